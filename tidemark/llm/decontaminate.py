"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, light_batches, stored

WORD_CHARS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: ASCII outside digits and letters parts words; A-Z are lower-cased; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Normalised words; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


NONE, SEVERAL = -1, -2


class Automaton:
    """Generalised suffix automaton of word sequences.

    Every state stands for the substrings that end at the same places; ``longest`` is the longest of them and ``link``
    the state of the longest suffix that ends at more places. Items of at least ``window`` words mark, for states whose
    strings span ``window`` words, which items hold them; shorter items mark the state of their whole sequence.

    It is built over dictionaries and then packed: nearly all states have one way on and one item at most, which stand
    in arrays of 32-bit numbers, so what is broadcast takes about 24 bytes a state and dictionaries where ways part. For
    each state stands where its last ``window`` words (``span``) and the longest short item that ends it (``short``) are,
    so a word costs the same in texts and items that repeat themselves.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = array("i", [-1]), array("i", [0])
        coded = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for key, words in items if words]
        for _, codes in coded:
            state = 0
            for code in codes:
                state = self._extend(state, code)
        self.least = min([window, *(len(codes) for _, codes in coded)])
        self.whole: dict[int, list[tuple[int, object]]] = {}
        self.keys = list(dict.fromkeys(key for key, _ in coded))
        self.item = array("i", [NONE]) * len(self.link)
        self.more_items: dict[int, set[int]] = {}
        by_length = sorted(range(1, len(self.link)), key=self.longest.__getitem__)
        self.span = array("i", range(len(self.link)))
        for state in by_length:
            if self.longest[self.link[state]] >= window:
                self.span[state] = self.span[self.link[state]]
        self._mark(coded)
        self.short = array("i", [NONE]) * len(self.link) if self.whole else None
        for state in by_length if self.whole else ():
            self.short[state] = state if state in self.whole else self.short[self.link[state]]
        self.more_next = {state: ways for state, ways in enumerate(self.next) if len(ways) > 1}
        self.code = array("i", (NONE if not ways else SEVERAL if len(ways) > 1 else next(iter(ways)) for ways in self.next))
        self.to = array("i", (next(iter(ways.values()), NONE) for ways in self.next))
        del self.next

    def _extend(self, last: int, code: int) -> int:
        if (known := self.next[last].get(code)) is not None:
            if self.longest[known] == self.longest[last] + 1:
                return known
            return self._clone(last, code, known)
        state = self._add({}, self.longest[last] + 1)
        at = last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = state
            at = self.link[at]
        if at < 0:
            self.link[state] = 0
        else:
            known = self.next[at][code]
            self.link[state] = known if self.longest[known] == self.longest[at] + 1 else self._clone(at, code, known)
        return state

    def _add(self, edges: dict[int, int], longest: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.longest.append(longest)
        return len(self.link) - 1

    def _clone(self, at: int, code: int, known: int) -> int:
        copy = self._add(dict(self.next[known]), self.longest[at] + 1)
        self.link[copy] = self.link[known]
        self.link[known] = copy
        while at >= 0 and self.next[at].get(code) == known:
            self.next[at][code] = copy
            at = self.link[at]
        return copy

    def cut(self, state: int, n: int) -> int:
        """The state of the last ``n`` words, fewer than a window, of what ``state`` stands for."""
        state = self.span[state]
        while self.longest[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _mark(self, coded: list[tuple[object, list[int]]]) -> None:
        number = {key: i for i, key in enumerate(self.keys)}
        for key, codes in coded:
            state = 0
            for n, code in enumerate(codes, 1):
                state = self.next[state][code]
                if n >= self.window:
                    self._add_item(self.span[state], number[key])
            if len(codes) < self.window:
                self.whole.setdefault(self.cut(state, len(codes)), []).append((len(codes), key))

    def _add_item(self, state: int, item: int) -> None:
        held = self.item[state]
        if held == NONE:
            self.item[state] = item
        elif held == SEVERAL:
            self.more_items[state].add(item)
        elif held != item:
            self.item[state], self.more_items[state] = SEVERAL, {held, item}

    def step(self, state: int, code: int | None) -> int:
        """The state after one more word, ``NONE`` if no item goes on so."""
        way = self.code[state]
        if way == code:
            return self.to[state]
        return self.more_next[state].get(code, NONE) if way == SEVERAL else NONE

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of words inside windows that occur, and the items of these windows.

        Words outside the vocabulary end any match, so only runs of known words as long as the shortest window are
        walked.
        """
        spans: list[tuple[int, int]] = []
        found: set = set()
        codes = list(map(self.vocabulary.get, words))
        n, at = len(codes), 0
        while at < n:
            if codes[at] is None:
                at += 1
                continue
            end = at
            while end < n and codes[end] is not None:
                end += 1
            if end - at >= self.least:
                self._walk(codes, at, end, spans, found)
            at = end + 1
        return spans, found

    def _walk(self, codes: list[int | None], start: int, end: int, spans: list[tuple[int, int]], found: set) -> None:
        state = length = 0
        for i in range(start, end):
            code = codes[i]
            while (following := self.step(state, code)) < 0 and state:
                state = self.link[state]
                length = self.longest[state]
            if following < 0:
                continue
            state, length = following, length + 1
            if length < self.least:
                continue
            hit = length if length >= self.window else 0
            if hit:
                at = self.span[state]
                item = self.item[at]
                if item >= 0:
                    found.add(self.keys[item])
                elif item == SEVERAL:
                    found |= {self.keys[x] for x in self.more_items[at]}
            if self.whole:
                at = self.short[state]
                while at > 0:
                    for size, key in self.whole[at]:
                        if size <= length:
                            found.add(key)
                            hit = max(hit, size)
                    at = self.short[self.link[at]]
            if hit:
                first = i + 1 - hit
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Test items in blocks of at most ``block_words`` words (one item at least), streamed to the driver."""
    block, held = [], 0
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        words = words_of(row["t"])
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((row["i"], words))
        held += len(words)
    yield block


FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>"


def finder(automaton: Broadcast, clean: bool = False) -> Callable[[Column], Column]:
    """A column function: what one automaton finds in texts, and with ``clean`` the texts without it (null if nothing)."""

    @F.pandas_udf(FOUND + ", clean string" * clean)
    def matched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = words_of(text)
            spans, items = automaton.value.matches(words)
            starts, ends = [s for s, _ in spans], [e for _, e in spans]
            rows.append((len(words), starts, ends, sorted(str(i) for i in items if i is not None), *([without(text, starts, ends) if spans else None] * clean)))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items", *["clean"] * clean], dtype=object)

    return matched


def together(a: Column, b: Column) -> Column:
    """What two automata found together."""

    @F.pandas_udf(FOUND)
    def join(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for x, y in zip(old.itertuples(index=False), new.itertuples(index=False), strict=True):
            spans = merged([*zip(map(int, x.starts), map(int, x.ends), strict=True), *zip(map(int, y.starts), map(int, y.ends), strict=True)])
            rows.append((x.n_words, [s for s, _ in spans], [e for _, e in spans], sorted({*x.items, *y.items})))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return join(a, b)


def find(docs: DataFrame, benchmark: DataFrame, name: str, window: int = 10, id_col: str = "item_id", text_col: str = "text", block_words: int = 500_000, clean: bool = False) -> DataFrame:
    """Adds a struct column ``name``: n_words, starts and ends (word places of hit spans, end exclusive), items.

    Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII. A window is ``window``
    consecutive words of an item, or a whole shorter item. Items are ids as sorted strings. With ``clean`` the struct
    also has the text without hit spans (null without a hit).

    The benchmark reaches the tasks as automata of at most ``block_words`` words each. A larger benchmark is taken in
    blocks: a pass over the texts for each, whose result is written to the shared folder before the next begins, so a
    worker holds one automaton at a time and what is broadcast is bounded. No shuffle. Null or empty texts have no words; null items and items without words are never found, an item
    without an id hits words but isn't listed, and an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    light_batches(spark)
    source = blocks_of(benchmark, id_col, text_col, block_words)
    block, following = next(source), next(source, None)
    found = finder(spark.sparkContext.broadcast(Automaton(block, window)), clean and following is None)(F.col("text"))
    out = docs.withColumn(name, found)
    while following is not None:
        out = stored(out, "found")
        more = finder(spark.sparkContext.broadcast(Automaton(following, window)))(F.col("text"))
        out, following = out.withColumn(name, together(F.col(name), more)), next(source, None)
    if clean and "clean" not in out.schema[name].dataType.names:
        out = out.withColumn(name, F.col(name).withField("clean", cleaned(F.col("text"), F.col(name))))
    return out


def cleaned(text: Column, found: Column) -> Column:
    """Texts without their hit spans; null if there is none."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([without(t, s, e) if s is not None and len(s) else None for t, s, e in zip(texts, starts, ends, strict=True)], dtype=object)

    return cut(text, found["starts"], found["ends"])


def hit_words(found: Column) -> Column:
    """Words inside hit spans."""
    return F.aggregate(F.zip_with(found["ends"], found["starts"], lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, **columns) -> DataFrame:
    """Cut benchmark passages out of texts.

    Adds a struct column ``contamination`` (one of that name is replaced): n_words, n_hit, spans, items as :func:`find`
    gives them, clean_text (the text without hit spans; other words stay as written) and dropped (more than
    ``max_coverage`` of the words are hit). Null texts stay null.
    """
    held = free_name(docs, "found")
    out = find(docs.drop("contamination"), benchmark, held, window, clean=True, **columns)
    found = F.col(held)
    return out.withColumn(
        "contamination",
        F.struct(
            found["n_words"].alias("n_words"),
            hit_words(found).alias("n_hit"),
            F.zip_with(found["starts"], found["ends"], lambda s, e: F.struct(s.alias("start"), e.alias("end"))).alias("spans"),
            found["items"].alias("items"),
            F.coalesce(found["clean"], F.col("text")).alias("clean_text"),
            F.coalesce(hit_words(found) > F.lit(max_coverage) * found["n_words"], F.lit(False)).alias("dropped"),
        ),
    ).drop(held)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if text is None or starts is None or not len(starts):
        return text
    at = [m.span() for m in WORD_CHARS.finditer(text)]
    out, last = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return "".join([*out, text[last:]])


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Counts and digests of what :func:`find` finds."""
    found = F.col("found")
    return find(docs.select("doc_id", "text"), benchmark, "found", window).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        hit_words(found).alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (hit_words(found) > 0).alias("contaminated"),
    )


REPORT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM g),
p AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT p.r, p.i, p.n, g.item_id FROM p JOIN g ON p.n = g.n AND p.k = g.k),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""
