"""Spelling variants: words that differ by one edit, found over words written in a reduced alphabet.

Letters are hashed to a few symbols. A word in these symbols has few neighbours at one edit, so all of them are generated
and joined with the reduced words of the vocabulary; what meets is verified on the words as written.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import CRC_SQL, crc_sql, light_batches, small, stored

LEAST_LETTERS, LEAST_COUNT, LEADS = 6, 5, 5
TYPOS = 199
#: Different words that a task counts before it hands its counts on.
HELD_WORDS = 400_000
#: Keys that are sent to all tasks, so that neighbours which no word has are left out early (8 bytes each).
SENT_KEYS = 2_000_000
#: Neighbours that are generated at once, of one word at least.
CELLS = 1 << 20

RUNS = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")


def counted(docs: DataFrame) -> DataFrame:
    """word, n: occurrences over all documents of runs of letters, some of them with a letter taken out.

    Only A-Z are lower-cased. A run loses one letter where the crc32 of ``<doc_id>:<run>`` divides by ``TYPOS``; in
    documents with a null id none does. Counts are added up in each task first, so a word that stands in most documents
    is a row a task. Null and empty texts have no run.
    """
    light_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not text:
                    continue
                before = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(RUNS.findall(text.encode().lower().decode())).items():
                    if before is not None and (h := zlib.crc32(run.encode(), before)) % TYPOS == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LETTERS:
                            continue
                    total[run] += n
                if len(total) > HELD_WORDS:
                    yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                    total.clear()
        yield pd.DataFrame({"word": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def alphabet(counts: dict[str, int], symbols: int) -> np.ndarray:
    """Symbol of each code point up to 255: letters by falling count, each to the symbol of least count so far."""
    held, out = [0] * symbols, np.zeros(256, np.int64)
    for letter, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        at = held.index(min(held))
        out[ord(letter)] = at
        held[at] += n
    return out


def written(words: list[str], table: np.ndarray) -> np.ndarray:
    """Symbols of words of one length, a row a word."""
    return table[np.array(words, f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1)]


def keys(words: np.ndarray, symbols: int) -> np.ndarray:
    """Hash of each reduced word: a sum over its places, so an edit changes it by a difference."""
    n = words.shape[1]
    return (mixed(np.arange(symbols, dtype=np.uint64))[words] * (mixed(np.arange(n, dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1))).sum(axis=1, dtype=np.uint64)


def neighbourhood(words: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every word at most one edit from each reduced word, each key once a row."""
    m, n = words.shape
    value = mixed(np.arange(symbols, dtype=np.uint64))
    place = mixed(np.arange(n + 1, dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)
    own = value[words]
    here = own * place[:n]
    left = np.zeros((m, n + 1), np.uint64)
    np.cumsum(here, axis=1, out=left[:, 1:])
    right = lambda x: np.concatenate([np.cumsum(x[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros((m, 1), np.uint64)], axis=1)
    later, sooner = right(own * place[1:]), right(np.concatenate([np.zeros((m, 1), np.uint64), own[:, 1:] * place[: n - 1]], axis=1))
    replaced = (left[:, n:] - here)[:, :, None] + place[:n, None] * value
    added = (left + later)[:, :, None] + place[:, None] * value
    taken = left[:, :n] + sooner[:, 1:]
    found = np.sort(np.concatenate([replaced.reshape(m, -1), added.reshape(m, -1), taken, left[:, n:]], axis=1), axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(fresh)[0], found[fresh]


def by_length(batch: pd.DataFrame, symbols: int, wide: bool) -> Iterator[pd.DataFrame]:
    """Parts of a batch whose words have one length, so few that their neighbours fit ``CELLS`` (one word at least)."""
    for n, part in batch.groupby(batch["word"].str.len()):
        rows = max(1, CELLS // ((2 * n + 1) * symbols + n + 1 if wide else n))
        for at in range(0, len(part), rows):
            yield part.iloc[at : at + rows]


def near_pairs(words: DataFrame, symbols: int | None = None, sent_keys: int = SENT_KEYS) -> DataFrame:
    """word, n, other, other_n: all ordered pairs of different words that are one edit apart.

    ``words`` (word, n) is stored and has each word once; letters are of U+0000 to U+00FF. By default the alphabet has
    as many symbols as the eighth root of the number of words, 4 at least and 2 more, so a reduced word stands for few words
    whatever their number. Up to ``sent_keys`` reduced words are sent to all tasks to leave out neighbours early; with
    more, all neighbours are joined. A word of n letters takes memory for about 2 n neighbours a symbol.
    """
    spark = words.sparkSession
    many = words.count()
    symbols = symbols or max(4, math.ceil(many**0.125)) + 2

    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for batch in batches:
            for word in batch["word"]:
                total.update(word)
        yield pd.DataFrame({"letter": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    summed = words.select("word").mapInPandas(letters, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    table = alphabet({r["letter"]: r["n"] for r in summed}, symbols)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in by_length(batch, symbols, False):
                yield pd.DataFrame({"key": keys(written(part["word"].tolist(), table), symbols).view(np.int64), "other": part["word"], "other_n": part["n"]})

    reduced = words.mapInPandas(reduce, "key long, other string, other_n long")
    there = None
    if many <= sent_keys:
        there = spark.sparkContext.broadcast(np.unique(np.array(reduced.select("key").toArrow()["key"], np.int64)))

    def surround(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in by_length(batch, symbols, True):
                row, key = neighbourhood(written(part["word"].tolist(), table), symbols)
                key = key.view(np.int64)
                if there is not None:
                    at = np.searchsorted(there.value, key)
                    at[at == len(there.value)] = 0
                    hit = there.value[at] == key
                    row, key = row[hit], key[hit]
                ids = part["id"].to_numpy()[row]
                for k in range(0, len(ids), CELLS):
                    yield pd.DataFrame({"id": ids[k : k + CELLS], "key": key[k : k + CELLS]})

    numbered = stored(words.withColumn("id", F.monotonically_increasing_id()), "numbered")
    variants = numbered.select("id", "word").mapInPandas(surround, "id long, key long")
    met = variants.join(reduced, "key").select("id", "other", "other_n").join(numbered, "id")
    near = (F.abs(F.char_length("word") - F.char_length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1)
    return met.where(near).select("word", "n", "other", "other_n")


def followed(links: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of ``links`` (word, form), where no chain returns to itself."""
    now = stored(links.select("word", F.col("form").alias("root")), "chains")
    while True:
        ahead = small(now).select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group(words: DataFrame, symbols: int | None = None, sent_keys: int = SENT_KEYS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a stored vocabulary (word, n), a row a word.

    A word's form is the near word of the largest n, of equal ones the first in code-point order, if it stands ``LEADS``
    times as often; else null. Root follows forms to their end; counts rise fivefold a step, so chains are short.
    """
    pairs = near_pairs(words, symbols, sent_keys)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other"))).alias("best"))
    leads = -F.col("best.m") >= LEADS * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.other")).alias("form"), F.when(leads, -F.col("best.m")).alias("form_n")
    )
    rows = stored(rows, "forms")
    ends = followed(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """Spelling variants of all documents' words (six letters or more, five occurrences or more).

    Null and empty texts have no words; repeated rows count each; an empty table has no rows. Only doc_id and text are
    read, whatever other columns are called.
    """
    return group(stored(counted(docs).where(F.col("n") >= LEAST_COUNT), "vocabulary"))


REPORT_SQL = f"""WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents WHERE text IS NOT NULL),
lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
hashed AS (SELECT *, doc_id::VARCHAR || ':' || run AS said FROM lowered),
marked AS (SELECT run, n, {crc_sql('said')}::BIGINT AS h FROM hashed, crc_t),
typed AS (SELECT CASE WHEN h % {TYPOS} = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, n FROM marked),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
holes AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS hole FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM holes AS a JOIN holes AS b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM holes AS a JOIN words AS b ON a.hole = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM holes AS a JOIN words AS b ON a.hole = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {LEADS} * n THEN other END AS form, CASE WHEN other_n >= {LEADS} * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root FROM forms UNION ALL SELECT s.word, f.form FROM steps AS s JOIN forms AS f ON f.word = s.root WHERE f.form IS NOT NULL),
ends AS (SELECT s.word, s.root FROM steps AS s JOIN forms AS f ON f.word = s.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
