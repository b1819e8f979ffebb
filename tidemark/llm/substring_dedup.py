"""Repeated passages: a log-structured index of window fingerprints, joined with each new batch of documents.

A window of 20 words is filed under the smallest hash among its 8-word grams (a winnowed fingerprint), so equal windows
meet under equal fingerprints and a document files about a seventh as many fingerprints as it has words. Runs of the
index are immutable and sorted by fingerprint. A batch is handled in three steps:

1. its fingerprints are merged with the runs; a fingerprint that occurs twice or more is repeated;
2. windows filed under repeated fingerprints are verified: hashed over all their words (64 bits in order, 32 bits of
   an independent sum) and compared with each other and with the index, the earliest occurrence staying;
3. words that removed windows cover are cut.

A run keeps, by fingerprint, the place of the one occurrence, or a mark that it is repeated; and, by window, those
windows that were verified. A later batch that repeats a lone fingerprint re-reads that one place in the history; of
the history's texts only those with such a place are shuffled. A document is an id and a hash of its text, so texts
that share an id, or have none, stay apart.
Arrays travel in buckets of hashes. Each task reduces its own part first, so a passage with any number of copies sends
one record a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, free_name, light_batches, shared_path, stored, written

WINDOW, GRAM = 20, 8
FLUSH = 1_000_000
NO_ID = np.iinfo(np.int64).max
GOLD = np.uint64(0x9E3779B97F4A7C15)
ROW = "kind string, bucket int, keys binary, checks binary, docs binary, texts binary, owners binary, places binary, flags binary"
TYPES = {"keys": np.uint64, "checks": np.uint32, "docs": np.int64, "texts": np.int64, "places": np.int32, "flags": np.int8}
PLACE = ("docs", "texts", "places")
Records = dict[str, np.ndarray]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, window hashes, window checks, and for each window the gram that it is filed under."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def doubled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = min(len(a), len(b))
        return mixed(a[:n] * GOLD + b[:n])

    two = doubled(h, h[1:])
    four = doubled(two, two[2:])
    gram = doubled(four, four[4:])
    sixteen = doubled(gram, gram[8:])
    window = doubled(sixteen, four[16:])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h))])
    check = (mixed(sums[WINDOW:] - sums[:-WINDOW]) >> np.uint64(32)).astype(np.uint32)
    filed = np.lib.stride_tricks.sliding_window_view(gram, WINDOW - GRAM + 1).argmin(axis=1) + np.arange(len(window))
    return gram, window, check, filed


def packed(kind: str, records: Records, by: np.ndarray, buckets: int) -> pd.DataFrame:
    """A row for each bucket of ``by`` with its records, in the order given.

    Documents (docs, texts) stand once a row; records name them by place (owners), as a bucket holds many of each.
    """
    columns = ["kind", "bucket", *TYPES, "owners"]
    if not len(by):
        return pd.DataFrame([], columns=columns)
    bucket = (by % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    out = {"kind": kind, "bucket": there}
    for name in TYPES:
        whole = records.get(name)
        out[name] = [None] * len(there) if whole is None else [x.tobytes() for x in np.split(whole[order], first[1:])]
    out["owners"] = [None] * len(there)
    if "docs" in records:
        sort, starts, sizes = groups(records["texts"], records["docs"])
        number = np.empty(len(by), np.int64)
        number[sort] = np.repeat(np.arange(len(starts)), sizes)
        heads = sort[starts]
        for i, part in enumerate(np.split(number[order], first[1:])):
            held, owners = np.unique(part, return_inverse=True)
            out["owners"][i] = owners.astype(np.int32).tobytes()
            out["docs"][i], out["texts"][i] = (records[n][heads[held]].tobytes() for n in ("docs", "texts"))
    return pd.DataFrame(out, columns=columns)


def unpacked(rows: pd.DataFrame) -> Records:
    """All records of some rows."""
    parts = {n: [np.frombuffer(x, t) for x in rows[n] if x is not None] for n, t in TYPES.items()}
    owners = [np.frombuffer(x, np.int32) for x in rows["owners"] if x is not None]
    for n in ("docs", "texts"):
        parts[n] = [x[o] for x, o in zip(parts[n], owners, strict=True)]
    return {n: np.concatenate(parts[n] or [np.zeros(0, t)]) for n, t in TYPES.items()}


def doc_hash(docs: np.ndarray) -> np.ndarray:
    """What documents are bucketed by: the id."""
    return mixed(docs.view(np.uint64))


def joined(parts: list[Records]) -> Records:
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def groups(*keys: np.ndarray, by: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts records (the last array first), and group starts and sizes by the last ``by`` arrays."""
    order = np.lexsort(keys)
    same = np.ones(len(order), bool)
    for k in keys[-by:]:
        s = k[order]
        same[1:] &= s[1:] == s[:-1]
    same[:1] = False
    starts = np.flatnonzero(~same)
    return order, starts, np.diff([*starts, len(order)])


def firsts(r: Records) -> tuple[np.ndarray, np.ndarray]:
    """Of windows: the first of each, those of the index before others; and the rest that a batch must cut.

    First is the smaller id, then the earlier start, then the smaller hash of the text. A window that repeats the very
    place of the first is of an equal row, and no repetition.
    """
    order, starts, sizes = groups(r["texts"], r["places"], r["docs"], 1 - r["flags"], r["checks"], r["keys"])
    first = order[starts]
    lead = np.repeat(first, sizes)
    elsewhere = np.logical_or.reduce([r[n][order] != r[n][lead] for n in ("docs", "texts", "places")])
    return first, order[elsewhere & (r["flags"][order] == 0)]


def fingerprints(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 1 in each task: fingerprints, one a key; places of keys that repeat within the task are hits already."""

    def flush(parts: list[Records]) -> Iterator[pd.DataFrame]:
        r = joined(parts)
        order, starts, sizes = groups(r["keys"], by=1)
        again = np.repeat(sizes > 1, sizes)
        hits = order[again]
        yield packed("hit", {n: r[n][hits] for n in PLACE}, doc_hash(r["docs"][hits]), buckets)
        first = order[starts]
        one = {n: r[n][first] for n in ("keys", *PLACE)} | {"flags": (sizes > 1).astype(np.int8)}
        yield packed("print", one, one["keys"], buckets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            for doc, th, text in zip(batch["doc"], batch["th"], batch["text"], strict=True):
                words = words_of(text)
                if len(words) < WINDOW:
                    continue
                gram, _, _, filed = hashes(words)
                at = np.unique(filed)
                parts.append({"keys": gram[at], "docs": np.full(len(at), doc), "texts": np.full(len(at), th), "places": at.astype(np.int32)})
                held += len(at)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return docs.select("doc", "th", "text").mapInPandas(run, ROW)


def merge_prints(buckets: int):
    """Step 1 in each bucket: a batch's fingerprints against the runs of the index."""

    def merge(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        hits = new[new["kind"] == "hit"]
        out = [hits]
        mine, past = unpacked(new[new["kind"] == "print"]), unpacked(old)
        n = len(mine["keys"])
        r = {k: np.concatenate([mine[k], past[k]]) for k in ("keys", *PLACE, "flags")}
        fresh = np.arange(len(r["keys"])) < n
        order, starts, sizes = groups(r["keys"], by=1)
        if len(order):
            many = (sizes > 1) | (np.maximum.reduceat(r["flags"][order], starts) > 0)
            met = np.add.reduceat(fresh[order].astype(np.int64), starts) > 0
            lone = (r["flags"] == 0)[order]
            told = order[np.repeat(many & met, sizes) & lone]
            out.append(packed("hit", {k: r[k][told] for k in PLACE}, doc_hash(r["docs"][told]), buckets))
            first = order[starts][met]
            run = {k: r[k][first] for k in ("keys", *PLACE)} | {"flags": many[met].astype(np.int8)}
            out.append(packed("print", run, run["keys"], buckets))
        return pd.concat(out, ignore_index=True)

    return merge


def places_by_doc(rows: DataFrame, name: str) -> DataFrame:
    """Places of each document, ascending, as one binary: doc, th, ``name``. Rows are bucketed by document."""

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        r = unpacked(group)
        order, starts, _ = groups(r["places"], r["texts"], r["docs"])
        first = order[starts]
        return pd.DataFrame({"doc": r["docs"][first], "th": r["texts"][first], name: [np.unique(p).tobytes() for p in np.split(r["places"][order], starts[1:])]})

    return rows.groupBy("bucket").applyInPandas(gather, f"doc long, th long, {name} binary")


def windows(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 2 in each task: windows filed under hit places; all but the first of a task are removed already.

    ``docs``: doc, th, text, hits, old (whether the document is in the index). Flags mark windows of the index.
    """

    def flush(parts: list[Records]) -> Iterator[pd.DataFrame]:
        r = joined(parts)
        first, later = firsts(r)
        yield packed("cut", {n: r[n][later] for n in PLACE}, doc_hash(r["docs"][later]), buckets)
        yield packed("window", {n: r[n][first] for n in TYPES}, r["keys"][first], buckets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            for doc, th, text, hits, old in zip(batch["doc"], batch["th"], batch["text"], batch["hits"], batch["old"], strict=True):
                words = words_of(text)
                if len(words) < WINDOW:
                    continue
                _, window, check, filed = hashes(words)
                hit = np.zeros(len(words), bool)
                at = np.frombuffer(hits, np.int32)
                hit[at[at < len(words)]] = True
                w = np.flatnonzero(hit[filed])
                parts.append({"keys": window[w], "checks": check[w], "docs": np.full(len(w), doc), "texts": np.full(len(w), th), "places": w.astype(np.int32), "flags": np.full(len(w), old, np.int8)})
                held += len(w)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return docs.select("doc", "th", "text", "hits", "old").mapInPandas(run, ROW)


def merge_windows(buckets: int):
    """Step 2 in each bucket: the first of equal windows stays, those of the index before those of the batch."""

    def merge(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        mine, past = unpacked(new[new["kind"] == "window"]), unpacked(old)
        past |= {k: np.full(len(past["keys"]), 1 if k == "flags" else -1, TYPES[k]) for k in (*PLACE, "flags")}
        r = {k: np.concatenate([mine[k], past[k]]) for k in TYPES}
        n = len(mine["keys"])
        first, later = firsts(r)
        cut = packed("cut", {k: r[k][later] for k in PLACE}, doc_hash(r["docs"][later]), buckets)
        first = first[first < n]
        run = {k: r[k][first] for k in ("keys", "checks")}
        return pd.concat([new[new["kind"] == "cut"], cut, packed("window", run, run["keys"], buckets)], ignore_index=True)

    return merge


class FingerprintIndex:
    """Runs of fingerprints (``print``) and verified windows (``window``) in folders.

    The newest manifest names the runs that count; runs and manifests are never changed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, fanout: int = 2):
        self.spark, self.path, self.buckets, self.fanout = spark, path, buckets, fanout
        self.runs: dict[str, list[tuple[int, str]]] = {"print": [], "window": []}
        self.version = 0

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that was last saved under ``path``."""
        rows = spark.read.parquet(f"{path}/manifest").collect()
        last = max(r["version"] for r in rows)
        now = sorted((r for r in rows if r["version"] == last), key=lambda r: r["place"])
        index = cls(spark, path, now[0]["buckets"], now[0]["fanout"])
        index.version = last
        for r in now:
            index.runs[r["kind"]].append((r["level"], r["run"]))
        return index

    def save(self) -> None:
        """Write a manifest of the runs."""
        self.version += 1
        rows = [(self.version, i, kind, level, run, self.buckets, self.fanout) for kind, runs in self.runs.items() for i, (level, run) in enumerate(runs)]
        schema = "version int, place int, kind string, level int, run string, buckets int, fanout int"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def rows(self, kind: str) -> DataFrame:
        """Rows of all runs of a kind."""
        paths = [run for _, run in self.runs[kind]]
        return self.spark.read.schema(ROW).parquet(*paths).where(F.col("kind") == kind) if paths else self.spark.createDataFrame([], ROW)

    def add(self, kind: str, rows: DataFrame) -> DataFrame:
        """Write rows as a new run and read them back (rows of other kinds too, which are no part of the run).

        ``fanout`` runs of a level are merged into one of the next.
        """
        run = f"{self.path}/run-{uuid.uuid4().hex}"
        out = written(rows, run)
        runs = self.runs[kind]
        runs.append((0, run))
        while len(level := [r for r in runs if r[0] == runs[-1][0]]) >= self.fanout:
            merged = f"{self.path}/run-{uuid.uuid4().hex}"
            old = self.spark.read.schema(ROW).parquet(*[r for _, r in level]).where(F.col("kind") == kind)
            written(old.groupBy("bucket").applyInPandas(compacted(self.buckets), ROW), merged)
            runs[:] = [r for r in runs if r not in level] + [(level[0][0] + 1, merged)]
        return out


def compacted(buckets: int):
    """Runs of one bucket as one sorted run: a record a key, repeated where it is in several runs."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        kind, r = group["kind"].iloc[0], unpacked(group)
        if kind == "print":
            order, starts, sizes = groups(r["places"], r["docs"], r["keys"], by=1)
            flags = ((sizes > 1) | (np.maximum.reduceat(r["flags"][order], starts) > 0)).astype(np.int8)
            first = order[starts]
            return packed(kind, {k: r[k][first] for k in ("keys", *PLACE)} | {"flags": flags}, r["keys"][first], buckets)
        order, starts, _ = groups(r["checks"], r["keys"])
        first = order[starts]
        return packed(kind, {k: r[k][first] for k in ("keys", "checks")}, r["keys"][first], buckets)

    return merge


def keyed(docs: DataFrame) -> DataFrame:
    """doc (the id, the largest number for null), th (hash of the text) and text of rows with a text."""
    return docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc"), F.xxhash64("text").alias("th"), "text")


def only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` of the wanted documents (doc, th; stored), before any shuffle where these were counted to be few."""
    ids = wanted.select("doc", "th")
    return rows.join(F.broadcast(ids), ["doc", "th"], "left_semi") if ids.count() <= BROADCAST_ROWS else rows


def find_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame | None) -> DataFrame:
    """Index a batch; returns doc, th and cuts (starts of its removed windows, as one binary of int32).

    ``history``: the documents (doc_id, text) behind the index, re-read only where a lone fingerprint is met again.
    """
    buckets, batch = index.buckets, keyed(batch)
    prints = fingerprints(batch, buckets).groupBy("bucket").cogroup(index.rows("print").groupBy("bucket")).applyInPandas(merge_prints(buckets), ROW)
    prints = index.add("print", prints)
    hits = stored(places_by_doc(prints.where("kind = 'hit'"), "hits"), "hits")
    texts = batch.withColumn("old", F.lit(0))
    if history is not None:
        texts = texts.unionByName(keyed(history).withColumn("old", F.lit(1)))
    found = windows(only(texts, hits).join(hits, ["doc", "th"]), buckets)
    found = found.groupBy("bucket").cogroup(index.rows("window").groupBy("bucket")).applyInPandas(merge_windows(buckets), ROW)
    found = index.add("window", found)
    index.save()
    return places_by_doc(found.where("kind = 'cut'"), "cuts")


def cut_words(text: str | None, cuts: bytes | None) -> tuple[int, int, str | None]:
    """Number of words, number removed, and the kept words joined by a space (null for null)."""
    words = words_of(text)
    if cuts is None or not words:
        return len(words), 0, None if text is None else b" ".join(words).decode("utf-8", "surrogatepass")
    edge = np.zeros(len(words) + WINDOW + 1, np.int64)
    at = np.frombuffer(cuts, np.int32)
    at = at[at < len(words)]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    gone = np.cumsum(edge)[: len(words)] > 0
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")


def dedup(docs: DataFrame, batches: tuple[float, ...] = (0.25,), bucket_docs: int = 1000, fanout: int = 2) -> DataFrame:
    """Remove every word covered by a 20-word window whose words also start earlier.

    Earlier is a smaller doc_id, or the same document at an earlier start; windows are judged on the input. Documents
    go to the index in batches of ascending ids, cut at the quantiles ``batches`` of doc_id. ``buckets`` (4 times the
    shuffle partitions by default) bounds a group: about 13 bytes times the fingerprints of a batch over ``buckets``.

    Adds a struct ``passages``: n_words, n_removed, text (kept words joined by a space); a column of that name is
    replaced. Null texts have no words and stay null. Null ids come last. Unlike texts under one id, or without an id,
    are documents of their own: each loses its own windows only, and of windows that start at one place of both that of
    the smaller text hash is first. Rows that repeat an id and its text are one document and get equal results. Ids
    must be whole numbers (or cast to them). An empty table gives no rows.
    """
    spark = docs.sparkSession
    light_batches(spark)
    buckets = max(64, docs.count() // bucket_docs)
    index = FingerprintIndex(spark, shared_path(spark, "fingerprints"), buckets, fanout)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    edges = rows.agg(F.percentile_approx("doc_id", list(batches), 10_000).alias("e")).collect()[0]["e"] or [] if batches else []
    edges = sorted(set(edges))
    cuts = None
    for n in range(len(edges) + 1):
        low = F.col("doc_id") > edges[n - 1] if n else F.lit(True)
        high = F.col("doc_id") <= edges[n] if n < len(edges) else F.lit(True)
        if n == len(edges) and n:
            low = low | F.col("doc_id").isNull()
        part = find_batch(index, rows.where(low & high), rows.where(F.col("doc_id") <= edges[n - 1]) if n else None)
        cuts = part if cuts is None else cuts.unionByName(part)

    cuts = stored(cuts, "cuts")
    name, doc, th = (free_name(docs, n) for n in ("cuts", "doc", "th"))

    @F.pandas_udf("n_words long, n_removed long, text string")
    def cleaned(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut_words(t, c) for t, c in zip(texts, starts, strict=True)], columns=["n_words", "n_removed", "text"])

    rows = docs.drop("passages").withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))).withColumn(th, F.xxhash64("text"))
    keys = cuts.select(F.col("doc").alias(doc), F.col("th").alias(th))
    cuts = cuts.toDF(doc, th, name)
    if keys.count() <= BROADCAST_ROWS:  # only texts that are cut need to meet their cuts
        whole = rows.join(F.broadcast(keys), [doc, th], "left_anti").withColumn(name, F.lit(None).cast("binary"))
        both = rows.join(F.broadcast(keys), [doc, th], "left_semi").join(cuts, [doc, th]).unionByName(whole)
    else:
        both = rows.join(cuts, [doc, th], "left")
    return both.withColumn("passages", cleaned("text", name)).drop(name, doc, th)


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of :func:`dedup`."""
    p = F.col("passages")
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", p["n_words"].alias("n_words"), p["n_removed"].alias("n_removed"), F.sha2(F.coalesce(p["text"], F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


REPORT_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM p),
c AS (SELECT DISTINCT r, x FROM (SELECT r, unnest(range(i, i + 20)) AS x FROM f WHERE n > 1)),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d),
k AS (SELECT u.r, count(*) AS n, string_agg(u.word, ' ' ORDER BY u.x) AS kept FROM u LEFT JOIN c ON u.r = c.r AND u.x = c.x WHERE c.x IS NULL GROUP BY u.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
