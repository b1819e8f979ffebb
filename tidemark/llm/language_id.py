"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import light_batches

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
PARTING = re.compile(r"[\W\d_]")
#: Characters that are looked up at once, for eight languages or fewer.
BLOCK_CHARS = 1 << 20


def letter_stream(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """Lower-case words of letters with a space before each, by parts of a text of about ``size`` that end between words."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            parting = PARTING.search(text, end)
            end = parting.start() if parting else len(text)
        words = LETTERS.findall(text[start:end].lower())
        if words:
            yield " " + " ".join(words)
        start = end


def parts(text: str | None, longest: int, size: int = BLOCK_CHARS) -> list[tuple[str, int]]:
    """The words of a text (with spaces before, between and after) in pieces, and at how many of its characters n-grams start.

    Pieces overlap by the longest n-gram less one character, so each n-gram is in one of them whole. A text without a
    letter has none.
    """
    out, held, lettered = [], "", False
    for chunk in letter_stream(text or "", size):
        lettered = lettered or any(map(str.isalpha, chunk))
        held += chunk
        at = 0
        while len(held) - at > size + longest:
            out.append((held[at : at + size + longest - 1], size))
            at += size
        held = held[at:]
    return [*out, (held + " ", len(held) + 1)] if lettered else []


def blocks(pieces: list[tuple[str, int]], size: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of about ``size`` characters together, one piece at least."""
    start = held = 0
    for i, (t, _) in enumerate(pieces):
        if held and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(pieces):
        yield start, len(pieces)


def grams(pieces: list[tuple[str, int]], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each character, for each order (``buckets`` where none does); where pieces start."""
    codes = np.frombuffer("".join(t for t, _ in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t, _ in pieces])
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))
    counted = left > np.repeat(lengths - np.array([n for _, n in pieces]), lengths)
    out = np.full((len(orders), len(codes)), buckets, np.int32)
    for row, n in enumerate(orders):
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[row, : len(h)] = np.where((left[: len(h)] >= n) & counted[: len(h)], (h % np.uint64(buckets)).astype(np.int32), buckets)
    return out, ends - lengths


def fit(docs: DataFrame, train: Column, orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 14, sample: int = 20_000, most_languages: int = 256) -> dict:
    """Log probabilities of n-gram buckets by language.

    Learns from rows where ``train`` holds and lang isn't null: those of ``sample`` ids at most, the first by hash of
    the id, so reruns agree. Counts are added up by Spark; the model is a matrix of ``buckets`` by languages (float32, 64 KB a
    language), refused beyond ``most_languages``. Without a training row the model has no language.
    """
    light_batches(docs.sparkSession)
    known = docs.where(train & F.col("lang").isNotNull()).select(F.xxhash64("doc_id").alias("h"), "lang", "text")
    chosen = known.select("h").orderBy("h").limit(sample).distinct()
    rows = known.join(F.broadcast(chosen), "h", "left_semi").select("lang", "text").repartition(16)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                texts = [p for t in group["text"] if (p := parts(t, max(orders)))]
                docs_of[lang] = docs_of.get(lang, 0) + len(texts)
                total, pieces = totals.setdefault(lang, np.zeros(buckets + 1)), [x for t in texts for x in t]
                for a, b in blocks(pieces):
                    total += np.bincount(grams(pieces[a:b], orders, buckets)[0].ravel(), minlength=buckets + 1)
        yield pd.DataFrame({"lang": pd.Series(list(totals), dtype=object), "docs": [docs_of[k] for k in totals], "counts": [v.tobytes() for v in totals.values()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c) for c in group["counts"])
        return pd.DataFrame({"lang": pd.Series([group["lang"].iloc[0]], dtype=object), "docs": [int(group["docs"].sum())], "counts": [total.tobytes()]})

    schema = "lang string, docs long, counts binary"
    summed = rows.mapInPandas(count, schema).groupBy("lang").applyInPandas(add, schema).where("docs > 0").orderBy("lang").limit(most_languages + 1).collect()
    if len(summed) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    matrix = np.zeros((buckets + 1, len(summed)), np.float32)
    for k, row in enumerate(summed):
        counts = np.frombuffer(row["counts"])[:buckets] + 0.5
        matrix[:buckets, k] = np.log(counts / counts.sum())
    docs_in = np.array([row["docs"] for row in summed], float)
    return {"languages": [row["lang"] for row in summed], "matrix": matrix, "prior": np.log(docs_in / max(docs_in.sum(), 1)), "orders": orders, "buckets": buckets}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Adds a struct ``language`` (lang, score) from whole texts.

    The score is the posterior probability of the named language. Very long texts are looked up piece by piece. Null texts and texts without a letter give ``und``
    and 0, as do all texts under a model without a language. A column named ``language`` is replaced.
    """
    light_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def name(column: pd.Series) -> pd.DataFrame:
        m = shared.value
        langs, scores = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        if not m["languages"]:
            return pd.DataFrame({"lang": pd.Series(langs, dtype=object), "score": scores})
        size = 8 * BLOCK_CHARS // max(8, len(m["languages"]))
        texts = [parts(t, max(m["orders"]), size) for t in column]
        held = np.array([i for i, t in enumerate(texts) if t], int)
        pieces, of = [x for t in texts for x in t], np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        total = np.tile(m["prior"], (len(texts), 1))
        for a, b in blocks(pieces, size):
            found, starts = grams(pieces[a:b], m["orders"], m["buckets"])
            for row in found:
                np.add.at(total, of[a:b], np.add.reduceat(m["matrix"][row], starts, axis=0, dtype=np.float64))
        if len(held):
            best = total[held].argmax(axis=1)
            langs[held] = np.array(m["languages"], object)[best]
            scores[held] = 1 / np.exp(total[held] - total[held].max(axis=1, keepdims=True)).sum(axis=1)
        return pd.DataFrame({"lang": pd.Series(langs, dtype=object), "score": scores})

    return docs.withColumn("language", name(F.col("text")))
