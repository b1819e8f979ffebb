"""Approximate nearest neighbours by cosine: query-directed multiprobe hashing with p-stable projections."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_path, stored

FOUND = "query_id long, vec_id long, score double"
RANKED = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Hashing:
    """Tables of Gaussian (2-stable) projections of unit vectors, cut into cells of one width."""

    tables: int = 16
    functions: int = 6
    width: float = 1.5
    first_probes: int = 8
    success: float = 0.95
    seed: int = 7

    def projections(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(dims, self.tables * self.functions)) / self.width, rng.uniform(0, 1, self.tables * self.functions)

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Place of each vector in each function of each table, in cells."""
        a, b = self.projections(unit.shape[1])
        return (unit @ a + b).reshape(len(unit), self.tables, self.functions)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One number for the cells of a table (the last axis)."""
        key = np.zeros(cells.shape[:-1], np.uint64)
        for k in range(cells.shape[-1]):
            key = (key ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        return key

    def visits(self, place: np.ndarray, distance: float | None) -> np.ndarray:
        """Keys of the cells that a query visits in each table, likeliest first.

        A neighbour at ``distance`` lies a normal deviate times ``distance`` along each projection, so a cell's chance
        is a product of normal masses; the home cell and all cells one step off are ordered by it. Visits stop where
        all tables together hold such a neighbour with probability ``success``; without a distance, after
        ``first_probes`` cells a table.
        """
        steps = np.array(list(itertools.product((-1, 0, 1), repeat=self.functions)))
        home = np.floor(place)
        edges = np.arange(-1, 3) - (place - home)[..., None]
        mass = np.diff(normal(edges * self.width / (1.0 if distance is None else max(distance, 1e-6))), axis=-1)
        chance = np.ones((self.tables, len(steps)))
        for f in range(self.functions):
            chance *= mass[:, f, steps[:, f] + 1]
        order = np.argsort(-chance, axis=1, kind="stable")
        n = self.first_probes
        if distance is not None:
            held = np.minimum(np.cumsum(np.take_along_axis(chance, order, 1), axis=1), 1.0)
            n = int(np.searchsorted(1 - np.prod(1 - held, axis=0), self.success)) + 1
        return self.keys(home[:, None, :] + steps[order[:, :n]])


def normal(x: np.ndarray) -> np.ndarray:
    """Normal distribution function, by a rational approximation (absolute error below 1e-6)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and size (number of components) of vectors that take part: not null, finite, not zero."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    return rows.where(finite & F.exists(e, lambda x: x != 0)).withColumn("size", F.size(e))


def hashed(vectors: DataFrame, hashing: Hashing) -> DataFrame:
    """Adds the key of each vector's cell in each table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = np.zeros((len(batch), hashing.tables), np.uint64)
            for size in batch["size"].unique():
                at = np.flatnonzero(batch["size"] == size)
                rows = np.array(batch["embedding"].iloc[at].tolist(), float)
                keys[at] = hashing.keys(np.floor(hashing.places(rows / norm(rows)[:, None])))
            yield batch.assign(keys=list(keys.view(np.int64)))

    return vectors.mapInPandas(run, "vec_id long, embedding array<double>, size int, keys array<long>")


def norm(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def blocks_of(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries in blocks of at most ``block``; no more than one block and one task's rows are held at a time."""
    ids, rows = [], []
    for row in queries.toLocalIterator():
        ids.append(row["vec_id"])
        rows.append(row["embedding"])
        if len(ids) == block:
            yield np.array(ids, np.int64), np.array(rows, float)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, float)


class Probes:
    """Which queries of a block ask for which cells: for each table its cells, ascending, and the queries of each."""

    def __init__(self, hashing: Hashing, units: np.ndarray, distances: np.ndarray | None):
        places = hashing.places(units)
        visits = [hashing.visits(p, None if distances is None else float(d)) for p, d in zip(places, np.zeros(len(places)) if distances is None else distances, strict=True)]
        askers = np.repeat(np.arange(len(visits), dtype=np.int32), [v.shape[1] for v in visits])
        self.tables = []
        for t in range(hashing.tables):
            keys = np.concatenate([v[t] for v in visits])
            order = np.argsort(keys, kind="stable")
            cells, first = np.unique(keys[order], return_index=True)
            self.tables.append((cells, np.append(first, len(keys)), askers[order]))

    def candidates(self, keys: np.ndarray, queries: int) -> np.ndarray:
        """Matrix (query, vector): whether a vector with ``keys`` lies in a cell that the query visits in some table."""
        near = np.zeros((queries, len(keys)), bool)
        for (cells, first, askers), key in zip(self.tables, keys.T, strict=True):
            at = np.minimum(np.searchsorted(cells, key), len(cells) - 1)
            there = np.flatnonzero(cells[at] == key)
            starts, counts = first[at[there]], first[at[there] + 1] - first[at[there]]
            flat = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
            near[askers[flat], np.repeat(there, counts)] = True
        return near


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best different ids of each query: largest score, then smallest id."""
    order = np.lexsort((-scores, ids, q))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[fresh]
    order = order[np.lexsort((ids[order], -scores[order], q[order]))]
    _, start, count = np.unique(q[order], return_index=True, return_counts=True)
    return order[np.arange(len(order)) - np.repeat(start, count) < k]


#: Vectors that are scored against a block of queries at a time.
CHUNK = 1024
#: Scores by matrix product may differ by this from the exact ones, which decide.
SLACK = 1e-9


def search_block(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, probes: Probes | None, k: int, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The k best candidates of each query of a block, read by ``read``; without probes all vectors are candidates."""
    norms = norm(queries)
    shared = vectors.sparkSession.sparkContext.broadcast((query_ids, queries, norms, probes))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q_rows, q_norms, cells = shared.value
        units = q_rows / q_norms[:, None]
        held_q, held_ids, held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(q_ids), -np.inf)
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                part = batch.iloc[start : start + CHUNK]
                ids, rows = part["vec_id"].to_numpy(np.int64), np.array(part["embedding"].tolist(), float)
                sizes = norm(rows)
                scores = units @ (rows / sizes[:, None]).T
                out = q_ids[:, None] == ids[None, :]
                if cells:
                    out |= ~cells.candidates(np.array(part["keys"].tolist(), np.int64).view(np.uint64), len(q_ids))
                scores[out] = -np.inf
                at_least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k]) if len(ids) >= k else least
                q, v = np.nonzero((scores >= at_least[:, None] - SLACK) & ~out)
                exact = (rows[v] * q_rows[q]).sum(axis=1) / (sizes[v] * q_norms[q])
                held_q, held_ids, held = np.concatenate([held_q, q]), np.concatenate([held_ids, ids[v]]), np.concatenate([held, exact])
                kept = best(held_q, held_ids, held, k)
                held_q, held_ids, held = held_q[kept], held_ids[kept], held[kept]
                full = np.bincount(held_q, minlength=len(q_ids)) == k
                least = np.full(len(q_ids), np.inf)
                np.minimum.at(least, held_q, held)
                least[~full] = -np.inf
        yield pd.DataFrame({"query_id": q_ids[held_q], "vec_id": held_ids, "score": held})

    columns = ["vec_id", "embedding", "keys"] if probes else ["vec_id", "embedding"]
    out = read(ranked(vectors.select(*columns).mapInPandas(find, FOUND), k))
    shared.destroy()
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int = 5, hashing: Hashing | None = None, block: int = 4096) -> DataFrame:
    """The k nearest found of each query by cosine, in double precision on the original vectors.

    Vectors are hashed once and stored with their keys. The stated queries go to the tasks in blocks of at most
    ``block``, one block at a time (some tens of MB with its probes, freed when the block is done); each task multiplies
    the block with its vectors, sets aside those outside the probed cells, takes the best of the others again exactly and
    keeps k a query, so vectors are never shuffled and a crowded cell stays spread over the tasks. A first round of a few probes bounds how far the
    k-th neighbour is; the second visits as many cells as find a neighbour at that distance with the wanted
    probability, however many vectors there are. A query that ends with fewer than k (or all) neighbours is searched
    again over all vectors.

    Returns query_id, rank, vec_id, score; ties go to the smaller vec_id. Vectors that are null, zero or not finite
    take no part; vectors of different lengths are searched apart, each query among those of its own length. Rows that
    repeat a vec_id count once with their best score, as a query with the smallest by hash. No vectors, no rows.
    """
    hashing = hashing or Hashing()
    every = stored(hashed(usable(vectors), hashing), "hashed-vectors")
    counts = every.groupBy("size").agg(F.count_distinct("vec_id").alias("n")).orderBy("size").collect()  # a row a length
    path = shared_path(vectors.sparkSession, "neighbours")
    out = vectors.sparkSession.createDataFrame([], RANKED)
    out.write.parquet(path)
    keep = lambda df: df.write.mode("append").parquet(path)
    for size, n in counts:
        rows = every.where(F.col("size") == size)
        queries = stored(rows.where(is_query).groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding")), "queries")
        for ids, matrix in blocks_of(queries, block):
            units = matrix / norm(matrix)[:, None]
            near = search_block(rows, ids, matrix, Probes(hashing, units, None), k, lambda df: df.where(F.col("rank") == k).select("query_id", "score").collect())
            distances = np.full(len(ids), 2.0)
            place = {int(q): i for i, q in enumerate(ids)}
            for r in near:
                distances[place[r["query_id"]]] = np.sqrt(max(0.0, 2 - 2 * r["score"]))
            found = search_block(rows, ids, matrix, Probes(hashing, units, distances), k, lambda df: stored(df, "block"))
            wanted = min(k, n - 1)
            full = {r["query_id"] for r in found.groupBy("query_id").count().where(F.col("count") >= wanted).collect()}  # ids of one block
            short = np.array([int(q) not in full for q in ids]) & (wanted > 0)
            keep(found)
            if short.any():
                more = search_block(rows, ids[short], matrix[short], None, k, lambda df: stored(df, "block"))
                keep(more.join(found, ["query_id", "vec_id"], "left_anti"))
    found = vectors.sparkSession.read.schema(RANKED).parquet(path)
    return ranked(found, k)
