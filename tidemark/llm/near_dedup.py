"""Near-duplicates by SetSketch: band register values, estimate jointly by likelihood, verify on full sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hot_keys, light_batches, small, spread_join, stored

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: How many standard errors below the threshold a likelihood still makes a candidate.
ERRORS = 4.5
#: Sets that are compared with as many others at a time.
BLOCK = 256
#: Members of a band whose registers are compared with as many others' at a time.
BAND_BLOCK = 1024
#: Candidate pairs a member that a group of a band gives as rows; where there are more its sets are compared in place.
PAIRS = 4
CANDIDATES = ["a", "b", "key", "one", "two", "side", "v", "c"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes (64 bits) of the distinct shingles of a text's words, ascending; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * GOLD + h[k : len(h) - n + 1 + k])
    return np.unique(out)


@dataclass(frozen=True)
class SetSketch:
    """Registers of exponentially spaced truncated minima.

    Register i of a set is floor(1 - log_b(min of exponential variates of its elements under hash i)), cut to
    0 .. top. The union of sets has the larger register each time; equal registers are likelier the more two sets
    share. Bands of ``rows`` registers: sets of Jaccard similarity 0.8 agree in none of ``registers / rows`` bands
    with probability (1 - 0.8 ** rows) ** bands at most: 2e-8 here.
    """

    registers: int = 132
    rows: int = 4
    base: float = 1.02
    top: int = 4000
    seed: int = 11

    @property
    def bands(self) -> int:
        return self.registers // self.rows

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        draw = rng.integers(0, 1 << 63, (2, self.registers), dtype=np.int64).astype(np.uint64)
        return draw[0] * np.uint64(2) + np.uint64(1), draw[1]

    def sketch(self, sets: list[np.ndarray]) -> np.ndarray:
        """Registers of sets, none of them empty."""
        a, b = self.coefficients()
        elements = np.concatenate(sets)
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        least = np.empty((len(sets), self.registers), np.uint64)
        for i in range(self.registers):
            least[:, i] = np.minimum.reduceat(elements * a[i] + b[i], starts)
        # -log of a uniform number is exponential and falls with it, so the least number gives the greatest variate;
        # taking 1 - u instead makes the least number the least variate.
        variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
        return np.clip(np.floor(1 - np.log(variate) / np.log(self.base)), 0, self.top).astype(np.int16)

    def band_keys(self, registers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A number for each band of each set; sets that agree in a band's registers agree in it."""
        keys = np.zeros((len(registers), self.bands), np.uint64)
        keys += mixed(np.arange(1, self.bands + 1, dtype=np.uint64) * GOLD)
        for k in range(self.rows):
            keys = mixed(keys ^ registers[:, k :: self.rows][:, : self.bands].astype(np.uint64) * GOLD)
        return keys

    def likelihood(self, plus: np.ndarray, minus: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
        """Most likely Jaccard similarity from the counts of registers that are larger in u, larger in v, and equal.

        u = n_u / (n_u + n_v) is the share of the first set; with similarity j a register is larger in u with
        probability p(u - v j) and in v with p(v - u j), where p(x) = -log_b(1 - x (b - 1) / b). The grid is fine
        enough for a filter.
        """
        grid = np.linspace(0, 1, 101)[:, None]
        u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (self.base - 1) / self.base) / np.log(self.base)
        up, down = np.clip(p(u - v * grid), 1e-12, 1), np.clip(p(v - u * grid), 1e-12, 1)
        same = np.clip(1 - up - down, 1e-12, 1)
        possible = (grid <= np.minimum(u / v, v / u) + 1e-9) | (grid == 0)
        score = plus * np.log(up) + minus * np.log(down) + (self.registers - plus - minus) * np.log(same)
        return grid[np.where(possible, score, -np.inf).argmax(axis=0), 0]

    def least(self, percent: int) -> float:
        """Likelihood estimates from here on make candidates: ``ERRORS`` standard errors below the threshold.

        The error is that of the counts' Fisher information for sets of one size: 0.035 for 132 registers, base 1.02.
        """
        j, c = percent / 100, (self.base - 1) / self.base
        p = -np.log1p(-(1 - j) / 2 * c) / np.log(self.base)
        slope = c / (1 - (1 - j) / 2 * c) / np.log(self.base) / 2
        return j - ERRORS / float(np.sqrt(self.registers * slope**2 * (2 / p + 4 / (1 - 2 * p))))

    def pairs(self, x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of rows of ``x`` and ``y`` that may link by size and likelihood and share ``band`` but no band before it."""
        same, earlier = np.zeros((len(x), len(y)), np.int16), np.zeros((len(x), len(y)), bool)
        step = max(1, 4_000_000 // max(1, len(y) * self.registers))
        for at in range(0, len(x), step):
            equal = x[at : at + step, None, :] == y[None, :, :]
            same[at : at + step] = equal.sum(axis=2, dtype=np.int16)
            if band:
                earlier[at : at + step] = equal[:, :, : band * self.rows].reshape(*equal.shape[:2], band, self.rows).all(axis=3).any(axis=2)
        # The share of equal registers is the likeness but for chance; likelihood, which knows the sizes, decides.
        likeness = self.least(percent)
        sized = (100 * n_x[:, None] >= percent * n_y[None, :]) & (100 * n_y[None, :] >= percent * n_x[:, None])
        i, j = np.nonzero(~earlier & sized & (same >= (likeness - 0.1) * self.registers))
        like = np.zeros(len(i))
        for s in range(0, len(i), 4096):
            p, q = i[s : s + 4096], j[s : s + 4096]
            like[s : s + 4096] = self.likelihood((x[p] > y[q]).sum(axis=1), (x[p] < y[q]).sum(axis=1), n_x[p].astype(float), n_y[q].astype(float))
        return i[like >= likeness], j[like >= likeness]


def sketched(docs: DataFrame, scheme: SetSketch, width: int) -> DataFrame:
    """doc_id, set size, digest of the set, registers and band keys of each row; nulls for empty sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                sets = [shingles(t, width) for t in part["text"]]
                sizes = np.array([len(s) for s in sets], np.int64)
                out = pd.DataFrame({"doc_id": part["doc_id"].to_numpy(object), "n": sizes})
                held = np.flatnonzero(sizes)
                digests, registers, keys = (np.full(len(sets), None, object) for _ in range(3))
                if len(held):
                    made = scheme.sketch([sets[i] for i in held])
                    for i, r, k in zip(held, made, scheme.band_keys(made, sizes[held]).view(np.int64), strict=True):
                        digests[i], registers[i], keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), r.tobytes(), k
                yield out.assign(digest=digests, registers=registers, keys=keys)

    light_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n long, digest binary, registers binary, keys array<long>")


def likely(pairs: DataFrame, sketches: DataFrame, scheme: SetSketch, percent: int) -> DataFrame:
    """Pairs (a, b) that may link: sizes allow it, and joint likelihood puts them above ``percent`` less a margin.

    Any number of pairs may have one ``a``; a ``b`` has one for each of its bands at most.
    """
    of = sketches.select("v", "n", "registers")
    both = spread_join(pairs, of.toDF("a", "n_a", "r_a"), "a", hot_keys(pairs, "a")).join(of.toDF("b", "n_b", "r_b"), "b")

    @F.pandas_udf("double")
    def estimate(r_a: pd.Series, r_b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        out = np.zeros(len(r_a))
        for s in range(0, len(r_a), 4096):
            x, y = (np.frombuffer(b"".join(r.iloc[s : s + 4096]), np.int16).reshape(-1, scheme.registers) for r in (r_a, r_b))
            out[s : s + 4096] = scheme.likelihood((x > y).sum(axis=1), (x < y).sum(axis=1), n_a.to_numpy(float)[s : s + 4096], n_b.to_numpy(float)[s : s + 4096])
        return pd.Series(out)

    fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    return both.where(fits).where(estimate("r_a", "r_b", "n_a", "n_b") >= scheme.least(percent)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    texts = packed_texts(docs, pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))))
    both = spread_join(pairs, texts.toDF("a", "t_a"), "a", hot_keys(pairs, "a"))
    both = spread_join(both, texts.toDF("b", "t_b"), "b", hot_keys(pairs, "b"))

    @F.pandas_udf("boolean")
    def near(t_a: pd.Series, t_b: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(t_a, t_b, strict=True):
            x, y = unpacked(a, width), unpacked(b, width)
            same = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * same >= percent * (len(x) + len(y) - same))
        return pd.Series(out)

    return both.where(near("t_a", "t_b")).select("a", "b")


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Compressed texts of the wanted ids, written once."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts], dtype=object)

    wanted = stored(wanted.distinct(), "wanted")
    if wanted.isEmpty():
        return wanted.select("v", F.lit(None).cast("binary").alias("packed"))
    wanted = small(wanted)
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("v"), F.col("text")).join(wanted, "v", "left_semi")
    return stored(rows.select("v", pack("text").alias("packed")).dropDuplicates(["v", "packed"]), "texts")


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Smallest vertex that each vertex reaches: v, c.

    Hash-to-min by rounds: each vertex points to the least of its own and its neighbours' labels, then labels are
    followed once (pointer jumping). A round is written to the shared folder, so lineage stays short; rounds end when
    no label changes. A hub, or the label of a large component, is a hot key; its rows are dealt to many tasks.
    """
    arcs = stored(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), "arcs")
    labels = vertices.select("v", F.col("v").alias("c"))
    touched = stored(arcs.select("v").distinct().withColumn("c", F.col("v")), "labels")
    if touched.isEmpty():
        return labels
    hubs = hot_keys(arcs, "w")
    while True:
        least = spread_join(arcs, touched.withColumnRenamed("v", "w"), "w", hubs).groupBy("v").agg(F.min("c").alias("m"))
        step = stored(touched.join(least, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")), "labels")
        follow = step.join(step.select("c").distinct().withColumnRenamed("c", "v"), "v", "left_semi").select(F.col("v").alias("c"), F.col("c").alias("cc"))
        step = stored(spread_join(step, follow, "c", hot_keys(step, "c")).select("v", "old", F.col("cc").alias("c")), "labels")
        touched = step.select("v", "c")
        if step.where(F.col("c") != F.col("old")).isEmpty():
            break
    return labels.join(touched.withColumnRenamed("c", "t"), "v", "left").select("v", F.coalesce("t", "c").alias("c"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, scheme: SetSketch | None = None) -> DataFrame:
    """Groups of near-duplicate documents.

    A document's set is its distinct ``width``-word shingles (A-Z lower-cased; a shorter text is one shingle). Texts
    link when 100 * intersection >= percent * union. Returns a row per row of ``docs``: doc_id, n_shingles,
    component_id (smallest doc_id reachable, itself included), kept (doc_id = component_id).

    Equal sets (128-bit digest of the set) become one class first. Classes meet in bands of equal registers. First a
    band's members are paired with its smallest member, so a group of any size gives one pair a member; pairs that
    joint likelihood puts within 4.5 standard errors of the threshold or above are verified on full sets
    and joined to components. Bands that then still hold several components are compared by registers, all members
    outside the band's largest component with all members (:func:`band_candidates`), and verified likewise. So every
    pair of a band is linked, in one component, or compared; links are lost only with the sketch's chance.

    Null or empty texts have no shingle and link with nothing; null ids stay alone with a null component; rows that
    repeat an id with unlike texts are joined by the id. Ids must be whole numbers (or cast to them). An empty table
    gives no rows.
    """
    scheme = scheme or SetSketch()
    sketches = stored(sketched(docs, scheme, width), "sketches")
    full = sketches.where("n > 0 AND doc_id IS NOT NULL")
    least = stored(full.groupBy("digest").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("many")), "class-heads")
    classes = spread_join(full.select("doc_id", "digest"), least.drop("many"), "digest", hot_keys(least, "digest", "many"))
    classes = stored(classes.select("doc_id", "v").distinct(), "classes")
    heads = classes.where("doc_id = v").select("v")
    own = full.withColumnRenamed("doc_id", "v").join(heads, "v", "left_semi").dropDuplicates(["v", "digest"])
    own = stored(own.select("v", "n", "registers", "keys"), "heads")

    members = own.select("v", F.posexplode("keys").alias("band", "key"))
    least = stored(members.groupBy("key").agg(F.min("v").alias("a"), F.count(F.lit(1)).alias("many")).where("many > 1"), "bands")
    banded = stored(spread_join(members, least.select("key", "a", "many"), "key", hot_keys(least, "key", "many")), "banded")
    met = stored(banded.where("a <> v").select("a", F.col("v").alias("b")).distinct(), "met")
    links = stored(verified(stored(likely(met, own, scheme, percent), "likely"), docs, percent, width), "links")
    labels = stored(components(links, heads), "components")

    pairs, crowds = band_candidates(banded.where("many > 2 AND a <> v").select("band", "key", "v"), own, labels, scheme, percent)
    more = stored(verified(pairs, docs, percent, width).unionByName(crowd_links(crowds, docs, percent, width)), "more-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = stored(components(links, heads), "components")

    repeated = classes.groupBy("doc_id").agg(F.min("v").alias("x"), F.max("v").alias("y")).where("x <> y")
    if not repeated.isEmpty():
        links = links.unionByName(classes.join(repeated, "doc_id").where("v <> x").select(F.col("x").alias("a"), F.col("v").alias("b")))
        labels = stored(components(links, heads), "components")
    found = spread_join(classes, labels, "v", hot_keys(classes, "v")).groupBy("doc_id").agg(F.min("c").alias("c")).withColumnRenamed("doc_id", "id")
    return sketches.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"), F.coalesce(F.coalesce("c", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def band_candidates(banded: DataFrame, own: DataFrame, labels: DataFrame, scheme: SetSketch, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidates among members of bands that are still of several components.

    ``banded``: members (band, key, v) without the one that each band was paired with. In a band the members outside
    its largest component are dealt to blocks of about ``BAND_BLOCK``, all members too, and each block of the first
    meets each of the second, so memory is bounded and a component that is joined already isn't compared with itself.
    A pair is compared in the first band that it shares. Returns the pairs (a, b) of groups that have up to
    ``PAIRS`` a member, and the members of other groups for :func:`crowd_links`, where pairs get no rows.
    """
    rows = stored(banded.join(labels, "v"), "band-components")
    parts = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    bands = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("most"))
    of = lambda n: F.ceil(n / BAND_BLOCK).cast("int")
    bands = bands.where("n > most.n").select("key", "n", F.col("most.c").alias("most"), of(F.col("n") - F.col("most.n")).alias("ones"), of(F.col("n")).alias("twos"))
    bands = stored(bands, "open-bands")
    rows = stored(spread_join(rows, bands.drop("n"), "key", hot_keys(bands, "key", "n")), "open-members")
    deal = lambda n: F.pmod(F.xxhash64("v"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    outside = rows.where("c <> most").select("band", "key", "v", "c", F.lit(0).alias("side"), deal(F.col("ones")).alias("one"), every(F.col("twos")).alias("two"))
    inside = rows.select("band", "key", "v", "c", F.lit(1).alias("side"), every(F.col("ones")).alias("one"), deal(F.col("twos")).alias("two"))
    filed = outside.unionByName(inside.select(*outside.columns)).join(own.select("v", "n", "registers"), "v")
    # A group is small in bytes but takes long, so its tasks are not to be merged by size.
    filed = filed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band", "key", "one", "two")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        side, v, c, n = (group[x].to_numpy() for x in ("side", "v", "c", "n"))
        registers = np.frombuffer(b"".join(group["registers"]), np.int16).reshape(-1, scheme.registers)
        i, j = scheme.pairs(registers[side == 0], registers[side == 1], n[side == 0], n[side == 1], int(key[0]), percent)
        one, two = v[side == 0], v[side == 1]
        told = (c[side == 0][i] != c[side == 1][j]) & ((one[i] < two[j]) | ~np.isin(two[j], one))
        i, j = i[told], j[told]
        if len(i) <= PAIRS * len(group):
            made = np.unique(np.stack([np.minimum(one[i], two[j]), np.maximum(one[i], two[j])], axis=1), axis=0)
            return pd.DataFrame({"a": made[:, 0], "b": made[:, 1], "key": None, "one": None, "two": None, "side": None, "v": None, "c": None}, columns=CANDIDATES)
        out = []
        for s, there in ((0, np.unique(i)), (1, np.unique(j))):
            ids, labels_of = (x[side == s][there] for x in (v, c))
            block, blocks = np.arange(len(there)) // BLOCK, (len(np.unique(j if s == 0 else i)) + BLOCK - 1) // BLOCK
            for other in range(blocks):
                at = (block, np.full(len(there), other)) if s == 0 else (np.full(len(there), other), block)
                place = [f"{key[0]}.{key[2]}.{key[3]}.{x}" for x in at[0]], at[1]
                out.append(pd.DataFrame({"a": None, "b": None, "key": key[1], "one": place[0], "two": place[1], "side": s, "v": ids, "c": labels_of}, columns=CANDIDATES))
        return pd.concat(out, ignore_index=True)

    found = filed.groupBy("band", "key", "one", "two").applyInPandas(compare, "a long, b long, key long, one string, two int, side int, v long, c long")
    found = stored(found, "candidates")
    return stored(found.where("a IS NOT NULL").select("a", "b").distinct(), "pairs"), found.where("a IS NULL").drop("a", "b")


def crowd_links(crowds: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Links between blocks of sets, as edges (a, b) that join what all their links join.

    Blocks hold ``BLOCK`` sets and are intersected as matrices, so no row is made for a pair.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        side, v, c = (group[x].to_numpy() for x in ("side", "v", "c"))
        sets = [unpacked(t, width) for t in group["packed"]]
        n = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(left) and len(right):
            same = intersections([sets[i] for i in left], [sets[i] for i in right])
            near = (100 * same >= percent * (n[left][:, None] + n[right][None, :] - same)) & (c[left][:, None] != c[right][None, :])
            top = {x: x for x in c.tolist()}
            for i, j in zip(*np.nonzero(near), strict=True):
                a, b = root(top, int(c[left[i]])), root(top, int(c[right[j]]))
                if a != b:
                    top[max(a, b)] = min(a, b)
                    found.append((int(v[left[i]]), int(v[right[j]])))
        return pd.DataFrame(found, columns=["a", "b"])

    texts = packed_texts(docs, crowds.select("v"))
    return spread_join(crowds, texts, "v", hot_keys(crowds, "v")).groupBy("key", "one", "two").applyInPandas(compare, "a long, b long")


def root(top: dict[int, int], x: int) -> int:
    """What ``x`` is joined to."""
    while top[x] != x:
        x = top[x]
    return x


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, over ``columns`` shared elements at a time."""
    out = np.zeros((len(left), len(right)))
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    at = [[np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)]) for s in side] for side in (left, right)]
    for start in range(0, len(shared), columns):
        parts = []
        for side in at:
            m = np.zeros((len(side), min(columns, len(shared) - start)), np.float32)
            for i, places in enumerate(side):
                m[i, places[np.searchsorted(places, start) : np.searchsorted(places, start + columns)] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def unpacked(packed: bytes, width: int) -> np.ndarray:
    """Shingles of a compressed text."""
    return shingles(zlib.decompress(packed).decode("utf-8", "surrogatepass"), width)


#: Every shared shingle of every pair, for small tables.
GROUPS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS v, a AS to_v FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.to_v),
m AS (SELECT v, min(to_v) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = d.doc_id
"""
