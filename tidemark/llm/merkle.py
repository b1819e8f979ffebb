"""Merkle manifest of a table: a tree of digests for each group of rows, one over their roots, and a proof for each row.

Nodes are kept as an append log in the order in which they complete (postorder). The log is written in pages: a builder
takes an aligned run of 2^height nodes, so the nodes of its page stand together in the log and the place of each follows
from the sizes of the subtrees before it. The roots of a tier of pages are the leaves of the next tier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import CRC_SQL, crc_sql, stored

HEIGHT = 10
TAMPERED = 7
DIGEST = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def stated(value: Column) -> Column:
    """A value with its length in bytes before it, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(stated, values)).cast("binary"), 256)


def levels_of(leaves: int) -> int:
    """Levels above the leaves of a whole tree."""
    return max(leaves - 1, 0).bit_length()


def position(level: int, index: int, leaves: int) -> int:
    """Place in the log of the node that is ``index``-th of its level, in a tree of ``leaves`` leaves.

    After e leaves, 2 e less the ones in e's binary form are complete. A node over leaves up to e follows all of them but
    its own ancestors that e completes too. Nodes at the right edge that never fill complete at the end, by level.
    """
    e = (index + 1) << level
    trailing = lambda x: (x & -x).bit_length() - 1
    if e <= leaves:
        return 2 * e - e.bit_count() - (trailing(e) - level) - 1
    return 2 * leaves - leaves.bit_count() + level - trailing(leaves) - 1


def completed(leaves: list[str], levels: int) -> list[str]:
    """All nodes over ``leaves``, ``levels`` high, in the order in which they complete."""
    log: list[str] = []
    waiting = [""] * (levels + 1)
    for node in leaves:
        level = 0
        log.append(node)
        while level < levels and waiting[level]:
            node, waiting[level] = digest(waiting[level] + node), ""
            level += 1
            log.append(node)
        waiting[level] = node
    node = ""
    for level in range(levels):
        if waiting[level] or node:
            node = digest(waiting[level] + node)
            log.append(node)
    return log


def siblings(log: bytes, index: int, leaves: int, levels: int) -> str:
    """Path from a leaf to the root of a page: for each level ``<`` or ``>`` (where the sibling stands) and its digest, or ``-``."""
    out = []
    for level in range(levels):
        other = (index >> level) ^ 1
        if other << level < leaves:
            at = 32 * position(level, other, leaves)
            out.append((">" if other & 1 else "<") + log[at : at + 32].hex())
        else:
            out.append("-")
    return "".join(out)


def steps(path: str) -> Iterator[tuple[str, str]]:
    """The steps of a path: side and sibling's digest."""
    at = 0
    while at < len(path):
        if path[at] == "-":
            yield "-", ""
            at += 1
        else:
            yield path[at], path[at + 1 : at + 1 + DIGEST]
            at += 1 + DIGEST


def folded(leaf: str, path: str) -> str:
    """Root that a leaf and the path of its siblings give."""
    for side, other in steps(path):
        leaf = digest(other + leaf if side == "<" else leaf + other)
    return leaf


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx (from 0, by ``order`` then digest) and n, the number of rows of a tree.

    Rows are dealt to ranges over all trees, so one large tree is spread over many tasks; ranges tell each other only
    their counts. Equal rows are dealt by a number of their own.
    """
    there = rows.withColumn("__row", F.monotonically_increasing_id())
    there = there.repartitionByRange("tree", *order, "digest", "__row").withColumn("__part", F.spark_partition_id())
    there = stored(there, "ranges")
    counts = there.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy("tree")).alias("n"))
    inside = Window.partitionBy("tree", "__part").orderBy(*order, "digest", "__row")
    placed = there.withColumn("idx", F.row_number().over(inside) - 1).join(starts, ["tree", "__part"])
    return placed.withColumn("idx", F.col("idx") + F.col("__start")).drop("__row", "__part", "__start")


def pages_of(nodes: DataFrame, height: int) -> DataFrame:
    """tree, block, n, leaves, levels, log (digests in order of completion), top: a page for each aligned run of 2^height nodes."""

    def build(key: tuple, run: pd.DataFrame) -> pd.DataFrame:
        n = int(run["n"].iloc[0])
        levels = height if n > 1 << height else levels_of(n)
        log = completed(run.sort_values("idx")["digest"].tolist(), levels)
        return pd.DataFrame({"tree": [key[0]], "block": [key[1]], "n": [n], "leaves": [len(run)], "levels": [levels], "log": [bytes.fromhex("".join(log))], "top": [log[-1]]})

    rows = nodes.select("tree", F.shiftright("idx", height).alias("block"), "idx", "n", "digest")
    return rows.groupBy("tree", "block").applyInPandas(build, "tree string, block long, n long, leaves int, levels int, log binary, top string")


def tiers_of(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The pages of each tier. ``nodes``: tree, idx, n, digest. Trees that end in a page have none in later tiers."""
    out = [stored(pages_of(nodes, height), "pages")]
    while True:
        above = out[-1].where(F.col("n") > 1 << height)
        if above.isEmpty():
            return out
        many = F.shiftright(F.col("n") - 1, height) + 1
        out.append(stored(pages_of(above.select("tree", F.col("block").alias("idx"), many.alias("n"), F.col("top").alias("digest")), height), "pages"))


def listed(tier: int, height: int):
    """Rows of the log for pages of a tier; nodes that a lower tier has as well are left out."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples(index=False):
                out = []
                for level in range(1 if tier else 0, p.levels + 1):
                    for i in range(-(-p.leaves >> level)):
                        at = 32 * position(level, i, p.leaves)
                        index = (p.block << (height - level)) + i
                        out.append((p.tree, position(tier * height + level, index, p.leaves_of_tree), tier * height + level, index, p.log[at : at + 32].hex()))
                yield pd.DataFrame(out, columns=["tree", "position", "level", "idx", "digest"])

    return rows


def log(tiers: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """tree, position, level, idx, digest: the whole log, a row a node."""
    sizes = tiers[0].groupBy("tree").agg(F.max("n").alias("leaves_of_tree"))
    out = None
    for tier, pages in enumerate(tiers):
        part = pages.join(sizes, "tree").mapInPandas(listed(tier, height), "tree string, position long, level int, idx long, digest string")
        out = part if out is None else out.unionByName(part)
    return out


def subroots(tiers: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """tree, subroot."""
    ends = [p.where(F.col("n") <= 1 << height).select("tree", F.col("top").alias("subroot")) for p in tiers]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def paths(nodes: DataFrame, pages: DataFrame, height: int) -> DataFrame:
    """tree, idx, path of each node through its page and on. ``pages`` has ``up``, the path from the page's root on."""

    def extract(key: tuple, run: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        p = page.iloc[0]
        found = [siblings(p["log"], int(i) & ((1 << height) - 1), int(p["leaves"]), int(p["levels"])) + p["up"] for i in run["idx"]]
        return pd.DataFrame({"tree": run["tree"], "idx": run["idx"], "path": found})

    a = nodes.select("tree", "idx", F.shiftright("idx", height).alias("block")).groupBy("tree", "block")
    return a.cogroup(pages.select("tree", "block", "leaves", "levels", "log", "up").groupBy("tree", "block")).applyInPandas(extract, "tree string, idx long, path string")


def with_paths(tiers: list[DataFrame], ends: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The pages of the first tier with ``up``. ``ends``: tree and up, the path from the tree's root on."""
    above = None
    for pages in reversed(tiers):
        up = ends.join(pages.where(F.col("n") <= 1 << height).select("tree", F.col("block")), "tree").select("tree", "block", "up")
        if above is not None:
            up = up.unionByName(above)
        reached = pages.join(up, ["tree", "block"])
        if pages is tiers[0]:
            return reached
        nodes = tiers[tiers.index(pages) - 1].where(F.col("n") > 1 << height).select("tree", F.col("block").alias("idx"))
        above = stored(paths(nodes, reached, height).select("tree", F.col("idx").alias("block"), F.col("path").alias("up")), "paths")
    raise ValueError("no pages")


def checked(leaves: DataFrame, pages: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Each leaf's ``proof_sha256`` (of its siblings' digests in order) and the root that its ``shown`` digest and they give.

    ``leaves``: tree, idx, shown and what else is to stay (``doc_id``, ``digest``); ``pages`` as of :func:`with_paths`.
    """

    def extract(key: tuple, run: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        p = page.iloc[0]
        found = [siblings(p["log"], int(i) & ((1 << height) - 1), int(p["leaves"]), int(p["levels"])) + p["up"] for i in run["idx"]]
        out = run[["tree", "doc_id", "digest"]].copy()
        out["proof_sha256"] = [digest("".join(other for _, other in steps(path))) for path in found]
        out["folded_root"] = [folded(leaf, path) for leaf, path in zip(run["shown"], found, strict=True)]
        return out

    kind = dict(leaves.dtypes)["doc_id"]
    a = leaves.select("tree", "doc_id", "digest", "shown", "idx", F.shiftright("idx", height).alias("block")).groupBy("tree", "block")
    b = pages.select("tree", "block", "leaves", "levels", "log", "up").groupBy("tree", "block")
    return a.cogroup(b).applyInPandas(extract, f"tree string, doc_id {kind}, digest string, proof_sha256 string, folded_root string")


def report(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A leaf for each row of documents, a tree for each lang, a root over all, and every row's proof tried.

    Values are null-safe (``-``), a null lang is a tree of its own, the first. Leaves ascend by doc_id, null first, then
    by digest, so rows that share an id have an order; equal rows are equal leaves, each with its own proof. A tampered
    row shows a leaf with 1 more in n_chars; null ids and null n_chars are not tampered with. An empty table has no rows
    and no root. Only the five columns are read, whatever others are called; texts are read once and never shuffled.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    own = row_digest(*[F.col(c) for c in names])
    other = row_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    leaves = docs.select("doc_id", tree.alias("tree"), own.alias("digest"), F.when(hit & F.col("n_chars").isNotNull(), other).alias("shown"))
    leaves = stored(numbered(stored(leaves.withColumn("shown", F.coalesce("shown", "digest")), "leaves"), ["doc_id"]), "numbered")
    tiers = tiers_of(leaves, height)
    ends = stored(subroots(tiers, height), "subroots")
    over = stored(numbered(ends.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest")), ["name"]), "numbered")
    tops = tiers_of(over, height)
    top = subroots(tops, height).first()
    ways = paths(over, with_paths(tops, ends.sparkSession.createDataFrame([("", "")], "tree string, up string"), height), height)
    ups = stored(over.join(ways, ["tree", "idx"]).select(F.col("name").alias("tree"), F.col("path").alias("up")), "paths")
    tried = checked(leaves, with_paths(tiers, ups, height), height)
    known = ends.withColumn("root", F.lit(top and top["subroot"]).cast("string"))
    return tried.join(known, "tree").select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _stated_sql(column: str, value: str | None = None) -> str:
    text = f"({value or column})::VARCHAR"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join([_stated_sql("doc_id"), _stated_sql("source"), _stated_sql("lang"), _stated_sql("n_chars", n_chars), _stated_sql("text")]) + ")"


REPORT_SQL = f"""WITH RECURSIVE {CRC_SQL},
named AS (SELECT doc_id, source, lang, n_chars, text, coalesce('=' || lang, '-') AS tree, doc_id::VARCHAR AS said FROM documents),
leaves AS MATERIALIZED (SELECT doc_id, tree, {_leaf_sql('n_chars')} AS leaf, CASE WHEN {crc_sql('said')} % {TAMPERED} = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END AS shown FROM named, crc_t),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2),
kept AS MATERIALIZED (SELECT * FROM nodes),
subs AS MATERIALIZED (SELECT tree, h AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS idx FROM kept WHERE n = 1),
tops AS (
  SELECT 0 AS level, idx, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, idx // 2),
upper AS MATERIALIZED (SELECT * FROM tops),
ways AS MATERIALIZED (
  SELECT p.doc_id, k.level, (p.idx // (1::BIGINT << k.level))::BIGINT AS at, o.h AS other
  FROM placed AS p JOIN (SELECT DISTINCT tree, level FROM kept WHERE n > 1) AS k ON k.tree = p.tree
  LEFT JOIN kept AS o ON o.tree = p.tree AND o.level = k.level AND o.idx = xor((p.idx // (1::BIGINT << k.level))::BIGINT, 1)
  UNION ALL
  SELECT p.doc_id, s.height + u.level, (s.idx // (1::BIGINT << u.level))::BIGINT, o.h
  FROM placed AS p JOIN subs AS s ON s.tree = p.tree, (SELECT DISTINCT level FROM upper WHERE n > 1) AS u
  LEFT JOIN upper AS o ON o.level = u.level AND o.idx = xor((s.idx // (1::BIGINT << u.level))::BIGINT, 1)),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(other, '' ORDER BY level), '')) AS proof_sha256 FROM ways GROUP BY doc_id),
folds AS (
  SELECT doc_id, 0::BIGINT AS level, shown AS h FROM placed
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(CASE WHEN w.at % 2 = 1 THEN coalesce(w.other, '') || f.h ELSE f.h || coalesce(w.other, '') END) FROM folds AS f JOIN ways AS w ON w.doc_id = f.doc_id AND w.level = f.level),
ends AS (SELECT doc_id, max_by(h, level) AS folded_root FROM folds GROUP BY doc_id)
SELECT p.doc_id, p.leaf, s.subroot, u.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = u.h AS verified
FROM placed AS p JOIN subs AS s ON s.tree = p.tree JOIN upper AS u ON u.n = 1 JOIN ends AS e ON e.doc_id = p.doc_id LEFT JOIN proofs AS q ON q.doc_id = p.doc_id"""
