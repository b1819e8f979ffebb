"""Mix sources to target weights: Efraimidis-Spirakis order, prefix sums to token budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small, stored, word_count


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Word targets of the sources.

    ``sizes`` has ``source`` and ``size``. Sources are taken by code point, null last, and get ``weights`` in turn.
    Together they share ``share`` times all words; a target stops at ``most`` times its source's size and the excess
    goes to the others by weight. Water filling in closed form: with sources ordered by cap / weight, the level is the
    first for which no later source is above its cap. The table has a row per source, so its windows are small.
    Returns source, source_size, target. No rows give no rows; sources without words get 0.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    caps = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    level = (
        share * F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    filled = caps.withColumn("level", level)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(whole)
    return filled.withColumn("at", first["level"]).select(
        "source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("weight"))).alias("target")
    )


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """A reproducible number in (0, 1) for an id: 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    bins: int = 1024,
    seed: str = "mix",
    broadcast_sources: int = 10_000,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Words that a mix takes of each document.

    A source with target t and s words takes floor(t / s) complete epochs, then t - s * floor(t / s) more words from
    documents in Efraimidis-Spirakis order: by u ** (1 / quality weight) descending, ties to the smaller id. The last
    document may be taken in part, so every source meets its target to a word, and no document is taken more often
    than its source's epochs plus one. ``quality`` has doc_id (each once) and weight; documents of weight 0 or less
    come last of all.

    Words are counted before anything is joined, so no text is shuffled; ``carry`` columns are, but only where there are
    too many weights to broadcast (they are counted). The order is never held by one task: keys
    fall into ``bins`` bins per source, sums of bins place each bin in the source's prefix sum, and only the bin that
    straddles the budget is ordered row by row. ``bins`` should grow with the rows of a source (a billion rows in one
    source: 65536). The plan has a row per source; it is broadcast when it was counted to have at most
    ``broadcast_sources`` rows, else joined by shuffle.

    Returns doc_id, source, the columns ``carry``, size, source_size, target, taken. Null text counts 0 words; ids
    without a weight count as 1; a null source is a source, the last; repeated rows count each; no rows give none.
    """
    rows = docs.select("doc_id", "source", *carry, word_count(F.col("text")).alias("size"))
    if quality is not None:
        known = stored(quality.select(F.col("doc_id").alias("weighed"), F.col("weight").cast("double").alias("w")), "mix-weights")
        rows = rows.join(small(known), F.col("doc_id") == F.col("weighed"), "left").drop("weighed").fillna(1.0, ["w"])
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    key = F.pow(uniform(F.col("doc_id"), seed), F.try_divide(F.lit(1.0), F.col("w")))
    rows = rows.withColumn("v", F.when(F.col("w") > 0, key).otherwise(F.lit(0.0))).drop("w")
    rows = stored(rows.withColumn("bin", F.floor((1.0 - F.col("v")) * bins).cast("int")), "mix-sizes")
    summed = rows.groupBy("source", "bin").agg(F.sum("size").alias("size"))
    targets = source_targets(summed, weights, share, most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    straddling = (
        summed.withColumn("below", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumnRenamed("source", "s")
        .join(targets, F.col("s").eqNullSafe(F.col("source")))
        .where((F.col("below") <= F.col("budget")) & (F.col("below") + F.col("size") > F.col("budget")))
        .groupBy("source")
        .agg(F.min("bin").alias("cut"), F.min_by("below", "bin").alias("below"))
    )
    plan = (
        targets.withColumnRenamed("source", "s")
        .join(straddling, F.col("s").eqNullSafe(F.col("source")), "left")
        .select(F.col("s"), "source_size", "target", "epochs", "budget", F.coalesce("cut", F.lit(bins + 1)).alias("cut"), F.coalesce("below", F.lit(0)).alias("below"))
    )
    plan = stored(plan, "mix-plan")
    placed = rows.join(F.broadcast(plan) if plan.count() <= broadcast_sources else plan, F.col("source").eqNullSafe(F.col("s")))
    sure = placed.where(F.col("bin") != F.col("cut")).withColumn("extra", F.when(F.col("bin") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    inside = Window.partitionBy("source").orderBy(F.desc("v"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("below") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    edge = placed.where(F.col("bin") == F.col("cut")).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return sure.unionByName(edge).select(
        "doc_id", "source", *carry, "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    )


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight, source_size::DOUBLE * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
a AS (SELECT arg_min(level, cap / weight) AS lvl FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN lvl IS NULL THEN cap ELSE least(cap, lvl * weight) END AS target FROM l, a),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
b AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS budget FROM e),
k AS (
  SELECT d.doc_id, d.source, d.size, pow((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE, 1.0::DOUBLE / coalesce(q.w, 1.0)) AS v
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY v DESC, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT p.doc_id, p.size, b.source_size, b.target,
  (b.epochs * p.size + greatest(0, least(p.size, b.budget - p.before)))::BIGINT AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""
