"""The next row of an ordered series that fits a condition, without a range join.

A flag is carried back by one pass over the series in reverse. A threshold that differs from query to query is looked up
in a pyramid of block maxima: each level holds, for a run of ``1 << BITS`` blocks of the level below, their highest values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A node has up to ``1 << BITS`` children; the children of the top level are all that there are.
BITS, LEVELS = 7, 4


def next_place(keys: Sequence[str], order: str, flag: Column, place: Column) -> Column:
    """``place`` (rising with ``order``) of the first later row whose flag holds; null without one.

    The frame grows with the reversed order, so a row costs the same however long the series is.
    """
    later = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.min(F.when(flag, place)).over(later)


def parent(node: Column, level: int, levels: int = LEVELS) -> Column:
    """The node that ``node`` belongs to, one level up."""
    return F.shiftright(node, BITS) if level + 1 < levels else F.lit(0).cast("long")


def pyramid(series: DataFrame, keys: Sequence[str], place: str, value: str, levels: int = LEVELS) -> DataFrame:
    """keys, level, parent, kids (node, high): block maxima of all levels. ``place`` is a number of 0 or more.

    Each level is an aggregate of the one below, so a key of any length is spread over its blocks. Null values are left
    out.
    """
    nodes = series.where(F.col(value).isNotNull()).select(*keys, F.col(place).cast("long").alias("node"), F.col(value).alias("high"))
    out = None
    for level in range(levels):
        kids = nodes.groupBy(*keys, parent(F.col("node"), level, levels).alias("parent")).agg(F.collect_list(F.struct("node", "high")).alias("kids"), F.max("high").alias("high"))
        rows = kids.select(*keys, F.lit(level).alias("level"), "parent", "kids")
        out = rows if out is None else out.unionByName(rows)
        nodes = kids.select(*keys, F.col("parent").alias("node"), "high")
    return out


def lookups(points: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``points`` (with at) once for each level: level, node and parent."""
    at = F.col("at").cast("long")
    looks = [F.struct(F.lit(k).alias("level"), F.shiftright(at, BITS * k).alias("node"), parent(F.shiftright(at, BITS * k), k, levels).alias("parent")) for k in range(levels)]
    return points.withColumn("__look", F.explode(F.array(*looks))).select(*points.columns, "__look.*")


def first_above(points: DataFrame, series: DataFrame, keys: Sequence[str], name: str, place: str, value: str, levels: int = LEVELS) -> DataFrame:
    """keys, name, found: for each point the first place after ``at`` whose value is above ``above``; points without one are left out.

    ``points``: keys, name (unique within its keys), at, above. On the way up a point meets one row a level, the children
    of the block that it stands in, and keeps the first later child that is high enough, of the lowest level that has
    one. On the way down it meets one row a level. So joins have points times levels rows whatever the distance.
    """
    ids = [*keys, name]
    tree = pyramid(series, keys, place, value, levels)
    high = lambda kid: kid["high"] > F.col("above")
    first = lambda fits: F.array_min(F.transform(F.filter("kids", fits), lambda kid: kid["node"]))
    met = lookups(points.select(*ids, "at", "above"), levels).join(tree, [*keys, "level", "parent"])
    met = met.withColumn("hit", first(lambda kid: (kid["node"] > F.col("node")) & high(kid))).where("hit IS NOT NULL")
    now = met.groupBy(*ids, "above").agg(F.min(F.struct("level", "hit")).alias("__at")).select(*ids, "above", "__at.level", "__at.hit")
    for level in range(levels - 1, 0, -1):
        below = tree.where(F.col("level") == level - 1).select(*keys, F.col("parent").alias("__node"), "kids")
        now = now.withColumn("__node", F.when(F.col("level") >= level, F.col("hit"))).join(below, [*keys, "__node"], "left")
        now = now.withColumn("hit", F.when(F.col("__node").isNull(), F.col("hit")).otherwise(first(high))).select(*ids, "above", "level", "hit")
    return now.select(*ids, F.col("hit").alias("found"))
