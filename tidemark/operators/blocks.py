"""Ordered passes over a key in blocks: rows are ordered within a block only, and blocks hand over what comes before.

``block`` rises with the order. What a block leaves behind is one row, found by partial aggregation, so a key that holds
a third of all rows is spread over its blocks and only these few rows are ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _handed_over(df: DataFrame, keys: Sequence[str], left: Column) -> DataFrame:
    """What stands before each block of a key, left by the last block before it that leaves any: the keys, __b, __base."""
    per_block = df.groupBy(*keys, "__block").agg(left.alias("__left"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.last("__left", ignorenulls=True).over(earlier)
    return per_block.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__b"), base.alias("__base"))


def _joined(rows: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__block").eqNullSafe(F.col("__b"))]
    return rows.join(base, on).drop("__block", "__b", *[f"__{k}" for k in keys])


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, out: str) -> DataFrame:
    """Adds ``value`` of the key's row before each row; null on the first."""
    rows = df.withColumn("__block", block).withColumn("__value", F.struct(value.alias("x")))
    base = _handed_over(rows, keys, F.max_by("__value", F.struct(*order)))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    rows = rows.withColumn("__lag", F.lag("__value").over(inside))
    return _joined(rows, base, keys).withColumn(out, F.coalesce("__lag", "__base")["x"]).drop("__value", "__lag", "__base")


def running_any(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, flags: dict[str, Column]) -> DataFrame:
    """Adds, for each name, whether its flag was true for the key at or before each row."""
    rows = df.withColumn("__block", block).withColumn("__value", F.struct(*[f.cast("int").alias(n) for n, f in flags.items()]))
    largest = F.struct(*[F.max(f"__value.{n}").alias(n) for n in flags])
    per_block = rows.groupBy(*keys, "__block").agg(largest.alias("__left"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = per_block.select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__b"), F.struct(*[F.max(f"__left.{n}").over(earlier).alias(n) for n in flags]).alias("__base")
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__in_{n}": F.max(f"__value.{n}").over(inside) for n in flags})
    rows = _joined(rows, base, keys)
    return rows.withColumns({n: F.coalesce(F.greatest(f"__in_{n}", f"__base.{n}"), F.lit(0)) > 0 for n in flags}).drop("__value", "__base", *[f"__in_{n}" for n in flags])


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, out: str) -> DataFrame:
    """Adds the last ``value`` that isn't null at or before each row of its key."""
    rows = df.withColumn("__block", block)
    base = _handed_over(rows, keys, F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__last", F.last(value, ignorenulls=True).over(inside))
    return _joined(rows, base, keys).withColumn(out, F.coalesce("__last", "__base")).drop("__last", "__base")
