"""As-of joins: the latest earlier row of another side, per key, without a range join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: Column, right_time: Column, values: list[str], strict: bool = True, block: Callable[[str], Column] | None = None) -> DataFrame:
    """Adds ``values`` of the right row with the latest time before (or, not strict, at) the left time; null if none.

    Both sides are put in one order by time and the last right row is carried forward, so each key is sorted once and
    nothing is multiplied. Right rows that share a key and a time count as one of them. ``block`` gives the block of a
    time column (rising with it), over which a key is spread; without it a key is one block.
    """
    carried = F.struct(*[F.col(v) for v in values])
    sides = {"left": 0, "right": 1} if strict else {"left": 1, "right": 0}
    a = left.select(*keys, left_time.alias("__t"), F.lit(sides["left"]).alias("__side"), F.struct(*left.columns).alias("__row"))
    b = right.select(*keys, right_time.alias("__t"), F.lit(sides["right"]).alias("__side"), carried.alias("__value"))
    both = blocks.last_known(a.unionByName(b, allowMissingColumns=True), keys, ["__t", "__side"], F.lit(0) if block is None else block("__t"), "__value", "__latest")
    return both.where(F.col("__side") == sides["left"]).select("__row.*", *[F.col(f"__latest.{v}").alias(v) for v in values])
