"""Trading guards: stale feeds, latches and their edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks
from tidemark.operators.asof import as_of


DAY = 86400


def day_of(at: str) -> Column:
    """A block of time: a day."""
    return F.floor(F.unix_micros(at) / (DAY * 1_000_000))


def outages(trades: DataFrame, key: Sequence[str], at: str, limit: float) -> DataFrame:
    """Silences longer than ``limit`` seconds: key, outage_start (last trade before), outage_end (next trade).

    Trades are ordered day by day, so a key that holds most of them is spread over its days.
    """
    rows = blocks.lagged(trades.select(*key, F.col(at).alias("outage_end")), key, ["outage_end"], day_of("outage_end"), F.col("outage_end"), "outage_start")
    seconds = (F.unix_micros("outage_end") - F.unix_micros("outage_start")) / 1e6
    return rows.where(F.col("outage_start").isNotNull() & (seconds > limit)).select(*key, "outage_start", "outage_end")


def silence(ticks: DataFrame, trades: DataFrame, key: Sequence[str], limit: float) -> DataFrame:
    """Each tick (key, ts) with the last trade at or before it, its age in seconds and whether that is stale.

    A feed that never started is not stale. Ticks and trades are ordered day by day.
    """
    out = as_of(ticks, trades.select(*key, F.col("ts").alias("last_trade")), list(key), F.col("ts"), F.col("last_trade"), ["last_trade"], strict=False, block=day_of)
    age = (F.unix_micros("ts") - F.unix_micros("last_trade")) / 1e6
    return out.withColumn("age", age).withColumn("stale", F.coalesce(F.col("age") > limit, F.lit(False)))


def latch(ticks: DataFrame, key: Sequence[str], seq: str, enabled: Column, block: Column | None = None) -> DataFrame:
    """Whether trading is allowed at each tick: adds can_trade and tripped (sorted names).

    ``ticks`` has stale and violated. A violation trips for ever; staleness trips while it lasts and its recovery
    enables trading, even where the configuration (``enabled``) had not, unless a violation came first or since.
    ``block``, which rises with ``seq``, spreads a key over its blocks.
    """
    rows = blocks.running_any(ticks, key, [seq], F.lit(0) if block is None else block, {"__s": F.col("stale"), "__v": F.col("violated")})
    names = F.array_sort(F.array_compact(F.array(F.when(F.col("stale"), "stale_stream"), F.when(F.col("__v"), "stop_required"))))
    return rows.withColumns({"can_trade": ~F.col("stale") & ~F.col("__v") & (enabled | F.col("__s")), "tripped": names}).drop("__s", "__v")


def disabled_edges(states: DataFrame, key: Sequence[str], seq: str, block: Column | None = None) -> DataFrame:
    """Ticks at which trading was allowed before and is no more. ``block``, which rises with ``seq``, spreads a key."""
    rows = blocks.lagged(states, key, [seq], F.lit(0) if block is None else block, F.col("can_trade"), "__before")
    return rows.where("__before AND NOT can_trade").drop("__before")


def last_seen(rows: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """Latest time of each key."""
    return rows.groupBy(*key).agg(F.max(at).alias("last_seen"))
