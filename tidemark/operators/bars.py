"""Bars from tapes in arrival order, and what is asked of bars."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIMEFRAMES = {"1m": 60, "1h": 3600, "4h": 14400}


def bucket(ts: Column, seconds: Column | int) -> Column:
    """Start of the time bucket in epoch seconds; a bucket of one second for other timeframes (null seconds)."""
    whole = F.floor(F.unix_micros(ts) / F.lit(1_000_000)).cast("long")
    step = F.coalesce(seconds if isinstance(seconds, Column) else F.lit(seconds), F.lit(1)).cast("long")
    return whole - F.pmod(whole, step)


def running_max(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``out``: the largest ``value`` of a key up to each row in order of seq.

    ``block`` rises with seq. The largest value of each block and the prefix maximum over the few blocks of a key come
    first; rows are then ordered within their block only, so a key that holds a third of all rows is spread over its
    blocks.
    """
    per_block = df.groupBy(*keys, "block").agg(F.max(value).alias("top"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = per_block.select(*keys, "block", F.max("top").over(earlier).alias("base"))
    inside = Window.partitionBy(*keys, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.max(value).over(inside)).join(base, [*keys, "block"]).withColumn(out, F.greatest(out, "base")).drop("base")


#: Columns that a trade must have.
WHOLE = ["symbol", "ts", "price", "size"]


def framed(timeframes: Mapping[str, int]) -> Column:
    """A row for each timeframe: timeframe, sec."""
    return F.explode(F.array(*[F.struct(F.lit(name).alias("timeframe"), F.lit(sec).alias("sec")) for name, sec in timeframes.items()]))


def placed(tape: DataFrame, timeframes: Mapping[str, int]) -> DataFrame:
    """Trades of each timeframe with the bar that they join in order of arrival (ts_open).

    A later time never falls in an earlier bucket, so the latest bucket so far is that of the latest time so far: trades
    are ordered once, for all timeframes.
    """
    rows = running_max(tape.dropna(subset=WHOLE).select("symbol", "price", "size", "ts", "seq", "block"), ["symbol"], "ts", "latest")
    return rows.select("symbol", "price", "size", "seq", "block", "latest", framed(timeframes).alias("f")).select("symbol", "price", "size", "seq", "block", "f.timeframe", bucket(F.col("latest"), F.col("f.sec")).alias("ts_open"))


def summed(rows: DataFrame) -> DataFrame:
    """Bars of placed trades, the last of each series too."""
    return rows.groupBy("symbol", "timeframe", "ts_open").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("size").alias("volume")
    )


def bars(tape: DataFrame, timeframes: Mapping[str, int] = TIMEFRAMES, keep_later: bool = False) -> DataFrame:
    """Completed bars of each symbol and timeframe: symbol, timeframe, ts_open, open, high, low, close, volume.

    A trade belongs to the latest bucket that its symbol has reached when it arrives, so a late trade joins the current
    bar and never an earlier one. A bar is complete once a later one exists: the last of each symbol and timeframe is
    left out. ``keep_later`` keeps where the next bar opens, which is when a bar is seen to close. There are no bars
    without trades. Trades without symbol, time, price or size are left out.
    """
    closed = completed(summed(placed(tape, timeframes)))
    return closed if keep_later else closed.drop("later")


def series(prefix: tuple[str, ...] = ("symbol", "timeframe")) -> Window:
    """Bars of a series in time."""
    return Window.partitionBy(*prefix).orderBy("ts_open")


def completed(made: DataFrame) -> DataFrame:
    """Bars that a later bar of the series has closed, with where that opens (later)."""
    return made.withColumn("later", F.lead("ts_open").over(series())).where("later IS NOT NULL")


def event_time_bars(tape: DataFrame, timeframes: Mapping[str, int] = TIMEFRAMES) -> DataFrame:
    """Bars by event time: each trade in the bucket of its own time, the last bar too (works on streams with a watermark).

    Trades without symbol, time, price or size are left out.
    """
    return summed(tape.dropna(subset=WHOLE).select("*", framed(timeframes).alias("f")).select("*", "f.timeframe", bucket(F.col("ts"), F.col("f.sec")).alias("ts_open")))


def last_bars(df: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series, oldest first (``place`` from 1)."""
    back = Window.partitionBy("symbol", "timeframe").orderBy(F.desc("ts_open"))
    kept = df.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)
    return kept.withColumn("place", F.row_number().over(series())).drop("back")


def bar_counts(df: DataFrame) -> DataFrame:
    """Number of bars of each series."""
    return df.groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("n_bars"))


def readiness(df: DataFrame, least: Mapping[str, int]) -> DataFrame:
    """Bars seen so far and whether they are enough for their timeframe."""
    seen = F.count(F.lit(1)).over(series().rowsBetween(Window.unboundedPreceding, 0))
    need = F.coalesce(*[F.when(F.col("timeframe") == k, F.lit(v)) for k, v in least.items()], F.lit(1))
    return df.withColumn("n_seen", seen).withColumn("ready", F.col("n_seen") >= need)


def gaps(df: DataFrame, timeframes: Mapping[str, int] = TIMEFRAMES) -> DataFrame:
    """Step from the bar before, whether it is longer than a bar, and whether any was so far (which disables a series)."""
    step = F.col("ts_open") - F.lag("ts_open").over(series())
    size = F.coalesce(*[F.when(F.col("timeframe") == k, F.lit(v)) for k, v in timeframes.items()], F.lit(1))
    marked = df.withColumn("step", step).withColumn("gap", F.coalesce(F.col("step") > size, F.lit(False)))
    return marked.withColumn("disabled", F.max("gap").over(series().rowsBetween(Window.unboundedPreceding, 0)))


def fresh_bars(feed: DataFrame) -> DataFrame:
    """Bars of a feed (in order of seq) that are later than all before them; repeated and older ones are ignored."""
    so_far = Window.partitionBy("symbol", "timeframe").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("ts_open").over(so_far)
    return feed.withColumn("top", top).where(F.col("top").isNull() | (F.col("ts_open") > F.col("top"))).drop("top")
