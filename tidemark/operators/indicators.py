"""Indicators and the regime over bars, in sliding windows that match a bounded history of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import folds
from tidemark.operators.bars import series

SIGNAL_BARS, REGIME_BARS = 30, 210


def true_range() -> Column:
    """Largest of the bar's range and its distances from the close before; null on the first bar."""
    before = F.lag("close").over(series())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def change() -> Column:
    """Step from the close before; null on the first bar."""
    return F.col("close") - F.lag("close").over(series())


def with_changes(df: DataFrame) -> DataFrame:
    """Adds true_range, gain and loss; 0 on the first bar, where no fold looks at them."""
    zero = F.lit(0.0)
    return df.withColumns(
        {"true_range": F.coalesce(true_range(), zero), "gain": F.greatest(F.coalesce(change(), zero), zero), "loss": F.greatest(F.coalesce(-change(), zero), zero)}
    )


def windowed(column: str, bars: int) -> Column:
    """The last ``bars`` values of a series up to a bar, as an array."""
    return F.collect_list(column).over(series().rowsBetween(1 - bars, 0))


def with_ema(df: DataFrame, period: int, bars: int, name: str) -> DataFrame:
    return df.withColumn("__w", windowed("close", bars)).withColumn(name, folds.ema(F.col("__w"), period)).drop("__w")


def with_atr(df: DataFrame, period: int, bars: int, name: str = "atr") -> DataFrame:
    return with_changes(df).withColumn("__w", windowed("true_range", bars)).withColumn(name, folds.wilder(F.col("__w"), period)).drop("__w", "true_range", "gain", "loss")


def with_rsi(df: DataFrame, period: int, bars: int, name: str = "rsi") -> DataFrame:
    both = with_changes(df).withColumn("__g", windowed("gain", bars)).withColumn("__l", windowed("loss", bars))
    return both.withColumn(name, folds.strength(folds.wilder(F.col("__g"), period), folds.wilder(F.col("__l"), period))).drop("__g", "__l", "true_range", "gain", "loss")


def with_regime(df: DataFrame, bars: int = REGIME_BARS, fast: int = 50, slow: int = 200, atr_period: int = 14, least_range: float = 0.005) -> DataFrame:
    """Adds ema_fast, ema_slow, ema_slow_before, regime_atr, n_window and bullish.

    Bullish: close above the slow mean, fast mean above slow, slow mean above its value one bar earlier in the same
    window, and average true range above ``least_range`` of the close; with fewer than ``slow`` + 1 bars never. The
    earlier value drops the window's last element and keeps its seed, so it is not the value of the bar before.
    """
    w = with_changes(df).withColumn("__w", windowed("close", bars)).withColumn("__t", windowed("true_range", bars))
    n = F.size("__w")
    w = w.withColumns(
        {
            "n_window": n,
            "ema_fast": folds.ema(F.col("__w"), fast),
            "ema_slow": folds.ema(F.col("__w"), slow),
            "ema_slow_before": folds.ema(F.slice("__w", F.lit(1), n - 1), slow),
            "regime_atr": folds.wilder(F.col("__t"), atr_period),
        }
    )
    bullish = (
        (F.col("close") > F.col("ema_slow")) & (F.col("ema_fast") > F.col("ema_slow")) & (F.col("ema_slow") > F.col("ema_slow_before")) & (F.col("regime_atr") / F.col("close") > least_range)
    )
    return w.withColumn("bullish", F.coalesce(bullish & (F.col("n_window") > slow), F.lit(False))).drop("__w", "__t", "true_range", "gain", "loss")


def with_range_history(df: DataFrame, bars: int = 20) -> DataFrame:
    """Adds n_before, prior_high and prior_volume: count, highest high and mean volume of the ``bars`` bars before."""
    before = series().rowsBetween(-bars, -1)
    return df.withColumns({"n_before": F.count(F.lit(1)).over(before), "prior_high": F.max("high").over(before), "prior_volume": F.sum("volume").over(before) / bars})


def close_position() -> Column:
    """Where a bar closes in its range, 0 to 1; null without a range."""
    return F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))


def ema_series(df: DataFrame, period: int, name: str = "ema", block: int = 512) -> DataFrame:
    """The exponential mean of whole series from their first bar on, null before its seed.

    A step is affine in the mean before it, so a block of bars is too: each block's factor and offset come from its own
    bars, the mean at its start from the few blocks before it, and the means inside from a fold over the block. No
    array is longer than ``block`` or the number of blocks of a series.
    """
    size, rate = max(block, period), 2.0 / (period + 1)
    rows = df.select("symbol", "timeframe", "ts_open", "close").withColumn("block", F.floor((F.row_number().over(series()) - 1) / size))
    rows = rows.groupBy("symbol", "timeframe", "block").agg(F.array_sort(F.collect_list(F.struct("ts_open", "close"))).alias("s"))
    closes = F.transform("s", lambda x: x["close"])
    fold = F.aggregate(closes, F.lit(0.0), lambda a, x: (x - a) * rate + a)
    first = F.element_at(folds.running_ema(closes, period), -1)
    rows = rows.withColumn("step", F.struct("block", F.pow(F.lit(1 - rate), F.size("s")).alias("factor"), F.when(F.col("block") == 0, first).otherwise(fold).alias("offset")))
    before = F.collect_list("step").over(Window.partitionBy("symbol", "timeframe").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    start = F.aggregate(F.slice("before", F.lit(2), F.greatest(F.size("before") - 1, F.lit(0))), F.get("before", F.lit(0))["offset"], lambda a, x: a * x["factor"] + x["offset"])
    going = F.slice(F.aggregate(closes, F.array(F.col("start")), lambda a, x: F.array_append(a, (x - F.element_at(a, -1)) * rate + F.element_at(a, -1))), F.lit(2), F.size("s"))
    rows = rows.withColumn("before", before).withColumn("start", start)
    rows = rows.withColumn("e", F.when(F.col("block") == 0, folds.running_ema(closes, period)).otherwise(going))
    return rows.select("symbol", "timeframe", F.explode(F.arrays_zip("s", "e")).alias("x")).select("symbol", "timeframe", "x.s.ts_open", "x.s.close", F.col("x.e").alias(name))
