"""Breakout, retest and continuation setups over bars, as set operations on candidates and one ordered choice per symbol."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators import search
from tidemark.operators.asof import as_of


@dataclass(frozen=True)
class SetupParams:
    """Parameters of the detector; the defaults are its fixed values."""

    signal: str = "1h"
    regime: str = "4h"
    signal_sec: int = 3600
    regime_sec: int = 14400
    signal_window: int = 30
    regime_window: int = 210
    least_signal: int = 25
    least_regime: int = 205
    fast: int = 50
    slow: int = 200
    least_range: float = 0.005
    lookback: int = 20
    volume_factor: float = 1.25
    least_position: float = 0.70
    rsi_low: float = 56.0
    rsi_high: float = 74.0
    retest_bars: int = 5
    zone_below: float = 0.5
    zone_above: float = 0.2
    chase: float = 0.8
    atr_period: int = 14
    rsi_period: int = 14
    stop_at_gaps: bool = True


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("ts_open")


def setup_bars(made: DataFrame, p: SetupParams = SetupParams()) -> DataFrame:
    """Signal bars that the detector would process, numbered from 1 (idx), with indicators and the regime they see.

    ``made``: bars of both timeframes with ``later``. A signal bar that closes at ``later`` sees regime bars that opened
    before the regime bucket of ``later``. Bars before both histories are long enough are left out; so are, with
    ``stop_at_gaps``, all bars from the first missing signal or regime bar on.
    """
    signal = made.where(F.col("timeframe") == p.signal)
    signal = I.with_range_history(I.with_atr(I.with_rsi(signal, p.rsi_period, p.signal_window), p.atr_period, p.signal_window), p.lookback)
    signal = signal.withColumn("n_seen", F.count(F.lit(1)).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    regime = I.with_regime(made.where(F.col("timeframe") == p.regime), p.regime_window, p.fast, p.slow, p.atr_period, p.least_range)
    context = regime.select("symbol", F.col("ts_open").alias("regime_ts"), F.col("n_window").alias("n_regime"), "bullish")
    seen = as_of(signal, context, ["symbol"], F.col("later") - F.pmod(F.col("later"), F.lit(p.regime_sec)), F.col("regime_ts"), ["regime_ts", "n_regime", "bullish"])
    ready = seen.where((F.col("n_seen") >= p.least_signal) & (F.col("n_regime") >= p.least_regime))
    if p.stop_at_gaps:
        step = lambda c: F.coalesce(F.col(c) - F.lag(c).over(by_symbol()), F.lit(0))
        broken = (step("ts_open") > p.signal_sec) | (step("regime_ts") > p.regime_sec)
        ready = ready.withColumn("broken", broken).withColumn("broken", F.max("broken").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).where("NOT broken").drop("broken")
    return ready.withColumn("idx", F.row_number().over(by_symbol()))


def is_breakout(p: SetupParams) -> Column:
    """Closes above the prior high on volume, near the top of its range, with a strength inside the band, in a bullish regime."""
    return F.coalesce(
        F.col("bullish")
        & (F.col("close") > F.col("prior_high"))
        & (F.col("volume") > p.volume_factor * F.col("prior_volume"))
        & (I.close_position() >= p.least_position)
        & F.col("rsi").between(p.rsi_low, p.rsi_high),
        F.lit(False),
    )


def is_retest(bar: Column, level: Column, midpoint: Column, p: SetupParams) -> Column:
    """Low inside the zone around the level, close above level and midpoint of the breakout."""
    zone = (bar["low"] >= level - bar["atr"] * p.zone_below) & (bar["low"] <= level + bar["atr"] * p.zone_above)
    return zone & (bar["close"] > level) & (bar["close"] > midpoint)


def breakouts(bars: DataFrame, p: SetupParams = SetupParams()) -> DataFrame:
    """Breakout candidates: symbol, idx, ts_open, level, midpoint, bear (idx of the next bearish bar), ahead (next bars)."""
    rows = bars.withColumns(
        {
            "bear": search.next_place(["symbol"], "ts_open", ~F.col("bullish"), F.col("idx")),
            "ahead": F.collect_list(F.struct("idx", "low", "high", "close", "atr")).over(by_symbol().rowsBetween(1, p.retest_bars)),
        }
    )
    return rows.where(is_breakout(p)).select("symbol", "idx", "ts_open", F.col("prior_high").alias("level"), ((F.col("high") + F.col("low")) / 2).alias("midpoint"), "bear", "ahead")


def retests(candidates: DataFrame, p: SetupParams = SetupParams()) -> DataFrame:
    """Adds retest: the first of the next bars, before the regime turns, that comes back to the level and holds."""
    ok = lambda x: is_retest(x, F.col("level"), F.col("midpoint"), p) & (F.col("bear").isNull() | (x["idx"] < F.col("bear")))
    return candidates.withColumn("retest", F.get(F.filter("ahead", ok), F.lit(0))).drop("ahead")


def continuations(found: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds next_bar: the first bar after the retest that closes above the retest's high, if no bearish bar comes before it.

    The bar is looked up by block maxima (:func:`tidemark.operators.search.first_above`), so a setup costs the same however
    long it waits.
    """
    waiting = found.where("retest IS NOT NULL").select("symbol", "idx", F.col("retest.idx").alias("at"), F.col("retest.high").alias("above"))
    hits = search.first_above(waiting, bars, ["symbol"], "idx", "idx", "close")
    after = bars.select("symbol", F.col("idx").cast("long").alias("found"), F.struct("idx", "ts_open", "close", "atr", "rsi").alias("next_bar"))
    first = hits.join(after, ["symbol", "found"]).select("symbol", "idx", "next_bar")
    rows = found.join(first, ["symbol", "idx"], "left")
    return rows.withColumn("next_bar", F.when(F.col("bear").isNull() | (F.col("next_bar.idx") < F.col("bear")), F.col("next_bar")))


def outcomes(bars: DataFrame, p: SetupParams = SetupParams()) -> DataFrame:
    """What becomes of each candidate taken alone: outcome, and release (first idx at which its symbol is free again; null: never)."""
    found = continuations(retests(breakouts(bars, p), p), bars)
    missed = F.least(F.col("bear"), F.col("idx") + p.retest_bars + 1) + 1
    chased = (F.col("next_bar.close") - F.col("level")) > p.chase * F.col("next_bar.atr")
    return found.withColumn(
        "outcome",
        F.when(F.col("retest").isNull(), F.when(F.col("bear") <= F.col("idx") + p.retest_bars + 1, "bearish").otherwise("expired"))
        .when(F.col("next_bar").isNotNull(), F.when(chased, "chased").otherwise("signal"))
        .when(F.col("bear").isNotNull(), "bearish")
        .otherwise("waiting"),
    ).withColumn("release", F.when(F.col("retest").isNull(), missed).when(F.col("next_bar").isNotNull(), F.col("next_bar.idx") + 1).otherwise(F.col("bear") + 1))


def greedy_chain(df: DataFrame, key: str, start: str, release: str) -> DataFrame:
    """Rows taken one after the other for each key: the first by ``start``, then the first that starts at or after the release of the last taken one.

    A null release never frees the key. Candidates of a key (breakouts or signals, not bars) are folded as one array.
    """
    step = lambda acc, x: F.when(
        acc["free"] <= x["start"], F.struct(F.coalesce(x["release"], F.lit((1 << 62))).alias("free"), F.array_append(acc["taken"], x["start"]).alias("taken"))
    ).otherwise(acc)
    zero = F.struct(F.lit(-(1 << 62)).cast("long").alias("free"), F.array().cast("array<bigint>").alias("taken"))
    slots = F.array_sort(F.collect_list(F.struct(F.col(start).cast("long").alias("start"), F.col(release).cast("long").alias("release"))))
    taken = df.groupBy(key).agg(F.aggregate(slots, zero, step, lambda acc: acc["taken"]).alias("taken"))
    return df.join(taken.select(key, F.explode("taken").alias(start)), [key, start], "left_semi")


def signal_id(symbol: Column, ts: Column) -> Column:
    """A reproducible id of a setup."""
    return F.sha2(F.concat_ws("|", symbol, ts.cast("string")).cast("binary"), 256)


def signals(bars: DataFrame, p: SetupParams = SetupParams()) -> DataFrame:
    """Signals of the detector, with status NEW."""
    taken = greedy_chain(outcomes(bars, p).withColumn("idx", F.col("idx").cast("long")), "symbol", "idx", "release").where("outcome = 'signal'")
    return taken.select(
        signal_id(F.col("symbol"), F.col("ts_open")).alias("signal_id"),
        "symbol",
        F.lit("LONG").alias("signal_type"),
        F.concat(F.lit("ATR:"), F.col("next_bar.atr").cast("string"), F.lit("_LEVEL:"), F.col("level").cast("string")).alias("regime_snapshot"),
        F.struct(F.col("next_bar.atr").alias("atr"), "level").alias("snapshot"),
        F.col("level").alias("breakout_level"),
        F.col("retest.low").alias("retest_level"),
        F.col("next_bar.atr").alias("atr"),
        F.col("next_bar.rsi").alias("rsi"),
        F.lit("NEW").alias("status"),
        F.col("next_bar.close").alias("execution_price"),
        F.col("next_bar.ts_open").alias("signal_ts"),
    )
