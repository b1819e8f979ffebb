"""Bars and indicators against event-at-a-time folds in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import folds
from tidemark.operators import bars as B
from tidemark.operators import blocks
from tidemark.operators import indicators as I
from tidemark.operators.asof import as_of

TRADES = "symbol string, price double, size double, ts timestamp, seq bigint, block bigint"


def tape(spark, rows, block=4):
    """rows: (symbol, seconds, price, size) in order of arrival."""
    data = [(s, float(p), float(z), t, i, i // block) for i, (s, t, p, z) in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, price double, size double, sec bigint, seq bigint, block bigint").withColumn("ts", F.timestamp_seconds("sec"))


def fold(rows, step):
    """Completed bars by the arrival rule, one trade at a time."""
    current, out = {}, []
    for symbol, t, p, z in rows:
        b, bar = t - t % step, current.get(symbol)
        if bar is None or b > bar[0]:
            if bar:
                out.append((symbol, *bar))
            current[symbol] = [b, p, p, p, p, z]
        else:
            bar[2], bar[3], bar[4], bar[5] = max(bar[2], p), min(bar[3], p), p, bar[5] + z
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_arrival_bars_with_late_trades(spark, seed):
    rng, t, rows = random.Random(seed), 0, []
    for _ in range(300):
        t += rng.randrange(0, 400)
        rows.append((rng.choice("AB"), max(0, t - rng.choice([0, 0, 0, 900])), rng.randrange(1, 50), rng.randrange(1, 5)))
    found = B.bars(tape(spark, rows), {"x": 600}).drop("timeframe").collect()
    assert sorted(tuple(r) for r in found) == fold(rows, 600)


def test_late_trade_joins_current_bar_and_last_bar_stays_open(spark):
    rows = [("A", 0, 1, 1), ("A", 3600, 2, 1), ("A", 10, 9, 1), ("A", 7200, 3, 1)]
    found = {r.ts_open: (r.high, r.volume) for r in B.bars(tape(spark, rows), {"1h": 3600}).collect()}
    assert found == {0: (1, 1), 3600: (9, 2)}


def test_empty_and_null_trades(spark):
    assert B.bars(spark.createDataFrame([], TRADES)).count() == 0
    rows = [(None, 1.0, 1.0, None, 0, 0), ("A", None, 1.0, None, 1, 0)]
    assert B.bars(spark.createDataFrame(rows, TRADES)).count() == 0


def ema_fold(xs, p):
    if len(xs) < p:
        return None
    e = sum(xs[:p]) / p
    for x in xs[p:]:
        e += (x - e) * 2 / (p + 1)
    return e


def wilder_fold(xs, p):
    if len(xs) <= p:
        return None
    a = sum(xs[1 : p + 1]) / p
    for x in xs[p + 1 :]:
        a = (a * (p - 1) + x) / p
    return a


@pytest.mark.parametrize("n", [0, 4, 5, 6, 7, 30])
def test_folds(spark, n):
    xs = [float((i * 7) % 11) for i in range(n)]
    v = F.lit(xs).cast("array<double>") if xs else F.array().cast("array<double>")
    row = spark.range(1).select(folds.ema(v, 5).alias("e"), folds.wilder(v, 5).alias("w"), folds.running_ema(v, 5).alias("r")).first()
    assert row.e == (None if (e := ema_fold(xs, 5)) is None else pytest.approx(e))
    assert row.w == (None if (w := wilder_fold(xs, 5)) is None else pytest.approx(w))
    assert len(row.r) == n and (n < 5 or row.r[-1] == pytest.approx(ema_fold(xs, 5)))


def series(spark, closes, spread=1.0):
    return spark.createDataFrame([("A", "1h", i * 3600, c, c + spread, c - spread, c, 1.0) for i, c in enumerate(closes)], "symbol string, timeframe string, ts_open bigint, open double, high double, low double, close double, volume double")


def test_ema_restarts_inside_its_window(spark):
    closes = [float((i * 13) % 37) for i in range(40)]
    found = [r.ema for r in I.with_ema(series(spark, closes), 5, 12, "ema").orderBy("ts_open").collect()]
    assert found == [None if (e := ema_fold(closes[max(0, i - 11) : i + 1], 5)) is None else pytest.approx(e) for i in range(40)]


def test_rsi_is_100_without_losses(spark):
    rows = I.with_rsi(series(spark, [float(i) for i in range(20)]), 14, 30).orderBy("ts_open").collect()
    assert [r.rsi for r in rows] == [None] * 14 + [100.0] * 6


def test_slope_drops_the_last_element_not_the_window(spark):
    closes = [float((i * 13) % 37) + i for i in range(30)]
    rows = I.with_regime(series(spark, closes), bars=12, fast=3, slow=6, atr_period=4, least_range=0.0).orderBy("ts_open").collect()
    for i, r in enumerate(rows):
        w = closes[max(0, i - 11) : i + 1]
        before = ema_fold(w[:-1], 6)
        assert r.ema_slow_before == (None if before is None else pytest.approx(before))
        assert r.bullish == (len(w) > 6 and closes[i] > ema_fold(w, 6) and ema_fold(w, 3) > ema_fold(w, 6) > before)


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([("A", 10), ("A", 11), ("B", 5)], "k string, t bigint")
    right = spark.createDataFrame([("A", 10, 1), ("A", 3, 0)], "k string, u bigint, v int")
    found = {(r.k, r.t): r.v for r in as_of(left, right, ["k"], F.col("t"), F.col("u"), ["v"]).collect()}
    assert found == {("A", 10): 0, ("A", 11): 1, ("B", 5): None}
    loose = {(r.k, r.t): r.v for r in as_of(left, right, ["k"], F.col("t"), F.col("u"), ["v"], strict=False).collect()}
    assert loose == {("A", 10): 1, ("A", 11): 1, ("B", 5): None}


def test_gap_disables_for_good_and_older_bars_are_ignored(spark):
    rows = spark.createDataFrame([("A", "1h", t * 3600, i) for i, t in enumerate([0, 1, 1, 3, 2, 4])], "symbol string, timeframe string, ts_open bigint, seq bigint")
    fresh = B.fresh_bars(rows)
    assert [r.ts_open // 3600 for r in fresh.orderBy("seq").collect()] == [0, 1, 3, 4]
    assert [r.disabled for r in B.gaps(fresh).orderBy("ts_open").collect()] == [False, False, True, True]


def test_blocks_give_what_whole_windows_give(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.randrange(9)]), rng.random() < 0.03) for i in range(400) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint, f boolean")
    blk = F.floor(F.col("i") / 23)
    before, known, ever = {}, {}, {}
    wanted = {}
    for k, i, v, f in rows:
        ever[k] = ever.get(k, False) or f
        known[k] = v if v is not None else known.get(k)
        wanted[i] = (before.get(k), known[k], ever[k])
        before[k] = v
    out = blocks.running_any(blocks.last_known(blocks.lagged(df, ["k"], ["i"], blk, F.col("v"), "lag"), ["k"], ["i"], blk, "v", "known"), ["k"], ["i"], blk, {"ever": F.col("f")})
    assert {r.i: (r.lag, r.known, r.ever) for r in out.collect()} == wanted and len(out.columns) == 7


def test_means_of_whole_series_in_blocks(spark):
    rng = random.Random(2)
    closes = {("A", "x"): [rng.uniform(50, 60) for _ in range(137)], ("B", "x"): [1.0, 2.0], ("C", "x"): [rng.uniform(1, 2) for _ in range(20)]}
    df = spark.createDataFrame([(*k, i * 60, c) for k, v in closes.items() for i, c in enumerate(v)], "symbol string, timeframe string, ts_open bigint, close double")
    got = {(r.symbol, r.ts_open): r.ema for r in I.ema_series(df, 5, block=16).collect()}
    for (symbol, _), v in closes.items():
        e = None
        for i, c in enumerate(v):
            e = None if i < 4 else sum(v[:5]) / 5 if i == 4 else (c - e) * (2 / 6) + e
            assert got[symbol, i * 60] == (None if e is None else pytest.approx(e, abs=1e-9))
