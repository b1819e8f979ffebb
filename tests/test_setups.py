"""Setups as set operations against a bar-at-a-time detector, and the lifecycle of one setup."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pytest

from tidemark.operators import setups as S
from tidemark.streaming.monitors import Setup, advance

P = S.SetupParams(stop_at_gaps=False)
BARS = "symbol string, ts_open bigint, idx int, open double, high double, low double, close double, volume double, bullish boolean, prior_high double, prior_volume double, atr double, rsi double"


def frame(spark, rows):
    return spark.createDataFrame(rows, BARS)


def detect(rows):
    """Signals of one symbol by stepping through its bars."""
    state, out = Setup(), []
    for _, ts, _, _, high, low, close, volume, bullish, prior_high, prior_volume, atr, rsi in rows:
        rise = high > low and (close - low) / (high - low) >= 0.7
        breakout = bullish and close > prior_high and volume > 1.25 * prior_volume and rise and 56 <= rsi <= 74
        bar = SimpleNamespace(ts_open=ts, low=low, high=high, close=close, atr=atr, rsi=rsi, bullish=bullish, breakout=breakout, prior_high=prior_high)
        state, hit = advance(state, bar, P)
        if hit:
            out.append((hit[0], hit[6]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_set_form_equals_steps(spark, seed):
    rng = random.Random(seed)
    rows = []
    for symbol in "ABC":
        for i in range(1, 160):
            low = rng.uniform(95, 101)
            high = low + rng.uniform(0.5, 4)
            close = high - rng.uniform(0, 0.4) if rng.random() < 0.5 else rng.uniform(low, high)
            rows.append((symbol, i * 3600, i, low, high, low, close, rng.choice([1.0, 2.0]), rng.random() < 0.93, rng.uniform(98, 101), 1.0, 4.0, rng.uniform(54, 76)))
    found = sorted((r.symbol, r.signal_ts, r.execution_price) for r in S.signals(frame(spark, rows), P).collect())
    assert found == sorted((s, *hit) for s in "ABC" for hit in detect([r for r in rows if r[0] == s]))


def bar(i, o, h, low, c, v, bullish=True, prior=110.0):
    return ("BTC-USD", i * 3600, i, float(o), float(h), float(low), float(c), float(v), bullish, prior, 50.0, 100.0, 65.0)


BREAKOUT, RETEST, NEXT = bar(1, 100, 150, 90, 140, 500), bar(2, 140, 140, 80, 125, 50), bar(3, 115, 160, 115, 150, 50)


def test_lifecycle(spark):
    [signal] = S.signals(frame(spark, [BREAKOUT, RETEST, NEXT, bar(4, 150, 155, 140, 145, 50, prior=200.0)]), P).collect()
    assert (signal.breakout_level, signal.retest_level, signal.execution_price, signal.status) == (110.0, 80.0, 150.0, "NEW")
    assert signal.regime_snapshot == "ATR:100.0_LEVEL:110.0"


def outcome(spark, rows):
    return S.outcomes(frame(spark, rows), P).where("idx = 1").first()


def test_outcomes(spark):
    calm = lambda i: bar(i, 200, 210, 200, 201, 50, prior=500.0)
    assert outcome(spark, [BREAKOUT, RETEST]).outcome == "waiting"
    assert outcome(spark, [BREAKOUT, bar(2, 140, 140, 80, 125, 50, bullish=False)]).outcome == "bearish"
    late = [BREAKOUT, *[calm(i) for i in range(2, 6)], bar(6, 140, 140, 80, 125, 50)]
    assert outcome(spark, late).retest.idx == 6
    missed = [BREAKOUT, *[calm(i) for i in range(2, 7)], bar(7, 140, 140, 80, 125, 50)]
    assert (outcome(spark, missed).outcome, outcome(spark, missed).release) == ("expired", 8)
    chased = outcome(spark, [BREAKOUT, RETEST, bar(3, 115, 260, 115, 250, 50, prior=500.0)])
    assert (chased.outcome, chased.release) == ("chased", 4)


def test_no_breakout_without_a_range(spark):
    assert S.outcomes(frame(spark, [bar(1, 140, 140, 140, 140, 500)]), P).count() == 0


def test_greedy_chain(spark):
    rows = spark.createDataFrame([("A", 1, 5), ("A", 2, 3), ("A", 5, None), ("A", 9, 10), ("B", 4, 4), ("B", 4, 4)], "k string, at bigint, release bigint")
    assert sorted((r.k, r.at) for r in S.greedy_chain(rows, "k", "at", "release").distinct().collect()) == [("A", 1), ("A", 5), ("B", 4)]
