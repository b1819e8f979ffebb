"""Orders, fills, reconcile ticks, merges, events and guards on small cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalar as R
from tidemark.operators import events as E
from tidemark.operators import fills as X
from tidemark.operators import guards as G
from tidemark.operators import merge as M
from tidemark.operators import orders as O
from tidemark.operators import reconcile as C
from tidemark.sources import messages, store

SIGNAL = "signal_id string, symbol string, status string, retest_level double, atr double, execution_price double, signal_ts bigint"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def table(spark, name, rows=()):
    return spark.createDataFrame([tuple(r) for r in rows], schemas.SCHEMAS[name])


def order(i, status="PENDING", size=1.0, exchange=None, created=1000, done=0.0):
    return (f"o{i}", f"s{i}", f"C{i}", "BUY", 100.0, size, done, status, created, exchange, None, None, None)


@pytest.mark.parametrize(("entry", "retest", "atr", "stop", "size", "limit"), [(50200.0, 49000.0, 500.0, 48500.0, 0.01176, 50451.0), (49500.0, 49000.0, 1000.0, 48000.0, 0.01333, 49747.5)])
def test_sizing(spark, entry, retest, atr, stop, size, limit):
    level = R.stop_level(F.lit(retest), F.lit(atr))
    assert value(spark, level) == stop
    assert value(spark, R.position_size(F.lit(10_000.0), F.lit(entry), level)) == size
    assert value(spark, R.ioc_limit(F.lit(entry))) == limit


@pytest.mark.parametrize(("portfolio", "entry", "stop"), [(0.0, 10.0, 5.0), (1.0, 0.0, 5.0), (1.0, 10.0, 0.0), (1.0, 5.0, 5.0), (1.0, 5.0, 6.0)])
def test_size_zero(spark, portfolio, entry, stop):
    assert value(spark, R.position_size(F.lit(portfolio), F.lit(entry), F.lit(stop))) == 0.0


def test_admission(spark):
    good = lambda i, sym, ts=1: (f"s{i}", sym, "NEW", 49000.0, 500.0, 50200.0, ts)
    signals = [good(1, "A"), good(1, "A"), good(2, "A", 2), ("s3", "B", "NEW", 49000.0, 0.0, 50200.0, 1), ("s4", "C", "NEW", 49000.0, 0.0, 50200.0, 1), good(5, "D"), good(6, "E"), ("s7", "F", "DONE", 1.0, 1.0, 1.0, 1), ("s8", "B", "NEW", 80.0, 100.0, 150.0, 2)]
    orders = spark.createDataFrame([("s5", "D", "FILLED"), ("x", "E", "PARTIAL")], "signal_id string, symbol string, status string")
    positions = spark.createDataFrame([("C", "OPEN")], "symbol string, state string")
    rows = {r.signal_id: r for r in O.admit(spark.createDataFrame(signals, SIGNAL).distinct(), orders, positions, F.lit(77)).collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "s1": "PENDING", "s2": "REJECTED_POSITION_OPEN", "s3": "REJECTED_INVALID_DATA", "s4": "REJECTED_POSITION_OPEN", "s6": "REJECTED_POSITION_OPEN", "s8": "REJECTED_INVALID_DATA",
    }
    assert (rows["s1"].order_id, rows["s1"].price, rows["s1"].size, rows["s1"].signal_status, rows["s1"].created_at) == ("ord_s1", 50451.0, 0.01176, "ORDER_PENDING", 77)
    assert (rows["s3"].order_id, rows["s3"].size) == ("ord_s3_rej", 0.0)


def test_exposure_ends_with_its_order(spark):
    intents = spark.createDataFrame([("A", 1, 4), ("A", 2, 9), ("A", 4, None), ("A", 50, 51)], "symbol string, at bigint, release bigint")
    assert sorted(r.at for r in O.admit_over_time(intents).collect()) == [1, 4]


FEED = "order_id string, seq bigint, execution_id string, price double, size double, fee double, ts bigint"


def fold(spark, fills, size=1.0, status="PENDING"):
    rows = [("o1", i, e, 100.0, z, 0.0, i) for i, (e, z) in enumerate(fills)]
    r = X.judged(table(spark, "orders", [order(1, status, size)]), spark.createDataFrame(rows, FEED)).first()
    return r.new_status, r.executed, [x.verdict for x in r.ledger]


def test_fills(spark):
    assert fold(spark, [("a", 0.5)]) == ("PARTIAL", 0.5, ["accepted"])
    assert fold(spark, [("a", 0.5), ("b", 0.5)]) == ("FILLED", 1.0, ["accepted", "accepted"])
    assert fold(spark, [("a", 0.5), ("a", 0.5)]) == ("PARTIAL", 0.5, ["accepted", "duplicate"])
    assert fold(spark, [("a", 1.5)]) == ("PENDING", 0.0, ["overfill"])
    assert fold(spark, [("a", 1.5), ("a", 1.0)]) == ("FILLED", 1.0, ["overfill", "accepted"])
    assert fold(spark, [("a", 1.0), ("b", 0.1)]) == ("FILLED", 1.0, ["accepted", "closed"])
    assert fold(spark, [("a", 0.99995)]) == ("FILLED", 0.99995, ["accepted"])
    assert fold(spark, [("a", 0.0)]) == ("PENDING", 0.0, [])
    assert fold(spark, [("a", 0.5)], status="FILLED")[2] == ["closed"]


def test_positions(spark):
    accepted = spark.createDataFrame([("A", "o1", 1, 100.0, 1.0, 5), ("A", "o1", 2, 200.0, 3.0, 9)], "symbol string, order_id string, place int, price double, size double, ts bigint")
    r = X.positions(accepted, spark.createDataFrame([("o1", 48.0)], "order_id string, stop_price double")).first()
    assert (r.entry_ts, r.avg_entry, r.current_size, r.stop_price, r.state, r.stop_active) == (5, 175.0, 4.0, 48.0, "OPEN", True)


def tick(spark, orders, fills=(), remote=(), signals=("s1",), now=1010, limit=60, **kw):
    feed = spark.createDataFrame([("cb_o1", i, e, p, z, 0.0, 5) for i, (e, p, z) in enumerate(fills)], "exchange_order_id string, seq bigint, execution_id string, price double, size double, fee double, ts bigint")
    known = spark.createDataFrame([(s,) for s in signals], "signal_id string")
    states = spark.createDataFrame(list(remote), "exchange_order_id string, remote_status string")
    return C.tick(table(spark, "orders", orders), known, F.lit(now), feed, states, limit=limit, **kw)


def test_reconcile_rules(spark):
    r = tick(spark, [order(1)], [("e", 49500.0, 1.0)], now=1000).first()
    assert (r.status, r.exchange_order_id, r.submitted_at, r.signal_status) == ("PENDING", "cb_o1", 1000, None)
    r = tick(spark, [order(1, exchange="cb_o1")], [("e", None, 1.0)], [("cb_o1", "CANCELLED")]).first()
    assert (r.status, r.executed_size, r.signal_status, r.ledger[0].price) == ("FILLED", 1.0, "ORDER_FILLED", 100.0)
    r = tick(spark, [order(1, exchange="cb_o1")], remote=[("cb_o1", "CANCELLED")], now=9999).first()
    assert (r.status, r.signal_status, r.fail_reason) == ("FAILED", "FAILED_EXCHANGE", None)
    r = tick(spark, [order(1, exchange="cb_o1")], remote=[("cb_o1", "OPEN")], now=1060).first()
    assert (r.status, r.fail_reason, r.updated_at, r.signal_status) == ("EXPIRED", "TIMEOUT", 1060, "FAILED_TIMEOUT")
    assert tick(spark, [order(1, exchange="cb_o1")], [("e", 1.0, 1.0)], signals=["zz"]).first().status == "PENDING"
    assert tick(spark, [order(1, "PARTIAL", exchange="cb_o1")], [("e", 1.0, 1.0)], now=9999).first().status == "PARTIAL"
    assert C.tick(table(spark, "orders", [order(1)]), spark.createDataFrame([("s1",)], "signal_id string"), F.lit(9999), submit=False).first().status == "EXPIRED"


def test_two_ticks_submit_then_fill(spark):
    first = tick(spark, [order(1)], now=1000).drop("signal_status", "ledger").collect()
    second = tick(spark, first, [("e", 50.0, 1.0)], now=1005).drop("signal_status", "ledger").collect()
    third = tick(spark, second, [("e", 50.0, 1.0)], now=1010).drop("signal_status", "ledger").collect()
    assert (first[0].exchange_order_id, second[0].status, third[0].status) == ("cb_o1", "FILLED", "FILLED")
    none = table(spark, "positions")
    kinds = [[r.event_type for r in E.order_events(table(spark, "orders", a), table(spark, "orders", b), none, F.lit(1)).collect()] for a, b in [([order(1)], first), (first, second), (second, third)]]
    assert kinds == [["ORDER_SUBMITTED"], ["ORDER_FILLED"], []]


def test_merges(spark):
    bars = spark.createDataFrame([("A", "1h", 1, 100.0, 105.0, 95.0, 102.0, 10.0, 1), ("A", "1h", 1, 102.0, 110.0, 90.0, 108.0, 5.0, 2)], "symbol string, timeframe string, ts_open bigint, open double, high double, low double, close double, volume double, seq bigint")
    assert tuple(M.merged(bars, "bars").first())[3:] == (100.0, 110.0, 90.0, 108.0, 5.0)
    rows = spark.createDataFrame([("k", "NEW", None, 1), ("k", None, 2.0, 2), ("k", "OLD", None, 3)], "key string, status string, size double, seq bigint")
    assert tuple(M.merge_latest(rows, ["key"], patch=["status", "size"]).first()) == ("k", "OLD", 2.0)
    assert tuple(M.merge_latest(rows, ["key"], last=["size"]).first()) == ("k", None)
    assert tuple(M.first_rows(rows, ["key"]).first()) == ("k", "NEW", None, 1)
    assert M.merged(rows.limit(0).withColumn("value", F.lit("x")), "runtime_state").count() == 0


def test_schema_alignment_is_idempotent(spark):
    old = spark.createDataFrame([("s1", "A", "7")], "signal_id string, symbol string, extra string")
    once = schemas.align_schema(old, schemas.SCHEMAS["signals"])
    assert once.columns == [*schemas.SCHEMAS["signals"].names, "extra"] and schemas.missing_columns(old, schemas.SCHEMAS["signals"])[:1] == ["signal_type"]
    assert schemas.align_schema(once, schemas.SCHEMAS["signals"]).schema == once.schema


def test_stop_check(spark):
    rows = [("A", 1, 1.0, 1.0, 0.0, 0.0, 0.0, "OPEN", False), ("B", 1, 1.0, 1.0, 0.0, 0.0, 5.0, "OPEN", True), ("C", 1, 1.0, 1.0, 0.0, 0.0, 0.0, "CLOSED", False), ("D", 1, 1.0, 1.0, 0.0, 0.0, None, "OPEN", True)]
    assert sorted(r.symbol for r in E.stop_violations(table(spark, "positions", rows)).collect()) == ["A", "D"]


def guard_fold(enabled, ticks):
    """Guard state stepped through: allowed at each tick."""
    on, tripped, out = enabled, set(), []
    for stale, violated in ticks:
        if violated:
            tripped.add("stop_required")
            on = False
        if stale:
            tripped.add("stale_stream")
            on = False
        elif tripped == {"stale_stream"} and not on:
            on, tripped = True, set()
        out.append(on and not stale)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_latch_equals_steps(spark, seed):
    rng = random.Random(seed)
    feeds = {k: [(rng.random() < 0.3, rng.random() < 0.05) for _ in range(30)] for k in range(6)}
    rows = spark.createDataFrame([(k, i, s, v) for k, f in feeds.items() for i, (s, v) in enumerate(f)], "k int, i int, stale boolean, violated boolean")
    got = G.latch(rows, ["k"], "i", F.col("k") % 2 == 0).orderBy("k", "i").collect()
    for k, f in feeds.items():
        assert [r.can_trade for r in got if r.k == k] == guard_fold(k % 2 == 0, f)


def test_messages(spark):
    trade = lambda p, t="2024-01-01T00:00:00.5Z": {"product_id": "A", "price": p, "size": "2", "time": t}
    rows = [
        json.dumps({"channel": "market_trades", "events": [{"trades": [trade("1"), trade("x")]}, {"trades": [trade("3")]}]}),
        json.dumps({"channel": "market_trades", "events": [{"trades": [trade("4")]}, {}]}),
        json.dumps({"channel": "user", "events": []}), "no json", None,
        json.dumps({"channel": "heartbeats", "events": [{"heartbeats": [{"product_id": "A", "time": "2024-01-01T00:00:09Z"}]}]}),
    ]
    feed = spark.createDataFrame([(v, i) for i, v in enumerate(rows)], "value string, seq bigint")
    got = messages.trades(feed).orderBy("seq").collect()
    assert [(r.price, r.size, r.ts.microsecond) for r in got] == [(1.0, 2.0, 500000), (4.0, 2.0, 500000)]
    assert sorted((r.seq, r.bad) for r in messages.quarantined(feed).collect() if r.bad is not None) == [(0, 1)]
    assert [r.product for r in messages.last_heartbeats(feed).collect()] == ["A"]
    fills = spark.createDataFrame([("x", '{"fills":[{"trade_id":"","size":"1"},{"trade_id":"","size":"1"}]}', 1), ("y", '[{"trade_id":"t","price":"5"}]', 2), ("z", "oops", 3)], "exchange_order_id string, value string, seq bigint")
    out = messages.fills(fills).collect()
    assert len({r.execution_id for r in out}) == 3 and [(r.price, r.size) for r in out if r.exchange_order_id == "y"] == [(5.0, 0.0)]
    status = spark.createDataFrame([("a", '{"order":{"status":"X"}}'), ("b", '{"status":"Y"}'), ("c", "{}")], "exchange_order_id string, value string")
    assert sorted(r.remote_status for r in messages.remote_status(status).collect()) == ["", "X", "Y"]


def test_bar_store(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    row = lambda t, seq, close: ("A", "1h", t, 1.0, 2.0, 0.5, close, 1.0, seq)
    schema = "symbol string, timeframe string, ts_open bigint, open double, high double, low double, close double, volume double, seq bigint"
    store.append_bars(spark.createDataFrame([row(t, t, float(t)) for t in range(5)], schema), path)
    store.append_bars(spark.createDataFrame([row(4, 9, 40.0)], schema), path)
    assert [(r.ts_open, r.close) for r in store.history(spark, path, "A", "1h", 2).orderBy("ts_open").collect()] == [(3, 3.0), (4, 40.0)]
    plan = store.history(spark, path, "A", "1h", 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(timeframe" in plan and "EqualTo(symbol,A)" in plan
    log = f"file://{tmp_path}/log"
    E.append_log(spark.createDataFrame([(5, "X", "{}")], schemas.SCHEMAS["event_log"]), log)
    assert spark.read.parquet(log).first().event_type == "X"
