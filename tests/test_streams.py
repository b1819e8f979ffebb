"""Streams split into micro-batches and restarted give what the batch form gives."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import setups as S
from tidemark.plans.live import LIVE
from tidemark.streaming import bars as SB
from tidemark.streaming import detector, monitors, sinks

SCHEMA = "symbol string, price double, size double, sec bigint, seq bigint"


def feed(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.timestamp_seconds("sec"))


def test_arrival_bars_over_batches_and_restart(spark, tmp_path):
    rows = [("A" if i % 3 else "B", float((i * 7) % 13), 1.0, i * 290 - (900 if i % 11 == 0 and i else 0), i) for i in range(120)]
    src, out, check = (f"file://{tmp_path}/{n}" for n in ("src", "out", "check"))
    for start in range(0, 120, 30):  # each run ends and the next goes on from the checkpoint
        feed(spark, src, rows[start : start + 30])
        sinks.run_to_end(SB.bars_of(stream(spark, src), "merge", {"x": 600, "y": 1800}), out, check)
    tape = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("sec")).withColumn("block", F.lit(0))
    wanted = sorted(map(tuple, B.bars(tape, {"x": 600, "y": 1800}).collect()))
    got = sorted(map(tuple, spark.read.parquet(out).select("symbol", "timeframe", "ts_open", "open", "high", "low", "close", "volume").collect()))
    assert got == wanted


def test_stale_and_timeout_timers(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    feed(spark, src, [("A", 1.0, 1.0, 10, 0)])
    seen = []
    q = sinks.on_batch(monitors.stale_feed(stream(spark, src), 1500), lambda df, _: seen.extend(df.collect()), f"file://{tmp_path}/c1", seconds=1)
    deadline = time.time() + 60
    while not seen and time.time() < deadline:
        time.sleep(0.5)
    q.stop()
    assert [(r.symbol, r.kind, r.outage_start) for r in seen][:1] == [("A", "stale", 10_000_000)]


def test_pending_orders_expire(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    spark.createDataFrame([("o1", "PENDING", 1), ("o2", "PENDING", 1), ("o2", "FILLED", 2)], "order_id string, status string, seq bigint").coalesce(1).write.parquet(src)
    seen = []
    orders = spark.readStream.schema("order_id string, status string, seq bigint").parquet(src)
    q = sinks.on_batch(monitors.pending_timeouts(orders, 1500), lambda df, _: seen.extend(df.collect()), f"file://{tmp_path}/c2", seconds=1)
    deadline = time.time() + 60
    while not seen and time.time() < deadline:
        time.sleep(0.5)
    q.stop()
    assert [tuple(r) for r in seen] == [("o1", "EXPIRED", "TIMEOUT")]


def test_orders_that_become_pending_later_expire_too(spark, tmp_path):
    src, schema = f"file://{tmp_path}/src", "order_id string, status string, seq bigint"
    feed_of = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    feed_of([("o1", "NEW", 1), ("o2", "FILLED", 2)])
    seen = []
    q = sinks.on_batch(monitors.pending_timeouts(spark.readStream.schema(schema).parquet(src), 1500), lambda df, _: seen.extend(df.collect()), f"file://{tmp_path}/c3", seconds=1)
    deadline = time.time() + 60
    while not any(p["numInputRows"] for p in q.recentProgress) and time.time() < deadline:
        time.sleep(0.2)
    feed_of([("o1", "PENDING", 2), ("o2", "PENDING", 1)])
    deadline = time.time() + 60
    while not seen and time.time() < deadline:
        time.sleep(0.5)
    q.stop()
    assert [tuple(r) for r in seen] == [("o1", "EXPIRED", "TIMEOUT")]


def test_detector_over_random_batches_and_restarts_equals_one_pass(spark, tmp_path):
    rng = random.Random(3)
    level, rows = 100.0, []
    for i in range(9000):
        level = max(20.0, level + rng.gauss(0.02, 0.6))
        rows.append((rng.choice("AB"), round(level, 3), float(rng.randrange(1, 5)), i * 200 - (rng.randrange(3000) if rng.random() < 0.05 else 0), i))
    tape = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("sec")).withColumn("block", F.lit(0))
    made = S.setup_bars(B.bars(tape, {"1h": 3600, "4h": 14400}, keep_later=True), LIVE)
    batch = S.signals(made, LIVE).select("symbol", "signal_ts", "breakout_level", "retest_level", "atr", "rsi", "execution_price").collect()
    src, out, check = (f"file://{tmp_path}/{n}" for n in ("src", "out", "check"))
    cuts = [0, *sorted(rng.sample(range(1, 9000), 5)), 9000]
    for a, b in zip(cuts, cuts[1:], strict=False):
        feed(spark, src, rows[a:b])
        sinks.run_to_end(detector.detect(stream(spark, src), LIVE), out, check)
    got = spark.read.parquet(out).select("symbol", "signal_ts", "breakout_level", "retest_level", "atr", "rsi", "execution_price").collect()
    key = lambda r: (r[0], r[1], *(round(x, 6) for x in r[2:]))
    assert len(batch) > 3 and sorted(map(key, got)) == sorted(map(key, batch))


def test_detector_starts_warm(spark, tmp_path):
    past = [("A", f, k * s, 10.0, 12.0 + k % 3, 9.0, 11.0 + k % 2, 5.0) for f, s in (("1h", 3600), ("4h", 14400)) for k in range(12)]
    stored = spark.createDataFrame(past, "symbol string, timeframe string, ts_open bigint, open double, high double, low double, close double, volume double")
    src = f"file://{tmp_path}/src"
    feed(spark, src, [("A", 10.0 + k, 1.0, 200_000 + k * 3600, k) for k in range(6)])
    sinks.run_to_end(detector.detect(stream(spark, src), LIVE, stored), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    assert spark.read.parquet(f"file://{tmp_path}/out").columns[0] == "symbol"


BAD = [(None, 1.0, 1.0, 400, 1000), ("A", None, 1.0, 400, 1001), ("A", 5.0, None, 400, 1002), ("A", 5.0, 1.0, None, 1003)]


def test_trades_that_lack_something_are_left_out_of_streams_as_of_batches(spark, tmp_path):
    rows = [("A" if i % 3 else "B", float(i % 7), 1.0, i * 200, i) for i in range(40)] + BAD
    tape = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("sec")).withColumn("block", F.lit(0))
    src = f"file://{tmp_path}/src"
    feed(spark, src, rows)
    read = lambda name: spark.read.parquet(f"file://{tmp_path}/{name}")
    run = lambda made, name: sinks.run_to_end(made, f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-check")
    columns = ["symbol", "timeframe", "ts_open", "open", "high", "low", "close", "volume"]
    run(SB.arrival_bars(stream(spark, src), {"x": 600}), "arrival")
    assert sorted(map(tuple, read("arrival").select(columns).collect())) == sorted(map(tuple, B.bars(tape, {"x": 600}).collect()))
    run(SB.windowed_bars(stream(spark, src), {"x": 600}, "1 second"), "windowed")
    whole = {tuple(r) for r in B.event_time_bars(tape, {"x": 600}).select(columns).collect()}
    got = {tuple(r) for r in read("windowed").select(columns).collect()}
    assert got and got <= whole and all(None not in r for r in whole) and len(whole) - len(got) <= 4
    run(monitors.stale_feed(stream(spark, src), 300_000, timers=False), "stale")
    assert {r.symbol for r in read("stale").collect()} <= {"A", "B"}


def test_blocked_bars_over_random_batches_and_repeats(spark, tmp_path):
    rng = random.Random(8)
    rows = [("A" if rng.random() < 0.8 else "B", round(rng.uniform(1, 9), 2), 1.0, i * 61 - (rng.randrange(2000) if rng.random() < 0.1 else 0), i) for i in range(600)] + BAD[1:]
    src, check = f"file://{tmp_path}/src", f"file://{tmp_path}/check"
    cuts = [0, *sorted(rng.sample(range(1, 600), 3)), len(rows)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        feed(spark, src, rows[a:b])
        made = SB.BlockedBars(spark, f"file://{tmp_path}/bars", {"x": 600, "y": 1800}, block_rows=50, buckets=2, fanout=2)

        def twice(batch, number, made=made):
            made.take(batch, number)
            made.take(batch, number)

        stream(spark, src).writeStream.foreachBatch(twice).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    tape = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("sec")).withColumn("block", F.lit(0))
    key = lambda r: (*r[:7], round(r[7], 6))
    got = made.closed.latest().select("symbol", "timeframe", "ts_open", "open", "high", "low", "close", "volume").collect()
    assert sorted(map(key, got)) == sorted(map(key, B.bars(tape, {"x": 600, "y": 1800}).collect()))


def test_silences_and_expiries_follow_from_the_data(spark, tmp_path):
    rng = random.Random(4)
    at, rows = 0, []
    for i in range(80):
        at += rng.choice([50, 100, 900])
        rows.append((rng.choice("AB"), 1.0, 1.0, at, i))
    src = f"file://{tmp_path}/src"
    cuts = [0, 20, 21, 60, 80]
    for a, b in zip(cuts, cuts[1:], strict=False):
        feed(spark, src, rows[a:b])
        sinks.run_to_end(monitors.silences(stream(spark, src), 500_000, "10 seconds"), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    wanted = set()
    for k in "AB":
        times = [r[3] for r in rows if r[0] == k]
        wanted |= {(k, kind, x * 10**6, y * 10**6 if kind == "recovered" else None) for x, y in zip(times, times[1:], strict=False) if y - x > 500 for kind in ("stale", "recovered")}
        wanted |= {(k, "stale", times[-1] * 10**6, None)} if times[-1] + 500 < at - 10 else set()
    got = [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").select("symbol", "kind", "outage_start", "outage_end").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted

    changes = [("o1", "PENDING", 0, 1), ("o2", "PENDING", 0, 1), ("o2", "FILLED", 59, 2), ("o3", "PENDING", 0, 1), ("o3", "FILLED", 60, 2), ("o4", "NEW", 0, 1), ("o4", "PENDING", 30, 2), ("o5", "PENDING", 500, 1), (None, "PENDING", 0, 1)]
    schema, path = "order_id string, status string, sec bigint, seq bigint", f"file://{tmp_path}/orders"
    for part in (changes[:4], changes[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        orders = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.timestamp_seconds(F.col("sec") + 1000))
        sinks.run_to_end(monitors.expiries(orders, 60_000, "100 seconds"), f"file://{tmp_path}/o-out", f"file://{tmp_path}/o-check")
    got = {r.order_id: r.expired_at for r in spark.read.parquet(f"file://{tmp_path}/o-out").collect()}
    assert got == {"o1": 1060 * 10**6, "o3": 1060 * 10**6, "o4": 1090 * 10**6}
