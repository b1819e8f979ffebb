"""Guards over random micro-batches, restarts and stored state against the batch form."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators import guards as G
from tidemark.streaming import sinks
from tidemark.streaming.guards import guard_stream

SCHEMA = "k string, at bigint, stale boolean, violated boolean, on boolean"


def test_random_batches_and_restarts_equal_the_latch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("ABC"), i, rng.random() < 0.3, rng.random() < 0.02, True) for i in range(300)]
    rows = [(k, i, s, v, k != "B") for k, i, s, v, _ in rows]
    src, out, check = (f"file://{tmp_path}/{n}" for n in ("src", "out", "check"))
    cuts = [0, *sorted(rng.sample(range(1, 300), 6)), 300]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        again = rows[max(0, a - 5) : a] if n % 2 else []  # ticks that are told again
        spark.createDataFrame(again + rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        if n % 3 != 1:  # some starts find two parts
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
            sinks.run_to_end(guard_stream(stream, "k", "at", F.col("on")), out, check)
    sinks.run_to_end(guard_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), "k", "at", F.col("on")), out, check)
    ticks = spark.createDataFrame(rows, SCHEMA)
    states = G.latch(ticks, ["k"], "at", F.col("on")).select("k", "at", "can_trade", F.array_join("tripped", ",").alias("tripped"))
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select("k", "seq", "can_trade", "tripped").collect())) == sorted(map(tuple, states.collect()))
    edges = [tuple(r) for r in G.disabled_edges(states, ["k"], "at").select("k", "at").collect()]
    assert len(edges) > 5 and sorted(tuple(r) for r in got.where("disabled").select("k", "seq").collect()) == sorted(edges)


def test_kept_trips_hold_after_a_new_start(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    spark.createDataFrame([("A", 11, False, False, True), ("B", 11, False, False, False), ("C", 9, True, True, True), ("C", 12, False, None, True)], SCHEMA).coalesce(1).write.parquet(src)
    stored = spark.createDataFrame([("A", 10, ["stop_required"], False, False), ("B", 10, ["stale_stream"], True, False), ("C", 10, [], False, True)], "k string, seq bigint, tripped array<string>, released boolean, can_trade boolean")
    sinks.run_to_end(guard_stream(spark.readStream.schema(SCHEMA).parquet(src), "k", "at", F.col("on"), stored), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    got = {r.k: (r.seq, r.can_trade, r.tripped) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {"A": (11, False, "stop_required"), "B": (11, True, ""), "C": (12, True, "")}
