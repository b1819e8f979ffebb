"""What a tick reads and writes: rows of the keys that it asks for, and rejected orders apart from those that may change."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.operators.merge import Policy
from tidemark.sources.changelog import Changelog
from tidemark.streaming.ticks import MESSAGE, Book

POLICY = Policy(("k", "j"), ("a",), ("b",), ("c",))


def test_keys_that_are_not_asked_for_are_not_merged(spark, tmp_path):
    log = Changelog(spark, f"file://{tmp_path}/log", POLICY, buckets=2)
    rows = spark.range(40).select((F.col("id") % 10).cast("string").alias("k"), (F.col("id") % 2).alias("j"), F.col("id").alias("seq"), F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").alias("c"))
    assert log.keys() is log.matching(rows.select("k")) is log.fitting(F.col("b") > 1) is None
    for n in range(2):
        log.append(rows.where(f"seq < {40 - 5 * n}").withColumn("seq", F.col("seq") + 100 * n), "w", n)
    view = lambda frame: sorted(tuple(r) for r in frame.collect())
    whole = log.latest()
    assert view(log.keys().distinct()) == view(whole.select("k", "j"))
    assert view(log.matching(spark.createDataFrame([("3",), ("3",), ("7",), ("none",)], "k string"))) == view(whole.where("k IN ('3', '7')"))
    assert view(log.matching(spark.createDataFrame([("3", 1), ("4", 1)], "k string, j long"), only=["b"]).select("k", "j", "b")) == view(whole.where("k = '3'").select("k", "j", "b"))
    for at in (0, 31, 34, 36, 99):  # 35 to 39 were the last of their keys in the first run alone
        assert view(log.fitting(F.col("b") > at)) == view(whole.where(F.col("b") > at))


def test_a_task_writes_few_buckets(spark, tmp_path):
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        log = Changelog(spark, f"file://{tmp_path}/log", Policy(("k",), ("a",)), buckets=8)
        log.append(spark.range(2000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("seq"), F.col("id").alias("a")))
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert log.latest().count() == 2000
    assert len([*tmp_path.glob("log/runs/*/*/*.parquet")]) <= 32 < 8 * 16


def test_rejected_orders_are_kept_apart(spark, tmp_path):
    told = {"symbol": "A", "breakout_level": 51.0, "retest_level": 50.0, "atr": 2.0, "rsi": 60.0, "execution_price": 54.0}
    say = lambda seq: ("signal", 1000, seq, json.dumps(told | {"signal_id": f"s{seq}", "signal_ts": seq}))
    book = Book(spark, f"file://{tmp_path}/book", buckets=2)
    book.take(spark.createDataFrame([say(1), say(2)], MESSAGE), 0)
    assert {(r.order_id, r.status) for r in book.table("orders").collect()} == {("ord_s1", "PENDING"), ("ord_s2_rej", "REJECTED_POSITION_OPEN")}
    assert [r.order_id for r in book.logs["orders"].latest().collect()] == ["ord_s1"]
