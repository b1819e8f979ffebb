"""The versioned changelog against a plain merge, over retries, conflicts and merges of runs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.merge import Policy, merge_latest
from tidemark.sources.changelog import Changelog, Conflict, sink

SCHEMA = "k string, seq long, a int, b string, c double"
POLICY = Policy(("k",), ("a",), ("b",), ("c",))


def changes(rng, start, n):
    return [(f"k{rng.randrange(12)}", start + i, rng.choice([None, rng.randrange(9)]), rng.choice([None, "x", "y"]), rng.choice([None, rng.random()])) for i in range(n)]


def view(frame):
    return sorted(tuple(r) for r in frame.select("k", "a", "b", "c").collect())


def plain(spark, rows):
    return view(merge_latest(spark.createDataFrame(rows, SCHEMA), ["k"], "seq", ["a"], ["b"], ["c"]))


def test_versions_merges_and_retries(spark, tmp_path):
    rng = random.Random(1)
    log = Changelog(spark, f"file://{tmp_path}/log", POLICY, buckets=4)
    assert log.latest() is None and log.version().number == 0
    told, states = [], {}
    for k in range(5):
        part = changes(rng, 100 * k, 30)
        told += part
        frame = spark.createDataFrame(part, SCHEMA)
        now = log.append(frame, "feed", k)
        assert log.append(frame, "feed", k) == now  # the same batch again
        states[now.number] = list(told)
        if k in (1, 3):
            states[log.compact(2).number] = list(told)
    last = log.compact(2)
    assert log.compact(9) == last
    assert {r.tier for r in last.runs} >= {2}
    states[last.number] = list(told)
    for number, rows in states.items():
        assert view(log.latest(number)) == plain(spark, rows)
    gone = log.unused(1)
    assert gone and not set(gone) & {r.path for r in last.runs}
    wanted = spark.createDataFrame([("k3",), ("none",)], "k string")
    assert view(log.lookup(wanted)) == [r for r in plain(spark, told) if r[0] == "k3"]


def test_lookup_reads_its_buckets_alone(spark, tmp_path):
    log = Changelog(spark, f"file://{tmp_path}/log", POLICY, buckets=16)
    log.append(spark.range(2000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("seq"), F.lit(1).alias("a"), F.lit("x").alias("b"), F.lit(1.0).alias("c")))
    assert log.lookup(spark.createDataFrame([("7",)], "k string")).count() == 1
    now = log.version()
    part = log._states(now.runs, now.schema, [5])
    assert 0 < part.count() < 400 and "__bucket" in part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert {f.split("__bucket=")[1].split("/")[0] for (f,) in part.select(F.input_file_name()).distinct().collect()} == {"5"}


def test_a_writer_that_comes_second_goes_on_top(spark, tmp_path, monkeypatch):
    log = Changelog(spark, f"file://{tmp_path}/log", POLICY, buckets=2)
    other = Changelog(spark, f"file://{tmp_path}/log", POLICY, buckets=2)
    row = lambda k, seq: spark.createDataFrame([(k, seq, 1, "x", None)], SCHEMA)
    log.append(row("a", 1))
    publish, once = Changelog._publish, []

    def late(self, *args):
        if self is log and not once:
            once.append(other.append(row("b", 2)))
        return publish(self, *args)

    monkeypatch.setattr(Changelog, "_publish", late)
    assert log.append(row("c", 3)).number == once[0].number + 1
    assert [r[0] for r in view(log.latest())] == ["a", "b", "c"]
    with pytest.raises(Conflict):
        publish(log, [], {}, "", 0)


def test_a_manifest_that_was_cut_off_is_passed_over(spark, tmp_path):
    log = Changelog(spark, f"file://{tmp_path}/log", POLICY, buckets=2)
    log.append(spark.createDataFrame([("a", 1, 1, "x", None)], SCHEMA))
    (tmp_path / "log/manifest/000000000002.json").write_text('{"runs": [')
    assert log.version().number == 1
    assert log.append(spark.createDataFrame([("b", 2, 1, "x", None)], SCHEMA)).number == 3
    assert len(view(log.latest())) == 2


def test_stream_into_a_changelog(spark, tmp_path):
    rng = random.Random(2)
    path, told = f"file://{tmp_path}/in", []
    for k in range(4):
        part = changes(rng, 100 * k, 20)
        told += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    log = Changelog(spark, f"file://{tmp_path}/log", POLICY, buckets=2)
    take = sink(log, "feed", 2)

    def twice(batch, number):  # as after a failure between the append and the checkpoint
        take(batch, number)
        take(batch, number)

    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    rows.writeStream.foreachBatch(twice).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert view(log.latest()) == plain(spark, told)
    assert sum(r.rows for r in log.version().runs) <= len(told)
