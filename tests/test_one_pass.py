"""How often tapes are ordered and runs of changelogs shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import bars as B
from tidemark.operators import setups as S
from tidemark.operators.merge import Policy
from tidemark.plans import setups
from tidemark.sources import tapes as T
from tidemark.sources.changelog import Changelog, Run, stated

POLICY = Policy(("k",), ("id",), ("b",))


def test_trades_are_ordered_once_for_all_timeframes(spark):
    plan = B.placed(T.tape_line(spark, SF), {"1d": 86400, "12d": 1036800})._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan.split("Generate")[-1] and "Window" not in plan.split("Generate")[0]


def test_setups_look_at_written_bars(spark, monkeypatch):
    seen, make = [], S.setup_bars

    def noted(made, p):
        seen.append(made._jdf.queryExecution().optimizedPlan().toString())
        return make(made, p)

    monkeypatch.setattr(S, "setup_bars", noted)
    setups.bars(spark, SF)
    assert len(seen) == 1 and "l_shipdate" not in seen[0]


def test_a_run_is_shuffled_once_and_has_one_row_a_key(spark, tmp_path, monkeypatch):
    frame = type(spark.range(1))
    plans, sorted_by = [], frame.sortWithinPartitions

    def noted(self, *by):
        made = sorted_by(self, *by)
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        return made

    monkeypatch.setattr(frame, "sortWithinPartitions", noted)
    log = Changelog(spark, f"file://{tmp_path}/log", POLICY, buckets=2)
    rows = spark.range(60).select((F.col("id") % 20).cast("string").alias("k"), F.col("id").alias("seq"), "id", F.col("id").alias("b"))
    for k in range(2):
        log.append(rows.withColumn("seq", F.col("seq") + 100 * k), "w", k)
    log.compact(2)
    assert len(plans) == 3 and all(p.count("Exchange hashpartitioning(") == 1 for p in plans)
    assert [r.rows for r in log.version(1).runs] == [20] and [r.rows for r in log.version().runs] == [20]
    for number, last in ((1, 40), (None, 40)):
        assert sorted(log.latest(number).collect(), key=lambda r: int(r.k)) == [(str(k), k, k + last) for k in range(20)]
        assert sorted(log.latest(number, ["b"]).collect(), key=lambda r: int(r.k)) == [(str(k), k + last) for k in range(20)]
    assert "Exchange" not in log.latest()._jdf.queryExecution().executedPlan().toString()


def test_runs_of_an_earlier_form_are_merged_when_read(spark, tmp_path):
    log = Changelog(spark, f"file://{tmp_path}/log", POLICY, buckets=2)
    log.append(spark.createDataFrame([("x", 1, 1, 1)], "k string, seq long, id long, b long"))
    now = log.version()
    path = f"file://{tmp_path}/old"
    both = stated(spark.createDataFrame([("x", 1, 1, 1), ("x", 2, 2, 2)], "k string, seq long, id long, b long"), POLICY)
    both.withColumn("__bucket", F.lit(0)).write.partitionBy("__bucket").parquet(path)
    log._publish([Run(path, 0, 2)], {}, now.schema, now.number)
    assert [tuple(r) for r in log.latest().collect()] == [("x", 1, 2)]
