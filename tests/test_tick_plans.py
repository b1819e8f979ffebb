"""How often a tick and its events shuffle and read their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import events as E
from tidemark.operators import reconcile as C
from tidemark.plans import ledger as L
from tidemark.schemas import SCHEMAS


def test_a_tick_shuffles_each_table_once_a_key(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        orders, signals, fills, remote = L.tick_inputs(spark, SF)
        after = C.tick(orders, signals, F.lit(L.NOW), fills, remote, limit=L.LIMIT)
        plan = after._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("hashpartitioning(") <= 5


def test_events_of_all_kinds_take_one_pass(spark):
    orders, signals, fills, remote = L.tick_inputs(spark, SF)
    after = C.tick(orders, signals, F.lit(L.NOW), fills, remote, limit=L.LIMIT).withColumn("symbol", F.col("order_id"))
    made = E.order_events(orders, after, spark.createDataFrame([], SCHEMAS["positions"]), F.lit(L.NOW))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation [l_orderkey") <= 1
