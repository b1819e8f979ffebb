"""One reconcile tick over pending orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as R
from tidemark.operators import fills as X

FAILED = ("CANCELLED", "FAILED", "EXPIRED")


def timeouts(orders: DataFrame, now: Column, limit: int = 60) -> DataFrame:
    """Pending orders that are ``limit`` seconds old or more."""
    return orders.where((F.col("status") == "PENDING") & (now - F.col("created_at") >= limit)).withColumn("age", R.age(now, F.col("created_at")))


def tick(orders: DataFrame, signals: DataFrame | None, now: Column, fills: DataFrame | None = None, remote: DataFrame | None = None, submit: bool = True, limit: int = 60) -> DataFrame:
    """Orders after a tick, with signal_status (null: unchanged) and ledger of fills.

    Only PENDING orders change. With ``submit`` an order without exchange id gets one and rests until the next tick.
    Then fills are applied (only where the signal is known; ``signals`` None: all are), and if the order is still PENDING its remote status may
    fail it, and else its age may expire it. ``fills``: exchange_order_id, seq, execution_id, price (null: the order's),
    size, fee, ts. ``remote``: exchange_order_id, remote_status. Without ``submit``, fills and remote statuses only
    the age counts. Fills are gathered by exchange id, where orders and remote statuses meet them, so each table is
    shuffled by that id once.
    """
    pending = orders.where(F.col("status") == "PENDING")
    rest = orders.where(F.col("status") != "PENDING")
    none = "exchange_order_id string, seq bigint, execution_id string, price double, size double, fee double, ts bigint"
    feed = X.fed(orders.sparkSession.createDataFrame([], none) if fills is None else fills, "exchange_order_id")
    if signals is None:
        rows = pending.withColumn("__known", F.col("signal_id").isNotNull())
    else:
        rows = pending.join(signals.select("signal_id").distinct().withColumn("__known", F.lit(True)), "signal_id", "left")
    rows = rows.join(feed, "exchange_order_id", "left")
    priced = F.transform("feed", lambda x: x.withField("price", F.coalesce(x["price"], F.col("price"))))
    rows = rows.withColumn("feed", F.when(F.col("__known"), F.array_sort(priced))).drop("__known")
    if remote is not None:
        rows = rows.join(remote.select("exchange_order_id", "remote_status"), "exchange_order_id", "left")
    else:
        rows = rows.withColumn("remote_status", F.lit(None).cast("string"))
    rows = X.folded(rows)
    fresh = F.lit(submit) & F.col("exchange_order_id").isNull()
    moved = F.col("new_status") != "PENDING"
    failed = F.coalesce(F.col("remote_status").isin(*FAILED), F.lit(False))
    late = now - F.col("created_at") >= limit
    case = F.when(fresh, "submitted").when(moved, "filled").when(failed, "failed").when(late, "expired").otherwise("waiting")
    rows = rows.withColumn("case", case)
    is_ = lambda name: F.col("case") == name
    new = rows.withColumns(
        {
            "status": F.when(is_("filled"), F.col("new_status")).when(is_("failed"), "FAILED").when(is_("expired"), "EXPIRED").otherwise(F.col("status")),
            "executed_size": F.when(is_("filled"), F.col("executed")).otherwise(F.col("executed_size")),
            "exchange_order_id": F.when(is_("submitted"), R.exchange_id(F.col("order_id"))).otherwise(F.col("exchange_order_id")),
            "submitted_at": F.when(is_("submitted"), now.cast("long")).otherwise(F.col("submitted_at")),
            "updated_at": F.when(is_("submitted") | is_("expired"), now.cast("long")).otherwise(F.col("updated_at")),
            "fail_reason": F.when(is_("expired"), "TIMEOUT").otherwise(F.col("fail_reason")),
            "signal_status": F.when(is_("filled") & (F.col("new_status") == "FILLED"), "ORDER_FILLED").when(is_("failed"), "FAILED_EXCHANGE").when(is_("expired"), "FAILED_TIMEOUT"),
        }
    ).select(*orders.columns, "signal_status", "ledger")
    return new.unionByName(rest.withColumn("signal_status", F.lit(None).cast("string")).withColumn("ledger", F.array().cast(X.VERDICTS)))
