"""From signals to order intents, under exposure rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as R

LIVE = ("PENDING", "PARTIAL")


def exposed_symbols(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """Symbols with an open position or a live order."""
    held = positions.where(F.col("state").isin("OPEN", "PENDING")).select("symbol")
    return held.union(orders.where(F.col("status").isin(*LIVE)).select("symbol")).distinct()


def exposure(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """Open positions and live orders of each exposed symbol."""
    held = positions.where(F.col("state").isin("OPEN", "PENDING")).select("symbol", F.lit(1).alias("p"), F.lit(0).alias("o"))
    live = orders.where(F.col("status").isin(*LIVE)).select("symbol", F.lit(0).alias("p"), F.lit(1).alias("o"))
    return held.union(live).groupBy("symbol").agg(F.sum("p").alias("n_positions"), F.sum("o").alias("n_orders"))


def admit(signals: DataFrame, orders: DataFrame, positions: DataFrame, now: Column, portfolio: float = 10_000.0) -> DataFrame:
    """Order intents of NEW signals, in order of signal time, then id.

    Signals that have an order are passed over. Then, in this order: exposure of the symbol (stored, or by an earlier
    intent of this batch) gives REJECTED_POSITION_OPEN, a price, stop or range not above 0 REJECTED_INVALID_DATA, a
    size of 0 REJECTED_INVALID_SIZE; else the intent is PENDING with its limit price. Returns the columns of orders
    with signal_status.
    """
    fresh = signals.where(F.col("status") == "NEW").join(orders.select("signal_id").distinct(), "signal_id", "left_anti")
    held = exposed_symbols(positions, orders).withColumn("held", F.lit(True))
    stop = R.stop_level(F.col("retest_level"), F.col("atr"))
    size = R.position_size(F.lit(portfolio), F.col("execution_price"), stop)
    rows = fresh.join(held, "symbol", "left").withColumns({"invalid": R.is_invalid(F.col("execution_price"), stop, F.col("atr")), "sized": size})
    earlier = Window.partitionBy("symbol").orderBy("signal_ts", "signal_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.max(~F.col("invalid") & (F.col("sized") > 0)).over(earlier), F.lit(False))
    rows = rows.withColumn("occupied", F.coalesce("held", F.lit(False)) | taken)
    status = (
        F.when(F.col("occupied"), "REJECTED_POSITION_OPEN").when(F.col("invalid"), "REJECTED_INVALID_DATA").when(F.col("sized") <= 0, "REJECTED_INVALID_SIZE").otherwise("PENDING")
    )
    rows = rows.withColumn("order_status", status)
    pending = F.col("order_status") == "PENDING"
    return rows.select(
        R.order_id(F.col("signal_id"), ~pending).alias("order_id"),
        "signal_id",
        "symbol",
        F.lit("BUY").alias("side"),
        F.when(pending, R.ioc_limit(F.col("execution_price"))).otherwise(F.col("execution_price")).alias("price"),
        F.when(pending, F.col("sized")).otherwise(F.lit(0.0)).alias("size"),
        F.lit(0.0).alias("executed_size"),
        F.col("order_status").alias("status"),
        now.cast("long").alias("created_at"),
        F.lit(None).cast("string").alias("exchange_order_id"),
        F.lit(None).cast("long").alias("submitted_at"),
        F.lit(None).cast("long").alias("updated_at"),
        F.lit(None).cast("string").alias("fail_reason"),
        R.mapped(F.col("order_status"), R.SIGNAL_STATUS, "PROCESSED").alias("signal_status"),
    )


def admit_over_time(intents: DataFrame) -> DataFrame:
    """Intents (symbol, at, release) that find their symbol free when each admitted one frees it at ``release`` (null: never)."""
    from tidemark.operators.setups import greedy_chain

    return greedy_chain(intents, "symbol", "at", "release")
