"""Scalar rules of trades, orders and guards, as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

RISK, SLIPPAGE = 0.002, 0.005
#: Order status to status of its signal; others are PROCESSED.
SIGNAL_STATUS = {
    "PENDING": "ORDER_PENDING",
    "REJECTED_POSITION_OPEN": "REJECTED_POSITION_OPEN",
    "REJECTED_INVALID_DATA": "REJECTED_INVALID_DATA",
    "REJECTED_INVALID_SIZE": "REJECTED_INVALID_SIZE",
}


def epoch_seconds(text: Column) -> Column:
    """Seconds, with fraction, of an ISO-8601 time; null if it is none."""
    return F.unix_micros(text.try_cast("timestamp")) / 1e6


def number(text: Column) -> Column:
    """A number in text; null if it is none."""
    return text.try_cast("double")


def stop_level(retest: Column, atr: Column) -> Column:
    return retest - atr


def position_size(value: Column, entry: Column, stop: Column) -> Column:
    """Size that loses ``RISK`` of the portfolio at the stop, to 5 places; 0 where an input isn't above 0 or the stop isn't below entry."""
    ok = (value > 0) & (entry > 0) & (stop > 0) & (stop < entry)
    return F.when(ok, F.round(value * RISK / (entry - stop), 5)).otherwise(F.lit(0.0))


def ioc_limit(price: Column) -> Column:
    return F.round(price * (1 + SLIPPAGE), 2)


def is_invalid(entry: Column, stop: Column, atr: Column) -> Column:
    return F.coalesce((entry <= 0) | (stop <= 0) | (atr <= 0), F.lit(True))


def order_id(signal_id: Column, rejected: Column) -> Column:
    return F.concat(F.lit("ord_"), signal_id, F.when(rejected, "_rej").otherwise(""))


def exchange_id(order: Column) -> Column:
    return F.concat(F.lit("cb_"), order)


def order_of_exchange_id(exchange: Column) -> Column:
    return F.regexp_replace(exchange, "^cb_", "")


def mapped(status: Column, names: Mapping[str, str], other: str) -> Column:
    """A status by name, or ``other``."""
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def remaining(size: Column, executed: Column) -> Column:
    return size - F.coalesce(executed, F.lit(0.0))


def age(now: Column, created: Column) -> Column:
    """Seconds since creation; 0 where that is unset."""
    return F.when(F.coalesce(created, F.lit(0)) == 0, F.lit(0)).otherwise(now - created).cast("long")


def hours_minutes(seconds: Column) -> Column:
    """A duration as whole hours and minutes."""
    return F.struct(F.floor(seconds / 3600).alias("hours"), F.floor(F.pmod(seconds, F.lit(3600)) / 60).alias("minutes"))


def fill_id(trade_id: Column, *place: Column) -> Column:
    """The id of a fill; without one, an id of its place in the feed, so it is never taken for a repetition."""
    return F.coalesce(F.nullif(trade_id, F.lit("")), F.concat(F.lit("exec_"), F.sha2(F.concat_ws("|", *[p.cast("string") for p in place]).cast("binary"), 256)))


def stop_holds(active: Column, price: Column) -> Column:
    return F.coalesce(active & (price > 0), F.lit(False))


def register_sql(spark: SparkSession) -> None:
    """The sizing rules as SQL functions of the session."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION position_size(value DOUBLE, entry DOUBLE, stop DOUBLE) RETURNS DOUBLE RETURN "
        f"CASE WHEN value > 0 AND entry > 0 AND stop > 0 AND stop < entry THEN round(value * {RISK}D / (entry - stop), 5) ELSE 0D END"
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ioc_limit(price DOUBLE) RETURNS DOUBLE RETURN round(price * {1 + SLIPPAGE}D, 2)")
