"""Declared schemas of the tables, and alignment of older data to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

TYPES = {"string": StringType(), "double": DoubleType(), "bigint": LongType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def schema_of(columns: str) -> StructType:
    """A schema from names and types, without a session."""
    return StructType([StructField(name, TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


SCHEMAS: dict[str, StructType] = {
    name: schema_of(columns)
    for name, columns in {
        "trades": "symbol string, price double, size double, ts timestamp, seq bigint, ingest_ts timestamp",
        "bars": "symbol string, timeframe string, ts_open bigint, open double, high double, low double, close double, volume double",
        "signals": "signal_id string, symbol string, signal_type string, regime_snapshot string, breakout_level double, retest_level double, "
        "atr double, rsi double, status string, execution_price double",
        "orders": "order_id string, signal_id string, symbol string, side string, price double, size double, executed_size double, status string, "
        "created_at bigint, exchange_order_id string, submitted_at bigint, updated_at bigint, fail_reason string",
        "executions": "execution_id string, order_id string, price double, size double, fee double, ts bigint",
        "positions": "symbol string, entry_ts bigint, avg_entry double, current_size double, realized_pnl double, unrealized_pnl double, "
        "stop_price double, state string, stop_active boolean",
        "event_log": "ts bigint, event_type string, message string",
        "runtime_state": "key string, value string",
        "risk_events": "ts bigint, event_type string, symbol string, message string, action_taken string",
    }.items()
}

#: Names that rows of a table are unique by once its changelog is merged.
KEYS = {
    "bars": ("symbol", "timeframe", "ts_open"),
    "signals": ("signal_id",),
    "orders": ("order_id",),
    "executions": ("execution_id",),
    "positions": ("symbol",),
    "runtime_state": ("key",),
}


def missing_columns(df: DataFrame, target: StructType) -> list[str]:
    """Columns of the target that ``df`` lacks."""
    return [f.name for f in target if f.name not in df.columns]


def align_schema(df: DataFrame, target: StructType) -> DataFrame:
    """``df`` with the target's columns and types, missing ones null; columns of its own come last.

    Applied twice it changes nothing, and values that can't be cast become null; :func:`misfits` gives their rows.
    """
    out = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target]
    return df.select(*out, *[c for c in df.columns if c not in target.names])


def misfits(df: DataFrame, target: StructType) -> DataFrame:
    """Rows of ``df`` that alignment would change: columns of ``df`` with misfit, the names of those that can't be cast."""
    lost = [F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f.name)) for f in target if f.name in df.columns]
    rows = df.withColumn("misfit", F.array_compact(F.array(*lost)) if lost else F.array().cast("array<string>"))
    return rows.where(F.size("misfit") > 0)


def create_table(spark: SparkSession, name: str, schema: str, path: str | None = None) -> None:
    """A parquet table with a declared schema; with ``path`` its rows stay there when the table is dropped."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[schema])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet" + (f" LOCATION '{path}'" if path else ""))
