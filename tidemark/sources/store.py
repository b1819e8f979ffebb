"""Tables on disk: appended changelogs, latest views, history scans and statements with parameters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import last_bars
from tidemark.operators.merge import merged
from tidemark.schemas import SCHEMAS, align_schema


def append_bars(bars: DataFrame, path: str) -> None:
    """Append bars as a changelog (with seq), partitioned by timeframe and sorted for scans by symbol."""
    bars.sortWithinPartitions("symbol", "ts_open").write.mode("append").partitionBy("timeframe").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append a batch of rows."""
    rows.write.mode("append").parquet(path)


def append_risk_events(rows: DataFrame, path: str) -> None:
    """Append risk events, aligned to their schema."""
    append_rows(align_schema(rows, SCHEMAS["risk_events"]), path)


def latest_bars(spark: SparkSession, path: str) -> DataFrame:
    """The latest view of a bar changelog."""
    return merged(spark.read.option("mergeSchema", "true").parquet(path), "bars")


def history(spark: SparkSession, path: str, symbol: str, timeframe: str, n: int) -> DataFrame:
    """The last n bars of a series; only its timeframe's partition is read, filtered by symbol in the scan."""
    rows = spark.read.parquet(path).where((F.col("timeframe") == timeframe) & (F.col("symbol") == symbol))
    return last_bars(merged(rows, "bars"), n)


def fetch(spark: SparkSession, sql: str, parameters: dict[str, Any] | list[Any], **tables: DataFrame) -> DataFrame:
    """A statement with parameter markers over named tables."""
    return spark.sql(sql, args=parameters, **tables)
