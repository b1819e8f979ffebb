"""Trade tapes over tables: symbol, price, size, ts, seq (arrival order) and block (rises with seq, bounds a window)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its timestamps become instants of the session time zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster (``spark.checkpoint.dir``); on a local master alone it may be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/tidemark-shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def events_tape(spark: SparkSession, sf_dir: str, symbol: Column, seq: Column | None = None) -> DataFrame:
    """Events as trades of size 1 at their value, in order of event_id or of ``seq``."""
    seq = F.col("event_id") if seq is None else seq
    return table(spark, sf_dir, "events").select(
        symbol.cast("string").alias("symbol"), F.col("value").alias("price"), F.lit(1.0).alias("size"), "ts", seq.alias("seq"), F.floor(seq / BLOCK_ROWS).alias("block")
    )


def tape_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_tape(spark, sf_dir, F.lit("ALL"))


def tape_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_tape(spark, sf_dir, F.col("event_type"))


def tape_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_tape(spark, sf_dir, F.col("user_id"))


def tape_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of their unit price, in order of ship date, then of all ids and the price."""
    rows = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    seq = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "l_quantity")
    return rows.select(
        F.col("l_returnflag").alias("symbol"), "price", F.col("l_quantity").cast("double").alias("size"), F.col("l_shipdate").alias("ts"), seq.alias("seq"),
        F.trunc("l_shipdate", "month").alias("block"),
    )


# The same tapes in the SQL of the oracles.
TAPE_ALL_SQL = "SELECT 'ALL' AS symbol, value AS price, 1.0::DOUBLE AS size, epoch(ts) AS sec, event_id AS seq FROM events"
TAPE_TYPE_SQL = "SELECT event_type AS symbol, value AS price, 1.0::DOUBLE AS size, epoch(ts) AS sec, event_id AS seq FROM events"
TAPE_USER_SQL = "SELECT user_id::VARCHAR AS symbol, value AS price, 1.0::DOUBLE AS size, epoch(ts) AS sec, event_id AS seq FROM events"
TAPE_LINE_SQL = (
    "SELECT l_returnflag AS symbol, l_extendedprice / l_quantity AS price, l_quantity::DOUBLE AS size, epoch(l_shipdate) AS sec, "
    "row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity, l_quantity) AS seq FROM lineitem"
)
