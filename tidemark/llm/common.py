"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster (``spark.checkpoint.dir``); on a local master alone it may be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/tidemark-shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def light_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most ``rows`` texts to a Python worker at once (from here on in this session), so workers stay small."""
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a path and read back. Its shuffle files go when the write ends, as nothing needs them again."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and is computed once."""
    return written(df, shared_path(df.sparkSession, name))


#: Rows of ids or hashes that are broadcast when counted to be no more; else they are joined by shuffle. Two numbers a
#: row are 16 MB of values and some 40 to 80 MB as a hash table, rows with digests as text up to three times that.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it was counted to be small. It should be stored: it is read twice."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows of one key that a join leaves in one part.
HOT_ROWS = 20_000


def hot_keys(rows: DataFrame, key: str, many: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys of more than ``hot_rows`` rows with the number of parts for their rows (``__parts``); None without any.

    With ``many``, ``rows`` holds a row a key and its count is in that column; else rows are counted by partial sums.
    """
    counted = rows.where(F.col(key).isNotNull())
    counted = counted.select(key, F.col(many).alias("__n")) if many else counted.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = counted.where(F.col("__n") > hot_rows).select(key, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__parts"))
    return None if hot.isEmpty() else small(stored(hot, "hot-keys"))


def spread_join(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Inner join of ``rows`` with ``values`` on ``key``, for few values a key and any number of rows a key.

    Rows of ``hot`` keys (see :func:`hot_keys`) are dealt to parts by hash of the whole row, and the values of such a
    key are repeated for each part, so no key fills a task. Null keys join nothing.
    """
    if hot is None:
        return rows.join(values, key)
    dealt = rows.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(*rows.columns), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    return dealt.join(values.join(hot, key, "left").withColumn("__part", parts).drop("__parts"), [key, "__part"]).drop("__part")


def is_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3 (such rows teach no model)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    name = f"__{stem}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: CRC-32 of text in SQL, a half byte at a time; the table is computed from the polynomial.
CRC_SQL = """crc_t AS MATERIALIZED (
  SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(range(4), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k) AS v FROM range(16) AS r(k)))"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text column's UTF-8; needs the row of crc_t as ``t``."""
    halves = f"list_transform(range(2 * octet_length(encode({text}))), lambda i: strpos('0123456789ABCDEF', hex(encode({text}))[i + 2 - 2 * (i % 2)]) - 1)"
    return f"xor(list_reduce({halves}, lambda c, b: xor(c // 16, t[xor(c, b) % 16 + 1]), 4294967295), 4294967295)"
