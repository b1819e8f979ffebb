"""Queries over stores that are written in versions, batches and ticks, and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.operators.merge import POLICIES
from tidemark.plans import audit, live
from tidemark.plans import ledger as L
from tidemark.plans import market
from tidemark.plans.live import trade_stream
from tidemark.sources import messages as M
from tidemark.sources.changelog import Changelog, sink
from tidemark.sources.tapes import scratch, table, tape_type
from tidemark.streaming import bars, guards, sinks
from tidemark.streaming.bars import BlockedBars
from tidemark.streaming.ticks import Book, run_book

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def at_once(sql: str, before: str) -> str:
    """The SQL of a merged table over the changes before a date."""
    return sql.replace("FROM lineitem)", f"FROM lineitem WHERE l_shipdate < TIMESTAMP '{before}')")


CUTS = ("1996-09-01", "1998-06-01", "2000-02-01")
MERGED = L.ORACLE_SQL["merged_orders"]


@query(
    "compacted_orders",
    f"SELECT 'pinned' AS version, * FROM ({at_once(MERGED, CUTS[1])}) UNION ALL SELECT 'latest', * FROM ({MERGED})",
)
def compacted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from a changelog of four appends, one told twice, whose runs are merged twice: the version of the first two, and the last."""
    log = Changelog(spark, scratch(spark, "orders-log"), POLICIES["orders"], buckets=8)
    changes = L.order_changes(spark, sf_dir)
    day = F.col("seq.l_shipdate")
    edges = [None, *CUTS, None]
    pinned = 0
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        part = changes.where((day >= F.lit(a).cast("timestamp") if a else F.lit(True)) & (day < F.lit(b).cast("timestamp") if b else F.lit(True)))
        for _ in range(2 if k == 1 else 1):
            log.append(part, "lines", k)
        if k == 1:
            pinned = log.version().number
        if k % 2:
            log.compact(2)
    then, now = log.latest(pinned), log.latest()
    return then.select(F.lit("pinned").alias("version"), "*").unionByName(now.select(F.lit("latest").alias("version"), "*"))


@query("stored_stream_bars", market.ORACLE_SQL["bar_store"].replace("CASE WHEN timeframe = '4h' THEN high + 1 ELSE high END", "high").replace("CASE WHEN timeframe = '4h' THEN close - 1 ELSE close END", "close"))
def stored_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a stream in a changelog that takes every batch twice and adds it once."""
    sinks.use_rocksdb(spark)
    path = scratch(spark, "stream-bars-log")
    log = Changelog(spark, f"{path}/log", POLICIES["bars"], buckets=8)
    take = sink(log, "bars")

    def twice(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("seq", F.lit(number))
        take(rows, number)
        take(rows, number)

    stream = bars.arrival_bars(trade_stream(spark, sf_dir), {"1h": 3600, "4h": 14400})
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return market.rounded(log.latest().select("symbol", "timeframe", "ts_open", "open", "high", "low", "close", "volume"), *market.BAR_COLUMNS)


PARTS = 3


def in_parts(rows: DataFrame, seq: str, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives that ends and goes on from its checkpoint as its rows arrive in parts, in order of ``seq``."""
    spark = rows.sparkSession
    path = scratch(spark, name)
    edges = rows.agg(F.percentile_approx(seq, [k / PARTS for k in range(1, PARTS)], 10_000).alias("e")).first()["e"] or []
    schema = None
    for k in range(len(edges) + 1):
        part = rows.where((F.col(seq) > edges[k - 1]) if k else F.lit(True)).where((F.col(seq) <= edges[k]) if k < len(edges) else F.lit(True))
        part.write.mode("append").parquet(f"{path}/in")
        made = make(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        schema = made.schema
        sinks.run_to_end(made, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(schema).parquet(f"{path}/out")


def streamed_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guards' states from ticks that arrive in three parts."""
    sinks.use_rocksdb(spark)
    make = lambda ticks: guards.guard_stream(ticks, "user_id", "event_id", F.col("user_id") % 2 == 0)
    return in_parts(audit.guard_ticks(spark, sf_dir), "event_id", "guards", make).withColumnRenamed("seq", "event_id")


@query("stream_guard_latch", audit.ORACLE_SQL["guard_latch"])
def stream_guard_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards with kept trips, over two restarts."""
    return streamed_guards(spark, sf_dir).drop("disabled")


@query("stream_guard_edges", audit.ORACLE_SQL["guard_edges"])
def stream_guard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks that disabled trading, each told once, over two restarts."""
    return streamed_guards(spark, sf_dir).where("disabled").select("user_id", "event_id", "tripped")


@query("lifecycle_changelog", audit.ORACLE_SQL["lifecycle_log"])
def lifecycle_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all events in a changelog that two streams tell, the second all over again."""
    path = scratch(spark, "lifecycle-log")
    audit.lifecycle_events(spark, sf_dir).write.parquet(f"{path}/events")
    log = Changelog(spark, f"{path}/log", E.LOG, buckets=8, seq="told")
    for run in ("first", "again"):
        stream = spark.readStream.schema(spark.read.parquet(f"{path}/events").schema).option("maxFilesPerTrigger", 50).parquet(f"{path}/events")
        stream.writeStream.foreachBatch(E.log_batch(log, run)).option("checkpointLocation", f"{path}/{run}").trigger(availableNow=True).start().awaitTermination()
    return log.latest(only=["event_type", "ts"]).select("event_key", "event_type", "ts")


def streamed_feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A part of a feed that is written as files of messages and read two at a time."""
    path = scratch(spark, "feed")
    messages = audit.given_messages(spark, sf_dir)
    messages.repartitionByRange(8, "seq").sortWithinPartitions("seq").select("value").write.text(f"{path}/in")
    feed = M.message_files(spark, f"{path}/in", maxFilesPerTrigger="2")
    feed.writeStream.foreachBatch(M.feed_sink(f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out/{name}")


@query("stream_trade_messages", f"SELECT symbol, price, size, ts, place FROM ({audit.ORACLE_SQL['trade_messages']})")
def stream_trade_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of a streamed feed, up to the first bad one of each message."""
    out = streamed_feed(spark, sf_dir, "trades")
    return out.select("symbol", "price", "size", F.unix_micros("ts").alias("ts"), F.col("seq.place").cast("long").alias("place"))


@query("stream_quarantine", f"SELECT bad, count(*) AS n FROM ({audit.ORACLE_SQL['quarantined_messages']}) GROUP BY bad")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the first bad trade in messages that a streamed feed set aside."""
    return streamed_feed(spark, sf_dir, "quarantine").groupBy("bad").agg(F.count(F.lit(1)).alias("n"))


TICKS, TICK_LIMIT = 4, 300 * 86_400


def tick_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as signals of their customer, line items as fills of their size or a part of it, and failures, by date."""
    told = lambda kind, at, seq, **fields: [F.lit(kind).alias("kind"), F.unix_timestamp(at).alias("at"), seq.alias("seq"), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("body")]
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key, entry = F.col("o_orderkey"), F.col("o_totalprice") / 1000
    signal = told(
        "signal", "o_orderdate", key * 10, signal_id=key.cast("string"), symbol=F.concat(F.lit("C"), "o_custkey"), breakout_level=entry, retest_level=entry * 0.9, atr=entry * 0.05,
        rsi=F.lit(60.0), execution_price=entry, signal_ts=F.unix_timestamp("o_orderdate"),
    )
    remote = told("remote", "o_orderdate", key * 10 + 9, exchange_order_id=F.concat(F.lit("cb_ord_"), key), remote_status=F.when(key % 5 == 0, "FAILED").otherwise("OPEN"))
    size = F.round(10_000 * 0.002 / (entry - (entry * 0.9 - entry * 0.05)), 5)
    part = F.when(F.col("l_linenumber") == 1, 0.5).when(F.col("l_linenumber") == 2, F.when(key % 2 == 0, 0.5).otherwise(0.75)).otherwise(0.01)
    paid = lines.where("l_orderkey % 3 <> 0").join(orders, key == F.col("l_orderkey"))
    fill = told(
        "fill", "l_shipdate", key * 10 + F.col("l_linenumber"), exchange_order_id=F.concat(F.lit("cb_ord_"), key), execution_id=F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        price=entry, size=size * part, fee=F.col("l_tax"),
    )
    return orders.select(*signal).unionByName(orders.select(*remote)).unionByName(paid.select(*fill))


def many_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after ticks over all messages, with a restart before each: a tick takes the next part by time.

    The messages are made and written once, by part; a part's folder is moved to where the stream looks as its time comes.
    """
    path = scratch(spark, "ticks")
    messages = tick_messages(spark, sf_dir)
    edges = [-1, *(messages.agg(F.percentile_approx("at", [k / TICKS for k in range(1, TICKS)], 10_000).alias("e")).first()["e"] or []), 1 << 62]
    part = sum((F.col("at") > e).cast("int") for e in edges[1:-1]) if len(edges) > 2 else F.lit(0)
    messages.where(F.col("at") > edges[0]).withColumn("part", part).write.partitionBy("part").parquet(f"{path}/parts")
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place(f"{path}/in"))
    for k in range(len(edges) - 1):
        if fs.exists(place(f"{path}/parts/part={k}")):
            fs.rename(place(f"{path}/parts/part={k}"), place(f"{path}/in/{k}"))
        stream = spark.readStream.schema(messages.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
        book = Book(spark, f"{path}/book", limit=TICK_LIMIT)
        run_book(stream, book, f"{path}/checkpoint").awaitTermination()
    return book.table("orders")


@query("stream_blocked_bars", live.ORACLE_SQL["stream_bars"])
def stream_blocked_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of a stream in arrival order, its trades ordered by blocks, over two restarts."""
    path = scratch(spark, "blocked-bars")
    tape = tape_type(spark, sf_dir).drop("block")

    def run() -> BlockedBars:
        made = BlockedBars(spark, f"{path}/bars", {"1h": 3600, "4h": 14400}, block_rows=1000)
        stream = spark.readStream.schema(tape.schema).parquet(f"{path}/in")
        stream.writeStream.foreachBatch(made.take).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return made

    edges = [-1, *(tape.agg(F.percentile_approx("seq", [k / PARTS for k in range(1, PARTS)], 10_000).alias("e")).first()["e"] or []), 1 << 62]
    for a, b in zip(edges, edges[1:], strict=False):
        tape.where((F.col("seq") > a) & (F.col("seq") <= b)).write.mode("append").parquet(f"{path}/in")
        made = run()
    return market.rounded(made.closed.latest().select("symbol", "timeframe", "ts_open", *BlockedBars.COLUMNS), *market.BAR_COLUMNS)


# Ticks carry state in a way that SQL doesn't follow; tests hold them against a loop.
QUERIES["many_ticks"] = many_ticks
