"""Feeds of JSON messages: trades, heartbeats, fills and order statuses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as R

TRADES = "array<struct<product_id:string,price:string,size:string,time:string>>"
EVENTS = f"array<struct<trades:{TRADES},heartbeats:array<struct<product_id:string,time:string>>>>"
ENVELOPE = f"channel string, events {EVENTS}"
FILL = "struct<trade_id:string,price:string,size:string,commission:string>"


#: A file of a feed has fewer lines than two to this power.
LINE_BITS = 24


def message_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A feed of files with a message a line, as a stream: value, seq (rises with the number in a file's name, then with the line).

    Files are whole when they appear, are numbered in order of arrival and hold one task's work each. ``options`` such as
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bound a micro-batch. Blank lines are none.
    """
    files = spark.readStream.format("text").option("wholetext", "true").options(**options).load(path)
    number = F.regexp_extract("_metadata.file_name", r"(\d+)", 1).try_cast("long")
    lines = files.select(number.alias("number"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return lines.where(F.trim("value") != "").select("value", (F.shiftleft("number", LINE_BITS) + F.col("line")).alias("seq"))


def log_messages(records: DataFrame, partitions: int = 1 << 12) -> DataFrame:
    """A feed from records of a partitioned log (value, partition, offset): value, seq. Order holds within a partition."""
    return records.select(F.col("value").cast("string").alias("value"), (F.col("offset") * partitions + F.col("partition")).alias("seq"))


def feed_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A callback for ``foreachBatch`` that files trades, heartbeats and quarantined messages of a micro-batch, read once.

    Each lands in a folder of the batch that a repeated batch replaces, so what is told again counts once.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, part in (("trades", trades), ("heartbeats", heartbeats), ("quarantine", quarantined)):
                part(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return take


def channel(messages: DataFrame, name: str) -> DataFrame:
    """Messages (value, seq) of a channel, parsed as ``m``; values that are no JSON belong to none."""
    return messages.withColumn("m", F.from_json("value", ENVELOPE)).where(F.col("m.channel") == name)


def _trades(messages: DataFrame) -> DataFrame:
    """All trades of trade messages by place, and the place of the first bad one of their message (null if none).

    A trade is bad without product or with a price, size or time that is none. Each message is judged in its own row.
    """
    none = lambda kind: F.array().cast(kind)
    every = F.flatten(F.transform(F.coalesce("m.events", none(EVENTS)), lambda e: F.coalesce(e["trades"], none(TRADES))))
    is_bad = lambda t: t["product_id"].isNull() | R.number(t["price"]).isNull() | R.number(t["size"]).isNull() | t["time"].try_cast("timestamp").isNull()
    rows = channel(messages, "market_trades").withColumn("all", every)
    bad = F.array_position(F.transform("all", is_bad), True)
    return rows.withColumn("bad", F.when(bad > 0, bad - 1))


def trades(messages: DataFrame) -> DataFrame:
    """Trades: symbol, price, size, ts, seq (message, place), block, ingest_ts if messages have one.

    Of a message with a bad trade those before it stay. Works on streams: no message needs another.
    """
    kept = F.when(F.col("bad").isNull(), F.col("all")).otherwise(F.slice("all", F.lit(1), F.col("bad").cast("int")))
    extra = [c for c in ("ingest_ts",) if c in messages.columns]
    rows = _trades(messages).select("seq", *extra, F.posexplode(kept).alias("place", "t"))
    return rows.select(
        F.col("t.product_id").alias("symbol"), R.number(F.col("t.price")).alias("price"), R.number(F.col("t.size")).alias("size"), F.col("t.time").try_cast("timestamp").alias("ts"),
        F.struct(F.col("seq").alias("message"), "place").alias("seq"), F.floor(F.col("seq") / 100_000).alias("block"), *extra,
    )


def quarantined(messages: DataFrame) -> DataFrame:
    """Messages with a bad trade, its place, and messages that can't be parsed (place null)."""
    bad = _trades(messages).where("bad IS NOT NULL").select("seq", "value", "bad")
    broken = messages.where(F.from_json("value", ENVELOPE)["channel"].isNull()).select("seq", "value", F.lit(None).cast("long").alias("bad"))
    return bad.withColumn("bad", F.col("bad").cast("long")).unionByName(broken)


def heartbeats(messages: DataFrame) -> DataFrame:
    """Heartbeats: product, ts, seq."""
    rows = channel(messages, "heartbeats").select("seq", F.explode("m.events").alias("e")).select("seq", F.explode("e.heartbeats").alias("h"))
    return rows.select(F.col("h.product_id").alias("product"), F.col("h.time").try_cast("timestamp").alias("ts"), "seq")


def last_heartbeats(messages: DataFrame) -> DataFrame:
    """The last heartbeat of each product in order of arrival."""
    return heartbeats(messages).groupBy("product").agg(F.max_by("ts", "seq").alias("last_heartbeat"))


def fills(feed: DataFrame) -> DataFrame:
    """Fills from a feed (exchange_order_id, value, seq): an object with ``fills`` or a bare list.

    Price stays null where missing (the order's price holds), size and commission become 0, and a fill without id gets
    one of its place, so it repeats nothing.
    """
    found = F.coalesce(F.from_json("value", f"struct<fills:array<{FILL}>>")["fills"], F.from_json("value", f"array<{FILL}>"))
    rows = feed.select("exchange_order_id", "seq", F.posexplode(found).alias("place", "f"))
    return rows.select(
        "exchange_order_id", F.struct("seq", "place").alias("seq"), R.fill_id(F.col("f.trade_id"), F.col("exchange_order_id"), F.col("seq"), F.col("place")).alias("execution_id"),
        R.number(F.col("f.price")).alias("price"), F.coalesce(R.number(F.col("f.size")), F.lit(0.0)).alias("size"), F.coalesce(R.number(F.col("f.commission")), F.lit(0.0)).alias("fee"),
    )


def remote_status(feed: DataFrame) -> DataFrame:
    """Status from a feed (exchange_order_id, value): inside ``order``, or bare; empty where missing."""
    parsed = F.from_json("value", "struct<order:struct<status:string>,status:string>")
    return feed.select("exchange_order_id", F.coalesce(parsed["order"]["status"], parsed["status"], F.lit("")).alias("remote_status"))
