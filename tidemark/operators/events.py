"""Lifecycle events from changes of state, and the event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as R
from tidemark.operators import blocks
from tidemark.operators.merge import Policy

KINDS = ("SIGNAL_EMITTED", "ORDER_PENDING", "ORDER_SUBMITTED", "ORDER_FILLED", "ORDER_FAILED_EXCHANGE", "ORDER_TIMEOUT", "POSITION_OPENED", "STOP_REQUIRED", "TRADING_DISABLED")


def event(kind: str, ts: Column, **fields: Column) -> list[Column]:
    """Columns of an event log row; fields become the JSON message."""
    return [ts.cast("long").alias("ts"), F.lit(kind).alias("event_type"), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"}).alias("message")]


def keyed(kind: str, ts: Column, subject: Column, **fields: Column) -> list[Column]:
    """Columns of :func:`event` behind a key that is the same whenever the same thing is told of the same subject."""
    return [F.sha2(F.concat_ws("|", F.lit(kind), subject).cast("binary"), 256).alias("event_key"), *event(kind, ts, **fields)]


def transitions(changes: DataFrame, key: str, seq: str, state: Sequence[str], block: Column | None = None) -> DataFrame:
    """Changes of state of a key along a changelog: each row whose state differs from the key's row before, with that state.

    ``block``, which rises with ``seq``, spreads a key over its blocks.
    """
    now = F.struct(*state)
    rows = blocks.lagged(changes, [key], [seq], F.lit(0) if block is None else block, now, "before")
    return rows.where(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(now)).select(key, seq, *[F.col(f"before.{c}").alias(f"{c}_before") for c in state], *state)


def order_events(before: DataFrame, after: DataFrame, positions: DataFrame, now: Column) -> DataFrame:
    """Events of a reconcile tick from orders before and after it (order_id, status, exchange_order_id, ...), with their keys.

    The first rule that fits gives the event of an order: an exchange id appeared while pending; it became filled; it
    failed; it expired. A filled order whose symbol has an open position also gives POSITION_OPENED. The fill price is the order's limit price.
    All kinds come from one pass, so what ``after`` takes is done once.
    """
    old = before.select("order_id", F.col("status").alias("was"), F.col("exchange_order_id").alias("had"))
    rows = after.join(old, "order_id")
    pending = F.col("was") == "PENDING"
    kind = (
        F.when(pending & (F.col("status") == "PENDING") & F.col("had").isNull() & F.col("exchange_order_id").isNotNull(), "ORDER_SUBMITTED")
        .when(F.col("was").isin("PENDING", "PARTIAL") & (F.col("status") == "FILLED"), "ORDER_FILLED")
        .when(pending & (F.col("status") == "FAILED"), "ORDER_FAILED_EXCHANGE")
        .when(pending & (F.col("status") == "EXPIRED"), "ORDER_TIMEOUT")
    )
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    held = positions.where("state = 'OPEN'").groupBy("symbol").agg(F.collect_list(F.struct("avg_entry", "current_size", "stop_price")).alias("held"))
    rows = rows.select("order_id", "symbol", "signal_id", "price", "executed_size", "exchange_order_id", "fail_reason", "created_at", "kind").join(held, "symbol", "left")
    one = lambda name, **fields: F.struct(*keyed(name, now, F.col("order_id"), **fields))
    own = (
        F.when(F.col("kind") == "ORDER_SUBMITTED", one("ORDER_SUBMITTED", order_id=F.col("order_id"), exchange_order_id=F.col("exchange_order_id")))
        .when(F.col("kind") == "ORDER_FILLED", one("ORDER_FILLED", order_id=F.col("order_id"), signal_id=F.col("signal_id"), fill_price=F.col("price"), fill_size=F.col("executed_size")))
        .when(F.col("kind") == "ORDER_FAILED_EXCHANGE", one("ORDER_FAILED_EXCHANGE", order_id=F.col("order_id"), remote_status=F.col("fail_reason")))
        .when(F.col("kind") == "ORDER_TIMEOUT", one("ORDER_TIMEOUT", order_id=F.col("order_id"), age_seconds=R.age(now, F.col("created_at"))))
    )
    opened = F.transform("held", lambda p: one("POSITION_OPENED", symbol=F.col("symbol"), avg_entry=p["avg_entry"], size=p["current_size"], stop_price=p["stop_price"]))
    both = F.when((F.col("kind") == "ORDER_FILLED") & F.col("held").isNotNull(), F.concat(F.array(own), opened)).otherwise(F.array(own))
    return rows.select(F.explode(both).alias("e")).select("e.*")


def signal_events(signals: DataFrame, now: Column) -> DataFrame:
    """SIGNAL_EMITTED of signals that are new."""
    fields = {c: F.col(c) for c in ("signal_id", "symbol", "execution_price")}
    return signals.where(F.col("status") == "NEW").select(*keyed("SIGNAL_EMITTED", now, F.col("signal_id"), **fields))


def intent_events(intents: DataFrame, now: Column) -> DataFrame:
    """ORDER_PENDING of admitted intents (as :func:`tidemark.operators.orders.admit` gives them)."""
    fields = {c: F.col(c) for c in ("order_id", "signal_id", "symbol", "size", "price")}
    return intents.where(F.col("status") == "PENDING").select(*keyed("ORDER_PENDING", now, F.col("order_id"), **fields))


def stop_events(positions: DataFrame, now: Column) -> DataFrame:
    """STOP_REQUIRED of each open position without an active stop, once a tick."""
    fields = {c: F.col(c) for c in ("symbol", "stop_price", "stop_active")}
    return stop_violations(positions).select(*keyed("STOP_REQUIRED", now, F.concat_ws("|", "symbol", now.cast("string")), **fields))


def disabled_events(edges: DataFrame, now: Column, subject: Column) -> DataFrame:
    """TRADING_DISABLED of ticks that disabled trading, with the guards that tripped (``tripped``, an array of names)."""
    names = F.concat(F.lit("["), F.array_join(F.transform("tripped", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    return edges.select(*keyed("TRADING_DISABLED", now, subject, reason=F.lit("safeguard_tripped"), guard_name=names))


def stop_violations(positions: DataFrame) -> DataFrame:
    """Open positions without an active stop above 0."""
    return positions.where((F.col("state") == "OPEN") & ~R.stop_holds(F.col("stop_active"), F.col("stop_price")))


def kind_counts(log: DataFrame, since: Column, kinds: Sequence[str] = KINDS) -> DataFrame:
    """One row: how many events of each kind there are from ``since`` on."""
    return log.where(F.col("ts") >= since).agg(*[F.count_if(F.col("event_type") == k).alias(k.lower()) for k in kinds])


def append_log(events: DataFrame, path: str) -> None:
    """Append events to a log partitioned by date."""
    events.withColumn("date", F.to_date(F.timestamp_seconds("ts"))).write.mode("append").partitionBy("date").parquet(path)


def append_once(events: DataFrame, path: str) -> None:
    """Append keyed events that the log doesn't have yet, so a batch that is told again adds nothing.

    Only the dates of the batch are read; one writer at a time. A key that a batch repeats is written once, with its
    earliest time.
    """
    spark = events.sparkSession
    rows = events.groupBy("event_key").agg(F.min_by(F.struct("ts", "event_type", "message"), F.struct("ts", "message")).alias("e")).select("event_key", "e.*")
    rows = rows.withColumn("date", F.to_date(F.timestamp_seconds("ts")))
    schema = "event_key string, ts bigint, event_type string, message string, date date"
    try:
        known = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], schema)
    known = known.join(F.broadcast(rows.select("date").distinct()), "date", "left_semi").select("event_key")
    rows.join(known, "event_key", "left_anti").write.mode("append").partitionBy("date").parquet(path)


def log_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream of keyed events to its end into a log: the checkpoint skips finished batches, the keys a repeated one."""
    run = stream.writeStream.foreachBatch(lambda batch, _: append_once(batch, path)).option("checkpointLocation", checkpoint)
    run.trigger(availableNow=True).start().awaitTermination()


#: The log as a versioned changelog (:class:`tidemark.sources.changelog.Changelog`, seq ``told``): a key's first row stays.
LOG = Policy(("event_key",), ("ts", "event_type", "message"))


def log_batch(log, writer: str):
    """A callback for ``foreachBatch`` that adds keyed events to a changelog under :data:`LOG`.

    Nothing stored is read: a batch that is told again is known by its number, and a key that another batch told before
    gives way where runs are merged or read. So the cost of a batch doesn't grow with the log, and several writers may add.
    """

    def take(batch: DataFrame, number: int) -> None:
        log.append(batch.withColumn("told", F.col("ts")), writer, number)
        log.compact(8)

    return take
