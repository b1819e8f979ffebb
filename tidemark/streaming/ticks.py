"""Ticks that follow one another: signals become orders, orders meet fills, and what is left is carried to the next tick.

A micro-batch is a tick. An order is of a signal that was told, a rejected one never changes and has a table of its own, and a
signal that is NEW has no order; so a tick reads the live orders, what waits, and of fills, remote statuses and signals the
rows of these orders, not the whole of what was told. The tables are versioned changelogs that take a tick once; a tick that is tried again starts from
the versions before it, so it comes to the same rows whatever it had written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions import scalar as R
from tidemark.operators import events as E
from tidemark.operators import orders as O
from tidemark.operators import reconcile as C
from tidemark.operators.merge import POLICIES, Policy
from tidemark.schemas import SCHEMAS, schema_of
from tidemark.sources.changelog import Changelog

WRITER = "tick"
MESSAGE = "kind string, at bigint, seq bigint, body string"
SIGNAL = "signal_id string, symbol string, breakout_level double, retest_level double, atr double, rsi double, execution_price double, signal_ts bigint"
FILL = "exchange_order_id string, execution_id string, price double, size double, fee double"
REMOTE = "exchange_order_id string, remote_status string"
_signal_columns = tuple(c.split()[0] for c in SIGNAL.split(", "))

TABLES: dict[str, tuple[Policy, StructType]] = {
    "signals": (Policy(("signal_id",), _signal_columns[1:], ("status",)), schema_of(f"{SIGNAL}, status string")),
    "orders": (POLICIES["orders"], SCHEMAS["orders"]),
    "rejected": (POLICIES["orders"], SCHEMAS["orders"]),
    "executions": (POLICIES["executions"], SCHEMAS["executions"]),
    "positions": (POLICIES["positions"], SCHEMAS["positions"]),
    "state": (POLICIES["runtime_state"], SCHEMAS["runtime_state"]),
    "fills": (Policy(("exchange_order_id", "seq"), ("execution_id", "price", "size", "fee")), schema_of(f"{FILL}, seq bigint")),
    "remote": (Policy(("exchange_order_id",), (), ("remote_status",)), schema_of(REMOTE)),
    "events": (Policy(("event_key",), ("ts", "event_type", "message")), schema_of("event_key string, ts bigint, event_type string, message string")),
}


class Book:
    """The tables that ticks read and write, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, limit: int = 60, portfolio: float = 10_000.0, buckets: int = 16, fanout: int = 4) -> None:
        self.spark, self.limit, self.portfolio, self.fanout = spark, limit, portfolio, fanout
        self.logs = {name: Changelog(spark, f"{path}/{name}", policy, buckets, seq="__tick") for name, (policy, _) in TABLES.items()}

    def table(self, name: str, number: int | None = None) -> DataFrame:
        """The latest rows of a table, or those before tick ``number``."""
        rows = self._read(name, number, lambda log, at: log.latest(at))
        return rows.unionByName(self.table("rejected", number)) if name == "orders" else rows

    def _read(self, name: str, number: int | None, read: Callable[[Changelog, int], DataFrame | None]) -> DataFrame:
        """What ``read`` gives of a log's latest version, or of that before tick ``number``."""
        log = self.logs[name]
        version = log.version() if number is None else log.before(WRITER, number)
        rows = read(log, version.number)
        return self.spark.createDataFrame([], TABLES[name][1]) if rows is None else rows

    def _add(self, name: str, rows: DataFrame, number: int) -> None:
        policy = TABLES[name][0]
        names = [*policy.key, *policy.first, *policy.last]
        self.logs[name].append(rows.select(*names).withColumn("__tick", F.lit(number)), WRITER, number)

    def take(self, batch: DataFrame, number: int) -> None:
        """One tick over messages (kind, at, seq, body), for ``foreachBatch``. The time of the tick is the latest ``at``.

        Messages are ``signal``, ``fill`` and ``remote`` with a JSON body, and ``trading`` with body ``on`` or ``off``. In this
        order: signals that are new or were held back become intents (unless trading is off) under the exposure of open
        positions and live orders of all ticks before; pending orders are submitted, filled from all fills told so far,
        failed or expired; executions, positions, statuses and events are added. An empty batch is no tick.
        """
        trading = F.col("kind") == "trading"
        latest, said = batch.agg(F.max("at"), F.max_by(F.when(trading, F.col("body")), F.when(trading, F.col("seq")))).first()
        if latest is not None:
            self._tick(batch, number, F.lit(latest).cast("long"), said)
        for log in self.logs.values():
            log.compact(self.fanout)

    def _tick(self, batch: DataFrame, number: int, now: Column, said: str | None) -> None:
        of = lambda kind, schema: batch.where(F.col("kind") == kind).select(F.from_json("body", schema).alias("m"), "seq").select("m.*", "seq")
        self._add("fills", of("fill", FILL), number)
        self._add("remote", of("remote", REMOTE).groupBy("exchange_order_id").agg(F.max_by("remote_status", "seq").alias("remote_status")), number)
        was_on = self._trading(self.table("state", number))
        on = was_on if said is None else said != "off"
        if said is not None:
            self._add("state", self.spark.createDataFrame([("trading", said)], "key string, value string"), number)

        positions = self.table("positions", number)
        orders = self._read("orders", number, lambda log, at: log.latest(at)).where(F.col("status").isin(*O.LIVE)).persist()
        told = of("signal", SIGNAL).groupBy("signal_id").agg(F.min_by(F.struct(*_signal_columns[1:]), "seq").alias("s")).select("signal_id", "s.*", F.lit("NEW").alias("status"))
        fresh = told.join(self._read("signals", number, lambda log, at: log.keys(at)).select("signal_id"), "signal_id", "left_anti").persist()
        waiting = fresh.unionByName(self._read("signals", number, lambda log, at: log.fitting(F.col("status") == "NEW", at)))
        intents = O.admit(waiting if on else waiting.limit(0), orders, positions, now, self.portfolio).persist()
        before = orders.unionByName(intents.where("status = 'PENDING'").drop("signal_status"))
        after = C.tick(before, None, now, *self._feed(orders, number, now), limit=self.limit).persist()
        try:
            old = before.select("order_id", F.struct(*orders.columns).alias("old"))
            moved = after.join(old, "order_id").where(~F.struct(*orders.columns).eqNullSafe(F.col("old"))).select(*orders.columns)
            self._add("orders", moved, number)
            self._add("rejected", intents.where("status <> 'PENDING'"), number)
            paid = after.select("order_id", "signal_id", "symbol", F.posexplode("ledger").alias("place", "x")).where("x.verdict = 'accepted'").select("order_id", "signal_id", "symbol", "place", "x.*")
            self._add("executions", paid, number)
            known = self._read("signals", number, lambda log, at: log.matching(paid.select("signal_id"), at, ("retest_level", "atr")))
            levels = ("signal_id", "retest_level", "atr")
            stops = fresh.select(*levels).unionByName(known.select(*levels)).select("signal_id", R.stop_level(F.col("retest_level"), F.col("atr")).alias("stop"))
            self._add("positions", self._filled(positions, paid.join(stops, "signal_id"), now), number)

            decided = intents.select("signal_id", "signal_status").unionByName(after.where("signal_status IS NOT NULL").select("signal_id", "signal_status"))
            named = fresh.join(decided, "signal_id", "left").withColumn("status", F.coalesce("signal_status", "status"))
            others = decided.join(fresh.select("signal_id"), "signal_id", "left_anti").withColumnRenamed("signal_status", "status")
            self._add("signals", named.drop("signal_status").unionByName(others, allowMissingColumns=True), number)

            held = self.table("positions")
            parts = [E.signal_events(fresh, now), E.intent_events(intents, now), E.order_events(before, after, held, now), E.stop_events(held, now)]
            if was_on and not on:
                parts.append(E.disabled_events(self.spark.range(1).select(F.array(F.lit("trading")).alias("tripped")), now, now.cast("string")))
            self._add("events", reduce(DataFrame.unionByName, parts), number)
        finally:
            for rows in (after, intents, fresh, orders):
                rows.unpersist()

    def _trading(self, state: DataFrame) -> bool:
        said = state.where("key = 'trading'").first()
        return said is None or said["value"] != "off"

    def _feed(self, live: DataFrame, number: int, now: Column) -> tuple[DataFrame, DataFrame]:
        """Of pending orders that were submitted, all fills told so far (but for ids that are executions already) and the remote statuses."""
        asked = live.where("status = 'PENDING' AND exchange_order_id IS NOT NULL").select("exchange_order_id")
        of = lambda name: self._read(name, None, lambda log, at: log.matching(asked, at))
        paid = self._read("executions", number, lambda log, at: log.keys(at)).select("execution_id")
        return of("fills").withColumn("ts", now).join(paid, "execution_id", "left_anti"), of("remote")

    def _filled(self, positions: DataFrame, paid: DataFrame, now: Column) -> DataFrame:
        """Positions of symbols whose orders were filled in this tick."""
        sums = paid.groupBy("symbol").agg(F.sum(F.col("price") * F.col("size")).alias("cost"), F.sum("size").alias("more"), F.max_by("stop", F.struct("order_id", "place")).alias("stop"))
        rows = sums.join(positions, "symbol", "left")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        size = zero("current_size") + F.col("more")
        return rows.select(
            "symbol", F.coalesce("entry_ts", now).alias("entry_ts"), ((zero("avg_entry") * zero("current_size") + F.col("cost")) / size).alias("avg_entry"), size.alias("current_size"),
            zero("realized_pnl").alias("realized_pnl"), zero("unrealized_pnl").alias("unrealized_pnl"), F.col("stop").alias("stop_price"), F.lit("OPEN").alias("state"), F.lit(True).alias("stop_active"),
        )


def run_book(messages: DataFrame, book: Book, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Ticks over a stream of messages: each ``seconds``, or (by default) over all that is there now."""
    out = messages.writeStream.foreachBatch(book.take).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if seconds is None else out.trigger(processingTime=f"{seconds} seconds")).start()
