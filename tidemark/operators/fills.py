"""Fills against orders: a conditional running sum with refusals, executions and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as R

OVER, FULL = 1.0001, 0.9999
VERDICTS = "array<struct<execution_id:string,price:double,size:double,fee:double,ts:bigint,verdict:string>>"


def new_fills(fills: DataFrame, executions: DataFrame) -> DataFrame:
    """Fills whose id isn't stored yet."""
    return fills.join(executions.select("execution_id").distinct(), "execution_id", "left_anti")


def judged(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Orders with their fills folded in order of seq: adds executed, new_status and ledger (fills with verdicts).

    A fill is judged in this order: ``closed`` if the order is neither PENDING nor PARTIAL, ``overfill`` if it would
    take the order above its size (0.01 % allowed), ``duplicate`` if its id was accepted before, else ``accepted``.
    Only accepted fills count, so the id of an overfill stays free. An order is PARTIAL until 99.99 % of its size.
    Orders without fills stay as they are. Fills of an order are folded as one array.
    """
    return folded(orders.join(fed(fills, "order_id"), "order_id", "left").withColumn("feed", F.array_sort("feed")))


def fed(fills: DataFrame, key: str) -> DataFrame:
    """Fills of a key as one array, in no order: the key, feed."""
    one = F.struct("seq", "execution_id", "price", "size", F.coalesce("fee", F.lit(0.0)).alias("fee"), "ts")
    return fills.where((F.col("size") > 0) & F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(one).alias("feed"))


def folded(fed_orders: DataFrame) -> DataFrame:
    """:func:`judged` of orders that have their fills in order beside them (``feed``, null: none)."""
    start = F.struct(F.coalesce(F.col("executed_size"), F.lit(0.0)).alias("done"), F.col("status").alias("status"), F.array().cast("array<string>").alias("seen"), F.array().cast(VERDICTS).alias("out"))

    def step(acc, x):
        done = acc["done"] + x["size"]
        verdict = (
            F.when(~acc["status"].isin("PENDING", "PARTIAL"), "closed").when(done > F.col("size") * OVER, "overfill").when(F.array_contains(acc["seen"], x["execution_id"]), "duplicate").otherwise("accepted")
        )
        ok = verdict == "accepted"
        row = F.struct(x["execution_id"].alias("execution_id"), x["price"].alias("price"), x["size"].alias("size"), x["fee"].alias("fee"), x["ts"].alias("ts"), verdict.alias("verdict"))
        return F.struct(
            F.when(ok, done).otherwise(acc["done"]).alias("done"),
            F.when(ok, F.when(done >= F.col("size") * FULL, "FILLED").otherwise("PARTIAL")).otherwise(acc["status"]).alias("status"),
            F.when(ok, F.array_append(acc["seen"], x["execution_id"])).otherwise(acc["seen"]).alias("seen"),
            F.array_append(acc["out"], row).alias("out"),
        )

    rows = fed_orders.withColumn("f", F.aggregate(F.coalesce("feed", F.array().cast(fed_orders.schema["feed"].dataType)), start, step))
    return rows.select(*[c for c in fed_orders.columns if c != "feed"], F.col("f.done").alias("executed"), F.col("f.status").alias("new_status"), F.col("f.out").alias("ledger"))


def ledger(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """A row for each fill: order_id, symbol, place, the fill and its verdict."""
    rows = judged(orders, fills).select("order_id", "symbol", F.posexplode("ledger").alias("place", "x"))
    return rows.select("order_id", "symbol", (F.col("place") + 1).alias("place"), "x.*")


def executions(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Accepted fills; an id that several orders accept stays with the first by time."""
    from tidemark.operators.merge import first_rows

    rows = ledger(orders, fills).where("verdict = 'accepted'").drop("verdict")
    return first_rows(rows.withColumn("seq", F.struct("ts", "order_id", "place")), ["execution_id"]).drop("seq", "place")


def execution_status(orders: DataFrame, fills: DataFrame) -> DataFrame:
    return judged(orders, fills).select("order_id", "symbol", "size", F.col("executed").alias("executed_size"), F.col("new_status").alias("status"))


def positions(accepted: DataFrame, stops: DataFrame) -> DataFrame:
    """Positions of symbols from accepted fills (symbol, order_id, price, size, ts, place) and the stop of each order.

    Mean entry is weighted by size; sums are exact decimals, so they don't depend on the order of partitions. The stop is that of the latest fill.
    """
    exact = lambda c: c.cast("decimal(38,8)")
    rows = accepted.join(stops.select("order_id", "stop_price"), "order_id")
    out = rows.groupBy("symbol").agg(
        F.min("ts").alias("entry_ts"),
        (F.sum(exact(F.col("price") * F.col("size"))).cast("double") / F.sum(exact(F.col("size"))).cast("double")).alias("avg_entry"),
        F.sum(exact(F.col("size"))).cast("double").alias("current_size"),
        F.max_by("stop_price", F.struct("ts", "order_id", "place")).alias("stop_price"),
    )
    return out.withColumns({"realized_pnl": F.lit(0.0), "unrealized_pnl": F.lit(0.0), "state": F.lit("OPEN"), "stop_active": F.lit(True)})


def open_remainders(orders: DataFrame) -> DataFrame:
    """What is left of live orders, with a reproducible fill id: the relational part of a synthetic fill source."""
    rest = R.remaining(F.col("size"), F.col("executed_size"))
    live = orders.where(F.col("status").isin("PENDING", "PARTIAL")).withColumn("left", rest).where(F.col("left") > 0)
    return live.select("order_id", F.concat(F.lit("fill_"), F.col("order_id")).alias("execution_id"), "price", F.col("left").alias("size"), F.lit(0.0).alias("fee"))
