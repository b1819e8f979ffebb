"""Queries that run a stream over a whole table in micro-batches and read its results back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import folds
from tidemark.operators import bars as B
from tidemark.operators import setups as S
from tidemark.plans import market, setups
from tidemark.plans.audit import ORACLE_SQL as AUDIT_SQL
from tidemark.sources.tapes import TAPE_TYPE_SQL, scratch, table, tape_type
from tidemark.streaming import bars, detector, history, monitors, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def finished(stream: DataFrame, name: str) -> DataFrame:
    """The results of a stream that has run to its end."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    sinks.run_to_end(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def trade_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of trades of their type."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


@query("stream_bars", f"WITH {market.bars_sql(TAPE_TYPE_SQL, {'1h': 3600, '4h': 14400})} SELECT {market.BARS_OUT} FROM bars")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars in arrival order by a stateful stream."""
    sinks.use_rocksdb(spark)
    return market.rounded(finished(bars.arrival_bars(trade_stream(spark, sf_dir), {"1h": 3600, "4h": 14400}), "stream-bars"), *market.BAR_COLUMNS)


@query(
    "stream_windowed_bars",
    f"""WITH t AS ({TAPE_TYPE_SQL}), b AS (SELECT *, floor(sec)::BIGINT - floor(sec)::BIGINT % 3600 AS ts_open FROM t), m AS (SELECT max(sec) - 600 AS mark FROM t)
SELECT symbol, '1h' AS timeframe, ts_open, round(arg_min(price, seq), 8) AS open, round(max(price), 8) AS high, round(min(price), 8) AS low, round(arg_max(price, seq), 8) AS close,
  round(sum(size), 8) AS volume FROM b, m GROUP BY symbol, ts_open, mark HAVING ts_open + 3600 <= mark""",
)
def stream_windowed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by event time behind a watermark; bars that it hasn't passed stay open."""
    return market.rounded(finished(bars.windowed_bars(trade_stream(spark, sf_dir), {"1h": 3600}), "windowed-bars"), *market.BAR_COLUMNS)


@query("stream_stale", AUDIT_SQL["stale_outages"])
def stream_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of each type, told when they end."""
    sinks.use_rocksdb(spark)
    out = finished(monitors.stale_feed(trade_stream(spark, sf_dir), 3_600_000, timers=False), "stale")
    return out.select("symbol", "outage_start", "outage_end")


@query(
    "stream_setups",
    f"""{setups.CHAIN}
SELECT oc.symbol, c_ts AS signal_ts, oc.ts_open AS breakout_ts, round(level, 8) AS breakout_level, round(r_low, 8) AS retest_level, round(c_close, 8) AS execution_price FROM oc JOIN ch3 USING (symbol, idx) WHERE outcome = 'signal'""",
)
def stream_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of prepared bars that are written as files and read as a stream."""
    sinks.use_rocksdb(spark)
    path = scratch(spark, "setup-bars")
    made = setups.bars(spark, sf_dir).withColumn("breakout", S.is_breakout(setups.P))
    made.select("symbol", "ts_open", "low", "high", "close", "atr", "rsi", "bullish", "breakout", "prior_high").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = finished(monitors.setup_stream(stream, setups.P), "setups")
    return market.rounded(out.drop("atr", "rsi"), "breakout_level", "retest_level", "execution_price")


#: Hours and four hours, with limits that noise passes.
LIVE = replace(setups.P, signal="1h", regime="4h", signal_sec=3600, regime_sec=14400, least_signal=10, least_regime=12, fast=4, slow=10)


@query(
    "stream_signals",
    f"""WITH RECURSIVE {setups.stages_sql(TAPE_TYPE_SQL, LIVE)}, {setups.CHAIN_STEP}
SELECT oc.symbol, c_ts AS signal_ts, oc.ts_open AS breakout_ts, round(level, 8) AS breakout_level, round(r_low, 8) AS retest_level, round(c_atr, 6) AS atr, round(c_rsi, 6) AS rsi, round(c_close, 8) AS execution_price
FROM oc JOIN ch3 USING (symbol, idx) WHERE outcome = 'signal'""",
)
def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals straight from a stream of trades."""
    sinks.use_rocksdb(spark)
    out = finished(detector.detect(trade_stream(spark, sf_dir), LIVE), "signals")
    return market.rounded(market.rounded(out, "breakout_level", "retest_level", "execution_price"), "atr", "rsi", places=6)


THIRDS = 3


@query("stream_bars_resumed", ORACLE_SQL["stream_bars"])
def stream_bars_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars from a stream that ends and goes on from its checkpoint twice, as trades arrive in three parts."""
    sinks.use_rocksdb(spark)
    path = scratch(spark, "resumed")
    tape = tape_type(spark, sf_dir).drop("block")
    edges = tape.agg(F.percentile_approx("seq", [k / THIRDS for k in range(1, THIRDS)], 10_000).alias("e")).collect()[0]["e"] or []
    for k in range(len(edges) + 1):
        part = tape.where((F.col("seq") > edges[k - 1]) if k else F.lit(True)).where((F.col("seq") <= edges[k]) if k < len(edges) else F.lit(True))
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(tape.schema).parquet(f"{path}/in")
        sinks.run_to_end(bars.arrival_bars(stream, {"1h": 3600, "4h": 14400}), f"{path}/out", f"{path}/checkpoint")
    return market.rounded(spark.read.parquet(f"{path}/out"), *market.BAR_COLUMNS)


@query("closed_bar_callbacks", f"WITH {market.bars_sql(TAPE_TYPE_SQL, {'4h': 14400})} SELECT symbol, ts_open, round(close, 8) AS close FROM bars")
def closed_bar_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a callback on closed bars was given, micro-batch by micro-batch; a repeated batch replaces itself."""
    sinks.use_rocksdb(spark)
    path = scratch(spark, "callbacks")
    stream = bars.arrival_bars(trade_stream(spark, sf_dir), {"4h": 14400})
    told = sinks.on_batch(stream, lambda closed, batch: closed.write.mode("overwrite").parquet(f"{path}/out/batch={batch}"), f"{path}/checkpoint", seconds=1)
    try:
        told.processAllAvailable()
    finally:
        told.stop()
    return market.rounded(spark.read.parquet(f"{path}/out").select("symbol", "ts_open", "close"), "close")


@query(
    "stream_ema",
    f"""WITH {market.bars_sql(TAPE_TYPE_SQL, {'1h': 3600})}, a AS (SELECT *, list(close) OVER {market.frame_sql(60)} AS w FROM bars)
SELECT symbol, timeframe, ts_open, len(w)::INTEGER AS n_window, round({market.ema_sql('w', 20)}, 6) AS ema FROM a, (SELECT (min(ts_open) + max(ts_open)) // 2 AS half FROM bars) WHERE ts_open >= half""",
)
def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over bounded windows of a stream of bars; bars of the first half of the time are stored and warm it up."""
    sinks.use_rocksdb(spark)
    path = scratch(spark, "bars")
    made = B.bars(tape_type(spark, sf_dir), {"1h": 3600})
    made.write.parquet(path)
    half = spark.read.parquet(path).agg(F.floor((F.min("ts_open") + F.max("ts_open")) / 2)).first()[0]
    later = F.coalesce(F.col("ts_open") >= F.lit(half), F.lit(False))
    past = spark.read.parquet(path).where(~later)
    stream = spark.readStream.schema(made.schema).parquet(path).where(later)
    out = finished(history.rolling_windows(stream, 60, past), "windows")
    return market.rounded(out.select("symbol", "timeframe", "ts_open", "n_window", folds.ema(F.col("closes"), 20).alias("ema")), "ema", places=6)


SILENT_MS, LATE = 3_600_000, "10 minutes"


@query(
    "stream_silences",
    f"""WITH t AS (SELECT event_type AS symbol, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS next FROM events),
m AS (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM events)
SELECT symbol, 'stale' AS kind, us AS outage_start, 0::BIGINT AS outage_end FROM t, m WHERE next - us > {SILENT_MS}000 OR next IS NULL AND us / 1000.0 + {SILENT_MS} < mark
UNION ALL SELECT symbol, 'recovered', us, next FROM t WHERE next - us > {SILENT_MS}000""",
)
def stream_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of each type by timers in event time: their starts (with no end yet, 0), also of those that go on, and their ends."""
    sinks.use_rocksdb(spark)
    out = finished(monitors.silences(trade_stream(spark, sf_dir), SILENT_MS, LATE), "silences")
    return out.withColumn("outage_end", F.coalesce("outage_end", F.lit(0)))


EXPIRE_MS = 90 * 86_400_000


@query(
    "stream_expiries",
    f"""WITH f AS (SELECT l_orderkey, min(l_shipdate) AS paid FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey),
o AS (SELECT o_orderkey, epoch_us(o_orderdate) AS since, epoch_us(paid) AS paid FROM orders LEFT JOIN f ON l_orderkey = o_orderkey),
m AS (SELECT max(greatest(since, coalesce(paid, since))) // 1000 - 600000 AS mark FROM o)
SELECT o_orderkey::VARCHAR AS order_id, 'EXPIRED' AS status, since + {EXPIRE_MS}000 AS expired_at FROM o, m
WHERE CASE WHEN paid IS NULL OR paid < since THEN since // 1000 + {EXPIRE_MS} < mark ELSE paid - since >= {EXPIRE_MS}000 END""",
)
def stream_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no shipment reached in ninety days, by timers in event time."""
    sinks.use_rocksdb(spark)
    path = scratch(spark, "order-changes")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    told = orders.select(F.col("o_orderkey").cast("string").alias("order_id"), F.lit("PENDING").alias("status"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("seq"))
    first = lines.where("l_orderkey % 3 <> 0").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("timestamp").alias("ts"))
    told.unionByName(first.select(F.col("l_orderkey").cast("string").alias("order_id"), F.lit("FILLED").alias("status"), "ts", F.lit(2).cast("long").alias("seq"))).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return finished(monitors.expiries(stream, EXPIRE_MS, LATE), "expiries")
