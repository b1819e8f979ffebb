"""Queries over lifecycle events, guards, feeds and schemas."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalar as R
from tidemark.operators import blocks
from tidemark.operators import events as E
from tidemark.operators import guards as G
from tidemark.operators import orders as O
from tidemark.operators import reconcile as C
from tidemark.plans import ledger as L
from tidemark.sources import messages as M
from tidemark.sources import store
from tidemark.sources.tapes import BLOCK_ROWS, scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def block() -> Column:
    """Blocks of events in order of their ids."""
    return F.floor(F.col("event_id") / BLOCK_ROWS)


@query(
    "order_transitions",
    """SELECT user_id, event_id, event_type_before, event_type FROM (
  SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS event_type_before FROM events) WHERE event_type_before <> event_type""",
)
def order_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as states of their user: every change of state with the state before."""
    return E.transitions(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"], block())


TYPES = ("click", "error", "login", "purchase", "view")


@query("lifecycle_counts", "SELECT " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + " FROM events WHERE epoch(ts) >= 1704500000")
def lifecycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.unix_timestamp("ts").alias("ts"), "event_type")
    return E.kind_counts(log, F.lit(1704500000), TYPES)


@query(
    "reconcile_events",
    f"""WITH after AS ({L.ORACLE_SQL["reconcile_tick"]}),
j AS (SELECT a.*, {L.STATUS_SQL} AS was, o_orderkey % 4 <> 0 AS had, epoch(o_orderdate)::BIGINT AS created, o_orderkey FROM after AS a JOIN orders ON o_orderkey::VARCHAR = a.order_id)
SELECT {L.NOW}::BIGINT AS ts, CASE WHEN was = 'PENDING' AND status = 'PENDING' AND NOT had AND exchange_order_id IS NOT NULL THEN 'ORDER_SUBMITTED' WHEN was = 'PENDING' AND status = 'FAILED' THEN 'ORDER_FAILED_EXCHANGE' ELSE 'ORDER_TIMEOUT' END AS event_type,
  CASE WHEN status = 'PENDING' THEN '{{"order_id":"' || order_id || '","exchange_order_id":"' || exchange_order_id || '"}}' WHEN status = 'FAILED' THEN '{{"order_id":"' || order_id || '","remote_status":null}}'
    ELSE '{{"order_id":"' || order_id || '","age_seconds":' || ({L.NOW} - created) || '}}' END AS message
FROM j WHERE was = 'PENDING' AND ((status = 'PENDING' AND NOT had AND exchange_order_id IS NOT NULL) OR status IN ('FAILED', 'EXPIRED'))""",
)
def reconcile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions, failures and timeouts of a tick (fills are in ``filled_events``)."""
    orders, signals, fills, remote = L.tick_inputs(spark, sf_dir)
    after = C.tick(orders, signals, F.lit(L.NOW), fills, remote, limit=L.LIMIT).withColumn("symbol", F.col("order_id"))
    none = spark.createDataFrame([], schemas.SCHEMAS["positions"])
    return E.order_events(orders, after, none, F.lit(L.NOW)).where("event_type <> 'ORDER_FILLED'").drop("event_key")


@query(
    "filled_events",
    f"""WITH after AS ({L.ORACLE_SQL["reconcile_tick"]}),
f AS (SELECT a.order_id, executed_size FROM after AS a JOIN orders ON o_orderkey::VARCHAR = a.order_id WHERE a.status = 'FILLED' AND {L.STATUS_SQL} IN ('PENDING', 'PARTIAL'))
SELECT order_id, 's' || order_id AS signal_id, executed_size AS fill_size, 'ORDER_FILLED' AS event_type FROM f UNION ALL SELECT order_id, NULL, 60.0, 'POSITION_OPENED' FROM f WHERE order_id::BIGINT % 2 = 0""",
)
def filled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of a tick and the positions of their symbols, read back from the messages."""
    orders, signals, fills, remote = L.tick_inputs(spark, sf_dir)
    after = C.tick(orders, signals, F.lit(L.NOW), fills, remote, limit=L.LIMIT).withColumn("symbol", F.col("order_id"))
    held = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("symbol"), F.lit("OPEN").alias("state"), F.lit(1.0).alias("avg_entry"), F.lit(60.0).alias("current_size"), F.lit(0.5).alias("stop_price"))
    log = E.order_events(orders, after, held, F.lit(L.NOW)).where("event_type IN ('ORDER_FILLED', 'POSITION_OPENED')")
    m = F.from_json("message", "order_id string, signal_id string, fill_size double, symbol string, size double")
    return log.select(F.coalesce(m["order_id"], m["symbol"]).alias("order_id"), m["signal_id"].alias("signal_id"), F.coalesce(m["fill_size"], m["size"]).alias("fill_size"), "event_type")


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine kinds: signals and their intents, a reconcile tick, stops, and guards that tripped."""
    now = F.lit(L.NOW)
    signals, held = L.given_signals(spark, sf_dir), L.given_positions(spark, sf_dir)
    intents = O.admit(signals, L.given_orders(spark, sf_dir), held, now)
    orders, known, fills, remote = L.tick_inputs(spark, sf_dir)
    after = C.tick(orders, known, now, fills, remote, limit=L.LIMIT).withColumn("symbol", F.col("order_id"))
    opened = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("symbol"), F.lit("OPEN").alias("state"), F.lit(1.0).alias("avg_entry"), F.lit(60.0).alias("current_size"), F.lit(0.5).alias("stop_price"))
    edges = G.disabled_edges(guard_states(spark, sf_dir), ["user_id"], "event_id", block()).withColumn("tripped", F.split("tripped", ","))
    parts = [E.signal_events(signals, now), E.intent_events(intents, now), E.order_events(orders, after, opened, now), E.stop_events(held, now), E.disabled_events(edges, now, F.concat_ws("|", "user_id", "event_id"))]
    return reduce(DataFrame.unionByName, parts)


@query(
    "lifecycle_log",
    f"""WITH adm AS ({L.ORACLE_SQL["order_admission"]}), after AS ({L.ORACLE_SQL["reconcile_tick"]}), stops AS ({{stops}}), edges AS ({{edges}}),
j AS (SELECT a.*, {L.STATUS_SQL} AS was, o_orderkey % 4 <> 0 AS had, o_orderkey FROM after AS a JOIN orders ON o_orderkey::VARCHAR = a.order_id),
k AS (SELECT order_id, o_orderkey, CASE WHEN was = 'PENDING' AND status = 'PENDING' AND NOT had AND exchange_order_id IS NOT NULL THEN 'ORDER_SUBMITTED' WHEN was IN ('PENDING', 'PARTIAL') AND status = 'FILLED' THEN 'ORDER_FILLED'
    WHEN was = 'PENDING' AND status = 'FAILED' THEN 'ORDER_FAILED_EXCHANGE' WHEN was = 'PENDING' AND status = 'EXPIRED' THEN 'ORDER_TIMEOUT' END AS kind FROM j),
e AS (
  SELECT 'SIGNAL_EMITTED' AS event_type, o_orderkey::VARCHAR AS subject FROM orders WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT 'ORDER_PENDING', order_id FROM adm WHERE status = 'PENDING'
  UNION ALL SELECT kind, order_id FROM k WHERE kind IS NOT NULL
  UNION ALL SELECT 'POSITION_OPENED', order_id FROM k WHERE kind = 'ORDER_FILLED' AND o_orderkey % 2 = 0
  UNION ALL SELECT 'STOP_REQUIRED', symbol || '|{L.NOW}' FROM stops
  UNION ALL SELECT 'TRADING_DISABLED', user_id || '|' || event_id FROM edges)
SELECT sha256(event_type || '|' || subject) AS event_key, event_type, {L.NOW}::BIGINT AS ts FROM e""",
)
def lifecycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all events after a checkpointed stream has written them, and after a second stream has told them again."""
    path = scratch(spark, "lifecycle")
    lifecycle_events(spark, sf_dir).write.parquet(f"{path}/events")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/events").schema).parquet(f"{path}/events")
    for run in ("first", "again"):
        E.log_stream(stream, f"{path}/log", f"{path}/{run}")
    return spark.read.parquet(f"{path}/log").select("event_key", "event_type", "ts")


@query("audit_log", "SELECT epoch(ts)::BIGINT AS ts, event_type, '{\"user_id\":' || user_id || '}' AS message, ts::DATE::VARCHAR AS date FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events)")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log by date in two batches and read back."""
    path = scratch(spark, "audit-log")
    rows = table(spark, sf_dir, "events")
    made = rows.select(*E.event("x", F.unix_timestamp("ts"), user_id=F.col("user_id")), F.col("event_type").alias("kind"), "event_id").drop("event_type").withColumnRenamed("kind", "event_type")
    for odd in (0, 1):
        E.append_log(made.where(F.col("event_id") % 2 == odd).select("ts", "event_type", "message"), path)
    return spark.read.parquet(path).withColumn("date", F.col("date").cast("string"))


@query("risk_log", "SELECT epoch(date_trunc('second', ts))::BIGINT AS ts, event_type, 'U' || user_id AS symbol, props AS message, NULL::VARCHAR AS action_taken, value FROM events WHERE event_type = 'error'")
def risk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors appended as risk events; the column that they lack is null, the one of their own stays."""
    path = scratch(spark, "risk-log")
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    store.append_risk_events(rows.select(F.unix_timestamp("ts").alias("ts"), "event_type", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("props").alias("message"), "value"), path)
    return spark.read.parquet(path)


@query("created_table", "SELECT 'C' || c_custkey AS symbol, NULL::BIGINT AS entry_ts, c_acctbal AS stop_price, 'OPEN' AS state, c_custkey % 2 = 0 AS stop_active FROM customer WHERE c_acctbal < 0")
def created_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared table that is created twice (once in effect), filled, and dropped; its rows stay where they are."""
    name, path = f"positions_{uuid.uuid4().hex}", scratch(spark, "positions")
    for _ in range(2):
        schemas.create_table(spark, name, "positions", path)
    schemas.align_schema(L.given_positions(spark, sf_dir), schemas.SCHEMAS["positions"]).write.insertInto(name)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(schemas.SCHEMAS["positions"]).parquet(path).select("symbol", "entry_ts", "stop_price", "state", "stop_active")


@query("stop_violations", "SELECT 'C' || c_custkey AS symbol, c_acctbal AS stop_price, c_custkey % 2 = 0 AS stop_active FROM customer WHERE c_acctbal < 0 AND NOT (c_custkey % 2 = 0 AND c_acctbal > 0)")
def stop_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stop_violations(L.given_positions(spark, sf_dir)).select("symbol", "stop_price", "stop_active")


@query(
    "stale_outages",
    """SELECT symbol, epoch_us(outage_start) AS outage_start, epoch_us(outage_end) AS outage_end FROM (
  SELECT event_type AS symbol, ts AS outage_start, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS outage_end FROM events) WHERE epoch_us(outage_end) - epoch_us(outage_start) > 3600000000""",
)
def stale_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts")
    return G.outages(rows, ["symbol"], "ts", 3600).select("symbol", F.unix_micros("outage_start").alias("outage_start"), F.unix_micros("outage_end").alias("outage_end"))


@query(
    "silence_at_ticks",
    """WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), t AS (SELECT user_id, ts FROM events WHERE event_type <> 'error')
SELECT e.user_id, e.event_id, round((epoch_us(e.ts) - epoch_us(t.ts)) / 1e6, 6) AS age, coalesce(epoch_us(e.ts) - epoch_us(t.ts) > 7200000000, false) AS stale
FROM e ASOF LEFT JOIN t ON e.user_id = t.user_id AND t.ts <= e.ts""",
)
def silence_at_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of the user's last other event at each error."""
    rows = table(spark, sf_dir, "events")
    out = G.silence(rows.where("event_type = 'error'").select("user_id", "event_id", "ts"), rows.where("event_type <> 'error'").select("user_id", "ts"), ["user_id"], 7200)
    return out.select("user_id", "event_id", F.round("age", 6).alias("age"), "stale")


LATCH_SQL = """t AS (
  SELECT user_id, event_id, user_id % 2 = 0 AS enabled, event_type = 'error' AND value > 60 AS violated,
    coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) > 36000000000, false) AS stale FROM events),
s AS (SELECT *, max(stale) OVER w AS ever_stale, max(violated) OVER w AS ever_violated FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT user_id, event_id, NOT stale AND NOT ever_violated AND (enabled OR ever_stale) AS can_trade,
  CASE WHEN stale AND ever_violated THEN 'stale_stream,stop_required' WHEN stale THEN 'stale_stream' WHEN ever_violated THEN 'stop_required' ELSE '' END AS tripped FROM s)"""


def guard_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as guard ticks of their user: stale after ten hours of silence, violated by large errors."""
    rows = blocks.lagged(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], block(), F.col("ts"), "before")
    step = F.unix_micros("ts") - F.unix_micros("before")
    return rows.select("user_id", "event_id", F.coalesce(step > 36_000_000_000, F.lit(False)).alias("stale"), ((F.col("event_type") == "error") & (F.col("value") > 60)).alias("violated"))


def guard_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.latch(guard_ticks(spark, sf_dir), ["user_id"], "event_id", F.col("user_id") % 2 == 0, block()).select("user_id", "event_id", "can_trade", F.array_join("tripped", ",").alias("tripped"))


@query("guard_latch", f"WITH {LATCH_SQL} SELECT * FROM g")
def guard_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard_states(spark, sf_dir)


@query(
    "guard_edges",
    f"WITH {LATCH_SQL} SELECT user_id, event_id, tripped FROM (SELECT *, lag(can_trade) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM g) WHERE b AND NOT can_trade",
)
def guard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.disabled_edges(guard_states(spark, sf_dir), ["user_id"], "event_id", block()).select("user_id", "event_id", "tripped")


@query("last_seen", "SELECT event_type AS product, epoch_us(max(ts)) AS last_seen FROM events GROUP BY event_type")
def last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("product"), "ts")
    return G.last_seen(rows, ["product"], "ts").select("product", F.unix_micros("last_seen").alias("last_seen"))


@query("props_json", "SELECT event_type, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS sum_k, count(*) AS n FROM events GROUP BY event_type")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return rows.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count(F.lit(1)).alias("n"))


@query("event_payload", """SELECT epoch(ts)::BIGINT AS ts, event_type, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS message FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events)""")
def event_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(*[c for c in E.event("x", F.unix_timestamp("ts"), event_id=F.col("event_id"), user_id=F.col("user_id"))], F.col("event_type").alias("kind")).select("ts", F.col("kind").alias("event_type"), "message")


@query(
    "schema_align",
    """SELECT 'S' || s_suppkey AS symbol, NULL::BIGINT AS entry_ts, s_acctbal AS avg_entry, NULL::DOUBLE AS stop_price, NULL::BOOLEAN AS stop_active, s_name AS name FROM supplier
UNION ALL SELECT 'C' || c_custkey, NULL, NULL, c_acctbal, c_custkey % 2 = 0, NULL FROM customer WHERE c_acctbal < 0""",
)
def schema_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables that lack columns of a declared schema, aligned and joined by name."""
    old = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_acctbal").alias("avg_entry"), F.col("s_name").alias("name"))
    target = schemas.SCHEMAS["positions"]
    both = schemas.align_schema(old, target).unionByName(schemas.align_schema(L.given_positions(spark, sf_dir), target), allowMissingColumns=True)
    return both.select("symbol", "entry_ts", "avg_entry", "stop_price", "stop_active", "name")


@query("schema_misfits", "SELECT event_id, 'value' || CASE WHEN event_id % 5 = 0 THEN ',ts' ELSE '' END AS misfit FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'ts' FROM events WHERE event_id % 3 <> 0 AND event_id % 5 = 0")
def schema_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose time or value is no number, kept apart before alignment would make these null."""
    target = schemas.schema_of("value double, ts bigint")
    said = lambda bad, good: F.when(F.col("event_id") % bad == 0, "none").otherwise(good.cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", said(3, F.col("value")).alias("value"), said(5, F.unix_timestamp("ts")).alias("ts"))
    return schemas.misfits(rows, target).select("event_id", F.array_join("misfit", ",").alias("misfit"))


@query("iso_times", "SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS sec FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 10 = 0")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in text back to seconds; what is no time is null."""
    text = F.when(F.col("event_id") % 10 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return table(spark, sf_dir, "events").select("event_id", F.round(R.epoch_seconds(text), 6).alias("sec"))


@query("orders_by_status", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 400000")
def orders_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed statement with parameters; its predicates reach the scan."""
    sql = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus IN (:a, :b) AND o_totalprice >= :least"
    return store.fetch(spark, sql, {"a": "O", "b": "P", "least": 400_000.0}, orders=table(spark, sf_dir, "orders"))


@query(
    "order_ids",
    """SELECT o_orderkey, 'ord_' || o_orderkey AS order_id, 'cb_ord_' || o_orderkey AS exchange_order_id, floor((1000000000 - epoch(o_orderdate)) / 3600.0)::BIGINT AS hours,
  floor(((1000000000 - epoch(o_orderdate)) - 3600.0 * floor((1000000000 - epoch(o_orderdate)) / 3600.0)) / 60)::BIGINT AS minutes, CASE o_orderstatus WHEN 'O' THEN 'ORDER_PENDING' ELSE 'PROCESSED' END AS signal_status FROM orders""",
)
def order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of orders and back, ages as hours and minutes, and the statuses of their signals."""
    made = R.order_id(F.col("o_orderkey").cast("string"), F.lit(False))
    rows = table(spark, sf_dir, "orders").withColumn("x", R.exchange_id(made)).withColumn("age", F.lit(1_000_000_000) - F.unix_timestamp("o_orderdate"))
    return rows.select("o_orderkey", R.order_of_exchange_id(F.col("x")).alias("order_id"), F.col("x").alias("exchange_order_id"), R.hours_minutes(F.col("age"))["hours"].alias("hours"), R.hours_minutes(F.col("age"))["minutes"].alias("minutes"), R.mapped(L.status_of(), R.SIGNAL_STATUS, "PROCESSED").alias("signal_status"))


def given_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in messages of ten: trades (a value above 90 is a bad price), every seventh message heartbeats."""
    rows = table(spark, sf_dir, "events").withColumn("seq", F.floor(F.col("event_id") / 10))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    trade = F.struct("event_id", F.col("event_type").alias("product_id"), F.when(F.col("value") > 90, "bad").otherwise(F.col("value").cast("string")).alias("price"), F.lit("1.0").alias("size"), time.alias("time"))
    grouped = rows.groupBy("seq").agg(F.array_sort(F.collect_list(trade)).alias("t"))
    trades = F.transform("t", lambda x: F.struct(x["product_id"].alias("product_id"), x["price"].alias("price"), x["size"].alias("size"), x["time"].alias("time")))
    beats = F.transform("t", lambda x: F.struct(x["product_id"].alias("product_id"), x["time"].alias("time")))
    as_trades = F.to_json(F.struct(F.lit("market_trades").alias("channel"), F.array(F.struct(trades.alias("trades"))).alias("events")))
    as_beats = F.to_json(F.struct(F.lit("heartbeats").alias("channel"), F.array(F.struct(beats.alias("heartbeats"))).alias("events")))
    return grouped.select(F.when(F.col("seq") % 7 == 0, as_beats).otherwise(as_trades).alias("value"), "seq")


BAD_SQL = "WITH m AS (SELECT *, event_id // 10 AS seq, min(CASE WHEN value > 90 THEN event_id END) OVER (PARTITION BY event_id // 10) AS bad FROM events)"


@query("trade_messages", f"{BAD_SQL} SELECT event_type AS symbol, value AS price, 1.0::DOUBLE AS size, epoch_us(ts) AS ts, seq AS message, event_id % 10 AS place FROM m WHERE seq % 7 <> 0 AND (bad IS NULL OR event_id < bad)")
def trade_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.trades(given_messages(spark, sf_dir))
    return out.select("symbol", "price", "size", F.unix_micros("ts").alias("ts"), F.col("seq.message").alias("message"), F.col("seq.place").cast("long").alias("place"))


@query("quarantined_messages", f"{BAD_SQL} SELECT DISTINCT seq, bad % 10 AS bad FROM m WHERE seq % 7 <> 0 AND bad IS NOT NULL")
def quarantined_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quarantined(given_messages(spark, sf_dir)).select("seq", "bad")


@query(
    "last_heartbeats",
    "SELECT event_type AS product, epoch_us(max(ts)) AS last_heartbeat FROM (SELECT *, max(event_id // 10) OVER (PARTITION BY event_type) AS top FROM events WHERE (event_id // 10) % 7 = 0) WHERE event_id // 10 = top GROUP BY event_type",
)
def last_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = M.heartbeats(given_messages(spark, sf_dir))
    last = beats.groupBy("product").agg(F.max(F.struct("seq", "ts")).alias("x"))
    return last.select("product", F.unix_micros("x.ts").alias("last_heartbeat"))


@query("fill_feed", "SELECT 'cb_' || l_orderkey AS exchange_order_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice END AS price, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_quantity END::DOUBLE AS size, l_tax AS fee FROM lineitem")
def fill_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of orders in both shapes of the feed, some without price or size."""
    rows = table(spark, sf_dir, "lineitem")
    one = F.struct(F.lit("").alias("trade_id"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice").cast("string")).alias("price"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity").cast("string")).alias("size"), F.col("l_tax").cast("string").alias("commission"))
    per_order = rows.groupBy("l_orderkey").agg(F.collect_list(one).alias("f"))
    value = F.when(F.col("l_orderkey") % 2 == 0, F.to_json(F.struct(F.col("f").alias("fills")))).otherwise(F.to_json("f"))
    feed = per_order.select(F.concat(F.lit("cb_"), F.col("l_orderkey").cast("string")).alias("exchange_order_id"), value.alias("value"), F.col("l_orderkey").alias("seq"))
    return M.fills(feed).select("exchange_order_id", "price", "size", "fee")


@query("remote_statuses", "SELECT 'cb_' || o_orderkey AS exchange_order_id, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE o_orderstatus END AS remote_status FROM orders")
def remote_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("order")))).when(F.col("o_orderkey") % 3 == 1, F.to_json(F.struct(F.col("o_orderstatus").alias("status")))).otherwise("{}")
    return M.remote_status(o.select(F.concat(F.lit("cb_"), F.col("o_orderkey").cast("string")).alias("exchange_order_id"), value.alias("value")))


# These use oracles that are defined after them.
ORACLE_SQL["lifecycle_log"] = ORACLE_SQL["lifecycle_log"].replace("{stops}", ORACLE_SQL["stop_violations"]).replace("{edges}", ORACLE_SQL["guard_edges"])
