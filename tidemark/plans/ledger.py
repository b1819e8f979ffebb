"""Queries over order intents, fills, positions and reconcile ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as R
from tidemark.operators import fills as X
from tidemark.operators import merge as M
from tidemark.operators import orders as O
from tidemark.operators import reconcile as C
from tidemark.plans.market import rounded
from tidemark.sources.tapes import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1_000_000_000


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def status_of() -> Column:
    """Order states of the given orders: F filled, P partial, O pending."""
    return R.mapped(F.col("o_orderstatus"), {"F": "FILLED", "P": "PARTIAL"}, "PENDING")


STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'P' THEN 'PARTIAL' ELSE 'PENDING' END"


@query(
    "position_sizes",
    """SELECT c_custkey, round(c_acctbal * 0.9, 4) AS stop,
  CASE WHEN c_acctbal > 0 AND c_acctbal * 0.9 > 0 AND c_acctbal * 0.9 < c_acctbal THEN round(10000.0::DOUBLE * 0.002::DOUBLE / (c_acctbal - c_acctbal * 0.9::DOUBLE), 5) ELSE 0 END AS size
FROM customer""",
)
def position_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = F.col("c_acctbal") * 0.9
    out = table(spark, sf_dir, "customer").select("c_custkey", F.round(stop, 4).alias("stop"), R.position_size(F.lit(10_000.0), F.col("c_acctbal"), stop).alias("size"))
    return out


@query(
    "ioc_limits",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, round((l_extendedprice * (1 + 0.005::DOUBLE))::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE AS limit_price FROM lineitem",
)
def ioc_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", R.ioc_limit(F.col("l_extendedprice")).alias("limit_price"))


@query(
    "sizing_sql_functions",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(10000.0::DOUBLE * 0.002::DOUBLE / (c_acctbal - c_acctbal * 0.9::DOUBLE), 5) ELSE 0 END AS size,
  round((c_acctbal * (1 + 0.005::DOUBLE))::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE AS limit_price FROM customer WHERE c_acctbal >= 100""",
)
def sizing_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizing rules as SQL functions in a statement with parameters."""
    R.register_sql(spark)
    customers = table(spark, sf_dir, "customer")
    sql = "SELECT c_custkey, position_size(:value, c_acctbal, c_acctbal * 0.9D) AS size, ioc_limit(c_acctbal) AS limit_price FROM {customers} WHERE c_acctbal >= :least"
    return spark.sql(sql, args={"value": 10_000.0, "least": 100.0}, customers=customers)


def given_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the given tables as signals of their customer; every seventh lacks a range."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("signal_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.when(F.col("o_orderkey") % 11 == 0, "PROCESSED").otherwise("NEW").alias("status"),
        (F.col("o_totalprice") * 0.98).alias("retest_level"),
        F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("o_totalprice") * 0.01).alias("atr"),
        F.col("o_totalprice").alias("execution_price"),
        F.unix_timestamp("o_orderdate").alias("signal_ts"),
    )


def given_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders of the given tables as orders that their signals already have."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return o.select(F.col("o_orderkey").cast("string").alias("signal_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), status_of().alias("status"))


def given_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt as symbols with an open position."""
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"), F.lit("OPEN").alias("state"), F.col("c_acctbal").alias("stop_price"), (F.col("c_custkey") % 2 == 0).alias("stop_active"))


EXPOSED_SQL = f"""live AS (SELECT o_orderkey::VARCHAR AS signal_id, 'C' || o_custkey AS symbol, {STATUS_SQL} AS status FROM orders WHERE o_orderpriority = '1-URGENT'),
held AS (SELECT 'C' || c_custkey AS symbol FROM customer WHERE c_acctbal < 0),
exposed AS (SELECT symbol FROM held UNION SELECT symbol FROM live WHERE status IN ('PENDING', 'PARTIAL'))"""


@query("exposed_symbols", f"WITH {EXPOSED_SQL} SELECT symbol FROM exposed")
def exposed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.exposed_symbols(given_positions(spark, sf_dir), given_orders(spark, sf_dir))


@query(
    "exposure",
    f"""WITH {EXPOSED_SQL}
SELECT symbol, sum(p)::BIGINT AS n_positions, sum(o)::BIGINT AS n_orders FROM (
  SELECT symbol, 1 AS p, 0 AS o FROM held UNION ALL SELECT symbol, 0, 1 FROM live WHERE status IN ('PENDING', 'PARTIAL')) GROUP BY symbol""",
)
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.exposure(given_positions(spark, sf_dir), given_orders(spark, sf_dir))


@query(
    "order_admission",
    f"""WITH {EXPOSED_SQL},
s AS (SELECT o_orderkey::VARCHAR AS signal_id, 'C' || o_custkey AS symbol, o_totalprice AS p, o_totalprice * 0.98::DOUBLE AS r, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice * 0.01::DOUBLE END AS a,
    epoch(o_orderdate)::BIGINT AS ts FROM orders WHERE o_orderkey % 11 <> 0),
n AS (SELECT *, NOT (p > 0 AND r - a > 0 AND a > 0) AS invalid, CASE WHEN p > 0 AND r - a > 0 AND r - a < p THEN round(10000.0::DOUBLE * 0.002::DOUBLE / (p - (r - a)), 5) ELSE 0 END AS z
  FROM s WHERE signal_id NOT IN (SELECT signal_id FROM live)),
e AS (SELECT *, symbol IN (SELECT symbol FROM exposed) OR coalesce(max(NOT invalid AND z > 0) OVER (PARTITION BY symbol ORDER BY ts, signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS occupied FROM n),
v AS (SELECT *, CASE WHEN occupied THEN 'REJECTED_POSITION_OPEN' WHEN invalid THEN 'REJECTED_INVALID_DATA' WHEN z <= 0 THEN 'REJECTED_INVALID_SIZE' ELSE 'PENDING' END AS status FROM e)
SELECT 'ord_' || signal_id || CASE WHEN status = 'PENDING' THEN '' ELSE '_rej' END AS order_id, signal_id, symbol, CASE WHEN status = 'PENDING' THEN round((p * (1 + 0.005::DOUBLE))::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE ELSE p END AS price,
  CASE WHEN status = 'PENDING' THEN z ELSE 0 END AS size, status, {NOW}::BIGINT AS created_at, CASE WHEN status = 'PENDING' THEN 'ORDER_PENDING' ELSE status END AS signal_status FROM v""",
)
def order_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.admit(given_signals(spark, sf_dir), given_orders(spark, sf_dir), given_positions(spark, sf_dir), F.lit(NOW))
    return out.select("order_id", "signal_id", "symbol", "price", "size", "status", "created_at", "signal_status")


TARGET = 60.0


def target_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given orders with a constant size, pending but for those that are already partial or filled."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.lit(TARGET).alias("size"),
        F.when(F.col("o_orderstatus") == "P", 10.0).otherwise(0.0).alias("executed_size"),
        status_of().alias("status"),
        F.col("o_totalprice").alias("price"),
        F.unix_timestamp("o_orderdate").alias("created_at"),
    )


def line_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fills of their order; ids repeat where an order repeats a line number."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("seq"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("execution_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("double").alias("size"),
        F.col("l_tax").alias("fee"),
        F.unix_timestamp("l_shipdate").alias("ts"),
    )


FOLD_SQL = f"""o AS (SELECT o_orderkey, 'C' || o_custkey AS symbol, {TARGET}::DOUBLE AS target, CASE WHEN o_orderstatus = 'P' THEN 10.0 ELSE 0.0 END::DOUBLE AS done, {STATUS_SQL} AS status FROM orders),
f AS (SELECT l_orderkey, l_orderkey || '-' || l_linenumber AS execution_id, l_extendedprice / l_quantity AS price, l_quantity::DOUBLE AS size, l_tax AS fee, epoch(l_shipdate)::BIGINT AS ts,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem),
run AS (
  SELECT o_orderkey, symbol, target, 0::BIGINT AS k, done, status, []::VARCHAR[] AS seen, NULL::VARCHAR AS verdict FROM o
  UNION ALL
  SELECT o_orderkey, symbol, target, k, CASE WHEN verdict = 'accepted' THEN d ELSE done END, CASE WHEN verdict = 'accepted' THEN CASE WHEN d >= target * 0.9999 THEN 'FILLED' ELSE 'PARTIAL' END ELSE status END,
    CASE WHEN verdict = 'accepted' THEN list_append(seen, execution_id) ELSE seen END, verdict
  FROM (SELECT r.o_orderkey, r.symbol, r.target, f.k, r.done, r.status, r.seen, f.execution_id, r.done + f.size AS d,
      CASE WHEN r.status NOT IN ('PENDING', 'PARTIAL') THEN 'closed' WHEN r.done + f.size > r.target * 1.0001 THEN 'overfill' WHEN list_contains(r.seen, f.execution_id) THEN 'duplicate' ELSE 'accepted' END AS verdict
    FROM run AS r JOIN f ON f.l_orderkey = r.o_orderkey AND f.k = r.k + 1))"""


@query(
    "fill_ledger",
    f"""WITH RECURSIVE {FOLD_SQL}
SELECT run.o_orderkey::VARCHAR AS order_id, symbol, run.k AS place, execution_id, round(price, 8) AS price, size, fee, ts, verdict FROM run JOIN f ON f.l_orderkey = run.o_orderkey AND f.k = run.k""",
)
def fill_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.ledger(target_orders(spark, sf_dir), line_fills(spark, sf_dir)).withColumn("place", F.col("place").cast("long")), "price")


@query(
    "order_execution_status",
    f"WITH RECURSIVE {FOLD_SQL} SELECT o_orderkey::VARCHAR AS order_id, symbol, target AS size, arg_max(done, k) AS executed_size, arg_max(status, k) AS status FROM run GROUP BY ALL",
)
def order_execution_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.execution_status(target_orders(spark, sf_dir), line_fills(spark, sf_dir))


@query(
    "positions",
    f"""WITH RECURSIVE {FOLD_SQL},
a AS (SELECT run.o_orderkey::VARCHAR AS order_id, symbol, execution_id, price, size, ts, run.k FROM run JOIN f ON f.l_orderkey = run.o_orderkey AND f.k = run.k WHERE verdict = 'accepted'),
p AS (SELECT a.*, o_totalprice * 0.97::DOUBLE AS stop FROM a JOIN orders ON o_orderkey::VARCHAR = order_id)
SELECT symbol, min(ts) AS entry_ts, round(sum((price * size)::DECIMAL(38, 8))::DOUBLE / sum(size), 8) AS avg_entry, sum(size) AS current_size, round(arg_max(stop, (ts, order_id, k)), 8) AS stop_price, 'OPEN' AS state FROM p GROUP BY symbol""",
)
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = target_orders(spark, sf_dir)
    accepted = X.ledger(orders, line_fills(spark, sf_dir)).where("verdict = 'accepted'")
    out = X.positions(accepted, orders.select("order_id", (F.col("price") * 0.97).alias("stop_price")))
    return rounded(out.select("symbol", "entry_ts", "avg_entry", "current_size", "stop_price", "state"), "avg_entry", "stop_price")


@query(
    "executions",
    f"""WITH RECURSIVE {FOLD_SQL}
SELECT execution_id, arg_min(run.o_orderkey::VARCHAR, (ts, run.k)) AS order_id, round(arg_min(price, (ts, run.k)), 8) AS price, arg_min(size, (ts, run.k)) AS size, min(ts) AS ts
FROM run JOIN f ON f.l_orderkey = run.o_orderkey AND f.k = run.k WHERE verdict = 'accepted' GROUP BY execution_id""",
)
def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.executions(target_orders(spark, sf_dir), line_fills(spark, sf_dir)).select("execution_id", "order_id", "price", "size", "ts"), "price")


@query(
    "new_fills",
    """SELECT l_orderkey || '-' || l_linenumber AS execution_id, l_quantity::DOUBLE AS size FROM lineitem
WHERE l_orderkey || '-' || l_linenumber NOT IN (SELECT l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_returnflag = 'R')""",
)
def new_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills that aren't stored yet, those of returned lines being stored."""
    stored = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("execution_id"))
    return X.new_fills(line_fills(spark, sf_dir), stored).select("execution_id", "size")


@query(
    "open_remainders",
    f"""SELECT o_orderkey::VARCHAR AS order_id, 'fill_' || o_orderkey AS execution_id, o_totalprice AS price, {TARGET}::DOUBLE - CASE WHEN o_orderstatus = 'P' THEN 10 ELSE 0 END AS size, 0.0::DOUBLE AS fee
FROM orders WHERE o_orderstatus IN ('O', 'P')""",
)
def open_remainders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.open_remainders(target_orders(spark, sf_dir))


LIMIT = 20 * 86400


def tick_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    orders = o.select(
        key.alias("order_id"), F.concat(F.lit("s"), key).alias("signal_id"), F.lit(TARGET).alias("size"), F.lit(0.0).alias("executed_size"), status_of().alias("status"), F.col("o_totalprice").alias("price"),
        F.unix_timestamp("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("cb_"), key)).alias("exchange_order_id"),
        F.lit(None).cast("long").alias("submitted_at"), F.lit(None).cast("long").alias("updated_at"), F.lit(None).cast("string").alias("fail_reason"),
    )
    signals = o.where("o_orderkey % 9 <> 0").select(F.concat(F.lit("s"), key).alias("signal_id"))
    fills = line_fills(spark, sf_dir).withColumn("exchange_order_id", F.concat(F.lit("cb_"), "order_id")).drop("order_id")
    remote = o.where("o_orderkey % 5 <= 1").select(F.concat(F.lit("cb_"), key).alias("exchange_order_id"), F.when(F.col("o_orderkey") % 5 == 0, "CANCELLED").otherwise("OPEN").alias("remote_status"))
    return orders, signals, fills, remote


@query(
    "reconcile_tick",
    f"""WITH RECURSIVE o AS (SELECT o_orderkey, {TARGET}::DOUBLE AS target, 0.0::DOUBLE AS done, {STATUS_SQL} AS status, o_orderkey % 4 <> 0 AS has_id, epoch(o_orderdate)::BIGINT AS created FROM orders),
f AS (SELECT l_orderkey, l_orderkey || '-' || l_linenumber AS execution_id, l_quantity::DOUBLE AS size,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem),
run AS (
  SELECT o_orderkey, target, 0::BIGINT AS k, done, status, []::VARCHAR[] AS seen FROM o WHERE status = 'PENDING' AND has_id
  UNION ALL
  SELECT o_orderkey, target, k, CASE WHEN ok THEN d ELSE done END, CASE WHEN ok THEN CASE WHEN d >= target * 0.9999 THEN 'FILLED' ELSE 'PARTIAL' END ELSE status END, CASE WHEN ok THEN list_append(seen, execution_id) ELSE seen END
  FROM (SELECT r.*, f.k AS k2, f.execution_id, r.done + f.size AS d, r.status IN ('PENDING', 'PARTIAL') AND r.done + f.size <= r.target * 1.0001 AND NOT list_contains(r.seen, f.execution_id) AS ok
    FROM run AS r JOIN f ON f.l_orderkey = r.o_orderkey AND f.k = r.k + 1 WHERE r.o_orderkey % 9 <> 0) AS x(o_orderkey, target, k0, done, status, seen, k, execution_id, d, ok)),
e AS (SELECT o_orderkey, arg_max(done, k) AS done, arg_max(status, k) AS status FROM run GROUP BY o_orderkey),
c AS (SELECT o.*, e.done AS new_done, e.status AS new_status, CASE WHEN o.status <> 'PENDING' THEN 'rest' WHEN NOT has_id THEN 'submitted' WHEN e.status <> 'PENDING' THEN 'filled'
    WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN {NOW} - created >= {LIMIT} THEN 'expired' ELSE 'waiting' END AS cs FROM o LEFT JOIN e USING (o_orderkey))
SELECT o_orderkey::VARCHAR AS order_id, CASE cs WHEN 'filled' THEN new_status WHEN 'failed' THEN 'FAILED' WHEN 'expired' THEN 'EXPIRED' ELSE status END AS status,
  CASE cs WHEN 'filled' THEN new_done ELSE done END AS executed_size, CASE WHEN has_id OR cs = 'submitted' THEN 'cb_' || o_orderkey END AS exchange_order_id,
  CASE WHEN cs = 'submitted' THEN {NOW}::BIGINT END AS submitted_at, CASE WHEN cs IN ('submitted', 'expired') THEN {NOW}::BIGINT END AS updated_at, CASE WHEN cs = 'expired' THEN 'TIMEOUT' END AS fail_reason,
  CASE cs WHEN 'filled' THEN CASE WHEN new_status = 'FILLED' THEN 'ORDER_FILLED' END WHEN 'failed' THEN 'FAILED_EXCHANGE' WHEN 'expired' THEN 'FAILED_TIMEOUT' END AS signal_status FROM c""",
)
def reconcile_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, signals, fills, remote = tick_inputs(spark, sf_dir)
    out = C.tick(orders, signals, F.lit(NOW), fills, remote, limit=LIMIT)
    return out.select("order_id", "status", "executed_size", "exchange_order_id", "submitted_at", "updated_at", "fail_reason", "signal_status")


@query(
    "pending_timeouts",
    f"SELECT o_orderkey::VARCHAR AS order_id, {NOW} - epoch(o_orderdate)::BIGINT AS age FROM orders WHERE {STATUS_SQL} = 'PENDING' AND {NOW} - epoch(o_orderdate) >= {LIMIT}",
)
def pending_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.timeouts(target_orders(spark, sf_dir), F.lit(NOW), LIMIT).select("order_id", "age")


@query(
    "merge_first_last",
    """SELECT l_orderkey, l_linenumber, arg_min(l_partkey, s) AS l_partkey, arg_max(l_quantity, s) AS l_quantity, arg_max(l_extendedprice, s) AS l_extendedprice FROM (
  SELECT *, (l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS s FROM lineitem) GROUP BY ALL""",
)
def merge_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of an order as a changelog: the part stays, quantity and price are replaced."""
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    return M.merge_latest(rows, ["l_orderkey", "l_linenumber"], first=["l_partkey"], last=["l_quantity", "l_extendedprice"])


@query(
    "first_executions",
    """SELECT l_orderkey || '-' || l_linenumber AS execution_id, arg_min(l_quantity::DOUBLE, s) AS size, arg_min(l_tax, s) AS fee FROM (
  SELECT *, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS s FROM lineitem) GROUP BY ALL""",
)
def first_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each execution id; repeated ids are refused."""
    return M.first_rows(line_fills(spark, sf_dir).select("execution_id", "size", "fee", "seq"), ["execution_id"]).drop("seq")


@query(
    "partial_updates",
    """SELECT user_id, arg_max(CASE WHEN event_type = 'click' THEN value END, event_id) FILTER (event_type = 'click') AS clicked,
  arg_max(value, event_id) FILTER (event_type = 'purchase') AS bought, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id""",
)
def partial_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that each update one column of their user."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", F.col("value")).alias("clicked"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("bought"), F.col("event_type").alias("last_type")
    )
    return M.merge_latest(rows, ["user_id"], last=["last_type"], patch=["clicked", "bought"])


@query("latest_state", "SELECT user_id::VARCHAR AS key, arg_max(props, event_id) AS value FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and value state: the last document of each key."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    return M.merged(rows, "runtime_state")


def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as changes of their order, in order of ship date and then of all their columns."""
    return table(spark, sf_dir, "lineitem").withColumn("seq", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of orders with all columns of the table."""
    return line_changes(spark, sf_dir).select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.concat(F.lit("s"), F.col("l_partkey")).alias("signal_id"), F.concat(F.lit("C"), F.col("l_suppkey")).alias("symbol"), F.col("l_returnflag").alias("side"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("size"), F.unix_timestamp("l_shipdate").alias("created_at"), F.col("l_linestatus").alias("status"), F.col("l_discount").alias("executed_size"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("cb_"), F.col("l_partkey"))).alias("exchange_order_id"), F.unix_timestamp("l_shipdate").alias("submitted_at"),
        F.when(F.col("l_linenumber") % 3 == 0, F.unix_timestamp("l_shipdate")).alias("updated_at"), F.lit(None).cast("string").alias("fail_reason"), "seq",
    )


CHANGES_SQL = """c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS k,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
a AS (SELECT * FROM c WHERE k = 1), z AS (SELECT * FROM c WHERE k = n)"""


@query(
    "merged_orders",
    f"""WITH {CHANGES_SQL}
SELECT a.l_orderkey::VARCHAR AS order_id, 's' || a.l_partkey AS signal_id, 'C' || a.l_suppkey AS symbol, a.l_returnflag AS side, a.l_extendedprice AS price, a.l_quantity AS size, epoch(a.l_shipdate)::BIGINT AS created_at,
  z.l_linestatus AS status, z.l_discount AS executed_size, CASE WHEN z.l_linenumber % 2 = 0 THEN 'cb_' || z.l_partkey END AS exchange_order_id, epoch(z.l_shipdate)::BIGINT AS submitted_at,
  CASE WHEN z.l_linenumber % 3 = 0 THEN epoch(z.l_shipdate)::BIGINT END AS updated_at, NULL::VARCHAR AS fail_reason FROM a JOIN z USING (l_orderkey)""",
)
def merged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders keep what they were made with and take the last status, nulls too."""
    return M.merged(order_changes(spark, sf_dir), "orders")


@query(
    "merged_legacy_orders",
    f"""WITH {CHANGES_SQL}
SELECT a.l_orderkey::VARCHAR AS order_id, 's' || a.l_partkey AS signal_id, 'C' || a.l_suppkey AS symbol, a.l_returnflag AS side, a.l_extendedprice AS price, a.l_quantity AS size,
  CASE WHEN z.l_linenumber % 2 = 0 THEN 'cb_' || z.l_partkey END AS exchange_order_id, z.l_linestatus AS status FROM a JOIN z USING (l_orderkey)""",
)
def merged_legacy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the older table, whose upserts replace the exchange id and the status only."""
    rows = line_changes(spark, sf_dir).select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.concat(F.lit("s"), F.col("l_partkey")).alias("signal_id"), F.concat(F.lit("C"), F.col("l_suppkey")).alias("symbol"), F.col("l_returnflag").alias("side"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("size"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("cb_"), F.col("l_partkey"))).alias("exchange_order_id"), F.col("l_linestatus").alias("status"), "seq",
    )
    return M.merged(rows, "legacy_orders")


@query(
    "merged_signals",
    f"""WITH {CHANGES_SQL}
SELECT 's' || a.l_orderkey AS signal_id, 'C' || a.l_suppkey AS symbol, 'LONG' AS signal_type, a.l_returnflag AS regime_snapshot, a.l_extendedprice AS breakout_level, a.l_extendedprice * 0.98::DOUBLE AS retest_level,
  a.l_tax AS atr, a.l_discount AS rsi, a.l_quantity AS execution_price, z.l_linestatus AS status FROM a JOIN z USING (l_orderkey)""",
)
def merged_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that are told again keep their first row but for the status."""
    rows = line_changes(spark, sf_dir).select(
        F.concat(F.lit("s"), F.col("l_orderkey")).alias("signal_id"), F.concat(F.lit("C"), F.col("l_suppkey")).alias("symbol"), F.lit("LONG").alias("signal_type"), F.col("l_returnflag").alias("regime_snapshot"),
        F.col("l_extendedprice").alias("breakout_level"), (F.col("l_extendedprice") * 0.98).alias("retest_level"), F.col("l_tax").alias("atr"), F.col("l_discount").alias("rsi"), F.col("l_quantity").alias("execution_price"),
        F.col("l_linestatus").alias("status"), "seq",
    )
    return M.merged(rows, "signals")


@query(
    "merged_positions",
    f"""WITH {CHANGES_SQL.replace('PARTITION BY l_orderkey', 'PARTITION BY l_suppkey').replace('l_shipdate, l_linenumber', 'l_shipdate, l_orderkey, l_linenumber')}
SELECT 'C' || l_suppkey AS symbol, epoch(l_shipdate)::BIGINT AS entry_ts, l_extendedprice AS avg_entry, l_quantity AS current_size, 0.0::DOUBLE AS realized_pnl, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS unrealized_pnl,
  l_discount AS stop_price, l_linestatus AS state, l_returnflag = 'R' AS stop_active FROM z""",
)
def merged_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions are replaced whole by their last row, nulls too."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("C"), F.col("l_suppkey")).alias("symbol"), F.unix_timestamp("l_shipdate").alias("entry_ts"), F.col("l_extendedprice").alias("avg_entry"), F.col("l_quantity").alias("current_size"), F.lit(0.0).alias("realized_pnl"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).alias("unrealized_pnl"), F.col("l_discount").alias("stop_price"), F.col("l_linestatus").alias("state"), (F.col("l_returnflag") == "R").alias("stop_active"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("seq"),
    )
    return M.merged(rows, "positions")


@query(
    "merged_executions",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS k FROM lineitem)
SELECT l_orderkey || '-' || l_linenumber AS execution_id, l_partkey::VARCHAR AS order_id, l_extendedprice AS price, l_quantity AS size, l_tax AS fee, epoch(l_shipdate)::BIGINT AS ts FROM c WHERE k = 1""",
)
def merged_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions never change: an id that comes again is ignored."""
    rows = line_changes(spark, sf_dir).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("execution_id"), F.col("l_partkey").cast("string").alias("order_id"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("size"), F.col("l_tax").alias("fee"),
        F.unix_timestamp("l_shipdate").alias("ts"), "seq",
    )
    return M.merged(rows, "executions")
