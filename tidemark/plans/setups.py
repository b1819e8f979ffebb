"""Queries over setups, by stages and whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import chains
from tidemark.operators import setups as S
from tidemark.plans import market
from tidemark.plans.market import rounded
from tidemark.sources import tapes as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FRAMES = {"1d": 86400, "12d": 1036800}
#: Days and twelve days, with limits that noise passes often enough to exercise each stage.
RELAXED = S.SetupParams(
    signal="1d", regime="12d", signal_sec=86400, regime_sec=1036800, signal_window=30, regime_window=60, least_signal=25, least_regime=35, fast=10, slow=30, least_range=0.0,
    lookback=2, volume_factor=0.1, least_position=0.1, rsi_low=1.0, rsi_high=99.0, zone_below=10.0, zone_above=10.0, chase=3.0, stop_at_gaps=False,
)
P = RELAXED

def stages_sql(tape: str, P: S.SetupParams) -> str:
    """CTEs from a tape to the outcomes of candidates (oc), in the detector's parameters."""
    return f"""{market.bars_sql(tape, {P.signal: P.signal_sec, P.regime: P.regime_sec})}, {market.regime_sql(P.regime_window, P.fast, P.slow, P.least_range)},
x AS (SELECT *, count(*) OVER w AS n_seen, max(high) OVER b AS prior_high, sum(volume) OVER b / {P.lookback} AS prior_volume,
    list(true_range) OVER h AS wt, list(gain) OVER h AS wg, list(loss) OVER h AS wl
  FROM ch2 WHERE timeframe = '{P.signal}'
  WINDOW w AS (PARTITION BY symbol ORDER BY ts_open ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY symbol ORDER BY ts_open ROWS BETWEEN {P.lookback} PRECEDING AND 1 PRECEDING),
    h AS (PARTITION BY symbol ORDER BY ts_open ROWS {P.signal_window - 1} PRECEDING)),
y AS (SELECT *, {market.wilder_sql('wt', 14)} AS atr, {market.wilder_sql('wg', 14)} AS ag, {market.wilder_sql('wl', 14)} AS al FROM x),
z AS (SELECT *, CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi, later - later % {P.regime_sec} AS visible FROM y),
rg AS (SELECT symbol, ts_open AS regime_ts, n_window AS n_regime, bullish FROM regime WHERE timeframe = '{P.regime}'),
sb AS (SELECT z.* EXCLUDE (wt, wg, wl), rg.regime_ts, rg.n_regime, rg.bullish, row_number() OVER (PARTITION BY z.symbol ORDER BY z.ts_open) AS idx
  FROM z ASOF JOIN rg ON z.symbol = rg.symbol AND rg.regime_ts < z.visible WHERE n_seen >= {P.least_signal} AND n_regime >= {P.least_regime}),
nb AS (SELECT *, min(CASE WHEN NOT bullish THEN idx END) OVER (PARTITION BY symbol ORDER BY ts_open ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS bear FROM sb),
bo AS (SELECT symbol, idx, ts_open, prior_high AS level, (high + low) / 2 AS midpoint, bear FROM nb
  WHERE bullish AND close > prior_high AND volume > {P.volume_factor} * prior_volume AND high > low AND (close - low) / (high - low) >= {P.least_position} AND rsi BETWEEN {P.rsi_low} AND {P.rsi_high}),
rt AS (SELECT bo.symbol, bo.idx, min(sb.idx) AS r FROM bo JOIN sb ON bo.symbol = sb.symbol AND sb.idx BETWEEN bo.idx + 1 AND bo.idx + {P.retest_bars}
  WHERE (bear IS NULL OR sb.idx < bear) AND sb.low BETWEEN level - {P.zone_below} * atr AND level + {P.zone_above} * atr AND sb.close > level AND sb.close > midpoint GROUP BY ALL),
r2 AS (SELECT bo.*, rt.r, sb.low AS r_low, sb.high AS r_high FROM bo LEFT JOIN rt USING (symbol, idx) LEFT JOIN sb ON sb.symbol = bo.symbol AND sb.idx = rt.r),
ct AS (SELECT r2.symbol, r2.idx, min(sb.idx) AS c FROM r2 JOIN sb ON sb.symbol = r2.symbol AND sb.idx > r2.r AND (bear IS NULL OR sb.idx < bear) WHERE sb.close > r_high GROUP BY ALL),
c2 AS (SELECT r2.*, ct.c, sb.close AS c_close, sb.atr AS c_atr, sb.rsi AS c_rsi, sb.ts_open AS c_ts FROM r2 LEFT JOIN ct USING (symbol, idx) LEFT JOIN sb ON sb.symbol = r2.symbol AND sb.idx = ct.c),
oc AS (SELECT *, CASE WHEN r IS NULL THEN CASE WHEN bear <= idx + {P.retest_bars + 1} THEN 'bearish' ELSE 'expired' END
    WHEN c IS NOT NULL THEN CASE WHEN c_close - level > {P.chase} * c_atr THEN 'chased' ELSE 'signal' END WHEN bear IS NOT NULL THEN 'bearish' ELSE 'waiting' END AS outcome,
  CASE WHEN r IS NULL THEN least(bear, idx + {P.retest_bars + 1}) + 1 WHEN c IS NOT NULL THEN c + 1 ELSE bear + 1 END AS release FROM c2)"""


STAGES = stages_sql(T.TAPE_LINE_SQL, P)


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that the detector would process; they and the bars of the tape, which they look at by timeframe, are written once."""
    made = B.bars(T.tape_line(spark, sf_dir), FRAMES, keep_later=True)
    for name, step in (("tape-bars", lambda x: x), ("setup-bars", lambda x: S.setup_bars(x, P))):
        made, path = step(made), T.scratch(spark, name)
        made.write.parquet(path)
        made = spark.read.schema(made.schema).parquet(path)
    return made


@query("breakouts", f"WITH {STAGES} SELECT symbol, idx, ts_open, round(level, 8) AS level, round(midpoint, 8) AS midpoint, bear FROM bo")
def breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.breakouts(bars(spark, sf_dir), P).select("symbol", F.col("idx").cast("long").alias("idx"), "ts_open", "level", "midpoint", F.col("bear").cast("long").alias("bear"))
    return rounded(out, "level", "midpoint")


@query("retests", f"WITH {STAGES} SELECT symbol, idx, r, round(r_low, 8) AS r_low, round(r_high, 8) AS r_high FROM r2")
def retests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.retests(S.breakouts(bars(spark, sf_dir), P), P)
    out = out.select("symbol", F.col("idx").cast("long").alias("idx"), F.col("retest.idx").cast("long").alias("r"), F.col("retest.low").alias("r_low"), F.col("retest.high").alias("r_high"))
    return rounded(out, "r_low", "r_high")


@query("continuations", f"WITH {STAGES} SELECT symbol, idx, r, c, round(c_close, 8) AS c_close FROM c2 WHERE r IS NOT NULL")
def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bars(spark, sf_dir)
    out = S.continuations(S.retests(S.breakouts(made, P), P), made).where("retest IS NOT NULL")
    out = out.select("symbol", F.col("idx").cast("long").alias("idx"), F.col("retest.idx").cast("long").alias("r"), F.col("next_bar.idx").cast("long").alias("c"), F.col("next_bar.close").alias("c_close"))
    return rounded(out, "c_close")


@query("setup_outcomes", f"WITH {STAGES} SELECT symbol, idx, outcome, release FROM oc")
def setup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.outcomes(bars(spark, sf_dir), P).select("symbol", F.col("idx").cast("long").alias("idx"), "outcome", F.col("release").cast("long").alias("release"))


CHAIN_STEP = """ch3 AS (
  SELECT symbol, min(idx) AS idx FROM oc GROUP BY symbol
  UNION ALL
  SELECT n.symbol, n.idx FROM (
    SELECT o.symbol, o.idx, row_number() OVER (PARTITION BY o.symbol ORDER BY o.idx) AS k
    FROM ch3 JOIN oc AS t ON t.symbol = ch3.symbol AND t.idx = ch3.idx JOIN oc AS o ON o.symbol = ch3.symbol AND o.idx >= t.release) AS n WHERE n.k = 1)"""
CHAIN = f"WITH RECURSIVE {STAGES},\n{CHAIN_STEP}"


@query(
    "signals",
    f"""{CHAIN}
SELECT sha256(oc.symbol || '|' || oc.ts_open::VARCHAR) AS signal_id, oc.symbol, 'LONG' AS signal_type, round(level, 8) AS breakout_level, round(r_low, 8) AS retest_level, round(c_atr, 6) AS atr,
  round(c_rsi, 6) AS rsi, 'NEW' AS status, round(c_close, 8) AS execution_price, c_ts AS signal_ts
FROM oc JOIN ch3 USING (symbol, idx) WHERE outcome = 'signal'""",
)
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.signals(bars(spark, sf_dir), P).drop("snapshot", "regime_snapshot")
    return rounded(rounded(out, "breakout_level", "retest_level", "execution_price"), "atr", "rsi", places=6)


@query(
    "signal_snapshots",
    f"""{CHAIN}
SELECT sha256(oc.symbol || '|' || oc.ts_open::VARCHAR) AS signal_id, round(c_atr, 6) AS atr, round(level, 6) AS level FROM oc JOIN ch3 USING (symbol, idx) WHERE outcome = 'signal'""",
)
def signal_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the snapshots of signals say, read back from their text."""
    number = r"(-?[0-9.]+(?:E-?[0-9]+)?)"
    said = lambda name: F.regexp_extract("regime_snapshot", f"{name}:{number}", 1).cast("double")
    out = S.signals(bars(spark, sf_dir), P).select("signal_id", said("ATR").alias("atr"), said("_LEVEL").alias("level"))
    return rounded(out, "atr", "level", places=6)


@query(
    "chained_orders",
    """WITH RECURSIVE c AS (SELECT o_orderpriority AS k, epoch(o_orderdate)::BIGINT // 86400 * 1000000000 + o_orderkey AS place, o_custkey % 30 AS days FROM orders),
t AS (
  SELECT k, min(place) AS place FROM c GROUP BY k
  UNION ALL
  SELECT k, place FROM (SELECT n.k, n.place, row_number() OVER (PARTITION BY n.k ORDER BY n.place) AS i FROM t JOIN c AS h ON h.k = t.k AND h.place = t.place JOIN c AS n ON n.k = t.k AND n.place >= h.place + (1 + h.days) * 1000000000) AS x WHERE i = 1)
SELECT k, place FROM t""",
)
def chained_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders taken one after the other in few long chains: each keeps its priority busy for some days."""
    at = F.floor(F.unix_timestamp("o_orderdate") / 86400) * 1_000_000_000 + F.col("o_orderkey")
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), at.cast("long").alias("place"), F.col("o_custkey"))
    rows = rows.withColumn("release", F.col("place") + (1 + F.col("o_custkey") % 30) * 1_000_000_000)
    return chains.long_chain(rows, "k", "place", "release").select("k", "place")
