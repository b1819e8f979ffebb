"""Queries over bars, indicators and setups, each with the SQL of its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import indicators as I
from tidemark.operators.asof import as_of
from tidemark.sources import store
from tidemark.sources import tapes as T

DAYS = {"1d": 86400, "4d": 345600}
HOURS = {"1h": 3600, "2h": 7200}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query with its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, places: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def bars_sql(tape: str, frames: dict[str, int], name: str = "bars") -> str:
    """CTEs that end in completed bars."""
    values = ", ".join(f"('{k}', {v})" for k, v in frames.items())
    return f"""tape AS ({tape}),
tf(timeframe, step) AS (VALUES {values}),
bucketed AS (SELECT symbol, timeframe, price, size, seq, (floor(sec)::BIGINT - floor(sec)::BIGINT % step) AS b FROM tape, tf),
placed AS (SELECT *, max(b) OVER (PARTITION BY symbol, timeframe ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ts_open FROM bucketed),
made AS (SELECT symbol, timeframe, ts_open, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(size) AS volume FROM placed GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, lead(ts_open) OVER (PARTITION BY symbol, timeframe ORDER BY ts_open) AS later FROM made) WHERE later IS NOT NULL)"""


BAR_COLUMNS = ("open", "high", "low", "close", "volume")
BARS_OUT = "symbol, timeframe, ts_open, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume"
S = "PARTITION BY symbol, timeframe ORDER BY ts_open"


@query("bars_ohlcv", f"WITH {bars_sql(T.TAPE_TYPE_SQL, {'1h': 3600})} SELECT {BARS_OUT} FROM bars")
def bars_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.bars(T.tape_type(spark, sf_dir), {"1h": 3600}), *BAR_COLUMNS)


@query("bars_multi_timeframe", f"WITH {bars_sql(T.TAPE_TYPE_SQL, B.TIMEFRAMES)} SELECT {BARS_OUT} FROM bars")
def bars_multi_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.bars(T.tape_type(spark, sf_dir)), *BAR_COLUMNS)


@query(
    "bars_late_merge",
    f"WITH {bars_sql(T.TAPE_ALL_SQL.replace('event_id AS seq', 'xor(event_id, 7) AS seq'), {'1m': 60, '1h': 3600})} SELECT {BARS_OUT} FROM bars",
)
def bars_late_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a tape whose trades arrive out of order, so late ones join the bar that is current."""
    seq = F.col("event_id").bitwiseXOR(F.lit(7))
    return rounded(B.bars(T.events_tape(spark, sf_dir, F.lit("ALL"), seq), {"1m": 60, "1h": 3600}), *BAR_COLUMNS)


@query(
    "bars_event_time",
    f"""WITH t AS ({T.TAPE_TYPE_SQL}), b AS (SELECT *, floor(sec)::BIGINT - floor(sec)::BIGINT % 3600 AS ts_open FROM t)
SELECT symbol, '1h' AS timeframe, ts_open, round(arg_min(price, seq), 8) AS open, round(max(price), 8) AS high, round(min(price), 8) AS low,
  round(arg_max(price, seq), 8) AS close, round(sum(size), 8) AS volume FROM b GROUP BY symbol, ts_open""",
)
def bars_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.event_time_bars(T.tape_type(spark, sf_dir), {"1h": 3600}), *BAR_COLUMNS)


@query(
    "last_n_bars",
    f"""WITH {bars_sql(T.TAPE_USER_SQL, {'1h': 3600, '4h': 14400})},
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts_open DESC) AS back FROM bars)
SELECT {BARS_OUT}, row_number() OVER ({S}) AS place FROM r WHERE back <= 5""",
)
def last_n_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.last_bars(B.bars(T.tape_user(spark, sf_dir), {"1h": 3600, "4h": 14400}), 5), *BAR_COLUMNS)


@query("bar_counts", f"WITH {bars_sql(T.TAPE_USER_SQL, {'1h': 3600, '4h': 14400})} SELECT symbol, timeframe, count(*) AS n_bars FROM bars GROUP BY ALL")
def bar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bar_counts(B.bars(T.tape_user(spark, sf_dir), {"1h": 3600, "4h": 14400}))


@query(
    "bar_readiness",
    f"""WITH {bars_sql(T.TAPE_TYPE_SQL, HOURS)}
SELECT symbol, timeframe, ts_open, count(*) OVER ({S} ROWS UNBOUNDED PRECEDING) AS n_seen,
  count(*) OVER ({S} ROWS UNBOUNDED PRECEDING) >= CASE timeframe WHEN '1h' THEN 25 ELSE 205 END AS ready FROM bars""",
)
def bar_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = B.bars(T.tape_type(spark, sf_dir), HOURS)
    return B.readiness(made, {"1h": 25, "2h": 205}).select("symbol", "timeframe", "ts_open", "n_seen", "ready")


@query(
    "bar_gaps",
    f"""WITH {bars_sql(T.TAPE_TYPE_SQL, {'1h': 3600})},
g AS (SELECT symbol, timeframe, ts_open, ts_open - lag(ts_open) OVER ({S}) AS step FROM bars)
SELECT *, coalesce(step > 3600, false) AS gap, max(coalesce(step > 3600, false)) OVER ({S} ROWS UNBOUNDED PRECEDING) AS disabled FROM g""",
)
def bar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.gaps(B.bars(T.tape_type(spark, sf_dir), {"1h": 3600})).select("symbol", "timeframe", "ts_open", "step", "gap", "disabled")


@query(
    "replay_guard",
    f"""WITH {bars_sql(T.TAPE_TYPE_SQL, {'1h': 3600})},
f AS (SELECT symbol, timeframe, ts_open, close, xor(ts_open // 3600, 5) AS seq FROM bars),
m AS (SELECT *, max(ts_open) OVER (PARTITION BY symbol, timeframe ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM f)
SELECT symbol, timeframe, ts_open, round(close, 8) AS close, seq FROM m WHERE top IS NULL OR ts_open > top""",
)
def replay_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of bars out of order: repeated and older bars are ignored."""
    feed = B.bars(T.tape_type(spark, sf_dir), {"1h": 3600}).withColumn("seq", F.floor(F.col("ts_open") / 3600).bitwiseXOR(F.lit(5).cast("long")))
    return rounded(B.fresh_bars(feed).select("symbol", "timeframe", "ts_open", "close", "seq"), "close")


LINE_BARS = bars_sql(T.TAPE_LINE_SQL, DAYS)


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars(T.tape_line(spark, sf_dir), DAYS)


@query(
    "prior_high_volume",
    f"""WITH {LINE_BARS}
SELECT symbol, timeframe, ts_open, count(*) OVER w AS n_before, round(max(high) OVER w, 8) AS prior_high, round(sum(volume) OVER w / 20, 8) AS prior_volume
FROM bars WINDOW w AS ({S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
)
def prior_high_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.with_range_history(line_bars(spark, sf_dir))
    return rounded(out.select("symbol", "timeframe", "ts_open", "n_before", "prior_high", "prior_volume"), "prior_high", "prior_volume")


@query(
    "candle_position",
    f"""WITH {LINE_BARS}
SELECT symbol, timeframe, ts_open, round(CASE WHEN high > low THEN (close - low) / (high - low) END, 8) AS position,
  coalesce(high > low AND (close - low) / (high - low) >= 0.7, false) AS strong, round((high + low) / 2, 8) AS midpoint FROM bars""",
)
def candle_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = I.close_position()
    out = line_bars(spark, sf_dir).select("symbol", "timeframe", "ts_open", at.alias("position"), F.coalesce(at >= 0.7, F.lit(False)).alias("strong"), ((F.col("high") + F.col("low")) / 2).alias("midpoint"))
    return rounded(out, "position", "midpoint")


CHANGES = f"""ch AS (
  SELECT *, coalesce(greatest(high - low, abs(high - p), abs(low - p)), 0) AS true_range, coalesce(greatest(close - p, 0), 0) AS gain, coalesce(greatest(p - close, 0), 0) AS loss
  FROM (SELECT *, lag(close) OVER ({S}) AS p FROM bars)),
ch2 AS (SELECT * REPLACE (CASE WHEN p IS NULL THEN 0 ELSE true_range END AS true_range) FROM ch)"""


@query(
    "true_range",
    f"WITH {LINE_BARS}, {CHANGES} SELECT symbol, timeframe, ts_open, round(true_range, 8) AS true_range, round(gain, 8) AS gain, round(loss, 8) AS loss FROM ch2",
)
def true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.with_changes(line_bars(spark, sf_dir)).select("symbol", "timeframe", "ts_open", "true_range", "gain", "loss"), "true_range", "gain", "loss")


def ema_sql(array: str, period: int) -> str:
    rate = f"(2.0::DOUBLE / {period + 1})"
    seed = f"(list_reduce({array}[1:{period}], lambda a, x: a + x) / {period})"
    return f"CASE WHEN len({array}) >= {period} THEN list_reduce(list_concat([{seed}], {array}[{period + 1}:]), lambda a, x: (x - a) * {rate} + a) END"


def wilder_sql(array: str, period: int) -> str:
    seed = f"(list_reduce({array}[2:{period + 1}], lambda a, x: a + x) / {period})"
    return f"CASE WHEN len({array}) > {period} THEN list_reduce(list_concat([{seed}], {array}[{period + 2}:]), lambda a, x: (a * {period - 1} + x) / {period}) END"


def frame_sql(n: int) -> str:
    return f"({S} ROWS {n - 1} PRECEDING)"


@query(
    "ema50",
    f"WITH {LINE_BARS}, a AS (SELECT *, list(close) OVER {frame_sql(210)} AS w FROM bars) SELECT symbol, timeframe, ts_open, round({ema_sql('w', 50)}, 6) AS ema FROM a",
)
def ema50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.with_ema(line_bars(spark, sf_dir), 50, 210, "ema").select("symbol", "timeframe", "ts_open", "ema"), "ema", places=6)


@query(
    "atr14",
    f"WITH {LINE_BARS}, {CHANGES}, a AS (SELECT *, list(true_range) OVER {frame_sql(30)} AS w FROM ch2) SELECT symbol, timeframe, ts_open, round({wilder_sql('w', 14)}, 6) AS atr FROM a",
)
def atr14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.with_atr(line_bars(spark, sf_dir), 14, 30).select("symbol", "timeframe", "ts_open", "atr"), "atr", places=6)


@query(
    "rsi14",
    f"""WITH {LINE_BARS}, {CHANGES}, a AS (SELECT *, list(gain) OVER {frame_sql(30)} AS g, list(loss) OVER {frame_sql(30)} AS l FROM ch2),
r AS (SELECT *, {wilder_sql('g', 14)} AS ag, {wilder_sql('l', 14)} AS al FROM a)
SELECT symbol, timeframe, ts_open, round(CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END, 6) AS rsi FROM r""",
)
def rsi14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.with_rsi(line_bars(spark, sf_dir), 14, 30).select("symbol", "timeframe", "ts_open", "rsi"), "rsi", places=6)


def regime_sql(bars: int = 210, fast: int = 50, slow: int = 200, least: float = 0.005) -> str:
    return f"""{CHANGES},
wa AS (SELECT *, list(close) OVER {frame_sql(bars)} AS w, list(true_range) OVER {frame_sql(bars)} AS t FROM ch2),
wb AS (SELECT * EXCLUDE (w, t, p), len(w) AS n_window, {ema_sql('w', fast)} AS ema_fast, {ema_sql('w', slow)} AS ema_slow, {ema_sql('w[1:len(w) - 1]', slow)} AS ema_slow_before,
  {wilder_sql('t', 14)} AS regime_atr FROM wa),
regime AS (SELECT *, coalesce(close > ema_slow AND ema_fast > ema_slow AND ema_slow > ema_slow_before AND regime_atr / close > {least} AND n_window > {slow}, false) AS bullish FROM wb)"""


REGIME = regime_sql()


@query(
    "regime",
    f"""WITH {LINE_BARS}, {REGIME}
SELECT symbol, timeframe, ts_open, n_window, round(ema_fast, 6) AS ema_fast, round(ema_slow, 6) AS ema_slow, round(ema_slow_before, 6) AS ema_slow_before,
  round(regime_atr, 6) AS regime_atr, bullish FROM regime""",
)
def regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.with_regime(line_bars(spark, sf_dir)).select("symbol", "timeframe", "ts_open", "n_window", "ema_fast", "ema_slow", "ema_slow_before", "regime_atr", "bullish")
    return rounded(out.withColumn("n_window", F.col("n_window").cast("long")), "ema_fast", "ema_slow", "ema_slow_before", "regime_atr", places=6)


@query(
    "ema200_slope",
    f"""WITH {bars_sql(T.TAPE_ALL_SQL, HOURS)}, {REGIME}
SELECT symbol, timeframe, ts_open, round(ema_slow - ema_slow_before, 6) AS slope FROM regime WHERE n_window > 200""",
)
def ema200_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.with_regime(B.bars(T.tape_all(spark, sf_dir), HOURS)).where("n_window > 200")
    return rounded(out.select("symbol", "timeframe", "ts_open", (F.col("ema_slow") - F.col("ema_slow_before")).alias("slope")), "slope", places=6)


@query(
    "ema_series",
    f"""WITH RECURSIVE {bars_sql(T.TAPE_LINE_SQL, {'4d': 345600})},
n AS (SELECT symbol, timeframe, ts_open, close, row_number() OVER ({S}) AS i FROM bars),
seed AS (SELECT symbol, timeframe, avg(close) AS e FROM n WHERE i <= 20 GROUP BY ALL HAVING count(*) = 20),
run AS (
  SELECT symbol, timeframe, 20::BIGINT AS i, e FROM seed
  UNION ALL SELECT n.symbol, n.timeframe, n.i, (n.close - run.e) * (2.0::DOUBLE / 21) + run.e FROM run JOIN n ON n.symbol = run.symbol AND n.timeframe = run.timeframe AND n.i = run.i + 1)
SELECT n.symbol, n.timeframe, n.ts_open, round(n.close, 6) AS close, round(run.e, 6) AS ema FROM n LEFT JOIN run ON n.symbol = run.symbol AND n.timeframe = run.timeframe AND n.i = run.i""",
)
def ema_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means at every bar of whole series, from one seed."""
    return rounded(I.ema_series(B.bars(T.tape_line(spark, sf_dir), {"4d": 345600}), 20), "close", "ema", places=6)


@query(
    "regime_asof",
    f"""WITH {LINE_BARS}, {REGIME},
s AS (SELECT symbol, ts_open, close, lead(ts_open) OVER (PARTITION BY symbol ORDER BY ts_open) AS following FROM bars WHERE timeframe = '1d'),
c AS (SELECT *, following - following % 345600 AS visible FROM s WHERE following IS NOT NULL),
r AS (SELECT symbol, ts_open AS regime_ts, bullish, ema_slow FROM regime WHERE timeframe = '4d')
SELECT c.symbol, c.ts_open, r.regime_ts, r.bullish, round(r.ema_slow, 6) AS ema_slow FROM c ASOF LEFT JOIN r ON c.symbol = r.symbol AND r.regime_ts < c.visible""",
)
def regime_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each daily bar with the latest regime bar that is closed when it closes."""
    made = line_bars(spark, sf_dir)
    days = made.where("timeframe = '1d'").withColumn("following", F.lead("ts_open").over(B.series())).where("following IS NOT NULL").select("symbol", "ts_open", "following")
    context = I.with_regime(made.where("timeframe = '4d'")).select("symbol", F.col("ts_open").alias("regime_ts"), "bullish", "ema_slow")
    out = as_of(days, context, ["symbol"], F.col("following") - F.pmod(F.col("following"), F.lit(345600)), F.col("regime_ts"), ["regime_ts", "bullish", "ema_slow"])
    return rounded(out.drop("following"), "ema_slow", places=6)


@query(
    "bar_store",
    f"""WITH {bars_sql(T.TAPE_TYPE_SQL, {'1h': 3600, '4h': 14400})}
SELECT symbol, timeframe, ts_open, round(open, 8) AS open, round(CASE WHEN timeframe = '4h' THEN high + 1 ELSE high END, 8) AS high, round(low, 8) AS low,
  round(CASE WHEN timeframe = '4h' THEN close - 1 ELSE close END, 8) AS close, round(volume, 8) AS volume FROM bars""",
)
def bar_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars appended to a changelog, those of four hours twice: the second row changes all but the open."""
    return rounded(store.latest_bars(spark, stored_bars(spark, sf_dir)), *BAR_COLUMNS)


def stored_bars(spark: SparkSession, sf_dir: str) -> str:
    """Path of a changelog of bars."""
    path = T.scratch(spark, "bar-store")
    made = B.bars(T.tape_type(spark, sf_dir), {"1h": 3600, "4h": 14400})
    store.append_bars(made.withColumn("seq", F.lit(1)), path)
    again = made.where("timeframe = '4h'").withColumns({"open": F.col("open") + 1, "high": F.col("high") + 1, "close": F.col("close") - 1, "seq": F.lit(2)})
    store.append_bars(again, path)
    return path


@query(
    "bar_history",
    f"""WITH {bars_sql(T.TAPE_TYPE_SQL, {'4h': 14400})},
k AS (SELECT *, row_number() OVER (ORDER BY ts_open DESC) AS back FROM bars WHERE symbol = 'click')
SELECT symbol, timeframe, ts_open, round(open, 8) AS open, round(high + 1, 8) AS high, round(low, 8) AS low, round(close - 1, 8) AS close, round(volume, 8) AS volume,
  row_number() OVER (ORDER BY ts_open)::INTEGER AS place FROM k WHERE back <= 30""",
)
def bar_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30 bars of one stored series, whose partition alone is read."""
    return rounded(store.history(spark, stored_bars(spark, sf_dir), "click", "4h", 30), *BAR_COLUMNS)
