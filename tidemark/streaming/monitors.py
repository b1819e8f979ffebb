"""Stateful monitors: stale feeds, pending orders and setups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.setups import SetupParams


class StaleFeed(StatefulProcessor):
    """Emits the end of each silence longer than the limit, and, by timer, the start of one that goes on."""

    def __init__(self, limit_ms: int, timers: bool):
        self.limit, self.timers = limit_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for part in rows for t in part["us"].tolist())
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in times:
            if last is not None and t - last > self.limit * 1000:
                out.append((key[0], "recovered", last, t))
            last = t if last is None else max(last, t)
        self.last.update((last,))
        if self.timers:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit)
        yield pd.DataFrame(out, columns=["symbol", "kind", "outage_start", "outage_end"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], "stale", self.last.get()[0], None)], columns=["symbol", "kind", "outage_start", "outage_end"]).astype({"outage_end": "Int64"})

    def close(self) -> None:
        pass


def stale_feed(trades: DataFrame, limit_ms: int, timers: bool = True) -> DataFrame:
    """Stale and recovered events of each symbol: symbol, kind, outage_start, outage_end (microseconds).

    With ``timers`` a silence is told when it has lasted ``limit_ms`` of processing time; without, only once it ends.
    Trades without symbol or time are left out.
    """
    rows = trades.dropna(subset=["symbol", "ts"]).select("symbol", F.unix_micros("ts").alias("us"))
    schema = "symbol string, kind string, outage_start bigint, outage_end bigint"
    return rows.groupBy("symbol").transformWithStateInPandas(StaleFeed(limit_ms, timers), schema, "append", "processingTime" if timers else "none")


class Silences(StatefulProcessor):
    """Tells each silence once, when the watermark has passed its limit, and its end when a later trade comes."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([part["us"].to_numpy(np.int64) for part in rows]))
        last, told = self.last.get() if self.last.exists() else (None, False)
        out = []
        line = times if last is None else np.concatenate([[last], times[times > last]])
        for at in np.nonzero(np.diff(line) > self.limit * 1000)[0].tolist():
            if at or last is None or not told:
                out.append((key[0], "stale", int(line[at]), None))
            out.append((key[0], "recovered", int(line[at]), int(line[at + 1])))
        if last is None or line[-1] > last:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(-(-int(line[-1]) // 1000) + self.limit)
            self.last.update((int(line[-1]), False))
        yield pd.DataFrame(out, columns=["symbol", "kind", "outage_start", "outage_end"]).astype({"outage_start": "Int64", "outage_end": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, told = self.last.get()
        self.last.update((last, True))
        out = [] if told else [(key[0], "stale", last, None)]
        yield pd.DataFrame(out, columns=["symbol", "kind", "outage_start", "outage_end"]).astype({"outage_start": "Int64", "outage_end": "Int64"})

    def close(self) -> None:
        pass


def silences(trades: DataFrame, limit_ms: int, lateness: str = "10 minutes") -> DataFrame:
    """Starts (``stale``) and ends (``recovered``) of silences longer than ``limit_ms`` of event time: symbol, kind, outage_start, outage_end (microseconds).

    A start is told once, when the watermark passes its limit without a trade or, at the latest, with the trade that ends
    it; so what is told follows from the data, whenever they come. Trades behind the watermark are dropped, and those
    without symbol or time are left out.
    """
    rows = trades.dropna(subset=["symbol", "ts"]).withWatermark("ts", lateness).select("symbol", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("symbol").transformWithStateInPandas(Silences(limit_ms), "symbol string, kind string, outage_start bigint, outage_end bigint", "append", "eventTime")


class Expiries(StatefulProcessor):
    """The statuses of a bucket's orders in event time; one expires ``limit_ms`` after it became pending unless it changed before."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("orders", "order_id array<string>, status array<string>, since array<bigint>, us array<bigint>, seq array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        changes = (x for part in rows for x in zip(part["order_id"].tolist(), part["us"].tolist(), part["seq"].tolist(), part["status"].tolist(), strict=True))
        for order, at, n, new in sorted(changes, key=lambda x: (*x[:3], x[3] or "")):
            status, since, us, seq = held.get(order, (None, None, None, None))
            if status == "EXPIRED" or us is not None and (at, n) <= (us, seq):
                continue
            if status == "PENDING" and at - since >= self.limit * 1000:
                new = "EXPIRED"
                out.append((order, new, since + self.limit * 1000))
            elif new == "PENDING" and status != "PENDING":
                since = at
            held[order] = (new, since, at, n)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self._keep(held)
        yield pd.DataFrame(out, columns=["order_id", "status", "expired_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        for order, (status, since, us, seq) in held.items():
            if status == "PENDING" and self._due(since) < mark:
                held[order] = ("EXPIRED", since, us, seq)
                out.append((order, "EXPIRED", since + self.limit * 1000))
        self._keep(held)
        yield pd.DataFrame(out, columns=["order_id", "status", "expired_at"])

    def close(self) -> None:
        pass

    def _due(self, since: int) -> int:
        return -(-since // 1000) + self.limit

    def _held(self) -> dict[str, tuple]:
        return {order: tuple(kept) for order, *kept in zip(*(self.kept.get() or ()), strict=True)}

    def _keep(self, held: dict[str, tuple]) -> None:
        """State of the bucket, and one timer for its first order that is due."""
        self.kept.update((list(held), *map(list, zip(*held.values(), strict=True))))
        first = min((self._due(since) for status, since, _, _ in held.values() if status == "PENDING"), default=None)
        if first is not None:
            self.handle.registerTimer(first)


def expiries(orders: DataFrame, limit_ms: int = 60_000, lateness: str = "10 minutes", buckets: int = 128) -> DataFrame:
    """Expiries of a stream of order changes (order_id, status, ts, seq) in event time: order_id, status, expired_at (microseconds).

    An order expires when it has been pending for ``limit_ms`` before its next change, or before the watermark. Changes of
    equal time are taken by seq; those behind the watermark, of expired orders and without id, time or seq are left out.
    State is read and written for a bucket of orders (by hash of the id) at once, as each call for a single order would
    cost more than all else; a micro-batch writes the buckets that it meets. ``buckets`` stays the same for a checkpoint.
    """
    rows = orders.dropna(subset=["order_id", "ts", "seq"]).withWatermark("ts", lateness)
    rows = rows.select(F.pmod(F.xxhash64("order_id"), F.lit(buckets)).alias("bucket"), "order_id", "status", "ts", "seq", F.unix_micros("ts").alias("us"))
    return rows.groupBy("bucket").transformWithStateInPandas(Expiries(limit_ms), "order_id string, status string, expired_at bigint", "append", "eventTime")


class PendingOrders(StatefulProcessor):
    """Expires an order that is still pending when its time is over, counted from when it became pending.

    Changes that aren't later (by seq) than the last one are ignored.
    """

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max((row for part in rows for row in zip(part["seq"].tolist(), part["status"].tolist(), strict=True)), key=lambda x: x[0])
        was = self.status.get() if self.status.exists() else (None, None)
        if was[1] is None or last[0] > was[1]:
            self.status.update((last[1], last[0]))
            if last[1] != "PENDING":
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
            elif was[0] != "PENDING":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit)
        yield pd.DataFrame([], columns=["order_id", "status", "fail_reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.status.update(("EXPIRED", self.status.get()[1]))
        yield pd.DataFrame([(key[0], "EXPIRED", "TIMEOUT")], columns=["order_id", "status", "fail_reason"])

    def close(self) -> None:
        pass


def pending_timeouts(orders: DataFrame, limit_ms: int = 60_000) -> DataFrame:
    """Expiries of a stream of order changes (order_id, status, seq)."""
    return orders.select("order_id", "status", "seq").groupBy("order_id").transformWithStateInPandas(PendingOrders(limit_ms), "order_id string, status string, fail_reason string", "append", "processingTime")


@dataclass
class Setup:
    """State of a symbol's setup between bars."""

    stage: str = "IDLE"
    level: float = 0.0
    midpoint: float = 0.0
    top: float = 0.0
    retest_low: float = 0.0
    waited: int = 0
    breakout_ts: int = 0
    last_ts: int = 0


class SetupDetector(StatefulProcessor):
    """Breakout, retest and continuation over prepared bars, one at a time."""

    STATE = "stage string, level double, midpoint double, top double, retest_low double, waited int, breakout_ts bigint, last_ts bigint"

    def __init__(self, params: SetupParams):
        self.p = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("setup", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = Setup(*self.kept.get()) if self.kept.exists() else Setup()
        out = []
        for bar in pd.concat(list(rows), ignore_index=True).sort_values("ts_open").itertuples():
            s, hit = advance(s, bar, self.p)
            if hit:
                out.append((key[0], *hit))
        self.kept.update(tuple(vars(s).values()))
        yield pd.DataFrame(out, columns=["symbol", "signal_ts", "breakout_ts", "breakout_level", "retest_level", "atr", "rsi", "execution_price"])

    def close(self) -> None:
        pass


def advance(s: Setup, bar, p: SetupParams) -> tuple[Setup, tuple | None]:
    """The setup after one more bar, and the signal that the bar gives, if it does.

    ``bar``: ts_open, low, high, close, atr, rsi, bullish, breakout, prior_high. Bars that aren't later are ignored. The bar that ends a setup starts none; the bar after a signal may.
    """
    if s.last_ts and bar.ts_open <= s.last_ts:
        return s, None
    if s.last_ts and p.stop_at_gaps and (s.stage == "DISABLED" or bar.ts_open - s.last_ts > p.signal_sec):
        return Setup("DISABLED", last_ts=bar.ts_open), None
    idle = Setup(last_ts=bar.ts_open)
    if s.stage in ("IDLE", "SIGNAL_EMITTED"):
        if not bar.breakout:
            return idle, None
        return Setup("WAITING_RETEST", bar.prior_high, (bar.high + bar.low) / 2, breakout_ts=bar.ts_open, last_ts=bar.ts_open), None
    if not bar.bullish:
        return idle, None
    s.last_ts = bar.ts_open
    if s.stage == "WAITING_RETEST":
        s.waited += 1
        if s.waited > p.retest_bars:
            return idle, None
        if s.level - p.zone_below * bar.atr <= bar.low <= s.level + p.zone_above * bar.atr and bar.close > s.level and bar.close > s.midpoint:
            s.stage, s.top, s.retest_low = "RETEST_CONFIRMED", bar.high, bar.low
        return s, None
    if bar.close <= s.top:
        return s, None
    if bar.close - s.level > p.chase * bar.atr:
        return idle, None
    hit = (bar.ts_open, s.breakout_ts, s.level, s.retest_low, bar.atr, bar.rsi, bar.close)
    s.stage = "SIGNAL_EMITTED"
    return s, hit


def setup_stream(bars: DataFrame, params: SetupParams = SetupParams()) -> DataFrame:
    """Signals of a stream of prepared bars (as ``setup_bars`` gives them, with a breakout column)."""
    rows = bars.select("symbol", "ts_open", "low", "high", "close", "atr", "rsi", "bullish", "breakout", "prior_high")
    schema = "symbol string, signal_ts bigint, breakout_ts bigint, breakout_level double, retest_level double, atr double, rsi double, execution_price double"
    return rows.groupBy("symbol").transformWithStateInPandas(SetupDetector(params), schema, "append", "none")
