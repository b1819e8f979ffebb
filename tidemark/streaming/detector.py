"""From a stream of trades to signals in one stateful pass: bars, rolling history, indicators, regime and setup."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.setups import SetupParams
from tidemark.streaming.bars import in_order
from tidemark.streaming.monitors import Setup, advance

BAR = ("ts_open", "open", "high", "low", "close", "volume")
SIGNAL = "symbol string, signal_ts bigint, breakout_ts bigint, breakout_level double, retest_level double, atr double, rsi double, execution_price double"


def mean(values: list[float]) -> float:
    total = 0.0
    for x in values:
        total += x
    return total / len(values)


def smoothed(values: list[float], period: int) -> float | None:
    """Wilder's mean of steps whose first never counts, as ``folds.wilder``."""
    if len(values) <= period:
        return None
    a = mean(values[1 : period + 1])
    for x in values[period + 1 :]:
        a = (a * (period - 1) + x) / period
    return a


def exponential(values: list[float], period: int) -> float | None:
    """The exponential mean seeded by a plain one, as ``folds.ema``."""
    if len(values) < period:
        return None
    a, rate = mean(values[:period]), 2.0 / (period + 1)
    for x in values[period:]:
        a = (x - a) * rate + a
    return a


def ranges(bars: list[list[float]]) -> list[float]:
    """True ranges; 0 for the first bar."""
    return [0.0] + [max(b[2] - b[3], abs(b[2] - a[4]), abs(b[3] - a[4])) for a, b in zip(bars, bars[1:], strict=False)]


@dataclass
class Live:
    """What a symbol's detector keeps: open bars, bounded history, the last regime, and the setup."""

    current: dict[str, list] = field(default_factory=dict)
    signal: list[list] = field(default_factory=list)
    regime: list[list] = field(default_factory=list)
    n_seen: int = 0
    regime_ts: int | None = None
    n_regime: int = 0
    bullish: bool = False
    seen_regime_ts: int | None = None
    broken: bool = False
    setup: dict = field(default_factory=lambda: asdict(Setup()))


@dataclass
class Prepared:
    """A signal bar with all that ``advance`` looks at."""

    ts_open: int
    low: float
    high: float
    close: float
    atr: float | None
    rsi: float | None
    bullish: bool
    breakout: bool
    prior_high: float | None


def add_regime_bar(live: Live, bar: list, p: SetupParams) -> None:
    """The regime at a closed regime bar, from the bounded history that it ends."""
    live.regime = [*live.regime, bar][-p.regime_window :]
    closes = [b[4] for b in live.regime]
    live.regime_ts, live.n_regime, live.bullish = int(bar[0]), len(closes), False
    if len(closes) > p.slow:
        fast, slow, before, atr = exponential(closes, p.fast), exponential(closes, p.slow), exponential(closes[:-1], p.slow), smoothed(ranges(live.regime), p.atr_period)
        live.bullish = bar[4] > slow and fast > slow and slow > before and atr is not None and bar[4] != 0 and atr / bar[4] > p.least_range


def add_signal_bar(live: Live, bar: list, p: SetupParams) -> Prepared | None:
    """The prepared bar at a closed signal bar; None while the history is too short or after a gap."""
    past, live.n_seen = live.signal[-p.lookback :], live.n_seen + 1
    live.signal = [*live.signal, bar][-max(p.signal_window, p.lookback + 1) :]
    if live.n_seen < p.least_signal or live.n_regime < p.least_regime:
        return None
    if p.stop_at_gaps and live.seen_regime_ts is not None and live.regime_ts - live.seen_regime_ts > p.regime_sec:
        live.broken = True
    live.seen_regime_ts = live.regime_ts
    if live.broken:
        return None
    window = live.signal[-p.signal_window :]
    steps = [0.0] + [b[4] - a[4] for a, b in zip(window, window[1:], strict=False)]
    gain, loss = smoothed([max(x, 0.0) for x in steps], p.rsi_period), smoothed([max(-x, 0.0) for x in steps], p.rsi_period)
    rsi = None if gain is None else 100.0 if loss == 0 else 100.0 - 100.0 / (1.0 + gain / loss)
    high = max((b[2] for b in past), default=None)
    volume = sum(b[5] for b in past) / p.lookback
    _, _, top, low, close, size = bar
    breakout = live.bullish and high is not None and close > high and size > p.volume_factor * volume and top > low and (close - low) / (top - low) >= p.least_position
    return Prepared(int(bar[0]), low, top, close, smoothed(ranges(window), p.atr_period), rsi, live.bullish, breakout and rsi is not None and p.rsi_low <= rsi <= p.rsi_high, high)


class Detector(StatefulProcessor):
    """Trades of a symbol in order of seq; a trade that opens a later bar closes the one before, the regime's first."""

    def __init__(self, params: SetupParams):
        self.p = params
        self.frames = ((params.regime, params.regime_sec), (params.signal, params.signal_sec))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("live", "state string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        live = Live()
        rows = initialState.sort_values("ts_open")
        for bar in rows[rows["timeframe"] == self.p.regime][list(BAR)].to_numpy().tolist():
            add_regime_bar(live, bar, self.p)
        past = rows[rows["timeframe"] == self.p.signal][list(BAR)].to_numpy().tolist()
        live.signal, live.n_seen = past[-max(self.p.signal_window, self.p.lookback + 1) :], len(past)
        self.kept.update((json.dumps(asdict(live)),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        live = Live(**json.loads(self.kept.get()[0])) if self.kept.exists() else Live()
        setup = Setup(**live.setup)
        out = []
        for sec, price, size in in_order(rows):
            for name, step in self.frames:
                at, bar = sec - sec % step, live.current.get(name)
                if bar is not None and at <= bar[0]:
                    bar[2], bar[3], bar[4], bar[5] = max(bar[2], price), min(bar[3], price), price, bar[5] + size
                    continue
                live.current[name] = [at, price, price, price, price, size]
                if bar is None:
                    continue
                if name == self.p.regime:
                    add_regime_bar(live, bar, self.p)
                elif (made := add_signal_bar(live, bar, self.p)) is not None:
                    setup, hit = advance(setup, made, self.p)
                    if hit:
                        out.append((key[0], *hit))
        live.setup = asdict(setup)
        self.kept.update((json.dumps(asdict(live)),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SIGNAL.split(", ")])

    def close(self) -> None:
        pass


def detect(trades: DataFrame, params: SetupParams = SetupParams(), stored: DataFrame | None = None) -> DataFrame:
    """Signals of a stream of trades (symbol, price, size, ts, seq), the same as the batch detector's over all trades.

    State is bounded: two open bars, the last bars of both timeframes, the regime and the setup of a symbol. ``stored``
    bars (symbol, timeframe, ts_open, open, high, low, close, volume) are history at the first start; the detector then
    waits for trades after them. Late trades join the current bar. Trades without symbol, time, price or size are left
    out. Batches must come in order of seq; a batch's trades of one symbol are ordered in one task.
    """
    rows = trades.dropna(subset=["symbol", "ts", "price", "size"]).select("symbol", "price", "size", "seq", F.floor(F.unix_micros("ts") / 1_000_000).cast("long").alias("sec"))
    first = stored.select("symbol", "timeframe", *BAR).groupBy("symbol") if stored is not None else None
    return rows.groupBy("symbol").transformWithStateInPandas(Detector(params), SIGNAL, "append", "none", initialState=first)
