"""Bounded history of bars in a stream, warm-started from stored bars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIELDS = ["ts_open", "high", "low", "close"]
WINDOW = "symbol string, timeframe string, ts_open bigint, n_window int, highs array<double>, lows array<double>, closes array<double>"


class RollingBars(StatefulProcessor):
    """Keeps the last ``size`` bars of a series and emits, with each new bar, the window that it closes.

    Bars that aren't later than the last one are ignored.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("bars", "ts_open bigint, high double, low double, close double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        past = initialState.sort_values("ts_open").tail(self.size)
        self.kept.put(list(past[FIELDS].itertuples(index=False, name=None)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        window = list(self.kept.get()) if self.kept.exists() else []
        out = []
        for bar in pd.concat(list(rows), ignore_index=True).sort_values("ts_open")[FIELDS].itertuples(index=False, name=None):
            if window and bar[0] <= window[-1][0]:
                continue
            window = [*window, bar][-self.size :]
            highs, lows, closes = ([x[i] for x in window] for i in (1, 2, 3))
            out.append((*key, bar[0], len(window), highs, lows, closes))
        if window:
            self.kept.put(window)
        yield pd.DataFrame(out, columns=["symbol", "timeframe", "ts_open", "n_window", "highs", "lows", "closes"])

    def close(self) -> None:
        pass


def rolling_windows(bars: DataFrame, size: int, stored: DataFrame | None = None) -> DataFrame:
    """Windows of a stream of bars as arrays, which the folds take as columns; ``stored`` bars fill them at the first start."""
    grouped = bars.select("symbol", "timeframe", *FIELDS).groupBy("symbol", "timeframe")
    first = stored.select("symbol", "timeframe", *FIELDS).groupBy("symbol", "timeframe") if stored is not None else None
    return grouped.transformWithStateInPandas(RollingBars(size), WINDOW, "append", "none", initialState=first)
