"""Bars of streams: by event time, or in exact arrival order with state."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import bars as B
from tidemark.operators.bars import TIMEFRAMES, event_time_bars
from tidemark.operators.merge import POLICIES, Policy
from tidemark.sources.changelog import Changelog

BAR = "symbol string, timeframe string, ts_open bigint, open double, high double, low double, close double, volume double"


def windowed_bars(trades: DataFrame, timeframes: Mapping[str, int] = TIMEFRAMES, lateness: str = "10 minutes") -> DataFrame:
    """Event-time bars of a stream: late trades join their own bar until the watermark passes it, then they are dropped.

    Each bar is emitted once the watermark has passed its end, so the streaming aggregate keeps open bars only. Trades
    without symbol, time, price or size are left out.
    """
    frames = list(timeframes.items())
    rows = trades.dropna(subset=B.WHOLE).withWatermark("ts", lateness)
    parts = []
    for name, seconds in frames:
        made = rows.groupBy("symbol", F.window("ts", f"{seconds} seconds")).agg(
            F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("size").alias("volume")
        )
        parts.append(made.select("symbol", F.lit(name).alias("timeframe"), F.unix_timestamp("window.start").alias("ts_open"), "open", "high", "low", "close", "volume"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bars_of(trades: DataFrame, late_policy: str, timeframes: Mapping[str, int] = TIMEFRAMES) -> DataFrame:
    """Bars by policy for late trades: ``merge`` into the current bar (arrival order) or by event time (``drop`` past the watermark)."""
    if late_policy == "merge":
        return arrival_bars(trades, timeframes)
    return windowed_bars(trades, timeframes) if trades.isStreaming else event_time_bars(trades, timeframes)


#: Trades that are Python objects at once.
CHUNK = 50_000


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, float, float]]:
    """sec, price and size of a symbol's trades of a micro-batch in order of seq.

    Parts are kept as plain arrays (32 bytes a trade) and become Python numbers a chunk at a time, so no frame and no
    list of a whole micro-batch is made.
    """
    kept: list[list[np.ndarray]] = [[], [], [], []]
    for part in rows:
        for column, name in zip(kept, ("seq", "sec", "price", "size"), strict=True):
            column.append(part[name].to_numpy(copy=True))
    size, price, sec, seq = (np.concatenate(kept.pop()) for _ in range(4))
    order = np.argsort(seq, kind="stable")
    del seq
    for at in range(0, len(order), CHUNK):
        now = order[at : at + CHUNK]
        yield from zip(sec[now].tolist(), price[now].tolist(), size[now].tolist(), strict=True)


class ArrivalBars(StatefulProcessor):
    """Current bars of a symbol; a trade of a later bucket closes the bar it ends, the longest timeframe first."""

    def __init__(self, timeframes: Mapping[str, int]):
        self.frames = sorted(timeframes.items(), key=lambda kv: -kv[1])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getMapState("current", "timeframe string", "ts_open bigint, open double, high double, low double, close double, volume double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {name: list(self.current.getValue((name,))) if self.current.containsKey((name,)) else None for name, _ in self.frames}
        closed = []
        for sec, price, size in in_order(rows):
            for name, step in self.frames:
                bucket, bar = sec - sec % step, held[name]
                if bar is None or bucket > bar[0]:
                    if bar is not None:
                        closed.append((key[0], name, *bar))
                    held[name] = [bucket, price, price, price, price, size]
                else:
                    bar[2], bar[3], bar[4], bar[5] = max(bar[2], price), min(bar[3], price), price, bar[5] + size
        for name, bar in held.items():
            if bar is not None:
                self.current.updateValue((name,), tuple(bar))
        yield pd.DataFrame(closed, columns=["symbol", "timeframe", "ts_open", "open", "high", "low", "close", "volume"])

    def close(self) -> None:
        pass


def arrival_bars(trades: DataFrame, timeframes: Mapping[str, int] = TIMEFRAMES) -> DataFrame:
    """Completed bars of a stream of trades in order of seq (a number that rises with arrival); late trades join the current bar.

    State is one open bar for each symbol and timeframe. Trades without symbol, time, price or size are left out. A
    symbol's trades of a micro-batch are ordered in one task; :class:`BlockedBars` spreads them.
    """
    rows = trades.dropna(subset=B.WHOLE).select("symbol", "price", "size", "seq", F.floor(F.unix_micros("ts") / 1_000_000).cast("long").alias("sec"))
    return rows.groupBy("symbol").transformWithStateInPandas(ArrivalBars(timeframes), BAR, "append", "none")


class BlockedBars:
    """Completed bars of a stream in arrival order whose trades are ordered by blocks, so a hot symbol fills no task.

    Each micro-batch is turned into partial bars as the batch form does (a prefix maximum over blocks of arrival, then
    partial and final sums). They meet the one open bar of each series, which is carried in a versioned changelog; so is
    what has closed. Both take a batch once, and one that is tried again starts from the open bars before it.
    """

    WRITER = "bars"
    COLUMNS = ("open", "high", "low", "close", "volume")

    def __init__(self, spark, path: str, timeframes: Mapping[str, int] = TIMEFRAMES, block_rows: int = 100_000, buckets: int = 16, fanout: int = 8) -> None:
        self.timeframes, self.block_rows, self.fanout = timeframes, block_rows, fanout
        self.open = Changelog(spark, f"{path}/open", Policy(("symbol", "timeframe"), (), ("ts_open", *self.COLUMNS)), buckets, seq="__batch")
        self.closed = Changelog(spark, f"{path}/closed", POLICIES["bars"], buckets, seq="__batch")

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of trades (symbol, price, size, ts, seq), for ``foreachBatch``. Batches come in order of seq."""
        rows = B.placed(batch.withColumn("block", F.floor(F.col("seq") / self.block_rows)), self.timeframes)
        carried = self.open.latest(self.open.before(self.WRITER, number).number)
        if carried is not None:
            held = carried.select("symbol", "timeframe", F.col("ts_open").alias("held"))
            rows = rows.join(held, ["symbol", "timeframe"], "left").withColumn("ts_open", F.greatest("ts_open", "held")).drop("held")
        made = B.summed(rows)
        if carried is not None:
            both = made.withColumn("part", F.lit(1)).unionByName(carried.withColumn("part", F.lit(0)))
            made = both.groupBy("symbol", "timeframe", "ts_open").agg(
                F.min_by("open", "part").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "part").alias("close"), F.sum("volume").alias("volume")
            )
        made = made.withColumn("later", F.lead("ts_open").over(B.series())).withColumn("__batch", F.lit(number)).persist()
        try:
            self.closed.append(made.where("later IS NOT NULL").drop("later"), self.WRITER, number)
            self.open.append(made.where("later IS NULL").drop("later"), self.WRITER, number)
        finally:
            made.unpersist()
        for log in (self.closed, self.open):
            log.compact(self.fanout)
