"""Trading guards as a stream: trips that are kept, survive a restart, and are told once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STALE, STOP = "stale_stream", "stop_required"


class Guard(StatefulProcessor):
    """The trips of a bucket's keys with the tick that they began at, whether a silence has ever ended, and the last ticks."""

    def __init__(self, key: str, kind: str):
        self.key, self.kind = key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("guards", f"key array<{self.kind}>, seq array<bigint>, released array<boolean>, can_trade array<boolean>, stale array<bigint>, stopped array<bigint>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held = self._held()
        for row in initialState.sort_values("seq", kind="stable").itertuples(index=False):
            seq = int(row.seq)
            if row.key not in held or held[row.key][0] <= seq:
                held[row.key] = (seq, bool(row.released), bool(row.can_trade), *(seq if name in row.tripped else None for name in (STALE, STOP)))
        self._keep(held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat([part.drop(columns="bucket") for part in rows], ignore_index=True).sort_values(["key", "seq"], kind="stable")
        held, keys = self._held(), ticks["key"].to_numpy()
        last = {k: h[0] for k, h in held.items()}
        edges = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
        columns = [ticks[c].to_numpy() for c in ("seq", "stale", "violated", "enabled")]
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            name = keys[a : a + 1].tolist()[0]
            if name in last:
                a += int(np.searchsorted(columns[0][a:b], last[name], "right"))
            if a < b:
                held[name], made = judged(held.get(name, (None, False, False, None, None)), *[c[a:b] for c in columns])
                out.append((keys[a:b], *made))
        if not out:
            return
        self._keep(held)
        found, numbers, can, names, disabled = map(np.concatenate, zip(*out, strict=True))
        yield pd.DataFrame({self.key: found if key[0] >= 0 else pd.Series([None] * len(found), dtype=object), "seq": numbers, "can_trade": can, "tripped": names, "disabled": disabled})

    def close(self) -> None:
        pass

    def _held(self) -> dict:
        return {name: tuple(kept) for name, *kept in zip(*(self.kept.get() or ()), strict=True)}

    def _keep(self, held: dict) -> None:
        self.kept.update((list(held), *map(list, zip(*held.values(), strict=True))))


def judged(held: tuple, numbers: np.ndarray, stale: np.ndarray, violated: np.ndarray, enabled: np.ndarray) -> tuple[tuple, tuple]:
    """What is held of a key (last tick, released, can_trade, since when stale, since when stopped) after its next ticks, and their rows."""
    _, released, could, *since = held
    stopped = np.logical_or.accumulate(violated) | (since[1] is not None)
    released = np.logical_or.accumulate(stale) | released
    can = ~stale & ~stopped & (enabled | released)
    before = np.concatenate([[could], can[:-1]])
    for n, now in enumerate((stale, stopped)):
        if not now[-1]:
            since[n] = None
        elif since[n] is None or not now.all():
            off = np.nonzero(~now)[0]
            since[n] = int(numbers[off[-1] + 1 if len(off) else 0])
    names = np.array(["", STALE, STOP, f"{STALE},{STOP}"], object)[stale + 2 * stopped]
    return (int(numbers[-1]), bool(released[-1]), bool(can[-1]), *since), (numbers, can, names, before & ~can)


def guard_stream(ticks: DataFrame, key: str, seq: str, enabled: Column, stored: DataFrame | None = None, buckets: int = 128) -> DataFrame:
    """Whether trading is allowed at each tick of a stream: key, seq, can_trade, tripped (names, joined), disabled (allowed before, no more).

    The same as :func:`tidemark.operators.guards.latch` and ``disabled_edges`` over all ticks (key, ``seq``, stale, violated).
    Batches come in order of ``seq``; ticks at or before the last one are told again and left out. ``stored`` is the state at
    the first start (key, seq, tripped (array), released, can_trade): trips that another process kept, and whether a
    silence has enabled trading. State is a row a key (an integer or a text) with two trips at most; it is read and
    written for a bucket of keys (by their hash) at once. ``buckets`` stays the same for a checkpoint.
    """
    kind = ticks.schema[key].dataType.simpleString()
    of = [F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).alias("bucket"), F.coalesce(key, F.lit(0).cast(kind)).alias("key")]  # keys that are null have a bucket of their own
    rows = ticks.select(*of, F.col(seq).cast("long").alias("seq"), F.coalesce("stale", F.lit(False)).alias("stale"), F.coalesce("violated", F.lit(False)).alias("violated"), F.coalesce(enabled, F.lit(False)).alias("enabled"))
    first = stored.withColumn(key, F.col(key).cast(kind)).select(*of, "seq", "tripped", "released", "can_trade").groupBy("bucket") if stored is not None else None
    schema = f"{key} {kind}, seq bigint, can_trade boolean, tripped string, disabled boolean"
    return rows.groupBy("bucket").transformWithStateInPandas(Guard(key, kind), schema, "append", "none", initialState=first)
