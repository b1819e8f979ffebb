"""Tables as changelogs: latest-by-key views with first-wins and last-wins columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Which columns of a key keep their first value, which take the last, and which take the last that isn't null."""

    key: tuple[str, ...]
    first: tuple[str, ...] = ()
    last: tuple[str, ...] = ()
    patch: tuple[str, ...] = ()


POLICIES = {
    "bars": Policy(("symbol", "timeframe", "ts_open"), ("open",), ("high", "low", "close", "volume")),
    "orders": Policy(
        ("order_id",),
        ("signal_id", "symbol", "side", "price", "size", "created_at"),
        ("status", "executed_size", "exchange_order_id", "submitted_at", "updated_at", "fail_reason"),
    ),
    "positions": Policy(("symbol",), (), ("entry_ts", "avg_entry", "current_size", "realized_pnl", "unrealized_pnl", "stop_price", "state", "stop_active")),
    "signals": Policy(
        ("signal_id",), ("symbol", "signal_type", "regime_snapshot", "breakout_level", "retest_level", "atr", "rsi", "execution_price"), ("status",)
    ),
    "runtime_state": Policy(("key",), (), ("value",)),
    "executions": Policy(("execution_id",), ("order_id", "price", "size", "fee", "ts"), ()),
    "legacy_orders": Policy(("order_id",), ("signal_id", "symbol", "side", "price", "size"), ("exchange_order_id", "status")),
}


def merge_latest(changes: DataFrame, key: Sequence[str], seq: str = "seq", first: Sequence[str] = (), last: Sequence[str] = (), patch: Sequence[str] = ()) -> DataFrame:
    """One row a key from a changelog ordered by ``seq``.

    ``first`` columns come from the key's first row, ``last`` from its last (null if that is null), ``patch`` from the
    last row where the column isn't null, so a partial update leaves the others as they are. A partial and a final
    aggregation; a key with any number of changes sends one row a task.
    """
    head, tail = F.struct(*[F.col(c) for c in first]), F.struct(*[F.col(c) for c in last])
    aggs = []
    if first:
        aggs.append(F.min_by(head, seq).alias("__first"))
    if last:
        aggs.append(F.max_by(tail, seq).alias("__last"))
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in patch]
    out = changes.groupBy(*key).agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
    return out.select(*key, *[F.col(f"__first.{c}") for c in first], *[F.col(f"__last.{c}") for c in last], *patch)


def merged(changes: DataFrame, table: str, seq: str = "seq") -> DataFrame:
    """The latest view of a known table's changelog."""
    p = POLICIES[table]
    return merge_latest(changes, p.key, seq, p.first, p.last, p.patch)


def first_rows(changes: DataFrame, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """The first row of each key; later rows of a key are refused."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.min_by(F.struct(*rest), seq).alias("__row")).select(*key, "__row.*")
