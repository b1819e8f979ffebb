"""A versioned changelog on disk: appended runs, a manifest a version, and runs merged without touching what readers use.

A run is written once and never changed: it has one row a key, filed by hash of the key and sorted within a file, by a part of that hash and key. A version is a small
manifest that lists its runs; a writer publishes one by creating the file of the next number, which one writer only can.
Readers hold a version, so a merge of runs doesn't disturb them. Merged runs hold a row a key with what later changes
need to be merged in: the first values, the last, and the last known of each patched column, each with its place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tidemark.operators.merge import Policy

BUCKETS = 64


def stated(changes: DataFrame, p: Policy, seq: str = "seq", *also: str) -> DataFrame:
    """Changes in the form of merged rows: the key, __first, __last and a __patch for each patched column, with their seq; and columns ``also``."""
    part = lambda names: F.struct(F.col(seq).alias("seq"), *[F.col(c) for c in names])
    patches = [F.when(F.col(c).isNotNull(), part([c])).alias(f"__patch_{c}") for c in p.patch]
    return changes.select(*also, *p.key, part(p.first).alias("__first"), part(p.last).alias("__last"), *patches)


def combined(states: DataFrame, p: Policy, *also: str) -> DataFrame:
    """One row a key of merged rows; the order in which they are merged doesn't matter. ``also``: columns that follow from the key."""
    patches = [F.max_by(f"__patch_{c}", f"__patch_{c}.seq").alias(f"__patch_{c}") for c in p.patch]
    return states.groupBy(*also, *p.key).agg(F.min_by("__first", "__first.seq").alias("__first"), F.max_by("__last", "__last.seq").alias("__last"), *patches)


def shown(states: DataFrame, p: Policy) -> DataFrame:
    """The columns of merged rows."""
    return states.select(*p.key, *[F.col(f"__first.{c}") for c in p.first], *[F.col(f"__last.{c}") for c in p.last], *[F.col(f"__patch_{c}.{c}").alias(c) for c in p.patch])


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Run:
    """A written run: its folder, how often its rows have been merged, how many they are, and whether it has one row a key."""

    path: str
    tier: int
    rows: int
    single: bool = False


@dataclass(frozen=True)
class Version:
    """A version: its number, its runs, the last batch of each writer, and the form of its rows."""

    number: int
    runs: tuple[Run, ...] = ()
    batches: tuple[tuple[str, int], ...] = ()
    schema: str = ""


class Changelog:
    """A changelog at ``path`` under a policy of first, last and patched columns.

    Appends and merges may come from several writers: a writer whose version was taken in the meantime tries again on top
    of it. Rows are never removed by a merge; :meth:`unused` names the runs that no kept version lists.
    """

    def __init__(self, spark: SparkSession, path: str, policy: Policy, buckets: int = BUCKETS, seq: str = "seq") -> None:
        self.spark, self.path, self.policy, self.buckets, self.seq = spark, path.rstrip("/"), policy, buckets, seq

    # Manifests

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _numbers(self) -> list[int]:
        fs, where = self._hadoop(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _manifest(self, number: int) -> Version | None:
        """A published version; None where its writer died before the file was whole."""
        fs, where = self._hadoop(f"{self.path}/manifest/{number:012d}.json")
        stream = fs.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            said = json.loads(text)
        except ValueError:
            return None
        return Version(number, tuple(Run(**r) for r in said["runs"]), tuple((w, b) for w, b in said["batches"]), said["schema"])

    def version(self, number: int | None = None) -> Version:
        """A version, the latest by default; version 0 is empty."""
        if number is not None:
            found = self._manifest(number) if number else Version(0)
            if found is None:
                raise ValueError(f"version {number} isn't whole")
            return found
        return next((v for n in reversed(self._numbers()) if (v := self._manifest(n)) is not None), Version(0))

    def before(self, writer: str, batch: int) -> Version:
        """The latest version without a batch of a writer or any later one: what a batch that is tried again started from."""
        for n in reversed(self._numbers()):
            found = self._manifest(n)
            if found is not None and dict(found.batches).get(writer, -1) < batch:
                return found
        return Version(0)

    def _publish(self, runs: Sequence[Run], batches: dict[str, int], schema: str, after: int) -> Version:
        number = after + 1
        fs, where = self._hadoop(f"{self.path}/manifest/{number:012d}.json")
        text = json.dumps({"runs": [vars(r) for r in runs], "batches": sorted(batches.items()), "schema": schema})
        try:
            stream = fs.create(where, False)
        except Exception as error:  # py4j wraps what the file system throws
            if fs.exists(where):
                raise Conflict(f"version {number} is taken") from error
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return Version(number, tuple(runs), tuple(sorted(batches.items())), schema)

    # Runs

    def _written(self, rows: DataFrame, tier: int, form: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Run:
        """A run of one row a key. ``rows`` are shuffled once, as they are, by bucket and part of a bucket; ``form`` (the form of
        merged rows) and the merge come after. There are as many parts as let all tasks write and no more, as a task writes a
        file for each bucket that it meets."""
        path = f"{self.path}/runs/{uuid.uuid4().hex}"
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = -(-2 * tasks // self.buckets)
        hashed = F.xxhash64(*self.policy.key)
        bucket, part = F.pmod(hashed, F.lit(self.buckets)).cast("int").alias("__bucket"), F.pmod(F.shiftright(hashed, 32), F.lit(parts)).cast("int").alias("__part")
        filed = form(rows.select("*", bucket, part).repartition("__bucket", "__part"))
        made = combined(filed, self.policy, "__bucket", "__part").sortWithinPartitions("__bucket", "__part", *self.policy.key)
        made = made.select(*[c for c in filed.columns if c != "__part"])
        made.write.partitionBy("__bucket").option("compression", "zstd").parquet(path)
        return Run(path, tier, self.spark.read.schema(made.schema).parquet(path).count(), True)

    def _states(self, runs: Sequence[Run], schema: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
        if not runs:
            return None
        paths = [r.path for r in runs if r.rows] or [runs[0].path]
        form = StructType.fromDDL(schema).add("__bucket", IntegerType())
        rows = None
        for path in paths:
            run = self.spark.read.schema(form).parquet(path)
            rows = run if rows is None else rows.unionByName(run)
        return (rows if buckets is None else rows.where(F.col("__bucket").isin(*buckets))).drop("__bucket")

    def append(self, changes: DataFrame, writer: str = "", batch: int | None = None, tries: int = 10) -> Version:
        """Publish a version with one more run of changes (with ``seq``).

        A batch of a writer that isn't later than its last one was appended before: nothing is added, so a batch that a
        stream tries again counts once.
        """
        now = self.version()
        known = dict(now.batches)
        if batch is not None and known.get(writer, -1) >= batch:
            return now
        states = stated(changes, self.policy, self.seq)
        run = self._written(changes.select(*dict.fromkeys([*self.policy.key, self.seq, *self.policy.first, *self.policy.last, *self.policy.patch])), 0, lambda rows: stated(rows, self.policy, self.seq, "__bucket", "__part"))
        schema = states.schema.toDDL()
        for _ in range(tries):
            known = dict(now.batches)
            if batch is not None and known.get(writer, -1) >= batch:
                return now
            try:
                return self._publish([*now.runs, run], known | ({writer: batch} if batch is not None else {}), schema, max([now.number, *self._numbers()]))
            except Conflict:
                now = self.version()
        raise Conflict(f"no version could be published in {tries} tries")

    def compact(self, fanout: int = 2, tries: int = 10) -> Version:
        """Merge the runs of the lowest tier that has ``fanout`` or more into one of the next tier; else nothing happens.

        A run is merged into larger ones only, so a row is written again as often as there are tiers. Versions that list
        the old runs stay readable.
        """
        now = self.version()
        tiers: dict[int, list[Run]] = {}
        for run in now.runs:
            tiers.setdefault(run.tier, []).append(run)
        tier = next((t for t in sorted(tiers) if len(tiers[t]) >= fanout), None)
        if tier is None:
            return now
        old = tiers[tier]
        states = self._states(old, now.schema)
        new = [self._written(states, tier + 1)] if states is not None else []
        for _ in range(tries):
            paths = {r.path for r in now.runs}
            if not {r.path for r in old} <= paths:
                raise Conflict("its runs were merged by another writer")
            rest = [r for r in now.runs if r not in old]
            try:
                return self._publish([*new, *rest], dict(now.batches), now.schema, max([now.number, *self._numbers()]))
            except Conflict:
                now = self.version()
        raise Conflict(f"no version could be published in {tries} tries")

    # Reading

    def _merged(self, runs: Sequence[Run], states: DataFrame, p: Policy | None = None) -> DataFrame:
        """One row a key of the rows of ``runs``; those of a single run that has one row a key are taken as they are."""
        full = [r for r in runs if r.rows] or list(runs[:1])
        return states if len(full) == 1 and full[0].single else combined(states, p or self.policy)

    def latest(self, number: int | None = None, only: Sequence[str] | None = None, kept: Callable[[DataFrame], DataFrame] = lambda states: states) -> DataFrame | None:
        """The latest row of each key as of a version; None while nothing was appended. With ``only``, these columns beside
        the key alone are read and merged. ``kept`` leaves keys out before the merge."""
        at = self.version(number)
        states = self._states(at.runs, at.schema)
        if states is None:
            return None
        p = self.policy
        if only is not None:
            p = Policy(p.key, *[tuple(c for c in names if c in only) for names in (p.first, p.last, p.patch)])
            part = lambda of, names: F.struct(F.col(f"{of}.seq").alias("seq"), *[F.col(f"{of}.{c}").alias(c) for c in names]).alias(of)
            states = states.select(*p.key, part("__first", p.first), part("__last", p.last), *[f"__patch_{c}" for c in p.patch])
        return shown(self._merged(at.runs, kept(states), p), p)

    def keys(self, number: int | None = None) -> DataFrame | None:
        """The keys of a version, each as often as runs have it: nothing is merged."""
        at = self.version(number)
        states = self._states(at.runs, at.schema)
        return None if states is None else states.select(*self.policy.key)

    def matching(self, wanted: DataFrame, number: int | None = None, only: Sequence[str] | None = None) -> DataFrame | None:
        """The latest rows of the keys that ``wanted`` has (its columns are some or all of the key). The others are left out before
        anything is merged, and no key passes through the driver."""
        return self.latest(number, only, lambda states: states.join(wanted, wanted.columns, "left_semi"))

    def fitting(self, fits: Column, number: int | None = None) -> DataFrame | None:
        """The latest rows that fit a condition on columns that take the last value. Only keys with a stored row that fits are merged."""
        at = self.version(number)
        states = self._states(at.runs, at.schema)
        if states is None:
            return None
        met = states.select(*self.policy.key, "__last.*").where(fits).select(*self.policy.key)
        return self.latest(at.number).limit(0) if met.isEmpty() else self.matching(met, at.number).where(fits)

    def lookup(self, keys: DataFrame, number: int | None = None) -> DataFrame | None:
        """The latest rows of ``keys`` (the key columns) alone; only the buckets that they fall in are read."""
        at = self.version(number)
        wanted = keys.select(*self.policy.key).distinct()
        met = wanted.select(F.pmod(F.xxhash64(*self.policy.key), F.lit(self.buckets)).cast("int").alias("b")).distinct()
        states = self._states(at.runs, at.schema, [r["b"] for r in met.collect()] or [-1])
        return None if states is None else shown(self._merged(at.runs, states.join(wanted, list(self.policy.key), "left_semi")), self.policy)

    def unused(self, keep: int) -> list[str]:
        """Folders of runs that the last ``keep`` versions don't list, for whoever clears them once no reader holds an older one."""
        numbers = self._numbers()
        listed = {r.path for n in numbers[-keep:] if (v := self._manifest(n)) is not None for r in v.runs}
        before = {r.path for n in numbers[:-keep] if (v := self._manifest(n)) is not None for r in v.runs}
        return sorted(before - listed)


def sink(log: Changelog, writer: str, fanout: int | None = 8):
    """A callback for ``foreachBatch`` that appends each batch once and merges runs as they gather."""

    def take(batch: DataFrame, number: int) -> None:
        log.append(batch, writer, number)
        if fanout:
            log.compact(fanout)

    return take
