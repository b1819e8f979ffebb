"""Chains over many candidates of one key: each candidate points to the next that may follow it, and blocks are passed over whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tapes import scratch

#: Candidates that are folded as one array.
BLOCK = 256


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back, so a pass over links doesn't repeat the passes before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def linked(df: DataFrame, key: str, start: str, release: str) -> DataFrame:
    """key, start, rank (from 1, by start, then release, null first) and next: the rank of the first later candidate that starts at or after the release.

    Starts and releases are put in one falling order and the last start is carried along, so no pairs are made. A null
    release has no next.
    """
    by = Window.partitionBy("key").orderBy("start", F.col("release").asc_nulls_first())
    rows = df.select(F.col(key).alias("key"), F.col(start).cast("long").alias("start"), F.col(release).cast("long").alias("release"))
    rows = rows.withColumn("rank", F.row_number().over(by).cast("long"))
    both = rows.select("key", "start", "rank", F.lit(0).alias("side"), F.col("start").alias("at")).unionByName(
        rows.where("release IS NOT NULL").select("key", "start", "rank", F.lit(1).alias("side"), F.col("release").alias("at"))
    )
    falling = Window.partitionBy("key").orderBy(F.desc("at"), "side", F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.last(F.when(F.col("side") == 0, F.col("rank")), ignorenulls=True).over(falling)
    follows = both.withColumn("ahead", ahead).where("side = 1").select("key", "rank", F.when(F.col("ahead").isNotNull(), F.greatest("ahead", F.col("rank") + 1)).alias("next"))
    last = rows.groupBy("key").agg(F.max("rank").alias("last"))
    out = rows.join(follows, ["key", "rank"], "left").join(last, "key")
    return out.select("key", "start", "rank", F.when(F.col("next") <= F.col("last"), F.col("next")).alias("next"))


def _block(rank: Column, size: int) -> Column:
    return F.floor((rank - 1) / size).cast("long")


def reached(links: DataFrame, size: int = BLOCK) -> DataFrame:
    """key, rank of the candidates on the chain that begins with each key's first.

    A block's candidates are folded from the last to the first, which gives where the chain leaves the block from each.
    Only places where some chain enters a block are followed from block to block, by doubling: after k passes the places
    up to 2^k blocks on are known. Then each block that the chain enters is walked from its entry. No array is longer
    than a block.
    """
    in_block = links.groupBy("key", _block(F.col("rank"), size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "next"))).alias("run"))
    # exits[k] belongs to the k-th last candidate of the run
    n = F.size("run")
    end = F.element_at("run", -1)["rank"]
    inner = lambda acc, x: F.when(x["next"] <= end, F.element_at(acc, (end - x["next"] + 1).cast("int"))).otherwise(x["next"])
    exits = F.aggregate(F.reverse("run"), F.array().cast("array<bigint>"), lambda acc, x: F.array_append(acc, inner(acc, x)))
    blocks = _kept(in_block.withColumn("exits", exits), "chain-blocks")
    rows = blocks.select("key", F.explode(F.arrays_zip(F.reverse("run").alias("run"), "exits")).alias("x")).select("key", F.col("x.run.rank").alias("node"), F.col("x.exits").alias("to"))
    entries = rows.where("to IS NOT NULL").select("key", F.col("to").alias("node")).distinct()
    jump = _kept(rows.join(entries, ["key", "node"], "left_semi").unionByName(rows.where("node = 1")).distinct(), "chain-jumps")
    on = jump.where("node = 1").select("key", "node")
    while True:
        further = on.join(jump.where("to IS NOT NULL"), ["key", "node"]).select("key", F.col("to").alias("node"))
        on = _kept(on.unionByName(further).distinct(), "chain-entries")
        jump = jump.where("to IS NOT NULL")
        if jump.isEmpty():
            break
        then = jump.select("key", F.col("node").alias("to"), F.col("to").alias("then"))
        jump = _kept(jump.join(then, ["key", "to"], "left").select("key", "node", F.col("then").alias("to")), "chain-jumps")
    entered = on.withColumn("block", _block(F.col("node"), size))
    walk = F.aggregate(
        "run",
        F.struct(F.col("node").alias("at"), F.array().cast("array<bigint>").alias("taken")),
        lambda acc, x: F.when(x["rank"] == acc["at"], F.struct(x["next"].alias("at"), F.array_append(acc["taken"], x["rank"]).alias("taken"))).otherwise(acc),
        lambda acc: acc["taken"],
    )
    return entered.join(blocks.select("key", "block", "run"), ["key", "block"]).select("key", F.explode(walk).alias("rank"))


def long_chain(df: DataFrame, key: str, start: str, release: str, size: int = BLOCK) -> DataFrame:
    """The rows that :func:`tidemark.operators.setups.greedy_chain` takes, for keys of any number of candidates."""
    links = _kept(linked(df, key, start, release), "chain-links")
    taken = links.join(reached(links, size), ["key", "rank"], "left_semi").select(F.col("key").alias(key), F.col("start").alias(start))
    return df.join(taken, [key, start], "left_semi")
