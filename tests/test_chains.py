"""Chains by links against the fold, on random candidates and on many of one key."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains
from tidemark.operators.setups import greedy_chain


@pytest.mark.parametrize("size", [3, 16])
def test_links_equal_the_fold(spark, size):
    rng = random.Random(size)
    rows = [(k, at, rng.choice([None] + [at + rng.randrange(-3, 25)] * 40)) for k, n in (("A", 120), ("B", 90), ("C", 1), ("D", 30)) for at in (rng.randrange(300) for _ in range(n))]
    df = spark.createDataFrame(rows, "k string, at bigint, release bigint")
    key = lambda r: (r.k, r.at, r.release is not None, r.release)
    assert sorted(map(key, chains.long_chain(df, "k", "at", "release", size).collect())) == sorted(map(key, greedy_chain(df, "k", "at", "release").collect()))


def test_many_candidates_of_one_key(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("A").alias("k"), F.col("id").alias("at"), (F.col("id") + 3 + F.col("id") % 5).alias("release"))
    at, wanted = 0, []
    while at < n:
        wanted.append(at)
        at += 3 + at % 5
    began = time.time()
    assert [r.at for r in chains.long_chain(df, "k", "at", "release").orderBy("at").collect()] == wanted
    assert time.time() - began < 120
