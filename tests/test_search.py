"""Next-row searches against loops, and their rows and time on long series."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.operators import setups as S
from tests.test_setups import BARS, P


@pytest.mark.parametrize("seed", range(3))
def test_first_above_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    series = {k: [rng.choice([None, *[float(rng.randrange(40))] * 30]) if rng.random() < 0.2 else rng.random() * 30 for _ in range(n)] for k, n in (("A", 700), ("B", 40), ("C", 1))}
    points = [(k, i, rng.randrange(len(v)), rng.uniform(0, 45)) for k, v in series.items() for i in range(60)]
    wanted = {}
    for k, name, at, above in points:
        hit = next((j for j in range(at + 1, len(series[k])) if series[k][j] is not None and series[k][j] > above), None)
        if hit is not None:
            wanted[k, name] = hit
    rows = spark.createDataFrame([(k, j, x) for k, v in series.items() for j, x in enumerate(v)], "k string, place long, value double")
    asked = spark.createDataFrame(points, "k string, name int, at int, above double")
    for levels in (1, 2, 4):
        got = search.first_above(asked, rows, ["k"], "name", "place", "value", levels).collect()
        assert {(r.k, r.name): r.found for r in got} == wanted and len(got) == len(wanted)


def test_rows_of_the_search_are_points_times_levels(spark):
    n = 1 << 17
    rows = spark.range(n).select(F.lit("A").alias("k"), F.col("id").alias("place"), F.when(F.col("id") == n - 1, 9.0).otherwise(F.rand(1)).alias("value"))
    asked = spark.range(50).select(F.lit("A").alias("k"), F.col("id").alias("name"), (F.col("id") * 1000).alias("at"), F.lit(5.0).alias("above"))
    met = search.lookups(asked).join(search.pyramid(rows, ["k"], "place", "value"), ["k", "level", "parent"])
    assert met.count() <= 50 * search.LEVELS
    assert {r.found for r in search.first_above(asked, rows, ["k"], "name", "place", "value").collect()} == {n - 1}


def test_next_place(spark):
    rows = spark.createDataFrame([("A", 1, False), ("A", 2, True), ("A", 3, False), ("A", 4, True), ("B", 1, True)], "k string, at int, bear boolean")
    got = rows.withColumn("n", search.next_place(["k"], "at", F.col("bear"), F.col("at"))).collect()
    assert sorted((r.k, r.at, r.n) for r in got) == sorted([("A", 1, 2), ("A", 2, 4), ("A", 3, 4), ("A", 4, None), ("B", 1, None)], key=str)


def test_a_million_bars_of_one_symbol(spark):
    """Setups that wait for the whole series: every thousandth bar breaks out, is retested, and only the last bar closes higher."""
    n = 1_000_000
    i = F.col("id")
    at = F.pmod(i, F.lit(1000))
    price = lambda a, b, c: F.when(at == 1, a).when(at == 2, b).otherwise(c)
    bars = spark.range(n).select(
        F.lit("A").alias("symbol"), (i * 3600).alias("ts_open"), (i + 1).cast("int").alias("idx"), F.lit(100.0).alias("open"), F.when(i == n - 1, 170.0).otherwise(price(150.0, 140.0, 120.0)).alias("high"),
        price(90.0, 80.0, 100.0).alias("low"), F.when(i == n - 1, 150.0).otherwise(price(140.0, 125.0, 118.0)).alias("close"), price(500.0, 50.0, 50.0).alias("volume"), F.lit(True).alias("bullish"),
        F.lit(110.0).alias("prior_high"), F.lit(50.0).alias("prior_volume"), F.lit(100.0).alias("atr"), F.lit(65.0).alias("rsi"),
    )
    assert [f.name for f in bars.schema] == [c.split()[0] for c in BARS.split(", ")]
    began = time.time()
    out = S.outcomes(bars, P).groupBy("outcome", F.col("next_bar.idx").alias("at")).count().collect()
    assert sum(r["count"] for r in out) == n // 1000 and all(r.outcome == "signal" for r in out)
    assert time.time() - began < 60
