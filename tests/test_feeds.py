"""Feeds of message files as streams against the same messages as a table."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from tidemark.sources import messages as M


def given(rng, n):
    trade = lambda: {"product_id": rng.choice("AB"), "price": rng.choice(["1.5", "2", "no", None]) if rng.random() < 0.2 else "3.25", "size": "1", "time": "2024-01-01T00:00:00Z"}
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.1:
            out.append(rng.choice(["not json", "{}", "[]", '{"channel": "other"}']))
        elif kind < 0.2:
            out.append(json.dumps({"channel": "heartbeats", "events": [{"heartbeats": [{"product_id": "A", "time": "2024-01-01T00:00:01Z"}]}]}))
        else:
            out.append(json.dumps({"channel": "market_trades", "events": [{"trades": [trade() for _ in range(rng.randrange(4))]} for _ in range(rng.randrange(1, 3))]}))
    return out


def test_a_feed_cut_into_files_is_the_feed(spark, tmp_path):
    rng = random.Random(6)
    said = given(rng, 90)
    (tmp_path / "in").mkdir()
    cuts = [0, *sorted(rng.sample(range(1, 90), 5)), 90]
    take = M.feed_sink(f"file://{tmp_path}/out")

    def twice(batch, number):
        take(batch, number)
        take(batch, number)

    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        text = ("\r\n" if k % 2 else "\n").join([*said[a:b], "", " "])
        (tmp_path / f"in/feed-{k:05d}.jsonl").write_text(text)
        if k % 2:
            feed = M.message_files(spark, f"file://{tmp_path}/in", maxFilesPerTrigger="1")
            feed.writeStream.foreachBatch(twice).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    table = spark.createDataFrame(list(enumerate(said)), "seq long, value string")
    for name, part, columns in (("trades", M.trades, ["symbol", "price", "size"]), ("quarantine", M.quarantined, ["value", "bad"]), ("heartbeats", M.heartbeats, ["product"])):
        got = [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out/{name}").orderBy("seq").select(columns).collect()]
        assert got == [tuple(r) for r in part(table).orderBy("seq").select(columns).collect()] and got


def test_a_partitioned_log(spark):
    rows = spark.createDataFrame([(b"a", 1, 0), (b"b", 0, 0), (b"c", 1, 1)], "value binary, partition int, offset long")
    assert [r.value for r in M.log_messages(rows).orderBy("seq").collect()] == ["b", "a", "c"]
    assert M.log_messages(rows).select(F.countDistinct("seq")).first()[0] == 3
