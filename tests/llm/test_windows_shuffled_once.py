"""op11 shuffles its windows once for all rounds, trains on every token of long texts, and spreads copies over shards."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import language_model as M

TEXT = " ".join(f"word{k % 37} of number{k}" for k in range(3000))


@pytest.fixture
def given(spark):
    p = M.LmParams(width=4, hidden=6, block=16, least_tokens=1, most_passes=1, shard_tokens=4_000, rounds=3)
    with open(p.vocabulary, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    encoding = M.encoder(ranks.value)
    counts = np.bincount([i for word in TEXT.encode().split() for i in M.subwords(encoding, word)], minlength=encoding.n_vocab + 1)
    return p, ranks, counts


def test_long_texts_are_trained_on_whole(spark, given):
    p, ranks, counts = given
    docs = spark.createDataFrame([(TEXT,), ("a b",), (None,), ("",)], "text string")
    to, _ = M.own_ids(counts)
    rows = [np.frombuffer(r.windows, np.uint16).reshape(-1, 32) for r in M.drawn(docs.coalesce(1), ranks, to, 1.0, p.block).collect()]
    own = np.concatenate([r[:, 16:].ravel() for r in rows])
    encoding = M.encoder(ranks.value)
    expected = [[*(int(to[i]) for w in (t or "").encode().split() for i in M.subwords(encoding, w)), 0] for t in (TEXT, "a b", None, "")]
    assert own[own != M.PAD].tolist() == sum(expected, [])


def test_rounds_shuffle_no_windows(spark, given, monkeypatch):
    p, ranks, counts = given
    docs = spark.createDataFrame([(TEXT,)] * 20, "text string")

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    held, pairs = {}, M.pairs

    def noted(sample, block):
        held["shards"] = sample.select("shard").distinct().count()
        held["sizes"] = [len(r.windows) for r in sample.select("windows").collect()]
        out = pairs(sample, block)
        held["before"] = written()
        return out

    monkeypatch.setattr(M, "pairs", noted)
    M.fit(docs, counts * 20, ranks, p)
    assert held["shards"] > 20  # though all texts are copies
    assert written() - held["before"] < sum(held["sizes"]) / 4
