"""op11 learns its layers from the whole training text, however large the corpus is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language_model as M


def test_all_training_text_is_trained_on(spark, monkeypatch):
    p = M.LmParams()
    with open(p.vocabulary, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    counts = np.full(M.encoder(ranks.value).n_vocab + 1, 20_000, np.int64)  # as of a corpus of a thousand million subwords
    docs = spark.range(40).select(F.concat_ws(" ", F.lit("one two three"), F.col("id").cast("string")).alias("text"))
    held, pairs = [], M.pairs

    def noted(sample, block):
        held.append(sample.agg(F.count(F.lit(1)), F.sum("tokens")).first())
        return pairs(sample, block)

    monkeypatch.setattr(M, "pairs", noted)
    M.fit(docs, counts, ranks)
    texts, tokens = held[0]
    encoding = M.encoder(ranks.value)
    assert texts == 40 and tokens == sum(1 + sum(len(M.subwords(encoding, w)) for w in f"one two three {k}".encode().split()) for k in range(40))
