"""op11 cuts a word into subwords once a task and adds up pairs by batches, with the windows and pairs of a plain loop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language_model as M


def test_words_are_cut_once(monkeypatch):
    p, cuts = M.LmParams(), []
    with open(p.vocabulary, "rb") as file:
        encoding = M.encoder(file.read())
    plain = M.subwords
    monkeypatch.setattr(M, "subwords", lambda e, w: cuts.append(w) or plain(e, w))
    to = np.arange(encoding.n_vocab + 1).astype(np.uint16)
    known = M.OwnIds(encoding, to)
    words = [b"alpha", b"beta", b"alpha", "été".encode(), b"x" * 200, b"beta"] * 50
    assert known.of(words).tolist() == [int(to[i]) for w in words for i in plain(encoding, w)]
    assert known.of([]).dtype == np.uint16 and len(cuts) == 4


def test_pairs_are_added_up_by_batches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    held = [M.windows(rng.integers(0, M.TOKENS, int(n)).astype(np.uint16), 16, bool(n % 2)) for n in rng.integers(1, 90, 30)]
    sample = spark.createDataFrame([(k, bytearray(w.tobytes())) for k, w in enumerate(held)], "h long, windows binary").coalesce(1)
    expected = np.zeros((M.TOKENS, M.TOKENS), np.float32)
    for w in held:
        for row in w:
            for i in range(16, 32):
                if row[i] != M.PAD:
                    expected[row[i - 1], row[i]] += 1
    assert np.array_equal(M.pairs(sample.where(F.col("h") >= 0), 16), expected)
    many = M.followed([w.tobytes() for w in held], 16)
    assert len(many) == sum(int((w[:, 16:] != M.PAD).sum()) for w in held)
