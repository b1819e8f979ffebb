"""Language-model scores, Merkle manifests and spelling variants against plain loops."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_operators import odd_docs
from tidemark.llm import language_model as L
from tidemark.llm import merkle, spelling
from tidemark.llm.common import stored

SMALL = L.LmParams(width=4, hidden=6, block=4, least_tokens=60_000, most_passes=1, shard_tokens=20_000, rounds=2, head_words=50)


def held(doc_id, by):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % by == 0


# Language model


def random_model(rng, block=4):
    p = L.LmParams(width=4, hidden=6, block=block)
    m = L.started(rng.random(L.TOKENS) * 9, p)
    return {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in m.items()}


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    m = {k: v.astype(np.float64) for k, v in random_model(rng).items()}
    rows = rng.integers(0, L.TOKENS, (5, 8)).astype(np.uint16)
    rows[4, 6:] = L.PAD
    n = int((rows[:, 4:] != L.PAD).sum())
    _, g = L.gradients(m, rows, 3)
    for name, at in itertools.product(m, range(3)):
        flat = np.abs(g[name]).ravel()
        k = int(np.argsort(-flat)[at * 2 % flat.size])
        spot = np.unravel_index(k, m[name].shape)
        up, down = ({**m, name: m[name].copy()} for _ in range(2))
        up[name][spot] += 1e-3
        down[name][spot] -= 1e-3
        slope = -(L.gradients(up, rows, 3)[0] - L.gradients(down, rows, 3)[0]) / 2e-3 / n
        assert slope == pytest.approx(g[name][spot], rel=0.08, abs=5e-4), name


def test_scores_are_those_of_training_and_add_up_to_one():
    rng = np.random.default_rng(2)
    m = random_model(rng)
    rows = rng.integers(0, L.TOKENS, (6, 8))
    tables = L.tables({"parameters": m, "block": 4})
    assert L.log_probabilities(tables, rows).sum() == pytest.approx(L.gradients(m, rows.astype(np.uint16), 0)[0], rel=1e-5)
    for place in (4, 7):
        every = np.repeat(rows[:1], L.TOKENS, axis=0)
        every[:, place] = np.arange(L.TOKENS)
        assert np.exp(L.log_probabilities(tables, every)[:, place - 4]).sum() == pytest.approx(1, rel=1e-4)
    later = rows.copy()
    later[:, 7] = 5  # what comes later changes nothing
    assert np.array_equal(L.log_probabilities(tables, later)[:, :3], L.log_probabilities(tables, rows)[:, :3])


def test_classes_are_whole():
    new = L.classes(np.random.default_rng(3).integers(0, 3, (L.TOKENS, L.TOKENS)).astype(np.float32), 1)
    assert sorted(new.tolist()) == list(range(L.TOKENS))


def test_long_texts_in_parts_score_as_whole(monkeypatch):
    rng = np.random.default_rng(4)
    with open(L.LmParams().vocabulary, "rb") as file:
        ranks = file.read()
    counts = rng.integers(0, 50, L.encoder(ranks).n_vocab + 1)
    to, extra = L.own_ids(counts)
    model = {"parameters": random_model(rng), "end": 7, "to": to, "extra": extra, "block": 4}
    words = ["the", "wörd", "of", "Zebra,", "x" * 200, "a b", "éé", " "]
    texts = [" ".join(rng.choice(words, n)) for n in (700, 3, 1, 0, 90)] + [None, "", " \n ", "end"]
    whole = L.Scorer(model, ranks, {b"the": 5}).batch(texts)
    # Each text alone, its windows laid out one by one.
    encoding = L.encoder(ranks)
    for text, found, n in zip(texts, whole["score"], whole["n_words"], strict=True):
        own = (text or "").encode().lower().split()
        ids = [i for w in own for i in L.subwords(encoding, w)]
        tokens = [7] * 4 + [int(to[i]) for i in ids] + [7]
        tokens += [7] * (-len(tokens) % 4)
        rows = np.array([tokens[k : k + 8] for k in range(0, len(tokens) - 4, 4)])
        each = L.log_probabilities(L.tables(model), rows).ravel()[: len(ids) + 1]
        assert found == pytest.approx(each.sum() + sum(extra[i] for i in ids), rel=1e-5) and n == len(own)
    for size, at_once in ((40, 30), (7, 1), (1000, 8)):
        monkeypatch.setattr(L, "HELD_WORDS", at_once)
        monkeypatch.setattr(L, "SCORED_AT_ONCE", 64)
        monkeypatch.setattr(L.pieces, "__defaults__", (size,))
        parts = L.Scorer(model, ranks, {b"the": 5}).batch(texts)
        assert np.allclose(parts["score"], whole["score"], rtol=1e-5) and parts["rare"].map(sorted).tolist() == whole["rare"].map(sorted).tolist()
        assert parts["n_words"].tolist() == whole["n_words"].tolist() and np.allclose(parts["base"], whole["base"])


def base_of(docs):
    """n_tokens, n_known and base of each text, by plain counting."""
    tok = lambda t: (t or "").encode().lower().split()
    counts, ends = Counter(), 0
    for doc_id, text in docs:
        if not held(doc_id, 10):
            counts.update(tok(text))
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + (ends > 0)
    log = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    return [(doc_id, len(tok(t)) + 1, sum(w in counts for w in tok(t)) + (ends > 0), total, round(sum(log(counts[w]) for w in tok(t)) + log(ends), 6)) for doc_id, t in docs]


def of_scores(frame):
    return [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in frame.collect()]


def test_base_equals_plain_counting_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = stored(L.report(docs, SMALL), "scores")
    assert sorted(of_scores(out)) == sorted(base_of([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    again = {r.doc_id: r.score for r in L.report(docs, SMALL).select("doc_id", "score").collect()}
    assert all(r.score == pytest.approx(again[r.doc_id], rel=1e-4) for r in out.collect())


def test_scores_of_held_out_texts_beat_single_words(spark):
    out = L.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    better = out.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert better[2] > 50 and better[0] > better[1]


@pytest.mark.parametrize("kind", ["odd", "empty", "nothing to learn from"])
def test_scores_of_odd_texts(spark, kind):
    docs = odd_docs(spark)
    if kind == "empty":
        docs = docs.limit(0)
    elif kind != "odd":
        docs = spark.createDataFrame([(i, f"text {i}") for i in range(200) if held(i, 10)], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = stored(L.report(docs, SMALL), "scores")
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(of_scores(out), key=order) == sorted(base_of(rows), key=order)
    assert all(math.isfinite(r.score) and r.score < 0 and r.held_out == held(r.doc_id, 10) for r in out.collect())


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 5, 7, 8, 9, 31, 32, 33, 64, 67])
def test_places_in_the_log_are_those_of_appending(leaves):
    each = [sha(str(k)) for k in range(leaves)]
    log = merkle.completed(each, merkle.levels_of(leaves))
    tree = levels(each)
    assert len(log) == sum(map(len, tree))
    for level, nodes in enumerate(tree):
        for i, node in enumerate(nodes):
            assert log[merkle.position(level, i, leaves)] == node
    packed = bytes.fromhex("".join(log))
    for k, leaf in enumerate(each):
        assert merkle.folded(leaf, merkle.siblings(packed, k, leaves, merkle.levels_of(leaves))) == tree[-1][0]


def test_the_log_of_pages_is_one_log(spark):
    sizes = {"a": 23, "b": 1, "c": 16, "d": 17}
    each = {t: [sha(f"{t}{k}") for k in range(n)] for t, n in sizes.items()}
    nodes = spark.createDataFrame([(t, k, sizes[t], x) for t, xs in each.items() for k, x in enumerate(xs)], "tree string, idx long, n long, digest string")
    rows = merkle.log(merkle.tiers_of(nodes, 2), 2).collect()
    for t, xs in each.items():
        mine = sorted((r.position, r.digest) for r in rows if r.tree == t)
        assert [d for _, d in mine] == merkle.completed(xs, merkle.levels_of(len(xs))) and [p for p, _ in mine] == list(range(len(mine)))


def manifest_of(rows):
    """The report's rows by plain recursion. Rows: doc_id, text, lang, source, n_chars."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(map(said, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0], leaf(r)))
        made[lang] = levels([leaf(r) for r in trees[lang]])
    top = levels([made[x][-1][0] for x in langs])
    out = []
    for at, lang in enumerate(langs):
        for k, r in enumerate(trees[lang]):
            shown = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            proof = ""
            for tree, i in ((made[lang], k), (top, at)):
                for nodes in tree[:-1]:
                    run, own = nodes[i // 2 * 2 : i // 2 * 2 + 2], i % 2
                    others = [x for n, x in enumerate(run) if n != own]
                    proof += "".join(others)
                    shown = sha("".join([*others, shown] if own else [shown, *others]))
                    i //= 2
            out.append((r[0], leaf(r), made[lang][-1][0], top[-1][0], sha(proof), shown, shown == top[-1][0]))
    return out


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_equals_plain_recursion(spark, height):
    rng = random.Random(height)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "tëxt", "x" * 50, "y"]), rng.choice(["en", "en", "de", None, "é", "-"]), rng.choice([None, "s"]), rng.choice([None, 3])) for _ in range(90)]
    rows += [(5, "same", "en", None, 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").select("*", F.lit(1).alias("tree"), F.lit(2).alias("digest"), F.lit(3).alias("idx"))
    key = lambda r: tuple((v is not None, v) for v in r)
    got = sorted((tuple(r) for r in merkle.report(docs, height).collect()), key=key)
    assert got == sorted(manifest_of(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in merkle.report(docs).collect()), key=key) == sorted(manifest_of(rows), key=key)
    assert merkle.report(docs.limit(0)).count() == 0


# Spelling variants


def grouped(words):
    """form, root, n, n_near and form_n by trying all pairs."""
    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, out = {}, {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = (len(around), words[form[w]] if form[w] else None)
    roots = {}
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        roots[w] = r
    return sorted((w, form[w] or "", roots[w], n, out[w][0], out[w][1] or 0) for w, n in words.items())


@pytest.mark.parametrize(("symbols", "sent"), [(None, 10**6), (2, 10**6), (3, 0), (9, 0)])
def test_groups_equal_all_pairs(spark, monkeypatch, symbols, sent):
    monkeypatch.setattr(spelling, "CELLS", 400)
    rng = random.Random(7)
    words = {"".join(rng.choice("abà÷") for _ in range(rng.randrange(6, 9))): rng.choice([5, 6, 30, 31, 160, 900]) for _ in range(150)}
    words |= {"é" * 300: 5, "é" * 299: 60, "é" * 301: 60}
    frame = stored(spark.createDataFrame(list(words.items()), "word string, n long"), "words")
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.group(frame, symbols, sent).collect())
    assert got == grouped(words)
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of forms


def test_neighbourhoods_are_whole():
    rng = random.Random(3)
    for n in (1, 2, 5):
        word = [rng.randrange(3) for _ in range(n)]
        near = {tuple(word)} | {(*word[:k], s, *word[k + 1 :]) for k in range(n) for s in range(3)} | {(*word[:k], *word[k + 1 :]) for k in range(n)} | {(*word[:k], s, *word[k:]) for k in range(n + 1) for s in range(3)}
        wanted = {0 if not w else int(spelling.keys(np.array([w]), 3)[0]) for w in near}
        row, found = spelling.neighbourhood(np.array([word]), 3)
        assert sorted(found.tolist()) == sorted(wanted) and set(row) == {0}


def test_words_are_counted_with_typos(spark):
    rng = random.Random(9)
    texts = [(rng.choice([None, *range(300)]), rng.choice([None, "", "Straße Éclair ABCDEF abcdef x1abcdefg", " ".join("".join(rng.choice("abcdeÉ") for _ in range(rng.randrange(4, 9))) for _ in range(60))])) for _ in range(400)]
    wanted = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                wanted[run] += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert {r.word: r.n for r in spelling.counted(docs).collect()} == wanted


def test_words_of_odd_and_empty_tables(spark):
    assert spelling.report(odd_docs(spark).limit(0)).count() == 0
    many = odd_docs(spark).select("doc_id", F.lit("secretive secretive").alias("text"), F.lit(1).alias("n"))
    [row] = spelling.report(many).collect()
    assert (row.word, row.form, row.root, row.n_near) == ("secretive", None, "secretive", 0) and row.n >= 5
