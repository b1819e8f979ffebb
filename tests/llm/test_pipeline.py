"""Stages of the corpus pipeline, each on what its predecessor kept, against brute force."""

from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_operators import groups_by_force, near_by_force
from tidemark.llm import decontaminate


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of documents and of each stage's result, by stage name."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        if name != "mixing":
            assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        made.write.parquet(f"file://{root}/{name}")
        docs = spark.read.parquet(f"file://{root}/{name}")
        out[name] = docs.collect()
    return out


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_quality_keeps_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = by_id(stages["quality"])
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_lines(stages):
    seen, wanted = [], {}
    for r in sorted(stages["quality"], key=lambda r: r.doc_id):
        kept = []
        for line in (r.text or "").split("\n"):
            w = line.split(" ")
            if not (line.strip() and any(near_by_force(w, x, 8) for x in seen)):
                kept.append(line)
            if line.strip():
                seen.append(w)
        text = "\n".join(kept)
        if text.strip() or text == (r.text or ""):
            wanted[r.doc_id] = text
    assert {r.doc_id: r.text for r in stages["lines"]} == wanted
    assert all(r.n_chars == len(r.text) for r in stages["lines"])


def test_near_duplicates(stages):
    rows = sorted(stages["lines"], key=lambda r: r.doc_id)
    groups = groups_by_force([r.text for r in rows], 5, 80)
    assert sorted(r.doc_id for r in stages["near-duplicates"]) == [r.doc_id for k, r in enumerate(rows) if groups[k][1] == k]


def test_decontamination(spark, stages):
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for _, w in items if w for k in range(len(w) - min(10, len(w)) + 1)}
    wanted = {}
    for r in stages["near-duplicates"]:
        words = decontaminate.words_of(r.text)
        hit = {x for n in {len(w) for w in windows} for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for x in range(k, k + n)}
        if len(hit) <= 0.5 * len(words):
            wanted[r.doc_id] = [w for k, w in enumerate(words) if k not in hit]
    assert {r.doc_id: decontaminate.words_of(r.text) for r in stages["decontamination"]} == wanted


def test_mix(stages):
    before = by_id(stages["decontamination"])
    taken, target = defaultdict(int), {}
    for r in stages["mixing"]:
        assert 0 < r.taken <= 2 * r.size and r.text == before[r.doc_id].text
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_run_equals_its_stages(spark, stages):
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages["mixing"]))


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, lines int, found int, size int"


def odd_stages(spark, rows):
    """Rows of each stage (id, text), each stage on the given rows."""
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], ODD)
    return {name: sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=str) for name, stage in corpus_pipeline.STAGES[1:]}


def test_stages_on_nulls_repeated_rows_and_clashing_names(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(None, None, None, None, None), (None, long, None, "s", None), (1, "", None, None, 0), (1, " \n ", "en", "s", 3), (2, f"{long}\nown words", "en", "s", 3), (2, f"{long}\nown words", "en", "s", 3), (3, None, "en", None, 1), (4, long, None, "s", 1)]
    out = odd_stages(spark, rows)
    both = [(2, f"{long}\nown words")] * 2
    plain = [(None, None), (1, ""), (1, " \n "), (3, None)]
    # The line goes from 4 and from the row without an id, which lose all words and go.
    assert out["lines"] == sorted([*plain, *both], key=str)
    # One row of an id stays, the first by text; 4 and the pair of 2 are too unlike to link.
    assert out["near-duplicates"] == sorted([(None, None), (None, long), (1, ""), both[0], (3, None), (4, long)], key=str)
    assert out["decontamination"] == sorted([*plain, *both, (None, long), (4, long)], key=str)
    assert {t for _, t in out["mixing"]} <= {long, both[0][1]} and out["mixing"]


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_quality_judges_odd_rows_alike(spark):
    docs = spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, 4) for i, t in [(None, None), (5, None), (5, ""), (6, " \n"), (7, "a word"), (7, "a word")]], ODD)
    kept = [r.text for r in corpus_pipeline.good_quality(spark, docs, SF).collect()]
    assert len([t for t in kept if not (t or "").strip()]) in (0, 4) and kept.count("a word") in (0, 2)
