"""Quality classifier: a sparse rule ensemble over text statistics, compiled to Spark columns."""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import light_batches

STATS = (
    "log_words", "word_length", "upper", "digit", "symbol", "end_mark", "comma", "bar", "beyond_ascii",
    "distinct", "adjacent", "top_word", "one_char", "marked_words", "words_per_line", "empty_lines", "repeated_lines", "words_per_stop",
)
UPPER = bytes(range(65, 91))
DIGIT = bytes(range(48, 58))
SYMBOL = b"#$%&*@^~<>=+_\\{}[]"
HIGH = bytes(range(128, 256))


def statistics_of(text: str | None) -> tuple[float, ...]:
    """Statistics of a whole text, in the order of ``STATS``; zeros for null, empty and blank texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATS)
    n, size = len(words), sum(map(len, words))

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip()]
    marked = sum(1 for w in tally if w[-1:] in b"!#$%&*|" and w) / len(tally)
    return (
        float(np.log1p(n)), size / n, share(UPPER), share(DIGIT), share(SYMBOL), share(b"!?"), share(b",;"), share(b"|"), share(HIGH),
        len(tally) / n, sum(map(operator.eq, words, words[1:])) / n, max(tally.values()) / n, sum(1 for w in words if len(w) == 1) / n, marked,
        n / len(full), 1 - len(full) / len(lines), 1 - len(set(full)) / len(full), min(n / (share(b".") * size + 1), 1000.0),
    )


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """Adds a struct column of statistics."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t) for t in texts], columns=STATS)

    light_batches(docs.sparkSession)
    return docs.withColumn(name, stats(F.col("text")))


@dataclass(frozen=True)
class Condition:
    """statistic <= at, or > at."""

    stat: int
    at: float
    above: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.stat] > self.at) == self.above

    def column(self, stats: Column) -> Column:
        value = stats[STATS[self.stat]]
        return value > F.lit(self.at) if self.above else value <= F.lit(self.at)


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleModel:
    """Rules with weights, and the weight of no rule."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, stats: Column) -> Column:
        """Probability of label 1 as a Spark column."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(conjunction(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def conjunction(rule: Rule, stats: Column) -> Column:
    out = rule[0].column(stats)
    for c in rule[1:]:
        out = out & c.column(stats)
    return out


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: Rule = ()) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on gradients: the paths to all its nodes, and its value for each row."""
    value = np.full(len(x), gradient.sum() / (hessian.sum() + 1.0))
    if depth == 0 or len(x) < 2 * least:
        return [], value
    best, gain = None, 1e-6
    whole = gradient.sum() ** 2 / (hessian.sum() + 1.0)
    for stat, points in enumerate(cuts):
        if not len(points):
            continue
        place = np.searchsorted(points, x[:, stat], side="left")  # place <= k just where x <= points[k]
        n, g, h = (np.cumsum(np.bincount(place, w, len(points) + 1))[:-1] for w in (None, gradient, hessian))
        ok = (n >= least) & (len(x) - n >= least)
        found = np.where(ok, g**2 / (h + 1.0) + (gradient.sum() - g) ** 2 / (hessian.sum() - h + 1.0) - whole, -np.inf)
        k = int(found.argmax())
        if found[k] > gain:
            best, gain = (stat, float(points[k])), found[k]
    if best is None:
        return [], value
    rules: list[Rule] = []
    for above in (False, True):
        step = (*path, Condition(*best, above))
        rows = step[-1].holds(x)
        below, value[rows] = grow(x[rows], gradient[rows], hessian[rows], cuts, depth - 1, least, step)
        rules += [step, *below]
    return rules, value


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradients; the bias is free."""
    n, p = z.shape
    mean = z.mean(axis=0)
    a, bias = np.zeros(p), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    at, at_bias, t = a.copy(), bias, 1.0
    centred = z - mean
    v = np.ones(p)
    for _ in range(20):
        v = centred.T @ (centred @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1.0 / (0.25 * max(np.linalg.norm(centred @ v) ** 2 / n, 1.0) + 1e-9)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(centred @ at + at_bias, -35, 35))) - y
        new = at - step * (centred.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = at_bias - step * r.mean()
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        at, at_bias = new + (was - 1) / t * (new - a), new_bias + (was - 1) / t * (new_bias - bias)
        a, bias = new, new_bias
    return a, bias - float(mean @ a)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, least: int = 20, rate: float = 0.3, penalty: float = 4e-4, steps: int = 400) -> RuleModel:
    """Boost small trees, take each path as a rule, and keep the rules that a lasso logistic fit gives a weight."""
    least = max(1, min(least, len(x) // 20))
    cuts = []
    for k in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 50))) if len(x) else np.zeros(0)
        cuts.append(q[q < x[:, k].max()] if len(x) else q)
    total = np.zeros(len(x))
    found: dict[Rule, None] = {}
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        rules, value = grow(x, y - p, p * (1 - p), cuts, depth, least)
        total += rate * value
        found |= dict.fromkeys(rules)
    rules = list(found)
    if not rules:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return RuleModel((), (), float(np.log(share / (1 - share))))
    z = np.stack([np.logical_and.reduce([c.holds(x) for c in rule]) for rule in rules], axis=1).astype(float)
    weights, bias = lasso(z, y.astype(float), penalty, steps)
    kept = np.flatnonzero(np.abs(weights) > 1e-3)
    return RuleModel(tuple(rules[k] for k in kept), tuple(float(weights[k]) for k in kept), bias)


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", sample: int = 20_000) -> RuleModel:
    """Fit on labelled documents where ``train`` (a condition on doc_id) holds.

    At most ``sample`` ids are learned from, the first by hash of the id, so reruns agree and what reaches the driver
    is bounded: a row of statistics an id. An id with several labels counts as its largest, an id with several texts
    teaches by the one with the smallest statistics. Null labels and ids teach nothing; without two classes the model
    is a constant.
    """
    known = labels.where(F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    once = with_statistics(rows, "stats").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("stats").alias("stats"))
    ordered = once.select("doc_id", "y", "stats.*").toPandas().sort_values("doc_id")
    return fit_rules(ordered[list(STATS)].to_numpy(float), (ordered["y"] == 1).to_numpy(float))


def score(docs: DataFrame, model: RuleModel, name: str = "quality_score") -> DataFrame:
    """Adds the score of each whole text; a column of that name is replaced. Null and empty texts have statistics 0."""
    return with_statistics(docs.drop(name), name).withColumn(name, model.score(F.col(name)))
