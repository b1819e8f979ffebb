"""Scores of texts by a small causal self-attention model over subword ids, trained on the whole training text.

Subwords are the ids of a public byte-level vocabulary; the 1023 most frequent ones of the training words (all of them
counted) and the end of a text have ids of their own, the rest share one and are told apart by their counts. A text is
cut into blocks. The window of a block is itself and the block before it, so windows overlap and each token is scored
once. A token is predicted from the two before it and from attention over its window, first as one of 32 classes and then
as one of 32 tokens of that class.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import light_batches, stored

CLASSES = 32
TOKENS = CLASSES * CLASSES
OTHER, PAD = TOKENS - 1, 0xFFFF
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANK = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class LmParams:
    """``vocabulary``: file of ranks, read on the driver. ``share`` of the training text (all by default) is trained on, or what
    gives ``least_tokens`` if that is more; ``shard_tokens`` of it are trained on by a task, in ``rounds`` after each of which the
    tasks' models are averaged. Text of less than ``least_tokens`` is passed over again, ``most_passes`` times at most.
    ``head_words`` counts at most are sent to all tasks; the others are joined."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    width: int = 16
    hidden: int = 48
    block: int = 16
    share: float = 1.0
    least_tokens: int = 4_000_000
    shard_tokens: int = 1_000_000
    most_passes: int = 4
    rounds: int = 3
    batch: int = 64
    rate: float = 5e-3
    seed: int = 7
    head_words: int = 400_000


PIECE_BYTES = 1 << 20
#: Blocks of a part of a text that is dealt to a shard, and parts that a task hands over at once.
PART_BLOCKS, DRAWN_ROWS = 32, 10_000
#: Code points of a word that are cut into subwords at once.
WORD_PART = 48
HELD_WORDS = 300_000
SCORED_AT_ONCE = 8192


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, by parts of about ``size`` bytes that end between words."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            blank = BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        yield text[start:end].split()
        start = end


def lowered(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z in lower case; null is empty."""
    return text.encode().lower() if text else b""


def encoder(ranks: bytes) -> tiktoken.Encoding:
    """The vocabulary of a file of ranks."""
    lines = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={base64.b64decode(t): int(r) for t, r in lines}, special_tokens={})


def subwords(encoding: tiktoken.Encoding, word: bytes) -> list[int]:
    """Ids of a word with the space before it; very long words in parts."""
    text = " " + word.decode()
    if len(text) <= WORD_PART:
        return encoding.encode_ordinary(text)
    return [i for at in range(0, len(text), WORD_PART) for i in encoding.encode_ordinary(text[at : at + WORD_PART])]


def counted_words(docs: DataFrame) -> DataFrame:
    """word (UTF-8), n: words of all texts, added up in each task first."""
    light_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                for words in pieces(lowered(text)):
                    total.update(words)
                    if len(total) > HELD_WORDS:
                        yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                        total.clear()
        yield pd.DataFrame({"word": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    return docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def subword_counts(words: DataFrame, ranks) -> np.ndarray:
    """Occurrences of each subword id in all counted words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = encoder(ranks.value)
        total = np.zeros(encoding.n_vocab + 1, np.int64)
        for batch in batches:
            found = [subwords(encoding, w) for w in batch["word"]]
            sizes = [len(f) for f in found]
            total += np.bincount(np.concatenate([*map(np.array, found)]).astype(np.int64), weights=np.repeat(batch["n"].to_numpy(), sizes), minlength=len(total)).astype(np.int64)
        ids = np.nonzero(total)[0]
        yield pd.DataFrame({"id": ids, "n": total[ids]})

    summed = words.mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(encoder(ranks.value).n_vocab + 1, np.int64)
    out[np.array(summed["id"], np.int64)] = np.array(summed["n"], np.int64)
    return out


def own_ids(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id in the model of each subword (0 is the end of a text), and its log share among those that have no id of their own."""
    first = np.argsort(-counts, kind="stable")[: TOKENS - 2]
    to = np.full(len(counts), OTHER, np.uint16)
    to[first] = np.arange(1, TOKENS - 1)
    rest = np.where(to == OTHER, counts + 0.1, 0)
    extra = np.zeros(len(counts))
    extra[to == OTHER] = np.log(rest[to == OTHER] / rest.sum())
    return to, extra


def windows(ids: np.ndarray, block: int, start: bool) -> np.ndarray:
    """Windows of two blocks over ids: one for each block after the first, or for each if ``ids`` are the ``start`` of a text."""
    if start:
        ids = np.concatenate([np.zeros(block, np.uint16), ids])
    padded = np.full(-(-len(ids) // block) * block, PAD, np.uint16)
    padded[: len(ids)] = ids
    rows = padded.reshape(-1, block)
    return np.hstack([rows[:-1], rows[1:]])


class OwnIds(dict):
    """Ids in the model (as bytes) of the words met so far, so a word is cut once while it is held."""

    def __init__(self, encoding: tiktoken.Encoding, to: np.ndarray) -> None:
        self.encoding, self.to = encoding, to

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.to[subwords(self.encoding, word)].tobytes()
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > HELD_WORDS:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint16)


def parts(data: bytes, known: OwnIds, block: int) -> Iterator[np.ndarray]:
    """The ids of a text and its end in parts of ``PART_BLOCKS`` blocks, each after the block before it (ends, before the first)."""
    held = np.zeros(block, np.uint16)
    size = PART_BLOCKS * block
    for words in chain(pieces(data), [None]):
        held = np.concatenate([held, known.of(words) if words is not None else np.zeros(1, np.uint16)])
        # What is held back is less than a part and the block before it.
        whole = (len(held) - block) // size if words is not None else -(-(len(held) - block) // size)
        for k in range(whole):
            yield held[k * size : (k + 1) * size + block]
        held = held[whole * size :]


def drawn(docs: DataFrame, ranks, to: np.ndarray, share: float, block: int) -> DataFrame:
    """h, place, tokens, windows: windows over parts of texts, a ``share`` of all parts by their hash h. Each token of all parts
    is in the own block of one window. ``place`` is the number of the text in its task, so that copies differ."""
    limit = np.uint32(min(share, 1) * 0xFFFFFFFF)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, place = OwnIds(encoder(ranks.value), to), 0
        for batch in batches:
            rows = []
            for text in batch["text"]:
                data = lowered(text)
                seed = zlib.crc32(data)
                place += 1
                for k, ids in enumerate(parts(data, known, block)):
                    h = zlib.crc32(b"%d:%d" % (seed, k))
                    if h <= limit:
                        rows.append((h, place, len(ids) - block, windows(ids, block, False).tobytes()))
                    if len(rows) >= DRAWN_ROWS:
                        yield pd.DataFrame(rows, columns=["h", "place", "tokens", "windows"])
                        rows = []
            yield pd.DataFrame(rows, columns=["h", "place", "tokens", "windows"])

    return docs.select("text").mapInPandas(draw, "h long, place long, tokens long, windows binary")


def followed(rows: Iterable[bytes], block: int) -> np.ndarray:
    """A number for each token of the windows' own blocks and the token before it."""
    x = np.frombuffer(b"".join(rows), np.uint16).reshape(-1, 2 * block)
    now, then = x[:, block:], x[:, block - 1 : -1]
    there = now != PAD
    return then[there].astype(np.int64) * TOKENS + now[there]


def pairs(sample: DataFrame, block: int) -> np.ndarray:
    """How often each id follows each other in the drawn windows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(TOKENS * TOKENS, np.int64)
        for batch in batches:
            total += np.bincount(followed(batch["windows"], block), minlength=len(total))
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"pair": at, "n": total[at]})

    summed = sample.mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TOKENS * TOKENS, np.float32)
    out[np.array(summed["pair"], np.int64)] = np.array(summed["n"], np.float32)
    return out.reshape(TOKENS, TOKENS)


def classes(follows: np.ndarray, seed: int) -> np.ndarray:
    """New number of each id, so that 32 numbers in a row are a class of ids that stand in like places.

    Ids are halved along the main direction of the shares of what stands before and after them, five times.
    """
    rng = np.random.default_rng(seed)
    share = lambda x: np.sqrt(x) / np.sqrt(x.sum(axis=1, keepdims=True) + 1)
    places = np.hstack([share(follows.T), share(follows)])
    groups = [np.arange(TOKENS)]
    while len(groups) < CLASSES:
        halves = []
        for g in groups:
            x = places[g] - places[g].mean(axis=0)
            v = rng.normal(size=x.shape[1])
            for _ in range(30):
                v = x.T @ (x @ v)
                v /= np.linalg.norm(v) + 1e-9
            by = g[np.argsort(x @ v, kind="stable")]
            halves += [by[: len(by) // 2], by[len(by) // 2 :]]
        groups = halves
    new = np.empty(TOKENS, np.uint16)
    new[np.concatenate(groups)] = np.arange(TOKENS)
    return new


def started(frequency: np.ndarray, p: LmParams) -> dict[str, np.ndarray]:
    """Parameters before training; the outputs start at the frequencies of classes and of tokens in them."""
    rng = np.random.default_rng(p.seed)
    d, h = p.width, p.hidden
    normal = lambda scale, *shape: rng.normal(0, scale, shape)
    f = (frequency + 0.5).reshape(CLASSES, CLASSES)
    model = {
        "embedding": normal(0.1, TOKENS, d), "now": normal(d**-0.5, d, h), "before": normal(d**-0.5, d, h), "context": normal(d**-0.5, d, h), "bias": np.zeros(h),
        "query": normal(d**-0.5, d, d), "key": normal(d**-0.5, d, d), "value": normal(d**-0.5, d, d), "distance": np.zeros(2 * p.block),
        "class": normal(0.05, h, CLASSES), "class_bias": np.log(f.sum(axis=1) / f.sum()),
        "token": normal(0.05, CLASSES, h, CLASSES), "token_bias": np.log(f / f.sum(axis=1, keepdims=True)),
    }
    return {k: v.astype(np.float32) for k, v in model.items()}


def away(block: int) -> np.ndarray:
    """Distance from each token that predicts (the row) to each token of its window; negative where it comes later."""
    return np.arange(block)[:, None] + block - 1 - np.arange(2 * block - 1)[None, :]


def flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def raised(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """exp(x) in place, for values between ``low`` and ``high``; each row is shifted first if these leave what single precision holds."""
    if not (low > -60 and high < 60):
        x -= x.max(axis=-1, keepdims=True)
    return np.exp(x, out=x)


class Step:
    """Parameters as one array ``w`` and gradients of a batch as one array ``g``, both laid out in few matrices.

    Biases are the last rows of their matrices: inputs end with a one, and a fixed column of the first layer hands it on.
    """

    def __init__(self, m: dict[str, np.ndarray]) -> None:
        self.kinds = {k: v.dtype for k, v in m.items()}
        self.d, self.hidden = m["now"].shape
        first = np.vstack([m["now"], m["before"], m["context"], m["bias"]])
        fixed = np.zeros((len(first), 1), first.dtype)
        fixed[-1] = 1
        held = [
            m["embedding"], np.hstack([first, fixed]), np.hstack([m["query"], m["key"], m["value"]]), m["distance"],
            np.vstack([m["class"], m["class_bias"]]), np.concatenate([m["token"], m["token_bias"][:, None]], axis=1),
        ]
        self.shapes = [x.shape for x in held]
        self.w = np.concatenate([x.ravel() for x in held])
        self.g = np.zeros_like(self.w)
        self.weights, self.slopes = self.parts(self.w), self.parts(self.g)
        self.by_token = [(w, w.T, g) for w, g in zip(self.weights[-1], self.slopes[-1], strict=True)]

    def parts(self, values: np.ndarray) -> list[np.ndarray]:
        """Views of a laid out array as matrices."""
        ends = np.cumsum([math.prod(s) for s in self.shapes])
        return [values[end - math.prod(s) : end].reshape(s) for end, s in zip(ends, self.shapes, strict=True)]

    def named(self, values: np.ndarray) -> dict[str, np.ndarray]:
        """Copies of a laid out array's parameters by their names, in the order of the model."""
        d, h = self.d, self.hidden
        embedding, first, qkv, distance, by_class, by_token = self.parts(values)
        out = {
            "embedding": embedding, "now": first[:d, :h], "before": first[d : 2 * d, :h], "context": first[2 * d : -1, :h], "bias": first[-1, :h],
            "query": qkv[:, :d], "key": qkv[:, d : 2 * d], "value": qkv[:, 2 * d :], "distance": distance,
            "class": by_class[:-1], "class_bias": by_class[-1], "token": by_token[:, :-1], "token_bias": by_token[:, -1],
        }
        return {k: out[k].copy() for k in self.kinds}

    def slope(self, rows: np.ndarray, end: int, loss: bool = False) -> float:
        """Sets ``g`` to the gradients of the windows' mean loss; gives the sum of log probabilities of their own tokens if asked."""
        embedding, first, qkv, shift, by_class, _ = self.weights
        g_embedding, g_first, g_qkv, g_shift, g_class, g_token = self.slopes
        kind, d, block, n_rows = self.w.dtype, self.d, rows.shape[1] // 2, len(rows)
        scale = kind.type(d**-0.5)
        distance = away(block)
        nearest = np.maximum(distance, 0)
        s = np.where(rows == PAD, end, rows)[:, :-1].astype(np.int64)
        e = embedding.take(s, axis=0)
        kv = (flat(e) @ qkv[:, d:]).reshape(n_rows, -1, 2 * d)
        k, v = kv[:, :, :d], kv[:, :, d:]
        x = np.empty((n_rows, block, 3 * d + 1), kind)
        x[:, :, :d], x[:, :, d : 2 * d], x[:, :, -1] = e[:, block - 1 :], e[:, block - 2 : -1], 1
        q = (flat(x)[:, :d] @ qkv[:, :d]).reshape(n_rows, block, d)
        q *= scale
        a = q @ k.transpose(0, 2, 1)
        low, high = a.min() + shift.min(), a.max() + shift.max()
        a += np.where(distance >= 0, shift[nearest], kind.type(-1e9))
        raised(a, low, high)
        a *= (1 / (a @ np.ones(a.shape[2], kind)))[:, :, None]
        context = a @ v
        x[:, :, 2 * d : -1] = context
        x = flat(x)
        h = x @ first
        np.maximum(h, 0, out=h)
        own = rows[:, block:].ravel()
        of = np.where(own == PAD, CLASSES, own // CLASSES).astype(np.uint8)
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(CLASSES + 1, dtype=np.uint8)).tolist()
        n = ends[-1]
        there = order[:n]
        z, of, inside, row = h.take(there, axis=0), of[there], (own % CLASSES)[there], np.arange(n)
        y, part = np.empty((2, n, CLASSES), kind), np.empty_like(z)
        np.matmul(z, by_class, out=y[0])
        of_class = [(z[i:j], y[1, i:j], part[i:j], *held) for i, j, held in zip(ends, ends[1:], self.by_token, strict=False) if i < j]
        for zc, yc, _, w, _, _ in of_class:
            np.dot(zc, w, yc)
        raised(y, y.min(initial=0), y.max(initial=0))
        y *= (1 / (y @ np.ones(CLASSES, kind)))[:, :, None]
        total = float(np.log(y[0, row, of]).sum() + np.log(y[1, row, inside]).sum()) if loss else 0.0

        y[0, row, of] -= 1
        y[1, row, inside] -= 1
        y *= kind.type(1 / max(n, 1))
        np.matmul(z.T, y[0], out=g_class)
        dz = y[0] @ by_class.T
        g_token[:] = 0
        for zc, yc, pc, _, back, g in of_class:
            np.dot(zc.T, yc, g)
            np.dot(yc, back, pc)
        dz += part
        dz *= z > 0
        dh = np.zeros_like(h)
        dh[there] = dz
        np.matmul(x.T, dh, out=g_first)
        g_first[:, -1] = 0
        dx = (dh @ first.T).reshape(n_rows, block, -1)
        dcontext = dx[:, :, 2 * d : -1]
        da = dcontext @ v.transpose(0, 2, 1)
        da -= np.einsum("ijk,ijk->ij", dcontext, context)[:, :, None]
        da *= a
        g_shift[:] = np.bincount(nearest.ravel(), np.ones(n_rows, kind) @ da.reshape(n_rows, -1), minlength=len(shift))
        dkv = np.empty_like(kv)
        dkv[:, :, d:] = a.transpose(0, 2, 1) @ dcontext
        dkv[:, :, :d] = da.transpose(0, 2, 1) @ q
        dq = da @ k
        dq *= scale
        g_qkv[:, :d], g_qkv[:, d:] = x[:, :d].T @ flat(dq), flat(e).T @ flat(dkv)
        de = (flat(dkv) @ qkv[:, d:].T).reshape(e.shape)
        de[:, block - 1 :] += dx[:, :, :d]
        de[:, block - 1 :] += (flat(dq) @ qkv[:, :d].T).reshape(n_rows, block, d)
        de[:, block - 2 : -1] += dx[:, :, d : 2 * d]
        g_embedding.ravel()[:] = np.bincount((s.ravel()[:, None] * d + np.arange(d)).ravel(), de.ravel(), minlength=embedding.size)
        return total


def gradients(m: dict[str, np.ndarray], rows: np.ndarray, end: int) -> tuple[float, dict[str, np.ndarray]]:
    """Sum of log probabilities of windows' own tokens, and the gradients of their mean loss."""
    step = Step(m)
    total = step.slope(rows, end, loss=True)
    return total, step.named(step.g)


def trained(m: dict[str, np.ndarray], rows: np.ndarray, end: int, p: LmParams, part: tuple[int, int]) -> dict[str, np.ndarray]:
    """The model after a pass over windows in their order (Adam; the rate falls over all rounds, ``part`` is (round, rounds))."""
    step = Step(m)
    w, g = step.w, step.g
    first, second, move = (np.zeros_like(w) for _ in range(3))
    starts = range(0, len(rows), p.batch)
    for n, at in enumerate(starts, 1):
        left = 1 - (part[0] + n / (len(starts) + 1)) / part[1]
        rate = p.rate * min(1, n / 50) * (0.02 + 0.98 * left)
        step.slope(rows[at : at + p.batch], end)
        # ``first`` and ``second`` are sums: the means are a tenth and a hundredth of them.
        root = math.sqrt(0.01 / (1 - 0.99**n))
        least, by = np.float32(1e-8 / root), np.float32(0.1 * rate / (1 - 0.9**n) / root)
        first *= np.float32(0.9)
        first += g
        second *= np.float32(0.99)
        g *= g
        second += g
        np.sqrt(second, out=move)
        move += least
        np.divide(first, move, out=move)
        move *= by
        w -= move
    return step.named(step.w)


def packed(m: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([v.ravel() for v in m.values()]).tobytes()


def unpacked(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    values, at, out = np.frombuffer(data, np.float32), 0, {}
    for k, v in like.items():
        out[k] = values[at : at + v.size].reshape(v.shape).copy()
        at += v.size
    return out


def averaged(group: pd.DataFrame) -> pd.DataFrame:
    """One row for some models: their mean by the windows that each has seen."""
    seen = group["seen"].to_numpy(float)
    mean = sum(np.frombuffer(m, np.float32) * np.float32(n / seen.sum()) for m, n in zip(group["model"], seen, strict=True))
    return pd.DataFrame({"model": [mean.astype(np.float32).tobytes()], "seen": [int(seen.sum())]})


def runs(batches: Iterable[pd.DataFrame], block: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard and windows of each run of rows of one shard."""
    shard, held = None, []
    for batch in batches:
        for this, windows_here in zip(batch["shard"], batch["windows"], strict=True):
            if this != shard and held:
                yield int(shard), np.frombuffer(b"".join(held), np.uint16).reshape(-1, 2 * block)
                held = []
            shard = this
            held.append(windows_here)
    if held:
        yield int(shard), np.frombuffer(b"".join(held), np.uint16).reshape(-1, 2 * block)


def learner(now, new: np.ndarray, end: int, p: LmParams, turn: int, passes: int, folds: int):
    """A round over its part of ``passes`` passes over the windows of each shard, from the model ``now``; the mean of a task's models."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = 0, 0
        for shard, rows in runs(batches, p.block):
            rng = np.random.default_rng(p.seed + shard)
            order = np.concatenate([rng.permutation(len(rows)) for _ in range(passes)])
            rows = rows[np.array_split(order, p.rounds)[turn]]
            if len(rows):
                rows = np.where(rows == PAD, np.uint16(PAD), new[np.minimum(rows, OTHER)])
                total = total + np.frombuffer(packed(trained(now.value, rows, end, p, (turn, p.rounds))), np.float32) * float(len(rows))
                seen += len(rows)
        if seen:
            yield pd.DataFrame({"fold": [TaskContext.get().partitionId() % folds], "model": [(total / seen).astype(np.float32).tobytes()], "seen": [seen]})

    return learn


def fit(docs: DataFrame, counts: np.ndarray, ranks, p: LmParams = LmParams()) -> dict:
    """The model after training on ``docs`` (or a share of them, if the parameters ask for less); ``counts`` of subwords are those of all training words.

    Parts of texts are dealt to shards by hash and stored in the order of shards; each task trains on its shards, one at a time and
    each from the same start, and the models are averaged after each round, so the work grows with the corpus and no task holds
    more than a shard. The windows are shuffled once for all rounds. Reruns over the same files agree but for the order of
    equal rows. Without training text the model keeps its start.
    """
    spark = docs.sparkSession
    to, extra = own_ids(counts)
    tokens = int(counts.sum())
    share = min(1.0, max(p.share, p.least_tokens / max(tokens, 1)))
    shards = max(1, math.ceil(tokens * share / p.shard_tokens))
    dealt = drawn(docs, ranks, to, share, p.block).withColumn("shard", F.pmod(F.xxhash64("h", "place"), F.lit(shards)))
    # Shuffled once, here: the shards lie one after another in what is stored, so that rounds read and train without a shuffle.
    sample = stored(dealt.repartition("shard").sortWithinPartitions("shard", "h", "windows"), "windows")
    follows = pairs(sample, p.block)
    new = classes(follows, p.seed)
    frequency = np.zeros(TOKENS)
    frequency[new] = follows.sum(axis=0)
    m, end = started(frequency, p), int(new[0])
    held = sample.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    folds = math.ceil(math.sqrt(shards))
    passes = min(p.most_passes, max(1, round(p.least_tokens / max(held, 1))))
    for turn in range(p.rounds if held else 0):
        now = spark.sparkContext.broadcast(m)
        learned = sample.select("shard", "windows").mapInPandas(learner(now, new, end, p, turn, passes, folds), "fold int, model binary, seen long")
        means = learned.groupBy("fold").applyInPandas(averaged, "model binary, seen long").toPandas()
        if len(means):
            m = unpacked(averaged(means)["model"].iloc[0], m)
        now.unpersist()
    return {"parameters": m, "end": end, "to": new[to], "extra": extra, "block": p.block}


def tables(model: dict) -> dict[str, np.ndarray]:
    """What scoring looks up by token, computed once. A column of ones beside the values adds up attention; one in the
    hidden layer holds the biases of the outputs."""
    m, block = model["parameters"], model["block"]
    e, distance = m["embedding"], away(block)
    wide = lambda x, fill: np.hstack([x, np.full((len(x), 1), fill, np.float32)])
    query = e @ m["query"] * np.float32(m["query"].shape[0] ** -0.5)
    mask = np.where(distance >= 0, m["distance"][np.maximum(distance, 0)], -1e9).astype(np.float32)
    return {
        "query": query, "key": e @ m["key"], "value": wide(e @ m["value"], 1), "mask": mask, "peak": (query @ (e @ m["key"]).T).max() + mask.max(),
        "now": wide(e @ m["now"] + m["bias"], 1), "before": wide(e @ m["before"], 0), "context": wide(m["context"], 0),
        "class": np.vstack([m["class"], m["class_bias"]]), "token": np.concatenate([m["token"], m["token_bias"][:, None, :]], axis=1),
    }


def log_probabilities(t: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Log probability of each token of the windows' own blocks (a row a window)."""
    block = rows.shape[1] // 2
    of_token = lambda name, ids: np.take(t[name], ids, axis=0, mode="clip")
    seen, now = rows[:, :-1], rows[:, block - 1 : -1]
    a = of_token("query", now) @ of_token("key", seen).transpose(0, 2, 1)
    a += t["mask"]
    if t["peak"] > 60:
        np.minimum(a, 60, out=a)
    np.exp(a, out=a)
    context = a @ of_token("value", seen)
    context = context[:, :, :-1] / context[:, :, -1:]
    z = flat(context) @ t["context"]
    z += of_token("now", now.ravel())
    z += of_token("before", rows[:, block - 2 : -2].ravel())
    np.maximum(z, np.float32(0), out=z)
    target = rows[:, block:].ravel()
    of = (target // CLASSES).astype(np.uint8)
    order = np.argsort(of, kind="stable")
    z, of, inside, row = np.take(z, order, axis=0, mode="clip"), of[order], target[order] % CLASSES, np.arange(len(order))
    ends = np.searchsorted(of, np.arange(CLASSES + 1))
    by_token = np.empty((len(z), CLASSES), np.float32)
    for c in range(CLASSES):
        i, j = ends[c], ends[c + 1]
        np.matmul(z[i:j], t["token"][c], out=by_token[i:j])
    found, ones = np.zeros(len(z)), np.ones(CLASSES, np.float32)
    for x, hit in ((z @ t["class"], of), (by_token, inside)):
        np.minimum(x, np.float32(80), out=x)
        found += x[row, hit]
        np.exp(x, out=x)
        found -= np.log(x @ ones)
    out = np.empty(len(z))
    out[order] = found
    return out.reshape(-1, block)


class Words(dict):
    """Number of each word met so far in the order of meeting; :meth:`settle` adds what the new ones look like in the model."""

    def __init__(self, encoding: tiktoken.Encoding, to: np.ndarray, extra: np.ndarray, head: dict[bytes, int]) -> None:
        self.encoding, self.encode, self.to, self.extra, self.head = encoding, encoding.encode_ordinary, to, extra, head
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: tuple[list[int], list[int], list[int]] = ([], [], [])
        self.ids, self.sizes, self.counts, self.costs = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float))

    def __missing__(self, word: bytes) -> int:
        found = self.encode(" " + word.decode()) if len(word) < WORD_PART else subwords(self.encoding, word)
        ids, sizes, counts = self.fresh
        ids += found
        sizes.append(len(found))
        counts.append(self.head.get(word, -1))
        n = self[word] = len(self)
        return n

    def settle(self) -> None:
        """Subwords in the model, count (-1 beyond the head) and cost of rare subwords of each word, by its number."""
        ids, sizes, counts = (np.array(x, np.int64) for x in self.fresh)
        if len(sizes):
            self.costs = np.append(self.costs, np.add.reduceat(self.extra[ids], np.cumsum(sizes) - sizes))
            self.ids, self.sizes, self.counts = np.append(self.ids, self.to[ids]), np.append(self.sizes, sizes), np.append(self.counts, counts)
            self.fresh = ([], [], [])


class Scorer:
    """Adds up, for each text of a batch, what its words and blocks give. Texts come part by part, in order."""

    def __init__(self, model: dict, ranks: bytes, head: dict[bytes, int]) -> None:
        self.tables, self.end, self.block = tables(model), model["end"], model["block"]
        self.words = Words(encoder(ranks), model["to"].astype(np.int64), model["extra"], head)

    def batch(self, texts: list[str | None]) -> pd.DataFrame:
        """n_tokens, n_known and base (over words of the head), rare (the other words) and score (natural logarithm) of each text."""
        n = len(texts)
        self.n_words, self.n_known, self.base, self.score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        self.rare: list[list[bytes]] = [[] for _ in range(n)]
        self.waiting: list[tuple[int, list[bytes], bool]] = []
        self.left = (-1, np.zeros(0, np.int64), self._blank())
        held = 0
        for doc, text in enumerate(texts):
            data = lowered(text)
            parts = pieces(data) if data else iter([[]])
            part = next(parts, [])
            while part is not None:
                after = next(parts, None)
                self.waiting.append((doc, part, after is None))
                held += len(part)
                if held > HELD_WORDS:
                    self._flush()
                    held = 0
                part = after
        self._flush()
        return pd.DataFrame({"n_words": self.n_words, "n_known": self.n_known, "base": self.base, "rare": self.rare, "score": self.score})

    def _blank(self) -> np.ndarray:
        return np.full(self.block, self.end, np.int64)

    def _flush(self) -> None:
        """Scores what waits; of a text that goes on, the tokens of its last block are kept back."""
        if not self.waiting:
            return
        if len(self.words) > HELD_WORDS or len(self.words.ids) > 8 * HELD_WORDS:
            self.words.forget()
        words = [w for _, part, _ in self.waiting for w in part]
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        self.words.settle()
        doc_of = np.repeat([d for d, _, _ in self.waiting], [len(part) for _, part, _ in self.waiting])
        n = len(self.score)
        counts = self.words.counts[at]
        self.n_words += np.bincount(doc_of, minlength=n)
        self.n_known += np.bincount(doc_of[counts >= 0], minlength=n)
        self.base += np.bincount(doc_of[counts >= 0], np.log10(counts[counts >= 0] + 0.1), minlength=n)
        for i in np.nonzero(counts < 0)[0]:
            self.rare[doc_of[i]].append(words[i])
        starts = np.cumsum(self.words.sizes) - self.words.sizes
        many = self.words.sizes[at]
        self.score += np.bincount(doc_of, self.words.costs[at], minlength=n)
        ends = np.cumsum(many)
        ids = self.words.ids[np.repeat(starts[at] - (ends - many), many) + np.arange(ends[-1])] if len(at) else at
        split = np.concatenate([[0], ends])[np.cumsum([len(part) for _, part, _ in self.waiting])]
        rows, tails, docs = [], [], []
        start = 0
        for (doc, _, last), stop in zip(self.waiting, split, strict=True):
            own, before = ids[start:stop], self._blank()
            start = stop
            if self.left[0] == doc:
                own, before = np.concatenate([self.left[1], own]), self.left[2]
            if last:
                own = np.append(own, self.end)
                self.left = (-1, own[:0], before)
            else:
                keep = len(own) // self.block * self.block
                own, rest = own[:keep], own[keep:]
                self.left = (doc, rest, own[-self.block :] if keep else before)
            blocks = -(-len(own) // self.block)
            padded = np.full((blocks + 1) * self.block, self.end, np.int64)
            padded[: self.block] = before
            padded[self.block : self.block + len(own)] = own
            padded = padded.reshape(-1, self.block)
            rows.append(np.hstack([padded[:-1], padded[1:]]))
            docs.append(np.full(blocks, doc))
            sizes_here = np.full(blocks, self.block)
            if blocks:
                sizes_here[-1] = len(own) - (blocks - 1) * self.block
            tails.append(sizes_here)
        rows, docs, tails = np.concatenate(rows), np.concatenate(docs), np.concatenate(tails)
        step = max(1, SCORED_AT_ONCE // self.block)
        for k in range(0, len(rows), step):
            found = log_probabilities(self.tables, rows[k : k + step])
            found[np.arange(self.block)[None, :] >= tails[k : k + step, None]] = 0
            self.score += np.bincount(docs[k : k + step], found.sum(axis=1), minlength=n)
        self.waiting = []


def head_of(words: DataFrame, most: int) -> tuple[int, dict[bytes, int]]:
    """The least count that leaves ``most`` words or fewer, and these words' counts."""
    held, least = 0, 1 << 62
    by_count = words.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    running = by_count.orderBy(F.desc("n")).limit(most).collect()
    for r in running:
        held += r["words"]
        if held > most:
            break
        least = r["n"]
    found = words.where(F.col("n") >= least).toArrow()
    return least, dict(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True))


def report(docs: DataFrame, p: LmParams = LmParams()) -> DataFrame:
    """Scores of all documents: by the model, and by counts of single words as a base. README gives the fields.

    Documents whose id's crc32 leaves 0 modulo 10 are held out; those with a null id aren't. Null, empty and blank texts are
    an end alone. Repeated rows are scored each, alike. Very long texts are scored part by part. With no training document
    counts are 0 and the model is that before training. An empty table has no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    light_batches(spark)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    training = rows.where("NOT held_out")
    with open(p.vocabulary, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    words = stored(counted_words(training), "words")
    ends = training.count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens, kinds = total + ends, distinct + (ends > 0)
    model = spark.sparkContext.broadcast(fit(training, subword_counts(words, ranks), ranks, p))
    least, counts = head_of(words, p.head_words)
    head = spark.sparkContext.broadcast(counts)
    end_base = math.log10(ends + 0.1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.value, ranks.value, head.value)
        for batch in batches:
            found = scorer.batch(batch["text"].tolist())
            found.insert(0, "held_out", batch["held_out"].to_numpy())
            found.insert(0, "doc_id", batch["doc_id"])
            found["score"] /= math.log(10)
            yield found

    kind = dict(docs.dtypes)["doc_id"]
    scored = rows.mapInPandas(score, f"doc_id {kind}, held_out boolean, n_words long, n_known long, base double, rare array<binary>, score double")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(words.where(F.col("n") < least), "word", "left")
    rare = rare.groupBy("row").agg(F.count("n").alias("known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"))
    whole = scored.drop("rare").join(rare, "row", "left")
    n_tokens = F.col("n_words") + 1
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end_base) - n_tokens * F.lit(math.log10(train_tokens + 0.1 * (kinds + 1)))
    known = F.col("n_known") + F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))
    return whole.select("doc_id", "held_out", n_tokens.cast("long").alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
