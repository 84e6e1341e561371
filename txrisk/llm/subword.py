"""A quality classifier of supervised subword embeddings.

Each word gives hashed features: the word itself, its character n-grams, and two bigrams with the word
before it, one of the words and one of their pattern (equal or not), as n-grams over a text whose words
are left open.  All weigh the same; their learned vectors are averaged over
the whole text and a softmax over two classes follows; numpy stochastic gradient descent trains both.

After training, a feature matters only through its vector's product with the output weights, so a
document's score needs one number per feature: a table of fixed size (``BUCKETS`` doubles, 1 MB) is
all that executors get.

Training uses a bounded sample: ``SAMPLE`` labelled documents of each class with the smallest hash of
their id, outside the held-out fold.  Texts of one id that repeats count once; several labels of one
id are averaged.  Without labels of both classes every score is the share of label 1 (one half if
there is none).  Null and empty texts score by the bias alone; ids, sources and languages are never
inputs.  Texts are read in pieces of ``PIECE`` bytes, cut between words, so memory does not grow with them; a
word longer than a piece counts as several.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

BUCKETS = 1 << 17
NGRAMS = (3, 4)
SAMPLE = 600
FOLDS = 5
#: Steps of the descent at least: a few labels are read more often.
LEAST_STEPS = 240
#: Bytes of text that are held as arrays at a time.
PIECE = 1 << 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    global _power_tables
    if len(_power_tables[0]) < n:
        m = max(n, 2 * len(_power_tables[0]), 1 << 16)
        _power_tables = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, INVERSE))
    return _power_tables[0][:n], _power_tables[1][:n]


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)
_power_tables: tuple = (np.zeros(0, np.uint64),) * 2
WHITE = (9, 10, 11, 12, 13, 32)
SPACE = np.zeros(256, bool)
SPACE[list(WHITE)] = True


def _bucket(h: np.ndarray) -> np.ndarray:
    """Hashes to feature numbers from 1."""
    return 1 + (((h ^ (h >> np.uint64(29))) * MIX) >> np.uint64(34)).astype(np.int64) % (BUCKETS - 1)


def pieces(text: bytes) -> Iterator[tuple[bytes, int]]:
    """(piece, bytes of the word before it that it begins with) of a text, cut between words."""
    lo, before = 0, b""
    while True:
        hi = len(text)
        if hi - lo > PIECE:
            hi = lo + PIECE
            cut = max(text.rfind(bytes([c]), lo, hi) for c in WHITE)
            hi = cut if cut > lo else hi
        part = text[lo:hi]
        yield (before + b" " + part, len(before)) if before else (part, 0)
        lo = hi
        if lo >= len(text):
            return
        before = (part.rsplit(None, 1) or [before])[-1]


def features(texts: list[bytes], skips: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text of each feature, its number); the first ``skips`` bytes of a text are only the word before.

    Words are runs without white space.  A character n-gram lies inside a word with one space on
    either side, so none spans two words or two texts.
    """
    buf = np.frombuffer(b" " + b"".join(t + b" " for t in texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    gap = SPACE[buf]
    c = np.where(gap, 32, buf).astype(np.uint64)
    inner = ~gap
    places, numbers = [], []
    for n in NGRAMS:
        at = inner[1 : len(c) - n + 2].copy()
        for k in range(2, n - 1):
            at &= inner[k : len(c) - n + 1 + k]
        at = np.flatnonzero(at)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + c[at + k]
        places.append(at)
        numbers.append(_bucket(h))
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    lo, hi = edge[::2], edge[1::2]  # the buffer begins and ends with a space
    power, inverse = _powers(len(c))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * power, dtype=np.uint64)])
    words = (total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64)
    places.append(lo)
    numbers.append(_bucket(words * np.uint64(31)))
    text_of = np.searchsorted(starts, lo - 1, side="right")
    two = np.flatnonzero(text_of[1:] == text_of[:-1]) + 1
    for h in (words[two] * np.uint64(37) + words[two - 1] * np.uint64(41), (words[two] == words[two - 1]).astype(np.uint64) + np.uint64(43)):
        places.append(lo[two])
        numbers.append(_bucket(h))
    places, numbers = np.concatenate(places), np.concatenate(numbers)
    own = np.searchsorted(starts, places, side="right") - 1
    if skips is not None and any(skips):
        keep = places >= starts[own] + np.where(np.array(skips) > 0, np.array(skips) + 1, 0)[own]
        own, numbers = own[keep], numbers[keep]
    return own, numbers


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a whole text and their shares."""
    dense = np.zeros(BUCKETS)
    for part, skip in pieces(text.encode()):
        dense += np.bincount(features([part], [skip])[1], minlength=BUCKETS)
    at = np.flatnonzero(dense)
    return at.astype(np.int32), (dense[at] / max(1.0, dense.sum())).astype(np.float32)


@dataclass
class Model:
    """Score = 1 / (1 + exp(-(mean of table over features + bias)))."""

    table: np.ndarray
    bias: float


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int = 8, epochs: int = 8, rate: float = 8.0, seed: int = 7) -> Model:
    """Averaged feature vectors and a softmax output, by stochastic gradient descent."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        n = len(y)
        p = (share * n + 1) / (n + 2)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    # Both classes weigh the same, whatever their numbers in the sample.
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    step, batch = 0, 32
    each = -(-len(y) // batch)
    epochs = max(epochs, -(-LEAST_STEPS // each))
    steps = epochs * each
    for _ in range(epochs):
        turn = rng.permutation(len(y))
        for lo in range(0, len(turn), batch):
            own = turn[lo : lo + batch]
            lr = rate * (1 - step / steps)
            step += 1
            idx = np.concatenate([bags[i][0] for i in own])
            w = np.concatenate([bags[i][1] for i in own])
            doc = np.repeat(np.arange(len(own)), [len(bags[i][0]) for i in own])
            hidden = np.zeros((len(own), dim))
            np.add.at(hidden, doc, vec[idx] * w[:, None])
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p *= weight[own, None]
            d_hidden = p @ out.T
            out -= lr / 8 * (hidden.T @ p) / len(own)
            bias -= lr / 80 * p.sum(0) / len(own)
            np.add.at(vec, idx, -lr * w[:, None] * d_hidden[doc])
    return Model(vec @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def score_texts(texts: Iterable[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    """Scores of whole texts."""
    value, count, held, size = [], [], [], 0

    def add() -> None:
        of, numbers = features([p for _, p, _ in held], [k for _, _, k in held])
        own = np.array([i for i, _, _ in held])[of]
        first = held[0][0]
        for out, more in ((value, np.bincount(own - first, table[numbers], len(value) - first)), (count, np.bincount(own - first, minlength=len(value) - first))):
            for k, x in enumerate(more):
                out[first + k] += x

    for i, t in enumerate(texts):
        value.append(0.0)
        count.append(0)
        for part, skip in pieces(t):
            held.append((i, part, skip))
            size += len(part)
            if size >= PIECE:
                add()
                held, size = [], 0
    if held:
        add()
    mean = np.array(value) / np.maximum(1, np.array(count, np.int64))
    return 1 / (1 + np.exp(-np.clip(mean + bias, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample_bags(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[list, np.ndarray]:
    """Features and labels of at most ``2 * per_class`` labelled documents outside the held-out fold."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    )
    # Only labelled ids that have a document count; each id's text counts once.
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    known = known.join(ids, "doc_id", "left_semi")
    chosen = [known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    chosen = {r["doc_id"]: r["y"] for part in chosen for r in part.collect()}
    if not chosen:
        return [], np.zeros(0, np.int64)
    spark = docs.sparkSession
    rows = spark.createDataFrame(sorted(chosen.items()), "doc_id bigint, y int")
    texts = (
        docs.select(F.col("doc_id").cast("bigint"), whole(F.col("text")).alias("text"))
        .join(F.broadcast(rows), "doc_id")  # at most 2 * per_class rows
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [bag(t) for t in b["text"]]
            yield pd.DataFrame(
                {"doc_id": b["doc_id"], "y": b["y"], "at": [g[0].tobytes() for g in got], "w": [g[1].tobytes() for g in got]}
            )

    got = sorted(texts.mapInPandas(run, "doc_id bigint, y int, at binary, w binary").collect(), key=lambda r: r["doc_id"])
    bags = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["w"], np.float32)) for r in got]
    return bags, np.array([r["y"] for r in got], np.int64)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*sample_bags(docs, labels))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))  # fixed size

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, bias = shared.value
        for t in texts:
            yield pa.array(score_texts(((x.as_py() or "").encode() for x in t), table, bias))

    return docs.withColumn(score_col, score(F.col(f"`{text_col}`")))


def quality_scores(docs: DataFrame, labels: DataFrame, at_least: float = 0.3) -> DataFrame:
    """One row per document: its fold, score and prediction."""
    s = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))
