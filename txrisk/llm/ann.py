"""Nearest neighbours by an inverted multi-index.

Vectors are cut into two halves with a codebook each, so a cell is a pair of centroids.  Nearness is the
inner product, so a query takes cells in falling order of the sum of its halves' inner products with
the centroids: a heap over the two sorted lists (the multi-sequence walk), until the cells hold as many
rows as the calibration asks for.  The walk goes by runs of neighbouring ranks, ``RUNS`` of each list,
and so takes no more steps where codebooks are larger.  Where it ends is one number per query, the least
sum visited; all entries of the visited cells are reranked by the inner product of the whole vectors.

Codebooks grow as the square root of the rows, up to ``CENTROIDS``, so that the visited share falls as
the table grows; they are trained on ``PER_CENTROID`` rows a centroid, chosen by hash of the id.  The rows
to visit are calibrated on ``PROBES`` queries, whose true neighbours among all rows are found by brute
force: the least number that meets a share of ``RECALL`` of them.  Every row is indexed.

Vectors that are null, zero or hold null or non-finite components, or whose length is not the usual one,
take no part.  Each row is a candidate of its own, also where ids repeat or are null, and only the
query's own row is left out.  Ties go to the smaller id, null last; a repeated id asks once for each
of its rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stash
from .vectors import sample, stacked, usable

CENTROIDS = 512
PER_CENTROID = 64
RUNS = 32
PROBES = 256
RECALL = 0.95
#: Rows and queries of one block of the search.
BLOCK_ROWS = 65_536
BLOCK_QUERIES = 8_192
CHUNK = 64

RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids of a sample; a centroid without members keeps its place."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        for d in range(x.shape[1]):
            total = np.bincount(own, x[:, d], len(c))
            c[:, d] = np.where(n > 0, total / np.maximum(n, 1), c[:, d])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)


def codebook_size(rows: int) -> int:
    """A power of two near the square root of the rows, so that a cell has about one row until ``CENTROIDS`` are reached."""
    return max(1, min(CENTROIDS, 1 << round(np.log2(max(1, rows)) / 2)))


@dataclass
class MultiIndex:
    """Codebooks of the two halves, the rows of each cell, and how many rows a query visits."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray | None = None
    visits: float = np.inf

    @property
    def half(self) -> int:
        return self.first.shape[1]

    @property
    def dim(self) -> int:
        return self.half + self.second.shape[1]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, : self.half], self.first), nearest(x[:, self.half :], self.second)

    def sums(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By query and centroid: the greatest inner product in the centroid's run of ranks."""
        return _heads(q[:, : self.half] @ self.first.T)[0], _heads(q[:, self.half :] @ self.second.T)[0]

    def walk(self, q: np.ndarray) -> Iterator[tuple[float, int, np.ndarray, np.ndarray]]:
        """(sum, rows, first centroids, second centroids) of the runs' pairs in falling order of the sum."""
        a, i_of = _heads(q[None, : self.half] @ self.first.T)
        b, j_of = _heads(q[None, self.half :] @ self.second.T)
        a, b, i_of, j_of = a[0], b[0], i_of[0], j_of[0]
        lo_i, lo_j = np.arange(0, len(a), _run(len(a))), np.arange(0, len(b), _run(len(b)))
        rows = np.add.reduceat(np.add.reduceat(self.counts[i_of][:, j_of], lo_i, axis=0), lo_j, axis=1)
        runs_i, runs_j = np.split(i_of, lo_i[1:]), np.split(j_of, lo_j[1:])
        a, b = a[i_of[lo_i]].tolist(), b[j_of[lo_j]].tolist()
        heap = [(-a[0] - b[0], 0, 0)]
        while heap:
            s, i, j = heapq.heappop(heap)
            yield -s, int(rows[i, j]), runs_i[i], runs_j[j]
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-a[i + 1] - b[0], i + 1, 0))
            if j + 1 < len(b):
                heapq.heappush(heap, (-a[i] - b[j + 1], i, j + 1))

    def least_sum(self, q: np.ndarray) -> float:
        """The sum at which the walk has met enough rows; rounding may not leave out the last cells."""
        seen = 0
        for s, n, _, _ in self.walk(q):
            seen += n
            if seen >= self.visits:
                return s - 1e-9 * (1 + abs(s))
        return -np.inf


def _run(k: int) -> int:
    return -(-k // RUNS)


def _heads(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values raised to the greatest of their run of ranks, centroids by rank), row by row."""
    order = np.argsort(-x, axis=1, kind="stable")
    head = np.arange(x.shape[1]) // _run(x.shape[1]) * _run(x.shape[1])
    out = np.empty_like(x)
    np.put_along_axis(out, order, np.take_along_axis(x, order[:, head], 1), 1)
    return out, order


def fit(x: np.ndarray, k: int) -> MultiIndex:
    """Codebooks from a sample."""
    half = (x.shape[1] + 1) // 2
    return MultiIndex(kmeans(x[:, :half], k), kmeans(x[:, half:], k))


def best(score: np.ndarray, key: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` greatest scores, ties to the smaller key."""
    at = np.arange(len(score))
    if len(score) > top:
        at = np.flatnonzero(score >= np.partition(score, len(score) - top)[len(score) - top])
    return at[np.lexsort((key[at], -score[at]))[:top]]


def calibrate(index: MultiIndex, entries: DataFrame, probes: DataFrame, top: int, recall: float) -> float:
    """The rows to visit so that ``recall`` of the probes' true neighbours among all entries are met."""
    asked = probes.toPandas()
    q, own = stacked(asked["v"]), asked["_row"].to_numpy()

    def nearest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4))
        for b in batches:
            v, row = stacked(b.column("v").to_pylist()), b.column("_row").to_numpy()
            if not len(v):
                continue
            s = q @ v.T
            s[own[:, None] == row[None, :]] = -np.inf
            k = min(top, s.shape[1])
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            c = np.stack([b.column("c1").to_numpy(), b.column("c2").to_numpy()], 1)[at].reshape(-1, 2)
            held = np.concatenate([held, np.column_stack([np.repeat(np.arange(len(q)), k), np.take_along_axis(s, at, 1).ravel(), c])])
            held = held[np.isfinite(held[:, 1])]
            held = held[np.lexsort((-held[:, 1], held[:, 0]))]
            held = held[np.arange(len(held)) - np.searchsorted(held[:, 0], held[:, 0]) < top]
        cols = [pa.array(held[:, k].astype(t)) for k, t in enumerate((np.int32, np.float64, np.int32, np.int32))]
        yield pa.RecordBatch.from_arrays(cols, ["probe", "score", "c1", "c2"])

    found = entries.mapInArrow(nearest_of, "probe int, score double, c1 int, c2 int")
    order = Window.partitionBy("probe").orderBy(F.desc("score"))
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).toPandas()  # PROBES * top rows
    needed = []
    for p, part in found.groupby("probe"):
        seen, met = 0, np.zeros(index.counts.shape, np.int64)
        for _, n, i, j in index.walk(q[p]):
            seen += n
            met[np.ix_(i, j)] = seen
        needed.append(met[part["c1"], part["c2"]])
    return float(np.quantile(np.concatenate(needed), recall, method="higher")) if needed else np.inf


def blocks_of(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of each first centroid: small ones share a block, large ones are split."""
    first, parts = np.zeros(len(rows), np.int64), np.maximum(1, -(-rows // size))
    block, held = 0, 0
    for c, n in enumerate(rows):
        if held and (held + n > size or parts[c] > 1):
            block, held = block + 1, 0
        first[c] = block
        held += n
        if parts[c] > 1:
            block, held = block + int(parts[c]), 0
    return first, parts


def indexed(df: DataFrame, top: int = 20, recall: float = RECALL) -> tuple[MultiIndex | None, DataFrame | None]:
    """The index of a table and its entries (_row, vec_id, c1, c2, v); none for a table without vectors."""
    rows = df.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint"), "embedding")
    k = codebook_size(rows.count())
    x = sample(rows, PER_CENTROID * k)
    if not len(x):
        return None, None
    index = fit(x, k)
    rows = rows.where(F.size("embedding") == index.dim).withColumn("_row", F.monotonically_increasing_id())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = stacked(b.column("embedding").to_pylist())
            if len(v):
                c1, c2 = index.cells(v)
                cols = [b.column("_row"), b.column("vec_id"), c1.astype(np.int32), c2.astype(np.int32), pa.array([r.tobytes() for r in v], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["_row", "vec_id", "c1", "c2", "v"])

    entries = stash(rows.mapInArrow(assign, "_row bigint, vec_id bigint, c1 int, c2 int, v binary"))
    index.counts = np.zeros((len(index.first), len(index.second)), np.int64)
    by_cell = entries.groupBy("c1", "c2").count().toPandas()  # at most CENTROIDS squared
    index.counts[by_cell["c1"], by_cell["c2"]] = by_cell["count"]
    probes = entries.orderBy(F.xxhash64("_row"), "_row").limit(PROBES).select("_row", "v")
    index.visits = calibrate(index, entries, probes, top, recall)
    return index, entries


def search(df: DataFrame, top: int = 20, every: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``top`` nearest rows to each row whose id ``every`` divides."""
    spark = df.sparkSession
    index, entries = indexed(df, top, recall)
    if index is None:
        return spark.createDataFrame([], RESULT)
    first, parts = blocks_of(index.counts.sum(1), BLOCK_ROWS)
    n_blocks = int((first + parts).max())
    queries = entries.where(F.col("vec_id") % every == 0)
    q_parts = max(1, -(-queries.count() // BLOCK_QUERIES))
    shared = spark.sparkContext.broadcast(index)  # at most CENTROIDS squared counts

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for b in batches:
            v, row, c1 = stacked(b.column("v").to_pylist()), b.column("_row").to_numpy(), b.column("c1").to_numpy()
            # Queries of one place go together, so that they ask for the same blocks; those of a large one are dealt out.
            own = x.counts.sum(1)
            turn = (row * 2_654_435_761 % (1 << 32)) / (1 << 32)
            q_part = np.minimum(((np.cumsum(own) - own)[c1] + turn * own[c1]) / own.sum() * q_parts, q_parts - 1).astype(np.int32)
            for lo in range(0, len(v), CHUNK):
                q = v[lo : lo + CHUNK]
                least = np.array([x.least_sum(u) for u in q])
                a, c = x.sums(q)
                wants = a + c.max(1)[:, None] >= least[:, None]
                asks = np.zeros((len(q), n_blocks), bool)
                for k in range(len(x.first)):
                    asks[:, first[k] : first[k] + parts[k]] |= wants[:, k, None]
                who, block = np.nonzero(asks)
                at = pa.array(who + lo)
                cols = [pa.array(block.astype(np.int32)), pa.array(q_part[who + lo]), pa.array(row[who + lo]), pa.array(least[who]), b.column("vec_id").take(at), b.column("v").take(at)]
                yield pa.RecordBatch.from_arrays(cols, ["block", "q_part", "q_row", "least", "query_id", "q"])

    probes = queries.mapInArrow(probe, "block int, q_part int, q_row bigint, least double, query_id bigint, q binary")
    probes = stash(probes)
    place = spark.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(first, parts))], "c1 int, first int, parts int")
    key = F.coalesce("vec_id", F.lit((1 << 63) - 1))
    at = (F.col("first") + F.pmod(F.xxhash64("_row"), F.col("parts"))).cast("int")
    dealt = entries.join(F.broadcast(place), "c1").select(at.alias("block"), "_row", key.alias("key"), "c1", "c2", "v")
    asked = probes.select(F.col("block").alias("block"), F.col("q_part").alias("q_part")).distinct()
    dealt = dealt.join(F.broadcast(asked), "block")  # blocks times query parts

    def rerank(entry: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entry) and len(query):
            x = shared.value
            entry = entry.sort_values("c1")
            c1, c2, row, keys, v = entry["c1"].to_numpy(), entry["c2"].to_numpy(), entry["_row"].to_numpy(), entry["key"].to_numpy(), stacked(entry["v"])
            edge = np.searchsorted(c1, np.arange(len(x.first) + 1))
            for lo in range(0, len(query), CHUNK):
                part = query.iloc[lo : lo + CHUNK]
                q, least, q_row = stacked(part["q"]), part["least"].to_numpy(), part["q_row"].to_numpy()
                a, b = x.sums(q)
                wanted = (a + b.max(1)[:, None] >= least[:, None]).any(0)
                at = np.concatenate([np.arange(edge[k], edge[k + 1]) for k in np.flatnonzero(wanted)] or [np.zeros(0, np.int64)])
                s = q @ v[at].T
                s[(a[:, c1[at]] + b[:, c2[at]] < least[:, None]) | (q_row[:, None] == row[at][None, :])] = -np.inf
                for k in range(len(part)):
                    # Ties within rounding stay in until the scores are taken one row at a time.
                    mine = s[k]
                    floor = np.partition(mine, len(mine) - top)[len(mine) - top] if len(mine) > top else -np.inf
                    some = np.flatnonzero((mine >= floor - 1e-9 * (1 + abs(floor)) if np.isfinite(floor) else True) & np.isfinite(mine))
                    exact = (v[at[some]] * q[k]).sum(1)
                    took = best(exact, keys[at[some]], top)
                    out.append((np.full(len(took), q_row[k]), row[at[some[took]]], keys[at[some[took]]], exact[took]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pd.DataFrame(dict(zip(("q_row", "row", "key", "score"), cols)))

    keys = ["block", "q_part"]
    found = dealt.groupBy(*keys).cogroup(probes.drop("query_id").groupBy(*keys)).applyInPandas(rerank, "q_row bigint, row bigint, key bigint, score double")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "key", "row")
    found = stash(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    discard(probes)
    name = entries.select(F.col("_row").alias("q_row"), F.col("vec_id").alias("query_id"))
    given = F.when(F.col("key") < (1 << 63) - 1, F.col("key"))
    return found.join(name, "q_row").select("query_id", "rank", given.alias("vec_id"), "score")
