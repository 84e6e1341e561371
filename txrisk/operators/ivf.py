"""Cluster-pruned search: k-means, inverted lists, boxes, probes, and the two-tier vote.

The index is three tables (centroids, members by cluster, boxes by cluster).  Centroids are few beside the
references, so they go to executors as an array (trained ones are 4096 at most); members meet their probes
in an equi-join on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.knn import nearest
from txrisk.schema import K, SearchConfig
from txrisk.storage import discard, stash

MAX_CLUSTERS = 4096
#: Members, or queries, of a cluster that a task holds at a time.
PART = 8192
#: Distances that are held at a time, and those of a block that stays in a core's cache.
DISTANCES = 1 << 24
CACHED = 1 << 16


@dataclass
class Index:
    """Centroids (row number = cluster), members (ci, pos, ref_id, dims, is_fraud), boxes (ci, lo_*, hi_*)."""

    centroids: np.ndarray
    members: DataFrame
    boxes: DataFrame
    dims: list[str]

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    def save(self, path: str) -> None:
        """Members partitioned by cluster, so a probe reads only its folders."""
        spark = self.members.sparkSession
        self.members.write.mode("overwrite").partitionBy("ci").parquet(f"{path}/members")
        self.boxes.write.mode("overwrite").parquet(f"{path}/boxes")
        rows = [(i, *map(float, c)) for i, c in enumerate(self.centroids)]
        schema = "ci int, " + ", ".join(f"{d} double" for d in self.dims)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @staticmethod
    def load(spark, path: str) -> Index:
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["ci"])
        dims = [c for c in rows[0].asDict() if c != "ci"] if rows else []
        centroids = np.array([[r[d] for d in dims] for r in rows], float)
        return Index(centroids, spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/boxes"), dims)


def sampled_centroids(refs: DataFrame, dims: list[str], every: int) -> np.ndarray:
    """One of ``every`` references, MAX_CLUSTERS at most: those whose ids have the smallest MD5 sums, in order of id."""
    k = min(MAX_CLUSTERS, -(-refs.count() // every))
    rows = refs.orderBy(F.md5(F.col("ref_id").cast("string").cast("binary"))).limit(k).select("ref_id", *dims).collect()
    return np.array([tuple(r)[1:] for r in sorted(rows)], float).reshape(len(rows), len(dims))


def trained_centroids(refs: DataFrame, dims: list[str], nlist: int, iterations: int = 30, seed: int = 42) -> np.ndarray:
    """Lloyd's centroids from random rows, of which no two are equal (so fewer, if fewer rows differ).

    Equal rows are one point with a weight.  A round is one pass in which each task sums up its points by cluster.
    """
    if not 1 <= nlist <= MAX_CLUSTERS:
        raise ValueError(f"nlist must be in 1..{MAX_CLUSTERS}")
    tasks = 2 * refs.sparkSession.sparkContext.defaultParallelism
    once = refs.groupBy(*[F.col(d).cast("double").alias(d) for d in dims]).agg(F.count("*").alias("n"))
    # Keys of -log(u) / n order points as if rows were drawn one after the other.
    u = (F.pmod(F.xxhash64(F.lit(seed), *dims), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    points = stash(once.withColumn("turn", -F.log(u) / F.col("n")).repartition(tasks))
    rows = points.orderBy("turn", *dims).limit(nlist).select(*dims).collect()
    centroids = np.array(sorted(map(tuple, rows)), float).reshape(len(rows), len(dims))
    for _ in range(iterations if len(rows) else 0):
        new = weighted_means(points, centroids, dims)
        if (new == centroids).all():
            break
        centroids = new
    discard(points)
    return centroids


def weighted_means(points: DataFrame, centroids: np.ndarray, dims: list[str]) -> np.ndarray:
    """The mean of each cluster's ``points`` (dims, n); a cluster without any keeps its centroid."""
    # Half the squared distance, less the point's own norm, as one product.
    against = np.vstack([-centroids.T, (centroids * centroids).sum(1) / 2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, step = np.zeros((len(dims) + 1, len(centroids))), max(1, CACHED // len(centroids))
        for b in batches:
            n, x = b.column("n").to_numpy(), np.stack([*(b.column(d).to_numpy() for d in dims), np.ones(b.num_rows)], 1)
            ci = np.concatenate([(x[lo : lo + step] @ against).argmin(1) for lo in range(0, len(x), step)] or [np.zeros(0, int)])
            for d, w in enumerate((n, *(x[:, :-1] * n[:, None]).T)):
                sums[d] += np.bincount(ci, w, len(centroids))
        own = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *map(pa.array, sums[:, own])], ["ci", "n", *dims])

    kind = ", ".join(f"{d} double" for d in ("n", *dims))
    found = points.select(*dims, "n").mapInArrow(run, f"ci int, {kind}").groupBy("ci").agg(*[F.sum(d).alias(d) for d in ("n", *dims)])
    out = centroids.copy()
    for ci, n, *total in found.collect():  # MAX_CLUSTERS at most
        out[ci] = np.array(total) / n
    return out


def centroid_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances from norms and products."""
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T


def rows_at_a_time(centroids: np.ndarray, most: int) -> int:
    return max(1, min(most, DISTANCES // max(1, len(centroids))))


def assign(refs: DataFrame, centroids: np.ndarray, dims: list[str]) -> DataFrame:
    """``refs`` with ``ci``, the nearest centroid (the lowest of equals), and ``cdist``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, step = b[dims].to_numpy(float), max(1, CACHED // max(1, len(centroids)))
            ci, least = np.zeros(len(b), np.int32), np.zeros(len(b))
            for lo in range(0, len(b), step):
                d = centroid_distances(x[lo : lo + step], centroids)
                ci[lo : lo + step] = at = d.argmin(1)
                least[lo : lo + step] = d[np.arange(len(d)), at]
            yield b.assign(ci=ci, cdist=np.rint(least).astype(np.int64))

    return refs.mapInPandas(run, f"{refs.schema.simpleString()[7:-1]}, ci int, cdist bigint")


def updated(assigned: DataFrame, centroids: np.ndarray, dims: list[str]) -> DataFrame:
    """(ci, n, dims): the mean of each cluster's rows, from partial sums; a cluster without rows keeps its centroid."""
    sums = assigned.groupBy("ci").agg(F.count("*").alias("n"), *[(F.sum(d).cast("double") / F.count("*")).alias(f"_{d}") for d in dims])
    schema = "ci int, " + ", ".join(f"{d} double" for d in dims)
    old = assigned.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centroids)], schema)  # MAX_CLUSTERS at most
    return old.join(sums, "ci", "left").select("ci", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(f"_{d}", d).alias(d) for d in dims])


def lloyd(refs: DataFrame, centroids: np.ndarray, dims: list[str], iterations: int) -> np.ndarray:
    """Centroids after ``iterations`` updates, or fewer if one changes nothing.

    A round is one pass with partial sums, of which the driver gets a row per cluster.
    """
    for _ in range(iterations):
        rows = sorted(updated(assign(refs, centroids, dims), centroids, dims).collect())
        new = np.array([r[2:] for r in rows], float).reshape(centroids.shape)
        if (new == centroids).all():
            break
        centroids = new
    return centroids


def boxes(assigned: DataFrame, dims: list[str]) -> DataFrame:
    low, high = [F.min(d).alias(f"lo_{d}") for d in dims], [F.max(d).alias(f"hi_{d}") for d in dims]
    return assigned.groupBy("ci").agg(*low, *high)


def inverted_lists(assigned: DataFrame) -> DataFrame:
    """``assigned`` with ``pos``, the place in the cluster's list by reference id."""
    return assigned.withColumn("pos", F.row_number().over(Window.partitionBy("ci").orderBy("ref_id")) - 1)


def list_offsets(assigned: DataFrame) -> DataFrame:
    """(ci, n, first): one row per cluster, so the running sum has ``nlist`` rows at most."""
    n = assigned.groupBy("ci").agg(F.count("*").alias("n"))
    before = Window.orderBy("ci").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def build(refs: DataFrame, centroids: np.ndarray, dims: list[str]) -> Index:
    """Lists and boxes for the centroids as given, so the lists are never one update behind.

    Both are written once to the shared folder: every tier of every search reads them there.
    """
    assigned = stash(inverted_lists(assign(refs, centroids, dims)))
    return Index(centroids, assigned, stash(boxes(assigned, dims)), dims)


def probes(queries: DataFrame, index: Index, nprobe: int) -> DataFrame:
    """``queries`` with (ci, probe, cdist): the nearest clusters, the lower of equals first."""
    centroids, dims = index.centroids, index.dims

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            step = rows_at_a_time(centroids, 1024)
            for lo in range(0, len(b), step):
                part = b.iloc[lo : lo + step]
                d = centroid_distances(part[dims].to_numpy(float), centroids)
                ci = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
                out = part.loc[part.index.repeat(ci.shape[1])]
                at = np.repeat(np.arange(len(part)), ci.shape[1])
                yield out.assign(
                    ci=ci.ravel().astype(np.int32),
                    probe=np.tile(np.arange(1, ci.shape[1] + 1, dtype=np.int32), len(part)),
                    cdist=np.rint(d[at, ci.ravel()]).astype(np.int64),
                )

    return queries.select("qid", *dims).mapInPandas(
        run, "qid bigint, " + ", ".join(f"{d} int" for d in dims) + ", ci int, probe int, cdist bigint"
    )


def box_bound(probed: DataFrame, index: Index) -> DataFrame:
    """``probed`` with ``bound``: no member of the cluster is nearer to the query."""
    gap = None
    for d in index.dims:
        out = F.greatest(F.col(f"lo_{d}") - F.col(d), F.col(d) - F.col(f"hi_{d}"), F.lit(0)).cast("bigint")
        gap = out * out if gap is None else gap + out * out
    return probed.join(index.boxes, "ci").withColumn("bound", gap).drop(*[f"{s}_{d}" for s in ("lo", "hi") for d in index.dims])


def scan(probed: DataFrame, index: Index, k: int = K, same_ids: bool = False) -> DataFrame:
    """(qid, probe, pos, ref_id, is_fraud, dist): of each probed cluster the k nearest members, ties by place in the list.

    A cluster's members meet its queries in blocks of PART rows a side, however many there are, and no
    pair is a row.  With ``same_ids`` a query's own row is left out.
    """
    dims = index.dims
    members = index.members.select("ci", "pos", "ref_id", "is_fraud", *dims)
    # A row per cluster: MAX_CLUSTERS at most.
    sizes = members.groupBy("ci").agg(F.ceil(F.count("*") / PART).alias("parts"))
    shape = sizes.join(probed.groupBy("ci").agg(F.ceil(F.count("*") / PART).alias("q_parts")), "ci")
    shape = shape.select(F.col("ci").alias("ci_"), "parts", "q_parts")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def met(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(shape), rows["ci"] == F.col("ci_")).drop("ci_")

    left = met(probed.select("qid", "ci", "probe", *dims)).withColumn("q_part", F.pmod(F.xxhash64("qid"), F.col("q_parts"))).withColumn("part", every("parts"))
    right = met(members).withColumn("part", F.pmod("pos", F.col("parts"))).withColumn("q_part", every("q_parts"))

    def run(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(m):
            qid, probe, x = q["qid"].to_numpy(), q["probe"].to_numpy(), q[dims].to_numpy(float)
            pos, ids, fraud, y = m["pos"].to_numpy(), m["ref_id"].to_numpy(), m["is_fraud"].to_numpy(bool), m[dims].to_numpy(float)
            step = rows_at_a_time(y, PART)
            for lo in range(0, len(q), step):
                d = np.rint(centroid_distances(x[lo : lo + step], y))
                if same_ids:
                    d[qid[lo : lo + step, None] == ids[None, :]] = np.inf
                row, at = nearest(d, pos, k)
                fine = np.isfinite(d[row, at])
                row, at = row[fine], at[fine]
                out.append((qid[row + lo], probe[row + lo], pos[at], ids[at], fraud[at], d[row, at].astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 6
        return pd.DataFrame(dict(zip(("qid", "probe", "pos", "ref_id", "is_fraud", "dist"), cols)))

    keys = ["ci", "part", "q_part"]
    schema = "qid bigint, probe int, pos int, ref_id bigint, is_fraud boolean, dist bigint"
    return left.drop("parts", "q_parts").groupBy(*keys).cogroup(right.drop("parts", "q_parts").groupBy(*keys)).applyInPandas(run, schema)


def top(found: DataFrame, k: int = K) -> DataFrame:
    """The k nearest in scan order: equal distances keep the one scanned first."""
    order = Window.partitionBy("qid").orderBy("dist", "probe", "pos")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def two_tier(queries: DataFrame, index: Index, config: SearchConfig = SearchConfig(), same_ids: bool = False) -> DataFrame:
    """(qid, fraud): votes after the quick tier, or after all probes where the quick vote is ambiguous.

    The second tier goes on from the first one's neighbours, and skips clusters whose box is no nearer
    than the worst of them.  Queries without any neighbour have no vote: 0.
    """
    config = config.clamped(index.nlist)
    if not config.nprobe:
        return queries.select("qid", F.lit(0).cast("bigint").alias("fraud"))
    probed = stash(probes(queries, index, config.nprobe))
    first = stash(top(scan(probed.where(F.col("probe") <= config.quick), index, same_ids=same_ids)))
    votes = first.groupBy("qid").agg(F.count_if("is_fraud").alias("fraud"), F.count("*").alias("n"), F.max("dist").alias("worst"))
    unsure = votes.where(F.col("fraud").between(config.boundary_low, config.boundary_high))
    rest = box_bound(probed.where(F.col("probe") > config.quick).join(unsure, "qid"), index)
    rest = rest.where((F.col("n") < K) | (F.col("bound") < F.col("worst"))).drop("fraud", "n", "worst", "bound")
    keep = first.join(unsure.select("qid"), "qid", "left_semi").drop("rank")
    second = top(keep.unionByName(scan(rest, index, same_ids=same_ids))).groupBy("qid").agg(F.count_if("is_fraud").alias("again"))
    out = stash(
        queries.select("qid").join(votes, "qid", "left").join(second, "qid", "left")
        .select("qid", F.coalesce("again", "fraud", F.lit(0)).cast("bigint").alias("fraud"))
    )
    discard(probed, first)
    return out
