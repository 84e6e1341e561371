"""Exact nearest labelled references.

No pair is a row, and few are looked at.  References are dealt to cells by median splits; a cell holds each vector
once, with the ids that can be among the nearest, in leaves with boxes.  A query vector, also taken once, first
meets the cell whose box is nearest, and then every cell whose box is no farther than the k-th neighbour found there;
within a cell the leaves are taken the same way.  A box as near as that neighbour is still opened, so ties by id are
kept and nothing is lost.  The sample behind the splits bears on the cost alone.  All tables pass through shuffles and
the shared folder; the driver gets the splits and a box per cell.

The native form is the same search as Spark expressions, a row per pair that is looked at; it needs no Python
and shows in the plan.  Both break ties by reference id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.storage import discard, stash

#: Queries that meet a cell in one task.
QUERY_BLOCK = 1 << 17
#: Leaves that a chunk of queries meets at a time.
BLOCKS_HELD = 64
#: Distances that are held at a time.
DISTANCES = 1 << 21
#: Rows of the sample that shapes the cells; rows of a cell, at least and at most; rows of a part of one.
SAMPLE = 1 << 15
CELL = 2048, 1 << 16
PART = 1 << 17
#: Vectors of a leaf, and queries of a chunk.
LEAF = 128
CHUNK = 64
#: Splits on the way to a cell, at most; beyond, cells grow and not their number.
DEPTH = 11
#: Rows of a cell of the native form.
NATIVE_CELL = 512

#: What the features are, and how they are packed.
TYPES = {"int": "<i4", "float": "<f4"}
#: Share by which distances summed in single precision may be below the true ones, at most.
ROUNDING = {"int": 0.0, "float": 1e-5}


def squared_distance(left: list[Column], right: list[Column]) -> Column:
    """Unrolled sum of squares in 64-bit integers."""
    out = None
    for a, b in zip(left, right):
        gap = a.cast("bigint") - b.cast("bigint")
        out = gap * gap if out is None else out + gap * gap
    return out


def nearest(distance: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the k least distances of each row, ties by id; only up to each row's ``limit``, if given."""
    if limit is None:
        limit = np.partition(distance, k - 1, axis=1)[:, k - 1] if distance.shape[1] > k else np.full(len(distance), np.inf)
    row, at = np.nonzero(distance <= limit[:, None])
    order = np.lexsort((ids[at], distance[row, at], row))
    row, at = row[order], at[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], at[keep]


@dataclass
class Splits:
    """A complete binary tree: node n goes on to 2n + 1 where ``dim`` is at most ``at``, else to 2n + 2."""

    dim: np.ndarray
    at: np.ndarray
    depth: int

    @staticmethod
    def of(sample: np.ndarray, depth: int) -> Splits:
        nodes = (1 << depth) - 1
        dim, at, rows = np.zeros(nodes, np.int64), np.full(nodes, np.inf), {0: np.nan_to_num(sample.astype(float))}
        for n in range(nodes):
            own = rows.pop(n)
            left = np.ones(len(own), bool)
            if len(own) > 1 and np.ptp(own, axis=0).max() > 0:
                dim[n] = own.var(0).argmax()
                v = own[:, dim[n]]
                mid = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
                at[n] = mid if mid < v.max() else v[v < mid].max()
                left = v <= at[n]
            rows[2 * n + 1], rows[2 * n + 2] = own[left], own[~left]
        return Splits(dim, at, depth)

    def cells(self, x: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[every, self.dim[node]] > self.at[node])
        return node - ((1 << self.depth) - 1)

    def column(self, x: Column) -> Column:
        """The cell of an array."""
        if not self.depth:
            return F.lit(0).cast("long")
        dim, at = F.lit(self.dim.tolist()), F.lit(self.at.tolist())
        down = lambda n, _: 2 * n + 1 + (F.get(x, F.get(dim, n.cast("int"))) > F.get(at, n.cast("int"))).cast("long")
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0).cast("long"), down) - F.lit((1 << self.depth) - 1)


def fitted(refs: DataFrame, dims: list[str], rows: int, kind: str, n: int) -> Splits:
    """Splits for cells of about ``rows`` references, from about SAMPLE of them, by hash."""
    depth = min(DEPTH, int(np.ceil(np.log2(max(1, n / rows)))))
    some = refs.where(F.pmod(F.xxhash64("ref_id"), F.lit(max(1, n // SAMPLE))) == 0).select(*[F.col(d).cast(kind).alias(d) for d in dims])
    some = some.limit(2 * SAMPLE if depth else 0).toArrow()
    return Splits.of(np.stack([some[d].to_numpy() for d in dims], 1), depth)


def groups(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in groups of ``size`` at most, by median splits of the widest column."""
    out, stack = [], [np.arange(len(x))] if len(x) else []
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        own, mid = x[rows], len(rows) // 2
        order = np.argpartition(own[:, own.var(0).argmax()], mid)
        stack += [rows[order[mid:]], rows[order[:mid]]]
    return out


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(starts - starts_of(sizes)[:-1], sizes) + np.arange(sizes.sum())


PACKED = "cell bigint, part bigint, lo array<double>, hi array<double>, leaves binary, copies binary, x binary, ids binary, fraud binary"


def packed(table: pa.Table, dims: list[str], kind: str, most: int) -> pa.Table:
    """One row of a cell's references: each vector once with its ``most`` least ids, in leaves."""
    x, ids = np.stack([table[d].to_numpy() for d in dims], 1).astype(TYPES[kind]), table["ref_id"].to_numpy()
    fraud = table["is_fraud"].to_numpy().astype(np.uint8)
    order = np.lexsort((ids, *x.T))
    x, ids, fraud = x[order], ids[order], fraud[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(1)]))
    sizes = np.minimum(np.diff(np.append(first, len(x))), most)
    leaves = groups(x[first].astype(float), LEAF)
    at = np.concatenate(leaves)
    own = ranges(first[at], sizes[at])
    sets = [np.array([len(g) for g in leaves], "<i4"), sizes[at].astype("<i4"), x[first[at]], ids[own].astype("<i8"), fraud[own]]
    row = {"cell": table["cell"][0].as_py(), "part": table["part"][0].as_py(), "lo": x.min(0).astype(float).tolist(), "hi": x.max(0).astype(float).tolist()}
    row |= {name: s.tobytes() for name, s in zip(("leaves", "copies", "x", "ids", "fraud"), sets)}
    return pa.table({name: [v] for name, v in row.items()})


def box_distance(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(query, box): the square of the distance to the nearest point of the box."""
    out = np.zeros((len(q), len(lo)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(lo[None, :, d] - q[:, d, None], q[:, d, None] - hi[None, :, d]), 0)
        out += gap * gap
    return out


class Cell:
    """A cell's references, and the search among them."""

    def __init__(self, row: dict, width: int, kind: str):
        self.kind, self.single = kind, kind == "float"
        self.raw = np.frombuffer(row["x"], TYPES[kind]).reshape(-1, width)
        self.x = self.raw.astype(float)
        self.xx = (self.x * self.x).sum(1)
        self.copies = np.frombuffer(row["copies"], "<i4").astype(np.int64)
        self.ids, self.fraud = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["fraud"], np.uint8).astype(bool)
        self.sizes = np.frombuffer(row["leaves"], "<i4").astype(np.int64)
        self.starts, self.id_starts = starts_of(self.sizes)[:-1], starts_of(self.copies)[:-1]
        self.lo, self.hi = np.minimum.reduceat(self.x, self.starts), np.maximum.reduceat(self.x, self.starts)

    def distances(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.single:  # in dimension order, as a loop over the dimensions would sum
            d = np.zeros((len(q), len(at)), np.float32)
            for k in range(q.shape[1]):
                gap = q[:, k, None] - self.raw[None, at, k]
                d += gap * gap
            return d.astype(float)
        # Integers below 2**53: exact in doubles.
        q = q.astype(float)
        return (-2 * q) @ self.x[at].T + self.xx[at] + (q * q).sum(1)[:, None]

    def chunk(self, q: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, vector, distance) of those that hold the k nearest ids of each query up to its ``limit``."""
        wide, near = q.astype(float), 1 - ROUNDING[self.kind]
        limit = limit.copy()
        gap = np.maximum(np.maximum(self.lo - wide.max(0), wide.min(0) - self.hi), 0)
        box = (gap * gap).sum(1) * near
        order = np.argsort(box, kind="stable")
        order = order[box[order] <= limit.max()]
        row, at, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        most = max(1, min(BLOCKS_HELD, DISTANCES // (len(q) * LEAF)))
        lo, step = 0, 1
        while lo < len(order) and box[order[lo]] <= limit.max():
            some = order[lo : lo + step]
            lo, step = lo + step, min(most, 2 * step)
            some = some[(box_distance(wide, self.lo[some], self.hi[some]) * near <= limit[:, None]).any(0)]
            if not len(some):
                continue
            own = ranges(self.starts[some], self.sizes[some])
            d = self.distances(q, own)
            r, c = np.nonzero(d <= limit[:, None])
            if not len(r):
                continue
            row, dist, at = np.concatenate([row, r]), np.concatenate([dist, d[r, c]]), np.concatenate([at, own[c]])
            by = np.lexsort((dist, row))
            row, dist, at = row[by], dist[by], at[by]
            n = np.cumsum(self.copies[at])
            first = np.searchsorted(row, row)
            before = n - self.copies[at]
            before -= before[first]
            full = np.flatnonzero((before < k) & (before + self.copies[at] >= k))
            limit[row[full]] = dist[full]
            fine = dist <= limit[row]
            row, dist, at = row[fine], dist[fine], at[fine]
        return row, at, dist

    def search(self, q: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(row, id, fraud, distance): the k nearest ids of each query up to its ``limit``, in order."""
        parts = []
        for rows in groups(q.astype(float), CHUNK):
            row, at, dist = self.chunk(q[rows], limit[rows], k)
            n = self.copies[at]
            own = ranges(self.id_starts[at], n)
            row, dist, ids = np.repeat(row, n), np.repeat(dist, n), self.ids[own]
            by = np.lexsort((ids, dist, row))
            by = by[np.arange(len(row)) - np.searchsorted(row, row) < k]  # lexsort keeps the rows in order
            parts.append((rows[row[by]], ids[by], self.fraud[own[by]], dist[by]))
        return tuple(np.concatenate(c) for c in zip(*parts))


def exact_knn(queries: DataFrame, refs: DataFrame, dims: list[str], k: int = 5, native: bool = False, same_ids: bool = False) -> DataFrame:
    """(qid, ref_id, is_fraud, dist, rank): the k nearest references of each query.

    ``queries``: qid and integer ``dims``; ``refs``: ref_id, ``dims`` and is_fraud; no value is null.  With
    ``same_ids`` queries are rows of the references too, and none is its own neighbour.
    """
    found = _native(queries, refs, dims, k, same_ids) if native else _nearest(queries, refs, dims, k, "int", same_ids)
    return _ranked(found, k)


def float_knn(queries: DataFrame, refs: DataFrame, dims: list[str], k: int = 5, same_ids: bool = False) -> DataFrame:
    """The same over single-precision features, whose squares are summed in single precision in dimension order."""
    return _ranked(_nearest(queries, refs, dims, k, "float", same_ids), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "ref_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _keyed(queries: DataFrame, dims: list[str], kind: str) -> DataFrame:
    """(qid, key, x): ``key`` is the least id of the queries with that vector."""
    q = queries.select("qid", *[F.col(d).cast(kind).alias(d) for d in dims])
    return q.select("qid", F.min("qid").over(Window.partitionBy(F.xxhash64(*dims), *dims)).alias("key"), F.array(*dims).alias("x"))


def _ids_repeated(queries: DataFrame, refs: DataFrame) -> int:
    """How often a query's own id stands among the references, at most."""
    own = refs.select("ref_id").join(queries.select(F.col("qid").alias("ref_id")), "ref_id", "left_semi")
    return own.groupBy("ref_id").count().agg(F.max("count")).first()[0] or 0


def _of_all(found: DataFrame, keyed: DataFrame, same_ids: bool) -> DataFrame:
    """What was found for the keys, for every query; none is its own neighbour."""
    out = keyed.select("qid", "key").join(found, "key").select("qid", "ref_id", "is_fraud", "dist")
    return out.where("qid <> ref_id") if same_ids else out


def _packed_cells(refs: DataFrame, dims: list[str], kind: str, most: int) -> DataFrame:
    refs = refs.where("ref_id is not null").select(
        F.col("ref_id").cast("bigint").alias("ref_id"), F.coalesce("is_fraud", F.lit(False)).alias("is_fraud"), *[F.col(d).cast(kind).alias(d) for d in dims]
    )
    n, tasks = refs.count(), refs.sparkSession.sparkContext.defaultParallelism
    splits = fitted(refs, dims, min(CELL[1], max(CELL[0], n // (8 * tasks))), kind, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = splits.cells(np.stack([b.column(d).to_numpy() for d in dims], 1))
            yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], ["cell", *b.schema.names])

    celled = stash(refs.mapInArrow(run, f"cell bigint, {refs.schema.simpleString()[7:-1]}"))
    part = F.lit(0).cast("bigint")
    for cell, rows in celled.groupBy("cell").count().where(F.col("count") > PART).collect():  # a row per cell, at most
        part = F.when(F.col("cell") == cell, F.pmod("ref_id", F.lit(-(-rows // PART)))).otherwise(part)
    out = stash(celled.withColumn("part", part).groupBy("cell", "part").applyInArrow(lambda t: packed(t, dims, kind, most), PACKED))
    discard(celled)
    return out


def _nearest(queries: DataFrame, refs: DataFrame, dims: list[str], k: int, kind: str, same_ids: bool) -> DataFrame:
    """(qid, ref_id, is_fraud, dist): the k nearest of each query, at least."""
    k += _ids_repeated(queries, refs) if same_ids else 0
    width, near = len(dims), 1 - ROUNDING[kind]
    cells = _packed_cells(refs, dims, kind, k)
    boxes = cells.select("cell", "part", "lo", "hi").collect()  # a row per cell
    names = np.array([(r["cell"], r["part"]) for r in boxes], np.int64).reshape(-1, 2)
    lo, hi = (np.array([r[c] for r in boxes], float).reshape(-1, width) for c in ("lo", "hi"))
    keyed = stash(_keyed(queries, dims, kind))
    only = keyed.where("qid = key").select("key", "x")
    blocks = max(1, -(-only.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    spread = cells.drop("lo", "hi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    routed, element = f"key bigint, x array<{kind}>, bound double, cell bigint, part bigint", pa.int32() if kind == "int" else pa.float32()
    result = f"key bigint, x array<{kind}>, cell bigint, part bigint, ids array<bigint>, fraud array<boolean>, dist array<double>"

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the cells they meet: the one with the nearest box, or all others within what it has found."""
        for b in batches:
            for part in (b.slice(at, 4096) for at in range(0, b.num_rows, 4096)) if len(boxes) else ():
                box = box_distance(part.column("x").flatten().to_numpy().reshape(-1, width).astype(float), lo, hi) * near
                limit = np.full(part.num_rows, np.inf)
                if "dist" in part.schema.names:
                    limit = part.column("bound").to_numpy()
                    met = box <= limit[:, None]
                    home = (part.column("cell").to_numpy()[:, None] == names[:, 0]) & (part.column("part").to_numpy()[:, None] == names[:, 1])
                    row, at = np.nonzero(met & ~home)
                else:
                    row, at = np.arange(part.num_rows), box.argmin(1)
                own = part.select(["key", "x"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(limit[row]), *(pa.array(names[at, c]) for c in (0, 1))], ["key", "x", "bound", "cell", "part"])

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        cols, n = [[]] * 7, q.num_rows
        if n and c.num_rows:
            x = q["x"].combine_chunks().flatten().to_numpy().reshape(-1, width)
            row, ids, fraud, dist = Cell(c.to_pylist()[0], width, kind).search(x, q["bound"].to_numpy(), k)
            order = np.argsort(row, kind="stable")
            ends = pa.array(starts_of(np.bincount(row, minlength=n)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (ids, fraud, dist)]
            cols = [q["key"], q["x"], q["cell"], q["part"], *lists]
        types = [pa.int64(), pa.list_(element), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.float64())]
        return pa.table([pa.chunked_array(a.chunks, t) if isinstance(a, pa.ChunkedArray) else pa.array(a, t) for a, t in zip(cols, types)], names=["key", "x", "cell", "part", "ids", "fraud", "dist"])

    def met(rows: DataFrame) -> DataFrame:
        at = ["cell", "part", "block"]
        return rows.withColumn("block", block).groupBy(*at).cogroup(spread.groupBy(*at)).applyInArrow(meet, result)

    first = stash(met(only.mapInArrow(to_cells, routed)))
    bound = F.when(F.size("dist") >= k, F.array_max("dist")).otherwise(F.lit(float("inf")))
    rest = met(first.withColumn("bound", bound).mapInArrow(to_cells, routed)).where(F.size("ids") > 0)
    both = first.unionByName(rest).select("key", F.explode(F.arrays_zip("ids", "fraud", "dist")).alias("f"))
    both = both.select("key", F.col("f.ids").alias("ref_id"), F.col("f.fraud").alias("is_fraud"), F.col("f.dist").cast("bigint" if kind == "int" else "float").alias("dist"))
    order = Window.partitionBy("key").orderBy("dist", "ref_id")
    found = stash(both.where(~F.isnan(F.col("dist").cast("double"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
    discard(cells, first)
    return _of_all(found, keyed, same_ids)


def _native(queries: DataFrame, refs: DataFrame, dims: list[str], k: int, same_ids: bool) -> DataFrame:
    """(qid, ref_id, is_fraud, dist) of the references no farther than the k-th of each query's nearest cell."""
    k += _ids_repeated(queries, refs) if same_ids else 0
    splits = fitted(refs, dims, NATIVE_CELL, "int", refs.count())
    copies = Window.partitionBy(F.xxhash64(*dims), *dims).orderBy("ref_id")
    once = refs.where("ref_id is not null").withColumn("turn", F.row_number().over(copies)).where(F.col("turn") <= k).drop("turn")
    cells = stash(once.withColumn("cell", splits.column(F.array(*dims))))
    boxes = cells.groupBy("cell").agg(F.array(*[F.min(d) for d in dims]).alias("lo"), F.array(*[F.max(d) for d in dims]).alias("hi"))
    boxes = stash(boxes)
    keyed = stash(_keyed(queries, dims, "int"))
    names = [f"_{d}" for d in dims]
    only = keyed.where("qid = key").select("key", *[F.col("x")[d].alias(name) for d, name in enumerate(names)])
    bound = None
    for d, name in enumerate(names):
        gap = F.pow(F.greatest(F.col("lo")[d] - F.col(name), F.col(name) - F.col("hi")[d], F.lit(0)), F.lit(2))  # exact in doubles
        bound = gap if bound is None else bound + gap
    # Beside a lambda Spark makes short methods, which the JVM compiles; all in one are too long for it.
    bound = F.transform(F.array("limit"), lambda most: most.isNull())[0] | (bound <= F.col("limit"))
    dist = squared_distance([F.col(d) for d in dims], [F.col(name) for name in names])
    place = Window.partitionBy("key").orderBy("dist", "ref_id")
    tasks = 4 * refs.sparkSession.sparkContext.defaultParallelism
    # Numbers of partitions are given: small tables that make many pairs would be merged into one task.
    dealt = cells.repartition(tasks, "cell")
    home = only.withColumn("cell", splits.column(F.array(*names))).repartition(tasks, "cell")
    first = home.join(dealt, "cell").select("key", dist.alias("dist"), "ref_id").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    limit = stash(first.groupBy("key").agg(F.when(F.count("*") >= k, F.max("dist")).alias("limit")))
    near = only.join(limit, "key", "left").repartition(tasks)
    met = near.join(F.broadcast(boxes), bound).drop("lo", "hi").repartition(tasks, "cell")  # a box per cell
    found = met.join(dealt, "cell").select("key", "ref_id", "is_fraud", dist.alias("dist"), "limit").where(F.col("limit").isNull() | (F.col("dist") <= F.col("limit")))
    found = stash(found.drop("limit").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).drop("rank"))
    discard(cells, boxes, limit)
    return _of_all(found, keyed, same_ids)


def vote(found: DataFrame) -> DataFrame:
    """(qid, n, fraud): neighbours found and how many of them are fraud."""
    return found.groupBy("qid").agg(F.count("*").alias("n"), F.count_if("is_fraud").alias("fraud"))


def vote_ratio(found: DataFrame) -> DataFrame:
    """Share of fraud among the neighbours found (not among k)."""
    return vote(found).select("qid", "n", "fraud", (F.col("fraud") / F.col("n")).alias("ratio"))


def reference_counts(refs: DataFrame) -> DataFrame:
    return refs.agg(
        F.count("*").alias("n_refs"), F.count_if("is_fraud").alias("n_fraud"), F.count_if(~F.col("is_fraud")).alias("n_legit")
    )
