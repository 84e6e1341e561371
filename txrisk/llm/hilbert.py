"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``2**bits`` steps by its own quantiles (strings by the ranks of their
distinct values, weighted by rows), the cell gets its index on the
Hilbert curve, and rows sorted by that index are cut into runs of equal row counts.  Neighbours on
the curve are neighbours in every dimension, so each shard covers a small box and a reader can prune
files on any of them.

Nulls sort before all values, a null text counts as empty, equal cells are ordered by text checksum
and id, repeated rows keep one place each, and an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, discard, keyed, partitions, stash, whole

BITS = 5
OVERHEAD = 16


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points, one per row, by Skilling's transform."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = top
    while q > 1:
        turn = np.where((x[:, n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def string_cuts(values: DataFrame, steps: int) -> list[str]:
    """At most ``steps - 1`` values of the column ``v`` that cut the rows into ``steps`` runs, as evenly as whole values allow."""
    n = values.where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    spark = values.sparkSession
    ranged = stash(n.repartitionByRange(partitions(spark), "v").withColumn("_part", F.spark_partition_id()))
    sums, total = {}, 0
    for part, held in sorted(map(tuple, ranged.groupBy("_part").agg(F.sum("n")).collect())):
        sums[part] = total
        total += held
    if not total:
        return []
    before = spark.createDataFrame(sorted(sums.items()), "_part int, _offset long")  # one row per partition
    own = Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = ranged.withColumn("upto", F.sum("n").over(own)).join(F.broadcast(before), "_part")
    upto = upto.withColumn("upto", F.col("upto") + F.col("_offset"))
    step = lambda x: F.floor(x * steps / F.lit(total))
    cuts = upto.where((step(F.col("upto") - F.col("n")) < step(F.col("upto"))) & (F.col("upto") < total)).select("v").collect()
    discard(ranged)
    return sorted(r["v"] for r in cuts)


def cells(values: pa.Array, cuts: list) -> np.ndarray:
    """How many cuts are smaller than each value; null is before all."""
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        held = values.dictionary_encode()
        of = np.array([bisect.bisect_left(cuts, x) for x in held.dictionary.to_pylist()] + [0], np.int64)
        return of[held.indices.fill_null(len(of) - 1).to_numpy(zero_copy_only=False)]
    x = values.cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
    return np.searchsorted(np.asarray(cuts, float), x, side="left")


def hilbert_shards(rows: DataFrame, dims: list[str], n_shards: int, bits: int = BITS) -> DataFrame:
    """``rows`` (a narrow table, without texts) with ``hilbert``, ``shard`` and ``slot``.

    ``dims`` are numeric or string columns.  Counts per shard differ by one at most.
    """
    spark = rows.sparkSession
    rows = stash(rows.withColumn("_row", F.monotonically_increasing_id()))
    steps = 1 << bits
    words = [d for d in dims if rows.schema[d].dataType.simpleString() == "string"]
    quantiles = [k / steps for k in range(1, steps)]
    numbers = [F.percentile_approx(d, quantiles, 2000).alias(d) for d in dims if d not in words]
    edges = rows.agg(F.count("*").alias("_n"), *numbers).first()
    cut = [string_cuts(rows.select(F.col(d).alias("v")), steps) if d in words else sorted(set(edges[d] or [])) for d in dims]
    schema = f"{rows.schema.simpleString()[7:-1]},hilbert:bigint"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turn = hilbert_index(np.stack([cells(b.column(d), c) for d, c in zip(dims, cut)], 1), bits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(turn)], [*b.schema.names, "hilbert"])

    curve = rows.mapInArrow(index, schema)
    order = ["hilbert", "text_crc32", "doc_id", "_row"]
    sorted_rows = stash(
        curve.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    discard(rows)
    # One count per partition: as many rows as the session has shuffle partitions.
    counts = sorted(map(tuple, sorted_rows.groupBy("_part").count().collect()))
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    base, more = divmod(total, n_shards)
    place = spark.createDataFrame(offsets or [(0, 0)], "_part int, _offset long")
    pos = F.col("_offset") + F.col("_nth")
    long_rows = more * (base + 1)
    shard = F.when(pos < long_rows, F.floor(pos / (base + 1))).otherwise(more + F.floor((pos - long_rows) / max(base, 1)))
    slot = F.when(pos < long_rows, pos % (base + 1)).otherwise((pos - long_rows) % max(base, 1))
    return (
        sorted_rows.join(F.broadcast(place), "_part")
        .withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")})
        .drop("_part", "_nth", "_offset", "_row")
    )


def placed(docs: DataFrame, n_shards: int, more: list[str]) -> DataFrame:
    """Size, text checksum, shard, slot and the columns ``more`` of each document (doc_id, text, lang, source)."""
    text = whole(F.col("text"))
    rows = docs.select(
        *more,
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("lang").cast("string").alias("d_lang"),
        F.col("source").cast("string").alias("d_source"),
    )
    return hilbert_shards(rows, ["d_lang", "d_source", "size"], n_shards)


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """One row per document: its size, text checksum and place under the law of equal row counts."""
    return placed(docs, n_shards, []).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """The documents themselves, one folder per shard, each in curve order; a shard's files are runs of its slots.

    Rows that repeat keep a place each.
    """
    rows = keyed(docs)
    narrow = rows.select(*KEY, *[F.col("r")[c].alias(c) for c in ("doc_id", "text", "lang", "source")])
    place = stash(placed(narrow, n_shards, KEY).select(*KEY, F.col("shard").alias("_shard"), F.col("slot").alias("_slot")))
    dealt = rows.join(place, KEY).repartitionByRange(max(n_shards, partitions(docs.sparkSession)), "_shard", "_slot")
    dealt = dealt.sortWithinPartitions("_shard", "_slot").select(F.col("_shard").alias("shard"), "r.*" if "shard" not in docs.columns else "r")
    dealt.write.partitionBy("shard").parquet(path)
    discard(place)
