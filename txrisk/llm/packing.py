"""Best-fit packing of tokenized documents into fixed-length sequences.

Every document is its token ids and one end id; only documents longer than a sequence are cut.
Pieces are dealt evenly into groups of bounded size, and each group is packed by vector best-fit
decreasing: a bin has three residual capacities (tokens, documents, attention cost as the sum of
squared lengths), only bins that satisfy all three are open to a piece, and among them the weighted
dot-product with its demand or the weighted norm of what would be left decides.  A group wastes less
than one sequence over what its own best fit leaves, so the loss shrinks with the group size.

Null and empty texts are pieces of the end id alone; repeated rows are packed once per row; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stash
from .tokens import encoder, tokenizer_path

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@dataclass(frozen=True)
class Packing:
    """Capacities of a sequence and the rule that picks a bin.

    The defaults leave tokens as the tight capacity: 4096 pieces of one token each, and 4096 squared,
    which a sum of squares of lengths that add up to 4096 cannot pass.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    end_id: int = 1
    rule: str = "residual"  # or "dot"
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    group: int = 8192


def cut(ids: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    n = len(ids) // 4
    for piece, start in enumerate(range(0, n, size)):
        part = ids[4 * start : 4 * (start + size)]
        yield piece, start, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, how: Packing, path: str | None = None) -> DataFrame:
    """One row per piece, whole texts tokenized."""
    path = path or tokenizer_path()
    end = np.array([how.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            rows = [(i, *p) for i, t in enumerate(texts) for p in cut((enc.encode(t) if t else b"") + end, how.tokens)]
            at, piece, start, length, crc = (np.array(c, np.int64) for c in (zip(*rows) if rows else [[]] * 5))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at)), *map(pa.array, (piece.astype(np.int32), start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, how: Packing) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    caps = np.array([how.tokens, how.documents, how.attention], float)
    weight = np.array(how.weights)
    left = np.empty((len(lengths), 3))  # residual capacities of open bins, as far as `n_open`
    name = np.empty(len(lengths), np.int64)
    n_open = n_bins = 0
    least = lengths[order[-1]] if len(order) else 0
    for k, i in enumerate(order):
        if k % 256 == 255:  # bins too full for even the smallest piece are closed
            keep = (left[:n_open, 0] >= least) & (left[:n_open, 1] >= 1) & (left[:n_open, 2] >= float(least) ** 2)
            m = int(keep.sum())
            left[:m], name[:m] = left[:n_open][keep], name[:n_open][keep]
            n_open = m
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        fits = np.flatnonzero((left[:n_open, 0] >= size) & (left[:n_open, 1] >= 1) & (left[:n_open, 2] >= need[2]))
        if len(fits):
            if how.rule == "dot":
                best = fits[np.argmax((left[fits] / caps) @ (weight * need / caps))]
            else:
                best = fits[np.argmin((((left[fits] - need) / caps) ** 2) @ weight)]
        else:
            best = n_open
            left[best], name[best] = caps, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i] = name[best]
        offsets[i] = how.tokens - left[best, 0]
        left[best] -= need
    return bins, offsets


def pack(docs: DataFrame, how: Packing = Packing(), path: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    made = stash(pieces(docs, how, path).withColumn("_row", F.monotonically_increasing_id()))
    groups = max(1, -(-made.count() // how.group))
    dealt = made.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def fill(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        bins, offsets = best_fit(b["length"].to_numpy(), how)
        return b.drop(columns=["_row", "_group"]).assign(sequence_id=(b["_group"].to_numpy() << 32) + bins, offset=offsets)

    # Ids pass pandas as text: it has no 64-bit integers with nulls.
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = PIECES.replace("doc_id bigint", "doc_id string")
    packed = dealt.groupBy("_group").applyInPandas(fill, f"{schema}, sequence_id bigint, offset bigint")
    return packed.withColumn("doc_id", F.col("doc_id").cast("bigint"))
