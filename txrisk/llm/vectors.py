"""Embedding tables: which vectors take part, and vectors as packed bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that fits codebooks and calibrates thresholds.
SAMPLE = 20_000


def usable(embedding: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    big = F.lit(float("inf"))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def sample(df: DataFrame, n: int = SAMPLE) -> np.ndarray:
    """At most ``n`` vectors, chosen by the hash of their id."""
    rows = df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select(F.col("embedding").cast("array<double>")).toArrow()
    col = rows.column(0).combine_chunks() if rows.num_rows else None
    if col is None or not len(col):
        return np.zeros((0, 0))
    lengths = np.diff(np.asarray(col.offsets))
    d = int(np.bincount(lengths).argmax())
    return np.stack([v for v in col.to_numpy(zero_copy_only=False) if len(v) == d])


def stacked(values) -> np.ndarray:
    """A matrix of doubles from a pandas column of float arrays or of packed floats."""
    values = list(values)
    if values and isinstance(values[0], (bytes, bytearray)):
        return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)
    return np.array([np.asarray(v, float) for v in values]) if values else np.zeros((0, 0))
