"""Readers and writers of references, constants, models and indexes."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.errors import DecodeError, ReadError
from txrisk.operators import ivf
from txrisk.operators.models import Ensemble, Logistic, Node, Predictor
from txrisk.schema import DEFAULT_RISK, DIMS, MCC_RISK, SCALE, Normalization
from txrisk.storage import stash

INTS = [f"q{d}" for d in range(DIMS)]


def references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, v0.., is_fraud) of a JSON array of {vector, label}, gzipped or not.

    Longer vectors are cut and shorter ones padded with zeros; only the label "fraud" is positive.  A
    row that does not decode fails the read.  One gzipped array is one task: write it to Parquet once.
    """
    try:
        rows = (
            spark.read.schema("vector array<double>, label string")
            .option("multiLine", True).option("mode", "FAILFAST").json(path)
        )
    except Exception as e:
        raise ReadError(f"cannot read {path}") from e
    return as_references(rows.withColumn("ref_id", F.monotonically_increasing_id()))


def as_references(rows: DataFrame) -> DataFrame:
    """(ref_id, v0.., is_fraud) of (ref_id, vector, label)."""
    full = F.slice(F.concat(F.coalesce("vector", F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), DIMS)), 1, DIMS)
    v = rows.select("ref_id", full.alias("x"), F.coalesce(F.col("label") == "fraud", F.lit(False)).alias("is_fraud"))
    return v.select("ref_id", *[F.col("x")[d].cast("float").alias(f"v{d}") for d in range(DIMS)], "is_fraud")


def _one_json(spark: SparkSession, path: str, schema: str):
    try:
        row = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).first()
    except Exception as e:
        raise ReadError(f"cannot read {path}") from e
    if row is None:
        raise DecodeError(f"{path} is empty")
    return row


def normalization(spark: SparkSession, path: str) -> Normalization:
    names = list(vars(Normalization()))
    row = _one_json(spark, path, ", ".join(f"{n} double" for n in names))
    try:
        return Normalization(**{n: row[n] or 0.0 for n in names})
    except ValueError as e:
        raise DecodeError(f"{path}: {e}") from e


def mcc_risks(spark: SparkSession, path: str) -> dict[str, float]:
    """Risk by code; keys that are not four digits are left out."""
    try:
        text = spark.read.text(path, wholetext=True)
        m = text.select(F.from_json("value", "map<string,double>", {"mode": "FAILFAST"}).alias("m")).first()
    except Exception as e:
        raise ReadError(f"cannot read {path}") from e
    if m is None or m["m"] is None:
        raise DecodeError(f"{path} holds no map")
    return {k: v for k, v in m["m"].items() if len(k) == 4 and k.isascii() and k.isdigit() and v is not None}


def mcc_table(spark: SparkSession, risks: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((risks or MCC_RISK).items()), "mcc string, risk double")


def _bytes(spark: SparkSession, path: str) -> bytes:
    try:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    except Exception as e:
        raise ReadError(f"cannot read {path}") from e


# Binary models and indexes (little-endian; magics, versions and field widths are fixed values).

TREES_MAGIC, LOGISTIC_MAGIC, INDEX_MAGIC, INDEX_VERSION = b"GBDT", 0x4C4F4752, 0x49564649, 5
OLD_NODE = np.dtype([("feat", "u1"), ("thresh", "<f8"), ("left", "<u2"), ("right", "<u2"), ("value", "<f4"), ("leaf", "u1")])
NEW_NODE = np.dtype([("feat", "u1"), ("_a", "u1"), ("left", "<u2"), ("right", "<u2"), ("leaf", "u1"), ("_b", "u1"), ("value", "<f4")])


def _tree_nodes(data: bytes, at: int, n_trees: int, kind: np.dtype) -> list[np.ndarray]:
    out = []
    for _ in range(n_trees):
        if at + 4 > len(data):
            raise DecodeError("trees end early")
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
        if at + n * kind.itemsize > len(data):
            raise DecodeError("nodes end early")
        out.append(np.frombuffer(data, kind, n, at))
        at += n * kind.itemsize
    return out


def parse_trees(data: bytes) -> Ensemble:
    """Both layouts of boosted trees; any version but 2 is the old one, whose leaves are scaled by the rate."""
    if len(data) < 16 or data[:4] != TREES_MAGIC:
        raise DecodeError("not a tree file")
    version, n_trees = struct.unpack_from("<II", data, 4)
    if version == 2:
        if len(data) < 24:
            raise DecodeError("header ends early")
        initial, sigmoid = struct.unpack_from("<fB", data, 16)
        nodes, rate, sigmoid = _tree_nodes(data, 24, n_trees, NEW_NODE), 1.0, bool(sigmoid)
    else:
        if len(data) < 28:
            raise DecodeError("header ends early")
        rate, initial = struct.unpack_from("<dd", data, 12)
        nodes, sigmoid = _tree_nodes(data, 28, n_trees, OLD_NODE), True

    def node(r) -> Node:
        if r["leaf"]:
            return Node(-1, 0.0, value=float(np.float32(rate) * np.float32(r["value"])))
        split = r["value"] if version == 2 else np.float32(r["thresh"])
        return Node(int(r["feat"]), float(split), int(r["left"]), int(r["right"]))

    return Ensemble(tuple(tuple(node(r) for r in t) for t in nodes), float(np.float32(initial)), sigmoid)


def trees(spark: SparkSession, path: str) -> Ensemble:
    return parse_trees(_bytes(spark, path))


def parse_logistic(data: bytes) -> Logistic:
    if len(data) < 20:
        raise DecodeError("header ends early")
    magic, version, n, bias = struct.unpack_from("<IIId", data)
    if magic != LOGISTIC_MAGIC:
        raise DecodeError("not a logistic model")
    if version != 1:
        raise DecodeError(f"version {version}")
    if len(data) < 20 + 8 * n:
        raise DecodeError("weights end early")
    return Logistic(struct.unpack_from(f"<{n}d", data, 20), bias)


def dump_logistic(model: Logistic) -> bytes:
    n = len(model.weights)
    return struct.pack(f"<IIId{n}d", LOGISTIC_MAGIC, 1, n, model.bias, *model.weights)


def logistic(spark: SparkSession, path: str) -> Logistic:
    return parse_logistic(_bytes(spark, path))


def predictor(spark: SparkSession, path: str) -> Predictor:
    """The logistic model of a file, as a predictor."""
    return Predictor(logistic(spark, path))


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file(spark, path)
    return fs.exists(at)


def save_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """Write a file through Hadoop's file systems, over one that is there."""
    at, fs = _file(spark, path)
    out = fs.create(at, True)
    try:
        for lo in range(0, len(data), 1 << 20):
            out.write(bytearray(data[lo : lo + (1 << 20)]))
    finally:
        out.close()


def save_logistic(spark: SparkSession, model: Logistic, path: str) -> None:
    save_bytes(spark, dump_logistic(model), path)


@dataclass
class FlatIndex:
    """The arrays of a binary index file."""

    centroids: np.ndarray
    offsets: np.ndarray
    low: np.ndarray
    high: np.ndarray
    vectors: np.ndarray
    fraud: np.ndarray


def parse_index(data: bytes) -> FlatIndex:
    if len(data) < 20:
        raise DecodeError("header ends early")
    magic, version, nlist, dim, n = struct.unpack_from("<5I", data)
    if (magic, version, dim) != (INDEX_MAGIC, INDEX_VERSION, DIMS):
        raise DecodeError(f"magic {magic:#x}, version {version}, {dim} dimensions")
    at, out = 20, []
    for kind, shape in (("<f4", (nlist, dim)), ("<u4", (nlist + 1,)), ("<i2", (nlist, dim)), ("<i2", (nlist, dim)), ("<i2", (n, dim)), ("u1", (-(-n // 8),))):
        count = int(np.prod(shape))
        if at + count * np.dtype(kind).itemsize > len(data):
            raise DecodeError("arrays end early")
        out.append(np.frombuffer(data, kind, count, at).reshape(shape))
        at += count * np.dtype(kind).itemsize
    out[-1] = np.unpackbits(out[-1], bitorder="little")[:n].astype(bool)
    return FlatIndex(*out)


def dump_index(x: FlatIndex) -> bytes:
    head = struct.pack("<5I", INDEX_MAGIC, INDEX_VERSION, len(x.centroids), DIMS, len(x.vectors))
    arrays = (x.centroids, "<f4"), (x.offsets, "<u4"), (x.low, "<i2"), (x.high, "<i2"), (x.vectors, "<i2")
    return head + b"".join(np.ascontiguousarray(a, k).tobytes() for a, k in arrays) + np.packbits(x.fraud, bitorder="little").tobytes()


def import_index(spark: SparkSession, path: str) -> ivf.Index:
    """A binary index as tables.  The file holds one machine's worth; larger indexes are Parquet (`Index.save`)."""
    x = parse_index(_bytes(spark, path))
    cluster = np.repeat(np.arange(len(x.centroids)), np.diff(x.offsets.astype(np.int64)))
    pos = np.arange(len(x.vectors)) - x.offsets.astype(np.int64)[cluster]
    columns = {"ci": cluster.astype(np.int32), "pos": pos.astype(np.int32), "ref_id": np.arange(len(x.vectors))}
    columns |= {d: x.vectors[:, k].astype(np.int32) for k, d in enumerate(INTS)} | {"is_fraud": x.fraud}
    members = stash(spark.createDataFrame(pa.table(columns)))  # Arrow columns, no Python rows
    return ivf.Index(x.centroids.astype(float) * SCALE, members, stash(ivf.boxes(members, INTS)), INTS)


def packed_lists(index: ivf.Index) -> DataFrame:
    """(ci, n, vectors, fraud): each list's arrays in order, packed where its members are."""

    dims = index.dims

    def run(m: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values("pos")
        v = np.ascontiguousarray(m[dims].to_numpy("<i2")).tobytes()
        return pd.DataFrame({"ci": [m["ci"].iloc[0]], "n": [len(m)], "vectors": [v], "fraud": [m["is_fraud"].to_numpy(np.uint8).tobytes()]})

    return index.members.groupBy("ci").applyInPandas(run, "ci int, n bigint, vectors binary, fraud binary")


def export_index(index: ivf.Index) -> FlatIndex:
    """Tables as the arrays of a binary index.

    The format is one file for one machine, so its arrays (29 bytes a member) must fit the driver; larger
    indexes stay Parquet (`Index.save`).
    """
    rows = packed_lists(index).toPandas().sort_values("ci")
    n = np.zeros(index.nlist, np.int64)
    n[rows["ci"]] = rows["n"]
    v = np.frombuffer(b"".join(rows["vectors"]), "<i2").reshape(-1, DIMS)
    offsets = np.concatenate([[0], np.cumsum(n)])
    low, high = np.zeros((index.nlist, DIMS), np.int64), np.zeros((index.nlist, DIMS), np.int64)
    for c in np.flatnonzero(n):
        own = v[offsets[c] : offsets[c + 1]]
        low[c], high[c] = own.min(0), own.max(0)
    return FlatIndex(index.centroids / SCALE, offsets, low, high, v, np.frombuffer(b"".join(rows["fraud"]), np.uint8).astype(bool))


@dataclass
class Dataset:
    """Constants, references or an index, and optional models."""

    norm: Normalization
    risks: dict[str, float]
    refs: DataFrame | None = None
    index: ivf.Index | None = None
    trees: Ensemble | None = None

    @property
    def kind(self) -> str:
        return "ivf" if self.index is not None else "exact" if self.refs is not None else "empty"


def load_constants(spark: SparkSession, folder: str) -> Dataset:
    """Constants alone, without references."""
    at = PurePosixPath(folder)
    return Dataset(normalization(spark, str(at / "normalization.json")), mcc_risks(spark, str(at / "mcc_risk.json")))


def load_default(spark: SparkSession, folder: str) -> Dataset:
    """Constants; the index if it loads, else the references; and trees if they load."""
    out, at = load_constants(spark, folder), PurePosixPath(folder)
    try:
        out.index = import_index(spark, str(at / "ivf.bin"))
    except (ReadError, DecodeError):
        out.refs = references(spark, str(at / "references.json.gz"))
    for name in ("gbdt.bin", "model.bin"):
        try:
            out.trees = trees(spark, str(at / name))
            break
        except (ReadError, DecodeError):
            continue
    return out


def in_memory(spark: SparkSession, rows: list[tuple[list[float], str]]) -> DataFrame:
    """References from Python rows."""
    numbered = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    return as_references(spark.createDataFrame(numbered, "ref_id bigint, vector array<double>, label string"))
