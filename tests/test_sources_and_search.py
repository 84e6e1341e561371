"""Readers, binary files, and nearest neighbours on hand-made references."""

import gzip
import json
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from txrisk import build_index, storage
from txrisk.errors import DecodeError, ReadError
from txrisk.operators import ivf, knn, models, telemetry
from txrisk.operators.models import Ensemble, Logistic, Node
from txrisk.plans import scoring
from txrisk.schema import Normalization, SearchConfig
from txrisk.sources import resources
from txrisk.sources.resources import INTS
from txrisk.streaming import scoring as stream


def refs_of(spark, rows):
    """rows: (id, first dimension, is_fraud)."""
    data = [(i, x, *[0] * 13, f) for i, x, f in rows]
    return spark.createDataFrame(data, "ref_id bigint, " + ", ".join(f"{q} int" for q in INTS) + ", is_fraud boolean")


def queries_of(spark, rows):
    return spark.createDataFrame([(i, x, *[0] * 13) for i, x in rows], "qid bigint, " + ", ".join(f"{q} int" for q in INTS))


def test_references(spark, tmp_path):
    rows = [{"vector": [0.5] * 16, "label": "fraud"}, {"vector": [0.25], "label": "legit"}, {"vector": [], "label": "FRAUD"}]
    p = tmp_path / "references.json.gz"
    p.write_bytes(gzip.compress(json.dumps(rows).encode()))
    got = resources.references(spark, str(p)).orderBy("ref_id").collect()
    assert [r["is_fraud"] for r in got] == [True, False, False]
    assert got[0]["v13"] == 0.5 and got[1]["v0"] == 0.25 and got[1]["v1"] == 0.0 and len(got[0]) == 16


def test_missing_and_broken_files(spark, tmp_path):
    with pytest.raises(ReadError):
        resources.normalization(spark, str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("invalid json {")
    with pytest.raises((ReadError, DecodeError)):
        resources.normalization(spark, str(tmp_path / "bad.json"))
    (tmp_path / "half.json").write_text('{"max_km": 5}')
    with pytest.raises(DecodeError):
        resources.normalization(spark, str(tmp_path / "half.json"))


def test_constants(spark, tmp_path):
    (tmp_path / "normalization.json").write_text(json.dumps(vars(Normalization(max_km=7.0))))
    (tmp_path / "mcc_risk.json").write_text(json.dumps({"5411": 0.1, "54": 0.2, "abcd": 0.3}))
    d = resources.load_constants(spark, str(tmp_path))
    assert d.norm.max_km == 7 and d.risks == {"5411": 0.1} and d.kind == "empty"
    (tmp_path / "references.json.gz").write_bytes(gzip.compress(b'[{"vector":[1],"label":"fraud"}]'))
    assert resources.load_default(spark, str(tmp_path)).kind == "exact"


def test_tree_files():
    def new(nodes, initial=0.0, sigmoid=1):
        body = b"".join(struct.pack("<BBHHBBf", f, 0, a, b, leaf, 0, v) for f, a, b, leaf, v in nodes)
        return b"GBDT" + struct.pack("<IIIfB3xI", 2, 1, 14, initial, sigmoid, len(nodes)) + body

    m = resources.parse_trees(new([(0, 1, 2, 0, 0.5), (0, 0, 0, 1, 0.1), (0, 0, 0, 1, 0.9)], 1.5, 0))
    assert not m.sigmoid and m.initial == 1.5 and m.trees[0][0].threshold == 0.5 and m.trees[0][2].value == pytest.approx(0.9)
    old = b"GBDT" + struct.pack("<IIddI", 7, 1, 0.5, 0.25, 1) + struct.pack("<BdHHfB", 0, 0.0, 0, 0, 2.0, 1)
    m = resources.parse_trees(old)
    assert m.sigmoid and m.initial == 0.25 and m.trees[0][0].value == 1.0
    for bad in (b"", b"GBDX" + bytes(30), old[:-1], new([(0, 0, 0, 1, 1.0)])[:-2]):
        with pytest.raises(DecodeError):
            resources.parse_trees(bad)


def test_logistic_files():
    m = Logistic(tuple(np.linspace(-1, 1, 119)), 0.5)
    assert resources.parse_logistic(resources.dump_logistic(m)) == m
    for bad in (b"", bytes(40), resources.dump_logistic(m)[:-1]):
        with pytest.raises(DecodeError):
            resources.parse_logistic(bad)


def test_index_files(spark, tmp_path):
    refs = refs_of(spark, [(i, 100 * i, i % 3 == 0) for i in range(20)])
    x = ivf.build(refs, ivf.sampled_centroids(refs, INTS, 5), INTS)
    data = resources.dump_index(resources.export_index(x))
    (tmp_path / "ivf.bin").write_bytes(data)
    y = resources.import_index(spark, str(tmp_path / "ivf.bin"))
    cols = ["ci", "pos", *INTS, "is_fraud"]
    assert sorted(x.members.select(cols).collect()) == sorted(y.members.select(cols).collect())
    assert np.allclose(x.centroids, y.centroids)
    with pytest.raises(DecodeError):
        resources.parse_index(data[:50])
    x.save(str(tmp_path / "index"))
    z = ivf.Index.load(spark, str(tmp_path / "index"))
    q = queries_of(spark, [(1, 130), (2, 1900)])
    assert sorted(ivf.two_tier(q, x).collect()) == sorted(ivf.two_tier(q, z).collect())


def test_ties_and_votes(spark):
    refs = refs_of(spark, [(1, 10, True), (2, -10, False), (3, 10, True), (4, 500, False)])
    q = queries_of(spark, [(7, 0)])
    for native in (False, True):
        f = knn.exact_knn(q, refs, INTS, 3, native)
        assert [r["ref_id"] for r in f.orderBy("rank").collect()] == [1, 2, 3]
        assert knn.vote_ratio(f).first()["ratio"] == pytest.approx(2 / 3)


def test_few_references_scale_the_exact_vote_and_not_the_clustered_one(spark):
    refs, q = refs_of(spark, [(1, 10, True), (2, 20, True)]), queries_of(spark, [(7, 0)])
    assert scoring.exact_votes(q, refs).first()["fraud"] == 5
    x = ivf.build(refs, np.zeros((1, 14)), INTS)
    assert ivf.two_tier(q, x).first()["fraud"] == 2


def test_no_references(spark):
    refs, q = refs_of(spark, []), queries_of(spark, [(7, 0)])
    assert knn.exact_knn(q, refs, INTS).count() == 0
    x = ivf.build(refs, np.zeros((0, 14)), INTS)
    assert ivf.two_tier(q, x).collect() == [(7, 0)]
    assert knn.exact_knn(queries_of(spark, []), refs_of(spark, [(1, 1, True)]), INTS).count() == 0


def test_forms_agree_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    refs = refs_of(spark, [(i, int(v), bool(v % 2)) for i, v in enumerate(rng.integers(-50, 50, 200))])
    q = queries_of(spark, [(i, int(v)) for i, v in enumerate(rng.integers(-50, 50, 20))])
    cols = ["qid", "rank", "ref_id", "dist"]
    a, b = (sorted(knn.exact_knn(q, refs, INTS, 5, n).select(cols).collect()) for n in (False, True))
    assert a == b


def test_blocks_of_queries_and_references_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 16)
    monkeypatch.setattr(knn, "BLOCKS_HELD", 2)
    monkeypatch.setattr(knn, "DISTANCES", 300)
    rng = np.random.default_rng(11)
    x = rng.integers(-9, 9, (150, 14))  # many ties
    refs = spark.createDataFrame([(i, *map(int, v), bool(i % 3)) for i, v in enumerate(x)], "ref_id bigint, " + ", ".join(f"{q} int" for q in INTS) + ", is_fraud boolean").repartition(5)
    q = refs.where("ref_id % 2 = 0").select(F.col("ref_id").alias("qid"), *INTS)
    got = {}
    for r in knn.exact_knn(q, refs, INTS, 5, same_ids=True).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["dist"], r["ref_id"], r["is_fraud"]))
    assert len(got) == 75
    for i, found in got.items():
        want = sorted((int(((x[i] - x[j]) ** 2).sum()), j) for j in range(150) if j != i)[:5]
        assert sorted(found) == [(n + 1, d, j, bool(j % 3)) for n, (d, j) in enumerate(want)]


def test_single_precision_search(spark):
    rng = np.random.default_rng(12)
    x = rng.random((80, 14)).astype(np.float32)
    names = [f"v{d}" for d in range(14)]
    refs = spark.createDataFrame([(i, *map(float, v), bool(i % 3)) for i, v in enumerate(x)], "ref_id bigint, " + ", ".join(f"{c} float" for c in names) + ", is_fraud boolean")
    q = refs.where("ref_id < 20").select(F.col("ref_id").alias("qid"), *names)
    for r in knn.float_knn(q, refs, names, 3, same_ids=True).collect():
        total = np.float32(0)
        for d in range(14):
            gap = x[r["qid"], d] - x[r["ref_id"], d]
            total = np.float32(total + gap * gap)
        assert r["dist"] == total
        exact = np.sort(((x[r["qid"]].astype(float) - x.astype(float)) ** 2).sum(1))
        assert r["dist"] == pytest.approx(exact[r["rank"]], rel=1e-5)


def test_sampled_centroids_span_all_ids(spark, monkeypatch):
    refs = spark.range(10_000).select(F.col("id").alias("ref_id"), F.col("id").cast("int").alias("q0"))
    got = ivf.sampled_centroids(refs, ["q0"], 20)[:, 0]
    assert len(got) == 500 and (np.diff(got) > 0).all() and np.histogram(got, 10, (0, 10_000))[0].min() > 20
    monkeypatch.setattr(ivf, "MAX_CLUSTERS", 100)
    few = ivf.sampled_centroids(refs, ["q0"], 20)[:, 0]
    assert len(few) == 100 and set(few) <= set(got) and few.max() > 9_000


def test_hot_clusters_go_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    refs = refs_of(spark, [(i, int(v), bool(i % 2)) for i, v in enumerate(rng.integers(0, 60, 200))])
    q = queries_of(spark, [(i, int(v)) for i, v in enumerate(rng.integers(0, 60, 40))])
    x = ivf.build(refs, np.zeros((1, 14)), INTS)
    want = sorted(map(tuple, ivf.two_tier(q, x).collect()))
    cols = ["qid", "rank", "pos", "dist"]
    p = ivf.probes(q, x, 1)
    first = sorted(ivf.top(ivf.scan(p, x)).select(cols).collect())
    monkeypatch.setattr(ivf, "PART", 7)
    assert sorted(ivf.top(ivf.scan(p, x)).select(cols).collect()) == first
    assert sorted(map(tuple, ivf.two_tier(q, x).collect())) == want


def test_index_build_command(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [{"vector": [round(float(v), 4) for v in rng.random(14)], "label": "fraud" if i % 4 == 0 else "legit"} for i in range(300)]
    (tmp_path / "references.json.gz").write_bytes(gzip.compress(json.dumps(rows).encode()))
    build_index.main(["--resources", str(tmp_path), "--nlist", "12", "--iterations", "3"])
    binary = resources.import_index(spark, str(tmp_path / "ivf.bin"))
    native = ivf.Index.load(spark, str(tmp_path / "index"))
    assert binary.nlist == native.nlist == 12 and binary.members.count() == native.members.count() == 300
    assert np.allclose(binary.centroids, native.centroids, atol=0.01)
    cols = ["ci", "pos", *INTS, "is_fraud"]
    assert sorted(binary.members.select(cols).collect()) == sorted(native.members.select(cols).collect())
    # Final lists, so every member is nearest to its own centroid.
    for r in native.members.collect():
        d = ((native.centroids - np.array([r[c] for c in INTS])) ** 2).sum(1)
        assert d[r["ci"]] <= d.min() + 1e-6
    (tmp_path / "normalization.json").write_text(json.dumps(vars(Normalization())))
    (tmp_path / "mcc_risk.json").write_text(json.dumps({"5411": 0.1}))
    assert resources.load_default(spark, str(tmp_path)).kind == "ivf"


def test_lloyd(spark):
    refs = refs_of(spark, [(1, 0, False), (2, 1000, False), (3, 5000, True), (4, 7000, True)])
    start = np.zeros((3, 14))
    start[:, 0] = 0, 7000, -(10**6)
    assert ivf.lloyd(refs, start, INTS, 5)[:, 0].tolist() == [500, 6000, -(10**6)]


def test_large_ensembles_are_walked_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    trees = tuple((Node(int(rng.integers(14)), float(np.float32(rng.random())), 1, 2), Node(-1, 0, value=float(np.float32(0.02 * rng.normal()))), Node(-1, 0, value=float(np.float32(0.02 * rng.normal())))) for _ in range(40))
    names = [f"v{d}" for d in range(14)]
    x = spark.createDataFrame([tuple(map(float, v)) for v in rng.random((50, 14))], ", ".join(f"{c} float" for c in names))
    for sigmoid in (True, False):
        m = Ensemble(trees, 0.5, sigmoid)
        a = [r[0] for r in x.select(models.ensemble_score(m, [F.col(c) for c in names])).collect()]
        monkeypatch.setattr(models, "MOST_CONDITIONS", 10)
        b = [r[0] for r in x.select(models.ensemble_score(m, [F.col(c) for c in names])).collect()]
        monkeypatch.undo()
        assert a == b and len(set(a)) > 5


def test_logistic_predictor(spark, tmp_path):
    m = Logistic(tuple(np.linspace(-1, 1, 119)), 0.5)
    path = str(tmp_path / "logreg.bin")
    assert not resources.exists(spark, path)
    resources.save_logistic(spark, m, path)
    p = resources.predictor(spark, path)
    x = [F.lit(0.1 * d) for d in range(14)]
    a, b, c = spark.range(1).select(p.predict(x), models.logistic_score(m, x), models.Predictor().predict(x)).first()
    assert resources.exists(spark, path) and a == b and c == 0 and p.count() == p.fraud_count() == 0


def test_all_probes_equal_exact(spark):
    rng = np.random.default_rng(2)
    refs = refs_of(spark, [(i, int(v), bool(i % 3 == 0)) for i, v in enumerate(rng.permutation(2000)[:300])])
    q = queries_of(spark, [(i, int(v)) for i, v in enumerate(rng.integers(0, 2000, 30))])
    x = ivf.build(refs, ivf.sampled_centroids(refs, INTS, 40), INTS)
    got = dict(map(tuple, ivf.two_tier(q, x, SearchConfig(128, 128)).collect()))
    assert got == dict(map(tuple, scoring.exact_votes(q, refs).collect()))


def test_box_bound_is_lossless(spark):
    rng = np.random.default_rng(3)
    refs = refs_of(spark, [(i, int(v), False) for i, v in enumerate(rng.integers(0, 5000, 200))])
    x = ivf.build(refs, ivf.sampled_centroids(refs, INTS, 20), INTS)
    p = ivf.probes(queries_of(spark, [(1, 800), (2, 4000)]), x, x.nlist)
    least = ivf.scan(p, x, 1).groupBy("qid", "probe").agg(F.min("dist").alias("d"))
    assert ivf.box_bound(p, x).join(least, ["qid", "probe"]).where("bound > d").count() == 0


def test_kmeans_update(spark):
    refs = refs_of(spark, [(1, 0, False), (2, 2500, False), (3, 5000, True), (4, 7500, True)])
    centroids = np.zeros((3, 14))
    centroids[1, 0], centroids[2, 0] = 7000, -10**6
    u = {r["ci"]: (r["n"], r["q0"]) for r in ivf.updated(ivf.assign(refs, centroids, INTS), centroids, INTS).collect()}
    assert u == {0: (2, 1250), 1: (2, 6250), 2: (0, -(10**6))}


def test_histogram_and_ring(spark):
    rows = [(i, 250 * (i % 60), i % 6, i % 10 == 9) for i in range(300)]
    log = spark.createDataFrame(rows, "seq bigint, latency_us bigint, fraud int, parse_error boolean").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000))
    )
    h = {r["bucket_us"]: r["n"] for r in telemetry.histogram(log).collect()}
    assert sum(h.values()) == 300 and h[250] == 10 and -1 in h
    o = telemetry.outliers(log).collect()
    assert len(o) == 64
    want = [r for r in reversed(rows) if r[3] or r[1] >= 2000 or r[2] in (2, 3)][:64]
    assert [r["seq"] for r in sorted(o, key=lambda r: r["slot"])] == [r[0] for r in want] and any(r["parse_error"] for r in o)


def test_a_fast_request_that_did_not_parse_is_an_outlier(spark):
    log = spark.createDataFrame([(1, 10, 0, True), (2, 10, 0, False)], "seq bigint, latency_us bigint, fraud int, parse_error boolean")
    log = log.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    assert [r["seq"] for r in telemetry.outliers(log).collect()] == [1]


def test_report_counts_on(spark, tmp_path):
    rows = [(i, 1_700_000_000 + 4 * i + (i // 50) * 90_000, 100 * (i % 130), i % 6, i % 10 == 9, i % 17 == 3) for i in range(120)]
    log = spark.createDataFrame(rows, "seq bigint, s bigint, latency_us bigint, fraud int, parse_error boolean, http_error boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(telemetry.report(log).collect(), key=lambda r: r["start"])
    for r in got:
        end = int(r["start"].timestamp()) + 10
        so_far = [x for x in rows if x[1] < end]
        assert r["n"] == sum(end - 10 <= x[1] < end for x in rows) and r["rps"] == r["n"] / 10
        assert r["total"] == len(so_far) and r["parse_errors"] == sum(x[4] for x in so_far) and r["http_errors"] == sum(x[5] for x in so_far)
        assert r["fraud"] + r["legit"] + r["parse_errors"] == r["total"] and r["mean_us"] == sum(x[2] for x in so_far) // len(so_far)
        assert r["le_250"] == sum(x[2] <= 250 for x in so_far) and r["overflow"] == sum(x[2] > 10_000 for x in so_far)
    assert len(got) == len({x[1] // 10 for x in rows})
    telemetry.write_lines(log, str(tmp_path / "on"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "on" / "stats")).collect()]
    assert len(lines) == len(got) and any("total=120 " in x and "hist_us: <=250:" in x for x in lines)
    telemetry.write_lines(log, str(tmp_path / "off"), enabled=False)
    assert spark.read.schema("value string").text(str(tmp_path / "off" / "stats")).count() == 0


def test_every_body_is_answered(spark, tmp_path):
    bodies = [(1, None), (2, "{" + " " * (1 << 17) + "}"), (3, "no"), (4, "{}")]
    spark.createDataFrame(bodies, "qid bigint, body string").write.option("ignoreNullFields", "false").json(str(tmp_path / "in"))
    index = ivf.build(refs_of(spark, [(9, 0, False)]), np.zeros((1, 14)), INTS)
    stream.start(stream.bodies(spark, str(tmp_path / "in")), index, Normalization(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["qid"]: (r["valid"], r["response"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    fallback = '{"approved":true,"fraud_score":0.0}'
    assert got == {1: (False, fallback), 2: (False, fallback), 3: (False, fallback), 4: (True, fallback)}


def test_scratch_tables_go(spark):
    with storage.scratch():
        kept = storage.stash(spark.range(3))
        assert kept.count() == 3
    assert kept.stash_path not in storage._written and not resources.exists(spark, kept.stash_path)


def test_scores(spark):
    f = lambda *x: spark.range(1).select(telemetry.detection(*map(F.lit, x))).first()[0]
    assert f(50, 50, 0, 0, 0) == pytest.approx(3000)
    assert f(10, 10, 10, 10, 0) == -3000
    p = lambda x: spark.range(1).select(telemetry.latency_points(F.lit(x))).first()[0]
    assert (p(0.5), p(100.0), p(2500.0)) == (3000, 1000, -3000)


def test_pruned_search_agrees_with_brute_force_and_looks_at_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", (60, 60))
    monkeypatch.setattr(knn, "NATIVE_CELL", 60)
    monkeypatch.setattr(knn, "LEAF", 8)
    rng = np.random.default_rng(21)
    base = np.repeat(rng.integers(-9000, 9000, (300, 14)), 3, axis=0)
    base[:, 2:] //= 3000
    x = np.vstack([base, np.zeros((200, 14), int)])  # copies of three, and one large group of copies
    refs = spark.createDataFrame([(i, *map(int, v), bool(i % 3)) for i, v in enumerate(x)], "ref_id bigint, " + ", ".join(f"{q} int" for q in INTS) + ", is_fraud boolean").repartition(3)
    q = refs.where("ref_id % 7 = 0").select(F.col("ref_id").alias("qid"), *INTS)
    for native in (False, True):
        got = {}
        for r in knn.exact_knn(q, refs, INTS, 5, native, same_ids=True).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["dist"], r["ref_id"], r["is_fraud"]))
        assert len(got) == -(-len(x) // 7)
        for i, found in got.items():
            want = sorted((int(((x[i] - x[j]) ** 2).sum()), j) for j in range(len(x)) if j != i)[:5]
            assert sorted(found) == [(n + 1, d, j, bool(j % 3)) for n, (d, j) in enumerate(want)]
    few = pa.table({"cell": [0] * len(x), "part": [0] * len(x), "ref_id": range(len(x)), "is_fraud": [False] * len(x), **{c: x[:, d].astype("int32") for d, c in enumerate(INTS)}})
    cell = knn.Cell(knn.packed(few, INTS, "int", 6).to_pylist()[0], 14, "int")
    assert len(cell.raw) == 301 and cell.copies.max() == 6
    seen, inner = [], cell.distances
    cell.distances = lambda q, at: seen.append(len(q) * len(at)) or inner(q, at)
    cell.search(x[::7].astype("<i4"), np.full(len(x[::7]), np.inf), 6)
    assert sum(seen) < 0.5 * len(x[::7]) * len(x)


def test_a_repeated_own_id_leaves_enough_neighbours(spark):
    refs = refs_of(spark, [(7, 0, True)] * 9 + [(i, i * 10, False) for i in range(1, 5)])
    for native in (False, True):
        found = knn.exact_knn(queries_of(spark, [(7, 0)]), refs, INTS, 3, native, same_ids=True)
        assert [r["ref_id"] for r in found.orderBy("rank").collect()] == [1, 2, 3]


def test_trained_centroids_weigh_equal_rows(spark):
    refs = refs_of(spark, [(i, v, False) for i, v in enumerate([0] * 30 + [10] * 10 + [9000] * 5)])
    found = ivf.trained_centroids(refs, INTS, 2, 20)
    assert sorted(found[:, 0].tolist()) in ([2.5, 9000.0], [0.0, 45100 / 15])
    assert len(ivf.trained_centroids(refs, INTS, 9, 3)) == 3
    assert ivf.trained_centroids(refs_of(spark, []), INTS, 4).shape == (0, 14)


def test_pruned_single_precision_search_keeps_rounded_ties(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", (40, 40))
    monkeypatch.setattr(knn, "LEAF", 4)
    rng = np.random.default_rng(31)
    x = (rng.integers(0, 3, (300, 14)) / np.float32(3)).astype(np.float32)  # thirds: sums round, and many are equal
    names = [f"v{d}" for d in range(14)]
    refs = spark.createDataFrame([(i, *map(float, v), bool(i % 3)) for i, v in enumerate(x)], "ref_id bigint, " + ", ".join(f"{c} float" for c in names) + ", is_fraud boolean")
    q = refs.where("ref_id % 9 = 0").select(F.col("ref_id").alias("qid"), *names)
    got = {}
    for r in knn.float_knn(q, refs, names, 5, same_ids=True).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["dist"], r["ref_id"]))
    for i in range(0, 300, 9):
        d = np.zeros(300, np.float32)
        for k in range(14):
            gap = x[:, k] - x[i, k]
            d += gap * gap
        want = sorted((float(d[j]), j) for j in range(300) if j != i)[:5]
        assert sorted(got[i]) == [(n + 1, e, j) for n, (e, j) in enumerate(want)]
    few = pa.table({"cell": [0] * 300, "part": [0] * 300, "ref_id": range(300), "is_fraud": [False] * 300, **{c: x[:, d] for d, c in enumerate(names)}})
    cell = knn.Cell(knn.packed(few, names, "float", 6).to_pylist()[0], 14, "float")
    seen, inner = [], cell.distances
    cell.distances = lambda q, at: seen.append(len(q) * len(at)) or inner(q, at)
    cell.search(x[:4], np.zeros(4), 6)
    assert sum(seen) < 4 * 300


def test_native_search_groups_references_into_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "NATIVE_CELL", 50)
    refs = refs_of(spark, [(i, i * 7 % 1000, False) for i in range(400)])
    splits = knn.fitted(refs, INTS, 50, "int", 400)
    rows = refs.withColumn("cell", splits.column(F.array(*INTS))).collect()
    assert [r["cell"] for r in rows] == splits.cells(np.array([[r[c] for c in INTS] for r in rows])).tolist()
    assert len({r["cell"] for r in rows}) == 8
    found = knn.exact_knn(queries_of(spark, [(1, 501)]), refs, INTS, 2, native=True)
    assert "Python" not in found._jdf.queryExecution().toString() and found.count() == 2


def test_features_make_each_text_once_and_stay_short_methods(spark, data):
    from txrisk.functions.features import vector
    from txrisk.sources import fixtures

    v = fixtures.requests(spark, data).select("event_id", *vector(F.col("request"), fixtures.NORM))
    held = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        plan = v._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", held)
    assert plan.count("date_format") == 2 and "lambda" in plan


def test_native_search_meets_boxes_once_and_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(knn, "NATIVE_CELL", 50)
    plans = []
    monkeypatch.setattr(knn, "stash", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or storage.stash(df))
    refs = refs_of(spark, [(i, i * 7 % 1000, False) for i in range(400)])
    found = knn.exact_knn(queries_of(spark, [(1, 501), (2, 900)]), refs, INTS, 2, native=True)
    at = {i: i * 7 % 1000 for i in range(400)}
    want = [(q, d, i) for q, x in ((1, 501), (2, 900)) for d, i in sorted(((at[i] - x) ** 2, i) for i in at)[:2]]
    assert sorted((r["qid"], r["dist"], r["ref_id"]) for r in found.collect()) == want
    met = [p for p in plans if "BroadcastNestedLoopJoin" in p]
    assert len(met) == 1 and "REPARTITION_BY_NUM" in met[0]


def test_references_are_dealt_to_cells_in_one_python_pass(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(knn, "stash", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or storage.stash(df))
    monkeypatch.setattr(knn, "CELL", (50, 50))
    monkeypatch.setattr(knn, "PART", 20)
    refs = refs_of(spark, [(i, i * 7 % 1000 // 100, bool(i % 3)) for i in range(400)])
    cells = knn._packed_cells(refs, INTS, "int", 400)
    assert ["MapInArrow" in p for p in seen] == [True, False]
    rows = cells.collect()
    assert sorted(np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows]).tolist()) == list(range(400))
    assert max(len(r["ids"]) // 8 for r in rows) <= 40 and len(rows) > 8
