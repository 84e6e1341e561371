"""Every engine query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from txrisk.oracle import ORACLE
from txrisk.queries import QUERIES


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in ("events", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - {n for n in ORACLE if n.startswith("feat_")}))
def test_same_rows(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(map(tuple, df.collect()), df.columns) == rows(cur.fetchall(), names)


def test_every_query_but_the_trained_has_a_twin():
    assert set(QUERIES) - set(ORACLE) == {"logreg_train", "kmeans_train", "stream_score"}


def test_trained_clusters_hold_every_reference(spark, data):
    n = QUERIES["ref_counts"](spark, data).first()["n_refs"]
    assert sum(r["n"] for r in QUERIES["kmeans_train"](spark, data).collect()) == n


def test_trained_logistic_beats_guessing(spark, data):
    c = QUERIES["logreg_train"](spark, data).first()
    assert c["tp"] / (c["tp"] + c["fn"]) > c["fp"] / max(1, c["fp"] + c["tn"])


def test_stream_equals_batch(spark, data):
    got = QUERIES["stream_score"](spark, data).collect()
    assert len(got) == len({r["qid"] for r in got}) == spark.read.parquet(f"{data}/events.parquet").count()
    assert all(r["response"].startswith('{"approved":') for r in got)
    assert all(r["response"] == '{"approved":true,"fraud_score":0.0}' for r in got if not r["valid"])
    fraud = {r["qid"]: r["fraud"] for r in QUERIES["ivf_two_tier"](spark, data).collect()}
    assert any(r["valid"] and r["qid"] in fraud for r in got)
    for r in got:
        if r["valid"] and r["qid"] in fraud:
            f = fraud[r["qid"]]
            assert r["response"] == '{"approved":%s,"fraud_score":%s}' % (str(f < 3).lower(), f / 5)
