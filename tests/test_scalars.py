"""Golden values of parsing, features, quantisation and models."""

import math

import pytest
from pyspark.sql import functions as F

from txrisk.functions import features, parse
from txrisk.operators import models
from txrisk.operators.models import Ensemble, Node
from txrisk.plans import scoring
from txrisk.schema import Normalization, SearchConfig


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize(
    "text, epoch, hour, weekday",
    [
        ("2026-03-11T20:23:35Z", 1773260615, 20, 2),
        ("2026-03-11T20:23:35+03:00", 1773260615, 20, 2),
        ("2026-03-11T20:23:35.999Z", 1773260615, 20, 2),
        ("2026-01-01T00:00:00Z", 1767225600, 0, 3),
        ("1970-01-01T00:00:00Z", 0, 0, 3),
        ("2026-12-31T23:59:59Z", 1798761599, 23, 3),
        ("2026-07-04T12:00:00Z", 1783166400, 12, 5),
        ("2026-13-04T12:00:00Z", 0, 12, 0),
        ("2026-03-11 20:23:35", 0, 0, 0),
        ("invalid", 0, 0, 0),
        ("", 0, 0, 0),
        (None, 0, 0, 0),
    ],
)
def test_civil_time(spark, text, epoch, hour, weekday):
    t = F.lit(text).cast("string")
    assert one(spark, parse.epoch_seconds(t), parse.hour(t), parse.weekday(t)) == (epoch, hour, weekday)


def test_strict_instants(spark):
    got = one(spark, *[parse.instant(F.lit(t)).cast("long") for t in ("2026-03-11T20:23:35Z", "2026-03-11T23:23:35+03:00", "2026-03-11")])
    assert got == (1773260615, 1773260615, None)


@pytest.mark.parametrize("x, want", [(-1e10, 0), (-0.5, 0), (0.0, 0), (0.5, 0.5), (1.0, 1), (1.5, 1), (1e10, 1)])
def test_clamp(spark, x, want):
    assert one(spark, features.clamp01(features.f32(F.lit(x)))) == (want,)


def test_clamp_keeps_nan(spark):
    assert math.isnan(one(spark, features.clamp01(features.f32(F.lit(float("nan")))))[0])


@pytest.mark.parametrize("x, want", [(0, 0), (1, 10000), (0.5, 5000), (-0.5, -5000), (-1, -10000), (1.5, 10000), (-1.5, -10000)])
def test_quantized(spark, x, want):
    assert one(spark, features.quantized(features.f32(F.lit(float(x))))) == (want,)


@pytest.mark.parametrize("x, want", [(0.12345, 0.1235), (0.12344, 0.1234), (0.99999, 1.0)])
def test_round4(spark, x, want):
    assert one(spark, features.round4(F.lit(x))) == (want,)


@pytest.mark.parametrize("code, want", [("5411", 0.15), ("7995", 0.85), ("1234", 0.5), ("", 0.5), ("abcd", 0.5), ("5:11", 0.5), (None, 0.5)])
def test_mcc(spark, code, want):
    assert one(spark, features.mcc_risk(F.lit(code).cast("string"))) == (want,)


BODY = (
    '{"id":"t","transaction":{"amount":1e2,"installments":3,"requested_at":"2026-03-11T20:23:35Z"},'
    '"customer":{"avg_amount":0,"tx_count_24h":3,"known_merchants":["M-1","M-1"]},'
    '"merchant":{"id":"M-2","mcc":"5411","avg_amount":60.25},'
    '"terminal":{"is_online":false,"card_present":true,"km_from_home":29.23},"last_transaction":null}'
)


def test_vector(spark):
    r = parse.payload(F.lit(BODY))
    v = one(spark, *features.vector(r, Normalization()))
    want = [0.01, 0.25, 0, 20 / 23, 2 / 6, -1, -1, 0.02923, 0.15, 0, 1, 1, 0.15, 0.006025]
    assert v == pytest.approx(want, abs=1e-6)


def test_absent_objects(spark):
    n = Normalization()
    v = lambda body: one(spark, *features.vector(parse.payload(F.lit(body)), n))
    assert v("{}") == (0.0,) * 14
    tx = '"transaction":{"amount":100,"installments":1,"requested_at":"2026-03-11T20:23:35Z"}'
    alone = v("{" + tx + "}")
    assert alone[5:7] == (-1, -1) and alone[11:] == (0, 0, 0)
    assert v("{" + tx + ',"last_transaction":{}}')[5:7] == (1, 0)
    assert v("{" + tx + ',"merchant":{"id":"a","mcc":"5411"}}')[11:] == (0, 0, 0)
    assert v("{" + tx + ',"customer":{},"merchant":{"id":"","mcc":"5411"}}')[11:] == (0, pytest.approx(0.15), 0)


@pytest.mark.parametrize(
    "body, strict, loose, valid",
    [("", False, False, False), (" {}", False, True, False), ("not json", False, False, False), ("[1]", False, False, False), ('{"a":', True, True, False), ("{}", True, True, True), (None, False, False, False)],
)
def test_gates(spark, body, strict, loose, valid):
    b = F.lit(body).cast("string")
    assert one(spark, parse.strict_body(b), parse.loose_body(b), parse.payload(b).isNotNull()) == (strict, loose, valid)


def test_decision(spark):
    assert [one(spark, scoring.response(F.lit(n)))[0] for n in (0, 2, 3, 5, 9, -1)] == [
        '{"approved":true,"fraud_score":0.0}', '{"approved":true,"fraud_score":0.4}', '{"approved":false,"fraud_score":0.6}',
        '{"approved":false,"fraud_score":1.0}', '{"approved":true,"fraud_score":0.0}', '{"approved":true,"fraud_score":0.0}',
    ]


def test_trees(spark):
    leaf = lambda v: (Node(-1, 0, value=v),)
    s = lambda x: 1 / (1 + math.exp(-x))
    score = lambda m, *x: one(spark, models.ensemble_score(m, [features.f32(F.lit(v)) for v in x]))[0]
    assert score(Ensemble((leaf(2.0),))) == pytest.approx(s(2))
    assert score(Ensemble((leaf(0.75),), sigmoid=False)) == 0.75
    assert score(Ensemble((leaf(0.0),), 1.5, False)) == 1 and score(Ensemble((leaf(0.0),), -0.5, False)) == 0
    assert score(Ensemble((leaf(25.0),))) == 1 and score(Ensemble((leaf(-25.0),))) == 0
    stump = Ensemble(((Node(0, 0.5, 1, 2), Node(-1, 0, value=0.1), Node(-1, 0, value=0.9)),))
    assert score(stump, 0.5) == pytest.approx(s(0.1)) and score(stump, 0.6) == pytest.approx(s(0.9))


def test_quadratic_has_119_terms():
    assert len(models.quadratic([F.lit(0.0)] * 14)) == 119


def test_search_config():
    assert SearchConfig(0, 0).clamped(1000) == SearchConfig(64, 32)
    assert SearchConfig(500, 300).clamped(1000) == SearchConfig(128, 128)
    assert SearchConfig(36, 16).clamped(10) == SearchConfig(10, 10)


def test_bad_constants():
    with pytest.raises(ValueError):
        Normalization(max_km=0)
