"""The engine's queries over the derived transactions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions import features, parse
from txrisk.functions.features import quantized, vector
from txrisk.operators import ivf, knn, models, telemetry
from txrisk.operators.models import Ensemble, Logistic, Node
from txrisk.plans import scoring
from txrisk.plans.scoring import INTS
from txrisk.schema import DIMS, FEATURES, SearchConfig
from txrisk.sources import fixtures
from txrisk.storage import new_path, stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CONFIG = SearchConfig()
CENTROID_EVERY = 250

#: A small fixed ensemble over the single-precision features.
TREES = Ensemble(
    (
        (Node(0, 0.3, 1, 2), Node(-1, 0, value=-0.8), Node(12, 0.4, 3, 4), Node(-1, 0, value=0.1), Node(-1, 0, value=0.9)),
        (Node(7, 0.5, 1, 2), Node(11, 0.5, 3, 4), Node(-1, 0, value=0.6), Node(-1, 0, value=-0.4), Node(-1, 0, value=0.2)),
        (Node(5, 0.0, 1, 2), Node(-1, 0, value=0.3), Node(8, 0.25, 3, 4), Node(-1, 0, value=-0.2), Node(-1, 0, value=0.5)),
    ),
    0.05,
)
#: Fixed weights by a rule.
LOGISTIC = Logistic(tuple(((k * 37) % 21 - 10) / 50.0 for k in range(119)), -0.3)


def query(f):
    QUERIES[f.__name__] = f
    return f


def millionths(x: Column) -> Column:
    return F.round(x * 1_000_000).cast("bigint")


def _fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.labelled(spark, sf_dir)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixtures.queries_and_references(_fx(spark, sf_dir))


def _index(refs: DataFrame) -> ivf.Index:
    return ivf.build(refs, ivf.sampled_centroids(refs, INTS, CENTROID_EVERY), INTS)


@query
def fraud_score(spark, sf_dir):
    """Flagship: features, five nearest references, vote, decision."""
    q, r = _split(spark, sf_dir)
    return scoring.decided(scoring.exact_votes(q, r, same_ids=True))


@query
def features_quantized(spark, sf_dir):
    return _fx(spark, sf_dir).select("event_id", *INTS, "is_fraud")


def _one_feature(d: int, name: str):
    def feature(spark, sf_dir):
        return _fx(spark, sf_dir).select("event_id", F.col(f"q{d}").alias("q"))

    QUERIES[f"feat_{name}"] = feature


for _d, _name in enumerate(FEATURES):
    _one_feature(_d, _name)


@query
def round4_amount(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", features.round4(F.col("value") / 490.0).alias("r4"))


@query
def clamp_amount(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = features.clamp01(features.f32((F.col("value") - 100.0) / 200.0))
    return e.select("event_id", quantized(x).alias("q"))


@query
def mcc_lookup(spark, sf_dir):
    r = fixtures.requests(spark, sf_dir)
    code = F.when(F.col("event_id") % 7 == 0, "12a4").when(F.col("event_id") % 7 == 1, "").otherwise(F.col("request.merchant.mcc"))
    return r.select("event_id", millionths(features.mcc_risk(code)).alias("risk"))


@query
def parse_payload(spark, sf_dir):
    b = fixtures.requests(spark, sf_dir).select("event_id", F.to_json("request").alias("body"))
    r = b.select("event_id", parse.payload(F.col("body")).alias("r"))
    return r.select(
        "event_id",
        F.round(parse.number(F.col("r.transaction.amount")) * 100).cast("bigint").alias("cents"),
        F.col("r.transaction.installments").alias("installments"),
        F.col("r.customer.tx_count_24h").alias("recent"),
        F.col("r.merchant.id").alias("merchant"),
        parse.flag(F.col("r.terminal.is_online")).alias("is_online"),
        parse.flag(F.col("r.terminal.card_present")).alias("card_present"),
        F.col("r.last_transaction").isNull().alias("is_first"),
        features.unknown_merchant(F.col("r")).cast("int").alias("unknown"),
    )


@query
def parse_civil_time(spark, sf_dir):
    at = F.col("request.transaction.requested_at")
    # An offset does not move the civil time that is read.
    at = F.when(F.col("event_id") % 3 == 0, F.concat(F.substring(at, 1, 19), F.lit(".25+03:00"))).when(F.col("event_id") % 11 == 1, "2026-13-01").otherwise(at)
    r = fixtures.requests(spark, sf_dir)
    return r.select(
        "event_id", parse.hour(at).alias("hour"), parse.weekday(at).cast("int").alias("weekday"), parse.epoch_seconds(at).alias("epoch")
    )


def _odd_body(n: Column, body: Column) -> Column:
    return (
        F.when(n % 6 == 1, F.concat(F.lit(" "), body)).when(n % 6 == 2, F.lit("")).when(n % 6 == 3, F.lit("not json"))
        .when(n % 6 == 4, F.lit("[1,2]")).when(n % 6 == 5, F.lit('{"id": ')).otherwise(body)
    )


@query
def invalid_gate(spark, sf_dir):
    b = fixtures.requests(spark, sf_dir).select("event_id", _odd_body(F.col("event_id"), F.to_json("request")).alias("body"))
    valid = parse.payload(F.col("body")).isNotNull()
    fail_open = F.when(valid, F.lit(None)).otherwise(scoring.response(F.lit(0)))
    return b.select(
        "event_id", parse.strict_body(F.col("body")).alias("strict"), parse.loose_body(F.col("body")).alias("loose"), valid.alias("valid"), fail_open.alias("fallback")
    )


@query
def missing_object_defaults(spark, sf_dir):
    parts = ("transaction", "customer", "merchant", "terminal", "last_transaction")
    n = F.col("event_id") % 6
    fields = [F.when(n != k, F.col(f"request.{p}")).alias(p) for k, p in enumerate(parts)]
    body = F.to_json(F.struct(*fields))
    r = fixtures.requests(spark, sf_dir).select("event_id", parse.payload(body).alias("r"))
    v = r.select("event_id", *vector(F.col("r"), fixtures.NORM))
    return v.select("event_id", *[quantized(F.col(f"v{d}")).alias(f"q{d}") for d in range(DIMS)])


@query
def knn_top5(spark, sf_dir):
    q, r = _split(spark, sf_dir)
    return knn.exact_knn(q, r, INTS, same_ids=True).select("qid", "rank", "ref_id", "dist", "is_fraud")


@query
def knn_top5_native(spark, sf_dir):
    q, r = _split(spark, sf_dir)
    return knn.exact_knn(q, r, INTS, native=True, same_ids=True).select("qid", "rank", "ref_id", "dist", "is_fraud")


@query
def knn_vote_ratio(spark, sf_dir):
    q, r = _split(spark, sf_dir)
    return knn.vote_ratio(knn.exact_knn(q, r, INTS, 3, same_ids=True)).select("qid", "n", "fraud", millionths(F.col("ratio")).alias("ratio"))


@query
def knn_embeddings(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = [f"e{d}" for d in range(n)]
    whole = F.size("embedding") == n
    e = e.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    e = e.select("vec_id", F.coalesce(F.col("label") == 1, F.lit(False)).alias("is_fraud"), *[F.coalesce(quantized(F.get("embedding", F.lit(d))), F.lit(0)).alias(x) for d, x in enumerate(dims)])
    q, r = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "ref_id")
    return knn.exact_knn(q, r, dims, same_ids=True).select("qid", "rank", "ref_id", "dist", "is_fraud")


@query
def knn_float(spark, sf_dir):
    """Single-precision search over the unrounded features."""
    fx, names = _fx(spark, sf_dir), [f"v{d}" for d in range(DIMS)]
    q = fx.where("event_id % 20 = 0").select(F.col("event_id").alias("qid"), *names)
    r = fx.select(F.col("event_id").alias("ref_id"), *names, "is_fraud")
    return knn.float_knn(q, r, names, same_ids=True).select("qid", "rank", "ref_id", F.col("dist").cast("double").alias("dist"), "is_fraud")


@query
def ref_counts(spark, sf_dir):
    return knn.reference_counts(_split(spark, sf_dir)[1])


@query
def kmeans_assign(spark, sf_dir):
    r = _split(spark, sf_dir)[1]
    return ivf.assign(r, ivf.sampled_centroids(r, INTS, CENTROID_EVERY), INTS).select("ref_id", "ci", "cdist")


@query
def kmeans_update(spark, sf_dir):
    r = _split(spark, sf_dir)[1]
    c = ivf.sampled_centroids(r, INTS, CENTROID_EVERY)
    return ivf.updated(ivf.assign(r, c, INTS), c, INTS)


@query
def kmeans_lloyd(spark, sf_dir):
    """Rows per cluster after two rounds."""
    r = _split(spark, sf_dir)[1]
    c = ivf.lloyd(r, ivf.sampled_centroids(r, INTS, CENTROID_EVERY), INTS, 2)
    return ivf.assign(r, c, INTS).groupBy("ci").agg(F.count("*").alias("n"))


@query
def inverted_lists(spark, sf_dir):
    r = _split(spark, sf_dir)[1]
    m = _index(r).members
    return m.join(ivf.list_offsets(m), "ci").select("ref_id", "ci", "pos", "first", "n")


@query
def cluster_bbox(spark, sf_dir):
    return _index(_split(spark, sf_dir)[1]).boxes


@query
def centroid_distance(spark, sf_dir):
    q, r = _split(spark, sf_dir)
    x = _index(r)
    return ivf.probes(q, x, x.nlist).select("qid", "ci", F.col("cdist").alias("dist"))


@query
def probe_select(spark, sf_dir):
    q, r = _split(spark, sf_dir)
    return ivf.probes(q, _index(r), CONFIG.nprobe).select("qid", "probe", "ci")


@query
def bbox_prune(spark, sf_dir):
    q, r = _split(spark, sf_dir)
    x = _index(r)
    p = stash(ivf.probes(q, x, CONFIG.clamped(x.nlist).nprobe))
    worst = ivf.top(ivf.scan(p.where(F.col("probe") <= CONFIG.quick), x, same_ids=True)).groupBy("qid").agg(F.max("dist").alias("worst"))
    return ivf.box_bound(p, x).join(worst, "qid").select("qid", "ci", "bound", (F.col("bound") < F.col("worst")).alias("may_improve"))


@query
def ivf_quick(spark, sf_dir):
    q, r = _split(spark, sf_dir)
    x = _index(r)
    t = ivf.top(ivf.scan(ivf.probes(q, x, CONFIG.quick), x, same_ids=True))
    return t.groupBy("qid").agg(F.count_if("is_fraud").alias("fraud"), F.sum("dist").alias("dist"))


@query
def ivf_two_tier(spark, sf_dir):
    q, r = _split(spark, sf_dir)
    return ivf.two_tier(q, _index(r), CONFIG, same_ids=True)


@query
def ivf_vs_exact(spark, sf_dir):
    q, r = _split(spark, sf_dir)
    a = ivf.two_tier(q, _index(r), CONFIG, same_ids=True).withColumnRenamed("fraud", "approx")
    b = scoring.exact_votes(q, r, same_ids=True)
    return a.join(b, "qid").agg(
        F.count("*").alias("n"), F.count_if((F.col("approx") < 3) != (F.col("fraud") < 3)).alias("decisions_apart"),
        F.count_if(F.col("approx") != F.col("fraud")).alias("votes_apart"),
    )


@query
def gbdt_predict(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return fx.select("event_id", millionths(models.ensemble_score(TREES, [F.col(f"v{d}") for d in range(DIMS)]).cast("double")).alias("score"))


def _logistic() -> Column:
    return models.logistic_score(LOGISTIC, [F.col(f"q{d}") / 10000.0 for d in range(DIMS)])


@query
def logreg_predict(spark, sf_dir):
    return _fx(spark, sf_dir).select("event_id", millionths(_logistic()).alias("score"))


@query
def confusion_matrix(spark, sf_dir):
    return models.confusion(_fx(spark, sf_dir), _logistic(), F.col("is_fraud"))


@query
def logreg_train(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    x = fx.select(*[(F.col(c) / 10000.0).alias(c) for c in INTS], "is_fraud")
    m = models.train_logistic(x, INTS, "is_fraud")
    return models.confusion(x, models.logistic_score(m, [F.col(c) for c in INTS]), F.col("is_fraud"))


@query
def kmeans_train(spark, sf_dir):
    r = _split(spark, sf_dir)[1]
    x = ivf.build(r, ivf.trained_centroids(r, INTS, ivf.MAX_CLUSTERS), INTS)
    return ivf.list_offsets(x.members)


@query
def decision_response(spark, sf_dir):
    q, r = _split(spark, sf_dir)
    v = scoring.exact_votes(q, r, same_ids=True)
    return v.select("qid", scoring.response(F.col("fraud")).alias("response"))


def _log(spark, sf_dir) -> DataFrame:
    """Events as a request log: value as a stand-in for latency."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.round(F.col("value") * 100).cast("bigint") * 10 % 12_000).alias("latency_us"),
        (F.col("event_id") % 6).alias("fraud"), (F.col("event_id") % 50 == 0).alias("parse_error"),
    )


@query
def telemetry_summary(spark, sf_dir):
    return telemetry.summary(_log(spark, sf_dir))


@query
def latency_histogram(spark, sf_dir):
    return telemetry.histogram(_log(spark, sf_dir))


@query
def outlier_ring(spark, sf_dir):
    o = telemetry.outliers(_log(spark, sf_dir), "1 day")
    return o.select(F.unix_seconds("start").alias("start"), "slot", "seq", "latency_us")


@query
def rps_tumbling(spark, sf_dir):
    return telemetry.report(_log(spark, sf_dir)).withColumn("start", F.unix_seconds("start"))


@query
def detection_score(spark, sf_dir):
    c = models.confusion(_fx(spark, sf_dir), _logistic(), F.col("is_fraud"))
    quality, points = telemetry.detection, telemetry.latency_points
    log = _log(spark, sf_dir).agg(F.expr("percentile(latency_us, 0.99)").alias("p99"), F.count_if("parse_error").alias("errors"))
    # The proxy labels are no test of accuracy; a hundredth of the misses keeps both branches of the score in use.
    both = c.crossJoin(log)  # one row each
    fp, fn = F.floor(F.col("fp") / 100), F.floor(F.col("fn") / 100)
    low = quality(F.col("tp"), F.col("tn"), fp, fn, F.col("errors"))
    late = points(F.col("p99") / 1000.0)
    return both.select(
        "tp", "tn", fp.alias("fp"), fn.alias("fn"), "errors", millionths(late).alias("latency_points"), millionths(low).alias("detection_points"),
        millionths(quality(*[F.col(x) for x in ("tp", "tn", "fp", "fn", "errors")])).alias("raw_points"), millionths(late + low).alias("final_points"),
    )


@query
def stream_score(spark, sf_dir):
    """Bodies as a stream of files, scored in micro-batches against the static index."""
    from txrisk.streaming import scoring as stream

    root = new_path(spark)
    r = fixtures.requests(spark, sf_dir)
    r.select(F.col("event_id").alias("qid"), _odd_body((F.col("event_id") / 100).cast("bigint"), F.to_json("request")).alias("body")).repartition(3).write.json(f"{root}/in")
    index = _index(_split(spark, sf_dir)[1])
    stream.start(stream.bodies(spark, f"{root}/in", 1), index, fixtures.NORM, f"{root}/out", f"{root}/state", CONFIG, same_ids=True).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("qid", "valid", "response")
