"""From bodies or requests to decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions import parse
from txrisk.functions.features import quantized, vector
from txrisk.operators import ivf
from txrisk.operators.knn import exact_knn, vote
from txrisk.schema import DIMS, K, Normalization, SearchConfig
from txrisk.storage import stash

INTS = [f"q{d}" for d in range(DIMS)]


def decision(fraud: Column) -> Column:
    """``struct(approved, fraud_score)`` of a vote count; counts out of range are 0."""
    fraud = F.when(fraud.between(0, K), fraud).otherwise(0)
    return F.struct((fraud < 3).alias("approved"), (fraud / float(K)).alias("fraud_score"))


def response(fraud: Column) -> Column:
    return F.to_json(decision(fraud))


def decided(votes: DataFrame) -> DataFrame:
    return votes.select("qid", "fraud", decision(F.col("fraud")).alias("d")).select("qid", "fraud", "d.approved", "d.fraud_score")


def exact_votes(queries: DataFrame, refs: DataFrame, same_ids: bool = False) -> DataFrame:
    """(qid, fraud): five-neighbour votes on the whole scale; fewer neighbours are scaled up."""
    v = vote(exact_knn(queries, refs, INTS, K, same_ids=same_ids))
    return v.select("qid", F.round(F.col("fraud") * K / F.col("n")).cast("bigint").alias("fraud"))


#: Longest body that is parsed; longer ones are answered like any that cannot be read.
MAX_BODY = 1 << 16


def vectorized(bodies: DataFrame, norm: Normalization) -> DataFrame:
    """(qid, valid, q0..) of (qid, body)."""
    body = F.when(F.length("body") <= MAX_BODY, F.col("body"))
    p = bodies.select("qid", parse.payload(body).alias("r"))
    v = p.select("qid", F.col("r").isNotNull().alias("valid"), *vector(F.col("r"), norm))
    return v.select("qid", "valid", *[quantized(F.col(f"v{d}")).alias(f"q{d}") for d in range(DIMS)])


def score_bodies(
    bodies: DataFrame, index: ivf.Index, norm: Normalization, config: SearchConfig = SearchConfig(), same_ids: bool = False
) -> DataFrame:
    """(qid, response): every body is answered; what cannot be read, is null or too long is approved."""
    x = stash(vectorized(bodies, norm))
    votes = ivf.two_tier(x.where("valid").select("qid", *INTS), index, config, same_ids)
    return x.select("qid", "valid").join(votes, "qid", "left").select("qid", "valid", response(F.coalesce("fraud", F.lit(0))).alias("response"))
