"""The queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import search
from .collisions import near_vectors
from .common import table
from .hilbert import shard_documents
from .mixing import mix_plan
from .packing import pack
from .pii import pii_digest
from .secret_scan import secret_digest
from .simhash import simhash_components
from .subword import quality_scores
from .url_filter import judge


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op5_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op6_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_collision_counting": op2_collision_counting,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_pii_disclosure": op5_pii_disclosure,
    "op6_simhash_anchors": op6_simhash_anchors,
    "op7_temperature_mixing": op7_temperature_mixing,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op9_multi_index": op9_multi_index,
    "op10_subword_quality": op10_subword_quality,
}

ORACLE_SQL: dict[str, str] = {
    # Every pair of one label, for tables small enough for that.
    "op2_collision_counting": """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x),
c AS (SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.y, vec_id)) AS component_id
  FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN n ON n.x = vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c""",
}
