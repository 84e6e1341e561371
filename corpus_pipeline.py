"""The corpus pipeline: classify, de-duplicate, redact, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.

Null and empty texts are scored by the classifier's bias alone; those that stay are one group of
copies, of which one row stays.  Very long texts are read whole by every stage.  Rows that repeat are
copies, and of a tie the row with the smallest id, then place in the files, stays.  Null ids and extra
columns, also such as share a name with one of a stage's own, pass through.  An empty table stays
empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.common import discard, stash, table
from txrisk.llm.mixing import Mix, mix_documents
from txrisk.llm.packing import pack
from txrisk.llm.secret_scan import redact_secrets
from txrisk.llm.simhash import drop_near_duplicates
from txrisk.llm.subword import fit, scored

#: Documents that score below are rejected.
QUALITY = 0.3
#: Every document stays; smaller sources are read more often, twice at most.
MIX = Mix(entropy=0.98, repeats=2.0, keep_all=True)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = docs.select(F.struct("*").alias("r"), F.col("doc_id"), F.col("text"))
    model = fit(packed, table(spark, sf_dir, "labels"))
    return scored(packed.select("r", "text"), model).where(F.col("score") >= QUALITY).select("r.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs, MIX)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and tokenizers have no SQL twin; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stash(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
