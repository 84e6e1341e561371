"""Streams of request bodies, scored against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from txrisk.operators import ivf, telemetry
from txrisk.plans.scoring import score_bodies
from txrisk.schema import Normalization, SearchConfig
from txrisk.storage import scratch

def bodies(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """(qid, body) from a folder of JSON-lines files with a number and a body each."""
    return spark.readStream.schema("qid bigint, body string").option("maxFilesPerTrigger", files_per_trigger).json(path)


def start(
    stream: DataFrame, index: ivf.Index, norm: Normalization, out: str, checkpoint: str, config: SearchConfig = SearchConfig(), same_ids: bool = False
) -> StreamingQuery:
    """Scores each micro-batch by the batch plan; a batch that is run again overwrites its own folder.

    Every body gets an answer, null and overlong ones too.
    """

    def batch(df: DataFrame, number: int) -> None:
        with scratch():
            score_bodies(df, index, norm, config, same_ids).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(log: DataFrame, late: str = "1 minute") -> DataFrame:
    """Requests per ten seconds of event time; later rows than ``late`` are left out."""
    return telemetry.rate(log.withWatermark("ts", late))
