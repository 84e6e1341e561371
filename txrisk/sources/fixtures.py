"""Transactions derived from the events table, for tests and benchmarks.

The label (error events) is a stand-in that exercises the engine; it says nothing about accuracy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.functions.features import quantized, vector
from txrisk.schema import DIMS, Normalization
from txrisk.storage import discard, stash

NORM = Normalization(max_amount=500.0, max_merchant_avg_amount=500.0)
MCC_OF_EVENT = {"click": "5411", "view": "5912", "signup": "5812", "purchase": "5944"}


_kept: dict[tuple, DataFrame] = {}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, request, label): one nested request for each event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
    )
    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = user.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("user_id").orderBy("micros").rangeBetween(-86_400_000_000, 0)
    visit = Window.partitionBy("user_id", "k").orderBy("ts", "event_id")
    e = e.withColumns(
        {
            "usual": F.sum("cents").over(before) / F.count("*").over(before) / 100.0,
            "recent": F.count("*").over(day) - 1,
            "last_ts": F.lag("ts").over(user),
            "last_k": F.lag("k").over(user),
            "visit": F.row_number().over(visit),
        }
    )
    # A shop's history goes by day first, so that no task holds a whole shop: there are few shops and many days.
    e = e.withColumn("day", F.to_date("ts"))
    days = e.groupBy("k", "day").agg(F.sum("cents").alias("c"), F.count("*").alias("n"))
    past = Window.partitionBy("k").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col("k").alias("k_"), F.col("day").alias("day_"), F.coalesce(F.sum("c").over(past), F.lit(0)).alias("c_"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n_"))
    e = e.join(days, F.col("k").eqNullSafe(F.col("k_")) & F.col("day").eqNullSafe(F.col("day_"))).drop("k_", "day_")
    today = Window.partitionBy("k", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    cents, n = F.col("c_") + F.coalesce(F.sum("cents").over(today), F.lit(0)), F.col("n_") + F.count("*").over(today)
    e = e.withColumn("shop_usual", F.when(n > 0, cents / n / 100.0))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = e.withColumns({"at": stamp("ts"), "last_at": stamp("last_ts")})
    shop_id = F.col("k").cast("string")
    codes = F.create_map(*[F.lit(x) for kv in MCC_OF_EVENT.items() for x in kv])
    request = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.struct(
            F.col("value").alias("amount"), (F.col("k") % 12 + 1).cast("bigint").alias("installments"), F.col("at").alias("requested_at")
        ).alias("transaction"),
        F.struct(
            F.coalesce("usual", F.lit(0.0)).alias("avg_amount"),
            F.col("recent").alias("tx_count_24h"),
            F.when(F.col("visit") > 1, F.array(shop_id)).otherwise(F.array().cast("array<string>")).alias("known_merchants"),
        ).alias("customer"),
        F.struct(
            shop_id.alias("id"),
            F.coalesce(F.try_element_at(codes, F.col("event_type")), F.lit("0000")).alias("mcc"),
            F.coalesce("shop_usual", F.lit(0.0)).alias("avg_amount"),
        ).alias("merchant"),
        F.struct(
            F.col("event_type").isin("click", "view").alias("is_online"),
            (F.col("event_id") % 2 == 0).alias("card_present"),
            (F.col("k") * 10).cast("double").alias("km_from_home"),
        ).alias("terminal"),
        F.when(
            F.col("last_ts").isNotNull(),
            F.struct(F.col("last_at").alias("timestamp"), (F.abs(F.col("k") - F.col("last_k")) * 10).cast("double").alias("km_from_current")),
        ).alias("last_transaction"),
    )
    label = F.when(F.col("event_type") == "error", "fraud").otherwise("legit")
    return e.select("event_id", "ts", request.alias("request"), label.alias("label"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, v0.., q0.., is_fraud), written once for a session and table: every query of the engine starts here."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        r = requests(spark, sf_dir)
        v = r.select("event_id", *vector(F.col("request"), NORM), (F.col("label") == "fraud").alias("is_fraud"))
        _kept[key] = stash(v.select("*", *[quantized(F.col(f"v{d}")).alias(f"q{d}") for d in range(DIMS)]))
    return _kept[key]


def forget() -> None:
    """Delete what ``labelled`` has written."""
    for held in _kept.values():
        discard(held)
    _kept.clear()


def queries_and_references(fx: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Every ``every``-th event is a query against all events; a search leaves out its own row (``same_ids``)."""
    ints = [f"q{d}" for d in range(DIMS)]
    return (
        fx.where(F.col("event_id") % every == 0).select(F.col("event_id").alias("qid"), *ints),
        fx.select(F.col("event_id").alias("ref_id"), *ints, "is_fraud"),
    )
