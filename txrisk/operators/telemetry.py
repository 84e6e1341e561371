"""Telemetry aggregates, the outlier ring, and the detection score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Inclusive upper bounds of the latency buckets, in microseconds; beyond is overflow.
BUCKETS = (250, 500, 750, 1000, 1500, 2000, 3000, 5000, 10000)
SLOW_US = 2000
RING = 64


def summary(log: DataFrame) -> DataFrame:
    """Counts over (latency_us, fraud, parse_error); rows with a parse error are neither legit nor fraud."""
    good = ~F.col("parse_error")
    mean = F.floor(F.sum("latency_us") / F.greatest(F.count("*"), F.lit(1)))
    return log.agg(
        F.count("*").alias("total"), F.coalesce(mean, F.lit(0)).cast("bigint").alias("mean_us"),
        F.count_if(F.col("parse_error")).alias("parse_errors"),
        F.count_if(good & (F.col("fraud") >= 3)).alias("denied"), F.count_if(good & (F.col("fraud") < 3)).alias("approved"),
        F.count_if(good & F.col("fraud").isin(2, 3)).alias("border"),
    )


def bucket(latency: Column) -> Column:
    """Upper bound of the latency's bucket; -1 for overflow."""
    out = None
    for b in BUCKETS:
        out = F.when(latency <= b, b) if out is None else out.when(latency <= b, b)
    return out.otherwise(-1)


def histogram(log: DataFrame) -> DataFrame:
    return log.groupBy(bucket(F.col("latency_us")).alias("bucket_us")).agg(F.count("*").alias("n"))


def collected(log: DataFrame, enabled: bool = True) -> DataFrame:
    """The log, or nothing of it where collection is switched off."""
    return log if enabled else log.where(F.lit(False))


def outliers(log: DataFrame, window: str = "10 seconds") -> DataFrame:
    """The last 64 requests of each window that are slow, borderline, or did not parse, which always count."""
    odd = log.where(F.col("parse_error") | (F.col("latency_us") >= SLOW_US) | F.col("fraud").isin(2, 3))
    odd = odd.withColumn("start", F.window("ts", window)["start"])
    last = Window.partitionBy("start").orderBy(F.desc("seq"))
    return odd.withColumn("slot", F.row_number().over(last)).where(F.col("slot") <= RING)


def rate(log: DataFrame, window: str = "10 seconds") -> DataFrame:
    """(start, n): requests per tumbling window; also on a stream, with a watermark set by the caller."""
    return log.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


COUNTERS = ("total", "fraud", "legit", "border_zone", "parse_errors", "http_errors", "latency_us")


def report(log: DataFrame, seconds: int = 10) -> DataFrame:
    """What a reporter says at the end of each interval that has requests: its rate, and all counters so far.

    (start, n, rps, total, fraud, legit, border_zone, parse_errors, http_errors, mean_us, and le_* and
    overflow: the histogram so far.)  Rows may have ``http_error``; without it there are none.  The running
    sums go within a day first and then over days, so no task holds all intervals.
    """
    good, yes = ~F.col("parse_error"), lambda c: F.count_if(c)
    http = F.col("http_error") if "http_error" in log.columns else F.lit(False)
    each = [
        yes(F.lit(True)).alias("total"), yes(good & (F.col("fraud") >= 3)).alias("fraud"), yes(good & (F.col("fraud") < 3)).alias("legit"),
        yes(good & F.col("fraud").isin(2, 3)).alias("border_zone"), yes(F.col("parse_error")).alias("parse_errors"), yes(http).alias("http_errors"),
        F.sum("latency_us").alias("latency_us"),
    ]
    names = [f"le_{b}" for b in BUCKETS] + ["overflow"]
    each += [yes(bucket(F.col("latency_us")) == b).alias(c) for b, c in zip((*BUCKETS, -1), names)]
    start = F.window("ts", f"{seconds} seconds")["start"]
    n = log.withColumn("start", start).groupBy("start").agg(*each).withColumn("day", F.to_date("start"))
    sums = [*COUNTERS, *names]
    past = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    before = n.groupBy("day").agg(*[F.sum(c).alias(c) for c in sums])
    before = before.select("day", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"_{c}") for c in sums])
    today = Window.partitionBy("day").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = n.join(before, "day").select(
        "start", F.col("total").alias("n"), (F.col("total") / float(seconds)).alias("rps"), *[(F.sum(c).over(today) + F.col(f"_{c}")).alias(c) for c in sums]
    )
    mean = F.floor(F.col("latency_us") / F.col("total"))
    return out.withColumn("mean_us", mean.cast("bigint")).drop("latency_us").select("start", "n", "rps", *COUNTERS[:-1], "mean_us", *names)


def stats_line(report: DataFrame) -> Column:
    """A report's row as one line of text."""
    hist = F.concat_ws(" ", *[F.format_string(f"{c.replace('le_', '<=')}:%d", F.col(c)) for c in report.columns if c.startswith("le_") or c == "overflow"])
    counters = " ".join(f"{c}=%d" for c in (*COUNTERS[:-1], "mean_us"))
    return F.format_string(f"STATS rps=%.1f {counters} | hist_us: %s", "rps", *COUNTERS[:-1], "mean_us", hist)


def outlier_line(ring: DataFrame) -> Column:
    """An outlier's row as one line of text."""
    return F.format_string("OUTLIER seq=%d lat_us=%d fraud_count=%d parse_error=%s", "seq", "latency_us", "fraud", F.col("parse_error").cast("string"))


def write_lines(log: DataFrame, path: str, seconds: int = 10, enabled: bool = True) -> None:
    """Reports and outliers of a log as text files, in the folders stats and outliers."""
    log = collected(log, enabled)
    stats, ring = report(log, seconds), outliers(log, f"{seconds} seconds")
    stats.orderBy("start").select(stats_line(stats).alias("value")).write.text(f"{path}/stats")
    ring.orderBy("start", F.desc("slot")).select(outlier_line(ring).alias("value")).write.text(f"{path}/outliers")


def detection(tp: Column, tn: Column, fp: Column, fn: Column, errors: Column) -> Column:
    """Points for the decisions: weighted errors against the total, with a floor when too many fail."""
    weighted = (fp + 3 * fn + 5 * errors).cast("double")
    n = (tp + tn + fp + fn + errors).cast("double")
    failing = (fp + fn + errors) / F.when(n > 0, n)
    points = 1000 * F.log10(1 / F.greatest(weighted / F.when(n > 0, n), F.lit(0.001))) - 300 * F.log10(1 + weighted)
    return F.when(failing > 0.15, -3000.0).otherwise(points)


def latency_points(p99_ms: Column) -> Column:
    return F.when(p99_ms > 2000, -3000.0).otherwise(1000 * F.log10(1000 / F.greatest(p99_ms, F.lit(1.0))))
