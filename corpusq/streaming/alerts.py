"""Alerts on the query log, as streams and in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.plans.quantiles import quantiles

WARN_MS, CRITICAL_MS = 4000, 5000


def ttft_alert(log: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """bucket, p95, level for buckets over the warning level (STR1). log: a stream or a table."""
    timed = log.where("ttft_ms is not null").withColumn("bucket", F.window("created_at", width).start)
    if log.isStreaming:
        # State of a window: how often it has each number of milliseconds.
        w = log.withWatermark("created_at", late).where("ttft_ms is not null").groupBy(F.window("created_at", width).alias("w")).agg(F.percentile("ttft_ms", 0.95).alias("p95")).select(F.col("w.start").alias("bucket"), "p95")
    else:
        w = quantiles(timed.where("bucket is not null"), ["bucket"], F.col("ttft_ms"), {"p95": 0.95})
    level = F.when(F.col("p95") > CRITICAL_MS, "critical").otherwise("warn")
    return w.where(F.col("p95") > WARN_MS).select("bucket", F.round("p95", 6).alias("p95"), level.alias("level"))


def strip_rate_spike(log: DataFrame, width: str = "6 hours", least: int = 20, share: float = 0.2, late: str = "1 day") -> DataFrame:
    """bucket, n, strip_rate for buckets with enough answers and too many stripped citations (STR3)."""
    log = log.withWatermark("created_at", late) if log.isStreaming else log
    w = log.groupBy(F.window("created_at", width).alias("w")).agg(F.count("*").alias("n"), F.avg("citations_stripped").alias("r"))
    return w.where((F.col("n") >= least) & (F.col("r") > share)).select(F.col("w.start").alias("bucket"), "n", F.round("r", 9).alias("strip_rate"))


def strip_rate_zero(log: DataFrame, least: int = 50, late: str = "1 day") -> DataFrame:
    """bucket, n: sliding days in which nothing was stripped though there were answers enough (STR4)."""
    log = log.withWatermark("created_at", late) if log.isStreaming else log
    w = log.groupBy(F.window("created_at", "24 hours", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.avg("citations_stripped").alias("r"))
    return w.where((F.col("n") >= least) & (F.col("r") == 0)).select(F.col("w.start").alias("bucket"), "n")


def silent_windows(log: DataFrame, minutes: int = 15) -> DataFrame:
    """bucket: windows between the first and the last query in which none came (STR2)."""
    width = f"interval {minutes} minutes"
    seen = log.select(F.window("created_at", f"{minutes} minutes").start.alias("bucket")).distinct()
    span = seen.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null")  # one row
    return span.select(F.explode(F.expr(f"sequence(a, b, {width})")).alias("bucket")).join(seen, "bucket", "left_anti")


def held(windows: DataFrame, width: str, times: int) -> DataFrame:
    """Windows of an alert that follow `times` - 1 others without a gap (STR5). windows: bucket (timestamp), ..."""
    before = F.lag("bucket", times - 1).over(Window.orderBy("bucket")) if times > 1 else F.col("bucket")
    return windows.withColumn("first", before).where(F.col("first") == F.expr(f"bucket - {times - 1} * interval {width}")).drop("first")
