"""Structured Streaming forms: first-seen dedup and windowed sentiment counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import dedup_key
from opinara.operators.reviews import label_counts, sentiment


def first_seen(stream: DataFrame, time_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """Drops a text that was seen within the watermark, per project."""
    keyed = stream.withColumn("norm_hash", F.sha2(dedup_key(F.col("text")), 256)).withWatermark(time_col, delay)
    return keyed.dropDuplicatesWithinWatermark(["project_id", "norm_hash"])


def windowed_trend(stream: DataFrame, lexicon: dict[str, float], time_col: str = "ts", width: str = "7 days", offset: str = "4 days", delay: str = "1 day") -> DataFrame:
    """Label counts per project and window; weeks begin on Monday (the epoch was a Thursday)."""
    scored = sentiment(stream, lexicon).withWatermark(time_col, delay)
    return scored.groupBy("project_id", F.window(time_col, width, width, offset).alias("w")).agg(F.count(F.lit(1)).alias("total"), *label_counts()).select("project_id", F.col("w.start").alias("period_start"), "total", "positive", "negative", "neutral")


def dated(batch: DataFrame, time_col: str = "ts") -> tuple[DataFrame, DataFrame]:
    """For ``foreachBatch``: the rows with a time, and per project how many have none."""
    none = batch.where(F.col(time_col).isNull()).groupBy("project_id").agg(F.count(F.lit(1)).alias("skipped"))
    return batch.where(F.col(time_col).isNotNull()), none
