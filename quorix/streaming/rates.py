"""Incremental click statistics over a stream, with the same results as the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorix.functions.exprs import smoothed_rate


def windowed_rates(events: DataFrame, time: str, key: str, clicks: Column, impressions: Column, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, clicks, impressions, rate) per tumbling window; events later than `late` are dropped.

    Works on a stream (append or update mode) and on a batch table alike.
    """
    # a watermark needs an instant; wall-clock times are read in the session time zone
    kind = dict(events.dtypes)[time]
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    marked = timed.withWatermark(time, late) if events.isStreaming else timed
    sums = marked.groupBy(F.window(time, window).alias("w"), key).agg(F.sum(clicks).alias("clicks"), F.sum(impressions).alias("impressions"))
    return sums.select(F.col("w.start").cast(kind).alias("window_start"), key, "clicks", "impressions", smoothed_rate(F.col("clicks"), F.col("impressions")).alias("rate"))
