"""Counts of what is present, as observations arrive.

An addition of this library: two windowed aggregates in a row, distinct identities in each bucket
and then mean and peak in each interval, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrack import schema as S


def presence_stream(rows: DataFrame, late: str = "10 seconds", bucket: str = "500 milliseconds", interval: str = "60 seconds") -> DataFrame:
    """rows: KEYS, at (timestamp), Category, Global_ID. Identities are counted approximately, as
    exact distinct counts would keep every identity in the state."""
    per = rows.withWatermark("at", late).groupBy(F.window("at", bucket), *S.KEYS, "Category").agg(F.approx_count_distinct("Global_ID", 0.01).alias("n"))
    length = lambda: F.unix_millis("window.end") - F.unix_millis("window.start")
    per = per.withColumn("ms", length())
    out = per.groupBy(F.window(F.window_time("window"), interval), *S.KEYS, "Category").agg(F.sum("n").alias("total"), F.max("n").alias("Peak_Present"), F.max("ms").alias("ms"))
    mean = F.col("total") * F.col("ms") / length()  # an interval's buckets, empty ones too
    return out.select(*S.KEYS, "Category", F.col("window.start").alias("Interval_Start"), mean.alias("Mean_Present"), "Peak_Present")
