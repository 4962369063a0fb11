"""Frames for training: those without detections, or with unsure ones only, evenly chosen."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack import schema as S
from groundtrack.operators.detections import thinned

FRAME = [*S.KEYS, "Camera", "ts_cs"]


def sharp(frames: DataFrame, least: float) -> DataFrame:
    return frames.where(F.col("sharpness") >= least)


def empty_frames(frames: DataFrame, detections: DataFrame, name: str | None = None) -> DataFrame:
    """Frames without a detection (of a class, if given)."""
    found = detections if name is None else detections.where(F.col("Class") == name)
    return frames.join(found.select(*FRAME), FRAME[::-1], "left_anti")


def soft_empty_frames(frames: DataFrame, detections: DataFrame, bar: float) -> DataFrame:
    """Frames without a detection of `bar` or more."""
    return frames.join(detections.where(F.col("Detection_Conf") >= bar).select(*FRAME), FRAME[::-1], "left_anti")


def evenly(frames: DataFrame, n: int) -> DataFrame:
    """n frames of each camera, spread evenly over its frames in time: items int(i * count / n); all
    where there are no more than n.

    Frames are ranked within blocks of time and by the blocks' counts, so that no camera's frames
    are sorted in one task."""
    key, block = [*S.KEYS, "Camera"], F.floor(F.col("ts_cs") / 60000).alias("_block")
    rows = frames.select("*", block)
    counts = rows.groupBy(*key, "_block").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key)
    counts = counts.withColumn("_all", F.sum("_n").over(w)).withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*key, "_block").orderBy("ts_cs")) - 1 + F.col("_before")
    rows = rows.join(counts, [*key, "_block"]).withColumn("_k", rank)
    # k is some floor(i * all / n) if and only if the first i that reaches it lands on it
    i = F.ceil(F.col("_k") * n / F.col("_all"))
    hit = (F.col("_all") <= n) | ((i < n) & (F.floor(i * F.col("_all") / n) == F.col("_k")))
    return rows.where(hit).drop("_block", "_n", "_before", "_all", "_k")


def mined(frames: DataFrame, detections: DataFrame, videos: DataFrame, fps: float, least: float, n: int, name: str | None = None, bar: float | None = None) -> DataFrame:
    """n frames of each camera, evenly in time, of those that are sharp and without a detection (of a
    class), or without one of `bar` or more, among some `fps` a second.

    frames: FRAME, frame_idx, sharpness; videos: keys, Camera, fps."""
    some = sharp(thinned(frames, videos, fps), least).select(*frames.columns)
    free = empty_frames(some, detections, name) if bar is None else soft_empty_frames(some, detections, bar)
    return evenly(free, n)


def label(path: str, name: str, most: int = 24):
    """File stem, cut, with a short hash of the whole name."""
    stem = F.regexp_extract(F.col(path), r"([^/]+?)(\.[^./]*)?$", 1)
    return F.concat(F.substring(F.regexp_replace(stem, " ", "_"), 1, most), F.lit("_"), F.substring(F.sha1(F.col(path).cast("binary")), 1, 8)).alias(name)


def every_nth(fps: float, target: float) -> int:
    return max(1, math.floor((fps or 30.0) / target + 0.5))
