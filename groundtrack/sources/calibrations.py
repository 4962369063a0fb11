"""Calibration points and camera maps from their JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "site_id string, camera_id string, points array<struct<video_xy: array<double>, lat: double, lon: double>>"
VIDEO = "camera_id string, start_timestamp double, reference_frame string, segments array<struct<from_video_s: double, start_timestamp: double>>"


def objects(text: str, schema: str) -> Column:
    """Map of the objects of a JSON object by their names; entries of other kinds, as notes, are left out."""
    entries = F.map_filter(F.from_json(text, "map<string, string>"), lambda _, v: F.ltrim(v).startswith("{"))
    return F.transform_values(entries, lambda _, v: F.from_json(v, schema))


def read_points(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """site_id, Camera, idx, px, py, lon, lat of each point; a file holds those of one camera."""
    rows = spark.read.schema(POINTS).json(paths, multiLine=True)
    rows = rows.select("site_id", F.col("camera_id").alias("Camera"), F.posexplode("points").alias("idx", "p"))
    return rows.select("site_id", "Camera", F.col("idx").cast("long").alias("idx"), F.col("p.video_xy")[0].alias("px"), F.col("p.video_xy")[1].alias("py"), "p.lon", "p.lat")


def read_camera_map(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Video, Camera, reference_frame, segment, from_s, start_s: a row for each recording of a video.

    Videos without an own camera name are named by their stem, those without segments have one from
    0 on, which starts at their start_timestamp or at 0."""
    rows = spark.read.text(paths, wholetext=True).select(F.explode(objects("value", VIDEO)).alias("Video", "v")).where(~F.col("Video").startswith("_"))
    whole = F.array(F.struct(F.lit(0.0).alias("from_video_s"), F.coalesce("v.start_timestamp", F.lit(0.0)).alias("start_timestamp")))
    segments = F.when(F.size("v.segments") > 0, F.array_sort("v.segments")).otherwise(whole)
    rows = rows.select("Video", F.coalesce("v.camera_id", "Video").alias("Camera"), "v.reference_frame", F.posexplode(segments).alias("segment", "s"))
    return rows.select("Video", "Camera", "reference_frame", F.col("segment").cast("long").alias("segment"), F.col("s.from_video_s").alias("from_s"), F.col("s.start_timestamp").alias("start_s"))
