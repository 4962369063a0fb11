"""Boxes of a detector and tracker to observations, and the views whose pictures become fingerprints.

    spark-submit groundtrack/jobs/observe.py --boxes B --camera-map M --out O [--frames N] [--size W H]

Observations are in folders by site, session and Camera, in time order; views in a table beside them."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrack import schema as S
from groundtrack.operators import detections, views
from groundtrack.sources.calibrations import read_camera_map
from groundtrack.sources.observations import centiseconds, write_observations

BOX = ["x1", "y1", "x2", "y2"]


def observed(boxes: DataFrame, cameras: DataFrame, frames: int | None = None) -> DataFrame:
    """boxes: keys, Video, frame_idx, video_s, Track_ID, Class, score, x1, y1, x2, y2; cameras: the rows of
    a camera map. Gives the columns of observations, ts_cs and the box.

    Only recorded classes stay, and weak boxes only in tracks that a sure one has opened. Videos that
    the map doesn't name start at 0 and are cameras by their own name."""
    rows = detections.recorded(boxes if frames is None else detections.first_frames(boxes, frames)).withColumn("Camera", F.col("Video"))
    rows = detections.two_level(detections.box_points(rows).withColumn("ts_cs", centiseconds(F.col("video_s"))))
    segments = boxes.select(*S.KEYS, "Video").distinct().join(cameras, "Video").select(*S.KEYS, F.col("Video").alias("Camera"), "segment", "from_s", "start_s")
    names = cameras.select("Video", F.col("Camera").alias("name")).distinct()
    out = detections.on_session_clock(rows, segments).join(names, "Video", "left").withColumn("Camera", F.coalesce("name", "Video"))
    out = out.withColumn("Timestamp", F.round("session_s", 2))
    out = out.withColumn("ts_cs", centiseconds(F.col("Timestamp")))
    return out.select(*S.TRACK, "Timestamp", "Class", "Center_X", "Center_Y", "Foot_X", "Foot_Y", "Detection_Conf", "ts_cs", *BOX)


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--boxes", required=True)
    p.add_argument("--camera-map", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--frames", type=int, help="only the first frames of each video")
    p.add_argument("--size", nargs=2, type=float, default=(1920.0, 1080.0), help="of a frame, in pixels")
    a = p.parse_args()
    spark = SparkSession.builder.appName("observe").getOrCreate()
    rows = observed(spark.read.parquet(a.boxes), read_camera_map(spark, a.camera_map), a.frames)
    write_observations(rows.drop("ts_cs", *BOX), f"{a.out}/observations")
    views.fingerprint_views(rows.where("Class = 'person'"), *a.size).write.mode("overwrite").parquet(f"{a.out}/views")


if __name__ == "__main__":
    main()
