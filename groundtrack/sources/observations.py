"""Observations: from files, and derived from the event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrack import schema as S


def centiseconds(seconds: Column) -> Column:
    """Session seconds as whole centiseconds, the unit in which times are compared."""
    return F.rint(seconds * 100).cast("long")


def read_positions(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Union of camera tables whose optional columns differ; positions must be there.

    Blank cells arrive as null, Camera as string."""
    reader = spark.read.option("header", True)
    one = lambda p: reader.schema(S.POSITIONS).csv(p) if fmt == "csv" else spark.read.parquet(p)
    tables = [one(p) for p in paths]
    missing = [p for p, t in zip(paths, tables, strict=True) if not {"Local_X_Meters", "Local_Y_Meters"} <= set(t.columns)]
    if missing:
        raise ValueError(f"no positions in {missing}: georeference them first")
    # before the union, which would make numbers of all cameras where one table has numbers
    out, *rest = (t.withColumn("Camera", F.col("Camera").cast("string")) for t in tables)
    for t in rest:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def in_time_order(df: DataFrame) -> DataFrame:
    """Rows dealt by camera and ten minutes, so that a busy camera has many tasks, each in time order."""
    keys = [*S.KEYS, "Camera"]
    return df.withColumn("_block", F.floor(F.col("Timestamp") / 600)).repartition(*keys, "_block").sortWithinPartitions(*keys, "Timestamp").drop("_block")


def write_observations(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder for each camera of a session, rows in time order inside its files."""
    in_time_order(df).write.partitionBy(*S.KEYS, "Camera").mode("errorifexists").format(fmt).option("header", True).save(path)


def from_events(events: DataFrame) -> DataFrame:
    """Three-second walks at 10 frames a second, derived from each event by whole numbers.

    Kind 0 is a walk; 1 the same walker seen by the next camera; 2 a bicycle beside it; 3 the same
    walker found again half a second later under a new track.

    The steps are a table that events are joined with, not an array that is exploded: an explode counts
    as no growth when Spark reckons sizes, so rows of a 10 MB file of events, 45 to an event, would be
    taken for a small table and sent to the driver for a broadcast."""
    e = events.select("event_id", "user_id", "value", F.explode(F.array(*(F.lit(n).cast("long") for n in range(4)))).alias("kind"))
    i, kind = F.col("event_id"), F.col("kind")
    e = e.where((kind == 0) | ((kind == 1) & (i % 4 == 0)) | ((kind == 2) & (i % 10 == 0)) | ((kind == 3) & (i % 6 == 0)))
    n = F.col("id")
    steps = events.sparkSession.range(116).select(F.least(F.floor(n / 30), F.lit(3)).cast("long").alias("kind"), F.when(n < 90, n % 30).otherwise(n - 56).alias("k"))
    e = e.join(F.broadcast(steps), "kind")
    k, u = F.col("k"), F.col("user_id")
    x = (u * 137 + i * 61) % 4000 + F.when(kind == 1, 30).when(kind == 2, 60).otherwise(0) + (u % 41 - 20) * k
    y = (F.floor(F.col("value") * 100 + 0.5).cast("long") * 7) % 3000 + F.when(kind == 1, 20).otherwise(0) + (i % 31 - 15) * k
    t, foot = i * 40 + k * 10, 500 + y.cast("double") / 10
    return e.select(
        F.concat(F.lit("s"), F.floor(i / 12) % 2).alias("site_id"),
        F.concat(F.lit("d"), F.floor(i / 4000)).alias("session_id"),
        F.concat(F.lit("cam"), F.when(kind == 1, (i + 1) % 3).otherwise(i % 3)).alias("Camera"),
        t.alias("ts_cs"),
        (t.cast("double") / 100).alias("Timestamp"),
        (i + kind.cast("long") * 1000000).alias("Track_ID"),
        F.when(i % 10 == 9, "car").when((i % 10 == 8) | (kind == 2), "bicycle").otherwise("person").alias("Class"),
        (x.cast("double") / 100).alias("Local_X_Meters"),
        (y.cast("double") / 100).alias("Local_Y_Meters"),
        (x.cast("double") / 4).alias("Foot_X"),
        foot.alias("Foot_Y"),
        (foot - (40 + i % 120).cast("double") / 2).alias("Center_Y"),
        ((20 + (i * 7 + k * 13) % 80).cast("double") / 100).alias("Detection_Conf"),
    )


#: The same rows in SQL, as the table expression obs.
SQL = """
ev AS (SELECT event_id AS i, user_id AS u, value, unnest([0, 1, 2, 3]) AS kind FROM events),
ek AS (SELECT *, unnest(CASE WHEN kind = 3 THEN range(34, 60) ELSE range(0, 30) END) AS k FROM ev
  WHERE kind = 0 OR (kind = 1 AND i % 4 = 0) OR (kind = 2 AND i % 10 = 0) OR (kind = 3 AND i % 6 = 0)),
exy AS (SELECT *, (u * 137 + i * 61) % 4000 + CASE kind WHEN 1 THEN 30 WHEN 2 THEN 60 ELSE 0 END + (u % 41 - 20) * k AS x,
  (CAST(floor(value * 100 + 0.5) AS BIGINT) * 7) % 3000 + CASE WHEN kind = 1 THEN 20 ELSE 0 END + (i % 31 - 15) * k AS y FROM ek),
obs AS (SELECT 's' || ((i // 12) % 2) AS site_id, 'd' || (i // 4000) AS session_id,
  'cam' || CASE WHEN kind = 1 THEN (i + 1) % 3 ELSE i % 3 END AS Camera, i * 40 + k * 10 AS ts_cs,
  CAST(i * 40 + k * 10 AS DOUBLE) / 100 AS Timestamp, i + kind * 1000000 AS Track_ID,
  CASE WHEN i % 10 = 9 THEN 'car' WHEN i % 10 = 8 OR kind = 2 THEN 'bicycle' ELSE 'person' END AS Class,
  CAST(x AS DOUBLE) / 100 AS Local_X_Meters, CAST(y AS DOUBLE) / 100 AS Local_Y_Meters, CAST(x AS DOUBLE) / 4 AS Foot_X,
  500 + CAST(y AS DOUBLE) / 10 AS Foot_Y, 500 + CAST(y AS DOUBLE) / 10 - CAST(40 + i % 120 AS DOUBLE) / 2 AS Center_Y,
  CAST(20 + (i * 7 + k * 13) % 80 AS DOUBLE) / 100 AS Detection_Conf FROM exy)
"""


def read_fingerprints(spark: SparkSession, paths: str) -> DataFrame:
    """Rows of numpy archives: camera_ids, track_ids and vectors, in newer ones timestamps and
    heights_px too; null in older ones. Each file is read in a task, from any store Spark reads."""

    def rows(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for content in pdf.content:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    n = len(z["track_ids"])
                    optional = lambda k: z[k].astype(float) if k in z.files else np.full(n, np.nan)  # noqa: B023, E731
                    out = pd.DataFrame({"Camera": z["camera_ids"].astype(str), "Track_ID": z["track_ids"].astype("int64"), "Timestamp": optional("timestamps"), "Height_Px": optional("heights_px")})
                    yield out.assign(Vector=list(z["vectors"].astype(np.float32)))

    files = spark.read.format("binaryFile").load(paths).select("content")
    out = files.mapInPandas(rows, S.FINGERPRINTS)
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("Camera", "Track_ID", known("Timestamp"), known("Height_Px"), "Vector")
