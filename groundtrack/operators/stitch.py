"""Track breaks: which track goes on as which, one to one, within a second."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack import schema as S
from groundtrack.operators.components import bundle, components, cut
from groundtrack.operators.matching import sparse_assign

CAMERA = [*S.KEYS, "Camera"]


def track_ends(df: DataFrame) -> DataFrame:
    """t0, x0, y0, t1, x1, y1 of each track and its end velocity: mean of the last fifth less mean of
    the first fifth of its last second, null for less than 0.25 s."""
    df = df.where(F.col("Local_X_Meters").isNotNull())
    track = Window.partitionBy(*S.TRACK[::-1])
    tail = df.withColumn("_last", F.max("ts_cs").over(track)).where(F.col("_last") - F.col("ts_cs") <= 100)
    up = track.orderBy("ts_cs")
    tail = tail.withColumn("_i", F.row_number().over(up)).withColumn("_n", F.count("*").over(track))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / 5))
    first, last = F.col("_i") <= k, F.col("_i") > F.col("_n") - k
    mean = lambda c, on: F.avg(F.when(on, F.col(c)))
    v = tail.groupBy(*S.TRACK).agg(
        (F.max("ts_cs") - F.min("ts_cs")).alias("span"),
        ((mean("ts_cs", last) - mean("ts_cs", first)) / 100).alias("dt"),
        (mean("Local_X_Meters", last) - mean("Local_X_Meters", first)).alias("dx"),
        (mean("Local_Y_Meters", last) - mean("Local_Y_Meters", first)).alias("dy"),
    )
    per = lambda c: F.when(F.col("span") >= 25, F.try_divide(F.col(c), F.col("dt")))
    v = v.select(*S.TRACK, per("dx").alias("vx"), per("dy").alias("vy"))
    point = F.struct("ts_cs", "Local_X_Meters", "Local_Y_Meters")
    ends = df.groupBy(*S.TRACK).agg(F.min(point).alias("p"), F.max(point).alias("q"))
    ends = ends.select(*S.TRACK, *(F.col(f"{s}.{c}").alias(n + k) for s, k in (("p", "0"), ("q", "1")) for c, n in (("ts_cs", "t"), ("Local_X_Meters", "x"), ("Local_Y_Meters", "y"))))
    return ends.join(v, S.TRACK, "left")


def stitch_edges(ends: DataFrame, gap_cs: int = 100) -> DataFrame:
    """Ends and starts within a second in one camera, near where the walker must be by then.

    With a velocity, within 1 + 1.5 * gap metres of the prediction; else 1 + 3 * gap of the end.
    Both sides meet by the second they lie in, the start's also by the one before."""
    a = ends.select(*CAMERA, F.col("Track_ID").alias("a"), "t1", "x1", "y1", "vx", "vy", F.floor(F.col("t1") / gap_cs).alias("slot"))
    b = ends.select(*CAMERA, F.col("Track_ID").alias("b"), "t0", "x0", "y0", F.explode(F.array(F.floor(F.col("t0") / gap_cs), F.floor(F.col("t0") / gap_cs) - 1)).alias("slot"))
    gap = (F.col("t0") - F.col("t1")) / 100
    moving = F.col("vx").isNotNull()
    px = F.col("x1") + F.coalesce(F.col("vx") * gap, F.lit(0.0))
    py = F.col("y1") + F.coalesce(F.col("vy") * gap, F.lit(0.0))
    error = F.hypot(F.col("x0") - px, F.col("y0") - py)
    allowed = 1 + F.when(moving, 1.5).otherwise(3.0) * gap
    met = a.join(b, [*CAMERA, "slot"]).where((F.col("t0") > F.col("t1")) & (F.col("t0") - F.col("t1") <= gap_cs) & (F.col("a") != F.col("b")))
    return met.withColumn("error", error).where(F.col("error") <= allowed).select(*CAMERA, "a", "b", "t1", "t0", "error")


def islands(edges: DataFrame) -> DataFrame:
    """Adds island: edges whose intervals overlap, in one camera. Edges that share a track overlap,
    so islands can be matched apart from each other."""
    w = Window.partitionBy(*CAMERA).orderBy("t1", "t0", "a", "b")
    reach = F.max("t0").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("t1") > reach).cast("long"), F.lit(1))
    return edges.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def parts(edges: DataFrame, most: int = 20_000) -> DataFrame:
    """Adds part: edges that share no track directly or through others are in different parts.

    Islands in time are such parts already, and cheap. Where cameras are so busy that an island has
    more than `most` edges, it is parted further, by the connected parts of its graph of ends and
    starts, in rounds of joins."""
    rows = cut(islands(edges))
    per = [*CAMERA, "island"]
    large = rows.groupBy(*per).count().where(F.col("count") > most).drop("count")
    name = F.xxhash64(*per)
    if large.isEmpty():
        return rows.withColumn("part", name).drop("island")
    busy = rows.join(large, per, "left_semi").select("*", F.xxhash64(*CAMERA, F.lit(0), "a").alias("_end"), F.xxhash64(*CAMERA, F.lit(1), "b").alias("_start"))
    found = components(busy.select(F.col("_end").alias("a"), F.col("_start").alias("b")))
    busy = busy.join(found.select(F.col("node").alias("_end"), F.col("component").alias("part")), "_end").drop("_end", "_start")
    return rows.join(large, per, "left_anti").withColumn("part", name).unionByName(busy).drop("island")


def matched(edges: DataFrame, most: int = 20_000) -> DataFrame:
    """The edges of a largest one-to-one matching of each camera's ends and starts, of least total error.

    A part's edges are matched in one task, in memory that follows their number. An edge that is alone in
    its part is its matching; the other parts, mostly of a few edges each, share calls of some ten thousand."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*CAMERA, "part", "a", "b"], ignore_index=True)
        new = (pdf[[*CAMERA, "part"]] != pdf[[*CAMERA, "part"]].shift()).any(axis=1).to_numpy()
        a, b, error, chosen = pdf.a.to_numpy(), pdf.b.to_numpy(), pdf.error.to_numpy(), []
        at = np.flatnonzero(new)
        for i, j in zip(at, [*at[1:], len(pdf)], strict=True):
            chosen.append(i + np.asarray(sparse_assign(a[i:j], b[i:j], error[i:j]), np.int64))
        return pdf.iloc[np.concatenate(chosen)]

    rows = cut(parts(edges, most).withColumn("_n", F.count("*").over(Window.partitionBy("part", *CAMERA[::-1]))))
    alone, several = rows.where("_n = 1").drop("_n"), rows.where("_n > 1").drop("_n")
    solved = several.groupBy(bundle(several.count(), "part", *CAMERA).alias("_bundle")).applyInPandas(solve, several.schema)
    return alone.unionByName(solved).drop("part")
