"""Views of a track: sets after gaps, spacing, the tallest of k stretches, set similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack import schema as S
from groundtrack.operators import detections


def height(floored: bool = False):
    """Box height: twice the distance from centre to foot."""
    h = 2 * (F.col("Foot_Y") - F.col("Center_Y"))
    return F.greatest(F.lit(0.0), h) if floored else h


def view_sets(df: DataFrame, gap_s: float = 6.0) -> DataFrame:
    """Adds view_set: a new set starts after more than gap_s unseen."""
    w = Window.partitionBy(*S.TRACK[::-1]).orderBy("ts_cs")
    new = (F.col("ts_cs") - F.lag("ts_cs").over(w) > int(round(gap_s * 100))).cast("long")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("view_set", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def spaced_views(df: DataFrame, apart_s: float = 0.2, most: int = 60) -> DataFrame:
    """Views at least apart_s after the last accepted one; on exceeding `most`, every other stays.

    What is accepted depends on what was, so each set is walked through in a task; the sets of a
    camera that begin in the same ten minutes share a call."""
    step = int(round(apart_s * 100))
    keys = [*S.TRACK, "view_set"]
    rows = df.select(*keys, "ts_cs").withColumn("_block", F.floor(F.min("ts_cs").over(Window.partitionBy(*keys)) / 60000))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, "ts_cs"], ignore_index=True)
        new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        times, at, chosen = pdf.ts_cs.to_numpy(), np.flatnonzero(new), []
        for a, b in zip(at, [*at[1:], len(pdf)], strict=True):
            kept: list[int] = []
            last = None
            for i in range(a, b):
                if last is None or times[i] - last >= step:
                    kept.append(i)
                    last = times[i]
                    if len(kept) > most:
                        kept = kept[::2]
            chosen += kept
        return pdf.loc[chosen, [*keys, "ts_cs"]]

    return rows.groupBy(*S.KEYS, "Camera", "_block").applyInPandas(walk, rows.drop("_block").schema)


def tallest_of_stretches(df: DataFrame, k: int = 5, by: str = "Height_Px", of: tuple = S.TRACK) -> DataFrame:
    """The tallest view of each of k stretches of a track's views (of the views that are alike in `of`),
    of nearly equal counts, larger ones first; the earliest of equally tall ones. Adds stretch from 1."""
    w = Window.partitionBy(*of).orderBy("ts_cs")
    df = df.withColumn("stretch", F.ntile(k).over(w))
    best = Window.partitionBy(*of, "stretch").orderBy(F.col(by).desc(), "ts_cs")
    return df.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth")


def fingerprint_views(boxes: DataFrame, width: float, height: float, k: int = 20, gap_s: float = 6.0, apart_s: float = 0.2, most: int = 60) -> DataFrame:
    """The boxes whose pictures become a track's fingerprints: TRACK, view_set, stretch, ts_cs, Height_Px.

    boxes: person boxes with x1, y1, x2, y2 and Detection_Conf. Sets follow from all boxes of a track;
    clear ones some time apart are its views, and of each of k stretches of a set the tallest stays."""
    sets = view_sets(boxes, gap_s)
    clear = detections.clear_views(sets, width, height).select(*S.TRACK, "view_set", "ts_cs", (F.col("y2") - F.col("y1")).alias("Height_Px"))
    spaced = spaced_views(clear, apart_s, most).join(clear, ["ts_cs", *S.TRACK[::-1], "view_set"])
    return tallest_of_stretches(spaced, k, of=(*S.TRACK, "view_set")).select(*S.TRACK, "view_set", "stretch", "ts_cs", "Height_Px")


def set_similarity(pairs: DataFrame, a: str = "views_a", b: str = "views_b") -> DataFrame:
    """Adds similarity: the largest inner product over all pairs of views of two sets."""

    @F.pandas_udf("double")
    def best(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            if p is None or q is None or not len(p) or not len(q):
                return None
            return float((np.stack(p).astype(np.float64) @ np.stack(q).astype(np.float64).T).max())

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("similarity", best(a, b))


def candidates(people: DataFrame, views: DataFrame | None = None, k: int = 5, least: float = S.MIN_HEIGHT_PX) -> DataFrame:
    """One row for each person track with a position: entry, exit, span, views and eligibility.

    views: a track's fingerprints (ts_cs, Height_Px or null, Vector). With heights, one of `least`
    makes the track eligible and the tallest of k stretches are its exemplars; views without heights
    are all used if the median height of the track's first five rows reaches `least`."""
    placed = F.col("Local_X_Meters").isNotNull()
    point = F.struct("ts_cs", "Local_X_Meters", "Local_Y_Meters")
    first = F.row_number().over(Window.partitionBy(*S.TRACK[::-1]).orderBy("ts_cs"))
    rows = people.withColumn("_h", F.when(first <= 5, height()))
    out = rows.groupBy(*S.TRACK).agg(
        F.min(F.when(placed, point)).alias("entry"), F.max(F.when(placed, point)).alias("exit"), F.count("*").alias("n_rows"), F.median("_h").alias("first_heights")
    )
    out = out.where(F.col("entry").isNotNull()).select(
        *S.TRACK, "n_rows", "first_heights",
        F.col("entry.ts_cs").alias("t0"), F.col("entry.Local_X_Meters").alias("x0"), F.col("entry.Local_Y_Meters").alias("y0"),
        F.col("exit.ts_cs").alias("t1"), F.col("exit.Local_X_Meters").alias("x1"), F.col("exit.Local_Y_Meters").alias("y1"),
    )
    if views is None:
        return out
    tall = tallest_of_stretches(views.where("Height_Px >= " + str(least)), k)
    with_heights = tall.groupBy(*S.TRACK).agg(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "Vector"))), lambda x: x["Vector"]).alias("tall"))
    legacy = views.where("Height_Px is null").groupBy(*S.TRACK).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts_cs", "Vector"))), lambda x: x["Vector"]).alias("legacy"))
    out = out.join(with_heights, S.TRACK, "left").join(legacy, S.TRACK, "left")
    old = F.when(F.col("first_heights") >= least, F.col("legacy"))
    return out.withColumn("exemplars", F.coalesce("tall", old)).withColumn("eligible", F.col("exemplars").isNotNull()).drop("tall", "legacy")
