"""Alignment of a drifting camera: matrices sampled over time, blended onto detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack import schema as S
from groundtrack.functions import geo
from groundtrack.operators.detections import one_decimal

#: Centiseconds of a camera's time that meet in one group.
BLOCK_CS = 60_000


def bracketed(df: DataFrame, samples: DataFrame, far_s: float = 3.0) -> DataFrame:
    """Adds H: the trusted matrix at each row's time, or null.

    Of the last sample before a time and the first at or after it, both are blended by time if they
    lie within twice `far_s` of each other and the nearer within `far_s`; else the nearer one counts
    if it is within `far_s` (the earlier on a tie); outside of the sampled span, its end counts then.
    A sample further than twice `far_s` from a row never counts for it, so rows and samples (keys,
    Camera, ts_cs, H) meet in blocks of a camera's time, each with the samples around it, and pass
    one window in ascending and one in descending order of time."""
    far = int(round(far_s * 100))
    block = lambda t: F.floor(t / max(BLOCK_CS, 2 * far))
    rows = df.withColumns({"_kind": F.lit(1), "_block": block(F.col("ts_cs")), "_s": F.lit(None).cast("struct<t: bigint, H: array<double>>")})
    marks = samples.where("H is not null and ts_cs is not null").select(*S.KEYS, "Camera", F.col("ts_cs").cast("long").alias("ts_cs"), F.lit(0).alias("_kind"), F.struct(F.col("ts_cs").cast("long").alias("t"), "H").alias("_s"))
    marks = marks.withColumn("_block", F.explode(F.sequence(block(F.col("ts_cs") - 2 * far), block(F.col("ts_cs") + 2 * far))))
    w = Window.partitionBy(*S.KEYS, "Camera", "_block")
    both = rows.unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("_a", F.last("_s", ignorenulls=True).over(w.orderBy("ts_cs").rangeBetween(Window.unboundedPreceding, -1)))
    both = both.withColumn("_b", F.last("_s", ignorenulls=True).over(w.orderBy(F.desc("ts_cs")).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    t, a, b = F.col("ts_cs"), F.col("_a"), F.col("_b")
    da, db = t - a["t"], b["t"] - t
    share = F.when(b["t"] > a["t"], da / (b["t"] - a["t"]))
    mixed = F.zip_with(a["H"], b["H"], lambda p, q: p + (q - p) * share)
    nearer = F.when((da <= db) & (da <= far), a["H"]).when((db < da) & (db <= far), b["H"])
    inside = F.when(b["t"] - a["t"] <= 2 * far, F.when(F.least(da, db) <= far, mixed)).otherwise(nearer)
    only = F.when(a.isNull(), F.when(db <= far, b["H"])).when(b.isNull(), F.when(da <= far, a["H"])).otherwise(inside)
    return both.where("_kind = 1").withColumn("H", only).drop("_kind", "_block", "_s", "_a", "_b")


def aligned(df: DataFrame, samples: DataFrame) -> DataFrame:
    """Centre and foot in the reference frame's pixels, one decimal; the raw foot is kept."""
    out = bracketed(df, samples)
    move = lambda x, y: [one_decimal(c) for c in geo.project(F.col("H"), F.col(x), F.col(y))[:2]]
    fx, fy = move("Foot_X", "Foot_Y")
    new = {"Raw_Foot_X": F.col("Foot_X"), "Raw_Foot_Y": F.col("Foot_Y"), "Foot_X": fx, "Foot_Y": fy}
    if "Center_X" in df.columns:
        new["Center_X"], new["Center_Y"] = move("Center_X", "Center_Y")
    return out.withColumns(new).drop("H")


def shifts(samples: DataFrame, cx: float, cy: float) -> DataFrame:
    """Offset of the frame's centre under each sample's matrix."""
    x, y, _ = geo.project(F.col("H"), F.lit(cx), F.lit(cy))
    return samples.where("H is not null").withColumns({"dx": x - cx, "dy": y - cy})


def reference_frames(samples: DataFrame, cx: float, cy: float) -> DataFrame:
    """The sampled frame nearest to the median offset of each camera, and the shifts from it."""
    key = [*S.KEYS, "Camera"]
    moved = shifts(samples, cx, cy)
    middle = moved.groupBy(*key).agg(F.median("dx").alias("mx"), F.median("dy").alias("my"))
    off = moved.join(middle, key).withColumn("d", F.hypot(F.col("dx") - F.col("mx"), F.col("dy") - F.col("my")))
    chosen = off.groupBy(*key).agg(F.min_by(F.struct("ts_cs", "dx", "dy"), F.struct("d", "ts_cs")).alias("r"))
    size = F.hypot(F.col("dx") - F.col("r.dx"), F.col("dy") - F.col("r.dy"))
    return moved.join(chosen, key).groupBy(*key).agg(F.first("r.ts_cs").alias("reference_cs"), F.median(size).alias("median_shift"), F.max(size).alias("max_shift"), F.count("*").alias("n_samples"))
