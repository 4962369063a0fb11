"""Ground covered by cameras, and the extent of a site's map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrack import schema as S
from groundtrack.operators.quantiles import quantiles


def extent(df: DataFrame, pad: float = 10.0, least_half: float = 20.0) -> DataFrame:
    """x0, x1, y0, y1 of each site and session: the cameras' 1st and 99th percentiles, padded, and
    widened about the middle to twice the least half size."""
    axes = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("Local_X_Meters").alias("at")), F.struct(F.lit("y").alias("axis"), F.col("Local_Y_Meters").alias("at"))))
    rows = df.where("Local_X_Meters is not null").select(*S.KEYS, "Camera", axes.alias("p")).select(*S.KEYS, "Camera", "p.*")
    cams = quantiles(rows, [*S.KEYS, "Camera", "axis"], "at", [0.01, 0.99])
    end = lambda axis, i, f: f(F.when(F.col("axis") == axis, F.col("q")[i])).alias(f"{axis}{i}")
    box = cams.groupBy(*S.KEYS).agg(*[end(axis, i, f) for axis in "xy" for i, f in ((0, F.min), (1, F.max))])
    out = {}
    for c in "xy":
        mid, half = (F.col(c + "0") + F.col(c + "1")) / 2, F.greatest((F.col(c + "1") - F.col(c + "0")) / 2 + pad, F.lit(least_half))
        out |= {c + "0": mid - half, c + "1": mid + half}
    return box.select(*S.KEYS, *(v.alias(k) for k, v in out.items()))


def cells(df: DataFrame, box: DataFrame, size: float = 2.0, least: int = 5) -> DataFrame:
    """Cells of the extent that a camera covers: at least `least` positions. The grid has
    ceil(width / size) equal columns and rows; its right and upper edges are closed."""
    out = df.where("Local_X_Meters is not null").join(box, S.KEYS)
    for c, v in (("x", "Local_X_Meters"), ("y", "Local_Y_Meters")):
        width = F.col(c + "1") - F.col(c + "0")
        n = F.ceil(width / size)
        i = F.floor((F.col(v) - F.col(c + "0")) * n / width)
        out = out.where((F.col(v) >= F.col(c + "0")) & (F.col(v) <= F.col(c + "1"))).withColumn("i" + c, F.least(i, n - 1))
    return out.groupBy(*S.KEYS, "Camera", "ix", "iy").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)


def areas(covered: DataFrame, size: float = 2.0) -> DataFrame:
    """Square metres that each camera covers, that two or more do, and that all do."""
    one = covered.groupBy(*S.KEYS, "Camera").agg((F.count("*") * size**2).alias("area_m2")).select(*S.KEYS, F.col("Camera").alias("what"), "area_m2")
    seen = covered.groupBy(*S.KEYS, "ix", "iy").agg(F.count_distinct("Camera").alias("n"))
    every = covered.groupBy(*S.KEYS).agg(F.count_distinct("Camera").alias("cameras"))
    some = seen.join(every, S.KEYS).groupBy(*S.KEYS).agg((F.count_if(F.col("n") >= 2) * size**2).alias("two"), (F.count_if(F.col("n") == F.col("cameras")) * size**2).alias("all"))
    rest = some.select(*S.KEYS, F.explode(F.map_from_arrays(F.array(F.lit("two or more"), F.lit("all")), F.array("two", "all"))).alias("what", "area_m2"))
    return one.unionByName(rest)
