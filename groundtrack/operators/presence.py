"""Composite paths, vehicles, and counts of what is present over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack import schema as S
from groundtrack.operators.components import cut, drop_cut, sized
from groundtrack.operators.identities import BUCKET, bucket_of
from groundtrack.operators.views import height


def precision(df: DataFrame, hulls: DataFrame | None = None) -> DataFrame:
    """Adds precision: box height, halved outside of the camera's calibrated area.

    hulls: keys, Camera, planes, an array of a, b, c with a*x + b*y + c >= 0 inside of the enlarged
    hull (one row for each camera); without a row, or without planes, the weight is 1."""
    if hulls is None:
        return df.withColumn("precision", height(True))
    df = df.join(sized(hulls.select(*S.KEYS, "Camera", "planes")), [*S.KEYS, "Camera"], "left")
    inside = F.forall("planes", lambda p: p["a"] * F.col("Foot_X") + p["b"] * F.col("Foot_Y") + p["c"] >= 0)
    known = F.coalesce(F.size("planes") >= 3, F.lit(False))
    weight = F.when(known & ~F.coalesce(inside, F.lit(False)), 0.5).otherwise(1.0)
    return df.withColumn("precision", height(True) * weight).drop("planes")


def best_views(people: DataFrame, bucket_cs: int = BUCKET) -> DataFrame:
    """The most precise row of each identity in each bucket; ties by camera, track and time.

    A top-one aggregate, so that rows are reduced before they move."""
    people = people.where(F.col("Local_X_Meters").isNotNull()).withColumn("bucket", bucket_of(F.col("ts_cs"), bucket_cs))
    keys, rank = [*S.KEYS, "Global_ID", "bucket"], ["Camera", "Track_ID", "ts_cs"]
    rest = [c for c in people.columns if c not in [*keys, *rank, "precision"]]
    row = F.struct((-F.col("precision")).alias("_less"), *rank, *rest)  # its first fields are the rank; nothing moves twice
    best = people.groupBy("bucket", "Global_ID", *S.KEYS).agg(F.min(row).alias("_row"))
    return best.select(*keys, (-F.col("_row._less")).alias("precision"), *(F.col(f"_row.{c}").alias(c) for c in [*rank, *rest]))


def gaps_filled(best: DataFrame, bucket_cs: int = BUCKET, most_cs: int = 100) -> DataFrame:
    """Adds rows on the straight line where 2 up to rint((most + bucket) / bucket) steps lie between
    an identity's rows; pixels are null there, all else is the earlier row's. Adds Interpolated."""
    most = round((most_cs + bucket_cs) / bucket_cs)
    w = Window.partitionBy(*S.KEYS, "Global_ID").orderBy("bucket")
    line = [c for c in ("Local_X_Meters", "Local_Y_Meters", "Longitude", "Latitude") if c in best.columns]
    pixels = [c for c in ("Foot_X", "Foot_Y", "Center_X", "Center_Y", "Raw_Foot_X", "Raw_Foot_Y", "Detection_Conf") if c in best.columns]
    nxt = best.withColumn("_next", F.lead(F.struct("bucket", *line)).over(w))
    steps = F.col("_next.bucket") - F.col("bucket")
    holes = nxt.where((steps >= 2) & (steps <= most)).withColumn("_at", F.explode(F.sequence(F.col("bucket") + 1, F.col("_next.bucket") - 1)))
    share = (F.col("_at") - F.col("bucket")) / steps
    filled = holes.withColumns({c: F.col(c) + (F.col(f"_next.{c}") - F.col(c)) * share for c in line} | {c: F.lit(None).cast(dict(best.dtypes)[c]) for c in pixels})
    time = F.col("_at") * bucket_cs
    filled = filled.withColumns({"bucket": F.col("_at"), "ts_cs": time, "Timestamp": time / 100}).drop("_at", "_next")
    return best.withColumn("Interpolated", F.lit(False)).unionByName(filled.withColumn("Interpolated", F.lit(True)))


def vehicle_rows(df: DataFrame, one_per_track: bool = False) -> DataFrame:
    """Rows that count as vehicles, with their bucket; all of them, or one of a track in a bucket."""
    rows = df.where((F.col("Class") != "person") & ~F.col("Class").isin(*S.DEFERRED) & F.col("Local_X_Meters").isNotNull())
    rows = rows.withColumn("bucket", bucket_of(F.col("ts_cs")))
    if one_per_track:
        w = Window.partitionBy(*S.TRACK[::-1], "bucket").orderBy(F.col("precision").desc(), "ts_cs")
        rows = rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    return rows


def _pairs(rows: DataFrame, keys: list[str], n: int, side: float = 4.0) -> DataFrame:
    """Later row i and earlier row k of a group, of different cameras and within the class's radius d.

    The earlier row lies in one cell of `side` radii, the later one in those that its radius touches, some
    two on average: a pair is made once and far rows never meet. n: rows at most."""
    radius = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in S.VEHICLE_RADIUS.items() for v in pair]), F.col("Class")), F.lit(S.OTHER_RADIUS))
    cell = lambda at: F.floor(at / (radius * side))
    x, y = F.col("Local_X_Meters").alias("x"), F.col("Local_Y_Meters").alias("y")
    # a hair more than the radius, so that no rounding of a quotient leaves a cell out
    touched = lambda c: F.explode(F.sequence(cell(F.col(c) - radius * 1.001), cell(F.col(c) + radius * 1.001)))
    left = rows.select(*keys, "n", "Camera", x, y).withColumn("cx", touched("x")).withColumn("cy", touched("y"))
    right = rows.select(*keys, F.col("n").alias("k"), F.col("Camera").alias("other"), x.alias("ox"), y.alias("oy"), cell(x).alias("cx"), cell(y).alias("cy"))
    met = left.join(sized(right, n), ["bucket", "cx", "cy", *[c for c in keys if c != "bucket"]]).where("k < n and other <> Camera")
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return met.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= radius).select(*keys, F.col("n").alias("i"), "Camera", "k", "d")


def vehicles(rows: DataFrame) -> DataFrame:
    """Vehicles in each bucket: rows of one class from different cameras within the class's radius
    are one vehicle, the most precise of them stays, and absorbs one row of each other camera.

    Settled in rounds over the pairs that are still open, all buckets at once. A row stays for sure when no open
    pair is left in which it is the later one. A pair is settled when its earlier row stays for sure, it is the
    later row's nearest open pair, and no more precise row of that camera has an open pair with the earlier one:
    nothing that comes before could still take either side. Then the pairs of the absorbed row, and those of its
    camera with the row that took it, close. The first open row of a bucket can always be settled, so it ends.

    Only rows of buckets that several cameras see look for pairs. What a round joins is counted first: a few
    megabytes of a cut's files may hold millions of pairs, which no driver could hold."""
    keys = ["bucket", "Class", *S.KEYS]
    place = [c for c in ("Local_X_Meters", "Local_Y_Meters", "Longitude", "Latitude") if c in rows.columns]
    group = lambda *more: Window.partitionBy("bucket", *more, *keys[1:])
    order = [F.desc("precision"), "Camera", "Track_ID", "ts_cs", "Local_X_Meters", "Local_Y_Meters"]
    numbered = rows.withColumns({"n": F.row_number().over(group().orderBy(*order)), "_shared": F.min("Camera").over(group()) != F.max("Camera").over(group())})
    rows = cut(numbered.select(*keys, *place, "Camera", "n", "_shared"))
    shared = rows.where("_shared")
    still, gone = cut(_pairs(shared, keys, shared.count())), []
    while True:
        open_ = still.count()
        later = still.select(*keys, F.col("i").alias("k")).distinct()
        ready = still.withColumns({
            "_nearest": F.row_number().over(group("i").orderBy("d", "k")) == 1,
            "_first": F.min("i").over(group("k", "Camera")) == F.col("i"),
        })
        settled = cut(ready.where("_nearest and _first").join(sized(later, open_), [*keys, "k"], "left_anti").select(*keys, "i", "k", "Camera"))
        n = settled.count()
        if not n:
            break
        gone.append((settled.select(*keys, F.col("i").alias("n")), n))
        taken = gone[-1][0]
        before, still = still, still.join(sized(taken.withColumnRenamed("n", "i"), n), [*keys, "i"], "left_anti")
        still = still.join(sized(taken.withColumnRenamed("n", "k"), n), [*keys, "k"], "left_anti")
        still = cut(still.join(sized(settled.select(*keys, "k", "Camera"), n), [*keys, "k", "Camera"], "left_anti"))
        drop_cut(before)
    if gone:
        taken = sized(reduce(DataFrame.unionByName, [t for t, _ in gone]), sum(n for _, n in gone))
        rows = rows.join(taken, [*keys, "n"], "left_anti")
    return rows.select(*S.KEYS, (F.col("bucket") * BUCKET / 100).alias("Timestamp"), "bucket", "Class", *place, F.col("Camera").alias("Source_Camera"))


def counts_over_time(composite: DataFrame, found: DataFrame, times: DataFrame, interval_s: int = S.INTERVAL_S) -> DataFrame:
    """Mean and peak number present in each interval by category: people by mode as distinct
    identities, vehicles by class as rows. Empty buckets count as zero; the buckets are those from
    the first to the last time of all rows (`times`), so nothing is laid out bucket by bucket."""
    people = composite.groupBy(*S.KEYS, "bucket", F.concat(F.lit("person ("), F.col("Mode"), F.lit(")")).alias("category")).agg(F.count_distinct("Global_ID").alias("n"))
    cars = found.groupBy(*S.KEYS, "bucket", F.col("Class").alias("category")).agg(F.count("*").alias("n"))
    present = people.unionByName(cars)
    interval = lambda b: F.floor(b * BUCKET / (interval_s * 100)).cast("long")
    span = times.groupBy(*S.KEYS).agg(bucket_of(F.min("ts_cs")).alias("b0"), bucket_of(F.max("ts_cs")).alias("b1"))
    per = interval_s * 100 // BUCKET
    grid = span.select(*S.KEYS, "b0", "b1", F.explode(F.sequence(interval(F.col("b0")), interval(F.col("b1")))).alias("interval"))
    grid = grid.select(*S.KEYS, "interval", (F.least("b1", (F.col("interval") + 1) * per - 1) - F.greatest("b0", F.col("interval") * per) + 1).alias("buckets"))
    sums = present.groupBy(*S.KEYS, "category", interval(F.col("bucket")).alias("interval")).agg(F.sum("n").alias("total"), F.max("n").alias("peak"))
    names = sums.select(*S.KEYS, "category").distinct()
    rows = grid.join(names, S.KEYS).join(sums, [*S.KEYS, "interval", "category"], "left")
    mean: Column = F.round(F.coalesce("total", F.lit(0)) / F.col("buckets"), 6)
    return rows.select(*S.KEYS, (F.col("interval") * interval_s).alias("Interval_Start_s"), F.col("category").alias("Category"), mean.alias("Mean_Present"), F.coalesce("peak", F.lit(0)).cast("long").alias("Peak_Present"))
