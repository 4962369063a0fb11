"""Queries over the movement operators on the observations derived from events, and SQL for those
that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack import schema as S
from groundtrack.functions import geo
from groundtrack.jobs import observe
from groundtrack.operators import alignment, audit, clocksync, coverage, detections, georeference, identities, mining, movement, presence, stitch, strangers, views
from groundtrack.operators.components import cut
from groundtrack.sources import observations as obs_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query by its function's name; sql follows the common table expression obs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{obs_source.SQL.strip()}{',' if not sql.lstrip().upper().startswith('SELECT') else ''} {sql.strip()}"
        return f

    return add


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of one row group is one task, and an event gives some 45 rows: where the scan has fewer
    tasks than there are cores, the events are dealt first."""
    events, cores = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value"), spark.sparkContext.defaultParallelism
    return obs_source.from_events(events.repartition(cores, "event_id") if events.rdd.getNumPartitions() < cores else events)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).where("Class = 'person'")


def camera_number() -> Column:
    return F.substring("Camera", 4, 10).cast("long")


def six(c: Column | str) -> Column:
    return F.round(c, 6)


KEYS = ", ".join(S.KEYS)
TRACK = ", ".join(S.TRACK)

# ---------------------------------------------------------------- rows of detections


@query(f"""
v AS (SELECT DISTINCT {KEYS}, Camera, 10 * (CAST(substr(Camera, 4) AS BIGINT) + 1) AS fps FROM obs),
f AS (SELECT DISTINCT {KEYS}, Camera, ts_cs // 10 AS frame_idx FROM obs)
SELECT {KEYS}, Camera, frame_idx FROM f JOIN v USING ({KEYS}, Camera)
WHERE frame_idx % CAST(greatest(1, round_even(CAST(fps AS DOUBLE) / 4, 0)) AS BIGINT) = 0""")
def frame_thinning(spark, sf_dir):
    rows = observations(spark, sf_dir)
    videos = rows.select(*S.KEYS, "Camera").distinct().withColumn("fps", (camera_number() + 1) * 10)
    frames = rows.select(*S.KEYS, "Camera", F.floor(F.col("ts_cs") / 10).alias("frame_idx")).distinct()
    return detections.thinned(frames, videos, 4).select(*S.KEYS, "Camera", "frame_idx")


@query(f"""
b AS (SELECT *, max(CASE WHEN Detection_Conf >= 0.1 THEN Detection_Conf END) OVER (PARTITION BY {TRACK} ORDER BY ts_cs RANGE UNBOUNDED PRECEDING) AS best FROM obs
  WHERE Class IN ('person', 'bicycle', 'car'))
SELECT {TRACK}, Class, ts_cs, Detection_Conf FROM b WHERE Detection_Conf >= 0.1 AND best >= 0.35""")
def class_conf_filter(spark, sf_dir):
    return detections.two_level(detections.recorded(observations(spark, sf_dir))).select(*S.TRACK, "Class", "ts_cs", "Detection_Conf")


CLOCK = f"""
m AS (SELECT {KEYS}, Camera, max(Timestamp) AS top FROM obs GROUP BY ALL),
g AS (SELECT {KEYS}, Camera, unnest(range(0, CAST(floor(top / 600) AS BIGINT) + 1)) AS segment FROM m),
s AS (SELECT *, segment * 600.0 + 5 AS from_s, segment * 1000.0 - 20 AS start_s,
  lead(segment * 600.0 + 5) OVER (PARTITION BY {KEYS}, Camera ORDER BY segment) AS nxt FROM g)
SELECT {KEYS}, Camera, o.Track_ID + segment * 1000000 AS Track_ID, ts_cs, round(start_s + (Timestamp - from_s), 6) AS session_s
FROM obs o JOIN s USING ({KEYS}, Camera) WHERE (segment = 0 OR Timestamp >= from_s) AND (nxt IS NULL OR Timestamp < nxt)"""


@query(CLOCK)
def session_clock_asof(spark, sf_dir):
    rows = observations(spark, sf_dir)
    # recordings of ten minutes; of those before a camera's first row, only the last can hold for a row
    span = rows.groupBy(*S.KEYS, "Camera").agg(F.min("Timestamp").alias("low"), F.max("Timestamp").alias("top"))
    segments = span.select(*S.KEYS, "Camera", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("low") / 600) - 1).cast("long"), F.floor(F.col("top") / 600))).alias("segment"))
    segments = segments.withColumns({"from_s": F.col("segment") * 600.0 + 5, "start_s": F.col("segment") * 1000.0 - 20})
    out = detections.on_session_clock(rows.withColumn("video_s", F.col("Timestamp")), segments)
    return out.select(*S.TRACK, "ts_cs", six("session_s").alias("session_s"))


@query(f"""
x AS (SELECT {TRACK}, ts_cs, Foot_X - 20 AS x1, Foot_Y - 2 * (Foot_Y - Center_Y) AS y1, Foot_X + 20 AS x2, Foot_Y AS y2 FROM obs WHERE Class = 'person'),
c AS (SELECT a.site_id, a.session_id, a.Camera, a.ts_cs, a.Track_ID, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1)) AS s
  FROM x a JOIN x b ON a.site_id = b.site_id AND a.session_id = b.session_id AND a.Camera = b.Camera AND a.ts_cs = b.ts_cs AND a.Track_ID <> b.Track_ID)
SELECT {KEYS}, x.Camera, x.ts_cs, x.Track_ID, round(coalesce(max(s), 0), 9) AS covered FROM x LEFT JOIN c USING ({KEYS}, Camera, ts_cs, Track_ID) GROUP BY ALL""")
def box_overlap_filter(spark, sf_dir):
    boxes = people(spark, sf_dir).withColumns({"x1": F.col("Foot_X") - 20, "x2": F.col("Foot_X") + 20, "y2": F.col("Foot_Y"), "y1": F.col("Foot_Y") - views.height()})
    return detections.covered_share(boxes).select(*S.KEYS, "Camera", "ts_cs", "Track_ID", F.round("covered", 9).alias("covered"))


# ---------------------------------------------------------------- ground


def boxes_of(rows: DataFrame) -> DataFrame:
    """Boxes of 40 pixels' width, in videos named by their cameras, at ten frames a second."""
    frame = {"Video": F.col("Camera"), "frame_idx": F.floor(F.col("ts_cs") / 10), "video_s": F.col("Timestamp"), "score": F.col("Detection_Conf") - 0.1004}
    return rows.withColumns(frame | {"x1": F.col("Foot_X") - 20, "x2": F.col("Foot_X") + 20, "y2": F.col("Foot_Y"), "y1": F.col("Foot_Y") - views.height()}).drop("Detection_Conf", "Timestamp")


BOXES = f"""
bx AS (SELECT {TRACK}, Class, ts_cs, Timestamp AS video_s, Detection_Conf - CAST(0.1004 AS DOUBLE) AS score, Foot_X - 20 AS x1, Foot_X + 20 AS x2, Foot_Y AS y2, Foot_Y - 2 * (Foot_Y - Center_Y) AS y1 FROM obs)"""


@query(BOXES + f""",
pt AS (SELECT *, round_even((x1 + x2) / 2 * 10, 0) / 10 AS cx, round_even((y1 + y2) / 2 * 10, 0) / 10 AS cy, round_even(y2 * 10, 0) / 10 AS fy, round_even(score * 1000, 0) / 1000 AS c FROM bx),
tl AS (SELECT *, max(CASE WHEN c >= 0.1 THEN c END) OVER (PARTITION BY {TRACK} ORDER BY ts_cs RANGE UNBOUNDED PRECEDING) AS best FROM pt),
cm AS (SELECT * FROM (VALUES ('cam0', 'gate', 0, 0.0, 30.0), ('cam0', 'gate', 1, 100.0, 500.0), ('cam1', 'cam1', 0, 0.0, 12.5)) t(video, name, segment, from_s, start_s)),
sg AS (SELECT *, lead(from_s) OVER (PARTITION BY video ORDER BY segment) AS nxt FROM cm),
jn AS (SELECT tl.*, coalesce(name, Camera) AS named, coalesce(segment, 0) AS sgm, coalesce(start_s + (video_s - from_s), video_s) AS s
  FROM tl LEFT JOIN sg ON video = Camera AND (segment = 0 OR video_s >= from_s) AND (nxt IS NULL OR video_s < nxt) WHERE c >= 0.1 AND best >= 0.35)
SELECT {KEYS}, named AS Camera, Track_ID + sgm * 1000000 AS Track_ID, Class, round(CAST(s AS DOUBLE), 2) AS Timestamp, cx AS Center_X, cy AS Center_Y, cx AS Foot_X, fy AS Foot_Y, c AS Detection_Conf FROM jn""")
def boxes_to_observations(spark, sf_dir):
    """Boxes of three videos, one with two recordings, one that the camera map does not name."""
    cameras = spark.createDataFrame([("cam0", "gate", 0, 0.0, 30.0), ("cam0", "gate", 1, 100.0, 500.0), ("cam1", "cam1", 0, 0.0, 12.5)], "Video string, Camera string, segment long, from_s double, start_s double")
    return observe.observed(boxes_of(observations(spark, sf_dir)), cameras).drop("ts_cs", *observe.BOX)


CLEAR = BOXES + f""",
pb AS (SELECT *, Track_ID % 1000000 AS w FROM bx WHERE Class = 'person'),
st AS (SELECT *, CASE WHEN ts_cs - lag(ts_cs) OVER (PARTITION BY {KEYS}, Camera, w ORDER BY ts_cs) > 50 THEN 1 ELSE 0 END AS new FROM pb),
se AS (SELECT *, CAST(sum(new) OVER (PARTITION BY {KEYS}, Camera, w ORDER BY ts_cs ROWS UNBOUNDED PRECEDING) AS BIGINT) AS view_set FROM st),
cl AS (SELECT {KEYS}, Camera, w, view_set, ts_cs, y2 - y1 AS h FROM se a WHERE score + CAST(0.1004 AS DOUBLE) >= 0.35 AND x1 > 2 AND y1 > 2 AND x2 < 958 AND y2 < 1998),
co AS (SELECT DISTINCT a.site_id, a.session_id, a.Camera, a.w, a.ts_cs FROM pb a JOIN pb b ON a.site_id = b.site_id AND a.session_id = b.session_id AND a.Camera = b.Camera AND a.ts_cs = b.ts_cs AND a.w <> b.w
  WHERE greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) > greatest(1, (a.x2 - a.x1) * (a.y2 - a.y1)) * CAST(0.2 AS DOUBLE)),
ok AS (SELECT cl.* FROM cl ANTI JOIN co USING ({KEYS}, Camera, w, ts_cs))"""


def _walkers(spark, sf_dir) -> DataFrame:
    """Person boxes; a walker's track and the one found again after half a second are one track."""
    return boxes_of(people(spark, sf_dir)).withColumns({"Detection_Conf": F.col("score") + 0.1004, "Track_ID": F.col("Track_ID") % 1000000})


@query(CLEAR + f" SELECT {KEYS}, Camera, w AS Track_ID, ts_cs FROM ok")
def clear_views(spark, sf_dir):
    return detections.clear_views(_walkers(spark, sf_dir), 960.0, 2000.0).select(*S.TRACK, "ts_cs")


@query(
    CLEAR
    + f""",
nx AS (SELECT *, min(ts_cs) OVER (PARTITION BY {KEYS}, Camera, w, view_set ORDER BY ts_cs RANGE BETWEEN 20 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM ok),
ac AS (SELECT {KEYS}, Camera, w, view_set, min(ts_cs) AS ts_cs FROM ok GROUP BY ALL
  UNION ALL SELECT n.site_id, n.session_id, n.Camera, n.w, n.view_set, n.nxt FROM ac JOIN nx n USING ({KEYS}, Camera, w, view_set, ts_cs) WHERE n.nxt IS NOT NULL),
nt AS (SELECT ac.*, h, ntile(4) OVER (PARTITION BY {KEYS}, Camera, w, view_set ORDER BY ts_cs) AS stretch FROM ac JOIN ok USING ({KEYS}, Camera, w, view_set, ts_cs)),
rk AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, Camera, w, view_set, stretch ORDER BY h DESC, ts_cs) AS nth FROM nt)
SELECT {KEYS}, Camera, w AS Track_ID, view_set, CAST(stretch AS INTEGER) AS stretch, ts_cs, h AS Height_Px FROM rk WHERE nth = 1""",
    recursive=True,
)
def fingerprint_views(spark, sf_dir):
    """Views for fingerprints: clear boxes 0.2 s apart, the tallest of four stretches of each set."""
    return views.fingerprint_views(_walkers(spark, sf_dir), 960.0, 2000.0, 4, 0.5)


@query(f" SELECT {TRACK}, ts_cs FROM obs WHERE ts_cs // 10 < 3000")
def first_frames(spark, sf_dir):
    """Rows of the first 3,000 frames of each camera."""
    return detections.first_frames(boxes_of(observations(spark, sf_dir)), 3000).select(*S.TRACK, "ts_cs")


def camera_table(spark, sf_dir) -> DataFrame:
    """A calibration of each camera: a tilted view whose numbers follow from the camera's."""
    n = camera_number()
    cams = observations(spark, sf_dir).select("site_id", "Camera").distinct()
    h = F.array(F.lit(0.05), n * 0.01, n * 2.0 - 20.0, n * -0.004, F.lit(0.06), n * 1.5 - 15.0, F.lit(0.00005), n * 0.0001 - 0.0009, F.lit(1.0))
    return cams.withColumns({"H": h, "pix_sign": F.lit(1.0), "mode": F.when(n == 2, "local").otherwise("global"), "utm_epsg": F.lit(32616), "origin": F.array(F.lit(500000.0), F.lit(4470000.0))})


GEO = """
h AS (SELECT DISTINCT site_id, Camera, CAST(substr(Camera, 4) AS BIGINT) AS n FROM obs),
p AS (SELECT o.*, (0.05 * Foot_X + n * CAST(0.01 AS DOUBLE) * Foot_Y + (n * CAST(2 AS DOUBLE) - 20)) AS px, (n * CAST(-0.004 AS DOUBLE) * Foot_X + CAST(0.06 AS DOUBLE) * Foot_Y + (n * CAST(1.5 AS DOUBLE) - 15)) AS py,
  (CAST(0.00005 AS DOUBLE) * Foot_X + (n * CAST(0.0001 AS DOUBLE) - CAST(0.0009 AS DOUBLE)) * Foot_Y + 1) AS s FROM obs o JOIN h USING (site_id, Camera)),
q AS (SELECT *, CASE WHEN s > 0 THEN round_even(px / s * 100, 0) / 100 END AS X, CASE WHEN s > 0 THEN round_even(py / s * 100, 0) / 100 END AS Y FROM p)"""


@query(GEO + f" SELECT {TRACK}, ts_cs, X AS Local_X_Meters, Y AS Local_Y_Meters, NOT s > 0 AS Beyond_Horizon FROM q")
def georeferenced_positions(spark, sf_dir):
    rows = observations(spark, sf_dir).drop("Local_X_Meters", "Local_Y_Meters")
    out = georeference.georeferenced(rows, camera_table(spark, sf_dir))
    return out.select(*S.TRACK, "ts_cs", "Local_X_Meters", "Local_Y_Meters", "Beyond_Horizon")


@query(GEO + f" SELECT {KEYS}, Camera, count(*) AS n_rows, count(*) FILTER (Foot_X IS NULL) AS n_no_pixel, count(*) FILTER (NOT s > 0) AS n_beyond_horizon, count(*) FILTER (X IS NULL) AS n_no_position FROM q GROUP BY ALL")
def horizon_report(spark, sf_dir):
    rows = observations(spark, sf_dir).drop("Local_X_Meters", "Local_Y_Meters")
    return georeference.position_report(georeference.georeferenced(rows, camera_table(spark, sf_dir)))


# fixed values: of the Krüger series for WGS84, the scaled radius, the eccentricity and four coefficients
KRUEGER = (6364902.166165086, 0.0818191908426215, 8.377318206244698e-4, 7.608527773572307e-7, 1.197645503329453e-9, 2.429170607201359e-12)


def _series(outer: str, inner: str) -> str:
    return " + ".join(f"{a!r}::DOUBLE * {outer}({2 * k} * xi) * {inner}({2 * k} * eta)" for k, a in enumerate(KRUEGER[2:], 1))


@query(f"""
pt AS (SELECT event_id, CAST(user_id * 37 % 360 - 180 AS DOUBLE) + 0.25 AS lon, CAST(event_id * 13 % 160 - 80 AS DOUBLE) + 0.5 AS lat FROM events),
zn AS (SELECT *, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS z, sin(radians(lat)) AS s FROM pt),
cf AS (SELECT *, sinh(atanh(s) - {KRUEGER[1]!r}::DOUBLE * atanh({KRUEGER[1]!r}::DOUBLE * s)) AS t, radians(lon - (z * 6 - 183)) AS dl FROM zn),
xe AS (SELECT *, atan2(t, cos(dl)) AS xi, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) AS eta FROM cf)
SELECT event_id, CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + z AS zone, round(500000 + {KRUEGER[0]!r}::DOUBLE * (eta + {_series("cos", "sinh")}), 2) AS east,
  round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + {KRUEGER[0]!r}::DOUBLE * (xi + {_series("sin", "cosh")}), 2) AS north, lon, lat FROM xe""")
def utm_roundtrip(spark, sf_dir):
    """Each event's point in its zone, and back again from there."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ((F.col("user_id") * 37 % 360) - 180 + 0.25).alias("lon"), ((F.col("event_id") * 13 % 160) - 80 + 0.5).alias("lat"))
    zone = geo.zone_of(F.col("lon"), F.col("lat"))
    east, north = geo.to_utm(F.col("lon"), F.col("lat"), zone)
    e = e.select("event_id", zone.alias("zone"), east.alias("east"), north.alias("north"))
    lon, lat = geo.to_lonlat(F.col("east"), F.col("north"), F.col("zone"))
    return e.select("event_id", "zone", F.round("east", 2).alias("east"), F.round("north", 2).alias("north"), six(lon).alias("lon"), six(lat).alias("lat"))


def _samples(rows: DataFrame) -> DataFrame:
    """Matrices of a camera's drift every two seconds of its busy time, some of them not trusted."""
    at = rows.select(*S.KEYS, "Camera", (F.floor(F.col("ts_cs") / 200) * 200 + 5).alias("ts_cs")).distinct()
    k = F.floor(F.col("ts_cs") / 200)
    drift = F.array(F.lit(1.0), F.lit(0.0), (k % 7).cast("double"), F.lit(0.0), F.lit(1.0), (k % 5).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return at.withColumn("H", F.when(k % 3 != 1, drift))


ALIGN = f"""
a AS (SELECT DISTINCT {KEYS}, Camera, (ts_cs // 200) * 200 + 5 AS t, ts_cs // 200 AS k FROM obs),
m AS (SELECT {KEYS}, Camera, t, CAST(k % 7 AS DOUBLE) AS dx, CAST(k % 5 AS DOUBLE) AS dy FROM a WHERE k % 3 <> 1),
o AS (SELECT {TRACK}, ts_cs, Foot_X, Foot_Y, ts_cs - 1 AS before FROM obs)"""

BLEND = f""",
l AS (SELECT o.*, m.t AS ta, m.dx AS xa, m.dy AS ya FROM o ASOF LEFT JOIN m ON o.site_id = m.site_id AND o.session_id = m.session_id AND o.Camera = m.Camera AND o.before >= m.t),
r AS (SELECT l.*, m.t AS tb, m.dx AS xb, m.dy AS yb FROM l ASOF LEFT JOIN m ON l.site_id = m.site_id AND l.session_id = m.session_id AND l.Camera = m.Camera AND l.ts_cs <= m.t),
w AS (SELECT *, ts_cs - ta AS da, tb - ts_cs AS db, (ts_cs - ta) / (tb - ta) AS share,
  CASE WHEN ta IS NULL THEN CASE WHEN tb - ts_cs <= 300 THEN 'b' END WHEN tb IS NULL THEN CASE WHEN ts_cs - ta <= 300 THEN 'a' END
    WHEN tb - ta <= 600 THEN CASE WHEN least(ts_cs - ta, tb - ts_cs) <= 300 THEN 'm' END
    WHEN ts_cs - ta <= tb - ts_cs THEN CASE WHEN ts_cs - ta <= 300 THEN 'a' END ELSE CASE WHEN tb - ts_cs <= 300 THEN 'b' END END AS how FROM r)
SELECT {TRACK}, ts_cs, round(CASE how WHEN 'a' THEN xa WHEN 'b' THEN xb WHEN 'm' THEN xa + (xb - xa) * share END, 6) AS dx,
  round(CASE how WHEN 'a' THEN ya WHEN 'b' THEN yb WHEN 'm' THEN ya + (yb - ya) * share END, 6) AS dy FROM w"""

REFERENCE = f""",
c AS (SELECT {KEYS}, Camera, median(dx) AS mx, median(dy) AS my FROM m GROUP BY ALL),
d AS (SELECT m.*, sqrt((dx - mx) * (dx - mx) + (dy - my) * (dy - my)) AS d FROM m JOIN c USING ({KEYS}, Camera)),
f AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, Camera ORDER BY d, t) AS nth FROM d)
SELECT {KEYS}, m.Camera, any_value(f.t) AS reference_cs, round(median(sqrt((m.dx - f.dx) * (m.dx - f.dx) + (m.dy - f.dy) * (m.dy - f.dy))), 6) AS median_shift,
  round(max(sqrt((m.dx - f.dx) * (m.dx - f.dx) + (m.dy - f.dy) * (m.dy - f.dy))), 6) AS max_shift, count(*) AS n_samples
FROM m JOIN f USING ({KEYS}, Camera) WHERE f.nth = 1 GROUP BY ALL"""


@query(ALIGN + BLEND)
def alignment_asof_blend(spark, sf_dir):
    rows = observations(spark, sf_dir)
    out = alignment.bracketed(rows, _samples(rows))
    return out.select(*S.TRACK, "ts_cs", six(F.col("H")[2]).alias("dx"), six(F.col("H")[5]).alias("dy"))


@query(ALIGN + REFERENCE)
def alignment_reference(spark, sf_dir):
    out = alignment.reference_frames(_samples(observations(spark, sf_dir)), 960.0, 540.0)
    return out.select(*S.KEYS, "Camera", "reference_cs", six("median_shift").alias("median_shift"), six("max_shift").alias("max_shift"), "n_samples")


@query()
def calibration_fit(spark, sf_dir):
    """Homography, report and hull of each camera from ten of its own sightings as points."""
    out = georeference.calibrated(_points(spark, sf_dir))
    return out.select("site_id", "Camera", "n_points", F.round("residual_mean", 3).alias("residual_mean"), F.round("loo_median", 3).alias("loo_median"), F.size("suspects").alias("n_suspects"), F.size("planes").alias("n_planes"))


def _points(spark, sf_dir) -> DataFrame:
    """Each camera's first sighting in each ninth of its picture, projected by its table's matrix."""
    rows = georeference.georeferenced(observations(spark, sf_dir).drop("Local_X_Meters", "Local_Y_Meters"), camera_table(spark, sf_dir)).where("Local_X_Meters is not null")
    part = F.concat(F.floor(F.col("Foot_X") / 400), F.lit(":"), F.floor((F.col("Foot_Y") - 500) / 120))
    first = rows.groupBy("site_id", "Camera", part.alias("part")).agg(F.min(F.struct("ts_cs", "Track_ID", "Foot_X", "Foot_Y", "Local_X_Meters", "Local_Y_Meters")).alias("r"))
    return first.select("site_id", "Camera", F.xxhash64("part").alias("idx"), F.col("r.Foot_X").alias("px"), F.col("r.Foot_Y").alias("py"), F.col("r.Local_X_Meters").alias("gx"), F.col("r.Local_Y_Meters").alias("gy"))


@query()
def calibration_too_loose(spark, sf_dir):
    """Cameras in use whose fit is too loose for hand-off by position, at half a centimetre here."""
    cams = observations(spark, sf_dir).select("site_id", "Camera").distinct()
    return georeference.too_loose(georeference.calibrated(_points(spark, sf_dir)), cams, 0.005).select("site_id", "Camera", F.round("loo_median", 4).alias("loo_median"))


@query("""
c AS (SELECT DISTINCT site_id, Camera, CAST(substr(Camera, 4) AS BIGINT) AS n FROM obs)
SELECT site_id, Camera, CAST(DATE '2026-01-01' - (DATE '2025-01-01' + CAST(n * 150 AS INTEGER)) AS BIGINT) AS age_days, (DATE '2026-01-01' - (DATE '2025-01-01' + CAST(n * 150 AS INTEGER))) > 180 AS stale FROM c""")
def calibration_stale(spark, sf_dir):
    registry = camera_table(spark, sf_dir).withColumn("last_calibrated", F.date_add(F.lit("2025-01-01").cast("date"), (camera_number() * 150).cast("int")))
    return georeference.stale(registry, F.lit("2026-01-01").cast("date")).select("site_id", "Camera", F.col("age_days").cast("long").alias("age_days"), "stale")


@query("""
c AS (SELECT DISTINCT site_id, Camera FROM obs)
SELECT site_id, Camera FROM c WHERE Camera <> 'cam1'""")
def uncalibrated_cameras(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return georeference.uncalibrated(rows, rows.where("Camera = 'cam1'").select("site_id", "Camera").distinct())


@query("""
c AS (SELECT DISTINCT site_id, Camera FROM obs)
SELECT site_id, Camera, CASE WHEN Camera = 'cam0' THEN 'local' WHEN Camera = 'cam2' THEN 'local' ELSE 'global' END AS mode,
  500000.0 AS east FROM c WHERE Camera IN ('cam0', 'cam1', 'cam2')""")
def registry_upsert(spark, sf_dir):
    old = camera_table(spark, sf_dir)
    new = old.where("Camera = 'cam0'").withColumn("mode", F.lit("local")).withColumn("origin", F.array(F.lit(1.0), F.lit(2.0)))
    return georeference.upsert(old, new).select("site_id", "Camera", "mode", F.col("origin")[0].alias("east"))


@query("""
q AS (SELECT event_id, CAST(3 + event_id % 5 AS DOUBLE) AS ab, CAST(4 + event_id % 3 AS DOUBLE) AS bc, CAST(5 + event_id % 2 AS DOUBLE) AS cd, CAST(4 + event_id % 4 AS DOUBLE) AS da, CAST(6 + event_id % 2 AS DOUBLE) AS ac FROM events),
a AS (SELECT *, acos(least(1, greatest(-1, (ab * ab + ac * ac - bc * bc) / (2 * ab * ac)))) AS b, acos(least(1, greatest(-1, (da * da + ac * ac - cd * cd) / (2 * da * ac)))) AS d FROM q)
SELECT event_id, round(ab * cos(b), 6) AS bx, round(-(ab * sin(b)), 6) + 0 AS by, round(ac, 6) AS cx, round(da * cos(d), 6) AS dx, round(da * sin(d), 6) AS dy FROM a""")
def four_point_frames(spark, sf_dir):
    i = F.col("event_id")
    sides = [(i % m + c).cast("double") for m, c in ((5, 3), (3, 4), (2, 5), (4, 4), (2, 6))]
    (_, _), (bx, by), (cx, _), (dx, dy) = geo.four_points(*sides)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", six(bx).alias("bx"), (six(by) + 0).alias("by"), six(cx).alias("cx"), six(dx).alias("dx"), six(dy).alias("dy"))


# ---------------------------------------------------------------- views and candidates


@query(f"""
g AS (SELECT {TRACK}, ts_cs, CASE WHEN ts_cs - lag(ts_cs) OVER (PARTITION BY {KEYS}, Camera, w ORDER BY ts_cs) > 50 THEN 1 ELSE 0 END AS new, w FROM
  (SELECT *, Track_ID % 1000000 AS w FROM obs WHERE Class = 'person'))
SELECT {KEYS}, Camera, w AS Track_ID, ts_cs, CAST(sum(new) OVER (PARTITION BY {KEYS}, Camera, w ORDER BY ts_cs ROWS UNBOUNDED PRECEDING) AS BIGINT) AS view_set FROM g""")
def view_sessions(spark, sf_dir):
    """A walker's track and the one found again after half a second, as one track with a gap."""
    rows = people(spark, sf_dir).withColumn("Track_ID", F.col("Track_ID") % 1000000)
    return views.view_sets(rows, 0.5).select(*S.TRACK, "ts_cs", "view_set")


@query(f"""
v AS (SELECT {TRACK}, ts_cs, 2 * (Foot_Y - Center_Y) + (ts_cs * 7) % 11 AS h, ntile(5) OVER (PARTITION BY {TRACK} ORDER BY ts_cs) AS stretch FROM obs WHERE Class = 'person'),
r AS (SELECT *, row_number() OVER (PARTITION BY {TRACK}, stretch ORDER BY h DESC, ts_cs) AS nth FROM v)
SELECT {TRACK}, CAST(stretch AS INTEGER) AS stretch, ts_cs, h AS Height_Px FROM r WHERE nth = 1""")
def view_selection(spark, sf_dir):
    rows = people(spark, sf_dir).withColumn("Height_Px", views.height() + F.col("ts_cs") * 7 % 11)
    return views.tallest_of_stretches(rows).select(*S.TRACK, "stretch", "ts_cs", "Height_Px")


@query(f"""
k AS (SELECT {TRACK}, ts_cs, row_number() OVER (PARTITION BY {TRACK} ORDER BY ts_cs) AS nth FROM obs WHERE Class = 'person')
SELECT {TRACK}, CAST(0 AS BIGINT) AS view_set, ts_cs FROM k WHERE nth % 2 = 1""")
def view_spacing(spark, sf_dir):
    """Views 0.2 s apart: every other row of these tracks, whose rows are 0.1 s apart."""
    return views.spaced_views(views.view_sets(people(spark, sf_dir)).select(*S.TRACK, "ts_cs", "view_set")).select(*S.TRACK, "view_set", "ts_cs")


CANDIDATES = f"""
c AS (SELECT {TRACK}, count(*) AS n_rows, min(ts_cs) AS t0, max(ts_cs) AS t1, arg_min(Local_X_Meters, ts_cs) AS x0, arg_min(Local_Y_Meters, ts_cs) AS y0,
  arg_max(Local_X_Meters, ts_cs) AS x1, arg_max(Local_Y_Meters, ts_cs) AS y1 FROM obs WHERE Class = 'person' GROUP BY ALL),
f AS (SELECT {TRACK}, median(2 * (Foot_Y - Center_Y)) AS first_heights FROM (SELECT *, row_number() OVER (PARTITION BY {TRACK} ORDER BY ts_cs) AS nth FROM obs WHERE Class = 'person') WHERE nth <= 5 GROUP BY ALL)"""


@query(CANDIDATES + f" SELECT {TRACK}, n_rows, first_heights, t0, x0, y0, t1, x1, y1 FROM c JOIN f USING ({TRACK})")
def track_candidates(spark, sf_dir):
    return views.candidates(people(spark, sf_dir))


def fingerprints(spark, sf_dir) -> DataFrame:
    """Vectors as views of tracks, five to a track, at the track's first frames."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 5).alias("Track_ID"), (F.col("vec_id") % 5).alias("k"), F.col("embedding").alias("Vector"))
    tracks = people(spark, sf_dir).groupBy(*S.TRACK).agg(F.min("ts_cs").alias("t0"))
    return v.join(tracks, "Track_ID").select(*S.TRACK, (F.col("t0") + F.col("k") * 10).alias("ts_cs"), (50.0 + F.col("Track_ID") * 7 % 40 + F.col("k")).alias("Height_Px"), "Vector")


def fingerprints_of_all(spark, sf_dir) -> DataFrame:
    """Views of every track: sets of five vectors, dealt over the tracks by their ids."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 5).alias("set"), (F.col("vec_id") % 5).alias("k"), F.col("embedding").alias("Vector"))
    sets = max(1, v.agg(F.max("set") + 1).first()[0] or 0)
    tracks = people(spark, sf_dir).groupBy(*S.TRACK).agg(F.min("ts_cs").alias("t0")).withColumn("set", F.pmod("Track_ID", F.lit(sets)))
    return tracks.join(v, "set").select(*S.TRACK, (F.col("t0") + F.col("k") * 10).alias("ts_cs"), (50.0 + F.col("Track_ID") * 7 % 40 + F.col("k")).alias("Height_Px"), "Vector")


@query("""
v AS (SELECT vec_id // 5 AS t, embedding AS e FROM embeddings)
SELECT a.t AS a, b.t AS b, round(max(list_dot_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[]))), 6) AS similarity FROM v a JOIN v b ON b.t BETWEEN a.t + 1 AND a.t + 3 GROUP BY ALL""")
def set_similarity(spark, sf_dir):
    """Each set of five vectors against the three sets that follow it."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.floor(F.col("vec_id") / 5).alias("a")).agg(F.collect_list("embedding").alias("views_a"))
    near = v.withColumn("b", F.explode(F.array(F.col("a") + 1, F.col("a") + 2, F.col("a") + 3)))
    pairs = near.join(v.select(F.col("a").alias("b"), F.col("views_a").alias("views_b")), "b")
    return views.set_similarity(pairs).select("a", "b", six("similarity").alias("similarity"))


# ---------------------------------------------------------------- strangers


STRANGERS = f"""
r AS (SELECT {KEYS}, Camera, ts_cs, Track_ID AS t, Foot_X AS x, Foot_Y AS y, 2 * (Foot_Y - Center_Y) AS h FROM obs WHERE Class = 'person'),
sp AS (SELECT {KEYS}, Camera, t, min(ts_cs) AS t0 FROM r GROUP BY ALL),
pr AS (SELECT {KEYS}, Camera, a.t AS a, b.t AS b, count(*) AS n_frames, median(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / greatest(a.h, b.h)) AS apart
  FROM r a JOIN r b USING ({KEYS}, Camera, ts_cs) WHERE a.t < b.t GROUP BY ALL),
st AS (SELECT pr.*, greatest(u.t0, v.t0) AS moment_cs FROM pr JOIN sp u ON u.site_id = pr.site_id AND u.session_id = pr.session_id AND u.Camera = pr.Camera AND u.t = a
  JOIN sp v ON v.site_id = pr.site_id AND v.session_id = pr.session_id AND v.Camera = pr.Camera AND v.t = b WHERE n_frames >= 5 AND apart >= 1)"""


@query(STRANGERS + f" SELECT {KEYS}, Camera, a, b, n_frames, round(apart, 6) AS apart, moment_cs FROM st")
def stranger_pairs(spark, sf_dir):
    return strangers.stranger_pairs(people(spark, sf_dir)).withColumn("apart", six("apart"))


def _stranger_scores(spark, sf_dir) -> DataFrame:
    pairs = strangers.stranger_pairs(people(spark, sf_dir))
    v = fingerprints(spark, sf_dir).groupBy(*S.TRACK).agg(F.collect_list("Vector").alias("exemplars"))
    return strangers.stranger_scores(pairs, v)


SCORES = (
    STRANGERS
    + f""",
ve AS (SELECT vec_id // 5 AS t, embedding AS e FROM embeddings),
sc AS (SELECT {KEYS}, Camera, a, b, moment_cs, max(list_dot_product(CAST(x.e AS DOUBLE[]), CAST(y.e AS DOUBLE[]))) AS similarity FROM st JOIN ve x ON x.t = a JOIN ve y ON y.t = b GROUP BY ALL)"""
)


@query(SCORES + f" SELECT {KEYS}, Camera, a, b, round(similarity, 6) AS similarity FROM sc")
def stranger_scores(spark, sf_dir):
    return _stranger_scores(spark, sf_dir).select(*S.KEYS, "Camera", "a", "b", six("similarity").alias("similarity"))


@query(
    SCORES
    + f"""
SELECT {KEYS}, moment_cs // 6000 AS block, count(*) AS n, round(quantile_cont(similarity, 0.99), 4) AS bar FROM sc GROUP BY ALL HAVING count(*) >= 3
UNION ALL SELECT {KEYS}, -1, count(*), round(quantile_cont(similarity, 0.99), 4) FROM sc GROUP BY ALL"""
)
def similarity_bars(spark, sf_dir):
    run, blocks = strangers.bars(_stranger_scores(spark, sf_dir), block_s=60, least=3)
    return blocks.select(*S.KEYS, "block", "n", "bar").unionByName(run.select(*S.KEYS, F.lit(-1).cast("long").alias("block"), "n", F.round("bar", 4).alias("bar")))


# ---------------------------------------------------------------- identities


def tracks_of(spark, sf_dir) -> DataFrame:
    """People's tracks, each an identity of its own: numbered by entry, camera and track."""
    w = Window.partitionBy(*S.KEYS).orderBy("t0", "Camera", "Track_ID")
    ends = cut(people(spark, sf_dir).where("Local_X_Meters is not null").groupBy(*S.TRACK[::-1]).agg(F.min("ts_cs").alias("t0"), F.max("ts_cs").alias("t1")))
    return ends.select(*S.TRACK, "t0", "t1").withColumns({"gid": F.row_number().over(w).cast("long"), "Confidence": F.lit(None).cast("double")})


def means_of(spark, sf_dir) -> DataFrame:
    """Bucket means, which several joins read, made once."""
    return cut(identities.bucket_means(people(spark, sf_dir)))


EDGES = f"""
l AS (SELECT *, max(ts_cs) OVER (PARTITION BY {TRACK}) AS top FROM obs WHERE Class = 'person'),
tl AS (SELECT {TRACK}, ts_cs, Local_X_Meters AS x, Local_Y_Meters AS y, row_number() OVER (PARTITION BY {TRACK} ORDER BY ts_cs) AS i, count(*) OVER (PARTITION BY {TRACK}) AS n FROM l WHERE top - ts_cs <= 100),
vv AS (SELECT {TRACK}, max(ts_cs) - min(ts_cs) AS span, (avg(CASE WHEN i > n - greatest(1, n // 5) THEN ts_cs END) - avg(CASE WHEN i <= greatest(1, n // 5) THEN ts_cs END)) / 100 AS dt,
  avg(CASE WHEN i > n - greatest(1, n // 5) THEN x END) - avg(CASE WHEN i <= greatest(1, n // 5) THEN x END) AS dx, avg(CASE WHEN i > n - greatest(1, n // 5) THEN y END) - avg(CASE WHEN i <= greatest(1, n // 5) THEN y END) AS dy FROM tl GROUP BY ALL),
en AS (SELECT {TRACK}, min(ts_cs) AS t0, max(ts_cs) AS t1, arg_min(Local_X_Meters, ts_cs) AS x0, arg_min(Local_Y_Meters, ts_cs) AS y0, arg_max(Local_X_Meters, ts_cs) AS x1, arg_max(Local_Y_Meters, ts_cs) AS y1 FROM l GROUP BY ALL),
e AS (SELECT en.*, CASE WHEN span >= 25 THEN dx / dt END AS vx, CASE WHEN span >= 25 THEN dy / dt END AS vy FROM en JOIN vv USING ({TRACK})),
j AS (SELECT {KEYS}, Camera, a.Track_ID AS a, b.Track_ID AS b, a.t1 AS t1, b.t0 AS t0, a.vx, sqrt((b.x0 - (a.x1 + coalesce(a.vx * (b.t0 - a.t1) / 100, 0))) ** 2 + (b.y0 - (a.y1 + coalesce(a.vy * (b.t0 - a.t1) / 100, 0))) ** 2) AS error
  FROM e a JOIN e b USING ({KEYS}, Camera) WHERE b.t0 > a.t1 AND b.t0 - a.t1 <= 100 AND a.Track_ID <> b.Track_ID)"""


@query(EDGES + f" SELECT {KEYS}, Camera, a, b, round(error, 6) AS error FROM j WHERE error <= 1 + CASE WHEN vx IS NULL THEN 3.0 ELSE 1.5 END * (t0 - t1) / 100")
def stitch_edges(spark, sf_dir):
    edges = stitch.stitch_edges(stitch.track_ends(people(spark, sf_dir)))
    return edges.select(*S.KEYS, "Camera", "a", "b", six("error").alias("error"))


@query()
def stitched_identities(spark, sf_dir):
    tracks = tracks_of(spark, sf_dir)
    out = identities.stitched(tracks, stitch.matched(stitch.stitch_edges(cut(stitch.track_ends(people(spark, sf_dir))))))
    return out.select(*S.TRACK, "gid", "moved")


MEANS = f"""
bm AS (SELECT {TRACK}, CAST(round_even(CAST(ts_cs AS DOUBLE) / 50, 0) AS BIGINT) AS bucket, avg(Local_X_Meters) AS x, avg(Local_Y_Meters) AS y FROM obs WHERE Class = 'person' GROUP BY ALL)"""


@query(
    MEANS
    + f"""
SELECT {KEYS}, a.Camera AS camera_a, a.Track_ID AS a, b.Camera AS camera_b, b.Track_ID AS b, count(*) AS n, round(median(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS d
FROM bm a JOIN bm b USING ({KEYS}, bucket) WHERE a.Camera < b.Camera GROUP BY ALL HAVING count(*) >= 4 AND median(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) <= 1.5"""
)
def cosighting_pairs(spark, sf_dir):
    return identities.cosighted(means_of(spark, sf_dir)).withColumn("d", six("d"))


@query()
def handoff_identities(spark, sf_dir):
    pairs = identities.cosighted(means_of(spark, sf_dir))
    return identities.handed_off(tracks_of(spark, sf_dir), pairs).select(*S.TRACK, "gid", "moved")


def _doubted(spark, sf_dir) -> DataFrame:
    """Tracks whose identities, ten events to each, are in several places at once."""
    tracks = tracks_of(spark, sf_dir)
    return tracks.withColumns({"gid": F.floor(F.col("Track_ID") % 1000000 / 10) + 1, "Confidence": (F.col("Track_ID") % 7 / 10).cast("double")})


@query(
    MEANS
    + f""",
gm AS (SELECT *, (Track_ID % 1000000) // 10 + 1 AS gid FROM bm)
SELECT {KEYS}, gid, a.Camera AS camera_a, a.Track_ID AS a, b.Camera AS camera_b, b.Track_ID AS b, count(*) AS n, min(bucket) AS bucket, round(median(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS d
FROM gm a JOIN gm b USING ({KEYS}, gid, bucket) WHERE a.Camera < b.Camera GROUP BY ALL HAVING median(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) > 5"""
)
def conflict_pairs(spark, sf_dir):
    return identities.conflict_pairs(identities.bucket_means(people(spark, sf_dir)), _doubted(spark, sf_dir)).withColumn("d", six("d"))


@query()
def settled_identities(spark, sf_dir):
    out = identities.settled(cut(_doubted(spark, sf_dir)), means_of(spark, sf_dir))
    return out.select(*S.TRACK, "gid", "Confidence")


@query()
def gallery_identities(spark, sf_dir):
    """Every track through the gallery; those without a tall view get numbers of their own."""
    tracks = cut(views.candidates(people(spark, sf_dir), fingerprints_of_all(spark, sf_dir)))
    out = identities.gallery_identities(tracks.withColumn("threshold", F.lit(S.FALLBACK_BAR)))
    return out.select(*S.TRACK, identities.gid_name(F.col("gid")).alias("Global_ID"), "Confidence")


# ---------------------------------------------------------------- movement

VELOCITY = """
mv AS (SELECT *, first_value(ts_cs) OVER w AS tt, first_value(Local_X_Meters) OVER w AS xx, first_value(Local_Y_Meters) OVER w AS yy, min(ts_cs) OVER (PARTITION BY site_id, session_id, Camera, kd, Track_ID) AS begin
  FROM (SELECT *, Class = 'person' AS kd FROM obs WHERE Class IN ('person', 'bicycle')) WINDOW w AS (PARTITION BY site_id, session_id, Camera, kd, Track_ID ORDER BY ts_cs RANGE BETWEEN 100 PRECEDING AND CURRENT ROW)),
mw AS (SELECT *, (tt - greatest(ts_cs - 100, begin) <= 50 AND ts_cs - tt >= 25) AS ok FROM mv),
ve AS (SELECT *, CASE WHEN ok THEN (Local_X_Meters - xx) / ((ts_cs - tt) / 100) END AS vx, CASE WHEN ok THEN (Local_Y_Meters - yy) / ((ts_cs - tt) / 100) END AS vy FROM mw)"""


@query(VELOCITY + f" SELECT {TRACK}, ts_cs, round(vx, 6) + 0 AS vx, round(vy, 6) + 0 AS vy FROM ve WHERE Class = 'person'")
def recent_velocity(spark, sf_dir):
    return movement.recent_velocity(people(spark, sf_dir)).select(*S.TRACK, "ts_cs", (six("vx") + 0).alias("vx"), (six("vy") + 0).alias("vy"))


RIDES = (
    VELOCITY
    + f""",
nr AS (SELECT {KEYS}, Camera, ts_cs, p.Track_ID AS p, r.Track_ID AS r, r.Class AS rc, sqrt((p.Local_X_Meters - r.Local_X_Meters) ** 2 + (p.Local_Y_Meters - r.Local_Y_Meters) ** 2) AS d,
  (sqrt(p.vx ** 2 + p.vy ** 2) >= 0.5 AND sqrt(r.vx ** 2 + r.vy ** 2) >= 0.5 AND sqrt((p.vx - r.vx) ** 2 + (p.vy - r.vy) ** 2) <= 1) AS tg
  FROM ve p JOIN ve r USING ({KEYS}, Camera, ts_cs) WHERE p.Class = 'person' AND r.Class = 'bicycle' AND sqrt((p.Local_X_Meters - r.Local_X_Meters) ** 2 + (p.Local_Y_Meters - r.Local_Y_Meters) ** 2) <= 2),
rp AS (SELECT {KEYS}, Camera, p, r FROM nr WHERE tg GROUP BY ALL HAVING max(ts_cs) - min(ts_cs) >= 50)"""
)
MODES = (
    RIDES
    + f""",
rd AS (SELECT {KEYS}, Camera, ts_cs, p, arg_min(rc, struct_pack(d := d, r := r)) AS rc FROM nr JOIN rp USING ({KEYS}, Camera, p, r) GROUP BY ALL)"""
)


@query(MODES + f" SELECT o.site_id, o.session_id, o.Camera, o.Track_ID, o.Class, o.ts_cs, CASE WHEN o.Class = 'person' THEN coalesce(rc, 'on foot') END AS Mode FROM obs o LEFT JOIN rd ON o.site_id = rd.site_id AND o.session_id = rd.session_id AND o.Camera = rd.Camera AND o.ts_cs = rd.ts_cs AND o.Track_ID = rd.p AND o.Class = 'person'")
def travel_mode(spark, sf_dir):
    return movement.travel_mode(observations(spark, sf_dir)).select(*S.TRACK, "Class", "ts_cs", "Mode")


@query(
    RIDES
    + f""",
rr AS MATERIALIZED (SELECT DISTINCT {KEYS}, Camera, r AS Track_ID, true AS ridden FROM rp),
fast AS MATERIALIZED (SELECT {TRACK}, ts_cs FROM ve WHERE Class = 'bicycle' AND sqrt(vx ** 2 + vy ** 2) >= 0.5)
SELECT {TRACK}, ts_cs FROM fast LEFT JOIN rr USING ({KEYS}, Camera, Track_ID) WHERE ridden IS NULL"""
)
def riderless_rows(spark, sf_dir):
    return movement.riderless(observations(spark, sf_dir)).select(*S.TRACK, "ts_cs")


# ---------------------------------------------------------------- presence


def hulls(spark, sf_dir) -> DataFrame:
    """A calibrated area of each camera but the first: a slanted band of its picture."""
    cams = observations(spark, sf_dir).select(*S.KEYS, "Camera").distinct().where("Camera <> 'cam0'")
    plane = lambda a, b, c: F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(c)).alias("c"))
    return cams.withColumn("planes", F.array(plane(1, 0, -100), plane(-1, 0.5, 500), plane(0, 1, -520), plane(0, -1, 760)))


PRECISE = """
pc AS (SELECT *, greatest(0, 2 * (Foot_Y - Center_Y)) * CASE WHEN Camera = 'cam0' OR (Foot_X - 100 >= 0 AND -Foot_X + 0.5 * Foot_Y + 500 >= 0 AND Foot_Y - 520 >= 0 AND -Foot_Y + 760 >= 0) THEN 1.0 ELSE 0.5 END AS precision,
  CAST(round_even(CAST(ts_cs AS DOUBLE) / 50, 0) AS BIGINT) AS bucket, printf('Global_ID_%04d', Track_ID % 1000000) AS Global_ID FROM obs)"""


@query(PRECISE + f" SELECT {TRACK}, Class, ts_cs, round(precision, 6) AS precision FROM pc")
def position_precision(spark, sf_dir):
    out = presence.precision(observations(spark, sf_dir), hulls(spark, sf_dir))
    return out.select(*S.TRACK, "Class", "ts_cs", six("precision").alias("precision"))


def precise(spark, sf_dir) -> DataFrame:
    """Rows with precision and the walker's identity, which is known here: the event's number."""
    return presence.precision(observations(spark, sf_dir), hulls(spark, sf_dir)).withColumn("Global_ID", identities.gid_name(F.col("Track_ID") % 1000000))


BEST = (
    PRECISE
    + f""",
bv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS}, Global_ID, bucket ORDER BY precision DESC, Camera, Track_ID, ts_cs) AS nth FROM pc WHERE Class = 'person') WHERE nth = 1)"""
)


@query(BEST + f" SELECT {KEYS}, Global_ID, bucket, Camera, Track_ID, ts_cs, Local_X_Meters, Local_Y_Meters FROM bv")
def composite_best_view(spark, sf_dir):
    rows = presence.best_views(precise(spark, sf_dir).where("Class = 'person'").select(*S.TRACK, "Global_ID", "ts_cs", "precision", "Local_X_Meters", "Local_Y_Meters"))
    return rows.select(*S.KEYS, "Global_ID", "bucket", "Camera", "Track_ID", "ts_cs", "Local_X_Meters", "Local_Y_Meters")


FILLED = (
    BEST
    + f""",
nx AS (SELECT *, lead(bucket) OVER w AS nb, lead(Local_X_Meters) OVER w AS nxx, lead(Local_Y_Meters) OVER w AS nyy FROM bv WINDOW w AS (PARTITION BY {KEYS}, Global_ID ORDER BY bucket)),
hl AS (SELECT *, unnest(range(bucket + 1, nb)) AS pos FROM nx WHERE nb - bucket BETWEEN 2 AND 3),
cp AS (SELECT {KEYS}, Global_ID, bucket, Camera, ts_cs, Local_X_Meters AS x, Local_Y_Meters AS y, Foot_X, false AS Interpolated FROM bv
  UNION ALL SELECT {KEYS}, Global_ID, pos, Camera, pos * 50, Local_X_Meters + (nxx - Local_X_Meters) * ((pos - bucket) / (nb - bucket)), Local_Y_Meters + (nyy - Local_Y_Meters) * ((pos - bucket) / (nb - bucket)), NULL, true FROM hl)"""
)


@query(FILLED + f" SELECT {KEYS}, Global_ID, bucket, Camera, ts_cs, round(x, 6) AS Local_X_Meters, round(y, 6) AS Local_Y_Meters, Foot_X, Interpolated FROM cp")
def composite_gap_fill(spark, sf_dir):
    path = precise(spark, sf_dir).where("Class = 'person'").select(*S.TRACK, "Global_ID", "ts_cs", "Timestamp", "precision", "Local_X_Meters", "Local_Y_Meters", "Foot_X")
    rows = presence.gaps_filled(presence.best_views(path))
    return rows.select(*S.KEYS, "Global_ID", "bucket", "Camera", "ts_cs", six("Local_X_Meters").alias("Local_X_Meters"), six("Local_Y_Meters").alias("Local_Y_Meters"), "Foot_X", "Interpolated")


@query(PRECISE + f" SELECT {KEYS}, bucket, Class, count(*) AS n, min(Camera) AS Camera FROM pc WHERE Class <> 'person' GROUP BY ALL HAVING count(DISTINCT Camera) = 1")
def vehicles_single_camera(spark, sf_dir):
    """Buckets and classes that one camera alone sees: no row of them is a copy."""
    rows = presence.vehicle_rows(precise(spark, sf_dir))
    return rows.groupBy(*S.KEYS, "bucket", "Class").agg(F.count("*").alias("n"), F.min("Camera").alias("Camera"), F.max("Camera").alias("_c")).where("Camera = _c").drop("_c")


def _vehicles_sql(rows: str) -> str:
    """One row after the other by precision, with the kept ones and what each took as a list: no rounds, no pairs."""
    group = f"{KEYS}, bucket, Class"
    dist = "sqrt((v.x - r.Local_X_Meters) ** 2 + (v.y - r.Local_Y_Meters) ** 2)"
    radius = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.VEHICLE_RADIUS.items())
    return f"""{PRECISE},
vr AS MATERIALIZED ({rows}),
vn AS MATERIALIZED (SELECT {group}, Camera, Local_X_Meters, Local_Y_Meters, CASE Class {radius} ELSE {S.OTHER_RADIUS} END AS radius,
  row_number() OVER (PARTITION BY {group} ORDER BY precision DESC, Camera, Track_ID, ts_cs, Local_X_Meters, Local_Y_Meters) AS n FROM vr),
st AS (SELECT {group}, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k BIGINT, x DOUBLE, y DOUBLE, cam VARCHAR, took VARCHAR[])[]) AS kept FROM (SELECT DISTINCT {group} FROM vn)
  UNION ALL
  SELECT {group}, n, CASE WHEN pick IS NULL THEN list_append(kept, {{'k': n, 'x': Local_X_Meters, 'y': Local_Y_Meters, 'cam': Camera, 'took': CAST([] AS VARCHAR[])}})
    ELSE list_transform(kept, lambda v: {{'k': v.k, 'x': v.x, 'y': v.y, 'cam': v.cam, 'took': CASE WHEN v.k = pick THEN list_append(v.took, Camera) ELSE v.took END}}) END
  FROM (SELECT r.*, s.kept, list_sort(list_transform(list_filter(s.kept, lambda v: v.cam <> r.Camera AND NOT list_contains(v.took, r.Camera) AND {dist} <= r.radius), lambda v: {{'d': {dist}, 'k': v.k}}))[1].k AS pick
    FROM st s JOIN vn r ON {" AND ".join(f"s.{c} = r.{c}" for c in [*S.KEYS, "bucket", "Class"])} AND r.n = s.n + 1)),
lst AS (SELECT {group}, unnest(kept) AS v FROM st JOIN (SELECT {group}, max(n) AS n FROM vn GROUP BY ALL) USING ({group}, n))
SELECT {KEYS}, bucket * 50 / 100 AS Timestamp, bucket, Class, v.x AS Local_X_Meters, v.y AS Local_Y_Meters, v.cam AS Source_Camera FROM lst"""


VEHICLE_ROWS = "SELECT * FROM pc WHERE Class NOT IN ('person', 'wheelchair')"


@query(_vehicles_sql(f"SELECT * FROM ({VEHICLE_ROWS}) QUALIFY row_number() OVER (PARTITION BY {TRACK}, bucket ORDER BY precision DESC, ts_cs) = 1"), recursive=True)
def vehicles_dedup(spark, sf_dir):
    """One row of a track in a bucket."""
    rows = presence.vehicles(presence.vehicle_rows(precise(spark, sf_dir), one_per_track=True))
    return rows.select(*S.KEYS, "Timestamp", "bucket", "Class", "Local_X_Meters", "Local_Y_Meters", "Source_Camera")


@query(_vehicles_sql(VEHICLE_ROWS), recursive=True)
def vehicles_each_row(spark, sf_dir):
    """Every row counts: rows of one camera are different vehicles."""
    rows = presence.vehicles(presence.vehicle_rows(precise(spark, sf_dir)))
    return rows.select(*S.KEYS, "Timestamp", "bucket", "Class", "Local_X_Meters", "Local_Y_Meters", "Source_Camera")


COUNTS = (
    FILLED
    + f""",
vh AS (SELECT DISTINCT {KEYS}, bucket, Class, Track_ID FROM pc WHERE Class <> 'person'),
ps AS (SELECT {KEYS}, bucket, 'person (on foot)' AS category, count(DISTINCT Global_ID) AS n FROM cp GROUP BY ALL
  UNION ALL SELECT {KEYS}, bucket, Class, count(*) FROM vh GROUP BY ALL),
sn AS (SELECT {KEYS}, min(bucket) AS b0, max(bucket) AS b1 FROM pc GROUP BY ALL),
gr AS (SELECT *, unnest(range(b0 * 50 // 6000, b1 * 50 // 6000 + 1)) AS iv FROM sn),
gn AS (SELECT {KEYS}, iv, least(b1, (iv + 1) * 120 - 1) - greatest(b0, iv * 120) + 1 AS buckets FROM gr),
sm AS (SELECT {KEYS}, category, bucket * 50 // 6000 AS iv, sum(n) AS total, max(n) AS peak FROM ps GROUP BY ALL)
SELECT {KEYS}, iv * 60 AS Interval_Start_s, category AS Category, round(coalesce(total, 0) / buckets, 6) AS Mean_Present, coalesce(peak, 0) AS Peak_Present
FROM gn JOIN (SELECT DISTINCT {KEYS}, category FROM sm) USING ({KEYS}) LEFT JOIN sm USING ({KEYS}, category, iv)"""
)


@query(COUNTS)
def counts_over_time(spark, sf_dir):
    """People on foot, and vehicles of each class by track, present in each minute."""
    rows, seen = precise(spark, sf_dir).where("Class = 'person'"), observations(spark, sf_dir)
    path = rows.select(*S.TRACK, "Global_ID", "ts_cs", "Timestamp", "precision", "Local_X_Meters", F.lit("on foot").alias("Mode"))
    composite = presence.gaps_filled(presence.best_views(path))
    others = presence.vehicle_rows(seen).select(*S.KEYS, "bucket", "Class", "Track_ID").distinct()
    return presence.counts_over_time(composite, others, seen)


# ---------------------------------------------------------------- coverage and clocks

COVER = f"""
cm AS (SELECT {KEYS}, Camera, quantile_cont(Local_X_Meters, 0.01) AS x0, quantile_cont(Local_X_Meters, 0.99) AS x1, quantile_cont(Local_Y_Meters, 0.01) AS y0, quantile_cont(Local_Y_Meters, 0.99) AS y1 FROM obs WHERE Class = 'person' GROUP BY ALL),
bx AS (SELECT {KEYS}, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM cm GROUP BY ALL),
ex AS (SELECT {KEYS}, (x0 + x1) / 2 - greatest((x1 - x0) / 2 + 10, 20) AS x0, (x0 + x1) / 2 + greatest((x1 - x0) / 2 + 10, 20) AS x1, (y0 + y1) / 2 - greatest((y1 - y0) / 2 + 10, 20) AS y0, (y0 + y1) / 2 + greatest((y1 - y0) / 2 + 10, 20) AS y1 FROM bx),
cc AS (SELECT {KEYS}, Camera, CAST(least(floor((Local_X_Meters - x0) * ceil((x1 - x0) / 2) / (x1 - x0)), ceil((x1 - x0) / 2) - 1) AS BIGINT) AS ix, CAST(least(floor((Local_Y_Meters - y0) * ceil((y1 - y0) / 2) / (y1 - y0)), ceil((y1 - y0) / 2) - 1) AS BIGINT) AS iy, count(*) AS hits
  FROM obs JOIN ex USING ({KEYS}) WHERE Class = 'person' AND Local_X_Meters BETWEEN x0 AND x1 AND Local_Y_Meters BETWEEN y0 AND y1 GROUP BY ALL HAVING count(*) >= 5)"""


@query(COVER + f" SELECT {KEYS}, round(x0, 6) AS x0, round(x1, 6) AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1 FROM ex")
def map_extent(spark, sf_dir):
    return coverage.extent(people(spark, sf_dir)).select(*S.KEYS, *(six(c).alias(c) for c in ("x0", "x1", "y0", "y1")))


def _covered(spark, sf_dir) -> DataFrame:
    rows = people(spark, sf_dir)
    return cut(coverage.cells(rows, coverage.extent(rows)))  # few, and read several times


@query(COVER + f" SELECT {KEYS}, Camera, ix, iy, hits FROM cc")
def coverage_cells(spark, sf_dir):
    return _covered(spark, sf_dir)


@query(
    COVER
    + f""",
ct AS (SELECT {KEYS}, ix, iy, count(*) AS n FROM cc GROUP BY ALL), al AS (SELECT {KEYS}, count(DISTINCT Camera) AS k FROM cc GROUP BY ALL)
SELECT {KEYS}, Camera AS what, count(*) * 4.0 AS area_m2 FROM cc GROUP BY ALL
UNION ALL SELECT {KEYS}, 'two or more', count(*) FILTER (n >= 2) * 4.0 FROM ct GROUP BY ALL
UNION ALL SELECT {KEYS}, 'all', count(*) FILTER (n = k) * 4.0 FROM ct JOIN al USING ({KEYS}) GROUP BY ALL"""
)
def coverage_areas(spark, sf_dir):
    return coverage.areas(_covered(spark, sf_dir))


CLOCK = f"""
ok AS (SELECT *, Camera = 'cam0' AS ref, CAST(floor(Local_X_Meters / 2) AS BIGINT) AS cx, CAST(floor(Local_Y_Meters / 2) AS BIGINT) AS cy FROM obs WHERE Camera IN ('cam0', 'cam1') AND Class = 'person'),
tz AS (SELECT {KEYS}, ref, min(ts_cs) AS tz FROM ok GROUP BY ALL),
sh AS (SELECT {KEYS}, cx, cy FROM ok GROUP BY ALL HAVING count(*) FILTER (ref) >= 20 AND count(*) FILTER (NOT ref) >= 20),
oc AS (SELECT DISTINCT {KEYS}, cx, cy, CASE WHEN ref THEN 'ref' ELSE 'other' END AS side, (ts_cs - tz) // 25 AS bin FROM ok JOIN tz USING ({KEYS}, ref) JOIN sh USING ({KEYS}, cx, cy))"""


@query(CLOCK + f" SELECT {KEYS}, cx, cy, side, bin FROM oc")
def clock_cells(spark, sf_dir):
    return clocksync.occupancy(observations(spark, sf_dir), "cam0", "cam1")


@query(CLOCK + f" SELECT {KEYS}, a.bin - b.bin AS lag, count(*) AS score FROM oc a JOIN oc b USING ({KEYS}, cx, cy) WHERE a.side = 'ref' AND b.side = 'other' GROUP BY ALL")
def clock_lag_curve(spark, sf_dir):
    return clocksync.lag_curve(clocksync.occupancy(observations(spark, sf_dir), "cam0", "cam1"))


@query(
    CLOCK
    + f""",
cv AS (SELECT {KEYS}, a.bin - b.bin AS lag, count(*) AS score FROM oc a JOIN oc b USING ({KEYS}, cx, cy) WHERE a.side = 'ref' AND b.side = 'other' GROUP BY ALL),
en AS (SELECT {KEYS}, min(ts_cs) FILTER (ref) AS r0, max(ts_cs) FILTER (ref) AS r1, min(ts_cs) FILTER (NOT ref) AS o0, max(ts_cs) FILTER (NOT ref) AS o1 FROM ok GROUP BY ALL),
gd AS (SELECT {KEYS}, r0, o0, unnest(range(-((o1 - o0 + 24) // 25), (r1 - r0 + 24) // 25 + 2)) AS lag FROM en JOIN (SELECT DISTINCT {KEYS} FROM cv) USING ({KEYS})),
fu AS (SELECT gd.*, coalesce(score, 0) AS score FROM gd LEFT JOIN cv USING ({KEYS}, lag)),
fw AS (SELECT *, lag(score) OVER w AS y0, lead(score) OVER w AS y2, row_number() OVER (PARTITION BY {KEYS} ORDER BY score DESC, lag) AS nth FROM fu WINDOW w AS (PARTITION BY {KEYS} ORDER BY lag)),
pk AS (SELECT *, coalesce(CASE WHEN y0 - 2 * score + y2 < 0 THEN (y0 - y2) / (2 * (y0 - 2 * score + y2)) ELSE 0 END, 0) AS fine FROM fw WHERE nth = 1),
aw AS (SELECT {KEYS}, f.lag AS away_lag, f.score AS s FROM fu f JOIN pk p USING ({KEYS}) WHERE abs(f.lag - p.lag) * 25 > 1000),
md AS (SELECT {KEYS}, median(s) AS m, max(s) AS runner_up FROM aw GROUP BY ALL),
ma AS (SELECT {KEYS}, median(abs(s - m)) AS mad, min(away_lag) FILTER (s = runner_up) AS second FROM aw JOIN md USING ({KEYS}) GROUP BY ALL),
ce AS (SELECT {KEYS}, count(*) AS shared_cells FROM (SELECT DISTINCT {KEYS}, cx, cy FROM oc) GROUP BY ALL)
SELECT {KEYS}, round((r0 + (lag + fine) * 25 - o0) / 100, 3) AS offset_s, score AS peak_score, CAST(coalesce(m, 0) AS DOUBLE) AS background,
  round((score - coalesce(m, 0)) / (CASE WHEN coalesce(mad, 0) > 0 THEN mad ELSE 1e-9 END * 1.4826), 1) AS peak_sigmas, runner_up,
  round((r0 + second * 25 - o0) / 100, 3) AS runner_up_offset_s, shared_cells, shared_cells * 4.0::DOUBLE AS shared_area_m2,
  score >= 3 * greatest(coalesce(m, 0), 1) AND score > 1.5 * coalesce(runner_up, 0) AS reliable
FROM pk JOIN ce USING ({KEYS}) LEFT JOIN md USING ({KEYS}) LEFT JOIN ma USING ({KEYS})"""
)
def clock_offset(spark, sf_dir):
    return clocksync.offset(observations(spark, sf_dir), "cam0", "cam1")


# ---------------------------------------------------------------- mining and audit

FRAMES = f"fr AS (SELECT DISTINCT {KEYS}, Camera, ts_cs FROM obs)"


def frames_of(rows: DataFrame) -> DataFrame:
    return rows.select(*mining.FRAME).distinct()


@query(FRAMES + f" SELECT {KEYS}, Camera, ts_cs FROM fr WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE Class = 'person' AND o.site_id = fr.site_id AND o.session_id = fr.session_id AND o.Camera = fr.Camera AND o.ts_cs = fr.ts_cs)")
def empty_frames(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return mining.empty_frames(frames_of(rows), rows, "person")


@query(FRAMES + f" SELECT {KEYS}, Camera, ts_cs FROM obs GROUP BY ALL HAVING max(Detection_Conf) < 0.6")
def soft_empty_frames(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return mining.soft_empty_frames(frames_of(rows), rows, 0.6)


@query(FRAMES + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, Camera ORDER BY ts_cs) - 1 AS k FROM fr),
ct AS (SELECT {KEYS}, Camera, count(*) AS c FROM fr GROUP BY ALL),
pick AS (SELECT DISTINCT {KEYS}, Camera, (i * c) // 50 AS k FROM ct, range(50) t(i))
SELECT {KEYS}, Camera, ts_cs FROM rk JOIN pick USING ({KEYS}, Camera, k)""")
def even_sample(spark, sf_dir):
    return mining.evenly(frames_of(observations(spark, sf_dir)), 50)


@query(f"""
fr AS (SELECT DISTINCT {KEYS}, Camera, ts_cs, 10 * (CAST(substr(Camera, 4) AS BIGINT) + 1) AS fps FROM obs),
pe AS (SELECT DISTINCT {KEYS}, Camera, ts_cs, true AS seen FROM obs WHERE Class = 'person'),
fe AS (SELECT {KEYS}, Camera, ts_cs FROM fr LEFT JOIN pe USING ({KEYS}, Camera, ts_cs) WHERE seen IS NULL AND ts_cs * 7 % 100 >= 30
  AND ts_cs // 10 % CAST(greatest(1, round_even(CAST(fps AS DOUBLE) / 4, 0)) AS BIGINT) = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, Camera ORDER BY ts_cs) - 1 AS k FROM fe),
ct AS (SELECT {KEYS}, Camera, count(*) AS c FROM fe GROUP BY ALL),
pick AS (SELECT DISTINCT {KEYS}, Camera, (i * c) // 50 AS k FROM ct, range(50) t(i))
SELECT {KEYS}, Camera, ts_cs FROM rk JOIN pick USING ({KEYS}, Camera, k)""")
def mined_frames(spark, sf_dir):
    """Sharp frames without a person, some four a second of each camera, fifty of them."""
    rows = observations(spark, sf_dir)
    videos = rows.select(*S.KEYS, "Camera").distinct().withColumn("fps", (camera_number() + 1) * 10)
    frames = frames_of(rows).withColumns({"frame_idx": F.floor(F.col("ts_cs") / 10), "sharpness": (F.col("ts_cs") * 7 % 100).cast("double")})
    return mining.mined(frames, rows, videos, 4, 30.0, 50, "person").select(*mining.FRAME)


@query(f" SELECT {KEYS}, Camera, ts_cs, printf('Global_ID_%04d', (Track_ID % 1000000) // 12) AS Global_ID, count(DISTINCT Track_ID) AS tracks FROM obs WHERE Class = 'person' GROUP BY ALL HAVING count(DISTINCT Track_ID) > 1")
def duplicate_identity_audit(spark, sf_dir):
    """With twelve events to an identity, cameras show some on several tracks at once."""
    return identities.duplicate_identities(people(spark, sf_dir).withColumn("Global_ID", identities.gid_name(F.floor(F.col("Track_ID") % 1000000 / 12))))


@query(
    RIDES
    + f"""
SELECT {KEYS}, count(*) AS n_rows, count(*) FILTER (o.Class = 'person') AS n_person_rows, count(DISTINCT CASE WHEN o.Class = 'person' THEN o.Camera || ':' || o.Track_ID END) AS n_tracks,
  count(DISTINCT CASE WHEN o.Class = 'person' THEN o.Track_ID % 1000000 END) AS n_identities, count(*) FILTER (o.Class = 'person' AND rc IS NOT NULL) AS n_riding_rows, count(DISTINCT o.Camera) AS n_cameras
FROM obs o LEFT JOIN rd ON o.site_id = rd.site_id AND o.session_id = rd.session_id AND o.Camera = rd.Camera AND o.ts_cs = rd.ts_cs AND o.Track_ID = rd.p AND o.Class = 'person' GROUP BY o.site_id, o.session_id"""
    .replace(f"SELECT {KEYS},", "SELECT o.site_id, o.session_id,")
)
def run_summary(spark, sf_dir):
    rows = movement.travel_mode(observations(spark, sf_dir)).withColumn("Global_ID", identities.gid_name(F.col("Track_ID") % 1000000))
    return audit.run_summary(rows)
