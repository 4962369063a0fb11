"""Tables of the movement jobs and the fixed values that their results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

#: In front of every key, so that many sites and sessions run in one job.
KEYS = ["site_id", "session_id"]
TRACK = [*KEYS, "Camera", "Track_ID"]

OBSERVATIONS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("site_id", "session_id", "Camera", "Class")]
    + [T.StructField("Track_ID", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("Timestamp", "Center_X", "Center_Y", "Foot_X", "Foot_Y", "Detection_Conf", "Raw_Foot_X", "Raw_Foot_Y")]
)
POSITIONS = T.StructType([*OBSERVATIONS.fields, *(T.StructField(n, T.DoubleType()) for n in ("Local_X_Meters", "Local_Y_Meters", "Longitude", "Latitude")), T.StructField("Beyond_Horizon", T.BooleanType())])
FINGERPRINTS = "Camera string, Track_ID long, Timestamp double, Height_Px double, Vector array<float>"

# fixed values: classes, bars, distances (metres) and times (seconds) that results depend on
RIDEABLES = ("bicycle", "scooter", "skateboard", "motorcycle")
VEHICLE_RADIUS = {"vehicle": 6.0, "car": 6.0, "truck": 8.0, "bus": 10.0, "golfcart": 4.0}
OTHER_RADIUS = 3.0
DEFERRED = ("wheelchair",)
RECORDED = ("person", "bicycle", "scooter", "skateboard", "motorcycle", "car", "truck", "bus", "vehicle", "golfcart", "wheelchair")
BUCKET_S = 0.5
INTERVAL_S = 60
START_BAR, KEEP_BAR = 0.35, 0.10
MIN_HEIGHT_PX = 60.0
FALLBACK_BAR = 0.80
STALE_DAYS = 180
MAX_LOO_M = 0.75
