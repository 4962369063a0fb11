"""Rounds over open pairs against a walk through each bucket in order of precision."""

import random

from groundtrack import schema as S
from groundtrack.operators import presence

ROWS = "site_id string, session_id string, Camera string, Track_ID long, Class string, ts_cs long, Local_X_Meters double, Local_Y_Meters double, precision double"


def walked(rows):
    """Each row in order is absorbed by the nearest kept one that has no row of its camera, or is kept."""
    groups, out = {}, []
    for r in rows:
        groups.setdefault((r[0], r[1], round(r[5] / 50), r[4]), []).append(r)
    for (site, session, bucket, name), members in groups.items():
        holders = []
        for r in sorted(members, key=lambda r: (-r[8], r[2], r[3], r[5], r[6], r[7])):
            reach = [(((h["x"] - r[6]) ** 2 + (h["y"] - r[7]) ** 2) ** 0.5, k) for k, h in enumerate(holders) if r[2] not in h["cameras"]]
            reach = [x for x in reach if x[0] <= S.VEHICLE_RADIUS.get(name, S.OTHER_RADIUS)]
            if reach:
                holders[min(reach)[1]]["cameras"].add(r[2])
            else:
                holders.append({"x": r[6], "y": r[7], "cameras": {r[2]}, "camera": r[2]})
        out += [(site, session, bucket, name, h["x"], h["y"], h["camera"]) for h in holders]
    return sorted(out)


def test_rounds_equal_a_walk(spark):
    r = random.Random(5)
    rows = []
    for bucket in range(60):
        size = r.choice([1, 3, 8, 25])
        for _ in range(size):
            # coarse places and precisions, so that ties come up
            x, y = r.randrange(-8, 9) * r.choice([0.5, 1.0, 3.0]), r.randrange(-3, 4) * 1.0
            rows.append(("s", r.choice("de"), r.choice("abcd"), r.randrange(9), r.choice(["bicycle", "car", "truck"]), bucket * 50, float(x), y, float(r.randrange(6))))
    rows += rows[:20]
    table = spark.createDataFrame(rows, ROWS).repartition(3)
    got = presence.vehicles(presence.vehicle_rows(table)).collect()
    assert sorted((x.site_id, x.session_id, x.bucket, x.Class, x.Local_X_Meters, x.Local_Y_Meters, x.Source_Camera) for x in got) == walked(rows)
    assert len(got) < len(rows)


def test_no_rows(spark):
    assert presence.vehicles(presence.vehicle_rows(spark.createDataFrame([], ROWS))).count() == 0
