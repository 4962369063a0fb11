"""Walkers whose truth is known, one operator at a time."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundtrack import queries
from groundtrack.functions import geo
from groundtrack.operators import alignment, clocksync, detections, georeference, identities, movement, presence, stitch, strangers, views
from groundtrack.operators.matching import Identities, assign

SCHEMA = "site_id string, session_id string, Camera string, Track_ID long, Class string, ts_cs long, Timestamp double, Local_X_Meters double, Local_Y_Meters double, Foot_X double, Foot_Y double, Center_Y double, Detection_Conf double"


def walk(camera, track, x, y, vx=0.0, vy=0.0, t0=0, t1=500, step=10, cls="person", height=100.0):
    out = []
    for t in range(t0, t1 + 1, step):
        px, py = float(x + vx * (t - t0) / 100), float(y + vy * (t - t0) / 100)
        out.append(("s", "d", camera, track, cls, t, t / 100, px, py, px * 100, py * 100 + 500, py * 100 + 500 - height / 2, 0.9))
    return out


def frame(spark, *parts):
    return spark.createDataFrame([r for p in parts for r in p], SCHEMA)


def tracks(spark, rows):
    """(camera, track, gid, confidence, t0, t1)"""
    return spark.createDataFrame([("s", "d", *r) for r in rows], "site_id string, session_id string, Camera string, Track_ID long, gid long, Confidence double, t0 long, t1 long")


def test_assign_is_least():
    r = np.random.default_rng(1)
    for _ in range(150):
        n, m = r.integers(1, 6, 2)
        cost = r.integers(0, 12, (n, m)).astype(float)
        pairs = assign(cost)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        small = cost if n <= m else cost.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert sum(cost[i, j] for i, j in pairs) == best


def test_guarded_merge():
    ids = Identities([1, 2, 3], [("c", 1), ("c", 2), ("c", 3)], [0, 5, 11], [10, 15, 20])
    assert not ids.merge(("c", 1), ("c", 2))
    assert ids.merge(("c", 3), ("c", 1)) and ids.of["c", 3] == 1


def test_strangers(spark):
    apart = frame(spark, walk("c", 1, 0, 0), walk("c", 2, 5, 0))
    assert strangers.stranger_pairs(apart).count() == 1
    never = frame(spark, walk("c", 1, 0, 0), walk("c", 2, 5, 0, t0=1000, t1=1500))
    assert strangers.stranger_pairs(never).count() == 0
    doubled = frame(spark, walk("c", 1, 0, 0), walk("c", 2, 0.2, 0))
    assert strangers.stranger_pairs(doubled).count() == 0
    flat = frame(spark, walk("c", 1, 0, 0, height=0), walk("c", 2, 5, 0, height=0))
    assert strangers.stranger_pairs(flat).first().apart == float("inf")


def test_bars(spark):
    scores = spark.createDataFrame([("s", "d", i * 1000, i / 100) for i in range(100)], "site_id string, session_id string, moment_cs long, similarity double")
    run, blocks = strangers.bars(scores)
    assert abs(run.first().bar - 0.9801) < 1e-9 and blocks.count() == 1
    assert abs(strangers.share_passing(scores, run.first().bar).first().passing - 0.01) < 0.011
    t = tracks(spark, [("c", 1, 1, None, 0, 10)])
    assert strangers.bar_of_tracks(t, scores).first().threshold == 0.9801
    assert strangers.bar_of_tracks(t, scores.limit(5)).first().threshold == 0.80


def test_candidates(spark):
    rows = frame(spark, walk("c", 1, 0, 0, height=120), walk("c", 2, 9, 9, height=30), walk("c", 3, 5, 5, height=90))
    v = [("s", "d", "c", t, i, h, [1.0, 0.0]) for t, h in ((1, 120.0), (2, 30.0), (3, None)) for i in range(7)]
    v = spark.createDataFrame(v, "site_id string, session_id string, Camera string, Track_ID long, ts_cs long, Height_Px double, Vector array<float>")
    got = {r.Track_ID: r for r in views.candidates(rows, v).collect()}
    assert got[1].eligible and len(got[1].exemplars) == 5
    assert not got[2].eligible and got[3].eligible and len(got[3].exemplars) == 7


def test_mode(spark):
    def mode(*parts):
        out = movement.travel_mode(frame(spark, walk("c", 1, 0, 0, 2.0), *parts)).where("Class = 'person'")
        return [r.Mode for r in out.orderBy("ts_cs").collect()]

    with_bike = mode(walk("c", 9, 0.5, 0, 2.0, cls="bicycle"))
    assert with_bike[-1] == "bicycle" and "bicycle" in with_bike
    assert set(mode(walk("c", 9, 3, 0, cls="bicycle"))) == {"on foot"}
    assert set(mode(walk("c", 9, 0.5, 0, 2.0, cls="wheelchair"))) == {"on foot"}
    lone = frame(spark, walk("c", 1, 50, 50), walk("c", 9, 0, 0, 2.0, cls="bicycle"))
    assert movement.riderless(lone).count() > 0


def test_vehicles(spark):
    rows = frame(spark, walk("a", 1, 0, 0, t1=0, cls="bicycle", height=100), walk("b", 2, 1, 0, t1=0, cls="bicycle", height=200), walk("a", 3, 0.5, 1, t1=0, cls="bicycle", height=50), walk("a", 4, 30, 0, t1=0, cls="car"), walk("a", 5, 9, 9, t1=0, cls="wheelchair"))
    out = presence.vehicles(presence.vehicle_rows(presence.precision(rows))).collect()
    assert sorted((r.Class, r.Source_Camera) for r in out) == [("bicycle", "a"), ("bicycle", "b"), ("car", "a")]
    many = frame(spark, walk("a", 1, 0, 0, t1=40, step=3, cls="bicycle"))
    assert presence.vehicle_rows(presence.precision(many)).count() > presence.vehicle_rows(presence.precision(many), True).count() == 2


def test_composite_and_gaps(spark):
    rows = frame(spark, walk("a", 1, 0, 0, 1.0, t1=500, height=50), walk("b", 2, 0.1, 0, 1.0, t1=500, height=200), walk("a", 1, 10, 0, 1.0, t0=650, t1=700), walk("a", 1, 20, 0, t0=1000, t1=1000))
    best = presence.best_views(presence.precision(rows).withColumn("Global_ID", F.lit("g")))
    assert {r.Camera for r in best.where("bucket < 10").collect()} == {"b"}
    filled = presence.gaps_filled(best).where("Interpolated").orderBy("bucket").collect()
    assert [r.bucket for r in filled] == [11, 12] and all(r.Foot_X is None for r in filled)
    assert filled[0].Timestamp == 5.5


def test_buckets_are_half_even(spark):
    df = spark.createDataFrame([(25,), (75,), (125,)], "t long")
    assert [r[0] for r in df.select(identities.bucket_of(F.col("t"))).collect()] == [0, 2, 2]


def test_counts_fill_empty_buckets(spark):
    rows = frame(spark, walk("a", 1, 0, 0, t1=300), walk("a", 2, 5, 0, t0=0, t1=9000, step=9000, cls="car"))
    p = presence.precision(rows).withColumns({"Global_ID": F.lit("g"), "Mode": F.lit("on foot")})
    out = {(r.Interval_Start_s, r.Category): r for r in presence.counts_over_time(presence.best_views(p.where("Class = 'person'")), presence.vehicles(presence.vehicle_rows(p)), p).collect()}
    assert out[0, "person (on foot)"].Peak_Present == 1 and abs(out[0, "person (on foot)"].Mean_Present - 7 / 120) < 1e-6
    assert out[60, "person (on foot)"].Peak_Present == 0 and out[60, "car"].Peak_Present == 1


def stitched(spark, *parts):
    df = frame(spark, *parts)
    edges = stitch.matched(stitch.stitch_edges(stitch.track_ends(df)))
    w = [(r.Camera, r.Track_ID, i, None, r.t0, r.t1) for i, r in enumerate(stitch.track_ends(df).orderBy("t0", "Camera", "Track_ID").collect(), 1)]
    return {(r.Camera, r.Track_ID): r.gid for r in identities.stitched(tracks(spark, w), edges).collect()}


def test_stitching(spark):
    a = walk("c", 1, 0, 0, 1.0, t1=300)
    join = stitched(spark, a, walk("c", 2, 3.6, 0, 1.0, t0=360, t1=600))
    assert join["c", 1] == join["c", 2]
    for other in (walk("c", 2, 4.5, 0, 1.0, t0=450, t1=600), walk("c", 2, 3.6, 5, 1.0, t0=360, t1=600), walk("e", 2, 3.6, 0, 1.0, t0=360, t1=600)):
        got = stitched(spark, a, other)
        assert len(set(got.values())) == 2
    cyclist = stitched(spark, walk("c", 1, 0, 0, 6.0, t1=300), walk("c", 2, 22.8, 0, 6.0, t0=380, t1=600))
    assert cyclist["c", 1] == cyclist["c", 2]
    pair = stitched(spark, walk("c", 1, 0, 0, 1.0, t1=300), walk("c", 2, 0, 1, 1.0, t1=300), walk("c", 3, 3.5, 0, 1.0, t0=350, t1=600), walk("c", 4, 3.5, 1, 1.0, t0=350, t1=600))
    assert pair["c", 1] == pair["c", 3] and pair["c", 2] == pair["c", 4] and pair["c", 1] != pair["c", 2]


def test_islands_match_the_whole(spark):
    r = np.random.default_rng(5)
    parts = []
    for i in range(60):
        t = int(r.integers(0, 300)) * 10
        parts.append(walk("c", i, *r.uniform(0, 4, 2), *r.uniform(-1, 1, 2), t0=t, t1=t + 200))
    edges = stitch.stitch_edges(stitch.track_ends(frame(spark, *parts)))
    rows = edges.collect()
    got = stitch.matched(edges).collect()
    starts, ends = sorted({x.a for x in rows}), sorted({x.b for x in rows})
    cost = np.full((len(starts), len(ends)), 1e9)
    for x in rows:
        cost[starts.index(x.a), ends.index(x.b)] = x.error
    whole = [(i, j) for i, j in assign(cost) if cost[i, j] < 1e9]
    assert len(got) == len(whole) and abs(sum(x.error for x in got) - sum(cost[i, j] for i, j in whole)) < 1e-6


def test_hand_off(spark):
    def same(*parts):
        df = frame(spark, *parts)
        pairs = identities.cosighted(identities.bucket_means(df))
        t = tracks(spark, [("a", 1, 1, None, 0, 500), ("b", 2, 2, None, 0, 500)])
        return len({r.gid for r in identities.handed_off(t, pairs).collect()}) == 1

    assert same(walk("a", 1, 0, 0), walk("b", 2, 0.67, 0))
    assert not same(walk("a", 1, 0, 0), walk("b", 2, 8, 0))
    assert not same(walk("a", 1, 0, 0), walk("b", 2, 0.3, 0, t1=100))


def test_cosighting_equals_the_plain_join(spark):
    r = np.random.default_rng(7)
    df = frame(spark, *(walk("ab"[i % 2], i, *r.uniform(-4, 4, 2), *r.uniform(-0.5, 0.5, 2), t1=400) for i in range(40)))
    m = identities.bucket_means(df)
    a = m.select("bucket", F.col("Camera").alias("ca"), F.col("Track_ID").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = m.select("bucket", F.col("Camera").alias("cb"), F.col("Track_ID").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    d = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
    plain = a.join(b, "bucket").where("ca < cb").groupBy("a", "b").agg(F.count("*").alias("n"), F.median(d).alias("d")).where("n >= 4 and d <= 1.5")
    assert {(x.a, x.b, x.n, round(x.d, 9)) for x in plain.collect()} == {(x.a, x.b, x.n, round(x.d, 9)) for x in identities.cosighted(m).collect()}


def test_conflicts(spark):
    def settle(rows, *parts):
        return {(r.Camera, r.Track_ID): (r.gid, r.Confidence) for r in identities.settled(tracks(spark, rows), identities.bucket_means(frame(spark, *parts))).collect()}

    far = (walk("a", 1, 0, 0, t0=1000, t1=1500), walk("b", 2, 20, 0, t0=1000, t1=1500))
    got = settle([("a", 1, 1, 0.9, 1000, 1500), ("b", 2, 1, 0.82, 1000, 1500)], *far)
    assert got["a", 1] == (1, 0.9) and got["b", 2][0] != 1 and got["b", 2][1] is None
    near = settle([("a", 1, 1, 0.9, 1000, 1500), ("b", 2, 1, 0.82, 1000, 1500)], walk("a", 1, 0, 0, t0=1000, t1=1500), walk("b", 2, 1, 0, t0=1000, t1=1500))
    assert near["a", 1][0] == near["b", 2][0] == 1
    # the surer one is out of reach from where the identity was a second before
    got = settle([("c", 3, 1, None, 0, 900), ("a", 1, 1, 0.9, 1000, 1500), ("b", 2, 1, 0.82, 1000, 1500)], walk("c", 3, 20, 0, t0=0, t1=900), walk("a", 1, 400, 0, t0=1000, t1=1500), far[1])
    assert got["b", 2][0] == 1 and got["a", 1][0] != 1
    # the track stitched to the one that leaves goes with it, a later one stays
    got = settle([("a", 1, 1, 0.9, 1000, 1500), ("b", 2, 1, 0.82, 1000, 1500), ("b", 4, 1, 0.8, 1550, 1700), ("b", 5, 1, 0.8, 4000, 4500)], *far, walk("b", 4, 20, 0, t0=1550, t1=1700), walk("b", 5, 5, 0, t0=4000, t1=4500))
    assert got["b", 4][0] == got["b", 2][0] != 1 and got["b", 5][0] == 1
    got = settle([("a", 1, 1, None, 1000, 1500), ("b", 2, 1, None, 1100, 1500)], *far)
    assert got["a", 1][0] == 1 and got["b", 2][0] != 1
    # reach is judged where a track comes first after the last sighting, not where the conflict begins
    rows = [("c", 3, 1, None, 0, 950), ("a", 1, 1, 0.9, 1000, 2500), ("b", 2, 1, 0.8, 2000, 2500)]
    got = settle(rows, walk("c", 3, 0, 0, t0=0, t1=950), walk("a", 1, 40, 0, t0=1000, t1=2500), walk("b", 2, 1, 0, t0=2000, t1=2500))
    assert got["b", 2][0] == 1 and got["a", 1][0] != 1
    # both in reach: the surer one stays
    got = settle([("c", 3, 1, None, 0, 900), ("a", 1, 1, 0.9, 1000, 1500), ("b", 2, 1, 0.82, 1000, 1500)], walk("c", 3, 10, 0, t0=0, t1=900), *far)
    assert got["a", 1][0] == 1 and got["b", 2][0] != 1
    # three cameras: the one that is far from the other two leaves, once
    got = settle([("a", 1, 1, 0.9, 1000, 1500), ("b", 2, 1, 0.8, 1000, 1500), ("c", 3, 1, 0.85, 1000, 1500)], *far, walk("c", 3, 1, 0, t0=1000, t1=1500))
    assert got["a", 1][0] == got["c", 3][0] == 1 and got["b", 2][0] != 1


def gallery(spark, rows, **more):
    """rows: camera, track, t0, x0, y0, t1, x1, y1, vector"""
    cols = "site_id string, session_id string, Camera string, Track_ID long, t0 long, x0 double, y0 double, t1 long, x1 double, y1 double, exemplars array<array<float>>, eligible boolean, threshold double"
    data = [("s", "d", c, k, t0, x0, y0, t1, x1, y1, [v] if v else None, bool(v), 0.8) for c, k, t0, x0, y0, t1, x1, y1, v in rows]
    return {(r.Camera, r.Track_ID): r.gid for r in identities.gallery_identities(spark.createDataFrame(data, cols), **more).collect()}


ME, YOU = [1.0, 0.0], [0.0, 1.0]


def at(camera, track, t0, x0, v, t1=None, x1=None):
    t1 = t0 + 200 if t1 is None else t1
    return (camera, track, t0, float(x0), 0.0, t1, float(x0 if x1 is None else x1), 0.0, v)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (at("a", 1, 0, 0, ME), at("b", 2, 2200, 25, ME), True),
        (at("a", 1, 0, 0, ME, t1=100), at("b", 2, 600, 500, ME), False),
        (at("a", 1, 0, 0, ME), at("b", 2, 2200, 25, YOU), False),
        (at("a", 1, 0, 0, ME), at("b", 2, 0, 1, ME), True),
        (at("a", 1, 0, 0, ME), at("b", 2, 0, 1, YOU), False),
        (at("a", 1, 0, 0, ME, t1=3000), at("a", 2, 2000, 1, ME), False),
    ],
)
def test_gallery(spark, a, b, same):
    got = gallery(spark, [a, b])
    assert (got["a", 1] == got[b[0], 2]) is same


def test_gallery_retention_and_numbers(spark):
    for gap, same in ((5900, True), (6100, False)):
        got = gallery(spark, [at("a", 1, 0, 0, ME), at("b", 2, 200 + gap, 0, ME)], retention_s=60)
        assert (got["a", 1] == got["b", 2]) is same
    got = gallery(spark, [at("a", 1, 0, 0, ME), at("b", 2, 100000, 0, ME), at("a", 3, 500, 0, None)])
    assert got == {("a", 3): 1, ("a", 1): 2, ("b", 2): 3}


def test_gallery_window_is_matched_as_a_whole(spark):
    p, q, both = [1.0, 0.0], [0.0, 1.0], [2**-0.5, 2**-0.5]
    rows = [at("a", 1, 0, 0, p), at("a", 2, 0, 5, q), at("b", 3, 2000, 1, [0.98, 0.199]), at("b", 4, 2000, 2, both)]
    data = gallery(spark, [(*r[:8], r[8]) for r in rows])
    assert data["b", 3] == data["a", 1] and data["b", 4] not in (data["b", 3],)


def test_gallery_bars_and_strangers(spark):
    alike = [0.8, 0.6]
    assert len(set(gallery(spark, [at("a", 1, 0, 0, ME), at("b", 2, 2000, 5, alike)]).values())) == 1  # at the bar of 0.8
    cols = "site_id string, session_id string, Camera string, Track_ID long, t0 long, x0 double, y0 double, t1 long, x1 double, y1 double, exemplars array<array<float>>, eligible boolean, threshold double"
    for bar, n in ((0.75, 1), (0.85, 2)):
        rows = [("s", "d", c, k, t, x, 0.0, t + 200, x, 0.0, [v], True, bar) for c, k, t, x, v in (("a", 1, 0, 0.0, ME), ("b", 2, 2000, 5.0, alike))]
        assert len({r.gid for r in identities.gallery_identities(spark.createDataFrame(rows, cols)).collect()}) == n
    # strangers at once in two cameras are two, also far apart and alike
    assert len(set(gallery(spark, [at("a", 1, 0, 0, ME), at("b", 2, 0, 30, ME)]).values())) == 2
    # two of one camera are never one, whoever else they look like
    got = gallery(spark, [at("a", 1, 0, 0, ME), at("a", 2, 50, 1, ME), at("b", 3, 20, 0, ME)])
    assert got["a", 1] != got["a", 2] and got["b", 3] in (got["a", 1], got["a", 2])


def test_gallery_forgets_and_prunes():
    views = np.array([[1.0, 0.0], [0.0, 1.0], [0.999, 0.0447], [0.6, 0.8]])
    assert identities.varied(views, 4) is views
    assert identities.varied(views, 3).tolist() == views[[1, 2, 3]].tolist()
    assert identities.varied(views, 2).tolist() == views[[2, 3]].tolist()
    known = identities.Known.none()
    seen = pd.DataFrame({"ident": [0, 1], "Camera": ["a", "b"], "s1": [10.0, 400.0], "x1": [0.0, 1.0], "y1": [0.0, 1.0]})
    known.learn(seen, [views, views[:1]], 3)
    assert len(known.views[0]) == 3 and sorted(known.last.index) == [0, 1]
    known.forget(350.0)
    assert list(known.last.index) == list(known.views) == list(known.exits.ident) == [1]


def test_gallery_in_chunks_is_the_gallery_as_a_whole(spark, monkeypatch):
    r = np.random.default_rng(12)
    rows, t = [], 0
    for k in range(60):
        t += int(r.choice([0, 40, 300, 2000, 33_000], p=[0.3, 0.3, 0.2, 0.15, 0.05]))
        v = r.normal(size=4)
        who = np.eye(4)[int(r.integers(4))] + 0.2 * v
        rows.append(at(str(r.choice(["a", "b", "c"])), k, t, float(r.integers(0, 6)), [float(x) for x in who / np.linalg.norm(who)]))
    parted = gallery(spark, rows)
    monkeypatch.setattr(identities, "gallery_chunks", lambda tracks, _: tracks.withColumn("chunk", F.lit(1).cast("long")))
    assert gallery(spark, rows) == parted and len(set(parted.values())) < 60


def test_alignment(spark):
    eye = lambda dx: [1.0, 0.0, dx, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    s = spark.createDataFrame([("s", "d", "c", t, eye(x) if x is not None else None) for t, x in ((0, 0.0), (100, 10.0), (200, None), (2000, 50.0))], "site_id string, session_id string, Camera string, ts_cs long, H array<double>")
    rows = spark.createDataFrame([("s", "d", "c", t, 100.0, 100.0) for t in (50, 350, 1100, 1900, 2400, -400)], "site_id string, session_id string, Camera string, ts_cs long, Foot_X double, Foot_Y double")
    got = {r.ts_cs: r.Foot_X for r in alignment.aligned(rows, s).collect()}
    assert got == {50: 105.0, 350: 110.0, 1100: None, 1900: 150.0, 2400: None, -400: None}


def test_alignment_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(8)
    times = sorted(set(map(int, r.integers(-3000, 9000, 60))))
    marks = [(t, float(r.integers(0, 99))) for t in times if not 2000 < t < 4000]
    asked = sorted({*range(-4000, 10000, 50), *times, *(t + d for t in times for d in (-600, -300, 300, 600))})

    def brute(t):
        a, b = max((m for m in marks if m[0] < t), default=None), min((m for m in marks if m[0] >= t), default=None)
        if a and b and b[0] - a[0] <= 600:
            return a[1] + (b[1] - a[1]) * (t - a[0]) / (b[0] - a[0]) if min(t - a[0], b[0] - t) <= 300 else None
        near = min((abs(m[0] - t), m[0], m[1]) for m in (a, b) if m)
        return near[2] if near[0] <= 300 else None

    s = spark.createDataFrame([("s", "d", "c", t, [x]) for t, x in marks], "site_id string, session_id string, Camera string, ts_cs long, H array<double>")
    rows = spark.createDataFrame([("s", "d", "c", t) for t in asked], "site_id string, session_id string, Camera string, ts_cs long")
    for block in (600, 777, 60_000):
        monkeypatch.setattr(alignment, "BLOCK_CS", block)
        out = alignment.bracketed(rows, s)
        # a frame that shrinks from row to row is computed anew for each
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
        got = {x.ts_cs: x.H and round(x.H[0], 9) for x in out.collect()}
        assert got == {t: None if (y := brute(t)) is None else round(y, 9) for t in asked}


def test_every_observation_on_the_clock_and_aligned(spark, sf_dir):
    for name in ("session_clock_asof", "alignment_asof_blend"):
        out = queries.QUERIES[name](spark, sf_dir)
        assert out.count() == queries.observations(spark, sf_dir).count()


def test_session_clock(spark):
    seg = spark.createDataFrame([("s", "d", "c", 0, 0.0, -22.47), ("s", "d", "c", 1, 359.92, 486.78)], "site_id string, session_id string, Camera string, segment long, from_s double, start_s double")
    rows = spark.createDataFrame([("s", "d", "c", 7, 100.0), ("s", "d", "c", 7, 400.0), ("s", "d", "z", 7, 10.0)], "site_id string, session_id string, Camera string, Track_ID long, video_s double")
    got = sorted((round(r.session_s, 2), r.Track_ID) for r in detections.on_session_clock(rows, seg).collect())
    assert got == [(10.0, 7), (77.53, 7), (526.86, 1000007)]


def test_clock_offset(spark):
    r = np.random.default_rng(3)
    parts = []
    for i in range(60):
        x, y = r.uniform(0, 20, 2)
        vx, vy = r.normal(0, 0.6, 2)
        t = int(r.integers(0, 2000)) * 20
        parts.append(walk("a", i, x, y, vx, vy, t0=t, t1=t + 2000, step=20))
        parts.append([(*row[:5], row[5] - 3740, (row[5] - 3740) / 100, row[7] + 0.1, *row[8:]) for row in walk("b", i, x, y, vx, vy, t0=t, t1=t + 2000, step=20)])
    got = clocksync.offset(frame(spark, *parts), "a", "b").first()
    assert got.reliable and abs(got.offset_s - 37.4) < 0.3
    away = [[(*row[:7], row[7] + (500 if row[2] == "b" else 0), *row[8:]) for row in p] for p in parts]
    assert clocksync.offset(frame(spark, *away), "a", "b").count() == 0


def test_homography(spark):
    true = np.array([[0.02, 0.003, -8.0], [-0.001, 0.05, -12.0], [0.00002, -0.0008, 1.0]])
    r = np.random.default_rng(2)
    pix = r.uniform([100, 100], [1800, 900], (10, 2))
    ground = georeference._apply(true, pix) + r.normal(0, 0.05, (10, 2))
    rows = [("s", "c", i, *map(float, pix[i]), *map(float, ground[i])) for i in range(10)]
    cal = georeference.calibrated(spark.createDataFrame(rows, "site_id string, Camera string, idx long, px double, py double, gx double, gy double"))
    got = cal.first()
    assert np.hypot(*(georeference._apply(np.array(got.H).reshape(3, 3), pix) - georeference._apply(true, pix)).T).max() < 0.3
    assert got.residual_mean < 0.15 and len(got.planes) >= 3
    full = cal.withColumns({"mode": F.lit("local"), "utm_epsg": F.lit(32616), "origin": F.array(F.lit(0.0), F.lit(0.0))})
    pixels = spark.createDataFrame([("s", "d", "c", 900.0, 900.0), ("s", "d", "c", 900.0, 3000.0), ("s", "d", "c", None, None), ("s", "d", "x", 1.0, 1.0)], "site_id string, session_id string, Camera string, Foot_X double, Foot_Y double")
    out = georeference.georeferenced(pixels, full).collect()
    by = {(r.Camera, r.Foot_Y): (r.Local_X_Meters is not None, r.Beyond_Horizon, r.Longitude) for r in out}
    assert by["c", 900.0] == (True, False, None) and by["c", 3000.0] == (False, True, None)
    assert by["c", None][:2] == (False, False) and by["x", 1.0][:2] == (False, False)


def test_utm(spark):
    df = spark.createDataFrame([(-86.9, 40.4), (151.2, -33.9), (2.35, 48.85)], "lon double, lat double")
    zone = geo.zone_of(F.col("lon"), F.col("lat"))
    e, n = geo.to_utm(F.col("lon"), F.col("lat"), zone)
    out = df.select(zone.alias("z"), e.alias("e"), n.alias("n"), "lon", "lat")
    lon, lat = geo.to_lonlat(F.col("e"), F.col("n"), F.col("z"))
    for r in out.withColumns({"a": lon, "b": lat}).collect():
        assert abs(r.a - r.lon) < 1e-9 and abs(r.b - r.lat) < 1e-9
    assert [r.z for r in out.collect()] == [32616, 32756, 32631]


def test_four_points(spark):
    d = spark.range(1).select(*(c for p in geo.four_points(*(F.lit(x) for x in (3.0, 4.0, 3.0, 4.0, 5.0))) for c in p))
    a = d.first()
    assert np.allclose([a[2], a[3], a[4], a[6], a[7]], [1.8, -2.4, 5.0, 3.2, 2.4])


def test_spacing_thins_when_full(spark):
    rows = views.view_sets(frame(spark, walk("c", 1, 0, 0, t1=2000)))
    out = views.spaced_views(rows, 0.2, 60).collect()
    assert 30 <= len(out) <= 60
    gap = frame(spark, walk("c", 1, 0, 0, t1=100), walk("c", 1, 0, 0, t0=800, t1=900))
    assert {r.view_set for r in views.view_sets(gap).collect()} == {0, 1}


def test_merges_by_part_are_those_of_the_session(spark):
    """Random tracks and edges of two sessions, walked through as a whole in plain Python."""
    r = np.random.default_rng(21)
    rows, breaks, pairs = [], [], []
    for day in ("d", "e"):
        for k in range(60):
            t0 = int(r.integers(0, 4000))
            rows.append(("s", day, "abc"[k % 3], k, int(r.integers(1, 50)) if k % 5 else k + 100, None, t0, t0 + int(r.integers(100, 900))))
        one, two = r.integers(0, 60, 90), r.integers(0, 60, 90)
        breaks += [("s", day, "abc"[a % 3], int(a), int(b), float(r.random())) for a, b in zip(one, two) if a % 3 == b % 3 and a != b]
        pairs += [("s", day, "abc"[a % 3], int(a), "abc"[b % 3], int(b), int(r.integers(4, 9)), float(r.integers(0, 9)) / 6) for a, b in zip(one, two) if a % 3 < b % 3]
    t = spark.createDataFrame(rows, "site_id string, session_id string, Camera string, Track_ID long, gid long, Confidence double, t0 long, t1 long")
    found = identities.stitched(t, spark.createDataFrame(breaks, "site_id string, session_id string, Camera string, a long, b long, error double"))
    handed = identities.handed_off(t, spark.createDataFrame(pairs, "site_id string, session_id string, camera_a string, a long, camera_b string, b long, n long, d double"))
    for name, got in (("stitched", found), ("handed", handed)):
        want, moved = {}, 0
        for day in ("d", "e"):
            own = [x for x in rows if x[1] == day]
            ids = Identities([x[4] for x in own], [(x[2], x[3]) for x in own], [x[6] for x in own], [x[7] for x in own])
            if name == "stitched":
                for x in sorted((x for x in breaks if x[1] == day), key=lambda x: (x[2], x[5], x[3], x[4])):
                    moved += ids.merge((x[2], x[3]), (x[2], x[4]))
            else:
                taken = set()
                for x in sorted((x for x in pairs if x[1] == day), key=lambda x: (x[7], -x[6], *x[2:6])):
                    p, q = (x[2], x[3]), (x[4], x[5])
                    if (p, q[0]) not in taken and (q, p[0]) not in taken:
                        taken |= {(p, q[0]), (q, p[0])}
                        moved += ids.merge(p, q)
            want |= {(day, *k): g for k, g in ids.of.items()}
        assert {(x.session_id, x.Camera, x.Track_ID): x.gid for x in got.collect()} == want and moved > 5
