"""The whole job twice, and counts as a stream."""

import glob
import json

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from groundtrack.jobs import observe
from groundtrack.jobs.fuse import fuse, replaced
from groundtrack.operators import detections, georeference, presence, views
from groundtrack.sources import calibrations
from groundtrack.sources import observations as source
from groundtrack.streaming.counts import presence_stream


def in_order(pattern, folder, order, across=False):
    """Rows of each file, or of a folder's files one after another, are in order."""
    folders = [f for f in glob.glob(str(folder / pattern)) if "=" in f.rsplit("/", 1)[-1]]
    assert folders
    for f in folders:
        files = [[tuple(r.values()) for r in pq.ParquetFile(p).read(order).select(order).to_pylist()] for p in sorted(glob.glob(f + "/*.parquet"))]
        for part in [sum(files, [])] if across else files:
            assert part == sorted(part)


def test_fuse_twice(spark, sf_dir, tmp_path):
    rows = source.from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).drop("ts_cs")
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("Track_ID"), F.col("embedding").alias("Vector"))
    first = rows.where("Class = 'person'").groupBy("site_id", "session_id", "Camera", "Track_ID").agg(F.min("Timestamp").alias("Timestamp"))
    prints = first.join(v, "Track_ID").withColumn("Height_Px", F.lit(80.0))
    out = [fuse(rows.repartition(n), prints, str(tmp_path / str(n))) for n in (3, 5)]
    key = lambda o: {(r.site_id, r.Camera, r.Track_ID, r.Global_ID) for r in o["fused"].where("Class = 'person'").select("site_id", "Camera", "Track_ID", "Global_ID").distinct().collect()}
    a, b = map(key, out)
    assert a == b and all(g for *_, g in a)
    assert out[0]["fused"].count() == rows.count()
    assert sorted(map(tuple, out[0]["counts"].collect())) == sorted(map(tuple, out[1]["counts"].collect()))
    folder = tmp_path / "3"
    found = {(m["site_id"], m["session_id"]): m["results"] for m in map(json.loads, (r.value for r in spark.read.text(str(folder / "manifest")).collect()))}
    assert set(found) == {tuple(r) for r in rows.select("site_id", "session_id").distinct().collect()}
    same = {(r.site_id, r.session_id): r["count"] for r in out[0]["vehicles"].groupBy("site_id", "session_id").count().collect()}
    assert all(m["vehicle_rows"] == same[k] and m["n_tracks"] >= m["n_identities"] > 0 and any(n.startswith("area_m2:") for n in m) for k, m in found.items())
    assert any(n.startswith("breaks_closed:") for m in found.values() for n in m)
    in_order("fused/*/*/*", folder, ["Timestamp"])
    for name, order in (("composite", ["Global_ID", "Timestamp"]), ("vehicles", ["Timestamp", "Class"]), ("counts", ["Interval_Start_s", "Category"])):
        in_order(f"{name}/*/*", folder, order, True)
    assert out[0]["composite"].groupBy("site_id", "session_id", "Global_ID", "bucket").count().where("count > 1").count() == 0


def test_a_run_replaces_its_own_sessions_only(spark, tmp_path):
    schema = "site_id string, session_id string, Camera string, n long"
    by, path = ["site_id", "session_id", "Camera"], str(tmp_path / "fused")

    def run(*rows, of=None):
        df = spark.createDataFrame(rows, schema)
        sessions = spark.createDataFrame(of, "site_id string, session_id string") if of else df.select("site_id", "session_id").distinct()
        return sorted(map(tuple, replaced(df, path, by, sessions).select("site_id", "session_id", "Camera", "n").collect()))

    everything = lambda: sorted(map(tuple, spark.read.schema(schema).parquet(path).select("site_id", "session_id", "Camera", "n").collect()))
    one = [("s", "d", "a", 1), ("s", "d", "b/1 =x", 2), ("s", "e", "a", 3)]
    assert run(*one) == one
    other = [("t", "d", "a", 4), ("t", "d", "a", 5)]
    assert run(*other) == other and everything() == one + other  # another site's run leaves the first
    assert run(*other) == other and everything() == one + other  # so does a rerun
    again = [("s", "d", "c", 6)]  # a session again, with other cameras: its old folders go, all else stays
    assert run(*again) == again and everything() == again + one[2:] + other
    assert run(of=[("t", "d")]) == [] and everything() == again + one[2:]  # nothing is left of a session
    assert not list((tmp_path / "fused" / "site_id=t").rglob("*.parquet"))


def test_two_sites_in_one_output(spark, sf_dir, tmp_path):
    rows = source.from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).drop("ts_cs").where("Timestamp < 60")
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") % 40).alias("Track_ID"), F.col("embedding").alias("Vector")).limit(40)
    prints = rows.where("Class = 'person'").groupBy("site_id", "session_id", "Camera", "Track_ID").agg(F.min("Timestamp").alias("Timestamp")).join(v, "Track_ID").withColumn("Height_Px", F.lit(80.0))
    sites = sorted(r.site_id for r in rows.select("site_id").distinct().collect())[:2]
    assert len(sites) == 2
    names = ("fused", "composite", "vehicles", "counts", "manifest")
    files = lambda site: {str(p): p.stat().st_mtime_ns for n in names for p in (tmp_path / n / f"site_id={site}").rglob("part-*")}
    fuse(rows.where(F.col("site_id") == sites[0]), prints, str(tmp_path))
    first = files(sites[0])
    assert len({p.split("/site_id=")[0] for p in first}) == len(names)
    out = fuse(rows.where(F.col("site_id") == sites[1]), prints, str(tmp_path))
    assert files(sites[0]) == first and files(sites[1])
    assert {r.site_id for r in out["fused"].select("site_id").distinct().collect()} == {sites[1]}
    assert not list((tmp_path / "work").iterdir())


def test_counts_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", "d", 60.0 + t / 10, "person (on foot)", f"g{i}") for t in range(1200) for i in range(2)] + [("s", "d", 900.0, "person (on foot)", "late")], "site_id string, session_id string, t double, Category string, Global_ID string")
    rows.select("site_id", "session_id", F.timestamp_seconds("t").alias("at"), "Category", "Global_ID").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = presence_stream(stream).writeStream.format("memory").queryName("present").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("present").orderBy("Interval_Start").collect()
    assert len(got) == 2 and all(r.Peak_Present == 2 and abs(r.Mean_Present - 2) < 0.1 for r in got)


def test_buckets_of_a_stream_may_be_of_any_length(spark, tmp_path):
    """Two people in every bucket of one second: two on average, whatever the length of a bucket."""
    rows = spark.createDataFrame([("s", "d", 60.0 + t / 2, "person (on foot)", f"g{i}") for t in range(240) for i in range(2)] + [("s", "d", 900.0, "person (on foot)", "late")], "site_id string, session_id string, t double, Category string, Global_ID string")
    rows.select("site_id", "session_id", F.timestamp_seconds("t").alias("at"), "Category", "Global_ID").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = presence_stream(stream, bucket="1 second").writeStream.format("memory").queryName("by_second").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("by_second").orderBy("Interval_Start").collect()
    assert [(r.Mean_Present, r.Peak_Present) for r in got][:2] == [(2.0, 2), (2.0, 2)]



def test_readers(spark, tmp_path):
    csv = tmp_path / "c.csv"
    from groundtrack import schema as S

    names = S.POSITIONS.fieldNames()
    row = {n: "" for n in names} | {"site_id": "s", "session_id": "d", "Camera": "7", "Class": "person", "Track_ID": "1", "Timestamp": "0.5", "Local_X_Meters": "1.5", "Local_Y_Meters": "2"}
    csv.write_text(",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n")
    got = source.read_positions(spark, [str(csv)], "csv").first()
    assert got.Camera == "7" and got.Foot_X is None and got.Local_X_Meters == 1.5
    np.savez(tmp_path / "v.npz", camera_ids=["a", "b"], track_ids=[1, 2], vectors=np.eye(2, dtype=np.float32))
    np.savez(tmp_path / "w.npz", camera_ids=["a"], track_ids=[3], vectors=np.ones((1, 2), np.float32), timestamps=[1.5], heights_px=[70.0])
    got = {r.Track_ID: r for r in source.read_fingerprints(spark, str(tmp_path / "*.npz")).collect()}
    assert len(got) == 3 and got[1].Height_Px is None and got[3].Timestamp == 1.5 and list(got[2].Vector) == [0.0, 1.0]
    source.write_observations(source.read_positions(spark, [str(csv)], "csv"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_positions_with_differing_columns(spark, tmp_path):
    one = "site_id string, session_id string, Camera string, Class string, Track_ID long, Timestamp double, Local_X_Meters double, Local_Y_Meters double"
    spark.createDataFrame([("s", "d", "a", "person", 1, 0.5, 1.0, 2.0)], one).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("s", "d", 7, "car", 2, 0.5, 1.0, 2.0, -86.9)], one.replace("Camera string", "Camera long") + ", Longitude double").write.parquet(str(tmp_path / "b"))
    got = {r.Camera: r.Longitude for r in source.read_positions(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()}
    assert got == {"a": None, "7": -86.9}


def test_vehicles_keep_their_place_on_earth(spark):
    row = ("s", "d", "a", 1, "car", 50, 1.0, 2.0, -86.9, 40.4, 5.0)
    rows = spark.createDataFrame([row, (*row[:2], "b", *row[3:6], 1.5, *row[7:10], 4.0)], "site_id string, session_id string, Camera string, Track_ID long, Class string, ts_cs long, Local_X_Meters double, Local_Y_Meters double, Longitude double, Latitude double, precision double")
    got = presence.vehicles(presence.vehicle_rows(rows)).collect()
    assert [(r.Source_Camera, r.Longitude, r.Latitude) for r in got] == [("a", -86.9, 40.4)]


def test_calibration_files(spark, tmp_path):
    lons, lats = [-86.9, -86.8999, -86.8998, -86.9, -86.8999], [40.4, 40.4, 40.4001, 40.4002, 40.4001]
    points = [{"video_xy": [100 * i, 50 + 70 * (i % 3)], "lat": lat, "lon": lon} for i, (lon, lat) in enumerate(zip(lons, lats))]
    (tmp_path / "p.json").write_text(json.dumps({"site_id": "s", "camera_id": "c", "points": points}, indent=1))
    read = calibrations.read_points(spark, str(tmp_path / "p.json"))
    got = georeference.grounded(read).orderBy("idx").collect()
    assert (got[0].gx, got[0].gy, got[0].utm_epsg) == (0.0, 0.0, 32616) and abs(got[1].gx - 8.49) < 0.02 and got[3].px == 300.0
    fixed = spark.createDataFrame([("s", 32616, [500000.0, 4470000.0])], "site_id string, utm_epsg int, origin array<double>")
    moved = georeference.grounded(read, fixed).orderBy("idx").collect()
    assert abs((moved[1].gx - moved[0].gx) - got[1].gx) < 1e-6 and moved[0].origin == [500000.0, 4470000.0]

    world = [[500010.0 + r.gx, 4470020.0 + r.gy] for r in got]
    entry = {"mode": "global", "cam_pixels": [p["video_xy"] for p in points], "utm_coords": world, "utm_epsg": 32616, "last_calibrated": "2026-01-02", "error_m": {"loo_median": 0.4}}
    local = {"mode": "local", "cam_pixels": [[1, 2]], "site_coords": [[3.0, 4.0]]}
    (tmp_path / "site7.json").write_text(json.dumps({"c": entry, "_note": {"mode": "none"}, "_by": "hand", "l": local}))
    registry = georeference.read_registry(spark, str(tmp_path / "site7.json"))
    assert {(r.site_id, r.Camera, tuple(r.origin)) for r in registry.collect()} == {("site7", "c", tuple(world[0])), ("site7", "l", tuple(world[0]))}
    back = {(r.Camera, r.idx): (r.px, r.gx, r.gy) for r in georeference.registry_points(registry).collect()}
    assert back["l", 0] == (1.0, 3.0, 4.0) and abs(back["c", 2][1] - got[2].gx) < 1e-6 and len(back) == 6

    video = {"v1": {"camera_id": "c", "start_timestamp": 5.5}, "v2": {"segments": [{"from_video_s": 60.0, "start_timestamp": 100.0}, {"from_video_s": 0.0, "start_timestamp": 7.0}]}, "v3": {}, "_about": "text"}
    (tmp_path / "map.json").write_text(json.dumps(video))
    got = {tuple(r) for r in calibrations.read_camera_map(spark, str(tmp_path / "map.json")).drop("reference_frame").collect()}
    assert got == {("v1", "c", 0, 0.0, 5.5), ("v2", "v2", 0, 0.0, 7.0), ("v2", "v2", 1, 60.0, 100.0), ("v3", "v3", 0, 0.0, 0.0)}


def test_new_cameras_of_a_new_site_share_an_origin(spark):
    schema = "site_id string, Camera string, mode string, utm_epsg int, origin array<double>"
    new = spark.createDataFrame([("n", "b", "global", 32617, [5.0, 6.0]), ("n", "a", "global", 32616, [1.0, 2.0]), ("o", "z", "global", 32616, [9.0, 9.0])], schema)
    old = spark.createDataFrame([("o", "y", "global", 32616, [7.0, 7.0])], schema)
    got = {(r.site_id, r.Camera): (r.utm_epsg, tuple(r.origin)) for r in georeference.upsert(old, new).collect()}
    assert got == {("n", "a"): (32616, (1.0, 2.0)), ("n", "b"): (32616, (1.0, 2.0)), ("o", "y"): (32616, (7.0, 7.0)), ("o", "z"): (32616, (7.0, 7.0))}


def test_boxes_to_observations_and_views(spark, tmp_path):
    schema = "site_id string, session_id string, Video string, frame_idx long, video_s double, Track_ID long, Class string, score double, x1 double, y1 double, x2 double, y2 double"
    box = lambda v, f, k, score, x=100.0, cls="person", h=80.0: ("s", "d", v, f, f / 10, k, cls, score, x, 50.0, x + 30.25, 50.0 + h)
    rows = [box("v1", f, 1, 0.9 if f == 2 else 0.2, h=80.0 + f % 7) for f in range(40)]  # weak until its third frame
    rows += [box("v1", f, 2, 0.95, x=110.0) for f in (10, 11)] + [box("v1", 0, 3, 0.9, cls="dog"), box("v2", 5, 1, 0.8), box("other", 5, 1, 0.8)]
    (tmp_path / "m.json").write_text(json.dumps({"v1": {"camera_id": "c", "segments": [{"from_video_s": 0.0, "start_timestamp": 7.0}, {"from_video_s": 3.0, "start_timestamp": 90.0}]}, "v2": {"camera_id": "c", "start_timestamp": 60.0}}))
    cameras = calibrations.read_camera_map(spark, str(tmp_path / "m.json"))
    got = observe.observed(spark.createDataFrame(rows, schema), cameras).collect()
    assert {(r.Camera, r.Track_ID, r.Timestamp) for r in got if r.Track_ID % 1000000 == 1} == {("c", 1, round(7 + f / 10, 2)) for f in range(2, 30)} | {("c", 1000001, round(90 + f / 10 - 3, 2)) for f in range(30, 40)} | {("c", 1, 60.5), ("other", 1, 0.5)}
    assert {r.Class for r in got} == {"person"} and {(r.Foot_X, r.Center_X) for r in got if r.Track_ID == 1} == {(115.1, 115.1)}
    assert len(observe.observed(spark.createDataFrame(rows, schema), cameras, 6).collect()) == 6

    sure = spark.createDataFrame([("s", "d", "c", k, t * 10, 0.9, x, 50.0, x + 30.0, 50.0 + h) for k, t, x, h in [(1, t, 100.0, 80.0 + t % 3) for t in range(30)] + [(2, 4, 100.0, 84.0), (2, 20, 1.0, 80.0), (3, 6, 128.0, 80.0)]], "site_id string, session_id string, Camera string, Track_ID long, ts_cs long, Detection_Conf double, x1 double, y1 double, x2 double, y2 double")
    clear = {(r.Track_ID, r.ts_cs) for r in detections.clear_views(sure, 640.0, 480.0).collect()}
    assert clear == {(1, t * 10) for t in range(30) if t != 4} | {(3, 60)}  # one box lies on another of its size, one at the edge; a sliver does not matter
    views_of = sorted((r.ts_cs, r.stretch, r.Height_Px) for r in views.fingerprint_views(sure, 640.0, 480.0, k=3).collect() if r.Track_ID == 1)
    taken = [0, 20] + [50 + 20 * n for n in range(13) if 50 + 20 * n < 300]
    tall = lambda ts: max(ts, key=lambda t: ((t // 10) % 3, -t))
    assert [t for t, _, _ in views_of] == [tall(list(part)) for part in np.array_split(taken, 3)]
