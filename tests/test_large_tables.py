"""What keeps the movement queries within a driver's and a disk's means on larger tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from groundtrack import queries
from groundtrack.operators import components, coverage, detections, identities, presence, quantiles, stitch
from groundtrack.queries import QUERIES

NAMES = "box_overlap_filter clear_views clock_offset cosighting_pairs coverage_areas coverage_cells fingerprint_views mined_frames handoff_identities riderless_rows run_summary settled_identities similarity_bars stranger_pairs stranger_scores travel_mode empty_frames even_sample soft_empty_frames".split()


def broadcasts(plan: str) -> list[str]:
    """The parts of a plan, in its tree form, that are sent to every executor."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = [line]
            for x in lines[i + 1 :]:
                if len(x) - len(x.lstrip(" :+-*")) <= depth:
                    break
                below.append(x)
            found.append("\n".join(below))
    return found


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_events_are_never_broadcast(spark, sf_dir, monkeypatch, name):
    """Events give some 45 rows each: where the file of events is below the bar of a broadcast, rows made of it are
    not. Cuts on the way are looked at too."""
    plans, real = [], components.cut

    def cut(df):
        plans.append(plan_of(df))
        return real(df)

    for module in (queries, components, identities, presence, quantiles, stitch):
        monkeypatch.setattr(module, "cut", cut)
    bar = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        plans.append(plan_of(QUERIES[name](spark, sf_dir)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bar)
    assert not [part for plan in plans for part in broadcasts(plan) if "events.parquet" in part]


def test_rows_meet_segments_of_their_block_only(spark):
    """A camera of 300 recordings: as a walk says, without a join that pairs a row with each of them."""
    dice = random.Random(3)
    starts = sorted({round(dice.uniform(0, 50_000), 1) for _ in range(300)})
    seg = [("s", "d", "c", n, at, at * 2 - 5) for n, at in enumerate(starts)]
    times = [round(dice.uniform(-500, 60_000), 2) for _ in range(2000)] + [starts[7], starts[-1], 0.0]
    rows = spark.createDataFrame([("s", "d", c, n, t) for n, t in enumerate(times) for c in ("c", "other")], "site_id string, session_id string, Camera string, Track_ID long, video_s double")
    got = detections.on_session_clock(rows, spark.createDataFrame(seg, "site_id string, session_id string, Camera string, segment long, from_s double, start_s double"))
    assert "video_s" not in "".join(x for x in plan_of(got).splitlines() if "Join" in x)
    want = []
    for n, t in enumerate(times):
        k = max([i for i, at in enumerate(starts) if at <= t], default=0)
        want += [("c", n + k * 1_000_000, round(starts[k] * 2 - 5 + t - starts[k], 6)), ("other", n, t)]
    assert sorted((r.Camera, r.Track_ID, round(r.session_s, 6)) for r in got.collect()) == sorted(want)


def test_small_parts_share_calls(spark, monkeypatch):
    """Breaks alone in their part are matched without Python, and the other parts are bundled, with the same choice."""
    dice = random.Random(5)
    edges = [("s", "d", f"cam{n % 3}", n * 10 + a, n * 10 + 5 + b, n * 1000 + 1, n * 1000 + 2, round(dice.random(), 6)) for n in range(60) for a in range(1 + n % 3) for b in range(1 + n % 2)]
    df = spark.createDataFrame(edges, "site_id string, session_id string, Camera string, a long, b long, t1 long, t0 long, error double")
    got = stitch.matched(df)
    assert "_bundle" in plan_of(got) and "_n" in plan_of(got)
    best = {}
    for n in range(60):
        own = [e for e in edges if e[3] // 10 == n]
        lefts, rights = sorted({e[3] for e in own}), sorted({e[4] for e in own})
        cost = {(e[3], e[4]): e[7] for e in own}
        few, many = (lefts, rights) if len(lefts) <= len(rights) else (rights, lefts)
        pairs = [list(zip(few, p, strict=True)) for p in itertools.permutations(many, len(few))]
        pairs = [[q if few is lefts else q[::-1] for q in p] for p in pairs]
        best[n] = min(sum(cost[q] for q in p) for p in pairs)
    rows = got.collect()
    total = {n: sum(r.error for r in rows if r.a // 10 == n) for n in range(60)}
    assert all(abs(total[n] - best[n]) < 1e-9 for n in range(60))


def test_rounds_of_vehicles_never_broadcast_what_is_not_few(spark, monkeypatch):
    """Pairs in a cut of a few megabytes may be millions of rows: only what is counted as few is broadcast."""
    plans, real = [], components.cut

    def seen(df):
        plans.append(plan_of(df))
        return real(df)

    monkeypatch.setattr(presence, "cut", seen)
    monkeypatch.setattr(presence, "sized", lambda df, n=None: components.sized(df, n, few=-1))
    dice = random.Random(2)
    rows = [("s", "d", n % 5, "car", f"c{n % 3}", n, n, dice.uniform(0, 40), dice.uniform(0, 40), float(dice.randrange(50))) for n in range(300)]
    df = spark.createDataFrame(rows, "site_id string, session_id string, bucket long, Class string, Camera string, Track_ID long, ts_cs long, Local_X_Meters double, Local_Y_Meters double, precision double")
    out = presence.vehicles(df)
    assert 0 < out.count() < 300 and "BroadcastExchange" not in "".join([*plans, plan_of(out)])


def test_a_vehicle_is_looked_for_in_two_cells_or_so(spark):
    """Rows are laid out for the cells that their radius touches, not for all nine neighbours, and no pair is lost."""
    dice = random.Random(4)
    rows = [("s", "d", 0, "car", f"c{n % 3}", n, dice.uniform(-200, 200), dice.uniform(-200, 200)) for n in range(1500)]
    df = spark.createDataFrame(rows, "site_id string, session_id string, bucket long, Class string, Camera string, n long, Local_X_Meters double, Local_Y_Meters double")
    got = presence._pairs(df, ["bucket", "Class", "site_id", "session_id"], 1500)
    want = {(i[5], k[5]) for i in rows for k in rows if k[5] < i[5] and k[4] != i[4] and (i[6] - k[6]) ** 2 + (i[7] - k[7]) ** 2 <= 36}
    assert sorted((r.i, r.k) for r in got.collect()) == sorted(want)
    assert "array((floor" not in plan_of(got)  # nine copies by arrays of neighbours


@pytest.mark.parametrize("name", ["composite_best_view", "composite_gap_fill", "counts_over_time"])
def test_few_areas_are_broadcast_and_rows_stay_narrow(spark, sf_dir, name):
    """The table of areas is counted and broadcast at any size of the events, so rows do not move for it, and no
    column moves that the result has not."""
    bar = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bar)
    assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and "Camera" in x] and "Detection_Conf" not in plan
