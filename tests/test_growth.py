"""Steps whose rows must not grow with the square of what lies in one place: what they hold and that they are exact."""

from __future__ import annotations

import numpy as np
import pytest

from seatrace.functions.geo import EARTH_RADIUS_M
from seatrace.operators import spatial


def metres(a, b):
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[..., 0] - a[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((b[..., 1] - a[..., 1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(h)))


@pytest.mark.parametrize("sent", [20_000, 0])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_many_places_at_one_spot(spark, monkeypatch, n, sent):
    monkeypatch.setattr(spatial, "_SENT", sent)
    monkeypatch.setattr(spatial, "_SPOTS", 3)
    rng = np.random.default_rng(5)
    spots = np.column_stack([rng.uniform(10, 10.2, 40), rng.uniform(179.9, 180.1, 40)])
    spots[:, 1] = (spots[:, 1] + 180) % 360 - 180
    places = [(k, float(spots[k % 40, 0]), float(spots[k % 40, 1])) for k in range(400)]
    points = np.column_stack([rng.uniform(10, 10.2, 60), (rng.uniform(179.9, 180.1, 60) + 180) % 360 - 180])
    points[0] = spots[7]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(60, None, 1.0)], "id long, latitude double, longitude double")
    there = spark.createDataFrame(places, "place long, latitude double, longitude double")
    assert spatial._spots(there, n).count() == 40
    got = {r["id"]: r for r in spatial.nearest_places(df, there, keys=["id"], n_nearest=n, radius_m=4000.0).collect()}
    assert len(got) == 61 and got[60]["n_within"] == 0
    for i, p in enumerate(points):
        d = metres(p, spots)
        want = sorted((float(d[k % 40]), k) for k in range(400) if d[k % 40] <= 4000)
        assert got[i]["n_within"] == len(want)
        assert [got[i][f"{j}_place"] for j in range(n)] == ([k for _, k in want] + [None] * n)[:n]
        assert all(abs(got[i][f"{j}_dist_m"] - want[j][0]) < 1e-6 for j in range(min(n, len(want))))


def test_search_equals_the_loop_it_replaces():
    from seatrace.operators.pairing import _search

    rng = np.random.default_rng(3)
    for ships, dets, most in ((1, 1, 1), (5, 2, 1000), (40, 2, 1000), (3, 3, 50), (12, 4, 200), (2, 5, 1000), (60, 9, 1000)):
        d = rng.integers(0, 30, (ships, dets)) * 1.0
        assert _search(d, most) == _plain_search(d, most)


def _plain_search(d, most):
    from itertools import islice, permutations

    from seatrace.operators.pairing import OVERFLOW_M

    ships, dets = d.shape
    d = np.vstack([d, np.full((max(0, dets - ships), dets), OVERFLOW_M)])
    by = sorted((d[s, k], s, k) for s in range(len(d)) for k in range(dets))
    first, used = {}, set()
    for _, s, k in by:
        if k not in first and s not in used:
            first[k] = s
            used.add(s)
    order = [first[k] for k in range(dets)]
    order += dict.fromkeys(s for _, s, _ in by if s not in used)
    depth = dets
    while dets > 1 and depth < len(order) and np.prod(np.arange(depth + 2 - dets, depth + 2, dtype=float)) < most:
        depth += 1
    best, mean, better, last, count = order[:dets], d[order[:dets], np.arange(dets)].mean(), 0, 0, 0
    for count, perm in enumerate(islice(permutations(order[:depth], dets), most)):
        m = d[list(perm), np.arange(dets)].mean()
        if m < mean - 1e-12:
            best, mean, better, last = list(perm), m, better + 1, count
    return best, better, last, count + 1


@pytest.mark.parametrize("cells", [64, 1, 0])
def test_ships_meet_detections_by_hours_of_their_way(spark, monkeypatch, cells):
    """Fast and slow ships, a gap of days, the date line, a place that is missing: with all, some and no hours dealt to cells."""
    from seatrace.operators import clock, pairing

    monkeypatch.setattr(pairing, "_SLICE_CELLS", cells)
    rng = np.random.default_rng(11)
    base = 1_700_000_000
    rows = []
    for m in range(6):
        at = np.sort(rng.integers(0, 86400, 12)) + base
        speed = (0.01, 0.05, 2.0)[m % 3]
        for t, a, o in zip(at, 10 + np.cumsum(rng.normal(0, speed, 12)), 179.9 + np.cumsum(rng.normal(0, speed, 12)), strict=True):
            rows.append((m, int(t), float(np.clip(a, -80, 80)), float((o + 180) % 360 - 180)))
    rows.append((7, base + 500, None, 1.0))
    reports = spark.createDataFrame(rows, "mmsi long, s long, latitude double, longitude double").selectExpr("mmsi", "cast(timestamp_seconds(s) as timestamp_ntz) timestamp", "latitude", "longitude")
    dets = [(k, int(base + rng.integers(0, 86400)), float(10 + rng.normal(0, 0.2)), float((179.9 + rng.normal(0, 0.2) + 180) % 360 - 180)) for k in range(300)]
    dets += [(300 + i, s, a, o) for i, (_, s, a, o) in enumerate(rows) if a is not None]
    asked = spark.createDataFrame(dets, "det_id long, s long, latitude double, longitude double").selectExpr("det_id", "cast(timestamp_seconds(s) as timestamp_ntz) timestamp", "latitude", "longitude")
    got = {(r["det_id"], r["mmsi"]): (r["dist_m"], r["timestamp_nearest"]) for r in pairing.candidates(asked, reports, threshold_sec=7200.0, threshold_m=20_000.0).collect()}
    want = {}
    ships = clock.at_instants(reports, asked, ["latitude", "longitude"]).collect()
    for d in asked.collect():
        for s in ships:
            if s["timestamp"] == d["timestamp"] and s["latitude"] is not None and abs((s["timestamp_nearest"] - s["timestamp"]).total_seconds()) < 7200:
                m = float(metres(np.array([s["latitude"], s["longitude"]]), np.array([d["latitude"], d["longitude"]])))
                if m <= 20_000:
                    want[d["det_id"], s["mmsi"]] = (m, s["timestamp_nearest"])
    assert len(want) > 70 and got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and got[k][1] == want[k][1] for k in want)


@pytest.mark.parametrize("lat, lon", [(10.0, 179.999), (89.98, 0.0), (-60.0, 30.0)])
def test_crowds_of_neighbours_are_not_pairs_of_rows(spark, monkeypatch, lat, lon):
    """Counts and nearest ships against brute force in blocks cut small; no plan joins ships with ships."""
    from datetime import datetime, timedelta

    monkeypatch.setattr(spatial, "_AT_ONCE", 64)
    rng = np.random.default_rng(2)
    n, wide = 240, 0.02 / max(0.02, np.cos(np.radians(lat)))
    places = np.column_stack([np.clip(lat + rng.uniform(-0.02, 0.02, n), -90, 90), (lon + rng.uniform(-wide, wide, n) + 180) % 360 - 180])
    places[5] = places[6] = places[7]
    rows = [(datetime(2024, 1, 1) + timedelta(hours=i % 2), i, float(a), float(o)) for i, (a, o) in enumerate(places)]
    df = spark.createDataFrame([*rows, (datetime(2024, 1, 1), 999, None, 1.0)], "timestamp timestamp_ntz, mmsi long, latitude double, longitude double")
    out = spatial.neighbors(df, n_nearest=3, radius_m=500.0)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["mmsi"]: r for r in out.collect()}
    assert len(got) == n + 1 and got[999]["n_within"] == 0 and got[999]["0_mmsi"] == -1
    for i in range(n):
        own = [j for j in range(n) if j != i and j % 2 == i % 2]
        d = metres(places[i], places[own])
        want = sorted((round(float(x), 6), j) for x, j in zip(d, own, strict=True) if x <= 500)
        assert got[i]["n_within"] == len(want)
        assert [got[i][f"{k}_mmsi"] for k in range(3)] == ([j for _, j in want] + [-1] * 3)[:3]
        assert [round(got[i][f"{k}_dist_m"], 6) for k in range(min(3, len(want)))] == [x for x, _ in want[:3]]


def test_hours_without_reports_are_not_gathered(spark):
    """Two reports a month apart: 700 hours, of which only those of the reports are shuffled and folded."""
    from datetime import datetime

    from seatrace.operators import clock

    rows = [(1, datetime(2024, 1, 1, 0, 30), 10.0, 20.0), (1, datetime(2024, 1, 30, 4, 0), 12.0, 21.0), (1, datetime(2024, 1, 30, 4, 0), 12.0, 21.0), (2, datetime(2024, 1, 1), None, 1.0), (2, datetime(2024, 1, 1, 3), 5.0, 1.0)]
    df = spark.createDataFrame(rows, "mmsi long, timestamp timestamp_ntz, latitude double, longitude double")
    out = clock.trajectory_features(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    got = {(r["mmsi"], r["bin"]): r for r in out.collect()}
    assert len(got) == 29 * 24 + 5 + 4
    assert got[1, datetime(2024, 1, 1)]["count"] == 2 and got[1, datetime(2024, 1, 30, 4)]["count"] == 1 and got[1, datetime(2024, 1, 30, 4)]["path_m"] is None
    one = got[1, datetime(2024, 1, 9, 7)]
    assert one["count"] == 2 and one["path_m"] == one["end2end_m"] and abs(one["excursion_m"] * 2 - one["path_m"]) < 0.5
    assert got[2, datetime(2024, 1, 1, 1)]["mean_latitude"] is None and got[2, datetime(2024, 1, 1, 1)]["count"] == 2


@pytest.mark.parametrize("most", [1, 1000])
def test_pairs_need_the_nearest_candidates_only(spark, monkeypatch, most):
    """A crowd of ships: the same pairs from near candidates as from all, of which there are many more."""
    from datetime import datetime, timedelta

    from seatrace.operators import pairing

    rng = np.random.default_rng(4)
    noon = datetime(2024, 5, 1, 12)
    ships = [(m, noon + timedelta(minutes=t), float(a), float(o)) for m, (a, o) in enumerate(np.column_stack([rng.normal(10, 0.02, 900), rng.normal(20, 0.02, 900)])) for t in (-60, 0, 60)]
    dets = [(k, noon + timedelta(minutes=k // 5), float(a), float(o)) for k, (a, o) in enumerate(np.column_stack([rng.normal(10, 0.03, 60), rng.normal(20, 0.03, 60)]))]
    dets.append((60, noon, 10.5, 20.0))
    reports = spark.createDataFrame(ships, "mmsi long, timestamp timestamp_ntz, latitude double, longitude double")
    asked = spark.createDataFrame(dets, "det_id long, timestamp timestamp_ntz, latitude double, longitude double")
    limits = {"threshold_sec": 7200.0, "threshold_m": 8000.0}
    few = pairing._enough_candidates(asked, reports, 7200.0, 8000.0, most).count()
    assert few < pairing.candidates(asked, reports, **limits).count() / 2
    names = ["det_id", "timestamp", "mmsi", "timestamp_nearest", "cluster", "greedy_count", "last_improvement", "last_iter", "dist_m"]
    key = lambda r: (*r[:8], None if r[8] is None else round(r[8], 6))
    got = sorted(map(key, pairing.infer_identity(asked, reports, max_permutations=most, **limits).select(*names).collect()), key=str)
    want = sorted(map(key, pairing.sweep(asked, reports, [7200.0], [8000.0], [most]).select(*names).collect()), key=str)
    assert got == want and len(got) == 61 and sum(r[2] is not None for r in got) >= 59


def test_small_pieces_of_tracks_are_no_calls_of_their_own(spark):
    """Two hundred ships, each of two linked reports and one far off: met in streams, with the branches that they had."""
    from seatrace.operators import stays

    rows = [(m, t, a, 0.0, None) for m in range(200) for t, a in ((0, 0.1), (60_000_000, 0.1), (120_000_000, 0.5))]
    out = stays.linked(spark.createDataFrame(rows, "mmsi long, us long, lat double, lon double, old long"), speed_m_sec=1.0, gap_sec=3600.0)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["mmsi"], r["us"], r["start"]) for r in out.collect()) == [(m, t, 0 if t < 120_000_000 else t) for m in range(200) for t in (0, 60_000_000, 120_000_000)]


def test_shuffle_files_of_a_written_table_are_gone(spark):
    import time
    from pathlib import Path

    from pyspark.sql import functions as F

    from seatrace.storage import _CLEANUP, discard, written

    files = lambda: {p for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    before, table = files(), None
    try:
        table = written(spark.range(200_000).repartition(5, F.xxhash64("id")), "brief")
        assert table.count() == 200_000 and spark.conf.get(_CLEANUP, "false") == "false"
        for _ in range(50):  # they are deleted beside the session's work; the count shuffles a few bytes of its own
            left = sum(p.stat().st_size for p in files() - before if p.exists())
            if left < 100_000:
                break
            time.sleep(0.1)
        assert left < 100_000
    finally:
        discard(table)


def test_permutations_share_their_candidates(spark):
    import datetime as dt

    from seatrace.operators import pairing

    at = lambda h: dt.datetime(2024, 1, 1, h)
    reports = spark.createDataFrame([(s, at(h), 20.0 + 0.004 * s, -80.0) for s in range(5) for h in (0, 2)], "mmsi long, timestamp timestamp_ntz, latitude double, longitude double")
    dets = spark.createDataFrame([(d, at(1), 20.001 + 0.003 * d, -80.0) for d in range(3)] + [(9, at(1), 40.0, 0.0)], "det_id long, timestamp timestamp_ntz, latitude double, longitude double")
    both = pairing.sweep(dets, reports, [14400.0], [2000.0], [1, 1000])
    alone = [pairing.sweep(dets, reports, [14400.0], [2000.0], [p]) for p in (1, 1000)]
    want = sorted(str(r) for one in alone for r in one.collect())
    assert sorted(str(r) for r in both.collect()) == want and len(want) == 8
    assert "sequence(0, 1" not in both._jdf.queryExecution().logical().toString()  # a detection's list isn't made twice


def test_loitering_is_met_in_streams(spark):
    """Two hundred ships at rest, each with a jump: no call of Python for each of their pieces, and one shuffle before it."""
    from datetime import datetime, timedelta

    from seatrace.operators import stays

    noon = datetime(2024, 5, 1, 12)
    rows = [(m, noon + timedelta(hours=h), 10.0 + (h >= 3) + 0.001 * (h % 3), 20.0) for m in range(200) for h in range(6)]
    df = spark.createDataFrame(rows, "mmsi long, timestamp timestamp_ntz, latitude double, longitude double")
    found = stays.loiter_candidates(df, 2000.0)
    out = stays.loitering(df, 2000.0)
    for x, most in ((found, 1), (out, 2)):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and plan.count("Exchange") <= most
    assert sorted((r["mmsi"], r["n"], r["begin"]) for r in found.collect()) == [(m, 3, noon + timedelta(hours=h)) for m in range(200) for h in (0, 3)]
    got = {(r["mmsi"], (r["timestamp"] - noon).seconds // 3600): (r["loiter_sec"], r["loiter_rank"]) for r in out.collect()}
    assert got == {(m, h): ((h % 3) * 3600.0, int(h < 3)) for m in range(200) for h in range(6)}


def test_boosting_runs_in_as_few_tasks_as_its_rows_need(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from seatrace.operators import learning

    df = spark.range(0, 90, 1, 12).select("id", array_to_vector(F.array(F.col("id") % 7 * 1.0, F.col("id") % 5 * 1.0)).alias("x"), (F.col("id") % 3 == 0).cast("double").alias("label"))
    asked, fit = [], Pipeline.fit

    def spy(self, data, *rest):
        asked.append(data.rdd.getNumPartitions())
        return fit(self, data, *rest)

    monkeypatch.setattr(Pipeline, "fit", spy)
    one = learning.train_trees(df, ["x"], "label", "gbt", trees=3)
    monkeypatch.setattr(learning, "BOOSTED_ROWS", 20)
    five = learning.train_trees(df, ["x"], "label", "gbt", trees=3)
    assert asked == [1, 5]
    rows = lambda m: sorted((r["id"], r["prediction"]) for r in m.transform(df).collect())
    assert rows(one) == rows(five)


def test_training_rows_go_through_the_harvest_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from seatrace.operators import learning, rules
    from seatrace.plans import domain

    small = "/root/testdata/sf0.001"
    wide = domain.harvested(spark, small).localCheckpoint()
    monkeypatch.setattr(domain, "harvested", lambda *_: wide)
    out = domain.labelled(spark, small)
    got = {r["mmsi"]: (list(r["x"]), r["label"]) for r in out.collect()}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    label = rules.behaviors(wide, domain._BEHAVIOR).groupBy("mmsi").agg((F.avg(F.col("loitering_at_sea").cast("double")) > 0.01).cast("double").alias("label"))
    filled = wide.select("mmsi", "timestamp", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in domain._FEATURES])
    want = {r["mmsi"]: (r["features"], r["label"]) for r in learning.sequences(filled, domain._FEATURES).join(label, "mmsi").collect()}
    assert got == want and got


def test_first_polygons_are_found_without_grouping_points(spark):
    """Overlapping squares over several cells: one row for each point throughout, and the first square by its number."""
    from seatrace.operators import spatial

    rng = np.random.default_rng(6)
    boxes = [(k, f"z{k}", float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 1, (20, 2)))]
    ring = lambda x, y: [(x, y), (x + 0.25, y), (x + 0.25, y + 0.25), (x, y + 0.25)]
    zones = spark.createDataFrame([(k, n, ring(x, y)) for k, n, x, y in boxes], "ord long, name string, ring array<struct<lon double, lat double>>")
    places = [(i, float(a), float(o)) for i, (a, o) in enumerate(rng.uniform(-0.1, 1.3, (500, 2)))] + [(500, None, 0.5)]
    points = spark.createDataFrame(places, "id long, latitude double, longitude double")
    out = spatial.first_polygon(points, zones, keys=["id"], cell=0.1)
    assert "Aggregate [id#" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["name"] for r in out.collect()}
    hit = lambda a, o: next((n for _, n, x, y in boxes if a is not None and x < o < x + 0.25 and y < a < y + 0.25), None)
    assert got == {i: hit(a, o) for i, a, o in places} and sum(n is not None for n in got.values()) > 100


@pytest.mark.parametrize("lat, lon", [(10.0, 179.999), (89.98, 0.0), (-60.0, 30.0)])
def test_pairs_of_neighbours_are_listed_where_they_meet(spark, lat, lon):
    """Against brute force, at the date line and near a pole; points are shuffled once and no plan joins ships with ships."""
    from datetime import datetime, timedelta

    rng = np.random.default_rng(12)
    n, wide = 200, 0.02 / max(0.02, np.cos(np.radians(lat)))
    places = np.column_stack([np.clip(lat + rng.uniform(-0.02, 0.02, n), -90, 90), (lon + rng.uniform(-wide, wide, n) + 180) % 360 - 180])
    places[5] = places[6]
    at = [datetime(2024, 1, 1) + timedelta(hours=i % 2) for i in range(n)]
    rows = [(at[i], i // 3 * 3 if i == 8 else i, float(a), float(o)) for i, (a, o) in enumerate(places)] + [(at[0], 999, None, 1.0), (at[0], None, lat, lon)]
    out = spatial.neighbor_pairs(spark.createDataFrame(rows, "timestamp timestamp_ntz, mmsi long, latitude double, longitude double"), 500.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    want = []
    for i, p in enumerate(rows[:n]):
        d = metres(places[i], places)
        want += [(p[0], p[1], rows[j][1], round(float(d[j]), 5)) for j in range(n) if rows[j][0] == p[0] and rows[j][1] != p[1] and d[j] <= 500]
    assert sorted((r["timestamp"], r["mmsi"], r["other"], round(r["dist_m"], 5)) for r in out.collect()) == sorted(want) and len(want) > 50
