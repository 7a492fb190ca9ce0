"""Clusters in space and time, pairs by squared distance, and pairs joined back to reports, against plain versions."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random
from collections import Counter

import pytest

from seatrace.operators import pairing, space_time
from seatrace.plans import domain, registry

from .oracle import SF

SMALL = SF.replace("sf0.01", "sf0.001")
NOON = dt.datetime(2024, 5, 1, 12)


def metres(a, b):
    h = math.sin(math.radians(a[0] - b[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
    return 2 * 6_378_000.0 * math.asin(min(1, math.sqrt(h)))


def apart(a, b, ns_per_m):
    return math.hypot((a[3] - b[3]).total_seconds() * 1e9 / ns_per_m, metres(a[1:3], b[1:3]))


def plain_clusters(points, eps, ns_per_m, least):
    near = {p[0]: [q[0] for q in points if apart(p, q, ns_per_m) <= eps] for p in points}
    by = {p[0]: p for p in points}
    core = {i for i, n in near.items() if len(n) >= least}
    root = {i: i for i in core}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in core:
        for j in near[i]:
            if j in core:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    of = {i: top(i) for i in core}
    for i in near.keys() - core:
        found = [(apart(by[i], by[j], ns_per_m), j) for j in near[i] if j in core]
        if found:
            of[i] = top(min(found)[1])
    first = {}
    for i, c in of.items():
        first[c] = min(first.get(c, i), i)
    return {i: first[of[i]] if i in of else None for i in near}


@pytest.mark.parametrize("least", [1, 2, 4])
@pytest.mark.parametrize("lat, lon", [(0.0, 179.999), (60.0, -20.0), (89.9, 10.0)])
def test_clusters_equal_brute_force(spark, least, lat, lon):
    rng = random.Random(least)
    deg = 1 / max(0.02, math.cos(math.radians(lat)))
    points = []
    for k in range(160):
        hub = rng.randrange(9)
        spread = 0.002 if hub < 3 else 0.02
        y, x = lat + hub * 0.004 + rng.uniform(-spread, spread), lon + (hub * 0.006 + rng.uniform(-spread, spread)) * deg
        points.append((k * 7, min(90.0, y), (x + 180) % 360 - 180, NOON + dt.timedelta(seconds=rng.randrange(0, 2400, 60))))
    points += [(9000 + k, *points[3][1:]) for k in range(5)]  # equal points
    df = spark.createDataFrame(points, "det_id long, latitude double, longitude double, timestamp timestamp_ntz")
    for eps, ns in ((1200.0, 1e9), (3000.0, 1e8)):
        got = {r["det_id"]: r["cluster"] for r in space_time.clusters(df, eps_m=eps, ns_per_m=ns, min_points=least).collect()}
        assert got == plain_clusters(points, eps, ns, least)


def test_clusters_of_odd_tables(spark):
    schema = "det_id long, latitude double, longitude double, timestamp timestamp_ntz, row string"
    assert space_time.clusters(spark.createDataFrame([], schema), eps_m=10.0).collect() == []
    rows = [(1, None, 0.0, NOON, "x"), (2, 0.0, 0.0, None, "x"), (3, 0.0, 0.0, NOON, "x"), (4, 0.0, 0.0, NOON, "x")]
    got = {r["det_id"]: r["cluster"] for r in space_time.clusters(spark.createDataFrame(rows, schema), eps_m=10.0).collect()}
    assert got == {1: None, 2: None, 3: 3, 4: 3}
    with pytest.raises(ValueError):
        space_time.clusters(spark.createDataFrame([], schema), eps_m=0.0)


def test_dense_neighbouring_cells_are_linked_by_inner_points(spark):
    """Outermost points prove nothing here: only two inner points of two full cells are near each other."""
    side = space_time._side(1000.0)
    at = lambda r, k: (r + k) * side
    rows = [at(0, 0.5) for _ in range(1)] + [at(0, 0.02), at(0, 0.6)] + [at(2, 0.74), at(2, 0.3), at(2, 0.95)]
    points = [(i, y, 0.0, NOON) for i, y in enumerate(rows)]
    df = spark.createDataFrame(points, "det_id long, latitude double, longitude double, timestamp timestamp_ntz")
    got = {r["det_id"]: r["cluster"] for r in space_time.clusters(df, eps_m=1000.0).collect()}
    assert got == plain_clusters(points, 1000.0, 100.0, 1)


def test_space_time_pairs_have_the_least_squares(spark):
    rng = random.Random(11)
    reports, dets = [], []
    for g in range(12):
        y, x, t = rng.uniform(-50, 50), rng.uniform(-170, 170), NOON + dt.timedelta(hours=g)
        for k in range(rng.randrange(1, 5)):
            a, b = y + rng.uniform(-0.03, 0.03), x + rng.uniform(-0.03, 0.03)
            reports += [(g * 10 + k, t + dt.timedelta(seconds=s), a, b) for s in (-60, 60)]
        for k in range(rng.randrange(1, 5)):
            dets.append((g * 10 + k, t, y + rng.uniform(-0.03, 0.03), x + rng.uniform(-0.03, 0.03)))
    a = spark.createDataFrame(reports, "mmsi long, timestamp timestamp_ntz, latitude double, longitude double")
    b = spark.createDataFrame(dets, "det_id long, timestamp timestamp_ntz, latitude double, longitude double")
    reach = 9000.0
    got = {r["det_id"]: r for r in pairing.infer_space_time(b, a, threshold_sec=120.0, threshold_m=reach, max_permutations=10_000).collect()}
    assert got.keys() == {d[0] for d in dets}
    over = pairing.OVERFLOW_M**2
    clusters: dict = {}
    for d in dets:
        clusters.setdefault(got[d[0]]["cluster"], []).append(d)
    pairs = 0
    for own in clusters.values():
        ships = sorted({r[0] for r in reports if r[1] == own[0][1] - dt.timedelta(seconds=60)})
        place = {r[0]: r[2:] for r in reports}
        cost = lambda d, s, place=place: over if s is None or (m := metres(d[2:], place[s])) > reach else m * m
        best = min(sum(cost(d, s) for d, s in zip(own, p, strict=True)) for p in itertools.permutations([*ships, *[None] * len(own)], len(own)))
        mine = [got[d[0]] for d in own]
        used = [r["mmsi"] for r in mine if r["mmsi"] is not None]
        pairs += len(used)
        assert len(used) == len(set(used))
        assert math.isclose(sum(over if r["mmsi"] is None else r["dist_m"] ** 2 for r in mine), best, rel_tol=1e-6)
        assert all(r["timestamp_nearest"] in {x[1] for x in reports if x[0] == r["mmsi"]} for r in mine if r["mmsi"] is not None)
    assert pairs > 10


def nearest_report(times, t):
    """The time nearest to t; of two equally near ones that with the even place among the ship's reports."""
    return min(range(len(times)), key=lambda i: (abs(times[i] - t), i % 2))


@pytest.mark.parametrize("how", ["left", "right", "inner", "outer"])
def test_pairs_are_joined_by_the_nearest_report(spark, how):
    reports = [tuple(r) for r in domain.reports(spark, SMALL).select("mmsi", "timestamp", "sog").collect()]
    found = [tuple(r) for r in domain.paired(spark, SMALL).select("mmsi", "timestamp", "det_id", "dist_m").collect()]
    times: dict = {}
    for m, t, _ in sorted(reports, key=lambda r: (r[0], r[1])):
        times.setdefault(m, []).append(t)
    by: dict = {}
    for m, t, det, dist in found:
        if m is not None:
            own = times[m]
            by.setdefault((m, own[nearest_report(own, t)]), []).append((det, t, dist))
    want, met = [], set()
    for m, t, sog in reports:
        own = by.get((m, t), [])
        met.update(x[0] for x in own)
        want += [(m, t, sog, *x) for x in own]
        if not own and how in ("left", "outer"):
            want.append((m, t, sog, None, None, None))
    assert met == {d for m, _, d, _ in found if m is not None} and met
    if how in ("right", "outer"):
        want += [(None, None, None, d, t, None) for m, t, d, _ in found if m is None]
    cut = lambda rows: Counter((*r[:5], None if r[5] is None else round(r[5], 6)) for r in rows)
    got = registry.queries()[f"pairing_master_whole_{how}"](spark, SMALL).select("mmsi", "timestamp", "sog", "det_id", "det_timestamp", "dist_m")
    assert cut(map(tuple, got.collect())) == cut(want)


def test_a_sweep_equals_single_runs(spark):
    """All of one candidate table: several thresholds of both kinds, and permutations on detections in conflict."""
    rng = random.Random(21)
    reports, dets = [], []
    for g in range(6):
        t = NOON + dt.timedelta(hours=g)
        for k in range(4):
            a, b = g + rng.uniform(-0.03, 0.03), rng.uniform(-0.03, 0.03)
            reports += [(g * 10 + k, t + dt.timedelta(seconds=s), a, b) for s in (-rng.choice([30, 400, 900]), rng.choice([30, 400, 900]))]
            dets.append((g * 10 + k, t, g + rng.uniform(-0.03, 0.03), rng.uniform(-0.03, 0.03)))
    a = spark.createDataFrame(reports, "mmsi long, timestamp timestamp_ntz, latitude double, longitude double")
    b = spark.createDataFrame(dets, "det_id long, timestamp timestamp_ntz, latitude double, longitude double")
    grid = [(s, m, p) for s in (60.0, 500.0, 1000.0) for m in (2500.0, 6000.0) for p in (1, 500)]
    all_ = pairing.sweep(b, a, [60, 500.0, 1000.0], [2500.0, 6000.0], [1, 500])
    names = ["det_id", "timestamp", "mmsi", "dist_m", "timestamp_nearest", "cluster", "greedy_count", "last_improvement", "last_iter"]
    got = Counter(map(tuple, all_.select(*names, "threshold_sec", "threshold_m", "max_permutations").collect()))
    want, improved = Counter(), 0
    for s, m, p in grid:
        rows = pairing.infer_identity(b, a, threshold_sec=s, threshold_m=m, max_permutations=p).select(*names).collect()
        improved += sum((r["greedy_count"] or 0) > 0 for r in rows)
        want.update((*r, s, m, p) for r in map(tuple, rows))
    assert got == want and improved > 0
    with pytest.raises(ValueError):
        pairing.sweep(b, a, [], [1.0], [1])
