"""Rules, tags and pairs without SQL against plain versions on small made-up tables."""

from __future__ import annotations

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatrace.functions.geo import in_ring
from seatrace.operators import pairing, rules, spatial
from seatrace.plans import domain

from .oracle import SF

NIGHT = dt.datetime(2024, 1, 1)


def test_every_behaviour_occurs(spark):
    got = rules.behaviors(domain.features(spark, SF), {"anomalous": 0.3})
    sums = got.agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in got.columns[2:]]).first().asDict()
    assert all(0 < n < got.count() for n in sums.values()), sums


@pytest.mark.parametrize("block_rows", [1, 4096])
def test_transshipment(spark, monkeypatch, block_rows):
    """Whole tracks and tracks cut at every row without a partner give the same."""
    monkeypatch.setattr(rules, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(3)
    rows = []
    for ship in range(6):
        for hour in range(60):
            near = rng.permutation(6)[:3]
            dists = rng.choice([5.0, 15.0, 30.0], 3)
            rows.append((ship, NIGHT + dt.timedelta(hours=hour), None if rng.random() < 0.1 else 60.0, float(rng.choice([10.0, 9e3], p=[0.9, 0.1])), 20.0, *[x for m, x_ in zip(near, dists, strict=True) for x in (int(m) if m != ship else -1, float(x_))]))
    names = ", ".join(f"`{i}_mmsi` long, `{i}_dist_m` double" for i in range(3))
    df = spark.createDataFrame(rows, f"mmsi long, timestamp timestamp_ntz, loiter_sec double, excursion_m double, coast_distance_km double, {names}")
    got = {(r["mmsi"], r["timestamp"]): r["partner"] for r in rules.transshipment(df).collect()}
    want = {}
    for ship in range(6):
        own = sorted(r for r in rows if r[0] == ship)
        far = [r[2] is not None and k + 1 < len(own) and own[k + 1][2] is not None and r[3] < 5e3 for k, r in enumerate(own)]
        beside = [{m: x for m, x in zip(r[5::2], r[6::2], strict=True) if m >= 0 and x <= 20.0} if far[k] else {} for k, r in enumerate(own)]
        runs = []
        for m in range(6):
            k = 0
            while k < len(own):
                end = k
                while end < len(own) and m in beside[end]:
                    end += 1
                if end > k:
                    runs.append((-(end - k), sum(beside[j][m] for j in range(k, end)), k, m))
                k = max(end, k + 1)
        partner = [-1] * len(own)
        for n, _, k, m in sorted(runs):
            if partner[k : k - n] == [-1] * -n:
                partner[k : k - n] = [m] * -n
        want |= {(ship, r[1]): p for r, p in zip(own, partner, strict=True)}
    assert got == want and len(set(want.values())) > 3


@pytest.mark.parametrize("dets, ships", [(1, 3), (2, 2), (3, 2), (3, 4)])
def test_permuted_pairs_are_the_best(spark, dets, ships):
    """One cluster at each instant: no other choice of different ships has a smaller sum."""
    rng = np.random.default_rng(dets * 10 + ships)
    reports, found, reach = [], [], 4000.0
    for k in range(30):
        at = NIGHT + dt.timedelta(hours=k)
        reports += [(100 * k + s, at, *rng.uniform(0, 0.05, 2).tolist()) for s in range(ships)]
        found += [(100 * k + d, at, *rng.uniform(0, 0.05, 2).tolist()) for d in range(dets)]
    a = spark.createDataFrame(reports, "mmsi long, timestamp timestamp_ntz, latitude double, longitude double")
    b = spark.createDataFrame(found, "det_id long, timestamp timestamp_ntz, latitude double, longitude double")
    got = pairing.infer_identity(b, a, threshold_sec=60.0, threshold_m=reach, max_permutations=10_000, clustering_eps_m=1e6).collect()
    cost = lambda p, q: x if (x := _metres(p[2], p[3], q[2], q[3])) <= reach else pairing.OVERFLOW_M
    for k in range(30):
        own = {r["det_id"]: r for r in got if r["det_id"] // 100 == k}
        mine = sorted(own)
        assert len(mine) == dets and len({r["mmsi"] for r in own.values()} - {None}) == sum(r["mmsi"] is not None for r in own.values())
        total = sum(pairing.OVERFLOW_M if own[d]["mmsi"] is None else own[d]["dist_m"] for d in mine)
        near = [[cost(r, f) for f in found if f[0] // 100 == k] for r in reports if r[0] // 100 == k]
        near += [[pairing.OVERFLOW_M] * dets] * max(0, dets - ships)
        best = min(sum(near[s][d] for d, s in enumerate(pick)) for pick in itertools.permutations(range(len(near)), dets))
        assert total == pytest.approx(best, abs=1e-3)


def _metres(lat1, lon1, lat2, lon2):
    a, o, b, p = np.radians([lat1, lon1, lat2, lon2])
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((p - o) / 2) ** 2
    return float(2 * pairing.EARTH_RADIUS_M * np.arcsin(np.sqrt(h)))


def test_polygons_of_many_edges(spark):
    """Stars that lie over one another: edges kept by cell give what whole rings give."""
    rng = np.random.default_rng(5)
    rings = []
    for k in range(12):
        x, y = rng.uniform(-0.5, 0.5, 2)
        turn = np.linspace(0, 2 * np.pi, 61)[:-1]
        far = rng.uniform(0.05, 0.6, 60)
        rings.append((k, f"p{k}", [(float(x + r * np.cos(t)), float(y + r * np.sin(t))) for r, t in zip(far, turn, strict=True)]))
    stars = spark.createDataFrame(rings, "ord long, name string, ring array<struct<lon: double, lat: double>>")
    points = spark.createDataFrame([(i, *rng.uniform(-1, 1, 2).tolist()) for i in range(1500)] + [(1500, None, None)], "id long, latitude double, longitude double")
    every = points.crossJoin(F.broadcast(stars)).where(in_ring(F.col("longitude"), F.col("latitude"), F.col("ring")))
    inside = {r["id"]: r["o"] for r in every.groupBy("id").agg(F.min("ord").alias("o")).collect()}
    assert 100 < len(inside) < 1400
    for cell in (0.07, 0.4):
        assert {r["id"]: r["name"] for r in spatial.first_polygon(points, stars, keys=["id"], cell=cell).collect()} == {i: f"p{inside[i]}" if i in inside else None for i in range(1501)}
    want = {}
    for i, lat, lon in points.collect():
        for k, name, ring in rings if lat is not None else []:
            a, b, p = np.array(ring), np.roll(np.array(ring), -1, 0), np.array([lon, lat])
            t = np.clip(((p - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)
            off = float(np.hypot(*(p - (a + t[:, None] * (b - a))).T).min())
            cross = ((a[:, 1] > lat) != (b[:, 1] > lat)) & (lon < (b[:, 0] - a[:, 0]) * (lat - a[:, 1]) / np.where(a[:, 1] == b[:, 1], 1, b[:, 1] - a[:, 1]) + a[:, 0])
            if cross.sum() % 2:
                want[i] = (name, "inside", 0.0)
            elif off <= 0.03:
                want[i] = (name, "within", round(off, 9))
            if i in want:
                break
    got = {r["id"]: (r["name"], r["kind"], r["dist_deg"] and round(r["dist_deg"], 9) or r["dist_deg"]) for r in spatial.polygon_context(points, stars, keys=["id"], within_deg=0.03).collect()}
    assert got == {i: want.get(i, (None, None, None)) for i in range(1501)}
    assert {kind for _, kind, _ in want.values()} == {"inside", "within"}
    cells = {(r["row"], r["col"]): r["value"] for r in spatial.rasterise(stars, rows=1800, cols=3600).collect()}
    centres = spark.createDataFrame([(r * 3600 + c, 90 - (r + 0.5) * 0.1, (c + 0.5) * 0.1 - 180) for r in range(880, 920) for c in range(1780, 1820)], "id long, latitude double, longitude double")
    first = centres.crossJoin(F.broadcast(stars)).where(in_ring(F.col("longitude"), F.col("latitude"), F.col("ring"))).groupBy("id").agg(F.min("ord").alias("o")).collect()
    assert cells == {divmod(r["id"], 3600): r["o"] for r in first} and len(cells) > 50


def test_detections_that_compete(spark):
    """In crowded instants permutations cost no more than taking the nearest ship one by one, and less in some."""
    got = domain.pairing_crowded(spark, SF).collect()
    near = pairing.candidates(domain.crowded(spark, SF), domain.reports(spark, SF), threshold_sec=14400.0, threshold_m=5000.0)
    allowed = {(r["det_id"], r["mmsi"]): r["dist_m"] for r in near.collect()}
    cost, ships = {}, {}
    for r in got:
        at = r["max_permutations"], r["timestamp"]
        if r["mmsi"] is None:
            cost[at] = cost.get(at, 0.0) + pairing.OVERFLOW_M
            continue
        assert allowed[r["det_id"], r["mmsi"]] == pytest.approx(r["dist_m"], abs=1e-5)
        cost[at] = cost.get(at, 0.0) + r["dist_m"]
        ships.setdefault(at, []).append(r["mmsi"])
    assert all(len(set(v)) == len(v) for v in ships.values())
    gain = [cost[1, t] - cost[1000, t] for n, t in cost if n == 1]
    assert min(gain) >= -1e-3 and any(g > 1 for g in gain)
    assert sum((r["greedy_count"] or 0) > 0 for r in got) > 0
