"""Polygons by cell: sides on the cells' borders, repeated rings, long rings and buffers in metres, against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatrace.functions.geo import in_ring
from seatrace.operators import spatial

RINGS = "ord long, name string, ring array<struct<lon: double, lat: double>>"


def plain_inside(points, polygons):
    every = points.crossJoin(F.broadcast(polygons)).where(in_ring(F.col("longitude"), F.col("latitude"), F.col("ring")))
    return {r["id"]: r["o"] for r in every.groupBy("id").agg(F.min("ord").alias("o")).collect()}


def test_sides_on_cell_borders_and_repeated_rings(spark):
    """Boxes, combs and rings with a hole's worth of turns on the very grid of the cells; the same ring twice is one ring."""
    comb = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.75, 1.0), (1.75, 0.25), (1.5, 0.25), (1.5, 1.0), (1.25, 1.0), (1.25, 0.25), (0.5, 0.25), (0.5, 1.0), (0.0, 1.0)]
    box = [(-1.0, -1.0), (-0.5, -1.0), (-0.5, -0.25), (-1.0, -0.25)]
    spiral = [(-1.0, 0.0), (-0.25, 0.0), (-0.25, 0.75), (-0.75, 0.75), (-0.75, 0.25), (-0.5, 0.25), (-0.5, 0.5), (-0.6, 0.5), (-0.6, 0.6), (-0.4, 0.6), (-0.4, 0.1), (-1.0, 0.1)]
    made = [(3, "comb", comb), (2, "box", box), (2, "box", box), (1, "spiral", spiral), (4, "none", None), (5, "bare", [])]
    polygons = spark.createDataFrame(made, RINGS)
    rng = np.random.default_rng(3)
    on_grid = [(float(a), float(b)) for a in np.arange(-1.25, 1.3, 0.125) for b in np.arange(-1.25, 2.3, 0.125)]
    places = on_grid + rng.uniform([-1.2, -1.2], [1.2, 2.2], (2000, 2)).tolist()
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "id long, latitude double, longitude double")
    names = {1: "spiral", 2: "box", 3: "comb"}
    want = plain_inside(points, polygons)
    assert len(set(want.values())) == 3
    for cell in (0.25, 0.1, 3.0):
        got = {r["id"]: r["name"] for r in spatial.first_polygon(points, polygons, keys=["id"], cell=cell).where("name is not null").collect()}
        assert got == {i: names[o] for i, o in want.items()}


def test_ring_of_many_sides_is_dealt_by_side(spark):
    """A ring of 100,000 sides: no cell has more than its own few, and points near the border are told apart."""
    n = 100_000
    turn = np.linspace(0, 2 * np.pi, n + 1)[:-1]
    far = 1 + 0.2 * np.sin(37 * turn)
    ring = [(float(r * np.cos(t)), float(r * np.sin(t))) for r, t in zip(far, turn, strict=True)]
    polygons = spark.createDataFrame([(0, "wave", ring)], RINGS)
    held = spatial.cover(polygons, 0.02).select(F.size("__e").alias("n")).agg(F.max("n"), F.sum("n"), F.sum((F.col("n") == 0).cast("int"))).first()
    assert held[0] < 2_000 and n <= held[1] < 1.2 * n and held[2] > 1_000
    rng = np.random.default_rng(4)
    t, off = rng.uniform(0, 2 * np.pi, 3000), rng.choice([-1, 1], 3000) * rng.uniform(0.001, 0.6, 3000)
    r = np.maximum(1 + 0.2 * np.sin(37 * t) + off, 0)
    rows = [(i, float(r[i] * np.sin(t[i])), float(r[i] * np.cos(t[i]))) for i in range(3000)]
    points = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    got = {x["id"] for x in spatial.first_polygon(points, polygons, keys=["id"], cell=0.02).where("name is not null").collect()}
    assert got == {i for i in range(3000) if off[i] < 0}


def _plain_m(lat, lon, a, b):
    """Metres from a point to the segment on the plane that touches the globe at the point's latitude."""
    k = spatial.MERCATOR_RADIUS_M * math.pi / 180
    at = lambda q: np.array([(q[0] - lon) * k * math.cos(math.radians(lat)), (q[1] - lat) * k])
    p, q = at(a), at(b)
    t = np.clip(-(p @ (q - p)) / ((q - p) @ (q - p)), 0, 1)
    return float(np.hypot(*(p + t * (q - p))))


@pytest.mark.parametrize("lat0", [0.0, 45.0, 70.0, -70.0])
def test_buffers_in_metres(spark, lat0):
    """Lines and rings within 5 km, at latitudes where a degree of longitude has 111, 79 and 38 km."""
    rng = np.random.default_rng(int(lat0) + 100)
    ends = [((float(x), float(y)), (float(x + dx), float(y + dy))) for x, y, dx, dy in rng.uniform([9, lat0 - 0.5, -0.2, -0.1], [11, lat0 + 0.5, 0.2, 0.1], (25, 4))]
    lines = spark.createDataFrame([(k, f"l{k}", *a, *b) for k, (a, b) in enumerate(ends)], "ord long, name string, lon1 double, lat1 double, lon2 double, lat2 double")
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.uniform([lat0 - 0.6, 8.8], [lat0 + 0.6, 11.2], (1200, 2)))]
    points = spark.createDataFrame([*rows, (1200, None, None)], "id long, latitude double, longitude double")
    far = {i: [_plain_m(lat, lon, a, b) for a, b in ends] for i, lat, lon in rows}
    got = {r["id"]: (r["name"], r["dist_m"]) for r in spatial.near_line(points, lines, keys=["id"], within_m=5000.0).collect()}
    assert len(got) == 1201 and got[1200] == (None, None)
    hits = 0
    for i, ds in far.items():
        if min(abs(d - 5000) for d in ds) < 25:  # the two planes differ by less than half a percent here
            continue
        first = next((k for k, d in enumerate(ds) if d < 5000), None)
        assert got[i][0] == (None if first is None else f"l{first}")
        if first is not None:
            hits += 1
            assert got[i][1] == pytest.approx(ds[first], abs=25)
    assert hits > 100
    ring = [(9.5, lat0 - 0.2), (10.5, lat0 - 0.2), (10.5, lat0 + 0.2), (9.5, lat0 + 0.2)]
    box = spark.createDataFrame([(0, "box", ring)], RINGS)
    told = {r["id"]: (r["kind"], r["dist_m"]) for r in spatial.polygon_context(points, box, keys=["id"], within_m=5000.0).collect()}
    for i, lat, lon in rows:
        d = min(_plain_m(lat, lon, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        if 9.5 < lon < 10.5 and abs(lat - lat0) < 0.2:
            assert told[i] == ("inside", 0.0)
        elif abs(d - 5000) > 25:
            assert told[i][0] == ("within" if d < 5000 else None)
    with pytest.raises(ValueError):
        spatial.near_line(points, lines, keys=["id"], within_m=1e6)
