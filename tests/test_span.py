"""Spans by hull against all pairs."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from seatrace.functions.geo import EARTH_RADIUS_M
from seatrace.operators import tracks

NOON = dt.datetime(2024, 5, 1, 12)


def cosine(p, q):
    a, b, c, d = (math.radians(x) for x in (*p, *q))
    return EARTH_RADIUS_M * math.acos(max(-1.0, min(1.0, math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(d - b))))


def groups() -> dict[int, list[tuple[float, float]]]:
    rng = random.Random(3)
    ring = lambda n, y, x, r: [(y + r * math.sin(2 * math.pi * k / n), x + r * math.cos(2 * math.pi * k / n)) for k in range(n)]
    cloud = lambda n, y, x, r: [(y + rng.uniform(-r, r), x + rng.uniform(-r, r)) for _ in range(n)]
    out = [[(1.0, 2.0)], cloud(2, 0, 0, 1), cloud(12, 5, 5, 1), ring(60, 10, 20, 0.3), ring(61, 70, -20, 0.3), cloud(80, 50, 5, 0.2)]
    out += [[(0.01 * k, 0.02 * k) for k in range(40)], [(3.0, 4.0)] * 30, [(3.0, 4.0)] * 30 + [(3.1, 4.0)], [(k * 0.01, 7.0) for k in range(25)] * 2]
    out += [cloud(20, 10, 179.9, 0.05) + cloud(20, 10, -179.9, 0.05), cloud(30, 89.5, 0, 0.4), cloud(20, 0, 0, 80), cloud(25, 0, 100, 20)]
    return dict(enumerate(out))


@pytest.mark.parametrize("least", [1, 12])
def test_spans_equal_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(tracks, "HULL_FROM", least)
    own = groups()
    rows = [(k, 0, NOON + dt.timedelta(seconds=i), y, x) for k, pts in own.items() for i, (y, x) in enumerate(pts)]
    got = {r["mmsi"]: r["span_m"] for r in tracks.geometry(spark.createDataFrame(rows, "mmsi long, bin int, timestamp timestamp_ntz, latitude double, longitude double")).collect()}
    for k, pts in own.items():
        want = max(cosine(p, q) for p in pts for q in pts) if len(pts) > 1 else None
        assert got[k] == want or got[k] == pytest.approx(want, rel=1e-7, abs=0.2)


def test_the_hull_of_many_points_is_small(spark):
    from pyspark.sql import functions as F

    from seatrace.functions.geo import hull

    rng = random.Random(8)
    pts = [(rng.gauss(40, 0.05), rng.gauss(3, 0.05)) for _ in range(1000)]
    df = spark.createDataFrame([(pts,)], "p array<struct<latitude:double,longitude:double>>")
    assert df.select(F.size(hull(F.col("p"), F.lit(40.0), F.lit(3.0))).alias("n")).first()["n"] < 60
