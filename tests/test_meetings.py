"""Ships and detections met at one instant: the same searches as on the whole table of distances, and no shuffle of pairs."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from seatrace.operators import meetings, pairing


def there(rng, n, ordered):
    k = rng.permutation(n)
    return meetings.Ships([np.arange(n), k, np.zeros(n, int), k * 10, np.zeros(n), 10 + rng.uniform(0, 0.2, n), (179.9 + rng.uniform(0, 0.2, n) + 180) % 360 - 180], ordered)


@pytest.mark.parametrize("power", [1, 2])
@pytest.mark.parametrize("dets, ships", [(1, 40), (2, 60), (4, 9), (5, 3), (7, 30), (9, 4), (25, 400), (40, 12), (60, 300)])
def test_settled_as_on_all_distances(dets, ships, power):
    rng = np.random.default_rng(dets)
    for most, reach, at_once in ((1, 6000.0, 8), (50, 6000.0, 64_000), (1000, 6000.0, 8), (1000, 2000.0, 100), (1000, 30_000.0, 100)):
        s = there(rng, ships, dets > 6)
        lat, lon = 10 + rng.uniform(0, 0.2, dets), (179.9 + rng.uniform(0, 0.2, dets) + 180) % 360 - 180
        d = meetings.metres(s.lat[:, None], s.lon[:, None], lat, lon)
        rows = np.flatnonzero((d <= reach).any(axis=1))
        rows = rows[np.argsort(s.mmsi[rows])]
        got = meetings.settle(lat, lon, s, reach, most, at_once, pairing._search, pairing.OVERFLOW_M, power)
        if not len(rows):
            assert got is None
            continue
        table = np.where(d[rows] <= reach, d[rows], pairing.OVERFLOW_M) ** power
        best, better, last, tries = pairing._search(table, most, pairing.OVERFLOW_M**power)
        want = [int(s.mmsi[rows[b]]) if b < len(rows) and d[rows[b], k] <= reach else None for k, b in enumerate(best)]
        assert [int(s.mmsi[x]) if x >= 0 else None for x in got[0].tolist()] == want
        assert got[2:] == (better, last, tries)


def crowd(spark, reports_each=(-60, 0, 60)):
    rng = np.random.default_rng(8)
    noon = datetime(2024, 5, 1, 12)
    ships = [(m, noon + timedelta(minutes=t), float(a), float(o), float(m + t)) for m, (a, o) in enumerate(np.column_stack([rng.normal(10, 0.02, 300), rng.normal(20, 0.02, 300)])) for t in reports_each]
    ships += [ships[4], (*ships[4][:4], None), (400, None, 10.0, 20.0, 1.0), (401, noon, None, 20.0, 1.0)]
    dets = [(k, noon + timedelta(minutes=k // 5), float(a), float(o)) for k, (a, o) in enumerate(np.column_stack([rng.normal(10, 0.03, 60), rng.normal(20, 0.03, 60)]))]
    dets += [(60, noon, 10.5, 20.0), (61, None, 10.0, 20.0), (62, noon, None, 20.0), (63, noon + timedelta(days=9), 10.0, 20.0)]
    reports = spark.createDataFrame(ships, "mmsi long, timestamp timestamp_ntz, latitude double, longitude double, sog double")
    return spark.createDataFrame(dets, "det_id long, timestamp timestamp_ntz, latitude double, longitude double"), reports


@pytest.mark.parametrize("how", ["left", "right", "inner", "outer"])
def test_candidates_meet_their_reports_without_a_shuffle_of_pairs(spark, how):
    dets, reports = crowd(spark)
    limits = {"threshold_sec": 7200.0, "threshold_m": 5000.0}
    got = pairing.merge_candidates(dets, reports, ["sog"], how, **limits)
    near = pairing.candidates(dets, reports, **limits)
    all_ = dets.select("det_id", "timestamp").join(near.drop("timestamp"), "det_id", "left")
    want = pairing.merge_reports(reports.select("mmsi", "timestamp", "sog"), all_, how)
    key = lambda df: sorted(str((*r[:5], None if r[5] is None else round(r[5], 6))) for r in df.select("mmsi", "timestamp", "sog", "det_id", "det_timestamp", "dist_m").collect())
    assert key(got) == key(want) and near.count() > 3000
    for df in (near, got if how in ("inner", "right") else near):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_searches_make_no_rows_of_pairs(spark):
    dets, reports = crowd(spark)
    out = pairing.infer_identity(dets, reports, threshold_sec=7200.0, threshold_m=5000.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 2
    found = {r["det_id"]: r for r in out.collect()}
    assert len(found) == 64 and all(found[k]["mmsi"] is None for k in (60, 61, 62, 63)) and sum(r["mmsi"] is not None for r in found.values()) >= 55


@pytest.mark.parametrize("least", [1, 3])
def test_blocks_settle_in_small_steps_what_they_settle_at_once(spark, monkeypatch, least):
    from seatrace.operators import space_time

    rng = np.random.default_rng(least)
    n = 400
    lat, lon, us = 10 + rng.integers(0, 12, n) * 0.004 + rng.uniform(0, 0.001, n), 20 + rng.uniform(0, 0.05, n), 10**15 + rng.integers(0, 4000, n) * 10**6
    df = spark.createDataFrame(list(zip(range(n), us.tolist(), lat.tolist(), lon.tolist(), strict=True)), "id long, us long, lat double, lon double")
    side = space_time._side(600.0)
    from pyspark.sql import functions as F

    placed = df.withColumns(space_time._cell(F.col("lat"), F.col("lon"), F.col("us"), side, 600.0 * 1e6 / 3**0.5))
    dealt = space_time._blocks(placed, side).toPandas()
    assert dealt["own"].sum() == n and len(dealt) < 12 * n  # not a row for each of 125 cells and more
    rows = {c: v.to_numpy() for c, v in dealt.drop_duplicates("id").assign(own=True).items()}
    want = [sorted(zip(*(x.tolist() for x in space_time._settled(rows, 600.0, 1e9, least)), strict=True))]
    monkeypatch.setattr(space_time, "_AT_ONCE", 3)
    assert [sorted(zip(*(x.tolist() for x in space_time._settled(rows, 600.0, 1e9, least)), strict=True))] == want
    assert sum(k for k, *_ in want[0]) > 200
