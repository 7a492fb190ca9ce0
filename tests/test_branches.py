"""Branches by periods against one run over all reports."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from seatrace.operators import branches, stays

FIRST = dt.datetime(2024, 3, 1)


def track(seed: int):
    """Two vessels under each number in turns, with silences of up to some days; one ship is never broken before the last day."""
    rng = random.Random(seed)
    rows = []
    for ship in range(6):
        t, at = FIRST + dt.timedelta(seconds=ship), [[10.0, 20.0], [10.3, 20.3]]
        while t < FIRST + dt.timedelta(days=6):
            who = rng.random() < (0.0 if ship == 5 else 0.3)
            at[who][0] += rng.uniform(-0.004, 0.004)
            at[who][1] += rng.uniform(-0.004, 0.004)
            rows.append((ship, t, *at[who]))
            t += dt.timedelta(seconds=rng.choice([600, 900, 1500, 3000] + ([200_000] if ship == 3 else [])))
    for k in range(5):  # two branches before midnight, one after it
        night = FIRST + dt.timedelta(days=k, hours=22, minutes=50)
        rows += [(8, night, 0.0, 0.0), (8, night + dt.timedelta(minutes=5), 0.0, 0.045), (8, night + dt.timedelta(minutes=90), 0.0, 0.0225)]
    rows += [(5, FIRST + dt.timedelta(days=6, hours=5), 10.0, 20.0), (7, FIRST + dt.timedelta(days=2), 1.0, 1.0)]
    return rows


SCHEMA = "mmsi long, timestamp timestamp_ntz, latitude double, longitude double"



@pytest.mark.parametrize("gap", [7200.0, 100_000.0])
def test_periods_equal_one_run(spark, tmp_path, gap):
    rows = track(int(gap))
    options = {"speed_m_sec": 1.0, "gap_sec": gap}
    want = {(m, t): b for m, t, b in [(r["mmsi"], r["timestamp"], r["branch_start"]) for r in stays.spoof_branches(spark.createDataFrame(rows, SCHEMA), **options).collect()]}
    path = str(tmp_path / "store")
    day = lambda k: spark.createDataFrame([r for r in rows if (r[1] - FIRST).days == k], SCHEMA)
    for k in range(7):
        branches.append(day(k), path, str((FIRST + dt.timedelta(days=k)).date()), **options)
    got = {(m, t): b for m, t, b in rows_of_pairs(branches.branches(spark, path))}
    assert got == want
    assert len({b for b in want.values()}) > 8 and spark.read.parquet(path).where("kind = 'merge'").count() > 0
    for k in (3, 4, 5, 6, 6):  # again: nothing changes
        branches.append(day(k), path, str((FIRST + dt.timedelta(days=k)).date()), **options)
    assert {(m, t): b for m, t, b in rows_of_pairs(branches.branches(spark, path))} == want


def rows_of_pairs(df):
    return [(r["mmsi"], r["timestamp"], r["branch_start"]) for r in df.collect()]


def test_empty_periods_hand_on(spark, tmp_path):
    path, rows = str(tmp_path / "store"), track(3)
    options = {"speed_m_sec": 1.0, "gap_sec": 7200.0}
    cut = FIRST + dt.timedelta(days=3)
    nothing = spark.createDataFrame([], SCHEMA)
    branches.append(nothing, path, "2024-02-01", **options)
    branches.append(spark.createDataFrame([r for r in rows if r[1] < cut], SCHEMA), path, "2024-03-01", **options)
    branches.append(nothing, path, "2024-03-02", **options)
    branches.append(spark.createDataFrame([r for r in rows if r[1] >= cut], SCHEMA), path, "2024-03-03", **options)
    want = {(r["mmsi"], r["timestamp"]): r["branch_start"] for r in stays.spoof_branches(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    assert {(m, t): b for m, t, b in rows_of_pairs(branches.branches(spark, path))} == want
