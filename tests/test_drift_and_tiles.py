"""Drifted headers against a plain version over all pairs, tiles against single cells."""

from __future__ import annotations

import difflib
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatrace.operators import spatial
from seatrace.sources import documents, headers, rasters

BASE = ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "VesselName", "CallSign", "Draft"]
DRIFT = {"Base_Date_Time": "BaseDateTime", "vesselname": "VesselName", "Vessel Name": "VesselName", "MMSI_": "MMSI", "Callsign": "CallSign", "Drafts": "Draft"}


def drifted(seed: int) -> dict[str, list[str]]:
    rng = random.Random(seed)
    back: dict[str, list[str]] = {}
    for new, old in DRIFT.items():
        back.setdefault(old, []).append(new)
    return {f"f{k}": [rng.choice(back[n]) if n in back and rng.random() < 0.15 else n for n in BASE] for k in range(30)}


def plain(files: dict[str, list[str]]) -> dict[str, str]:
    counts: dict[str, int] = {}
    for names in files.values():
        for n in set(names):
            counts[n] = counts.get(n, 0) + 1
    widths = [len(set(v)) for v in files.values()]
    width = max(sorted(set(widths)), key=widths.count)
    table = sorted((-headers.likeness(a, b) * counts[b], a, b) for a in counts for b in counts if a != b)
    called = {n: n for n in counts}
    for _, a, b in table:
        if len(set(called.values())) == width:
            break
        called = {n: called[b] if c == called[a] else c for n, c in called.items()}
    return called


def test_likeness_is_that_of_common_letters():
    for a, b in [("LAT", "LON"), ("VesselName", "vessel_name"), ("", "x"), ("abc", "abc"), ("BaseDateTime", "Base_Date_Time")]:
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert headers.likeness(a, b) == pytest.approx(2 * table[-1, -1] / (len(a) + len(b)))
    assert headers.likeness("LAT", "LAT") == 1.0 == difflib.SequenceMatcher(None, "LAT", "LAT").ratio()


@pytest.mark.parametrize("seed", range(4))
def test_names_are_merged_as_over_all_pairs(spark, seed):
    files = drifted(seed)
    got = headers.renames(spark.createDataFrame([(f, n) for f, names in files.items() for n in names], "file string, name string"))
    assert got == plain(files)
    assert all(got[n] == DRIFT.get(n, n) for n in got)


def test_names_without_common_pairs_are_merged_last(spark):
    files = {"a": ["ab", "cd"], "b": ["ab", "cd"], "c": ["ab", "dc"]}
    got = headers.renames(spark.createDataFrame([(f, n) for f, names in files.items() for n in names], "file string, name string"))
    assert got == {"ab": "ab", "cd": "cd", "dc": "cd"}
    assert headers.renames(spark.createDataFrame([], "file string, name string")) == {}


def test_drifted_files_are_one_table(spark, tmp_path):
    files, want = drifted(9), set()
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for f, names in files.items():
            values = [f"{f}{n}" for n in BASE]
            order = random.Random(f).sample(range(len(BASE)), len(BASE))
            z.writestr(f"{f}.csv", ",".join(names[i] for i in order) + "\n" + ",".join(values[i] for i in order) + "\n")
            want.add(tuple(values))
    df = headers.read_drifted(spark, str(tmp_path))
    assert sorted(df.columns) == sorted([*BASE, "archive", "member"])
    assert {tuple(r[n] for n in BASE) for r in df.collect()} == want


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("shape, side", [((50, 70), 16), ((16, 32), 16), ((5, 3), 16)])
def test_tiles_equal_cells(spark, tmp_path, order, shape, side):
    rng = np.random.default_rng(1)
    array = np.asarray(rng.normal(size=shape).astype(np.float32), order=order)
    array[rng.random(shape) < 0.2] = np.nan
    np.save(tmp_path / "r.npy", array)
    tiles = rasters.read_tiles(spark, str(tmp_path / "r.npy"), side=side)
    assert tiles.count() == -(-shape[0] // side) * -(-shape[1] // side)
    points = [(k, float(y), float(x)) for k, (y, x) in enumerate(zip(rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400), strict=True))] + [(900, 90.0, 180.0), (901, -90.0, -180.0)]
    df = spark.createDataFrame(points, "id long, latitude double, longitude double")
    got = {r["id"]: r["v"] for r in spatial.tile_lookup(df, tiles, rows=shape[0], cols=shape[1], side=side, name="v").collect()}
    pixels = documents.read_raster(spark, str(tmp_path / "r.npy"))
    want = {r["id"]: r["v"] for r in spatial.raster_lookup(df, pixels, rows=shape[0], cols=shape[1], name="v").collect()}
    assert got == want and len(got) == 402
    again = {r["id"]: r["v"] for r in spatial.tile_lookup(df, rasters.tiled(pixels, side=side), rows=shape[0], cols=shape[1], side=side, name="v").collect()}
    assert again == want


def test_odd_rasters(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.zeros(4))
    with pytest.raises(Exception, match="two-dimensional"):
        rasters.read_tiles(spark, str(tmp_path / "x.npy")).count()
    (tmp_path / "none").mkdir()
    assert rasters.read_tiles(spark, str(tmp_path / "none")).where(F.lit(True)).count() == 0
