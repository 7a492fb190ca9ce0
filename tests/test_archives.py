"""Zipped CSV and extraction, against what was put into the archives."""

from __future__ import annotations

import datetime as dt
import random
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import types as T

from seatrace.sources import archives

HEAD = "MMSI,BaseDateTime,LAT,LON,SOG,VesselName"


def line(k: int) -> str:
    return f"{k % 9},2024-05-0{1 + k % 3}T{k % 24:02}:{k % 60:02}:00,{k % 80}.5,-{k % 170}.25,{k % 30}.1,\"SHIP, {k}\""


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    with zipfile.ZipFile(place / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", "\r\n".join([HEAD, *map(line, range(0, 50)), "9,bad line"]) + "\r\n")
        z.writestr("deep/two.csv", "\n".join(["LON,MMSI,LAT,BaseDateTime,Extra", "1.5,77,2.5,2024-05-04T00:00:00,x", ",78,2.5,2024-05-04T00:00:00,y"]))
        z.writestr("notes.txt", "no table")
    with zipfile.ZipFile(place / "b.zip", "w") as z:
        z.writestr("head.csv", HEAD + "\n")
        z.writestr("nothing.csv", "")
        z.writestr("three.csv", "\n".join([HEAD, *map(line, range(50, 60)), line(50)]))
    return place


def test_members_are_read_by_their_own_headers(spark, folder):
    df = archives.read_zipped(spark, str(folder))
    assert df.columns == [*HEAD.split(","), "archive", "member"]
    rows = df.collect()
    assert len(rows) == 50 + 2 + 11
    by = {r["member"]: 0 for r in rows}
    assert by.keys() == {"one.csv", "deep/two.csv", "three.csv"}
    two = [r for r in rows if r["member"] == "deep/two.csv"]
    assert {(r["MMSI"], r["LON"], r["SOG"]) for r in two} == {("77", "1.5", None), ("78", None, None)}
    assert {r["VesselName"] for r in rows if r["member"] == "three.csv"} == {f"SHIP, {k}" for k in range(50, 60)}
    assert df.rdd.getNumPartitions() == 5


def test_types_are_guessed_and_reports_clean(spark, folder):
    df = archives.read_reports(spark, str(folder))
    kinds = {f.name: type(f.dataType) for f in df.schema.fields}
    assert kinds["mmsi"] is T.LongType and kinds["timestamp"] is T.TimestampNTZType and kinds["latitude"] is T.DoubleType and kinds["VesselName"] is T.StringType
    got = {(r["mmsi"], r["timestamp"]) for r in df.collect()}
    want = {(k % 9, dt.datetime(2024, 5, 1 + k % 3, k % 24, k % 60)) for k in range(60)} | {(77, dt.datetime(2024, 5, 4))}
    assert got == want and df.count() == len(want)
    with pytest.raises(ValueError):
        archives.read_reports(spark, str(folder), member="notes.txt")


def test_a_large_member_is_read_in_blocks():
    """The reader is a bounded number of blocks ahead of what it has given out, however long the stream is."""

    class Counted(BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.taken += len(out)
            return out

    data = (HEAD + "\n" + "\n".join(map(line, range(60_000)))).encode()
    rows, most, before = 0, 0, 0
    for batch in archives.csv_batches(Counted(data), HEAD.split(","), block=1 << 13):
        rows, most, before = rows + len(batch), max(most, Counted.taken - before), Counted.taken
    assert rows == 60_000 and most <= 40 << 13 < len(data) / 4


def test_nothing_is_extracted_twice(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    first = archives.extract(spark, str(folder), out)
    assert first.count() == 6
    for r in first.collect():
        with zipfile.ZipFile(r["archive"]) as z:
            assert (tmp_path / "out" / r["file"]).read_bytes() == z.read(r["member"])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*") if p.is_file() and "_extracted" not in str(p)}
    assert archives.extract(spark, str(folder), out).count() == 0
    assert before == {p: p.stat().st_mtime_ns for p in before}
    with zipfile.ZipFile(folder / "b.zip", "w") as z:  # one member changed, one new, the others gone
        z.writestr("three.csv", HEAD)
        z.writestr("../outside.csv", HEAD)
    assert {r["member"] for r in archives.extract(spark, str(folder), out).collect()} == {"three.csv", "../outside.csv"}
    assert (tmp_path / "out/b/outside.csv").exists() and not (tmp_path / "outside.csv").exists()
    assert archives.extract(spark, str(folder), out).count() == 0


def test_folders_without_archives(spark, tmp_path):
    assert archives.list_members(spark, str(tmp_path)).count() == 0
    assert archives.read_zipped(spark, str(tmp_path), columns=["MMSI"]).count() == 0
    assert archives.extract(spark, str(tmp_path), str(tmp_path / "out")).count() == 0


def test_seeded_reports_come_back(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(5), f"2024-01-01 00:{k // 60:02}:{k % 60:02}", round(rng.uniform(-90, 90), 6), round(rng.uniform(-180, 180), 6)) for k in range(500)]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.csv", "MMSI,BaseDateTime,LAT,LON\n" + "\n".join(",".join(map(str, r)) for r in rows))
    got = {(r["mmsi"], str(r["timestamp"]), r["latitude"], r["longitude"]) for r in archives.read_reports(spark, str(tmp_path)).collect()}
    assert got == set(rows)
