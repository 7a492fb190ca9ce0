"""Sources and sinks by round trips, and the operators that have no SQL against plain versions."""

from __future__ import annotations

import datetime as dt
import io
import math
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatrace.operators import filters, learning, pairing, stays
from seatrace.plans import domain, registry
from seatrace.sources import ais, documents

from .oracle import SF

SMALL = SF.replace("sf0.01", "sf0.001")
KML = "<kml><Document><Placemark><name>Port A</name><Point><coordinates>1.5,2.5,0</coordinates></Point></Placemark><Placemark><name>Bad</name><Point><coordinates>x</coordinates></Point></Placemark></Document></kml>"


def test_csv_reports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,IMO,CallSign,VesselType,Status,Length,Width,Draft,Cargo,TransceiverClass\n7,2024-01-01T00:00:05,1.5,2.5,NaN,,,,,,30,0,10,3,,,A\nx,2024-01-01T00:00:05,1,2,3,4,5,a,b,c,30,0,10,3,1,2,A\n8,no,1,2,3,4,5,a,b,c,30,0,10,3,1,2,B\n")
    got = ais.read_csv(spark, str(tmp_path / "a.csv")).orderBy("mmsi").collect()
    assert [(r["mmsi"], r["timestamp"], r["SOG"]) for r in got] == [(7, dt.datetime(2024, 1, 1, 0, 0, 5), None), (8, None, 3.0)]
    assert ais.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "none.csv")], num_files=1).count() == 2


def test_daily_parquet(spark, tmp_path):
    df = domain.reports(spark, SMALL)
    ais.write_daily(df, str(tmp_path / "days"))
    back = spark.read.parquet(str(tmp_path / "days"))
    day = df.agg(F.min(F.to_date("timestamp"))).first()[0]
    assert back.count() == df.count()
    assert ais.of_days(back, str(day)).count() == df.where(F.to_date("timestamp") == F.lit(day)).count() > 0
    assert set(ais.of_days(df, str(day), "numeric").columns) == {"mmsi", "timestamp", "latitude", "longitude", "sog", "heading", "vessel_type", "length", "width", "event_id"}
    assert ais.of_days(df, str(day), ["mmsi"]).columns == ["mmsi"]


def test_code_table(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("code,label\n0,Not available\n1 to 3,Reserved\n20,Wing\nbad,none\n")
    assert sorted(map(tuple, ais.read_codes(spark, str(tmp_path / "codes.csv")).collect())) == [(0, "Not available"), (1, "Reserved"), (2, "Reserved"), (3, "Reserved"), (20, "Wing")]


def test_kml_and_kmz(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    with zipfile.ZipFile(tmp_path / "a.kmz", "w") as z:
        z.writestr("doc.kml", KML)
        z.writestr("picture.png", b"\x00")
    for read, name in ((documents.read_kml, "a.kml"), (documents.read_kmz, "a.kmz")):
        got = [(r["name"], r["lon"], r["lat"]) for r in read(spark, str(tmp_path / name)).collect()]
        assert got == [("Port A", 1.5, 2.5), ("Bad", None, None)]


def test_raster(spark, tmp_path):
    a = np.array([[1.0, np.nan, 3.0], [4.0, 5.0, -6.0]])
    np.save(tmp_path / "a.npy", a)
    got = {(r["row"], r["col"]): r["value"] for r in documents.read_raster(spark, str(tmp_path / "a.npy")).collect()}
    assert got == {(i, j): a[i, j] for i in range(2) for j in range(3) if not math.isnan(a[i, j])}


def test_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]},"properties":{"name":"a"}},{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[6,6]]],[[[7,7],[8,7],[8,8]]]]},"properties":{"name":"b"}}]}')
    rings = documents.polygon_rings(documents.read_geojson(spark, str(tmp_path / "a.json")), "name").collect()
    assert sorted((r["name"], r["ring"][0]["lon"], len(r["ring"])) for r in rings) == [("a", 0.0, 3), ("b", 5.0, 3), ("b", 7.0, 3)]


def test_annotations(spark, tmp_path):
    one = "named_struct('filename', 'i.png', 'date', '2024-01-01', 'time_estimate', '10:00:00', 'size', named_struct('width', 100, 'height', 200, 'depth', 3), 'meters_per_pixel', 2.0D, 'lat_lon_bounds', named_struct('lat1', 10.0D, 'lon1', 5.0D, 'lat2', 8.0D, 'lon2', 6.0D), 'object', array(named_struct('class', 1, 'bndbox', named_struct('xmin', 40, 'ymin', 90, 'xmax', 60, 'ymax', 110))))"
    documents.write_voc(spark.sql(f"select x.* from (select {one} as x)"), str(tmp_path / "voc"))
    got = documents.read_voc(spark, str(tmp_path / "voc")).first()
    assert (got["datetime"], got["latitude"], got["longitude"], got["vessel_type"]) == (dt.datetime(2024, 1, 1, 10), 9.0, 5.5, 1)


@pytest.mark.parametrize("block", [2, 1_000_000])
def test_simulator_report(spark, block):
    text = ["junk", "Time (UTCG)   Lat   Lon", "1 Jan 2024 00:00:00.000   1.0   2.0", "2 Jan 2024 00:00:00.000   1.5   2.5", "", "Time (UTCG)   Lat   Lon", "1 Jan 2024 00:00:00.000   3.0   4.0"]
    got = documents.stk_report(spark.createDataFrame(list(enumerate(text)), "n long, line string"), block=block)
    assert sorted((r["ship"], r["at"].day, r["latitude"]) for r in got.collect()) == [(1, 1, 1.0), (1, 2, 1.5), (2, 1, 3.0)]


def test_pollution(spark):
    body = '{"list":[{"dt":0,"main":{"aqi":2},"components":{"co":1.5}},{"dt":3600,"main":{"aqi":3},"components":{}}]}'
    got = documents.pollution_rows(spark.createDataFrame([("p", body)], "place string, body string")).orderBy("at").collect()
    assert [(r["at"], r["aqi"], r["co"]) for r in got] == [(dt.datetime(1970, 1, 1), 2, 1.5), (dt.datetime(1970, 1, 1, 1), 3, None)]


def test_answers_memo_and_report(spark, tmp_path):
    rows = spark.createDataFrame([("weather", "a", "{}"), ("pollution", "a", "[]")], "kind string, place string, body string")
    documents.write_answers(rows, str(tmp_path / "answers"))
    assert {p.name for p in (tmp_path / "answers").iterdir() if p.is_dir()} == {"kind=weather", "kind=pollution"}
    made = []
    for _ in range(2):
        assert documents.memoised(spark, str(tmp_path / "memo"), lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 1
    documents.write_report(rows, str(tmp_path / "report"), "kind")
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2


@pytest.mark.parametrize("per_column", [False, True])
def test_vectors(spark, tmp_path, per_column):
    df = spark.createDataFrame([(1, [1.0, 2.0], [0, 1]), (2, [3.0, 4.0], [1, 1])], "mmsi long, features array<double>, labels array<int>")
    documents.write_vectors(df, str(tmp_path / "v"), per_column=per_column)
    assert sorted(map(tuple, documents.read_vectors(spark, str(tmp_path / "v")).collect())) == sorted(map(tuple, df.collect()))


def test_days_jitter_files(spark, tmp_path):
    df = domain.reports(spark, SMALL).limit(50)
    assert documents.combine_days({"2024-01-02": df, "2024-01-01": df.drop("sog")}).groupBy("day").count().count() == 2
    a, b = (sorted(map(tuple, documents.jittered(df, ["event_id"], degrees=0.5).select("event_id", "latitude").collect())) for _ in range(2))
    was = dict(map(tuple, df.select("event_id", "latitude").collect()))
    assert a == b and all(0 < abs(lat - was[e]) <= 0.5 for e, lat in a)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "day_1.txt").write_text("1")
    (tmp_path / "day_1.txt").write_text("1")
    (tmp_path / "other.txt").write_text("1")
    assert [r["duplicates"] for r in documents.find_files(spark, str(tmp_path), starts="day", ends=".txt").collect()] == [2, 2]


def test_renamed_refuses_equal_names(spark):
    with pytest.raises(ValueError):
        filters.renamed(spark.range(1).selectExpr("id as a", "id as b"), {"a": "b", "b": "b"})


def _naive_loitering(rows, radius):
    """Per ship: all runs from every anchor, then the heaviest first."""
    out = {}
    for ship, own in rows.items():
        own = sorted(own)
        us, lat, lon = np.array(own).T
        lat, lon = np.radians(lat), np.radians(lon)
        far = lambda i, j: stays._cosine_m(lat[j], lon[j], lat[i], lon[i])  # noqa: B023, E731
        found = []
        for i in range(len(us)):
            if i and far(i, i - 1) < radius:
                continue
            j = i + 1
            while j < len(us) and far(i, j) < radius:
                j += 1
            if j - i > 1:
                found.append((-round(float(((us[i:j] - us[0]) / 1e6).sum()), 6), i, j))
        rank = [-1] * len(us)
        for k, (_, i, j) in enumerate(sorted(found)):
            if all(x == -1 for x in rank[i:j]):
                rank[i:j] = [k] * (j - i)
        out |= {(ship, int(t)): r for t, r in zip(us, rank, strict=True)}
    return out


def test_loitering_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(stays, "BLOCK_ROWS", 64)
    df = domain.reports(spark, SF).withColumn("mmsi", F.col("mmsi") % 40)  # tracks that jump
    df = df.dropDuplicates(["mmsi", "timestamp"])
    rows = {}
    for m, t, lat, lon in df.select("mmsi", F.unix_micros(F.col("timestamp").cast("timestamp")), "latitude", "longitude").collect():
        rows.setdefault(m, []).append((t, lat, lon))
    got = stays.loitering(df, 2000.0).select("mmsi", F.unix_micros(F.col("timestamp").cast("timestamp")), "loiter_rank").collect()
    want = _naive_loitering(rows, 2000.0)
    assert {(m, t): r for m, t, r in got} == want and max(want.values()) > 2
    assert stays._by_jumps(df, 2000.0, ["mmsi"]).select("mmsi", "__piece").distinct().count() > 40


def test_conflicting_detections(spark):
    """Two detections nearest to the same ship: greedy takes it first, permutation finds the smaller sum."""
    at = dt.datetime(2024, 1, 1)
    reports = spark.createDataFrame([(1, at, 0.0, 0.0), (2, at, 0.0, 0.03)], "mmsi long, timestamp timestamp_ntz, latitude double, longitude double")
    dets = spark.createDataFrame([(1, at, 0.0, 0.001), (2, at, 0.0, -0.0105)], "det_id long, timestamp timestamp_ntz, latitude double, longitude double")
    runs = {}
    for n in (1, 1000):
        found = pairing.infer_identity(dets, reports, threshold_sec=60.0, threshold_m=9000.0, max_permutations=n)
        runs[n] = found
        assert {r["det_id"]: r["mmsi"] for r in found.collect()} == {1: 1, 2: 2} if n == 1 else {1: 2, 2: 1}
    measures = pairing.quality(runs[1].withColumn("p", F.lit(1)).unionByName(runs[1000].withColumn("p", F.lit(1000))), reports, ["p"])
    one = pairing.side_by_side(measures, "p", 1, 1000, truth=600).first()
    assert one["paired_left"] == one["paired_right"] == 600.0 and one["max_off_sec_left"] == 0.0
    by = {r["p"]: r.asDict() for r in measures.collect()}
    assert one["mean_dist_m_left"] == by[1]["mean_dist_m"] and one["mean_dist_m_right"] == by[1000]["mean_dist_m"] <= one["mean_dist_m_left"] + 1e-6


def test_stratified_split_counts(spark):
    df = domain.reports(spark, SF).select("event_id", F.when(F.col("event_id") % 3 > 0, F.lit("hot")).alias("label"))
    n, test = Counter(), Counter()
    for label, is_test in learning.stratified_split(df, "label", "event_id").select("label", "is_test").collect():
        n[label] += 1
        test[label] += is_test
    assert set(n) == {"hot", None} and test == {k: math.floor(v * 0.2) for k, v in n.items()} and sum(n.values()) == df.count()


def test_tuning(spark):
    df = domain.reports(spark, SF).select("length", "width", (F.col("length") > 30).cast("double").alias("label"))
    model, runs = learning.tune_trees(df, ["length", "width"], "label", grid={"maxDepth": [1, 3], "numTrees": [2]})
    assert runs.columns == ["maxDepth", "numTrees", "score"] and runs.count() == 2 and model.getNumTrees == 2


def test_spoof_branches_over_pieces(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, registry.queries()["spoof_branches"](spark, SF).collect()), key=str)
    whole = rows()
    monkeypatch.setattr(stays, "BLOCK_ROWS", 4)
    assert rows() == whole
