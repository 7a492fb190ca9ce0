"""Queries over the rest of the sources, splits, clocks and reports, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatrace.functions import geo, scalars
from seatrace.operators import clock, filters, learning, pairing, rules, spatial
from seatrace.sources import ais, documents

from .domain import LEGAL_SQL, LINE_SQL, TYPE_SQL, legal, pipelines
from .tracks import CLOCK_CTE, DET_SQL, detections, hav, query, r6, rd, reports


@query("SELECT mmsi, timestamp, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM ais")
def positions(spark, d):
    return ais.positions(reports(spark, d)).select("mmsi", "timestamp", r6("latitude"), r6("longitude"))


@query(f"SELECT mmsi, max(length) AS length, max(width) AS width, {rd('max(width) / max(length)', 'aspect_ratio')} FROM ais GROUP BY 1")
def static_ships(spark, d):
    return ais.static_ships(reports(spark, d)).select("mmsi", "length", "width", r6("aspect_ratio"))


@query("SELECT event_id, mmsi FROM ais ORDER BY timestamp, event_id LIMIT 100")
def first_lines(spark, d):
    return filters.first_lines(reports(spark, d), 100, ["timestamp", "event_id"]).select("event_id", "mmsi")


@query("SELECT event_id, mmsi FROM ais ORDER BY md5('7:' || CAST(event_id AS VARCHAR)), event_id LIMIT 250")
def sample_rows(spark, d):
    return filters.sample_rows(reports(spark, d), 250, "event_id", 7).select("event_id", "mmsi")


@query("SELECT status, vessel_type, count(*) AS n FROM ais GROUP BY 1, 2 ORDER BY n DESC, status DESC, vessel_type DESC")
def falling_order(spark, d):
    return filters.falling(reports(spark, d).groupBy("status", "vessel_type").agg(F.count("*").alias("n")), "n", "status", "vessel_type")


@query("SELECT mmsi, status AS kind, event_id AS raw_event_id_x, sog AS \"raw_speed_over_ground_x\" FROM ais")
def renamed_columns(spark, d):
    df = reports(spark, d).select("mmsi", "status", "event_id", F.col("sog").alias(" speed over  ground "))
    return filters.renamed(df, {"status": "kind"}, prefix="raw_", suffix="_x", keep=["mmsi"])


@query("SELECT mmsi, t AS timestamp, CAST(mmsi % 100 AS INTEGER) AS vessel_type FROM grid", CLOCK_CTE)
def restored_types(spark, d):
    df = reports(spark, d)
    return filters.restore_types(clock.on_grid(df, ["vessel_type"]), df).select("mmsi", "timestamp", "vessel_type")


@query("SELECT value, row_number() OVER (ORDER BY part, value) AS code FROM (SELECT status AS value, min(CASE WHEN vessel_type < 3 THEN 0 ELSE 1 END) AS part FROM ais WHERE status IS NOT NULL GROUP BY 1)")
def category_union(spark, d):
    df = reports(spark, d)
    return learning.union_categories(df.where("vessel_type < 3"), df.where("not vessel_type < 3"), "status")[1].select("value", F.col("code").cast("bigint").alias("code"))


@query("SELECT event_id, row_number() OVER (PARTITION BY status ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) <= floor(count(*) OVER (PARTITION BY status) * 2e-1) AS is_test FROM ais")
def split_stratified(spark, d):
    return learning.stratified_split(reports(spark, d), "status", "event_id").select("event_id", "is_test")


@query("SELECT event_id, dense_rank() OVER (ORDER BY CAST(timestamp AS DATE)) > floor((SELECT count(DISTINCT CAST(timestamp AS DATE)) FROM ais) * 8e-1) AS is_test FROM ais")
def split_by_order(spark, d):
    return learning.split_by_order(reports(spark, d).withColumn("day", F.to_date("timestamp")), "day").select("event_id", "is_test")


@query(f"SELECT status, vessel_type, {rd('score', 'score')} FROM (SELECT status, vessel_type, avg(sog) AS score FROM ais GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10)")
def best_runs(spark, d):
    runs = reports(spark, d).groupBy("status", "vessel_type").agg(F.avg("sog").alias("score"))
    return learning.best_models(runs, "score", 10, ties=["status", "vessel_type"]).select("status", "vessel_type", r6("score"))


@query("SELECT event_id, CASE WHEN len(s) > 5 THEN TRY_CAST(s AS TIMESTAMP) END AS at FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(timestamp, '%Y-%m-%d') WHEN 2 THEN '2024' ELSE 'no time at all' END AS s FROM ais)")
def iso_times(spark, d):
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 1, F.date_format("timestamp", "yyyy-MM-dd")).when(kind == 2, "2024").otherwise("no time at all")
    return reports(spark, d).select("event_id", scalars.iso_time(text).alias("at"))


_DAYS = ("2024-01-10", "2024-01-14")
_BUFFERED = "buf AS (SELECT * FROM ais WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-09' AND DATE '2024-01-15'), " + CLOCK_CTE.replace("FROM ais", "FROM buf")


@query(f"SELECT mmsi, timestamp, {rd('latitude', 'latitude')}, {rd('sog', 'sog')}, status FROM clock WHERE CAST(timestamp AS DATE) BETWEEN DATE '{_DAYS[0]}' AND DATE '{_DAYS[1]}'", _BUFFERED)
def clock_day_range(spark, d):
    return clock.day_range(reports(spark, d), *_DAYS, ["latitude", "sog", "status"]).select("mmsi", "timestamp", r6("latitude"), r6("sog"), "status")


def _own(spark, d):
    """Detections with the ship of their own report."""
    return detections(spark, d).join(reports(spark, d).select(F.col("event_id").alias("det_id"), "mmsi"), "det_id").select("det_id", "mmsi", "timestamp")


_OWN_SQL = CLOCK_CTE.split("span AS")[0].rstrip().rstrip(",") + f""", {DET_SQL}, asks AS (SELECT e.mmsi, x.timestamp, x.det_id FROM det x JOIN ais e ON e.event_id = x.det_id),
ap AS (SELECT k.*, s.timestamp AS t0, s.sog AS sog0, s.seq FROM asks k ASOF LEFT JOIN seqd s ON k.mmsi = s.mmsi AND k.timestamp >= s.timestamp),
an AS (SELECT p.*, s.timestamp AS t1, s.sog AS sog1 FROM ap p ASOF LEFT JOIN seqd s ON p.mmsi = s.mmsi AND p.timestamp <= s.timestamp),
af AS (SELECT *, t0 IS NOT NULL AND t1 IS NOT NULL AS ok, CASE WHEN timestamp = t0 THEN 0e0 ELSE (epoch_us(timestamp) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END AS f FROM an)"""


@query(f"SELECT det_id, mmsi, {rd('CASE WHEN ok THEN sog0 + (sog1 - sog0) * f END', 'sog')}, CASE WHEN ok THEN CASE WHEN round_even(seq + f, 0) > seq THEN t1 ELSE t0 END END AS timestamp_nearest FROM af", _OWN_SQL)
def augment_pairs(spark, d):
    return clock.augment(_own(spark, d), reports(spark, d), ["sog"]).select("det_id", "mmsi", r6("sog"), "timestamp_nearest")


@query("SELECT f.det_id, f.mmsi, CASE WHEN ok THEN CAST(f.mmsi % 100 AS INTEGER) END AS vessel_type, t.label AS type_label FROM af f LEFT JOIN type_label t ON ok AND t.code = f.mmsi % 100", _OWN_SQL + ", " + TYPE_SQL)
def describe_pairs(spark, d):
    return pairing.described(_own(spark, d), reports(spark, d), rules.type_table(spark)).select("det_id", "mmsi", "vessel_type", "type_label")


@query("SELECT a.event_id, coalesce(l.required, false) AS required FROM ais a LEFT JOIN (SELECT s.mmsi, bool_or(g.k LIKE '%passenger%' OR g.k LIKE '%cargo%') AS required FROM legal g JOIN ais s ON s.event_id = g.event_id WHERE g.length < 40 GROUP BY 1) l ON a.mmsi = l.mmsi", LEGAL_SQL)
def legality_on_features(spark, d):
    kind = F.lower("type_label")
    own = legal(spark, d).where("length < 40").groupBy("mmsi").agg(F.bool_or(kind.contains("passenger") | kind.contains("cargo")).alias("required"))
    return rules.with_legality(reports(spark, d).select("mmsi", "event_id"), own).select("event_id", "required")


_FRAME = {"xs": (-80.03, -79.9), "ys": (19.98, 20.1)}


@query(
    f"SELECT name, {rd('lon1 + dx * b', 'x1')}, {rd('lat1 + dy * b', 'y1')}, {rd('lon1 + dx * e', 'x2')}, {rd('lat1 + dy * e', 'y2')} FROM cut WHERE b <= e",
    LINE_SQL.split("seg AS")[0].rstrip().rstrip(",") + """, way AS (SELECT *, lon2 - lon1 AS dx, lat2 - lat1 AS dy FROM line WHERE lon2 <> lon1 AND lat2 <> lat1),
cut AS (SELECT *, greatest(0e0, least((-8003e-2 - lon1) / dx, (-799e-1 - lon1) / dx), least((1998e-2 - lat1) / dy, (201e-1 - lat1) / dy)) AS b, least(1e0, greatest((-8003e-2 - lon1) / dx, (-799e-1 - lon1) / dx), greatest((1998e-2 - lat1) / dy, (201e-1 - lat1) / dy)) AS e FROM way)""",
)
def clip_lines(spark, d):
    part = geo.clip_segment(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"), **_FRAME)
    df = pipelines(spark, d).where("lon2 <> lon1 and lat2 <> lat1").select("name", part.alias("p")).where("p is not null")
    return df.select("name", *[r6(F.col(f"p.{c}"), c) for c in ("x1", "y1", "x2", "y2")])


def _world(spark, d):
    k = F.col("n_nationkey")
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("place"), ((k * 13) % 140 - 70).cast("double").alias("latitude"), ((k * 29) % 360 - 180).cast("double").alias("longitude"))


@query(
    f"SELECT event_id, max(place) FILTER (WHERE k = 1) AS \"0_place\", {rd('max(m) FILTER (WHERE k = 1)', '0_dist_m')}, max(place) FILTER (WHERE k = 2) AS \"1_place\", {rd('max(m) FILTER (WHERE k = 2)', '1_dist_m')} FROM ranked GROUP BY 1".replace("AS 0_dist_m", 'AS "0_dist_m"').replace("AS 1_dist_m", 'AS "1_dist_m"'),
    f"""world AS (SELECT n_name AS place, CAST((n_nationkey * 13) % 140 - 70 AS DOUBLE) AS lat2, CAST((n_nationkey * 29) % 360 - 180 AS DOUBLE) AS lon2 FROM nation),
met AS (SELECT a.event_id, w.place, {hav('a.latitude', 'a.longitude', 'w.lat2', 'w.lon2')} AS m FROM ais a, world w), ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY m, place) AS k FROM met)""",
)
def nearest_any(spark, d):
    out = spatial.nearest_any(reports(spark, d), _world(spark, d), keys=["event_id"], n_nearest=2, start_m=50_000.0)
    return out.select("event_id", "0_place", r6("0_dist_m"), "1_place", r6("1_dist_m"))


@query("SELECT n_name AS place, CAST(unnest(generate_series(DATE '2024-02-27', DATE '2024-03-02', INTERVAL 1 DAY)) AS VARCHAR)[1:10] AS date FROM nation")
def request_days(spark, d):
    return documents.request_days(_world(spark, d), "2024-02-27", "2024-03-02").select("place", F.col("date").cast("string").alias("date"))


@query("SELECT event_id, 'ship ' || mmsi || chr(10) || '  Speed $5' || chr(10) || 'Speedy 2' AS text FROM ais")
def set_property(spark, d):
    text = F.concat(F.lit("ship "), F.col("mmsi").cast("string"), F.lit("\n  Speed "), F.col("sog").cast("string"), F.lit("\nSpeedy 2"))
    return reports(spark, d).select("event_id", documents.with_property(text, "Speed", "$5").alias("text"))


@query("SELECT CAST(c AS INTEGER) AS code, CASE WHEN c <= 19 THEN 'Reserved' ELSE 'Type ' || c END AS label FROM range(1, 31) t(c)")
def code_ranges(spark, d):
    one = spark.range(20, 31).select(F.col("id").cast("string").alias("code"), F.concat(F.lit("Type "), F.col("id").cast("string")).alias("label"))
    return ais.code_table(one.unionAll(spark.range(1).select(F.lit("1 to 19"), F.lit(" Reserved "))).unionAll(spark.range(1).select(F.lit("n/a"), F.lit("no code"))))


@query()
def pairing_side_by_side(spark, d):
    """Greedy and permuted runs side by side: it is held against brute force in the tests."""
    limits = [14400.0], [5000.0], [1, 1000]
    by = ["threshold_sec", "threshold_m"]
    found = pairing.sweep(detections(spark, d), reports(spark, d), *limits)
    return pairing.side_by_side(pairing.quality(found, reports(spark, d), [*by, "max_permutations"]), "max_permutations", 1, 1000, by, truth=600)
