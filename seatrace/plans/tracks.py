"""Queries over position reports, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seatrace.functions import geo, scalars
from seatrace.operators import branches, clock, filters, learning, spatial, stays, tracks
from seatrace.sources import ais
from seatrace.storage import checkpoint_dir

Q: dict = {}
SQL: dict[str, str] = {}

AIS_SQL = """ais AS (
  SELECT user_id AS mmsi, ts AS timestamp, 20 + (user_id % 10) * 2e-2 + 5e-2 * sin(epoch_us(ts) / 86400e6 + user_id) AS latitude,
         -80 + (user_id % 7) * 2e-2 + 5e-2 * cos(epoch_us(ts) / 86400e6 + user_id) AS longitude, value AS sog, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 36e-1 AS heading,
         CAST(user_id % 100 AS INTEGER) AS vessel_type, event_type AS status, CAST(5 + user_id % 60 AS DOUBLE) AS length, (5 + user_id % 60) / 4 AS width, event_id FROM events)"""


def hav(a1: str, o1: str, a2: str, o2: str) -> str:
    return f"(2 * 6378e3 * asin(least(1e0, sqrt(pow(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2)))))"


def cosd(a1: str, o1: str, a2: str, o2: str) -> str:
    return f"(6378e3 * acos(greatest(-1e0, least(1e0, sin(radians({a1})) * sin(radians({a2})) + cos(radians({a1})) * cos(radians({a2})) * cos(radians({o2} - {o1}))))))"


def bear(a1: str, o1: str, a2: str, o2: str) -> str:
    return f"degrees(atan2(sin(radians({o2} - {o1})) * cos(radians({a2})), cos(radians({a1})) * sin(radians({a2})) - sin(radians({a1})) * cos(radians({a2})) * cos(radians({o2} - {o1}))))"


def r6(c, name: str | None = None):
    """Six places, and no negative zero."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or c) if isinstance(c, str) or name else out


def rd(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0e0 AS {name}"


def reports(spark, d):
    return ais.from_events(spark.read.parquet(f"{d}/events.parquet"))


def query(sql: str | None = None, ctes: str = ""):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH RECURSIVE {AIS_SQL}{', ' + ctes if ctes else ''} {sql}"
        return f

    return add


@query("SELECT mmsi, timestamp, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, sog, event_id FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, timestamp ORDER BY event_id) AS n FROM ais WHERE mmsi IS NOT NULL AND timestamp IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL) WHERE n = 1")
def ingest_clean(spark, d):
    return ais.clean(reports(spark, d), tie=["event_id"]).select("mmsi", "timestamp", r6("latitude"), r6("longitude"), "sog", "event_id")


@query("SELECT unnest(['mmsi', 'sog', 'heading', 'status']) AS \"column\", unnest([count(*) - count(mmsi), count(*) - count(sog), count(*) - count(heading), count(*) - count(status)]) AS nulls_before, unnest([count(*) - count(mmsi), 0, count(*) FILTER (WHERE sog IS NOT NULL AND heading IS NULL), count(*) FILTER (WHERE sog IS NOT NULL AND status IS NULL)]) AS nulls_after, count(*) AS rows_before, count(sog) AS rows_after FROM ais")
def ingest_null_report(spark, d):
    df = reports(spark, d).select("mmsi", "sog", "heading", "status")
    return ais.null_report(df, df.dropna(subset=["sog"]))


@query("SELECT mmsi, timestamp, is_first, is_last FROM (SELECT mmsi, timestamp, lag(timestamp) OVER w IS NULL AS is_first, lead(timestamp) OVER w IS NULL AS is_last FROM ais WINDOW w AS (PARTITION BY mmsi, CAST(timestamp AS DATE) ORDER BY timestamp)) WHERE is_first OR is_last")
def edges_per_day(spark, d):
    return tracks.edges(reports(spark, d)).select("mmsi", "timestamp", "is_first", "is_last")


@query("SELECT DISTINCT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date FROM ais WHERE CAST(timestamp AS DATE) NOT IN (SELECT CAST(timestamp AS DATE) FROM ais WHERE sog > 500)")
def missed_dates(spark, d):
    df = reports(spark, d).withColumn("date", F.to_date("timestamp"))
    return ais.missed_dates(df, df.where("sog > 500")).select(F.col("date").cast("string"))


@query(f"SELECT event_id, {rd(hav('latitude', 'longitude', '20.1', '-79.9'), 'haversine_m')}, round({cosd('latitude', 'longitude', '20.1', '-79.9')}, 2) + 0e0 AS cosine_m FROM ais")
def geo_distance(spark, d):
    lat, lon = F.col("latitude"), F.col("longitude")
    return reports(spark, d).select("event_id", r6(geo.haversine_m(lat, lon, F.lit(20.1), F.lit(-79.9)), "haversine_m"), r2(geo.cosine_m(lat, lon, F.lit(20.1), F.lit(-79.9)), "cosine_m"))


@query(f"SELECT event_id, {rd(bear('latitude', 'longitude', '20.1', '-79.9'), 'bearing')}, {rd('sog * 5144e-4', 'speed_m_sec')} FROM ais")
def geo_bearing(spark, d):
    return reports(spark, d).select("event_id", r6(geo.bearing_deg(F.col("latitude"), F.col("longitude"), F.lit(20.1), F.lit(-79.9)), "bearing"), r6(geo.knots_to_m_sec(F.col("sog")), "speed_m_sec"))


_BOX = {"lats": (19.95, 20.25), "lons": (-80.05, -79.85), "size": (1663, 771), "width_m": 20903.0}


@query(
    f"SELECT event_id, x, y, {rd('CASE WHEN x BETWEEN 0 AND 1663 AND y BETWEEN 0 AND 771 THEN (771 - y) / (771 / (2025e-2 - 1995e-2)) + 1995e-2 END', 'lat_back')} FROM px",
    """px AS (SELECT event_id, CAST(trunc(rs * sin(radians(longitude + 8005e-2)) * (1663 / 20903e0)) AS INTEGER) AS x, CAST(trunc(771 - (latitude - 1995e-2) * (771 / (2025e-2 - 1995e-2))) AS INTEGER) AS y
      FROM (SELECT *, sqrt((pow(pow(6378137e0, 2) * cos(radians(latitude)), 2) + pow(pow(6356752e0, 2) * sin(radians(latitude)), 2)) / (pow(6378137e0 * cos(radians(latitude)), 2) + pow(6356752e0 * sin(radians(latitude)), 2))) AS rs FROM ais WHERE latitude BETWEEN 1995e-2 AND 2025e-2 AND longitude BETWEEN -8005e-2 AND -7985e-2))""",
)
def pixel_roundtrip(spark, d):
    df = reports(spark, d).where(F.col("latitude").between(*_BOX["lats"]) & F.col("longitude").between(*_BOX["lons"]))
    x, y = geo.lat_lon_to_pixel(F.col("latitude"), F.col("longitude"), **_BOX)
    df = df.select("event_id", x.alias("x"), y.alias("y"))
    return df.select("event_id", "x", "y", r6(geo.pixel_to_lat_lon(F.col("x"), F.col("y"), **_BOX)[0], "lat_back"))


@query(f"SELECT event_id, {rd('(CASE WHEN sog < 10 THEN 10e0 WHEN sog > 200 THEN 200e0 ELSE sog END - 105) / 95', 'sog_norm')}, coalesce(sog < 10 OR sog > 200, false) AS outside, coalesce(heading = 180, false) AS special, {rd('width / length', 'aspect')} FROM ais")
def normalise_clip(spark, d):
    sog = F.col("sog")
    return reports(spark, d).select("event_id", r6(scalars.normalise(scalars.clip(sog, 10, 200), 10, 200), "sog_norm"), scalars.is_outside(sog, 10, 200).alias("outside"), scalars.is_special(F.col("heading"), 180).alias("special"), r6(scalars.aspect_ratio(F.col("width"), F.col("length")), "aspect"))


@query(f"SELECT event_id, {rd('year(timestamp) / 3000', 'year')}, {rd('month(timestamp) / 12', 'month')}, {rd('day(timestamp) / 31', 'day')}, {rd('hour(timestamp) / 24', 'hour')}, {rd('minute(timestamp) / 60', 'minute')}, {rd('second(timestamp) / 60', 'second')} FROM ais")
def datetime_split(spark, d):
    return reports(spark, d).select("event_id", *[r6(c, n) for n, c in scalars.datetime_parts(F.col("timestamp")).items()])


@query("SELECT event_id, coalesce(CASE WHEN sog < 300 THEN sog END, -1) AS sog, coalesce(CASE WHEN vessel_type < 50 THEN status END, 'NoEntry') AS status FROM ais")
def fill_by_type(spark, d):
    return scalars.fill_by_type(reports(spark, d).select("event_id", F.when(F.col("sog") < 300, F.col("sog")).alias("sog"), F.when(F.col("vessel_type") < 50, F.col("status")).alias("status")))


KIN_CTE = f"""k0 AS (SELECT *, lag(timestamp) OVER w AS pt, lead(timestamp) OVER w AS nt, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM ais WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp)),
k1 AS (SELECT *, (epoch_us(timestamp) - epoch_us(pt)) / 1e6 AS delta_sec, {hav('latitude', 'longitude', 'plat', 'plon')} AS delta_m, {bear('latitude', 'longitude', 'plat', 'plon')} AS bearing_deg FROM k0),
k2 AS (SELECT *, delta_m / nullif(delta_sec, 0) AS v, (bearing_deg - lag(bearing_deg) OVER w) / nullif(delta_sec, 0) AS om FROM k1 WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp)),
kin AS (SELECT event_id, mmsi, timestamp, latitude, longitude, delta_sec, delta_m, bearing_deg,
  CASE WHEN nt IS NOT NULL THEN (bearing_deg - lead(bearing_deg) OVER w) / ((delta_m + lead(delta_m) OVER w) / 2 + 1e-10) END AS curvature_deg_m,
  CASE WHEN nt IS NOT NULL THEN v END AS speed_m_sec, CASE WHEN nt IS NOT NULL THEN (v - lead(v) OVER w) / lead(delta_sec) OVER w * 1e3 END AS accel_m_sec2,
  CASE WHEN nt IS NOT NULL THEN om END AS ang_vel_deg_sec, CASE WHEN nt IS NOT NULL THEN (om - lead(om) OVER w) / lead(delta_sec) OVER w END AS ang_accel_deg_sec2 FROM k2 WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp))"""


@query("SELECT event_id, mmsi, timestamp, " + ", ".join(rd(c, c) for c in tracks.KINEMATICS) + " FROM kin", KIN_CTE)
def kinematics(spark, d):
    return tracks.kinematics(reports(spark, d)).select("event_id", "mmsi", "timestamp", *[r6(c) for c in tracks.KINEMATICS])


_STATS = [(f, c) for c in tracks.KINEMATICS for f in ("mean", "std", "min", "max")]
_FN = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@query("SELECT mmsi, date_trunc('hour', timestamp) AS bin, count(*) AS count, " + ", ".join(rd(f"{_FN[f]}({c})", f"{f}_{c}") for f, c in _STATS) + " FROM kin GROUP BY 1, 2", KIN_CTE)
def kinematics_hourly(spark, d):
    return tracks.kinematics_by_bin(reports(spark, d)).select("mmsi", "bin", "count", *[r6(f"{f}_{c}") for f, c in _STATS])


@query("SELECT mmsi, make_timestamp(CAST(round_even(epoch_us(timestamp) / 3600e6, 0) AS BIGINT) * 3600000000) AS bin, count(*) AS count, " + ", ".join(rd(f"{_FN[f]}(sog)", f"{f}_sog") for f in _FN) + " FROM ais GROUP BY 1, 2")
def time_aggregate(spark, d):
    return tracks.time_aggregate(reports(spark, d), ["sog"]).select("mmsi", "bin", "count", *[r6(f"{f}_sog") for f in _FN])


@query("SELECT event_id, (epoch_us(timestamp) - epoch_us(min(timestamp) OVER (PARTITION BY mmsi))) / 1e6 AS elapsed_sec FROM ais")
def elapsed_time(spark, d):
    return tracks.elapsed(reports(spark, d)).select("event_id", "elapsed_sec")


@query("SELECT event_id, f AND coalesce(n, false) AS both_fast, f OR coalesce(n, false) AS any_fast, round(avg(CAST(f AS INTEGER)) OVER (PARTITION BY mmsi), 6) AS share FROM (SELECT *, lead(f) OVER (PARTITION BY mmsi ORDER BY timestamp) AS n FROM (SELECT *, coalesce(sog > 50, false) AS f FROM ais))")
def neighbour_flags(spark, d):
    fast = F.col("sog") > 50
    df = tracks.share_of_ship(tracks.bad_or_next(tracks.successive(reports(spark, d), fast, "both_fast"), fast, "any_fast"), fast, "share")
    return df.select("event_id", "both_fast", "any_fast", r6("share"))


@query("SELECT mmsi, min(timestamp) AS begin, max(timestamp) AS \"end\", count(*) AS n FROM (SELECT *, rn - row_number() OVER (PARTITION BY mmsi ORDER BY timestamp) AS g FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY timestamp) AS rn FROM ais) WHERE sog > 20) GROUP BY mmsi, g")
def fast_islands(spark, d):
    return tracks.islands(reports(spark, d), F.col("sog") > 20)


CLOCK_CTE = """seqd AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY timestamp) - 1 AS seq FROM ais),
span AS (SELECT mmsi, min(timestamp) AS a, max(timestamp) AS b FROM ais GROUP BY mmsi),
grid AS (SELECT mmsi, make_timestamp(t) AS t FROM (SELECT mmsi, unnest(range(CAST(ceil(epoch_us(a) / 3600e6) AS BIGINT) * 3600000000, epoch_us(b) + 1, 3600000000)) AS t FROM span)),
pv AS (SELECT g.mmsi, g.t, s.timestamp AS t0, s.latitude AS lat0, s.longitude AS lon0, s.sog AS sog0, s.status AS st0, s.seq FROM grid g ASOF JOIN seqd s ON g.mmsi = s.mmsi AND g.t >= s.timestamp),
both_sides AS (SELECT p.*, s.timestamp AS t1, s.latitude AS lat1, s.longitude AS lon1, s.sog AS sog1, s.status AS st1 FROM pv p ASOF JOIN seqd s ON p.mmsi = s.mmsi AND p.t <= s.timestamp),
frac AS (SELECT *, CASE WHEN t = t0 THEN 0e0 ELSE (epoch_us(t) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END AS f FROM both_sides),
clock AS (SELECT mmsi, t AS timestamp, lat0 + (lat1 - lat0) * f AS latitude, lon0 + (lon1 - lon0) * f AS longitude, sog0 + (sog1 - sog0) * f AS sog,
  CASE WHEN round_even(seq + f, 0) > seq THEN st1 ELSE st0 END AS status, seq + f AS interp_index, t0 AS timestamp_previous, t1 AS timestamp_next, CASE WHEN round_even(seq + f, 0) > seq THEN t1 ELSE t0 END AS timestamp_nearest FROM frac)"""


def hourly(spark, d):
    return clock.on_grid(reports(spark, d), ["latitude", "longitude", "sog", "status"])


@query(f"SELECT mmsi, timestamp, {rd('latitude', 'latitude')}, {rd('longitude', 'longitude')}, {rd('sog', 'sog')}, status, {rd('interp_index', 'interp_index')} FROM clock", CLOCK_CTE)
def interp_hourly(spark, d):
    return hourly(spark, d).select("mmsi", "timestamp", r6("latitude"), r6("longitude"), r6("sog"), "status", r6("interp_index"))


@query("SELECT mmsi, timestamp, timestamp_previous, timestamp_next, timestamp_nearest FROM clock", CLOCK_CTE)
def interp_prev_next_nearest(spark, d):
    return hourly(spark, d).select("mmsi", "timestamp", "timestamp_previous", "timestamp_next", "timestamp_nearest")


@query("SELECT mmsi, count(*) AS n, count(DISTINCT CAST(timestamp AS DATE)) AS days FROM clock WHERE CAST(timestamp_previous AS DATE) = CAST(timestamp_next AS DATE) GROUP BY 1", CLOCK_CTE)
def interp_no_cross_midnight(spark, d):
    return clock.same_day(hourly(spark, d)).groupBy("mmsi").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("timestamp")).alias("days"))


DET_SQL = """det AS (SELECT event_id AS det_id, date_trunc('minute', timestamp) AS timestamp, latitude + (event_id % 7 - 3) * 5e-4 AS latitude, longitude + (event_id % 5 - 2) * 5e-4 AS longitude FROM ais WHERE status = 'purchase')"""


def detections(spark, d):
    df = reports(spark, d).where("status = 'purchase'")
    e = F.col("event_id")
    return df.select(e.alias("det_id"), F.date_trunc("minute", "timestamp").cast("timestamp_ntz").alias("timestamp"), (F.col("latitude") + (e % 7 - 3) * 5e-4).alias("latitude"), (F.col("longitude") + (e % 5 - 2) * 5e-4).alias("longitude"))


@query("SELECT event_id, mmsi, timestamp FROM ais WHERE latitude BETWEEN 2002e-2 AND 2011e-2 AND longitude BETWEEN -8e1 AND -7992e-2")
def bbox_filter(spark, d):
    return filters.in_box(reports(spark, d), (20.02, 20.11), (-80.0, -79.92)).select("event_id", "mmsi", "timestamp")


@query("SELECT event_id, mmsi FROM ais WHERE mmsi IN (SELECT mmsi FROM (SELECT mmsi, avg(sog) AS m FROM ais GROUP BY mmsi ORDER BY m DESC, mmsi LIMIT 20))")
def top_ships_by_speed(spark, d):
    return filters.fastest_ships(reports(spark, d), 20).select("event_id", "mmsi")


@query("SELECT a.event_id, a.mmsi FROM ais a JOIN (SELECT mmsi, min({'t': timestamp, 'e': event_id}) AS f FROM ais WHERE sog >= 100 AND status IN ('click', 'view') GROUP BY mmsi ORDER BY f LIMIT 15) x ON a.mmsi = x.mmsi WHERE {'t': a.timestamp, 'e': a.event_id} >= x.f")
def first_n_ships(spark, d):
    return filters.first_ships(reports(spark, d), 15, min_sog=100, statuses=["click", "view"], order=("timestamp", "event_id")).select("event_id", "mmsi")


@query("SELECT coalesce(CAST(arg_max(hour, {'m': m, 'h': -hour}) AS INTEGER), -1) AS hour FROM (SELECT hour(timestamp) AS hour, avg(sog) AS m FROM ais GROUP BY 1) WHERE m > 0")
def busiest_hour(spark, d):
    return filters.busiest_hour(reports(spark, d))


@query(f"SELECT event_id, mmsi FROM ais WHERE abs(epoch_us(timestamp) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) < 86400e6 AND {hav('latitude', 'longitude', '20.1', '-79.9')} < 8e3")
def radius_time_filter(spark, d):
    return spatial.within(filters.near_time(reports(spark, d), "2024-01-15 12:00:00", 86400), 20.1, -79.9, 8e3).select("event_id", "mmsi")


@query("SELECT event_id, mmsi FROM ais WHERE strftime(timestamp, '%Y-%m-%dT%H:%M:%S') LIKE '%-12T1%'")
def time_text_filter(spark, d):
    return filters.time_text(reports(spark, d), "-12T1").select("event_id", "mmsi")


@query("SELECT event_id, mmsi, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY timestamp) AS n, dense_rank() OVER (ORDER BY mmsi) AS r FROM ais) WHERE n <= 10 AND r BETWEEN 5 AND 99")
def first_rows_per_ship(spark, d):
    return filters.first_rows(reports(spark, d), 10, (5, 99)).select("event_id", "mmsi", "timestamp")


@query("SELECT DISTINCT mmsi, status, vessel_type FROM ais ORDER BY 1, 2, 3")
def distinct_lines(spark, d):
    return filters.sorted_lines(reports(spark, d).select("mmsi", "status", "vessel_type"), "mmsi")


@query("SELECT mmsi, max(CAST(coalesce(sog > 300, false) AS INTEGER)) AS sog_greater_300, max(CAST(coalesce(sog < 1, false) AS INTEGER)) AS sog_less_1, max(CAST(coalesce(status = 'purchase', false) AS INTEGER)) AS status_is_purchase, max(CAST(coalesce(status <> 'click', false) AS INTEGER)) AS status_not_click FROM ais GROUP BY mmsi")
def any_labels(spark, d):
    return learning.any_labels(reports(spark, d), greater={"sog": 300}, less={"sog": 1}, equal={"status": "purchase"}, unequal={"status": "click"})


NEIGHBOR_CTE = CLOCK_CTE + f""", pairs AS (SELECT a.timestamp, a.mmsi, b.mmsi AS other, {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS dist_m FROM clock a JOIN clock b ON a.timestamp = b.timestamp AND a.mmsi <> b.mmsi
  WHERE abs(a.latitude - b.latitude) < 6e-3 AND abs(a.longitude - b.longitude) < 6e-3), near AS (SELECT * FROM pairs WHERE dist_m <= 500)"""


@query(f"SELECT timestamp, mmsi, other, {rd('dist_m', 'dist_m')} FROM near", NEIGHBOR_CTE)
def neighbors_within(spark, d):
    return spatial.neighbor_pairs(hourly(spark, d), 500.0).select("timestamp", "mmsi", "other", r6("dist_m"))


@query(
    "SELECT c.timestamp, c.mmsi, CAST(coalesce(n.n, 0) AS INTEGER) AS n_within, "
    + ", ".join(f"round(n.d{i}, 6) + 0e0 AS \"{i}_dist_m\", coalesce(n.m{i}, -1) AS \"{i}_mmsi\"" for i in range(3))
    + " FROM clock c LEFT JOIN (SELECT timestamp, mmsi, count(*) AS n, "
    + ", ".join(f"max(dist_m) FILTER (WHERE k = {i + 1}) AS d{i}, max(other) FILTER (WHERE k = {i + 1}) AS m{i}" for i in range(3))
    + " FROM (SELECT *, row_number() OVER (PARTITION BY timestamp, mmsi ORDER BY dist_m, other) AS k FROM near) GROUP BY 1, 2) n ON c.timestamp = n.timestamp AND c.mmsi = n.mmsi",
    NEIGHBOR_CTE,
)
def neighbors_topk(spark, d):
    out = spatial.neighbors(hourly(spark, d), n_nearest=3, radius_m=500.0)
    return out.select("timestamp", "mmsi", "n_within", *[c for i in range(3) for c in (r6(f"{i}_dist_m"), f"{i}_mmsi")])


def ports(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey")
    return s.select(k.cast("bigint").alias("place"), (20 + (k % 11) * 0.017).alias("latitude"), (-80 + (k % 13) * 0.013).alias("longitude"))


PORT_CTE = "port AS (SELECT CAST(s_suppkey AS BIGINT) AS place, 20 + (s_suppkey % 11) * 17e-3 AS latitude, -80 + (s_suppkey % 13) * 13e-3 AS longitude FROM supplier)"


@query(
    f"SELECT a.event_id, CAST(coalesce(x.n, 0) AS INTEGER) AS n_within, round(x.d0, 6) + 0e0 AS \"0_dist_m\", x.p0 AS \"0_place\", round(x.d1, 6) + 0e0 AS \"1_dist_m\", x.p1 AS \"1_place\" FROM ais a LEFT JOIN (SELECT event_id, count(*) AS n, max(d) FILTER (WHERE k = 1) AS d0, max(place) FILTER (WHERE k = 1) AS p0, max(d) FILTER (WHERE k = 2) AS d1, max(place) FILTER (WHERE k = 2) AS p1 FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, place) AS k FROM (SELECT a.event_id, p.place, {hav('a.latitude', 'a.longitude', 'p.latitude', 'p.longitude')} AS d FROM ais a, port p) WHERE d <= 3000) GROUP BY 1) x ON a.event_id = x.event_id",
    PORT_CTE,
)
def nearest_port(spark, d):
    out = spatial.nearest_places(reports(spark, d), ports(spark, d), keys=["event_id"], n_nearest=2, radius_m=3000.0)
    return out.select("event_id", "n_within", r6("0_dist_m"), "0_place", r6("1_dist_m"), "1_place")


GEOM_CTE = CLOCK_CTE + f""", grid2 AS (SELECT mmsi, make_timestamp(t) AS t FROM (SELECT mmsi, unnest(range(CAST(ceil((epoch_us(a) + 1) / 3600e6) AS BIGINT) * 3600000000 - 1, epoch_us(b) + 1, 3600000000)) AS t FROM span)),
pv2 AS (SELECT g.mmsi, g.t, s.timestamp AS t0, s.latitude AS lat0, s.longitude AS lon0 FROM grid2 g ASOF JOIN seqd s ON g.mmsi = s.mmsi AND g.t >= s.timestamp),
bs2 AS (SELECT p.*, s.timestamp AS t1, s.latitude AS lat1, s.longitude AS lon1 FROM pv2 p ASOF JOIN seqd s ON p.mmsi = s.mmsi AND p.t <= s.timestamp),
ends AS (SELECT mmsi, t AS timestamp, lat0 + (lat1 - lat0) * f AS latitude, lon0 + (lon1 - lon0) * f AS longitude FROM (SELECT *, CASE WHEN t = t0 THEN 0e0 ELSE (epoch_us(t) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END AS f FROM bs2)),
pts AS (SELECT mmsi, timestamp, latitude, longitude FROM ais UNION ALL SELECT c.mmsi, c.timestamp, c.latitude, c.longitude FROM clock c ANTI JOIN ais a ON a.mmsi = c.mmsi AND a.timestamp = c.timestamp UNION ALL SELECT e.mmsi, e.timestamp, e.latitude, e.longitude FROM ends e ANTI JOIN ais a ON a.mmsi = e.mmsi AND a.timestamp = e.timestamp),
bp AS (SELECT *, date_trunc('hour', timestamp) AS bin FROM pts),
ord AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY mmsi, bin) AS n, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, avg(latitude) OVER (PARTITION BY mmsi, bin) AS mlat, avg(longitude) OVER (PARTITION BY mmsi, bin) AS mlon FROM bp WINDOW w AS (PARTITION BY mmsi, bin ORDER BY timestamp)),
geom AS (SELECT mmsi, bin, count(*) AS count, avg(latitude) AS mean_latitude, avg(longitude) AS mean_longitude, {cosd('min(latitude) FILTER (WHERE k = 1)', 'min(longitude) FILTER (WHERE k = 1)', 'min(latitude) FILTER (WHERE k = n)', 'min(longitude) FILTER (WHERE k = n)')} AS e2e,
  max({cosd('latitude', 'longitude', 'mlat', 'mlon')}) AS exc, sum({cosd('plat', 'plon', 'latitude', 'longitude')}) AS path FROM ord GROUP BY 1, 2),
spans AS (SELECT a.mmsi, a.bin, max({cosd('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}) AS span FROM bp a JOIN bp b ON a.mmsi = b.mmsi AND a.bin = b.bin GROUP BY 1, 2)"""


def r2(c, name=None):
    out = F.round(F.col(c) if isinstance(c, str) else c, 2) + F.lit(0.0)
    return out.alias(name or c)


@query("SELECT g.mmsi, g.bin, g.count, round(g.mean_latitude, 6) AS mean_latitude, round(g.mean_longitude, 6) AS mean_longitude, CASE WHEN g.count > 1 THEN round(g.path, 1) + 0e0 END AS path_m, CASE WHEN g.count > 1 THEN round(s.span, 1) + 0e0 END AS span_m, CASE WHEN g.count > 1 THEN round(g.exc, 1) + 0e0 END AS excursion_m, CASE WHEN g.count > 1 THEN round(g.e2e, 1) + 0e0 END AS end2end_m FROM geom g JOIN spans s ON g.mmsi = s.mmsi AND g.bin = s.bin", GEOM_CTE)
def traj_geometry_hourly(spark, d):
    # The arc cosine loses about half of the digits for near points, so metres are compared to one place.
    out = clock.trajectory_features(reports(spark, d))
    m = lambda c: (F.round(c, 1) + F.lit(0.0)).alias(c)
    return out.select("mmsi", "bin", "count", r6("mean_latitude"), r6("mean_longitude"), m("path_m"), m("span_m"), m("excursion_m"), m("end2end_m"))


LOITER_CTE = f"""lr AS (SELECT mmsi, timestamp, latitude, longitude, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY mmsi) AS n, (epoch_us(timestamp) - epoch_us(min(timestamp) OVER (PARTITION BY mmsi))) / 1e6 AS el FROM ais WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp)),
lp AS (SELECT a.mmsi, a.i, a.n, b.i AS j, {cosd('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} < 2000 AS near FROM lr a JOIN lr b ON a.mmsi = b.mmsi AND b.i >= a.i - 1),
lc AS (SELECT mmsi, i, coalesce(min(j) FILTER (WHERE j > i AND NOT near), any_value(n)) AS e FROM lp GROUP BY mmsi, i HAVING NOT coalesce(bool_or(near) FILTER (WHERE j = i - 1), false))"""


@query("SELECT c.mmsi, min(r.timestamp) AS begin, max(r.timestamp) AS \"end\", count(*) AS n, round(sum(r.el), 3) AS weight FROM lc c JOIN lr r ON r.mmsi = c.mmsi AND r.i >= c.i AND r.i < c.e WHERE c.e - c.i > 1 GROUP BY c.mmsi, c.i", LOITER_CTE)
def loiter_candidates(spark, d):
    return stays.loiter_candidates(reports(spark, d), 2000.0).withColumn("weight", F.round("weight", 3))


@query()
def loitering(spark, d):
    return stays.loitering(reports(spark, d), 2000.0)


BROKEN_CTE = KIN_CTE + ", brk AS (SELECT mmsi, coalesce(bool_or(coalesce(delta_m / nullif(delta_sec, 0) > 3e-1 OR delta_sec > 86400, false)), false) AS broken FROM kin GROUP BY mmsi)"


@query("SELECT mmsi, broken FROM brk", BROKEN_CTE)
def broken_tracks(spark, d):
    return stays.broken_tracks(reports(spark, d), speed_m_sec=0.3, gap_sec=86400)


_BRANCH_SQL = "SELECT a.mmsi, a.timestamp, CASE WHEN b.broken THEN least(a.timestamp, coalesce((SELECT min(u) FROM reach r WHERE r.mmsi = a.mmsi AND r.t = a.timestamp), a.timestamp)) END AS branch_start FROM ais a JOIN brk b ON a.mmsi = b.mmsi"
_BRANCH_CTE = (
    BROKEN_CTE
    + f""", lk AS (SELECT a.mmsi, a.timestamp AS t, b.timestamp AS u FROM ais a JOIN brk k ON k.mmsi = a.mmsi AND k.broken JOIN ais b ON a.mmsi = b.mmsi AND a.timestamp <> b.timestamp AND abs(epoch_us(a.timestamp) - epoch_us(b.timestamp)) <= 86400e6
    WHERE {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 3e-1 * abs(epoch_us(a.timestamp) - epoch_us(b.timestamp)) / 1e6), reach AS (SELECT mmsi, t, u FROM lk UNION SELECT r.mmsi, r.t, l.u FROM reach r JOIN lk l ON r.mmsi = l.mmsi AND r.u = l.t)"""
)


@query(_BRANCH_SQL, _BRANCH_CTE)
def spoof_branches(spark, d):
    return stays.spoof_branches(reports(spark, d), speed_m_sec=0.3, gap_sec=86400)


@query(_BRANCH_SQL, _BRANCH_CTE)
def spoof_branches_by_week(spark, d):
    """The same, a week at a time: each run sees one week's reports and what the week before has handed on."""
    all_ = reports(spark, d).withColumn("week", F.date_trunc("week", "timestamp").cast("date"))
    path = f"{checkpoint_dir(spark)}/branches-{uuid.uuid4().hex}"
    for week in sorted(r["week"] for r in all_.select("week").distinct().collect()):
        branches.append(all_.where(F.col("week") == F.lit(week)), path, str(week), speed_m_sec=0.3, gap_sec=86400)
    return branches.branches(spark, path)
