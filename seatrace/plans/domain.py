"""Queries over tags, rules, pairing, text and learning, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from seatrace.functions import scalars
from seatrace.operators import clock, harvest, learning, multilabel, pairing, rules, space_time, spatial
from seatrace.sources import documents as sources
from seatrace.sources import rasters
from seatrace.storage import written

from .tracks import CLOCK_CTE, DET_SQL, detections, hav, hourly, ports, query, r6, rd, reports

TYPE_SQL = "type_label(code, label) AS (VALUES " + ", ".join(f"({c}, '{rules.type_name(c)} ({c})')" for c in range(100)) + ")"

#: Derived boxes: one for each nation, five in a row.
ZONE_SQL = "zone AS (SELECT n_nationkey AS ord, n_name AS name, -801e-1 + (n_nationkey % 5) * 6e-2 AS x0, 199e-1 + (n_nationkey // 5) * 8e-2 AS y0 FROM nation)"


def zones(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey")
    x, y = -80.1 + (k % 5) * 0.06, 19.9 + F.floor(k / 5) * 0.08
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    return n.select(k.cast("bigint").alias("ord"), F.col("n_name").alias("name"), F.array(corner(0, 0), corner(0.06, 0), corner(0.06, 0.08), corner(0, 0.08)).alias("ring"))


@query("SELECT a.event_id, (SELECT arg_min(z.name, z.ord) FROM zone z WHERE a.longitude > z.x0 AND a.longitude < z.x0 + 6e-2 AND a.latitude > z.y0 AND a.latitude < z.y0 + 8e-2) AS name FROM ais a", ZONE_SQL)
def eez_tag(spark, d):
    return spatial.first_polygon(reports(spark, d), zones(spark, d), keys=["event_id"], cell=0.05)


@query(
    f"SELECT a.event_id, x.b.name AS name, x.b.kind AS kind, {rd('x.b.dd', 'dist_deg')} FROM ais a LEFT JOIN (SELECT event_id, arg_min({{'name': name, 'kind': CASE WHEN dd = 0 THEN 'inside' ELSE 'within' END, 'dd': dd}}, ord) AS b FROM far WHERE dd <= 3e-2 GROUP BY 1) x ON a.event_id = x.event_id",
    ZONE_SQL + ", far AS (SELECT a.event_id, z.ord, z.name, sqrt(pow(greatest(z.x0 - a.longitude, 0e0, a.longitude - (z.x0 + 6e-2)), 2) + pow(greatest(z.y0 - a.latitude, 0e0, a.latitude - (z.y0 + 8e-2)), 2)) AS dd FROM ais a, zone z)",
)
def zone_context(spark, d):
    out = spatial.polygon_context(reports(spark, d), zones(spark, d), keys=["event_id"], within_deg=0.03, cell=0.05)
    return out.select("event_id", "name", "kind", r6("dist_deg"))


def pipelines(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey")
    return n.select(k.cast("bigint").alias("ord"), F.col("n_name").alias("name"), (-80.05 + k * 0.008).alias("lon1"), (19.96 + (k % 7) * 0.03).alias("lat1"), (-80.04 + k * 0.008).alias("lon2"), (19.99 + (k % 5) * 0.03).alias("lat2"))


LINE_SQL = """line AS (SELECT n_nationkey AS ord, n_name AS name, -8005e-2 + n_nationkey * 8e-3 AS lon1, 1996e-2 + (n_nationkey % 7) * 3e-2 AS lat1, -8004e-2 + n_nationkey * 8e-3 AS lon2, 1999e-2 + (n_nationkey % 5) * 3e-2 AS lat2 FROM nation),
seg AS (SELECT a.event_id, l.ord, l.name, sqrt(pow(a.longitude - (l.lon1 + t * (l.lon2 - l.lon1)), 2) + pow(a.latitude - (l.lat1 + t * (l.lat2 - l.lat1)), 2)) AS dd FROM ais a, (SELECT *, pow(lon2 - lon1, 2) + pow(lat2 - lat1, 2) AS q FROM line) l, LATERAL (SELECT greatest(0e0, least(1e0, ((a.longitude - l.lon1) * (l.lon2 - l.lon1) + (a.latitude - l.lat1) * (l.lat2 - l.lat1)) / l.q)) AS t))"""


@query(f"SELECT a.event_id, x.name, {rd('x.dd', 'dist_deg')} FROM ais a LEFT JOIN (SELECT event_id, arg_min(name, ord) AS name, arg_min(dd, ord) AS dd FROM seg WHERE dd <= 2e-2 GROUP BY 1) x ON a.event_id = x.event_id", LINE_SQL)
def line_proximity(spark, d):
    out = spatial.near_line(reports(spark, d), pipelines(spark, d), keys=["event_id"], within_deg=0.02)
    return out.select("event_id", "name", r6("dist_deg"))


METRE_SQL = LINE_SQL.split("seg AS")[0] + """flat AS (SELECT n.ord, n.name, radians(n.lon1) * 6378137 AS x1, asinh(tan(radians(n.lat1))) * 6378137 AS y1, radians(n.lon2) * 6378137 AS x2, asinh(tan(radians(n.lat2))) * 6378137 AS y2 FROM line n),
spot AS (SELECT event_id, radians(longitude) * 6378137 AS x, asinh(tan(radians(latitude))) * 6378137 AS y, cos(radians(latitude)) AS k FROM ais),
seg AS (SELECT event_id, ord, name, k * sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) AS dd FROM spot, flat, LATERAL (SELECT greatest(0e0, least(1e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t))"""


@query(f"SELECT a.event_id, x.name, round(x.dd, 3) + 0e0 AS dist_m FROM ais a LEFT JOIN (SELECT event_id, arg_min(name, ord) AS name, arg_min(dd, ord) AS dd FROM seg WHERE dd <= 1500 GROUP BY 1) x ON a.event_id = x.event_id", METRE_SQL)
def line_proximity_metres(spark, d):
    """The first line within 1,500 metres of each report."""
    out = spatial.near_line(reports(spark, d), pipelines(spark, d), keys=["event_id"], within_m=1500.0)
    return out.select("event_id", "name", (F.round("dist_m", 3) + F.lit(0.0)).alias("dist_m"))


def raster(spark, d):
    """A made up field over the box of the reports, on a raster of 0.01 degrees."""
    cell = spark.range(60 * 60).select((F.col("id") / 60).cast("int").alias("i"), (F.col("id") % 60).cast("int").alias("j"))
    return cell.select((F.lit(6970) + F.col("i")).alias("row"), (F.lit(9970) + F.col("j")).alias("col"), ((F.col("i") * 7 + F.col("j") * 3) % 50 - 5).cast("double").alias("value"))


RASTER_SQL = "rast AS (SELECT CAST(6970 + i AS INTEGER) AS row, CAST(9970 + j AS INTEGER) AS col, CAST((i * 7 + j * 3) % 50 - 5 AS DOUBLE) AS value FROM range(60) a(i), range(60) b(j))"


@query("SELECT a.event_id, r.value FROM (SELECT event_id, greatest(0, least(17999, CAST(round_even((90 - latitude) / 180 * 18000 - 5e-1, 0) AS INTEGER))) AS row, greatest(0, least(35999, CAST(round_even((longitude + 180) / 360 * 36000 - 5e-1, 0) AS INTEGER))) AS col FROM ais) a LEFT JOIN rast r ON a.row = r.row AND a.col = r.col", RASTER_SQL)
def raster_tag(spark, d):
    return spatial.raster_lookup(reports(spark, d), raster(spark, d), rows=18000, cols=36000, name="value").select("event_id", "value")


_BUSY = "busy AS (SELECT event_id, greatest(0, least(17999, CAST(round_even((90 - latitude) / 180 * 18000 - 5e-1, 0) AS INTEGER))) AS row, greatest(0, least(35999, CAST(round_even((longitude + 180) / 360 * 36000 - 5e-1, 0) AS INTEGER))) AS col, sog FROM ais), crowd AS (SELECT row, col, CAST(count(*) AS DOUBLE) AS n FROM busy WHERE sog > 50 GROUP BY 1, 2)"


@query("SELECT event_id, n AS fast_reports FROM busy LEFT JOIN crowd USING (row, col)", _BUSY)
def raster_tag_tiles(spark, d):
    """A raster of how many fast reports each cell of 0.01 degrees has, kept in tiles and looked up for every report."""
    df = reports(spark, d)
    row, col = spatial.raster_cells(F.col("latitude"), F.col("longitude"), 18000, 36000)
    pixels = df.where("sog > 50").groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").cast("double").alias("value"))
    tiles = rasters.tiled(pixels, side=64)
    return spatial.tile_lookup(df.select("event_id", "latitude", "longitude"), tiles, rows=18000, cols=36000, side=64, name="fast_reports").select("event_id", "fast_reports")


@query("SELECT row, col, min(ord) AS value FROM (SELECT ord, 90 - (row + 5e-1) * 1e-2 AS lat, (col + 5e-1) * 1e-2 - 180 AS lon, row, col FROM zone z, (SELECT CAST(r AS BIGINT) AS row FROM range(6900, 7100) t(r)), (SELECT CAST(c AS BIGINT) AS col FROM range(9900, 10100) t(c)) WHERE lon > x0 AND lon < x0 + 6e-2 AND lat > y0 AND lat < y0 + 8e-2) GROUP BY 1, 2", ZONE_SQL)
def rasterise_zones(spark, d):
    return spatial.rasterise(zones(spark, d), rows=18000, cols=36000)


@query("SELECT a.event_id, coalesce(t.label, CAST(a.vessel_type AS VARCHAR)) AS type_label FROM ais a LEFT JOIN type_label t ON t.code = a.vessel_type", TYPE_SQL)
def describe_codes(spark, d):
    return rules.describe(reports(spark, d), rules.type_table(spark), "vessel_type", "type_label").select("event_id", "type_label")


_SOV = ["USA", "GBR", "FRA", "CAN", "NOR"]
_REGIONS = ["United States", "United Kingdom", "France", "Canada", rules.INTERNATIONAL]
LEGAL_SQL = TYPE_SQL + f", legal AS (SELECT a.event_id, a.length, lower(t.label) AS k, list_extract({_SOV}, CAST(a.mmsi % 5 + 1 AS BIGINT)) AS sov, list_extract({_REGIONS}, CAST(a.mmsi % 5 + 1 AS BIGINT)) AS region FROM ais a JOIN type_label t ON t.code = a.vessel_type)"


def legal(spark, d):
    df = rules.describe(reports(spark, d), rules.type_table(spark), "vessel_type", "type_label")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("mmsi") % 5 + 1).cast("int"))
    return df.withColumns({"sovereign": pick(_SOV), "region": pick(_REGIONS)})


_FLAGS = {
    "passenger": "k LIKE '%passenger%'", "cargo": "k LIKE '%cargo%'", "usa_length": "sov = 'USA' AND length > 198e-1 AND k NOT LIKE '%sailing (36)%'", "towing": "k LIKE '%towing%'", "tug_length": "k LIKE '%tug%' AND length > 79e-1",
    "usa_fishing": "sov = 'USA' AND k LIKE '%fishing%' AND length > 198e-1", "uk_fishing": "sov = 'GBR' AND k LIKE '%fishing%' AND length BETWEEN 15 AND 18", "eu_fishing": "sov = 'FRA' AND k LIKE '%fishing%' AND length >= 12", "canada": "sov = 'CAN' AND length >= 8",
}


@query("SELECT event_id, " + ", ".join(f"({v}) AS {k}" for k, v in _FLAGS.items()) + ", (" + " OR ".join(f"({v})" for v in _FLAGS.values()) + ") AS required FROM legal", LEGAL_SQL)
def legality_flags(spark, d):
    return rules.legality_flags(legal(spark, d)).select("event_id", *_FLAGS, "required")


_CHAIN = {
    "international": f"length BETWEEN 8 AND 45 AND region = '{rules.INTERNATIONAL}'", "length": "length >= 45", "passenger": "k LIKE '%passenger%'", "cargo": "k LIKE '%cargo%'", "usa": "length >= 198e-1 AND region = 'United States'",
    "towing": "k LIKE '%towing%' OR (k LIKE '%tug%' AND length >= 79e-1)", "uk_fishing": "length BETWEEN 15 AND 18 AND k LIKE '%fishing%' AND region = 'United Kingdom'", "eu_fishing": "length >= 12 AND k LIKE '%fishing%' AND region = 'France'", "canada": "length >= 8 AND region = 'Canada'",
}
_CASE = "CASE " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in _CHAIN.items()) + " END"


@query(f"SELECT event_id, {_CASE} AS rule, ({_CASE}) IS NOT NULL AS needs_ais FROM legal", LEGAL_SQL)
def legality_chain(spark, d):
    return rules.legality_chain(legal(spark, d)).select("event_id", "rule", "needs_ais")


_PLACED = LEGAL_SQL + ", " + ZONE_SQL + f""", treaty AS (SELECT CASE n_name WHEN 'NATION_0' THEN 'United States of America' WHEN 'NATION_3' THEN 'Canada' WHEN 'NATION_2' THEN 'France' WHEN 'NATION_1' THEN 'United Kingdom' ELSE n_name END AS country, n_regionkey AS signed FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey % 4 = 1)),
land AS (SELECT ord, CASE name WHEN 'NATION_0' THEN 'United States' WHEN 'NATION_3' THEN 'Canada' WHEN 'NATION_2' THEN 'France' WHEN 'NATION_1' THEN 'United Kingdom' ELSE name END AS name, x0, y0 FROM zone),
placed AS (SELECT a.event_id, l.length, l.k, coalesce((SELECT arg_min(z.name, z.ord) FROM land z WHERE a.longitude > z.x0 AND a.longitude < z.x0 + 6e-2 AND a.latitude > z.y0 AND a.latitude < z.y0 + 8e-2), '{rules.INTERNATIONAL}') AS region FROM ais a JOIN legal l USING (event_id)),
sole AS (SELECT country, min(signed) AS signed FROM treaty GROUP BY 1 HAVING count(*) = 1)"""


@query(f"SELECT event_id, region, signed, {_CASE} AS rule, ({_CASE}) IS NOT NULL AS needs_ais FROM placed LEFT JOIN sole ON country = CASE region WHEN 'United States' THEN 'United States of America' ELSE region END", _PLACED)
def legality_by_place(spark, d):
    """Region by zone and treaty by region, for every report; a quarter of the nations has two treaty rows, so none counts."""
    proper = {"NATION_0": "United States", "NATION_3": "Canada", "NATION_2": "France", "NATION_1": "United Kingdom"}
    spoken = lambda c, us: F.coalesce(F.create_map(*[F.lit(x) for k, v in (proper | {"NATION_0": us}).items() for x in (k, v)])[F.col(c)], F.col(c))
    nation = spark.read.parquet(f"{d}/nation.parquet")
    treaties = nation.unionByName(nation.where("n_nationkey % 4 = 1")).select(spoken("n_name", "United States of America").alias("country"), F.col("n_regionkey").alias("signed"))
    land = zones(spark, d).withColumn("name", spoken("name", "United States"))
    return rules.legality_by_place(legal(spark, d), land, treaties, keys=["event_id"], cell=0.05)


@query("SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN status END IGNORE NULLS) OVER w AS status, last_value(CASE WHEN event_id % 4 = 0 THEN sog END IGNORE NULLS) OVER w AS sog FROM ais WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def forward_filled(spark, d):
    """Status and speed as if most reports had come without them."""
    e = F.col("event_id")
    thin = reports(spark, d).withColumns({"status": F.when(e % 3 == 0, F.col("status")), "sog": F.when(e % 4 == 0, F.col("sog"))})
    return clock.forward_fill(thin, ["status", "sog"]).select("event_id", "status", "sog")


def harvested(spark, d):
    return harvest.harvest(
        reports(spark, d),
        types=rules.type_table(spark),
        ports=ports(spark, d).withColumn("place", F.concat(F.lit("port "), F.col("place").cast("string"))),
        lines=pipelines(spark, d),
        zones=zones(spark, d).withColumn("name", F.when(F.col("ord") % 3 == 0, "prohibited").otherwise("free")),
        rasters={"coast_distance_km": (raster(spark, d), 18000, 36000), "shipping_intensity": (raster(spark, d).withColumn("value", F.greatest(F.lit(0.0), F.col("value") - 30)), 18000, 36000)},
        loiter_m=2000.0,
        neighbor_m=500.0,
    )


@query()
def harvest_features(spark, d):
    return harvested(spark, d)


_BEHAVIOR = {"speed": 0.5, "ang_vel": 0.01, "coast": 5e3, "dark_sec": 36000.0}


@query()
def behaviors(spark, d):
    return rules.behaviors(harvested(spark, d), _BEHAVIOR)


_KINDS = ["Fishing (30)", "Dredging or underwater ops (33)", "Diving ops (34)", "Cargo, all ships of this type (70)", "Tug (52)"]

FEATURE_SQL = f"""feat AS (SELECT user_id AS mmsi, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS timestamp, CASE WHEN event_id * 7 % 5 < 4 THEN 6e1 END AS loiter_sec, event_id * 13 % 7 * 1e3 AS excursion_m, event_id * 11 % 41 - 1e1 AS coast_distance_km,
event_id * 17 % 50 AS max_speed_m_sec, event_id * 19 % 121 - 60 AS max_ang_vel_deg_sec, event_id * 23 % 97 * 6e1 AS max_delta_sec, list_extract({_KINDS}, user_id % 6 + 1) AS type_label, CASE WHEN event_id * 31 % 3 < 2 THEN 0 ELSE 1 END AS shipping_intensity,
CASE event_id * 37 % 3 WHEN 0 THEN 'prohibited' WHEN 1 THEN 'free' END AS fish_rule, CASE WHEN event_id * 41 % 3 = 0 THEN 'p' END AS pipeline, CASE WHEN event_id * 43 % 4 = 0 THEN 'h' END AS port FROM events),
beh AS (SELECT *, coast_distance_km * 1e3 AS coast, max_speed_m_sec > 35 OR abs(max_ang_vel_deg_sec) > 45 AS wild, coalesce(lower(type_label) LIKE '%fishing (30)%', false) AS fishing, max_delta_sec > 3600 AS dark,
excursion_m < 5e3 AND loiter_sec IS NOT NULL AND coalesce(lead(loiter_sec IS NOT NULL) OVER (PARTITION BY mmsi ORDER BY timestamp), false) AS stay, coast_distance_km > 10 AND coalesce(lower(type_label) LIKE '%cargo%', false) AND shipping_intensity = 0 AS odd FROM feat)"""


def features(spark, d):
    """A wide table by rule in which every behaviour occurs."""
    e = F.col("event_id")
    part = lambda a, m: e * a % m
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").alias("mmsi"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, event_id)").alias("timestamp"), F.when(part(7, 5) < 4, 60.0).alias("loiter_sec"), (part(13, 7) * 1e3).alias("excursion_m"), (part(11, 41) - 10.0).alias("coast_distance_km"),
        part(17, 50).alias("max_speed_m_sec"), (part(19, 121) - 60).alias("max_ang_vel_deg_sec"), (part(23, 97) * 60.0).alias("max_delta_sec"), F.get(F.array(*map(F.lit, _KINDS)), F.col("user_id") % 6).alias("type_label"), F.when(part(31, 3) < 2, 0).otherwise(1).alias("shipping_intensity"),
        F.when(part(37, 3) == 0, "prohibited").when(part(37, 3) == 1, "free").alias("fish_rule"), F.when(part(41, 3) == 0, "p").alias("pipeline"), F.when(part(43, 4) == 0, "h").alias("port"),
    )


@query(
    "SELECT mmsi, timestamp, stay AND excursion_m > 0 AS loitering_at_sea, coalesce(pipeline IS NOT NULL AND stay AND (type_label LIKE '%(33)%' OR type_label LIKE '%(34)%'), false) AS loitering_pipeline_work, port IS NOT NULL AND stay AS loitering_port, coast > 1e4 AND stay AS loitering_far, coast < 1e4 AND stay AS loitering_near, coast > 0 AND wild AS oob_at_sea, coast < 0 AND wild AS oob_at_coast, coalesce(coast > 0 AND fish_rule = 'prohibited' AND stay AND fishing, false) AS fishing_prohibited, coast > 0 AND dark AND stay AND fishing AS fishing_dark, coalesce(coast > 0 AND dark AND fish_rule = 'prohibited' AND stay AND fishing, false) AS fishing_prohibited_dark, odd AND avg(CAST(odd AS INTEGER)) OVER (PARTITION BY mmsi) > 3e-1 AS anomalous_routing FROM beh",
    FEATURE_SQL,
)
def behavior_rules(spark, d):
    return rules.behaviors(features(spark, d), {"anomalous": 0.3})


@query()
def transshipment(spark, d):
    return rules.transshipment(harvested(spark, d), thresholds={"transshipment": 400.0, "coast": 5e3})


PAIR_CTE = CLOCK_CTE.split("span AS")[0].rstrip().rstrip(",") + f""", {DET_SQL}, inst AS (SELECT DISTINCT timestamp AS t FROM det), spn AS (SELECT mmsi, min(timestamp) AS a, max(timestamp) AS b FROM ais GROUP BY 1),
gi AS (SELECT s.mmsi, i.t FROM spn s, inst i WHERE i.t BETWEEN s.a AND s.b),
gp AS (SELECT g.mmsi, g.t, s.timestamp AS t0, s.latitude AS lat0, s.longitude AS lon0, s.seq FROM gi g ASOF JOIN seqd s ON g.mmsi = s.mmsi AND g.t >= s.timestamp),
gn AS (SELECT p.*, s.timestamp AS t1, s.latitude AS lat1, s.longitude AS lon1 FROM gp p ASOF JOIN seqd s ON p.mmsi = s.mmsi AND p.t <= s.timestamp),
gf AS (SELECT *, CASE WHEN t = t0 THEN 0e0 ELSE (epoch_us(t) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END AS f FROM gn),
sh AS (SELECT mmsi, t, lat0 + (lat1 - lat0) * f AS latitude, lon0 + (lon1 - lon0) * f AS longitude, CASE WHEN round_even(seq + f, 0) > seq THEN t1 ELSE t0 END AS tn FROM gf),
cand AS (SELECT d.det_id, d.timestamp, s.mmsi, s.tn, {hav('s.latitude', 's.longitude', 'd.latitude', 'd.longitude')} AS dist_m FROM det d JOIN sh s ON s.t = d.timestamp WHERE abs(epoch_us(s.tn) - epoch_us(s.t)) < 14400e6 AND abs(s.latitude - d.latitude) < 6e-2),
near AS (SELECT * FROM cand WHERE dist_m <= 5000)"""
_LIMITS = {"threshold_sec": 14400.0, "threshold_m": 5000.0}


@query(f"SELECT det_id, timestamp, mmsi, {rd('dist_m', 'dist_m')} FROM near", PAIR_CTE)
def pairing_candidates(spark, d):
    return pairing.candidates(detections(spark, d), reports(spark, d), **_LIMITS).select("det_id", "timestamp", "mmsi", r6("dist_m"))


def paired(spark, d, permutations=1000, **limits):
    return pairing.infer_identity(detections(spark, d), reports(spark, d), max_permutations=permutations, **(_LIMITS | limits))


@query()
def pairing_permuted(spark, d):
    return paired(spark, d)


@query()
def pairing_greedy(spark, d):
    return paired(spark, d, 1)


@query()
def pairing_stats(spark, d):
    return pairing.quality(pairing.sweep(detections(spark, d), reports(spark, d), [14400.0], [2000.0, 5000.0], [1, 1000]), by=["threshold_sec", "threshold_m", "max_permutations"])


def crowded(spark, d):
    """The detections as mosaics of six hours each: many of one instant, and more than one with the same ship nearest."""
    return detections(spark, d).withColumn("timestamp", F.expr("timestamp_micros(unix_micros(date_trunc('day', timestamp)) + 21600000000 * (hour(timestamp) div 6))").cast("timestamp_ntz"))


@query()
def pairing_crowded(spark, d):
    """Pairs of detections that compete for ships, one by one (1) and with permutations (1000)."""
    runs = pairing.sweep(crowded(spark, d), reports(spark, d), [14400.0], [5000.0], [1, 1000])
    return runs.select("max_permutations", "det_id", "timestamp", "mmsi", r6("dist_m"), "greedy_count")


@query()
def pairing_compare(spark, d):
    return pairing.compare(paired(spark, d, 1), paired(spark, d))


_CAND = PAIR_CTE + f", got AS (SELECT mmsi, tn AS timestamp, det_id, timestamp AS det_timestamp, {rd('dist_m', 'dist_m')} FROM near)"


def _master(how, sql):
    def f(spark, d):
        return pairing.merge_candidates(detections(spark, d), reports(spark, d), ["sog"], how, **_LIMITS).withColumn("dist_m", r6("dist_m"))

    f.__name__ = f"pairing_master_{how}"
    alone = " UNION ALL SELECT NULL, NULL, NULL, det_id, timestamp, NULL FROM det WHERE det_id NOT IN (SELECT det_id FROM near)"
    query(f"SELECT coalesce(f.mmsi, g.mmsi) AS mmsi, coalesce(f.timestamp, g.timestamp) AS timestamp, f.sog, g.det_id, g.det_timestamp, g.dist_m FROM ais f {sql} JOIN got g ON f.mmsi = g.mmsi AND f.timestamp = g.timestamp" + (alone if how in ("right", "outer") else ""), _CAND)(f)


for _how, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("inner", ""), ("outer", "FULL")):
    _master(_how, _sql)


def _master_whole(how):
    """All reports with all that infer_identity finds; the queries above join them with all candidates."""

    def f(spark, d):
        return pairing.merge_reports(reports(spark, d).select("mmsi", "timestamp", "sog"), paired(spark, d), how)

    f.__name__ = f"pairing_master_whole_{how}"
    query()(f)


for _how in ("left", "right", "inner", "outer"):
    _master_whole(_how)


#: For the clusters of the data: 1,500 m, or 1,500 seconds.
_DENSE = {"eps_m": 1500.0, "ns_per_m": 1e9, "min_points": 3}
_DENSE_SQL = DET_SQL + f""", close AS (SELECT a.det_id AS a, b.det_id AS b, sqrt(pow((epoch_us(a.timestamp) - epoch_us(b.timestamp)) * 1e-6, 2) + pow({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 2)) AS dd FROM det a JOIN det b ON abs(epoch_us(a.timestamp) - epoch_us(b.timestamp)) <= 15e8),
near_by AS MATERIALIZED (SELECT * FROM close WHERE dd <= 15e2), core AS MATERIALIZED (SELECT a AS id FROM near_by GROUP BY 1 HAVING count(*) >= 3), link AS MATERIALIZED (SELECT a, b FROM near_by WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT id, id AS other FROM core UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other), own AS (SELECT id, min(other) AS first FROM reach GROUP BY 1),
edge AS (SELECT a AS id, arg_min(b, (dd, b)) AS other FROM near_by WHERE a NOT IN (FROM core) AND b IN (FROM core) GROUP BY 1), named AS (SELECT id, first FROM own UNION ALL SELECT edge.id, first FROM edge JOIN own ON own.id = edge.other),
least AS (SELECT first, min(id) AS cluster FROM named GROUP BY 1)"""


@query("SELECT det_id, cluster FROM det LEFT JOIN (SELECT id, cluster FROM named JOIN least USING (first)) n ON n.id = det_id", _DENSE_SQL)
def space_time_clusters(spark, d):
    return space_time.clusters(detections(spark, d), **_DENSE)


@query()
def pairing_space_time(spark, d):
    return pairing.infer_space_time(detections(spark, d), reports(spark, d), **_LIMITS, ns_per_m=1e6)


@query(f"SELECT a.event_id FROM ais a WHERE EXISTS (SELECT 1 FROM det d WHERE abs(epoch_us(a.timestamp) - epoch_us(d.timestamp)) <= 900e6 AND {hav('a.latitude', 'a.longitude', 'd.latitude', 'd.longitude')} <= 4000)", DET_SQL)
def reports_near_detections(spark, d):
    return pairing.near_detections(reports(spark, d), detections(spark, d), threshold_sec=900.0, threshold_m=4000.0).select("event_id")


@query("SELECT minute, row, col, count(*) AS n, list_sort(list(det_id)) AS ids FROM (SELECT date_trunc('minute', timestamp) AS minute, CAST(floor((20.3::DOUBLE - latitude) / 2e-2) AS BIGINT) AS row, CAST(floor((longitude + 8015e-2) / 2e-2) AS BIGINT) AS col, det_id FROM det) GROUP BY 1, 2, 3", DET_SQL)
def cell_binning(spark, d):
    det = detections(spark, d)
    return det.groupBy(F.date_trunc("minute", "timestamp").cast("timestamp_ntz").alias("minute"), F.floor((20.3 - F.col("latitude")) / 0.02).alias("row"), F.floor((F.col("longitude") + 80.15) / 0.02).alias("col")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("det_id")).alias("ids"))


@query("SELECT label, trim(regexp_replace(regexp_replace(regexp_replace(lower(label), '[\\s,.]*(?:all ships of this type|not available or no ship, default|\\(.*\\)|for assignment to local vessel|reserved for future use|no additional information|reserved for regional use|null|no designation)[\\s,.]*', ' ', 'g'), '\\s+', ' ', 'g'), '\\bsar\\b', 'SAR', 'g')) AS cleaned FROM type_label", TYPE_SQL)
def clean_type_text(spark, d):
    return rules.type_table(spark).select("label", scalars.clean_text(F.col("label")).alias("cleaned"))


@query("SELECT label, CASE WHEN ends_with(label, ')') THEN trim(regexp_replace(regexp_replace(label, '\\(.*\\)', '', 'g'), ',.*', '', 'g')) ELSE label END AS short FROM type_label", TYPE_SQL)
def short_type_names(spark, d):
    return rules.type_table(spark).select("label", scalars.short_type(F.col("label")).alias("short"))


@query("SELECT event_id, list_filter(list_transform(string_split_regex(concat(status, ' ', CAST(event_id AS VARCHAR), ' x 1.5 -', CAST(mmsi AS VARCHAR)), '\\s+'), lambda t: TRY_CAST(t AS DOUBLE)), lambda v: v IS NOT NULL) AS numbers FROM ais")
def extract_numbers(spark, d):
    text = F.concat(F.col("status"), F.lit(" "), F.col("event_id").cast("string"), F.lit(" x 1.5 -"), F.col("mmsi").cast("string"))
    return reports(spark, d).select("event_id", scalars.numbers(text).alias("numbers"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k_ FROM events")
def json_flatten(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return df.select("event_id", *[c.alias(n) for c, n in scalars.flatten_schema(df.select("props").schema)])


@query("SELECT mmsi % 10 AS place, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, CAST(h * 300 AS INTEGER) AS time, CAST(h * 2 + mmsi % 3 AS INTEGER) AS temp, 'T' || CAST(CAST(timestamp AS DATE) AS VARCHAR) AS moon, CASE WHEN h * 300 <= 700 AND 700 < h * 300 + 300 THEN 'HIGH' END AS tide FROM (SELECT DISTINCT mmsi, CAST(timestamp AS DATE) AS timestamp FROM ais) x, range(8) t(h)")
def weather_explode(spark, d):
    return sources.weather_rows(sources.sample_weather(reports(spark, d)), step_hours=3)


@query("SELECT status, CAST(code AS INTEGER) AS code, CAST((code >> 2) & 1 AS INTEGER) AS b0, CAST((code >> 1) & 1 AS INTEGER) AS b1, CAST(code & 1 AS INTEGER) AS b2 FROM (SELECT status, row_number() OVER (ORDER BY f, status) AS code FROM (SELECT status, min(event_id) AS f FROM ais WHERE status IS NOT NULL GROUP BY 1))")
def encode_base2(spark, d):
    cats = learning.categories(reports(spark, d), "status", "event_id")
    return cats.select(F.col("value").alias("status"), F.col("code").cast("int").alias("code"), *[b.alias(f"b{i}") for i, b in enumerate(scalars.base2(F.col("code").cast("int"), 3))])


@query("SELECT event_id, CAST(coalesce(status = 'click', false) AS INTEGER) AS status_click, CAST(coalesce(status = 'view', false) AS INTEGER) AS status_view FROM ais")
def encode_one_hot(spark, d):
    return learning.prepare(reports(spark, d).select("event_id", "status"), {"ONE_HOT": {"status": ["click", "view"]}})


@query("SELECT mmsi, list_concat(f, list_resize([]::DOUBLE[], 30 - len(f), 0)) AS features FROM (SELECT mmsi, flatten(list(v ORDER BY n)) AS f FROM (SELECT mmsi, row_number() OVER (PARTITION BY mmsi ORDER BY timestamp) AS n, [sog, length, width] AS v FROM ais) WHERE n <= 10 GROUP BY mmsi HAVING count(*) > 1)")
def feature_sequence(spark, d):
    return learning.sequences(reports(spark, d), ["sog", "length", "width"])


@query("SELECT mmsi, [max(CAST(sog > 100 AS INTEGER)), max(CAST(status = 'view' AS INTEGER))] AS labels FROM ais GROUP BY 1")
def label_vector(spark, d):
    out = learning.any_labels(reports(spark, d), greater={"sog": 100}, equal={"status": "view"})
    return out.select("mmsi", F.array("sog_greater_100", "status_is_view").alias("labels"))


@query("SELECT DISTINCT mmsi, md5(CAST(mmsi AS VARCHAR)) < '33333333' AS is_test FROM ais")
def split_by_hash(spark, d):
    return learning.split_by_hash(reports(spark, d).select("mmsi").distinct(), "mmsi")


_PRED = "p AS (SELECT status, CAST(sog > 50 AS INTEGER) AS t, CAST(length > 30 AS INTEGER) AS p, length / 65 AS q FROM ais)"


@query("SELECT status, count(*) FILTER (WHERE t = 1 AND p = 1) AS tp, count(*) FILTER (WHERE t = 0 AND p = 1) AS fp, count(*) FILTER (WHERE t = 1 AND p = 0) AS fn, count(*) FILTER (WHERE t = 0 AND p = 0) AS tn, round(count(*) FILTER (WHERE t = 1 AND p = 1) / nullif(count(*) FILTER (WHERE p = 1), 0), 6) AS precision, round(count(*) FILTER (WHERE t = 1 AND p = 1) / nullif(count(*) FILTER (WHERE t = 1), 0), 6) AS recall, round(2 * count(*) FILTER (WHERE t = 1 AND p = 1) / nullif(count(*) FILTER (WHERE t = 1) + count(*) FILTER (WHERE p = 1), 0), 6) AS f1 FROM p GROUP BY 1", _PRED)
def confusion(spark, d):
    df = reports(spark, d).select("status", (F.col("sog") > 50).cast("int").alias("t"), (F.col("length") > 30).cast("int").alias("p"))
    return learning.confusion(df, "t", "p", ["status"]).select("status", "tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("f1"))


@query(f"SELECT {rd('avg(-(t * ln(greatest(1e-7, least(1 - 1e-7, q))) + (1 - t) * ln(1 - greatest(1e-7, least(1 - 1e-7, q)))))', 'bce')} FROM p", _PRED)
def bce_loss(spark, d):
    df = reports(spark, d).select((F.col("sog") > 50).cast("int").alias("t"), (F.col("length") / 65).alias("q"))
    return learning.bce(df, "t", "q").select(r6("bce"))


@query("SELECT count(*) AS n FROM ais WHERE NOT sog > 50 AND NOT length > 30")
def zero_label_count(spark, d):
    df = reports(spark, d).select((F.col("sog") > 50).cast("int").alias("a"), (F.col("length") > 30).cast("int").alias("b"))
    return learning.all_zero(df, ["a", "b"])


@query("SELECT CAST(floor((log10(sog) + 1) / (4e0 / 20)) AS INTEGER) AS bin, count(*) AS n FROM ais WHERE sog > 0 AND floor((log10(sog) + 1) / (4e0 / 20)) BETWEEN 0 AND 19 GROUP BY 1")
def log_histogram(spark, d):
    return learning.log_histogram(reports(spark, d), "sog", -1, 3, 20)


@query("SELECT status, vessel_type, count(*) AS n FROM ais GROUP BY 1, 2")
def type_histogram(spark, d):
    return reports(spark, d).groupBy("status", "vessel_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(min(n) AS BIGINT) AS mode_n FROM (SELECT n, count(*) AS c FROM (SELECT mmsi, count(*) AS n FROM ais GROUP BY 1) GROUP BY 1 QUALIFY c = max(c) OVER ())")
def mode_count(spark, d):
    per = reports(spark, d).groupBy("mmsi").agg(F.count("*").alias("n"))
    return per.agg(F.mode("n", True).cast("bigint").alias("mode_n"))


@query("SELECT mmsi, status FROM (SELECT DISTINCT mmsi, status FROM ais WHERE sog > 20) EXCEPT SELECT mmsi, status FROM ais WHERE sog > 60")
def unmatched_pairs(spark, d):
    df = reports(spark, d)
    return df.where("sog > 20").select("mmsi", "status").distinct().join(df.where("sog > 60").select("mmsi", "status"), ["mmsi", "status"], "left_anti")


@query("SELECT a.mmsi, CAST(s AS INTEGER) AS seconds, CAST(m AS INTEGER) AS metres FROM (SELECT DISTINCT mmsi FROM ais) a, (VALUES (60), (300), (900)) x(s), (VALUES (1000), (10000)) y(m)")
def parameter_grid(spark, d):
    ships = reports(spark, d).select("mmsi").distinct()
    return ships.withColumn("seconds", F.explode(F.array(F.lit(60), F.lit(300), F.lit(900)))).withColumn("metres", F.explode(F.array(F.lit(1000), F.lit(10000))))


#: As many as the reference has: trees of the forest, rounds of boosting.
TREES = {"rf": 100, "gbt": 149}


_FEATURES = ["length", "vessel_type", "coast_distance_km", "shipping_intensity", "max_speed_m_sec", "max_delta_sec", "path_m", "span_m", "n_within"]


def labelled(spark, d):
    """(mmsi, x, label): each ship's first ten hours in a line, and whether it loiters at sea in more than one hour of a hundred.

    What the rule of the label looks at (the stay) isn't among the features.
    """
    judged = rules.behaviors(harvested(spark, d), _BEHAVIOR, keep=_FEATURES)
    filled = judged.select("mmsi", "timestamp", "loitering_at_sea", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _FEATURES])
    label = (F.avg(F.col("loitering_at_sea").cast("double")) > 0.01).cast("double")
    return learning.sequences(filled, _FEATURES, also={"label": label}).select("mmsi", array_to_vector("features").alias("x"), "label")


def _train(kind):
    def f(spark, d):
        split = learning.split_by_hash(labelled(spark, d), "mmsi").persist()
        model = learning.train_trees(split.where("not is_test"), ["x"], "label", kind, trees=TREES.get(kind, 1))
        return learning.confusion(model.transform(split.where("is_test")), "label", "prediction")

    f.__name__ = f"train_{kind}"
    query()(f)


for _kind in ("rf", "gbt", "cart"):
    _train(_kind)


def labelled_reports(spark, d):
    """(event_id, x, ten labels of 0 and 1): where a report is and how fast and long its ship, and what holds for it."""
    df = reports(spark, d).select("event_id", "latitude", "longitude", "sog", "length", "status").where("latitude is not null and longitude is not null and sog is not null")
    x = F.array((F.col("latitude") - 20.1) / 0.1, (F.col("longitude") + 79.94) / 0.1, F.col("sog") / 50, (F.col("length") - 30) / 20)
    zone = spatial.first_polygon(df, zones(spark, d), keys=["event_id"], cell=0.05).select("event_id", F.col("name").alias("zone"))
    closed = zones(spark, d).where("ord % 3 = 0").select(F.col("name").alias("zone"), F.lit(True).alias("closed"))
    line = spatial.near_line(df, pipelines(spark, d), keys=["event_id"], within_m=1500.0).select("event_id", F.col("name").alias("line"))
    port = spatial.nearest_places(df, ports(spark, d), keys=["event_id"], n_nearest=1, radius_m=2000.0).select("event_id", "n_within")
    held = df.join(zone, "event_id", "left").join(closed, "zone", "left").join(line, "event_id", "left").join(port, "event_id", "left")
    slow, fast, inside = F.col("sog") < 20, F.col("sog") >= 60, F.coalesce("closed", F.lit(False))
    labels = {
        "in_closed_zone": inside, "near_line": F.col("line").isNotNull(), "at_port": F.col("n_within") > 0, "slow": slow, "cruising": ~slow & ~fast, "fast": fast,
        "large": F.col("length") >= 45, "middling": F.col("length").between(20, 44), "slow_in_closed_zone": slow & inside, "large_and_fast": fast & (F.col("length") >= 45),
    }
    return held.select("event_id", x.alias("x"), *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in labels.items()])


@query()
def train_labels(spark, d):
    """Ten labels learnt at once on four fifths of the reports and measured on the rest, beside what always saying yes gives."""
    split = written(learning.split_by_hash(labelled_reports(spark, d), "event_id"), "labelled-reports")
    names = [c for c in split.columns if c not in ("event_id", "x", "is_test")]
    model = multilabel.train_labels(split.where("not is_test"), "x", names, fourier=multilabel.Fourier(4, dims=256, scale=0.5))
    told = multilabel.label_measures(model.predict(split.where("is_test"), "x"), names)
    yes = F.try_divide(2 * (F.col("tp") + F.col("fn")), F.col("tp") + F.col("fn") + F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return told.withColumn("f1_of_yes", yes)
