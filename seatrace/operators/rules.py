"""Code descriptions, legal obligations and behaviour labels: projections over a wide feature table."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seatrace.shipping import ship_package

from .spatial import first_polygon
from .stays import BLOCK_ROWS
from .tracks import successive

#: Names of vessel type codes. Decades with classes by last digit, and single codes.
DECADES = {20: "Wing in ground (WIG)", 40: "High speed craft (HSC)", 60: "Passenger", 70: "Cargo", 80: "Tanker", 90: "Other Type"}
SINGLE = {
    0: "Not available (default)", 30: "Fishing", 31: "Towing", 32: "Towing: length exceeds 200m or breadth exceeds 25m", 33: "Dredging or underwater ops", 34: "Diving ops", 35: "Military ops", 36: "Sailing", 37: "Pleasure Craft", 38: "Reserved", 39: "Reserved",
    50: "Pilot Vessel", 51: "Search and Rescue vessel", 52: "Tug", 53: "Port Tender", 54: "Anti-pollution equipment", 55: "Law Enforcement", 56: "Spare - Local Vessel", 57: "Spare - Local Vessel", 58: "Medical Transport", 59: "Noncombatant ship according to RR Resolution No. 18",
}
EU = ("Austria", "Belgium", "Bulgaria", "Croatia", "Cyprus", "Czechia", "Denmark", "Estonia", "Finland", "France", "Germany", "Greece", "Hungary", "Ireland", "Italy", "Latvia", "Lithuania", "Luxembourg", "Malta", "Netherlands", "Poland", "Portugal", "Romania", "Slovakia", "Slovenia", "Spain", "Sweden")
INTERNATIONAL = "INTERNATIONAL WATERS"


def type_name(code: int) -> str:
    if code in SINGLE:
        return SINGLE[code]
    decade, unit = code // 10 * 10, code % 10
    if decade not in DECADES:
        return "Reserved for future use"
    tail = "all ships of this type" if unit == 0 else f"Hazardous category {'ABCD'[unit - 1]}" if unit < 5 else "Reserved for future use" if unit < 9 else "No additional information"
    return f"{DECADES[decade]}, {tail}"


def type_table(spark: SparkSession) -> DataFrame:
    """(code, label) of the codes 0 to 99; labels end with their code in brackets."""
    return spark.createDataFrame([(c, f"{type_name(c)} ({c})") for c in range(100)], "code int, label string")


def describe(df: DataFrame, table: DataFrame, code: str, name: str) -> DataFrame:
    """df with the label of a code; codes without one become text. The table has one row for each of at most 100 codes."""
    return df.join(F.broadcast(table.select(F.col("code").alias(code), F.col("label").alias("__l"))), code, "left").withColumn(name, F.coalesce("__l", F.col(code).cast("string"))).drop("__l")


def _says(label: Column, word: str) -> Column:
    return F.coalesce(F.lower(label).contains(word.lower()), F.lit(False))


def legality_flags(df: DataFrame, *, label: str = "type_label", sovereign: str = "sovereign", length: str = "length") -> DataFrame:
    """df with nine obligations and `required`. sovereign: an ISO code of three letters."""
    kind, of, size = F.col(label), F.upper(F.col(sovereign)), F.col(length)
    eu = ("AUT", "BEL", "BGR", "HRV", "CYP", "CZE", "DNK", "EST", "FIN", "FRA", "DEU", "GRC", "HUN", "IRL", "ITA", "LVA", "LTU", "LUX", "MLT", "NLD", "POL", "PRT", "ROU", "SVK", "SVN", "ESP", "SWE")
    fishing = _says(kind, "fishing")
    flags = {
        "passenger": _says(kind, "passenger"),
        "cargo": _says(kind, "cargo"),
        "usa_length": (of == "USA") & (size > 19.8) & ~_says(kind, "sailing (36)"),
        "towing": _says(kind, "towing"),
        "tug_length": _says(kind, "tug") & (size > 7.9),
        "usa_fishing": (of == "USA") & fishing & (size > 19.8),
        "uk_fishing": (of == "GBR") & fishing & size.between(15, 18),
        "eu_fishing": of.isin(*eu) & fishing & (size >= 12),
        "canada": (of == "CAN") & (size >= 8),
    }
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    required = F.lit(False)
    for k in flags:
        required = required | F.col(k)
    return df.withColumns(flags).withColumn("required", required)


def legality_chain(df: DataFrame, *, label: str = "type_label", region: str = "region", length: str = "length") -> DataFrame:
    """df with the first rule that asks for a transmitter (null: none) and needs_ais. region: a country's name."""
    kind, where, size = F.col(label), F.col(region), F.col(length)
    fishing = _says(kind, "fishing")
    rules = [
        ("international", size.between(8, 45) & (where == INTERNATIONAL)),
        ("length", size >= 45),
        ("passenger", _says(kind, "passenger")),
        ("cargo", _says(kind, "cargo")),
        ("usa", (size >= 19.8) & (where == "United States")),
        ("towing", _says(kind, "towing") | (_says(kind, "tug") & (size >= 7.9))),
        ("usa_fishing", (size >= 19.8) & fishing & (where == "United States")),
        ("uk_fishing", size.between(15, 18) & fishing & (where == "United Kingdom")),
        ("eu_fishing", (size >= 12) & fishing & where.isin(*EU)),
        ("canada", (size >= 8) & (where == "Canada")),
    ]
    chain = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        chain = F.when(rule, F.lit(name)).otherwise(chain)
    return df.withColumn("rule", chain).withColumn("needs_ais", F.col("rule").isNotNull())


def ratified(df: DataFrame, treaties: DataFrame, key: str) -> DataFrame:
    """df with a treaty row where exactly one has its key."""
    single = treaties.withColumn("__n", F.count("*").over(W.partitionBy(key))).where("__n = 1").drop("__n")
    return df.join(single, key, "left")


#: A fixed value: what the treaty table calls a region that has another name elsewhere.
TREATY_NAME = {"United States": "United States of America"}


def legality_by_place(ships: DataFrame, zones: DataFrame, treaties: DataFrame, *, keys: Sequence[str], country: str = "country", label: str = "type_label", length: str = "length", cell: float = 0.1) -> DataFrame:
    """The legality chain for ships at their places: keys, region, the columns of the region's treaty, rule and needs_ais.

    The region is the first zone that holds the place (zones: ord, name, ring), else international waters. treaties has a
    column `country`; a region gets its row only if there is exactly one. Ships without a place are in no zone.
    """
    region = first_polygon(ships, zones, keys=keys, cell=cell).select(*keys, F.coalesce("name", F.lit(INTERNATIONAL)).alias("region"))
    judged = legality_chain(ships.select(*keys, label, length).join(region, list(keys)), label=label, length=length)
    named = F.col("region")
    for here, there in TREATY_NAME.items():
        named = F.when(F.col("region") == here, F.lit(there)).otherwise(named)
    extra = [c for c in treaties.columns if c != country]
    return ratified(judged.withColumn(country, named), treaties, country).select(*keys, "region", *extra, "rule", "needs_ais")


#: Thresholds of the labels, in metres, seconds and degrees a second.
THRESHOLDS = {"loitering": 5e3, "speed": 35.0, "ang_vel": 45.0, "transshipment": 20.0, "coast": 10e3, "anomalous": 0.5, "dark_sec": 3600.0}


def behaviors(df: DataFrame, thresholds: dict | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(mmsi, timestamp), columns to keep, and eleven labels from the columns of harvest()."""
    t = THRESHOLDS | (thresholds or {})
    coast = F.col("coast_distance_km") * 1e3
    df = successive(df, F.col("loiter_sec") >= 0, "__stay").withColumn("__stay", F.col("__stay") & F.coalesce(F.col("excursion_m") < t["loitering"], F.lit(False)))
    stay, kind = F.col("__stay"), F.col("type_label")
    wild = (F.col("max_speed_m_sec") > t["speed"]) | (F.abs(F.col("max_ang_vel_deg_sec")) > t["ang_vel"])
    fishing = _says(kind, "fishing (30)")
    odd = (coast > t["coast"]) & _says(kind, "cargo") & (F.col("shipping_intensity") == 0)
    prohibited = (coast > 0) & (F.col("fish_rule") == "prohibited") & stay & fishing
    dark = F.col("max_delta_sec") > t["dark_sec"]
    labels = {
        "loitering_at_sea": stay & (F.col("excursion_m") > 0),
        "loitering_pipeline_work": F.col("pipeline").isNotNull() & stay & (_says(kind, "(33)") | _says(kind, "(34)")),
        "loitering_port": F.col("port").isNotNull() & stay,
        "loitering_far": (coast > t["coast"]) & stay,
        "loitering_near": (coast < t["coast"]) & stay,
        "oob_at_sea": (coast > 0) & wild,
        "oob_at_coast": (coast < 0) & wild,
        "fishing_prohibited": prohibited,
        "fishing_dark": (coast > 0) & dark & stay & fishing,
        "fishing_prohibited_dark": prohibited & dark,
    }
    df = df.withColumn("__odd", F.coalesce(odd, F.lit(False)))
    df = df.withColumn("anomalous_routing", F.col("__odd") & (F.avg(F.col("__odd").cast("double")).over(W.partitionBy("mmsi")) > t["anomalous"]))
    return df.select("mmsi", "timestamp", *keep, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in labels.items()], "anomalous_routing")


def transshipment(df: DataFrame, *, n_nearest: int = 3, thresholds: dict | None = None, keys: Sequence[str] = ("mmsi",)) -> DataFrame:
    """(mmsi, timestamp, partner): the ship alongside in long common stays far from the coast, or -1.

    Runs of consecutive rows with the same partner are taken longest first (ties: nearer, then earlier) when none of
    their rows is taken. Runs end at rows without a partner, so a ship's track is cut there and its pieces are settled
    on their own; pieces that begin within the same BLOCK_ROWS rows make one group.
    """
    t = THRESHOLDS | (thresholds or {})
    df = successive(df, F.col("loiter_sec") >= 0, "__stay")
    far = F.col("__stay") & (F.col("excursion_m") < t["loitering"]) & (F.col("coast_distance_km") * 1e3 > t["coast"])
    near = [F.struct(F.col(f"{i}_mmsi").alias("m"), F.col(f"{i}_dist_m").alias("d")) for i in range(n_nearest)]
    ok = F.filter(F.array(*near), lambda x: (x["m"] >= 0) & (x["d"] <= t["transshipment"]))
    rows = df.select(*dict.fromkeys([*keys, "mmsi"]), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), F.when(F.coalesce(far, F.lit(False)), ok).otherwise(F.slice(ok, 1, 0)).alias("near"))
    rows = rows.select("*", F.col("near.m").alias("ships"), F.col("near.d").alias("dists")).drop("near")
    track = W.partitionBy(*keys).orderBy("us")
    rows = rows.withColumn("__i", F.row_number().over(track))
    begun = F.coalesce(F.max(F.when(F.size("ships") == 0, F.col("__i"))).over(track), F.lit(0))
    rows = rows.withColumn("__piece", F.floor(begun / BLOCK_ROWS)).drop("__i")

    ship_package(df.sparkSession)
    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us").reset_index(drop=True)
        partner, open_, done = [-1] * len(pdf), {}, []
        for r, (ships, dists) in enumerate(zip(pdf["ships"], pdf["dists"], strict=True)):
            now = dict(zip(ships, dists, strict=True))
            for m in [m for m in open_ if m not in now]:
                done.append((m, *open_.pop(m)))
            for m, d in now.items():
                first, total, n = open_.get(m, (r, 0.0, 0))
                open_[m] = (first, total + d, n + 1)
        done += [(m, *x) for m, x in open_.items()]
        for m, first, total, n in sorted(done, key=lambda x: (-(x[3] - x[2] * 1e-10), x[1], x[0])):
            if all(p == -1 for p in partner[first : first + n]):
                partner[first : first + n] = [int(m)] * n
        return pd.DataFrame({"mmsi": pdf["mmsi"], "us": pdf["us"], "partner": partner})

    out = rows.groupBy(*keys, "__piece").applyInPandas(find, "mmsi long, us long, partner long")
    return out.select("mmsi", F.timestamp_micros("us").cast("timestamp_ntz").alias("timestamp"), "partner")


def with_legality(features: DataFrame, legality: DataFrame, key: str | Sequence[str] = "mmsi", columns: Sequence[str] = ("required",)) -> DataFrame:
    """features with the legality columns of the same key, false where there are none. legality has one row for each key."""
    keys = [key] if isinstance(key, str) else list(key)
    out = features.join(legality.select(*keys, *columns), keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in columns})
