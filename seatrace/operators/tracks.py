"""Track operators along one ship's time: kinematics, edges, aggregates and quality masks.

All of them shuffle once, by ship (or ship and bin); partial aggregates run before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seatrace.functions.geo import bearing_deg, cosine_m, haversine_m, hull

KINEMATICS = ("delta_sec", "delta_m", "bearing_deg", "curvature_deg_m", "speed_m_sec", "accel_m_sec2", "ang_vel_deg_sec", "ang_accel_deg_sec2")


def by_time():
    return W.partitionBy("mmsi").orderBy("timestamp")



def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def kinematics(df: DataFrame) -> DataFrame:
    """df with the steps between a ship's neighbouring reports; null where a neighbour is missing.

    Distances and bearings lead from a report to the one before. Acceleration keeps its factor of 1000. Bearing
    differences aren't wrapped. The last report has no speed, turn or acceleration.
    """
    lat, lon, ts = F.col("latitude"), F.col("longitude"), F.col("timestamp")
    back = lambda c: F.lag(c).over(by_time())
    ahead = lambda c: F.lead(c).over(by_time())
    step = df.withColumns({"delta_sec": seconds_between(ts, back("timestamp")), "delta_m": haversine_m(lat, lon, back("latitude"), back("longitude")), "bearing_deg": bearing_deg(lat, lon, back("latitude"), back("longitude"))})
    step = step.withColumns({"__v": F.try_divide("delta_m", "delta_sec"), "__w": F.try_divide(F.col("bearing_deg") - back("bearing_deg"), F.col("delta_sec")), "__last": ahead("timestamp").isNull()})
    seen = lambda c: F.when(~F.col("__last"), c)
    out = step.withColumns(
        {
            "curvature_deg_m": seen((F.col("bearing_deg") - ahead("bearing_deg")) / ((F.col("delta_m") + ahead("delta_m")) / 2 + 1e-10)),
            "speed_m_sec": seen(F.col("__v")),
            "accel_m_sec2": seen(F.try_divide(F.col("__v") - ahead("__v"), ahead("delta_sec")) * 1e3),
            "ang_vel_deg_sec": seen(F.col("__w")),
            "ang_accel_deg_sec2": seen(F.try_divide(F.col("__w") - ahead("__w"), ahead("delta_sec"))),
        }
    )
    return out.drop("__v", "__w", "__last")


def binned(df: DataFrame, unit: str = "hour") -> DataFrame:
    return df.withColumn("bin", F.date_trunc(unit, "timestamp").cast("timestamp_ntz"))


def statistics(df: DataFrame, columns, keys=("mmsi", "bin")) -> DataFrame:
    """mean, std (of a sample), min and max of the columns by keys, and count."""
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(F.count("*").alias("count"), *aggs)


def kinematics_by_bin(df: DataFrame, unit: str = "hour") -> DataFrame:
    return statistics(binned(kinematics(df), unit), KINEMATICS)


def round_to_hour(ts: Column) -> Column:
    """The nearest hour; half hours go to the even one."""
    return F.timestamp_micros((F.bround(micros(ts) / F.lit(3600e6)) * 3600000000).cast("bigint")).cast("timestamp_ntz")


def time_aggregate(df: DataFrame, columns) -> DataFrame:
    """Statistics by ship and nearest hour."""
    return statistics(df.withColumn("bin", round_to_hour(F.col("timestamp"))), columns)


def edges(df: DataFrame) -> DataFrame:
    """The first and the last report of each ship and day."""
    w = W.partitionBy("mmsi", F.to_date("timestamp")).orderBy("timestamp")
    marked = df.withColumns({"is_first": F.lag("timestamp").over(w).isNull(), "is_last": F.lead("timestamp").over(w).isNull()})
    return marked.where("is_first or is_last")


def elapsed(df: DataFrame) -> DataFrame:
    """Seconds since the ship's first report."""
    return df.withColumn("elapsed_sec", seconds_between(F.col("timestamp"), F.first("timestamp").over(by_time())))


def successive(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """Whether flag holds in this report and the ship's next one."""
    return df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn(name, F.col("__f") & F.coalesce(F.lead("__f").over(by_time()), F.lit(False))).drop("__f")


def bad_or_next(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """Whether flag holds in this report or the ship's next one."""
    return df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn(name, F.col("__f") | F.coalesce(F.lead("__f").over(by_time()), F.lit(False))).drop("__f")


def share_of_ship(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """A flag's mean over the ship, in every row."""
    return df.withColumn(name, F.avg(F.coalesce(flag, F.lit(False)).cast("double")).over(W.partitionBy("mmsi")))


def islands(df: DataFrame, flag: Column) -> DataFrame:
    """Runs of consecutive reports of a ship where flag holds: (mmsi, island, begin, end, n)."""
    w = W.partitionBy("mmsi").orderBy("timestamp")
    rows = df.select("mmsi", "timestamp", F.row_number().over(w).alias("rn"), F.coalesce(flag, F.lit(False)).alias("f")).where("f")
    rows = rows.withColumn("g", F.col("rn") - F.row_number().over(w))
    return rows.groupBy("mmsi", "g").agg(F.min("timestamp").alias("begin"), F.max("timestamp").alias("end"), F.count("*").alias("n")).drop("g")


#: Groups of more points than this are measured by their hull.
HULL_FROM = 12


def geometry(df: DataFrame, keys=("mmsi", "bin")) -> DataFrame:
    """Shape of each group's track: end to end distance and turn, excursion from the mean, path length and span.

    The points of a group are folded as one ordered array (a ship's points of a bin). Null for single points. The span is
    measured between all points of small groups and between the corners of their hull in others.
    """
    pts = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("timestamp", "latitude", "longitude"))).alias("p"), F.count("*").alias("count"), F.avg("latitude").alias("mean_latitude"), F.avg("longitude").alias("mean_longitude"))
    n = F.size("p")
    at = lambda i: F.element_at("p", i)
    many = lambda c: F.when(n > 1, c)
    dist = lambda a, b: cosine_m(a["latitude"], a["longitude"], b["latitude"], b["longitude"])
    turn = lambda a, b: bearing_deg(a["latitude"], a["longitude"], b["latitude"], b["longitude"])
    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    first, last = at(F.lit(1)), at(n)
    second, before = at(F.when(n > 1, 2).otherwise(1)), at(F.when(n > 1, n - 1).otherwise(1))
    across = lambda c: F.array_max(F.transform(c, lambda x: F.array_max(F.transform(c, lambda y: dist(x, y)))))
    span = F.when(n <= HULL_FROM, across(F.col("p"))).otherwise(across(F.col("corners")))
    pts = pts.withColumn("corners", F.when(n > HULL_FROM, hull(F.col("p"), F.col("mean_latitude"), F.col("mean_longitude"))))
    rotation = turn(before, last) - turn(first, second)
    return pts.select(
        *keys,
        "count",
        "mean_latitude",
        "mean_longitude",
        many(dist(first, last)).alias("end2end_m"),
        many(F.pmod(rotation, F.lit(360.0))).alias("end2end_deg"),
        many(F.array_max(F.transform("p", lambda x: cosine_m(x["latitude"], x["longitude"], F.col("mean_latitude"), F.col("mean_longitude"))))).alias("excursion_m"),
        many(F.aggregate(F.transform(steps, lambda i: dist(at(i - 1), at(i))), F.lit(0.0), lambda s, x: s + x)).alias("path_m"),
        many(span).alias("span_m"),
    )


def geometry_of_two(df: DataFrame, keys=("mmsi", "bin")) -> DataFrame:
    """geometry() of groups of two points, from rows with both: lat_a, lon_a, lat_b, lon_b."""
    dist = lambda x, y: cosine_m(*[F.col(f"{c}_{n}") for n in (x, y) for c in ("lat", "lon")])
    # A row of one element each, or Spark would write the places out in each place where they are used.
    held = df.withColumn("__m", F.explode(F.array(F.struct(*[((F.coalesce(f"{c}_a", F.lit(0.0)) + F.coalesce(f"{c}_b", F.lit(0.0))) / F.nullif(F.col(f"{c}_a").isNotNull().cast("int") + F.col(f"{c}_b").isNotNull().cast("int"), F.lit(0))).alias(f"{c}_m") for c in ("lat", "lon")], dist("a", "b").alias("d")))))
    held = held.select(*df.columns, "__m.*")
    turn = bearing_deg(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return held.select(
        *keys,
        F.lit(2).cast("bigint").alias("count"),
        F.col("lat_m").alias("mean_latitude"),
        F.col("lon_m").alias("mean_longitude"),
        F.col("d").alias("end2end_m"),
        F.pmod(turn - turn, F.lit(360.0)).alias("end2end_deg"),
        F.greatest(dist("a", "m"), dist("b", "m")).alias("excursion_m"),
        F.col("d").alias("path_m"),
        F.greatest("d", dist("a", "a"), dist("b", "b")).alias("span_m"),
    )
