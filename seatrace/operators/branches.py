"""Branches of broken tracks, period by period: what a period needs of the ones before is a table that each run hands on.

`append` reads the newest earlier period of a store and adds one of its own; it never reads older reports. A period is
one partition of a table and is replaced in one step, so a run that is lost or repeated changes nothing. Its rows are

    row      a report and the first time of its branch, as known at the period's end
    carry    the reports that later ones can still be linked to, and each ship's last one, with their branches
    merge    a branch of earlier periods and the earlier one that it has turned out to be
    broken   a ship with a step that is too fast or too long

`branches` puts the periods together: branches that merged later are one, and ships that broke later are broken in all
periods. So it equals one run over all reports (`stays.spoof_branches`), however they are cut into periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seatrace.storage import connected_components, written

from .stays import broken_tracks, linked
from .tracks import micros

_SCHEMA = "kind string, mmsi bigint, us bigint, latitude double, longitude double, branch bigint, into bigint, period date"


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append(reports: DataFrame, path: str, period: str, *, speed_m_sec: float = 35.0, gap_sec: float = 3600.0) -> None:
    """Adds the reports of one period, or replaces it. Periods are dates in ascending order, and reports of a period are
    later than those of all earlier ones; after a period is replaced with other reports, so must be those behind it.

    A period without reports only hands on what it was given.
    """
    spark = reports.sparkSession
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias("timestamp")
    day = F.lit(period).cast("date")
    own = reports.select("mmsi", micros("timestamp").alias("us"), "latitude", "longitude", F.lit(None).cast("bigint").alias("old"))
    both = own
    if _exists(spark, path):
        held = _read(spark, path).where(F.col("period") < day)
        last = held.agg(F.max("period")).first()[0]
        if last is not None:
            both = own.unionByName(held.where((F.col("period") == F.lit(last)) & (F.col("kind") == "carry")).select("mmsi", "us", "latitude", "longitude", F.col("branch").alias("old")))
    both = written(both, "branch-rows")
    rows = both.select("mmsi", "us", F.radians("latitude").alias("lat"), F.radians("longitude").alias("lon"), "old")
    found = written(linked(rows, speed_m_sec=speed_m_sec, gap_sec=gap_sec).join(both.select("mmsi", "us", "latitude", "longitude"), ["mmsi", "us"]), "branch-found")

    end = F.max("us").over(W.partitionBy("mmsi"))
    newest = found.agg(F.max("us")).first()[0] or 0
    kind = lambda k, df: df.select(F.lit(k).alias("kind"), "mmsi", *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("us", "bigint"), ("latitude", "double"), ("longitude", "double"), ("branch", "bigint"), ("into", "bigint"))])
    named = found.withColumn("branch", F.col("start"))
    # A later report may be as early as the newest one here, so what lies within the gap of that is handed on.
    reach = named.withColumn("__last", end).where((F.col("us") == F.col("__last")) | (F.col("us") >= newest - int(gap_sec * 1e6)))
    merged = found.where("old is not null and old <> start").select("mmsi", F.col("old").alias("branch"), F.col("start").alias("into")).distinct()
    broken = broken_tracks(both.select("mmsi", stamp("us"), "latitude", "longitude"), speed_m_sec=speed_m_sec, gap_sec=gap_sec).where("broken").select("mmsi")
    out = kind("row", named.where("old is null")).unionByName(kind("carry", reach)).unionByName(kind("merge", merged)).unionByName(kind("broken", broken))
    out.withColumn("period", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def branches(spark: SparkSession, path: str) -> DataFrame:
    """(mmsi, timestamp, branch_start) of all periods: for broken ships the first time of the report's branch, null for others."""
    held = _read(spark, path)
    node = lambda c: F.struct("mmsi", F.col(c).alias("us"))
    merged = held.where("kind = 'merge'").select(node("branch").alias("a"), node("into").alias("b"))
    joined = connected_components(merged, "branch-merges").select(F.col("node.mmsi").alias("mmsi"), F.col("node.us").alias("branch"), F.col("component.us").alias("first"))
    broken = held.where("kind = 'broken'").select("mmsi").distinct().withColumn("broken", F.lit(True))
    rows = held.where("kind = 'row'").select("mmsi", "us", "branch").join(joined, ["mmsi", "branch"], "left").join(broken, "mmsi", "left")
    start = F.when(F.col("broken"), F.timestamp_micros(F.coalesce("first", "branch")).cast("timestamp_ntz"))
    return rows.select("mmsi", F.timestamp_micros("us").cast("timestamp_ntz").alias("timestamp"), start.alias("branch_start"))
