"""Position reports: the canonical table, CSV ingest and the adapter from the events table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

RAW_SCHEMA = T.StructType(
    [
        T.StructField("MMSI", T.LongType()),
        T.StructField("BaseDateTime", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("LAT", "LON", "SOG", "COG", "Heading")],
        *[T.StructField(c, T.StringType()) for c in ("VesselName", "IMO", "CallSign")],
        T.StructField("VesselType", T.IntegerType()),
        T.StructField("Status", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("Length", "Width", "Draft")],
        T.StructField("Cargo", T.IntegerType()),
        T.StructField("TransceiverClass", T.StringType()),
    ]
)
#: Fixed names of the raw format and the canonical ones.
CANONICAL = {"BaseDateTime": "timestamp", "MMSI": "mmsi", "LAT": "latitude", "LON": "longitude"}
KEY = ("mmsi", "timestamp")
NEEDED = ("latitude", "longitude", "mmsi", "timestamp")


def canonical(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(CANONICAL)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns become null."""
    bad = {f.name: F.when(F.isnan(f.name) | (F.abs(F.col(f.name)) == float("inf")), None).otherwise(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(bad) if bad else df


def read_csv(spark: SparkSession, paths: str | Sequence[str], *, schema: T.StructType = RAW_SCHEMA, num_files: int | None = None) -> DataFrame:
    """Canonical rows of CSV files (plain or gz); malformed lines are dropped, whichever columns are asked for."""
    paths = [paths] if isinstance(paths, str) else list(paths)[:num_files]
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(text).option("header", True).option("mode", "DROPMALFORMED").csv(paths)
    # Values are cast here: the reader would only look at the columns that are asked for.
    whole, casts = F.lit(True), []
    for f in schema.fields:
        cast = F.col(f.name).try_cast(f.dataType)
        whole, casts = whole & (F.col(f.name).isNull() | cast.isNotNull()), [*casts, cast.alias(f.name)]
    df = canonical(raw.where(whole).select(*casts))
    return nan_to_null(df.withColumn("timestamp", F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz")))


def clean(df: DataFrame, *, tie: Sequence[str | Column] = ()) -> DataFrame:
    """Complete rows, one for each ship and instant: the first in the order of tie."""
    order = W.partitionBy(*KEY).orderBy(*(tie or [F.xxhash64(*[c for c in df.columns if c not in KEY])]))
    return df.dropna(how="any", subset=list(NEEDED)).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def null_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, nulls_before, nulls_after, rows_before, rows_after)."""

    def counted(df, name):
        one = df.agg(F.count("*").alias("rows"), *[F.sum(F.isnull(c).cast("bigint")).alias(c) for c in df.columns])
        return one.unpivot(["rows"], [F.col(c) for c in df.columns], "column", f"nulls_{name}").withColumnRenamed("rows", f"rows_{name}")

    return counted(before, "before").join(counted(after, "after"), "column")


def of_days(df: DataFrame, days: str | Sequence[str], columns: Sequence[str] | str | None = None) -> DataFrame:
    """Rows of some days; columns: names, or "numeric" or "non-numeric" by type. A date column prunes partitions."""
    days = [days] if isinstance(days, str) else list(days)
    day = F.col("date") if "date" in df.columns else F.to_date("timestamp")
    df = df.where(day.isin([F.lit(d).cast("date") for d in days]))
    if columns in ("numeric", "non-numeric"):
        wanted = [f.name for f in df.schema.fields if f.name in KEY or isinstance(f.dataType, T.NumericType) == (columns == "numeric")]
        return df.select(*wanted)
    return df.select(*columns) if columns else df


def write_daily(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet by date; a day's rows lie together and in order."""
    df.withColumn("date", F.to_date("timestamp")).repartition("date").sortWithinPartitions("date", *KEY).write.mode(mode).partitionBy("date").parquet(path)


def missed_dates(ingested: DataFrame, done: DataFrame) -> DataFrame:
    return ingested.select("date").distinct().join(done.select("date").distinct(), "date", "left_anti")


def from_events(events: DataFrame) -> DataFrame:
    """The events table as position reports: ships are users on fixed small orbits."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    turn = us / F.lit(86400e6) + F.col("user_id")
    user = F.col("user_id")
    return events.select(
        user.cast("bigint").alias("mmsi"),
        F.col("ts").alias("timestamp"),
        (20 + (user % 10) * 0.02 + 0.05 * F.sin(turn)).alias("latitude"),
        (-80 + (user % 7) * 0.02 + 0.05 * F.cos(turn)).alias("longitude"),
        F.col("value").alias("sog"),
        (F.get_json_object("props", "$.k").cast("double") * 3.6).alias("heading"),
        (user % 100).cast("int").alias("vessel_type"),
        F.col("event_type").alias("status"),
        (5 + user % 60).cast("double").alias("length"),
        ((5 + user % 60) / 4).alias("width"),
        F.col("event_id"),
    )


def positions(df: DataFrame) -> DataFrame:
    """Only who, when and where."""
    return df.select("mmsi", "timestamp", "latitude", "longitude")


def static_ships(df: DataFrame) -> DataFrame:
    """(mmsi, length, width, aspect_ratio): the largest size that a ship has reported; null without a length."""
    out = df.groupBy("mmsi").agg(F.max("length").alias("length"), F.max("width").alias("width"))
    return out.withColumn("aspect_ratio", F.try_divide("width", "length"))


def code_table(lines: DataFrame) -> DataFrame:
    """(code, label) of lines (code, label) as text; a code may be a range such as `1 to 19`. Other lines are left out."""
    at = lambda i: F.regexp_extract("code", r"^\s*(\d+)(?:\s+to\s+(\d+))?\s*$", i).try_cast("int")
    low, high = at(1), F.coalesce(at(2), at(1))
    return lines.where(low.isNotNull() & (low <= high)).select(F.explode(F.sequence(low, high)).alias("code"), F.trim("label").alias("label"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """code_table of a CSV file with a header and two columns."""
    return code_table(spark.read.schema("code string, label string").option("header", True).csv(path))
