"""Row and column selections."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def in_box(df: DataFrame, lats=(25.7598, 25.7709), lons=(-80.1521, -80.1266)) -> DataFrame:
    """Reports in a box, edges included."""
    return df.where(F.col("latitude").between(*lats) & F.col("longitude").between(*lons))


def time_text(df: DataFrame, text: str) -> DataFrame:
    """Reports whose ISO time contains the text."""
    return df.where(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").contains(text))


def near_time(df: DataFrame, at: str, seconds: float) -> DataFrame:
    return df.where(F.abs(F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.lit(at).cast("timestamp_ntz").cast("timestamp"))) < seconds * 1e6)


def first_ships(df: DataFrame, n_ships: int = 20, *, min_sog: float | None = None, statuses: Sequence[str] | None = None, order: Sequence[str] = ("timestamp", "mmsi")) -> DataFrame:
    """The reports of the first n ships to qualify, from their qualifying report on.

    A ship qualifies with its first report that has the speed and status asked for; only one row a ship is ranked.
    """
    ok = F.lit(True)
    if min_sog is not None:
        ok = ok & (F.col("sog") >= min_sog)
    if statuses is not None:
        ok = ok & F.col("status").isin(list(statuses))
    place = F.struct(*order)
    admitted = df.where(ok).groupBy("mmsi").agg(F.min(place).alias("__from")).orderBy("__from").limit(n_ships)
    return df.join(F.broadcast(admitted), "mmsi").where(place >= F.col("__from")).drop("__from")


def fastest_ships(df: DataFrame, n_ships: int = 20) -> DataFrame:
    """The reports of the ships with the highest mean speed."""
    top = df.groupBy("mmsi").agg(F.avg("sog").alias("__m")).orderBy(F.desc("__m"), "mmsi").limit(n_ships)
    return df.join(F.broadcast(top.select("mmsi")), "mmsi", "left_semi")


def first_rows(df: DataFrame, rows: int = 10, ships: tuple[int, int] | None = None) -> DataFrame:
    """The first rows of each ship; ships: ranks of the ships to take, by number."""
    out = df.withColumn("__n", F.row_number().over(W.partitionBy("mmsi").orderBy("timestamp"))).where(F.col("__n") <= rows).drop("__n")
    if ships is None:
        return out
    ranked = df.select("mmsi").distinct().orderBy("mmsi").limit(ships[1]).withColumn("__r", F.row_number().over(W.orderBy("mmsi"))).where(F.col("__r") >= ships[0])
    return out.join(F.broadcast(ranked.select("mmsi")), "mmsi", "left_semi")


def matching_columns(df: DataFrame, *patterns: str) -> list[str]:
    """Names that all patterns match."""
    return [c for c in df.columns if all(re.search(p, c) for p in patterns)]


def without(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df without columns that must exist."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*columns)


def drop_share(df: DataFrame, share: float = 0.05, seed: int = 0) -> DataFrame:
    """df without a pseudo-random share of its rows; rows beside a gap are marked in `unexpected`.

    Which rows go depends on a hash of ship and time, so the result doesn't depend on partitions.
    """
    w = W.partitionBy("mmsi").orderBy("timestamp")
    gone = (F.pmod(F.xxhash64("mmsi", "timestamp", F.lit(seed)), F.lit(1_000_000)) / 1e6) < share
    marked = df.withColumn("__gone", gone)
    beside = F.coalesce(F.lag("__gone").over(w), F.lit(False)) | F.coalesce(F.lead("__gone").over(w), F.lit(False))
    return marked.withColumn("unexpected", beside).where(~F.col("__gone")).drop("__gone")


def sorted_lines(df: DataFrame, column: str) -> DataFrame:
    """Distinct rows in the order of a column (a sink's order: nothing else depends on it)."""
    return df.distinct().orderBy(column, *[c for c in df.columns if c != column])


def busiest_hour(df: DataFrame) -> DataFrame:
    """The hour of day with the highest positive mean speed, else -1."""
    best = df.groupBy(F.hour("timestamp").alias("hour")).agg(F.avg("sog").alias("m")).where("m > 0")
    return best.agg(F.coalesce(F.max_by("hour", F.struct(F.col("m"), -F.col("hour"))), F.lit(-1)).cast("int").alias("hour"))


def first_lines(df: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """The first n rows in an order, for a quick look; all rows if n is None."""
    return df if n is None else df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement: those with the least digests of seed and key, the same for any partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def falling(df: DataFrame, *columns: str) -> DataFrame:
    """Rows by several columns, largest first, nulls last."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in columns])


def renamed(df: DataFrame, names: dict[str, str] | None = None, *, prefix: str = "", suffix: str = "", blank: str = "_", keep: Sequence[str] = ()) -> DataFrame:
    """Columns by a map; all others but `keep` get the prefix and suffix, and white space in them becomes `blank`."""
    new = {c: (names or {}).get(c) or (c if c in keep else prefix + re.sub(r"\s+", blank, c.strip()) + suffix) for c in df.columns}
    if len(set(new.values())) < len(new):
        raise ValueError(f"equal names: {sorted(new.values())}")
    return df.withColumnsRenamed(new)


def restore_types(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns that `like` has get its types: whole numbers are rounded half to even, not cut."""
    kinds = {f.name: f.dataType for f in like.schema.fields}
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

    def cast(f):
        if f.name not in kinds or f.dataType == kinds[f.name]:
            return F.col(f.name)
        c = F.bround(f.name) if isinstance(kinds[f.name], whole) and isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        return c.cast(kinds[f.name]).alias(f.name)

    return df.select(*[cast(f) for f in df.schema.fields])
