"""Universal clock: every ship at the same instants, interpolated between its reports, never beyond them.

A report and the next one make an interval that carries both rows; instants are generated inside the intervals. So one
shuffle by ship does for the hourly grid, and a time bucket equi-join does for arbitrary instants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .tracks import by_time, micros


def intervals(df: DataFrame) -> DataFrame:
    """Each report with prev (its row), next (the ship's next row, or null), seq (its number), and both times in microseconds."""
    row = F.struct(*[F.col(c) for c in df.columns if c != "mmsi"])
    out = df.select("mmsi", row.alias("prev"), F.lead(row).over(by_time()).alias("next"), (F.row_number().over(by_time()) - 1).alias("seq"))
    return out.withColumns({"t0": micros("prev.timestamp"), "t1": micros("next.timestamp")})


def _at(held: DataFrame, columns: Sequence[str], source: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Values at instant t (microseconds) of interval rows."""
    share = F.when(F.col("t") == F.col("t0"), F.lit(0.0)).otherwise((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    nearest_is_next = F.bround(F.col("seq") + F.col("__share")) > F.col("seq")
    kinds = {f.name: f.dataType for f in source.schema.fields}
    held = held.withColumn("__share", share)
    values = []
    for c in columns:
        a, b = F.col(f"prev.{c}"), F.col(f"next.{c}")
        if isinstance(kinds[c], T.NumericType):
            values.append(F.when(F.col("__share") == 0, a.cast("double")).otherwise(a + (b - a) * F.col("__share")).alias(c))
        else:
            values.append(F.when(nearest_is_next, b).otherwise(a).alias(c))
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    exact = F.col("__share") == 0
    return held.select(
        "mmsi", stamp(F.col("t")).alias("timestamp"), *keep, *values,
        (F.col("seq") + F.col("__share")).alias("interp_index"),
        stamp(F.col("t0")).alias("timestamp_previous"),
        stamp(F.when(exact, F.col("t0")).otherwise(F.col("t1"))).alias("timestamp_next"),
        stamp(F.when(nearest_is_next, F.col("t1")).otherwise(F.col("t0"))).alias("timestamp_nearest"),
    )


def on_grid(df: DataFrame, columns: Sequence[str], *, step_sec: int = 3600, shift_micros: int = 0) -> DataFrame:
    """Every ship at every multiple of step_sec (plus shift_micros) from its first to its last report.

    Numbers are interpolated, other columns come from the nearer report (half goes to the even one).
    """
    step = step_sec * 1_000_000
    held = intervals(df.select("mmsi", "timestamp", *columns))
    first = F.ceil((F.col("t0") - shift_micros) / step) * step + shift_micros
    last = F.when(F.col("t1").isNull(), F.col("t0")).otherwise(F.col("t1") - 1)
    grid = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint")))
    return _at(held.withColumn("t", F.explode(grid)), columns, df)


def at_instants(df: DataFrame, instants: DataFrame, columns: Sequence[str], *, bucket_sec: int = 3600) -> DataFrame:
    """Every ship at every instant (column timestamp) that its reports enclose."""
    width = bucket_sec * 1_000_000
    held = intervals(df.select("mmsi", "timestamp", *columns)).withColumn("__end", F.coalesce(F.col("t1") - 1, F.col("t0")))
    low, high = F.floor(F.col("t0") / width), F.floor(F.col("__end") / width)
    dealt = held.withColumn("__bucket", F.explode(F.sequence(low, high)))
    asked = instants.select(micros("timestamp").alias("t")).distinct().withColumn("__bucket", F.floor(F.col("t") / width))
    return _at(dealt.join(asked, "__bucket").where("t >= t0 and t <= __end"), columns, df)


def forward_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with nulls of some columns filled by what the ship has last reported; null before it has reported anything."""
    before = by_time().rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns})


def same_day(clock: DataFrame) -> DataFrame:
    """Without rows that are interpolated across midnight."""
    return clock.where(F.to_date("timestamp_previous") == F.to_date("timestamp_next"))


def trajectory_features(df: DataFrame):
    """Hourly geometry over reports, and interpolated rows at each hour's beginning and a microsecond before its end.

    An hour without reports has two rows, both of one interval, so it is measured there. Only the rows of hours with
    reports are gathered, three for each report at most: what is shuffled and folded follows the reports, not the hours.
    """
    from .tracks import geometry, geometry_of_two

    step = 3_600_000_000
    held = intervals(df.select("mmsi", "timestamp", "latitude", "longitude")).withColumns({"b0": F.floor(F.col("t0") / step), "b1": F.floor(F.col("t1") / step)})
    held = held.select("mmsi", "t0", "t1", "b0", "b1", *[F.col(f"{w}.{c}").alias(f"{n}{k}") for k, w in enumerate(("prev", "next")) for c, n in (("latitude", "lat"), ("longitude", "lon"))])
    share = lambda t: F.when(t == F.col("t0"), F.lit(0.0)).otherwise((t - F.col("t0")) / (F.col("t1") - F.col("t0")))
    at = lambda c, t: F.when(share(t) == 0, F.col(f"{c}0").cast("double")).otherwise(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * share(t))
    stamp = lambda t: F.timestamp_micros(t).cast("timestamp_ntz")
    point = lambda b, t: F.struct(stamp(b * step).alias("bin"), stamp(t).alias("timestamp"), at("lat", t).alias("latitude"), at("lon", t).alias("longitude"))
    end, begin = (F.col("b0") + 1) * step - 1, F.col("b1") * step
    # Of reports at one instant one counts; edges of an hour that are reports aren't there twice.
    own = F.when(F.col("t1").isNull() | (F.col("t1") > F.col("t0")), point(F.col("b0"), F.col("t0")))
    across = F.col("b1") > F.col("b0")
    edges = F.array(own, F.when(across & (end > F.col("t0")), point(F.col("b0"), end)), F.when(across & (begin < F.col("t1")), point(F.col("b1"), begin)))
    busy = geometry(held.select("mmsi", F.explode(F.filter(edges, lambda p: p.isNotNull())).alias("p")).select("mmsi", "p.*"))
    empty = held.where("b1 > b0 + 1").withColumn("b", F.explode(F.sequence(F.col("b0") + 1, F.col("b1") - 1)))
    first, last = F.col("b") * step, (F.col("b") + 1) * step - 1
    two = empty.select("mmsi", stamp(first).alias("bin"), *[at(c, t).alias(f"{c}_{n}") for n, t in (("a", first), ("b", last)) for c in ("lat", "lon")])
    return busy.unionByName(geometry_of_two(two))


def day_range(df: DataFrame, first: str, last: str, columns: Sequence[str], *, buffer_days: int = 1, step_sec: int = 3600, whole_days: bool = False) -> DataFrame:
    """The clock of the days first to last. Reports of buffer_days more on both sides let it reach the days' ends.

    whole_days leaves out rows that are interpolated across midnight. A date column prunes the scan, if there is one.
    """
    day = F.col("date") if "date" in df.columns else F.to_date("timestamp")
    near = df.where(day.between(F.date_sub(F.lit(first).cast("date"), buffer_days), F.date_add(F.lit(last).cast("date"), buffer_days)))
    out = on_grid(near, columns, step_sec=step_sec).where(F.to_date("timestamp").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return same_day(out) if whole_days else out


def augment(paired: DataFrame, reports: DataFrame, columns: Sequence[str]) -> DataFrame:
    """paired (mmsi, timestamp, ...) with the ship's columns at that time; null beyond its reports or without a ship.

    Asked times and reports of a ship are put in one order, and each time takes the interval that began last: no
    interval is copied, however long it is.
    """
    held = intervals(reports.select("mmsi", "timestamp", *columns))
    begun = held.select("mmsi", F.col("t0").alias("t"), F.struct("prev", "next", "seq", "t0", "t1").alias("iv"), F.lit(0).alias("__asked"))
    kind = begun.schema["iv"].dataType
    asked = paired.where("mmsi is not null").select("mmsi", micros("timestamp").alias("t")).distinct()
    both = begun.unionByName(asked.select("*", F.lit(None).cast(kind).alias("iv"), F.lit(1).alias("__asked")))
    before = W.partitionBy("mmsi").orderBy("t", "__asked").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = both.withColumn("iv", F.last("iv", ignorenulls=True).over(before)).where("__asked = 1").select("mmsi", "t", "iv.*")
    got = _at(seen.where("t <= coalesce(t1, t0)"), columns, reports).drop("interp_index")
    new = [c for c in got.columns if c not in ("mmsi", "timestamp")]
    clash = [c for c in new if c in paired.columns]
    if clash:
        raise ValueError(f"columns in both: {clash}")
    return paired.join(got, ["mmsi", "timestamp"], "left")
