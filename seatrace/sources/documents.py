"""JSON, XML, KML and report sources of context data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WEATHER_SCHEMA = "date string, maxtempC string, mintempC string, uvIndex string, hourly array<struct<time:string,tempC:string>>, astronomy array<struct<moon:string>>, tides array<struct<tide_data:array<struct<tideDateTime:string,tide_type:string>>>>"


def sample_weather(reports: DataFrame) -> DataFrame:
    """(place, body): captured weather answers as JSON text, one for each ship and day."""
    days = reports.select("mmsi", F.to_date("timestamp").cast("string").alias("date")).distinct()
    hours = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda h: F.struct((h * 300).cast("string").alias("time"), (h * 2 + F.col("mmsi") % 3).cast("string").alias("tempC")))
    tide = F.array(F.struct(F.array(F.struct(F.concat("date", F.lit(" 07:00")).alias("tideDateTime"), F.lit("HIGH").alias("tide_type"))).alias("tide_data")))
    day = F.struct(F.col("date"), hours.alias("hourly"), F.array(F.struct(F.concat(F.lit("T"), "date").alias("moon"))).alias("astronomy"), tide.alias("tides"))
    return days.select((F.col("mmsi") % 10).alias("place"), F.to_json(F.struct(F.struct(F.array(day).alias("weather")).alias("data"))).alias("body"))


def weather_rows(captured: DataFrame, *, step_hours: int = 3) -> DataFrame:
    """(place, date, time, temp, moon, tide) by day and hour; a tide belongs to the step its time falls into."""
    parsed = captured.select("place", F.from_json("body", f"data struct<weather:array<struct<{_fields(WEATHER_SCHEMA)}>>>").alias("b"))
    days = parsed.select("place", F.explode("b.data.weather").alias("d"))
    hours = days.select("place", "d", F.explode("d.hourly").alias("h"))
    time = F.col("h.time").cast("int")
    tides = F.flatten(F.transform("d.tides", lambda t: t["tide_data"]))
    at = lambda t: F.regexp_extract(t["tideDateTime"], r"(\d{2}):\d{2}", 1).cast("int") * 100 + F.regexp_extract(t["tideDateTime"], r"\d{2}:(\d{2})", 1).cast("int")
    within = F.filter(tides, lambda t: (at(t) >= time) & (at(t) < time + step_hours * 100))
    return hours.select("place", F.col("d.date").alias("date"), time.alias("time"), F.col("h.tempC").cast("int").alias("temp"), F.try_element_at("d.astronomy", F.lit(1))["moon"].alias("moon"), F.try_element_at(within, F.lit(1))["tide_type"].alias("tide"))


def _fields(ddl: str) -> str:
    """Top-level columns of a DDL text as struct fields."""
    out, depth = [], 0
    for part in ddl.split(", "):
        if depth == 0:
            name, kind = part.split(" ", 1)
            out.append(f"{name}:{kind}")
        else:
            out[-1] += "," + part
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def pollution_rows(captured: DataFrame) -> DataFrame:
    """(place, at, aqi, components...) of captured pollution answers (place, body)."""
    gases = ("co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3")
    kind = "array<struct<dt:bigint,main:struct<aqi:int>,components:struct<" + ",".join(f"{g}:double" for g in gases) + ">>>"
    rows = captured.select("place", F.explode(F.from_json("body", f"list {kind}")["list"]).alias("r"))
    return rows.select("place", F.timestamp_seconds("r.dt").cast("timestamp_ntz").alias("at"), F.col("r.main.aqi").alias("aqi"), *[F.col(f"r.components.{g}").alias(g) for g in gases])


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature: type, coordinates (as JSON) and properties (as JSON)."""
    raw = spark.read.schema("features array<struct<geometry:struct<type:string,coordinates:string>,properties:string>>").option("multiLine", True).json(path)
    f = raw.select(F.posexplode("features").alias("ord", "f"))
    return f.select("ord", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def polygon_rings(features: DataFrame, name: str) -> DataFrame:
    """(ord, name, ring) of polygon features, outer rings; a multi-polygon gives several rows."""
    pairs = lambda c: F.transform(c, lambda p: F.struct(F.element_at(p, 1).alias("lon"), F.element_at(p, 2).alias("lat")))
    label = F.get_json_object("properties", f"$.{name}").alias("name")
    one = features.where("type = 'Polygon'").select("ord", label, F.from_json("coordinates", "array<array<array<double>>>").alias("c")).select("ord", "name", pairs(F.element_at("c", 1)).alias("ring"))
    many = features.where("type = 'MultiPolygon'").select("ord", label, F.explode(F.from_json("coordinates", "array<array<array<array<double>>>>")).alias("c")).select("ord", "name", pairs(F.element_at("c", 1)).alias("ring"))
    return one.unionAll(many)


VOC_SCHEMA = "filename string, date string, time_estimate string, size struct<width:int,height:int,depth:int>, meters_per_pixel double, lat_lon_bounds struct<lat1:double,lon1:double,lat2:double,lon2:double>, object array<struct<class:int,bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>>>"


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """Detections of annotation files: one row for each object, with its place from the image's bounds."""
    raw = spark.read.format("xml").option("rowTag", "annotation").schema(VOC_SCHEMA).load(path)
    o = raw.select("*", F.explode("object").alias("o"))
    x, y = F.floor((F.col("o.bndbox.xmin") + F.col("o.bndbox.xmax")) / 2).cast("int"), F.floor((F.col("o.bndbox.ymin") + F.col("o.bndbox.ymax")) / 2).cast("int")
    b = F.col("lat_lon_bounds")
    south, north = F.least(b["lat1"], b["lat2"]), F.greatest(b["lat1"], b["lat2"])
    west, east = F.least(b["lon1"], b["lon2"]), F.greatest(b["lon1"], b["lon2"])
    return o.select(
        F.try_to_timestamp(F.concat_ws(" ", "date", "time_estimate")).cast("timestamp_ntz").alias("datetime"),
        (north - (north - south) * y / F.col("size.height")).alias("latitude"), (west + (east - west) * x / F.col("size.width")).alias("longitude"),
        "filename", F.col("size.width").alias("image_w"), F.col("size.height").alias("image_h"), "meters_per_pixel", F.col("o.class").alias("vessel_type"),
        F.col("o.bndbox.xmin").alias("x1"), F.col("o.bndbox.ymin").alias("y1"), F.col("o.bndbox.xmax").alias("x2"), F.col("o.bndbox.ymax").alias("y2"), F.struct(x.alias("x"), y.alias("y")).alias("ship_pixel_loc"),
    )


def write_voc(images: DataFrame, path: str) -> None:
    """Images (columns of VOC_SCHEMA) as annotation XML."""
    images.write.format("xml").option("rootTag", "annotations").option("rowTag", "annotation").save(path)


def kml_placemarks(text: Column) -> Column:
    """array<struct<name,lon,lat>> of the placemarks in KML text."""
    marks = F.regexp_extract_all(text, F.lit(r"(?s)<Placemark\b.*?</Placemark>"), 0)
    point = lambda m: F.split(F.trim(F.regexp_extract(m, r"(?s)<coordinates>\s*([^<\s]+)", 1)), ",")
    return F.transform(marks, lambda m: F.struct(F.regexp_extract(m, r"(?s)<name>(.*?)</name>", 1).alias("name"), F.try_element_at(point(m), F.lit(1)).try_cast("double").alias("lon"), F.try_element_at(point(m), F.lit(2)).try_cast("double").alias("lat")))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, lon, lat) of placemarks in KML files."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.explode(kml_placemarks(F.decode("content", "UTF-8"))).alias("m")).select("path", "m.*")


def find_files(spark: SparkSession, path: str, *, starts: str = "", ends: str = "", contains: str = "") -> DataFrame:
    """(path, name, length, duplicates) of files below a folder by their names; duplicates: files of that name."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    named = raw.withColumn("name", F.element_at(F.split("path", "/"), -1))
    kept = named.where(F.col("name").startswith(starts) & F.col("name").endswith(ends) & F.col("name").contains(contains))
    return kept.withColumn("duplicates", F.count("*").over(W.partitionBy("name")))


def stk_report(lines: DataFrame, *, block: int = 1_000_000) -> DataFrame:
    """(ship, at, latitude, longitude) of a simulator's report: lines (n, line), a header line before each ship's rows.

    Headers are counted by blocks of line numbers; only the blocks' counts are summed up in one place, lines in theirs.
    """
    head = F.coalesce(F.col("line").contains("Time (UTCG)"), F.lit(False)).cast("int")
    marked = lines.withColumns({"__h": head, "__b": F.floor(F.col("n") / block)})
    sums = marked.groupBy("__b").agg(F.sum("__h").alias("__s"))
    before = sums.select("__b", (F.sum("__s").over(W.orderBy("__b")) - F.col("__s")).alias("__before"))
    counted = marked.withColumn("__own", F.sum("__h").over(W.partitionBy("__b").orderBy("n"))).join(before, "__b").withColumn("ship", F.col("__before") + F.col("__own"))
    f = F.split(F.trim("line"), r"\s{2,}")
    rows = counted.where((F.col("ship") > 0) & F.col("line").rlike(r"^\s*\d+ \w{3} \d{4}"))
    return rows.select("ship", F.try_to_timestamp(F.element_at(f, 1), F.lit("d MMM yyyy HH:mm:ss.SSS")).cast("timestamp_ntz").alias("at"), F.try_element_at(f, F.lit(2)).cast("double").alias("latitude"), F.try_element_at(f, F.lit(3)).cast("double").alias("longitude"))


def combine_days(days: dict[str, DataFrame]) -> DataFrame:
    """Reports of several days in one table, with their day."""
    parts = [df.withColumn("day", F.lit(d).cast("date")) for d, df in sorted(days.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def waypoints(reports: DataFrame) -> DataFrame:
    """(mmsi, text): a simulator's waypoint file for each ship, times as a share of its whole span, speeds in m/s."""
    w = W.partitionBy("mmsi")
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    first, last = F.min(us).over(w), F.max(us).over(w)
    share = F.coalesce(F.try_divide(us - first, last - first), F.lit(0.0))
    speed = F.greatest(F.col("sog") * 0.514444, F.lit(1e-6))
    line = F.format_string("%.6f %.6f %.6f %.6f", share, F.col("latitude"), F.col("longitude"), speed)
    return reports.select("mmsi", us.alias("us"), line.alias("line")).groupBy("mmsi").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "line"))), lambda x: x["line"]), "\n").alias("text"))


def simulated_log(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Made up non-AIS log rows, the same for the same seed and number."""
    pick = lambda name, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(len(values))) + 1).cast("int")).alias(name)
    unit = lambda name: F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(1_000_000)) / 1e6
    return spark.range(n).select("id", pick("Affiliation", ["civil", "state", "unknown"]), pick("Behavior", ["transit", "loiter", "fish"]), (unit("lat") * 180 - 90).alias("Latitude"), (unit("lon") * 360 - 180).alias("Longitude"), (unit("ais") < 0.8).alias("AIS Compliant"))


def jittered(rows: DataFrame, keys, *, degrees: float = 0.01, seed: int = 0) -> DataFrame:
    """Waypoints moved by up to `degrees` each way, the same for the same seed and keys."""
    move = lambda n: (F.pmod(F.xxhash64(*keys, F.lit(n), F.lit(seed)), F.lit(2_000_001)) / 1e6 - 1) * degrees
    return rows.withColumns({"latitude": F.col("latitude") + move(0), "longitude": F.col("longitude") + move(1)})


def with_property(text: Column, name: str, value: str) -> Column:
    """Scenario text in which the line `name value` has another value; other lines stay."""
    import re

    return F.regexp_replace(text, rf"(?m)^([ \t]*{re.escape(name)}[ \t]+)[^\r\n]*", "$1" + re.sub(r"([\\$])", r"\\\1", value))


def request_days(places: DataFrame, first: str, last: str) -> DataFrame:
    """places with one row for each day from first to last: what a service is to be asked for."""
    return places.withColumn("date", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))


def write_answers(answers: DataFrame, path: str) -> None:
    """Captured answers (kind, place, date, body) as JSON lines, each kind in a folder of its own."""
    answers.write.mode("append").partitionBy("kind").json(path)


def memoised(spark: SparkSession, path: str, make) -> DataFrame:
    """What make() gives, from path if it lies there whole, else written there first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    done = hadoop.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, by: str) -> None:
    """A table as CSV, a folder for each value of `by`."""
    df.write.partitionBy(by).option("header", True).csv(path)


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, lon, lat) of the placemarks in zipped KML files; one archive a task at a time."""
    import pandas as pd

    def run(batches):
        import io
        import zipfile

        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    texts = [z.read(m).decode("utf-8", "replace") for m in z.namelist() if m.lower().endswith(".kml")]
                yield pd.DataFrame({"path": [p] * len(texts), "kml": texts})

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, kml string")
    return raw.select("path", F.explode(kml_placemarks(F.col("kml"))).alias("m")).select("path", "m.*")


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, value) of two-dimensional arrays in .npy files, row by row; NaN is left out."""
    import pandas as pd

    def run(batches):
        import io

        import numpy as np

        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                for r, line in enumerate(np.load(io.BytesIO(c), allow_pickle=False)):
                    cols = np.flatnonzero(~np.isnan(line.astype(float)))
                    yield pd.DataFrame({"path": p, "row": np.full(len(cols), r), "col": cols, "value": line[cols].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, col int, value double")


def write_vectors(df: DataFrame, path: str, *, per_column: bool = False) -> None:
    """Training vectors as parquet: (mmsi, features, labels), or a column for each feature and label."""
    if per_column:
        size = df.select(F.max(F.size("features")).alias("f"), F.max(F.size("labels")).alias("l")).first()
        df = df.select("mmsi", *[F.try_element_at(c, F.lit(i + 1)).alias(f"{n}_{i}") for c, n, k in (("features", "f", size["f"]), ("labels", "l", size["l"])) for i in range(k or 0)])
    df.write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(mmsi, features, labels), however they were written."""
    raw = spark.read.parquet(path)
    if "features" in raw.columns:
        return raw
    of = lambda n: F.array(*sorted((c for c in raw.columns if c.startswith(n + "_")), key=lambda c: int(c[2:])))
    return raw.select("mmsi", of("f").alias("features"), of("l").alias("labels"))
