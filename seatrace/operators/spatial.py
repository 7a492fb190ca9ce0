"""Spatial joins: neighbours at one instant, nearest places, polygons, lines and rasters.

Every join is an equi-join on cells of about the search radius, then an exact distance: no cross join, and a dense cell
is an ordinary join key that adaptive execution can split.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from seatrace.functions.geo import EARTH_RADIUS_M, haversine_m, ring_edges, segment_distance_deg
from seatrace.groups import floats, map_groups
from seatrace.shipping import ship_package

from .meetings import metres


def _grid(radius_m: float) -> float:
    """Height of a row of cells in degrees: a little more than the radius."""
    return math.degrees(radius_m / EARTH_RADIUS_M) * 1.0001


def _columns(row: Column, size: float) -> Column:
    """Number of cells around the globe in a row: none is narrower than the radius is there or in the rows beside it.

    Looked up by the degree of latitude that the row lies in, for the degree's far end: rows of a degree are alike, and
    no row costs more than an element of a constant array.
    """

    def of_band(degree: int) -> int:
        most = degree + 1 + 1.5 * size
        ratio = math.sin(math.radians(min(90.0, size / 2))) / math.cos(math.radians(most)) if most < 89.9 else 1.0
        return 1 if ratio >= 1 else max(1, math.floor(360 / math.degrees(2 * math.asin(ratio))))

    band = F.least(F.floor(F.abs(row + 0.5) * size), F.lit(90)).cast("int")
    return F.get(F.lit([of_band(k) for k in range(91)]), band).cast("bigint")


def _cells(lat: Column, lon: Column, size: float) -> dict[str, Column]:
    row = F.floor(lat / size)
    n = _columns(row, size)
    return {"__row": row, "__col": F.pmod(F.floor((lon + 180) / (360 / n)), n)}


def _near_cells(df: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    """df with each cell in which something within the radius can lie; the number of columns is that of the cell's row."""
    row = F.floor(F.col(lat) / size)
    rows = df.withColumn("__row", F.explode(F.sequence(row - 1, row + 1))).withColumn("__n", _columns(F.col("__row"), size))
    col = F.floor((F.col(lon) + 180) / (360 / F.col("__n")))
    near = F.transform(F.sequence(col - 1, col + 1), lambda c: F.pmod(c, F.col("__n")))
    return rows.withColumn("__col", F.explode(F.array_distinct(near))).drop("__n")


#: Radii that a block of the plane is high and wide, and distances that are measured at a time.
_BLOCK, _AT_ONCE = 6, 1 << 18


def _blocks(df: DataFrame, radius_m: float) -> DataFrame:
    """df (latitude, longitude) with each block (__row, __col) in which something within the radius can lie; __own: the one that holds the point."""
    size = _grid(radius_m * _BLOCK)
    lat, lon = F.col("latitude"), F.col("longitude") + 180
    rows = df.withColumn("__row", F.explode(F.sequence(F.floor(lat / size - 1 / _BLOCK), F.floor(lat / size + 1 / _BLOCK)))).withColumn("__n", _columns(F.col("__row"), size))
    at = lon / (360 / F.col("__n"))
    cols = F.transform(F.sequence(F.floor(at - 1 / _BLOCK), F.floor(at + 1 / _BLOCK)), lambda c: F.pmod(c, F.col("__n")))
    own = (F.col("__row") == F.floor(lat / size)) & (F.col("__col") == F.pmod(F.floor(at), F.col("__n")))
    return rows.withColumn("__col", F.explode(F.array_distinct(cols))).withColumn("__own", own).drop("__n")


#: Pairs in a batch.
_PAIRS = 200_000


def neighbor_pairs(df: DataFrame, radius_m: float) -> DataFrame:
    """(timestamp, mmsi, other, dist_m): ships within radius_m of one another at the same instant, both directions.

    Ships of an instant meet in the blocks of `neighbors`; each block lists the pairs of its own points, so what is shuffled
    are points, about two rows of each, and never pairs.
    """
    pts = df.select("timestamp", "mmsi", "latitude", "longitude")
    held = _blocks(pts.where("mmsi is not null and timestamp is not null and latitude is not null and longitude is not null"), radius_m)
    reach = _grid(radius_m)
    edge = math.cos(min(math.pi, radius_m / EARTH_RADIUS_M * (1 + 1e-6))) - 1e-14

    def kernel(rows, bounds):
        mmsi, own = rows["mmsi"].to_numpy(), rows["__own"].to_numpy()
        lat, lon = floats(rows, "latitude", "longitude")
        a, o = np.radians(lat), np.radians(lon)
        x, y, z = np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)
        made, n = ([], [], []), 0

        def out():
            i, j, m = (np.concatenate(c) for c in made)
            return {"timestamp": rows["timestamp"].take(pa.array(i)), "mmsi": mmsi[i], "other": mmsi[j], "dist_m": m}

        for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = b + np.flatnonzero(own[b:e])
            low, high = b + np.searchsorted(lat[b:e], lat[at] - reach), b + np.searchsorted(lat[b:e], lat[at] + reach, "right")
            begin = 0
            while begin < len(at):
                end = min(len(at), begin + max(1, _AT_ONCE // max(1, int(high[begin] - low[begin]))))
                mine, first, last = at[begin:end], int(low[begin]), int(high[end - 1])
                dot = x[mine, None] * x[first:last]
                dot += y[mine, None] * y[first:last]
                dot += z[mine, None] * z[first:last]
                i, j = np.nonzero(dot >= edge)
                i, j = mine[i], j + first
                other = mmsi[i] != mmsi[j]
                i, j = i[other], j[other]
                m = metres(lat[i], lon[i], lat[j], lon[j])
                near = m <= radius_m
                for held, v in zip(made, (i[near], j[near], m[near]), strict=True):
                    held.append(v)
                n += int(near.sum())
                if n >= _PAIRS:
                    yield out()
                    made, n = ([], [], []), 0
                begin = end
        if n:
            yield out()

    kinds = {f.name: f.dataType.simpleString() for f in pts.schema.fields}
    schema = f"timestamp {kinds['timestamp']}, mmsi {kinds['mmsi']}, other {kinds['mmsi']}, dist_m double"
    return map_groups(held, ["timestamp", "__row", "__col"], ["latitude"], kernel, schema)


def _nearest_in_block(mmsi, lat, lon, own, n_nearest: int, radius_m: float):
    """Of a block's own points: how many others are within the radius, and distances and names of the nearest (inf and -1
    beyond). Points are in order of latitude."""
    a, o = np.radians(lat), np.radians(lon)
    x, y, z = np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)
    at = np.flatnonzero(own)
    reach = _grid(radius_m)
    low, high = np.searchsorted(lat, lat[at] - reach), np.searchsorted(lat, lat[at] + reach, "right")
    count, dist, name = np.zeros(len(at), np.int64), np.full((len(at), n_nearest), np.inf), np.full((len(at), n_nearest), -1, np.int64)
    edge = math.sin(min(math.pi / 2, radius_m / EARTH_RADIUS_M / 2)) ** 2
    sure, most = edge * (1 - 1e-6) - 1e-15, edge * (1 + 1e-6) + 1e-15

    def metres(i, j):
        h = np.sin((a[j] - a[i]) / 2) ** 2 + np.cos(a[i]) * np.cos(a[j]) * np.sin(np.radians(lon[j] - lon[i]) / 2) ** 2
        return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(h)))

    begin = 0
    while begin < len(at):
        end = min(len(at), begin + max(1, _AT_ONCE // max(1, int(high[begin] - low[begin]))))
        mine, first, last = at[begin:end], int(low[begin]), int(high[end - 1])
        # A quarter of the squared chord tells near from far; the distance is computed at the edge and of the nearest.
        h = (x[mine, None] - x[first:last]) ** 2
        h += (y[mine, None] - y[first:last]) ** 2
        h += (z[mine, None] - z[first:last]) ** 2
        h *= 0.25
        near = (h <= most) & (mmsi[mine, None] != mmsi[first:last])
        i, j = np.nonzero(near & (h >= sure))
        near[i, j] = metres(mine[i], first + j) <= radius_m
        count[begin:end] = near.sum(1)
        if n_nearest and near.any():
            h[~near] = np.inf
            k = min(n_nearest, h.shape[1]) - 1
            bound = np.partition(h, k, axis=1)[:, k] * (1 + 1e-6) + 1e-15
            i, j = np.nonzero(near & (h <= bound[:, None]))
            d, other = metres(mine[i], first + j), mmsi[first + j]
            by = np.lexsort((other, d, i))
            i, d, other = i[by], d[by], other[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            few = rank < n_nearest
            dist[begin + i[few], rank[few]], name[begin + i[few], rank[few]] = d[few], other[few]
        begin = end
    return at, count, dist, name


def neighbors(df: DataFrame, *, n_nearest: int = 5, radius_m: float = 5.0) -> DataFrame:
    """df's (timestamp, mmsi) with `i_dist_m` and `i_mmsi` of the nearest ships (null and -1 beyond) and n_within.

    Ships of an instant meet in blocks of some radii, each with a rim of one radius; pairs are measured in arrays and only
    counts and the nearest leave a block, so what is shuffled grows with the rows, however many ships are in reach.
    """
    pts = df.select("timestamp", "mmsi", "latitude", "longitude")
    held = _blocks(pts.where("mmsi is not null and latitude is not null and longitude is not null"), radius_m)

    def kernel(rows, bounds):
        mmsi, own = rows["mmsi"].to_numpy(), rows["__own"].to_numpy()
        lat, lon = floats(rows, "latitude", "longitude")
        out = []
        for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at, *rest = _nearest_in_block(mmsi[b:e], lat[b:e], lon[b:e], own[b:e], n_nearest, radius_m)
            out.append((at + b, *rest))
        at, count, dist, name = (np.concatenate(c) for c in zip(*out, strict=True))
        cols = {"timestamp": rows["timestamp"].take(at), "mmsi": mmsi[at], "n_within": count}
        for i in range(n_nearest):
            cols[f"{i}_dist_m"], cols[f"{i}_mmsi"] = pa.array(dist[:, i], mask=np.isinf(dist[:, i])), name[:, i]
        return cols

    kinds = {f.name: f.dataType.simpleString() for f in pts.schema.fields}
    fields = ", ".join(["timestamp " + kinds["timestamp"], "mmsi " + kinds["mmsi"], "n_within int", *[f"`{i}_dist_m` double, `{i}_mmsi` {kinds['mmsi']}" for i in range(n_nearest)]])
    found = map_groups(held, ["timestamp", "__row", "__col"], ["latitude"], kernel, fields)
    alone = pts.where("mmsi is null or latitude is null or longitude is null")
    none = [F.lit(None).cast("double").alias(f"{i}_dist_m") if c == "d" else F.lit(-1).cast(kinds["mmsi"]).alias(f"{i}_mmsi") for i in range(n_nearest) for c in "dm"]
    return found.unionAll(alone.select("timestamp", "mmsi", F.lit(0).alias("n_within"), *none))


def _unit_vector(lat: str, lon: str, name: str = "__u") -> dict[str, Column]:
    a, o = F.radians(lat), F.radians(lon)
    return {f"{name}x": F.cos(a) * F.cos(o), f"{name}y": F.cos(a) * F.sin(o), f"{name}z": F.sin(a)}


#: Spots of a cell that one row of the join with points carries, and how many spots at most are sent to all executors.
_SPOTS, _SENT = 256, 20_000


def _spots(places: DataFrame, take: int) -> DataFrame:
    """(lat2, lon2, n, firsts): a row for each spot with how many places are there, and the first of them by name."""
    at = places.select("place", F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2")).where("lat2 is not null and lon2 is not null")
    rank = F.row_number().over(W.partitionBy("lat2", "lon2").orderBy("place"))
    firsts = at.withColumn("k", rank).where(F.col("k") <= take).groupBy("lat2", "lon2").agg(F.collect_list(F.struct("place")).alias("firsts"))
    return at.groupBy("lat2", "lon2").agg(F.count("*").alias("n")).join(firsts, ["lat2", "lon2"])


def _nearest_sent(points: DataFrame, spots: list, kind: str, *, keys: Sequence[str], n_nearest: int, radius_m: float) -> DataFrame:
    """nearest_places where all tasks hold the spots (rows of _spots): points are measured as they come, nothing is shuffled."""
    spots = sorted(spots, key=lambda s: s["lat2"])
    names = sorted({p["place"] for s in spots for p in s["firsts"]})
    rank_of = {p: i for i, p in enumerate(names)}
    held = points.sparkSession.sparkContext.broadcast((
        np.array([s["lat2"] for s in spots], float), np.array([s["lon2"] for s in spots], float), np.array([s["n"] for s in spots], np.int64),
        [np.array([rank_of[p["place"]] for p in s["firsts"]], np.int64) for s in spots],
    ))

    def kernel(lat, lon):
        lat2, lon2, n, firsts = held.value
        a, o, a2, o2 = np.radians(lat), np.radians(lon), np.radians(lat2), np.radians(lon2)
        p = np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])
        q = np.stack([np.cos(a2) * np.cos(o2), np.cos(a2) * np.sin(o2), np.sin(a2)])
        count, dist, name = np.zeros(len(lat), np.int64), np.full((len(lat), n_nearest), np.inf), np.full((len(lat), n_nearest), -1, np.int64)
        size, flat = np.array([len(f) for f in firsts], np.int64), np.concatenate([*firsts, np.zeros(0, np.int64)])
        begins = np.cumsum(size) - size
        edge = math.sin(min(math.pi / 2, radius_m / EARTH_RADIUS_M / 2)) ** 2
        sure, most = edge * (1 - 1e-6) - 1e-15, edge * (1 + 1e-6) + 1e-15

        def metres(i, j):
            h = np.sin((a2[j] - a[i]) / 2) ** 2 + np.cos(a[i]) * np.cos(a2[j]) * np.sin(np.radians(lon2[j] - lon[i]) / 2) ** 2
            return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(h)))

        by_lat = np.argsort(lat, kind="stable")
        by_lat = by_lat[: int(np.isfinite(lat[by_lat]).sum())]
        by_lat = by_lat[np.isfinite(lon[by_lat])]
        low, high = np.searchsorted(lat2, lat[by_lat] - _grid(radius_m)), np.searchsorted(lat2, lat[by_lat] + _grid(radius_m), "right")
        begin = 0
        while begin < len(by_lat):
            end = min(len(by_lat), begin + max(1, _AT_ONCE // max(1, int(high[begin] - low[begin]))))
            mine, first, last = by_lat[begin:end], int(low[begin]), int(high[end - 1])
            begin = end
            if first >= last:
                continue
            h = sum((x[mine, None] - y[first:last]) ** 2 for x, y in zip(p, q, strict=True)) * 0.25
            near = h <= most
            i, j = np.nonzero(near & (h >= sure))
            near[i, j] = metres(mine[i], first + j) <= radius_m
            count[mine] = near @ n[first:last]
            h[~near] = np.inf
            k = min(max(1, n_nearest), h.shape[1]) - 1
            # Spots up to the n-th nearest, and a little, hold the n nearest places.
            i, j = np.nonzero(near & (h <= np.partition(h, k, axis=1)[:, k, None] * (1 + 1e-6) + 1e-15))
            d, j = metres(mine[i], first + j), first + j
            times = size[j]
            of = np.repeat(begins[j] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            i, d, place = np.repeat(i, times), np.repeat(d, times), flat[of]
            by = np.lexsort((place, d, i))
            i, d, place = i[by], d[by], place[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            few = rank < n_nearest
            dist[mine[i[few]], rank[few]], name[mine[i[few]], rank[few]] = d[few], place[few]
        return count, dist, name

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    fields = T._parse_datatype_string(", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n_within int", *[f"`{i}_dist_m` double, `{i}_place` {kind}" for i in range(n_nearest)]]))
    arrow, of_place = to_arrow_schema(fields), to_arrow_schema(fields).field(len(keys) + 2).type if n_nearest else pa.int64()
    sent = points.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        known = pa.array(sent.value, of_place)
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            count, dist, name = kernel(*floats(rows, "latitude", "longitude"))
            cols = [rows[k].combine_chunks() for k in keys] + [pa.array(count)]
            for i in range(n_nearest):
                cols += [pa.array(dist[:, i], mask=name[:, i] < 0), known.take(pa.array(name[:, i], mask=name[:, i] < 0))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    ship_package(points.sparkSession)
    return points.select(*keys, "latitude", "longitude").mapInArrow(run, fields)


def nearest_places(points: DataFrame, places: DataFrame, *, keys: Sequence[str], n_nearest: int = 2, radius_m: float = 10_000.0) -> DataFrame:
    """Per point: n_within and the n nearest places in radius (i_dist_m, i_place). places: place, latitude, longitude.

    Places at one spot are measured once. Up to _SENT spots are held by all tasks, and points are measured as they come.
    With more of them a point meets the spots of its cell as arrays, so no pair is a row: what is shuffled is a row for each
    point and block of spots, however many places are in reach.
    """
    grid, take = _grid(radius_m), max(1, n_nearest)
    spots = _spots(places, take)
    few = spots.limit(_SENT + 1).collect()
    if len(few) <= _SENT:
        return _nearest_sent(points, few, places.schema["place"].dataType.simpleString(), keys=keys, n_nearest=n_nearest, radius_m=radius_m)
    near = _near_cells(spots, "lat2", "lon2", grid).withColumns(_unit_vector("lat2", "lon2"))
    block = F.floor((F.row_number().over(W.partitionBy("__row", "__col").orderBy("lat2", "lon2")) - 1) / _SPOTS)
    cells = near.withColumn("__block", block).groupBy("__row", "__col", "__block").agg(F.collect_list(F.struct("__ux", "__uy", "__uz", "lat2", "lon2", "n", "firsts")).alias("__spots"))
    pts = points.select(*keys, "latitude", "longitude").withColumns(_cells(F.col("latitude"), F.col("longitude"), grid)).withColumns(_unit_vector("latitude", "longitude", "__p"))
    # A quarter of the squared chord tells near from far; the distance itself is computed for what is at the edge or nearest.
    quarter = lambda s: ((F.col("__px") - s["__ux"]) * (F.col("__px") - s["__ux"]) + (F.col("__py") - s["__uy"]) * (F.col("__py") - s["__uy"]) + (F.col("__pz") - s["__uz"]) * (F.col("__pz") - s["__uz"])) * 0.25
    dist = lambda s: haversine_m(F.col("latitude"), F.col("longitude"), s["lat2"], s["lon2"])
    edge = math.sin(min(math.pi / 2, radius_m / EARTH_RADIUS_M / 2)) ** 2
    low, high = edge * (1 - 1e-6) - 1e-15, edge * (1 + 1e-6) + 1e-15
    measured = F.transform("__spots", lambda s: F.struct(quarter(s).alias("h"), s["lat2"].alias("lat2"), s["lon2"].alias("lon2"), s["n"].alias("n"), s["firsts"].alias("firsts")))
    met = pts.join(cells, ["__row", "__col"]).withColumn("s", F.filter(measured, lambda s: (s["h"] <= high) & ((s["h"] < low) | (dist(s) <= radius_m)))).where(F.size("s") > 0)
    # The spots up to the n-th nearest, and a little, hold the n nearest places.
    met = met.withColumn("h", F.coalesce(F.get(F.sort_array(F.col("s.h")), F.lit(take - 1)), F.lit(2.0)) * (1 + 1e-6) + 1e-15)
    close = F.transform(F.filter("s", lambda s: s["h"] <= F.col("h")), lambda s: F.struct(dist(s).alias("dist_m"), s["firsts"].alias("firsts")))
    held = F.flatten(F.transform(close, lambda s: F.transform(s["firsts"], lambda p: F.struct(s["dist_m"].alias("dist_m"), p["place"].alias("place")))))
    few = met.select(*keys, F.aggregate("s", F.lit(0).cast("bigint"), lambda n, s: n + s["n"]).alias("n"), F.slice(F.sort_array(held), 1, take).alias("b"))
    found = few.groupBy(*keys).agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("b"))), 1, take).alias("b"))
    found = found.select(*keys, "n", *[F.get("b", F.lit(i))[c].alias(f"{i}_{c}") for i in range(n_nearest) for c in ("dist_m", "place")])
    return points.select(*keys).join(found, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).cast("int").alias("n_within"), *[f"{i}_{c}" for i in range(n_nearest) for c in ("dist_m", "place")])


def _deal(lines: DataFrame, cell: float, margin: Column | float) -> DataFrame:
    """lines (x1, y1, x2, y2) with each cell (__x, __y) in which something within margin of them can lie.

    A line is cut by the rows of cells first, and in a row only the columns are taken that its part there comes near: a
    long slanting line has as many rows as the cells along it, not as its frame.
    """
    low, high = F.least("y1", "y2") - margin, F.greatest("y1", "y2") + margin
    rows = lines.withColumn("__y", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    share = lambda y: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1")))), F.lit(0.0))
    flat, dx = F.col("y1") == F.col("y2"), F.col("x2") - F.col("x1")
    a = F.col("x1") + dx * F.when(flat, 0.0).otherwise(share(F.col("__y") * cell - margin))
    b = F.col("x1") + dx * F.when(flat, 1.0).otherwise(share((F.col("__y") + 1) * cell + margin))
    cols = F.sequence(F.floor((F.least(a, b) - margin) / cell), F.floor((F.greatest(a, b) + margin) / cell))
    return rows.withColumn("__x", F.explode(cols))


def _edges(polygons: DataFrame) -> DataFrame:
    """(ord, name, __ring, x1, y1, x2, y2): a row for each edge. Rings that are there more than once count once."""
    rings = polygons.select("ord", "name", "ring", F.xxhash64("ring").alias("__ring")).dropDuplicates(["ord", "name", "__ring"])
    sides = rings.select("ord", "name", "__ring", F.explode(ring_edges(F.col("ring"))).alias("e"))
    return sides.select("ord", "name", "__ring", *[F.col(f"e.{p}.{c}").alias(f"{x}{n}") for p, n in (("a", 1), ("b", 2)) for c, x in (("lon", "x"), ("lat", "y"))])


_RING = ["ord", "name", "__ring"]


def _inner_spans(edges: DataFrame, rows: Column, height: Column) -> DataFrame:
    """(ord, name, __ring, __y, __from, __to): the stretches [__from, __to) of each row's line of latitude inside a ring.

    The crossings of a ring with the line are counted from the east; between an odd one and the next lies the inside.
    """
    y1, y2 = F.col("y1"), F.col("y2")
    lines = edges.withColumn("__y", F.explode(rows)).withColumn("__h", height).where((y1 > F.col("__h")) != (y2 > F.col("__h")))
    met = lines.select(*_RING, "__y", ((F.col("x2") - F.col("x1")) * (F.col("__h") - y1) / (y2 - y1) + F.col("x1")).alias("__to"))
    w = W.partitionBy(*_RING, "__y").orderBy(F.desc("__to"))
    return met.withColumns({"__k": F.row_number().over(w), "__from": F.lead("__to").over(w)}).where("__k % 2 = 1 and __from is not null").drop("__k")


def cover(polygons: DataFrame, cell: float) -> DataFrame:
    """(ord, name, __ring, __y, __x, __in, __e) for each cell that a ring fills or cuts.

    __in says whether the middle of the cell's eastern side is inside, __e has the edges that come into the cell (none if
    it is full). Edges are dealt to cells one by one and the inside is carried along a row of cells, so no task and no
    array holds a ring's edges but those of one cell.
    """
    edges = _edges(polygons)
    cut = _deal(edges, cell, cell * 1e-6).select(*_RING, "__y", "__x", F.lit(False).alias("__in"), F.struct("x1", "y1", "x2", "y2").alias("e"))
    rows = F.sequence(F.floor(F.least("y1", "y2") / cell) - 1, F.floor(F.greatest("y1", "y2") / cell) + 1)
    spans = _inner_spans(edges, rows, (F.col("__y") + 0.5) * cell)
    east = (F.col("__x") + 1) * cell
    full = spans.withColumn("__x", F.explode(F.sequence(F.floor(F.col("__from") / cell) - 2, F.floor(F.col("__to") / cell) + 1))).where((east >= F.col("__from")) & (east < F.col("__to")))
    full = full.select(*_RING, "__y", "__x", F.lit(True).alias("__in"), F.lit(None).cast(cut.schema["e"].dataType).alias("e"))
    return cut.unionAll(full).groupBy(*_RING, "__y", "__x").agg(F.max("__in").alias("__in"), F.collect_list("e").alias("__e"))


def _inside(x: Column, y: Column, cell: float, held: Column | None = None) -> Column:
    """Whether a point of a covered cell is in the ring: from it due east to the cell's side and along the side to its
    middle, each edge that is crossed changes between in and out. held: a struct with the ring's __in and __e."""
    east, middle = (F.col("__x") + 1) * cell, (F.col("__y") + 0.5) * cell
    begin, edges = (F.col("__in"), F.col("__e")) if held is None else (held["__in"], held["__e"])

    def crossed(n, e):
        over, beside = (e["y1"] > y) != (e["y2"] > y), (e["x1"] > east) != (e["x2"] > east)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(over, e["y2"] - e["y1"]).otherwise(1.0) + e["x1"]
        height = (e["y2"] - e["y1"]) * (east - e["x1"]) / F.when(beside, e["x2"] - e["x1"]).otherwise(1.0) + e["y1"]
        return n + F.when(over & (at > x) & (at <= east), 1).otherwise(0) + F.when(beside & ((height > y) != (height > middle)), 1).otherwise(0)

    return F.aggregate(edges, begin.cast("int"), crossed) % 2 == 1


def _in_cells(points: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    return points.select(*keys, "latitude", "longitude", F.floor(F.col("longitude") / cell).alias("__x"), F.floor(F.col("latitude") / cell).alias("__y"))


def _held(points: DataFrame, polygons: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """(keys, ord, name) for each polygon that holds a point."""
    pts = _in_cells(points, keys, cell)
    return pts.join(cover(polygons, cell), ["__x", "__y"]).where(_inside(F.col("longitude"), F.col("latitude"), cell)).select(*keys, "ord", "name")


def first_polygon(points: DataFrame, polygons: DataFrame, *, keys: Sequence[str], cell: float = 0.1) -> DataFrame:
    """points' keys with the first polygon (by ord) that holds them. polygons: ord, name, ring array<struct<lon,lat>>.

    A point meets the polygons of its cell as one row, in their order, and isn't put together again by its keys.
    """
    held = F.array_sort(F.collect_list(F.struct("ord", "name", "__in", "__e"))).alias("__held")
    in_order = cover(polygons, cell).groupBy("__x", "__y").agg(held)
    first = F.get(F.filter("__held", lambda p: _inside(F.col("longitude"), F.col("latitude"), cell, p)), F.lit(0))
    return _in_cells(points, keys, cell).join(in_order, ["__x", "__y"], "left").select(*keys, first["name"].alias("name"))


def polygon_context(points: DataFrame, polygons: DataFrame, *, keys: Sequence[str], within_deg: float = 0.05, within_m: float | None = None, cell: float = 0.1) -> DataFrame:
    """points' keys with the first polygon (by ord) that holds them or has an edge within within_deg (planar) or within_m.

    kind says `inside` or `within` (inside goes first), dist_deg or dist_m how far the nearest edge is (0 inside); null
    where no polygon is near. Points without a place are near none.
    """
    near = _near(points, _edges(polygons), keys, within_deg, within_m).withColumn("k", F.lit(1))
    inside = _held(points, polygons, keys, cell).withColumns({"k": F.lit(0), "d": F.lit(0.0)})
    best = inside.unionByName(near).groupBy(*keys).agg(F.min(F.struct("ord", "k", "d", "name")).alias("b"))
    kind = F.when(F.col("b.k") == 0, "inside").otherwise("within")
    return points.select(*keys).join(best.select(*keys, F.col("b.name").alias("name"), kind.alias("kind"), F.col("b.d").alias(_unit(within_m))), list(keys), "left")


def _unit(within_m: float | None) -> str:
    return "dist_deg" if within_m is None else "dist_m"


def _near(points: DataFrame, lines: DataFrame, keys: Sequence[str], within_deg: float, within_m: float | None) -> DataFrame:
    return _along(points, lines, keys, within_deg) if within_m is None else _along_m(points, lines, keys, within_m)


def _along(points: DataFrame, lines: DataFrame, keys: Sequence[str], within_deg: float) -> DataFrame:
    """(keys, ord, name, d) for each segment within within_deg of a point."""
    cell = max(within_deg, 1e-6) * 2
    pts = points.select(*keys, F.col("longitude").alias("__px"), F.col("latitude").alias("__py"), F.lit(1.0).alias("__scale"))
    return _measured(pts, lines, keys, cell, within_deg * (1 + 1e-9), within_deg)


#: Of the projection, fixed values: the globe's radius in metres and the latitude where the map ends.
MERCATOR_RADIUS_M, MERCATOR_END_DEG = 6378137.0, 85.06


def _mercator(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Place on the Mercator map in metres, and how many metres on the globe one of the map is there."""
    held = F.radians(F.greatest(F.lit(-MERCATOR_END_DEG), F.least(F.lit(MERCATOR_END_DEG), lat)))
    return F.radians(lon) * MERCATOR_RADIUS_M, F.asinh(F.tan(held)) * MERCATOR_RADIUS_M, F.cos(held)


def _along_m(points: DataFrame, lines: DataFrame, keys: Sequence[str], within_m: float) -> DataFrame:
    """(keys, ord, name, d) for each segment within within_m metres of a point, measured on the Mercator map by the scale at the point.

    The map is true to shape, so near a point all directions have the same scale. Segments are straight on the map. What
    lies beyond 85.06 degrees counts as if it lay there, and nothing is near across the date line. within_m: at most 500 km.
    """
    if not 0 <= within_m <= 500_000:
        raise ValueError("within_m must be between 0 and 500,000 metres")
    x, y, scale = _mercator(F.col("longitude"), F.col("latitude"))
    pts = points.select(*keys, x.alias("__px"), y.alias("__py"), scale.alias("__scale"))
    far = F.greatest(F.abs(F.col("y1")), F.abs(F.col("y2"))) + 2 * math.degrees(within_m / MERCATOR_RADIUS_M)
    ends = {f"{c}{n}": v for n in (1, 2) for c, v in zip("xy", _mercator(F.col(f"x{n}"), F.col(f"y{n}"))[:2], strict=True)}
    flat = lines.withColumn("__margin", F.lit(within_m * (1 + 1e-9)) / _mercator(F.lit(0.0), far)[2]).withColumns(ends)
    return _measured(pts, flat, keys, max(within_m, 1.0) * 2, F.col("__margin"), within_m)


def _measured(pts: DataFrame, lines: DataFrame, keys: Sequence[str], cell: float, margin: Column | float, limit: float) -> DataFrame:
    """(keys, ord, name, d) of points (__px, __py) and lines on a plane, distances times the point's __scale."""
    held = pts.withColumns({"__x": F.floor(F.col("__px") / cell), "__y": F.floor(F.col("__py") / cell)})
    d = segment_distance_deg(F.col("__px"), F.col("__py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) * F.col("__scale")
    return held.join(_deal(lines, cell, margin), ["__x", "__y"]).withColumn("d", d).where(F.col("d") <= limit).select(*keys, "ord", "name", "d")


def near_line(points: DataFrame, lines: DataFrame, *, keys: Sequence[str], within_deg: float = 0.05, within_m: float | None = None) -> DataFrame:
    """points' keys with the first segment (by ord) within within_deg (planar, dist_deg) or within_m (dist_m). lines: ord, name, lon1, lat1, lon2, lat2."""
    flat = lines.select("ord", "name", *[F.col(f"{c}{n}").alias(f"{x}{n}") for n in (1, 2) for c, x in (("lon", "x"), ("lat", "y"))])
    found = _near(points, flat, keys, within_deg, within_m)
    best = found.groupBy(*keys).agg(F.min(F.struct("ord", "name", "d")).alias("b")).select(*keys, F.col("b.name").alias("name"), F.col("b.d").alias(_unit(within_m)))
    return points.select(*keys).join(best, list(keys), "left")


def raster_cells(lat: Column, lon: Column, rows: int, cols: int) -> tuple[Column, Column]:
    """Nearest cell of a raster from (90, -180) to (-90, 180); the edges belong to the last cells."""
    row = F.bround((90 - lat) / 180 * rows - 0.5)
    col = F.bround((lon + 180) / 360 * cols - 0.5)
    hold = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c.cast("int")))
    return hold(row, rows), hold(col, cols)


def raster_lookup(points: DataFrame, raster: DataFrame, *, rows: int, cols: int, name: str) -> DataFrame:
    """points with the raster's value. raster: row, col, value."""
    r, c = raster_cells(F.col("latitude"), F.col("longitude"), rows, cols)
    return points.withColumns({"__r": r, "__c": c}).join(raster.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("value").alias(name)), ["__r", "__c"], "left").drop("__r", "__c")


def tile_lookup(points: DataFrame, tiles: DataFrame, *, rows: int, cols: int, side: int, name: str) -> DataFrame:
    """points with the raster's value, null where there is none. tiles: tile_row, tile_col, width, values, row by row.

    One row of the join for a point, as with single cells, but the raster's side has a row for side * side of them.
    """
    r, c = raster_cells(F.col("latitude"), F.col("longitude"), rows, cols)
    placed = points.withColumns({"__r": r, "__c": c}).withColumns({"__tr": F.floor(F.col("__r") / side).cast("int"), "__tc": F.floor(F.col("__c") / side).cast("int")})
    held = tiles.select(F.col("tile_row").alias("__tr"), F.col("tile_col").alias("__tc"), F.col("width").alias("__w"), F.col("values").alias("__v"))
    found = F.get("__v", (F.col("__r") % side) * F.col("__w") + F.col("__c") % side)
    return placed.join(held, ["__tr", "__tc"], "left").select(*points.columns, F.nanvl(found, F.lit(None).cast("double")).alias(name))


def rasterise(polygons: DataFrame, *, rows: int, cols: int) -> DataFrame:
    """(row, col, value): the first polygon (by ord) that holds each cell's centre.

    Each row is filled between the crossings of its line of centres; no cell is tested against an edge.
    """
    dlat, dlon = 180 / rows, 360 / cols
    own_rows = F.sequence(F.floor((90 - F.greatest("y1", "y2")) / dlat) - 1, F.floor((90 - F.least("y1", "y2")) / dlat) + 1)
    spans = _inner_spans(_edges(polygons), own_rows, 90 - (F.col("__y") + 0.5) * dlat)
    centre = (F.col("__x") + 0.5) * dlon - 180
    cells = spans.withColumn("__x", F.explode(F.sequence(F.floor((F.col("__from") + 180) / dlon) - 1, F.floor((F.col("__to") + 180) / dlon) + 1)))
    inside = cells.where((centre >= F.col("__from")) & (centre < F.col("__to")) & F.col("__y").between(0, rows - 1) & F.col("__x").between(0, cols - 1))
    return inside.groupBy(F.col("__y").alias("row"), F.col("__x").alias("col")).agg(F.min("ord").alias("value"))


def within(df: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    return df.where(haversine_m(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)) < radius_m)


def nearest_any(points: DataFrame, places: DataFrame, *, keys: Sequence[str], n_nearest: int = 2, start_m: float = 2_000.0) -> DataFrame:
    """Per point the n nearest places (i_dist_m, i_place) at any distance; null only where there are fewer places.

    The radius begins at start_m and grows fourfold, each time only for the points that have found fewer than n.
    """
    need, radius, out = min(n_nearest, places.count()), start_m, None
    left = points.select(*keys, "latitude", "longitude")
    while True:
        found = nearest_places(left, places, keys=keys, n_nearest=n_nearest, radius_m=radius).persist()
        last = radius >= math.pi * EARTH_RADIUS_M
        enough = found if last else found.where(F.col("n_within") >= need)
        out = enough if out is None else out.unionByName(enough)
        open_ = found.where(F.col("n_within") < need)
        if last or open_.isEmpty():
            return out.drop("n_within")
        left, radius = left.join(open_.select(*keys), list(keys), "left_semi"), radius * 4
