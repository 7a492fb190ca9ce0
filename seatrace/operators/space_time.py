"""Density clustering in space and time, by cells.

Two points are near if hypot(dt / ns_per_m, great-circle metres) is at most eps_m. Cells are so small that all points in
one are near each other, so what a cell holds never has to be compared with itself: a cell with min_points points has only
core points. Only points of thin cells count their neighbours, and cells, not points, are linked. That is done in blocks of
cells, each with the cells around it that its own points can depend on; what is left is a graph of cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatrace.functions.geo import EARTH_RADIUS_M
from seatrace.groups import map_groups
from seatrace.storage import connected_components, written

from .meetings import metres

#: Pairs of points that are measured at a time, and rows of a batch.
_AT_ONCE, _BATCH = 1_000_000, 100_000


def _side(eps_m: float) -> float:
    """Height of a cell in degrees: a third of the diagonal's square for each of the three sides, and a little less."""
    return math.degrees(eps_m / EARTH_RADIUS_M) / math.sqrt(3) * 0.9999


def _columns(row: Column, side: float) -> Column:
    """Cells around the globe in a row; none is wider than the side anywhere in the row."""
    flattest = F.greatest(F.lit(0.0), F.least(F.abs(row), F.abs(row + 1)) * side)
    return F.greatest(F.lit(1), F.ceil(360 * F.cos(F.radians(F.least(flattest, F.lit(90.0)))) / side)).cast("bigint")


def _cell(lat: Column, lon: Column, us: Column, side: float, step: float) -> dict[str, Column]:
    row = F.floor(lat / side)
    n = _columns(row, side)
    return {"row": row, "col": F.pmod(F.floor((lon + 180) / (360 / n)), n), "slot": F.floor(us / F.lit(step))}


#: Cells along the side of a block in latitude and time, and at least as many along the third.
_EDGE = 16
#: Cells around a block's own that are sent along: two to each side decide which of them hold core points, two more which of
#: these are near its own points.
_HALO = 4


def _blocks(placed: DataFrame, side: float) -> DataFrame:
    """Points with each block (b_row, b_col, b_slot) that needs them, and whether the block is theirs (own).

    A block has _EDGE rows and slots, and a part of the globe's round in which all its rows have that many columns. A cell
    belongs to the block of its middle. It is sent to blocks within _HALO rows and slots, and so far east and west that two
    steps of the reach fit in between at the latitude that is farthest from the equator, with the widths of the cells.
    """
    near = lambda c: F.sequence(F.floor((F.col(c) - _HALO) / _EDGE), F.floor((F.col(c) + _HALO) / _EDGE))
    out = placed.withColumn("b_row", F.explode(near("row"))).withColumn("b_slot", F.explode(near("slot")))
    # The rows that a block and what is around it can have: the columns' number falls towards the poles.
    top = F.greatest(F.abs(F.col("b_row") * _EDGE - _HALO), F.abs((F.col("b_row") + 1) * _EDGE + _HALO))
    parts = F.greatest(F.lit(1), F.floor(_columns(top, side) / _EDGE)).cast("bigint")
    n = _columns(F.col("row"), side)
    eps_deg = side * math.sqrt(3) / 0.9999
    ratio = math.sin(math.radians(min(90.0, eps_deg / 2))) / F.cos(F.radians(F.least(top * side, F.lit(89.99))))
    reach = F.when((top * side >= 89.99) | (ratio >= 1), F.lit(360.0)).otherwise(2 * F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.001)
    margin = 2 * reach + 3 * (360 / _columns(top, side))
    width = 360 / parts
    first, last = F.floor((F.col("col") * (360 / n) - margin) / width), F.floor(((F.col("col") + 1) * (360 / n) + margin) / width)
    cols = F.transform(F.sequence(first, F.least(last, first + parts - 1)), lambda c: F.pmod(c, parts))
    out = out.withColumn("__parts", parts).withColumn("b_col", F.explode(F.array_distinct(cols)))
    middle = F.pmod(F.floor((F.col("col") + 0.5) * (360 / n) / (360 / F.col("__parts"))), F.col("__parts"))
    own = (F.col("b_row") == F.floor(F.col("row") / _EDGE)) & (F.col("b_slot") == F.floor(F.col("slot") / _EDGE)) & (F.col("b_col") == middle)
    return out.withColumn("own", own).drop("__parts")


def _distance(a: np.ndarray, b: np.ndarray, ns_per_m: float) -> np.ndarray:
    """Of points (lat, lon in degrees, microseconds)."""
    return np.hypot((a[..., 2] - b[..., 2]) * (1e3 / ns_per_m), metres(a[..., 0], a[..., 1], b[..., 0], b[..., 1]))


def _pairs(size_a: np.ndarray, start_a: np.ndarray, size_b: np.ndarray, start_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the pair of ranges, element of a, element of b) of all combinations, about _AT_ONCE at a time; a pair of
    ranges with more than these comes in parts."""
    total = size_a * size_b
    big = np.flatnonzero(total > _AT_ONCE)
    for p in big.tolist():
        step = max(1, _AT_ONCE // int(size_b[p]))
        for i in range(0, int(size_a[p]), step):
            for j in range(0, int(size_b[p]), _AT_ONCE):
                a, b = np.arange(i, min(i + step, size_a[p])) + start_a[p], np.arange(j, min(j + _AT_ONCE, size_b[p])) + start_b[p]
                yield np.full(len(a) * len(b), p), np.repeat(a, len(b)), np.tile(b, len(a))
    rest = np.flatnonzero((total <= _AT_ONCE) & (total > 0))
    cuts = np.flatnonzero(np.diff(np.cumsum(total[rest]) // _AT_ONCE, prepend=-1)).tolist() + [len(rest)]
    for b, e in zip(cuts[:-1], cuts[1:], strict=True):
        own = rest[b:e]
        of = np.repeat(own, total[own])
        at = np.arange(len(of)) - np.repeat(np.cumsum(total[own]) - total[own], total[own])
        yield of, start_a[of] + at // size_b[of], start_b[of] + at % size_b[of]


class _Block:
    """Points of a block in the order of their cells (time, row, column), and pairs of cells that can be near each other."""

    def __init__(self, rows: dict[str, np.ndarray], eps_m: float, ns_per_m: float):
        order = np.lexsort((rows["id"], rows["col"], rows["row"], rows["slot"]))
        self.id, self.own, slot, row, col = (rows[c][order] for c in ("id", "own", "slot", "row", "col"))
        self.at = np.column_stack([rows["lat"], rows["lon"], rows["us"]])[order]
        self.eps, self.ns = eps_m, ns_per_m
        new = np.ones(len(order), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(order)))
        self.cell = np.cumsum(new) - 1
        self.slot, self.row = slot[self.start], row[self.start]
        self.mine = self.own[self.start]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs a < b of cells within two slots and rows whose points, by boxes around them, can be near each other."""
        low, high = (np.column_stack([f.reduceat(self.at[:, c], self.start) for c in range(3)]) for f in (np.minimum, np.maximum))
        deg, us = math.degrees(self.eps / EARTH_RADIUS_M) * 1.0001, self.eps * self.ns / 1e3 * 1.0001
        upto = np.searchsorted(self.slot, self.slot + 2, "right")
        found = []
        for a in range(len(self.slot)):
            b = np.arange(a + 1, upto[a])
            b = b[np.abs(self.row[b] - self.row[a]) <= 2]
            near = (low[b, 0] - high[a, 0] <= deg) & (low[a, 0] - high[b, 0] <= deg) & (low[b, 2] - high[a, 2] <= us) & (low[a, 2] - high[b, 2] <= us)
            b = b[near]
            if len(b):
                found.append((np.full(len(b), a), b))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return _distance(self.at[i], self.at[j], self.ns) <= self.eps


def _settled(rows: dict[str, np.ndarray], eps_m: float, ns_per_m: float, min_points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, a, b) of a block: 0: cells, named by their smallest core ids, that are linked; 1: an own point and its cell,
    that of its nearest core point where it is none itself.
    """
    block = _Block(rows, eps_m, ns_per_m)
    n, (a, b) = len(block.id), block.pairs()
    # Points of a full cell are core points; those of thin cells count their neighbours.
    full = block.size >= min_points
    core = full[block.cell]
    if not full.all():
        count = block.size[block.cell].copy()
        some = np.flatnonzero(~full[a] | ~full[b])
        for _, i, j in _pairs(block.size[a[some]], block.start[a[some]], block.size[b[some]], block.start[b[some]]):
            ok = block.near(i, j)
            count += np.bincount(i[ok], minlength=n) + np.bincount(j[ok], minlength=n)
        core |= count >= min_points
    # Core points alone, cell by cell.
    at = np.flatnonzero(core)
    size = np.bincount(block.cell[at], minlength=len(block.size))
    start = np.cumsum(size) - size
    node = np.zeros(len(size), block.id.dtype)
    held = np.flatnonzero(size)
    if len(held):
        node[held] = np.minimum.reduceat(block.id[at], start[held])
    root = list(range(len(size)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    some = np.flatnonzero((size[a] > 0) & (size[b] > 0) & (block.mine[a] | block.mine[b]))
    few = size[a[some]] * size[b[some]] <= _AT_ONCE
    for part in [some[few], *np.split(some[~few], np.arange(1, (~few).sum()))]:  # small ones first: they can spare large ones
        if len(part) == 1 and top(int(a[part[0]])) == top(int(b[part[0]])):
            continue
        for of, i, j in _pairs(size[a[part]], start[a[part]], size[b[part]], start[b[part]]):
            hit = np.unique(of[block.near(at[i], at[j])])
            for x, y in zip(a[part[hit]].tolist(), b[part[hit]].tolist(), strict=True):
                x, y = top(x), top(y)
                root[max(x, y)] = min(x, y)
            if len(part) == 1 and len(hit):
                break
    tops = np.array([top(i) for i in range(len(root))])
    linked = held[tops[held] != held]
    own = np.flatnonzero(block.own & core)
    out = [(np.zeros(len(linked), int), node[linked], node[tops[linked]]), (np.ones(len(own), int), block.id[own], node[block.cell[own]])]

    # Border points: the nearest core point, of equally near ones that with the smaller id.
    best = np.full(n, np.inf)
    to = np.full(n, -1)
    edge = block.own & ~core
    thin = np.unique(block.cell[edge])
    if len(thin):
        each = np.concatenate([a, b, thin]), np.concatenate([b, a, thin])
        some = np.flatnonzero(np.isin(each[0], thin) & (size[each[1]] > 0))
        x, y = each[0][some], each[1][some]
        for _, i, j in _pairs(block.size[x], block.start[x], size[y], start[y]):
            keep = edge[i]
            i, j = i[keep], at[j[keep]]
            d = _distance(block.at[i], block.at[j], ns_per_m)
            ok = d <= eps_m
            i, j, d = i[ok], j[ok], d[ok]
            order = np.lexsort((block.id[j], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.ones(len(i), bool)
            first[1:] = i[1:] != i[:-1]
            i, j, d = i[first], j[first], d[first]
            better = (d < best[i]) | ((d == best[i]) & (block.id[j] < block.id[to[i]]))
            best[i[better]], to[i[better]] = d[better], j[better]
        got = np.flatnonzero(to >= 0)
        out.append((np.ones(len(got), int), block.id[got], node[block.cell[to[got]]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def clusters(points: DataFrame, *, eps_m: float, ns_per_m: float = 100.0, min_points: int = 1, id_col: str = "det_id") -> DataFrame:
    """(id, cluster): the smallest id of each point's cluster, null for points in none.

    points: id, timestamp, latitude, longitude. A core point has min_points points near it, itself included; clusters are
    core points connected by nearness, and a border point joins its nearest core point's (ties: the smaller id). Points
    without a time or place are in no cluster. Equal points count as often as they occur.
    """
    if eps_m <= 0 or ns_per_m <= 0 or min_points < 1:
        raise ValueError("eps_m and ns_per_m are above 0, min_points at least 1")
    side, step = _side(eps_m), eps_m * ns_per_m / 1e3 / math.sqrt(3) * 0.9999
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    src = points.select(F.col(id_col).alias("id"), us.alias("us"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    placed = src.where("us is not null and lat is not null and lon is not null").withColumns(_cell(F.col("lat"), F.col("lon"), F.col("us"), side, step))
    kind = src.schema["id"].dataType.simpleString()

    def find(rows: pa.Table, bounds: np.ndarray) -> Iterator[dict]:
        held = {c: rows[c].to_numpy() for c in ("id", "us", "lat", "lon", "row", "col", "slot", "own")}
        made, n = [], 0
        for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if not held["own"][b:e].any():
                continue
            made.append(_settled({c: v[b:e] for c, v in held.items()}, eps_m, ns_per_m, min_points))
            n += len(made[-1][0])
            if n > _BATCH or e == bounds[-1]:
                yield dict(zip(("kind", "a", "b"), map(np.concatenate, zip(*made, strict=True)), strict=True))
                made, n = [], 0
        if made:
            yield dict(zip(("kind", "a", "b"), map(np.concatenate, zip(*made, strict=True)), strict=True))

    key = ["b_row", "b_col", "b_slot"]
    met = written(map_groups(_blocks(placed, side).select(*key, "own", "id", "us", "lat", "lon", "row", "col", "slot"), key, ["slot"], find, f"kind int, a {kind}, b {kind}"), "blocks")
    joined = connected_components(met.where("kind = 0").select("a", "b"), "space-time").withColumnRenamed("node", "b")
    named = met.where("kind = 1").select(F.col("a").alias("id"), "b").join(joined, "b", "left").select("id", F.coalesce("component", "b").alias("cluster"))
    if min_points > 1:
        smallest = named.groupBy("cluster").agg(F.min("id").alias("least"))
        named = named.join(smallest, "cluster").select("id", F.col("least").alias("cluster"))
    return src.select("id").join(named, "id", "left").withColumnRenamed("id", id_col)
