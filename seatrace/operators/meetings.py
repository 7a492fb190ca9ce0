"""Ships and detections met at one instant.

A ship's way between two reports is dealt, as one row, to the times in which an instant can be near one of these reports;
detections are dealt by the same times. So all ships and detections of an instant are in one group, and a pair of them is
no row before a kernel hands it on: what is shuffled follows the reports, however many pairs there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import islice, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seatrace.functions.geo import EARTH_RADIUS_M
from seatrace.groups import floats, map_groups

from .clock import intervals
from .tracks import micros

#: Seconds of a group: long enough for a report to be in few of them, short enough for a group to be small.
SPAN_SEC = 6 * 3600

#: Thousands of distances computed at a time, and points from which on ships are sorted for them.
AT_ONCE, _SORTED = 64, 12

_BEFORE = np.iinfo(np.int64).min


def metres(lat1, lon1, lat2, lon2) -> np.ndarray:
    """geo.haversine_m in the same order of operations; degrees."""
    la1, la2 = np.radians(lat1), np.radians(lat2)
    s1, s2 = np.sin((la2 - la1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(s1 * s1 + np.cos(la1) * np.cos(la2) * s2 * s2)))


class Ships:
    """Places of ships at an instant: interval, ship, side (0: the interval's first report is nearest, else 1), time of that
    report. For many points they are put from south to north."""

    _COLUMNS = ("interval", "mmsi", "side", "nearest", "late", "lat", "lon")

    def __init__(self, columns: Sequence[np.ndarray], ordered: bool):
        self.ordered = ordered
        order = np.argsort(columns[5]) if ordered else slice(None)
        for n, c in zip(self._COLUMNS, columns, strict=True):
            setattr(self, n, c[order])

    def where(self, keep: np.ndarray) -> Ships:
        if keep.all():
            return self
        out = object.__new__(Ships)
        out.ordered = self.ordered
        for n in self._COLUMNS:
            setattr(out, n, getattr(self, n)[keep])
        return out

    def within(self, lat: np.ndarray, lon: np.ndarray, reach_m: float, at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, ship, metres) of all pairs of points and ships within reach."""
        n, there = len(lat), len(self.lat)
        if not n or not there:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        angle = reach_m / EARTH_RADIUS_M * 1.000001
        deg = math.degrees(angle) + 1e-9
        ratio = math.sin(angle) / np.where(np.abs(lat) + deg < 90, np.cos(np.radians(lat)), 1.0)
        wide = np.where((ratio < 1) & (np.abs(lat) + deg < 90), np.degrees(np.arcsin(np.minimum(ratio, 1.0))) * 1.000001 + 1e-9, 360.0)
        order, low, high = np.arange(n), [0] * n, [there] * n
        if self.ordered:
            order = np.argsort(lat, kind="stable")
            low, high = (np.searchsorted(self.lat, lat[order] + off, side).tolist() for off, side in ((-deg, "left"), (deg, "right")))
        found, i = [], 0
        while i < n:
            j, b = i + 1, low[i]
            while j < n and (j + 1 - i) * (high[j] - b) <= at_once:
                j += 1
            e, own = high[j - 1], order[i:j]
            off = np.abs(self.lon[b:e] - lon[own, None])
            near = np.minimum(off, 360 - off) <= wide[own, None]
            near &= np.abs(self.lat[b:e] - lat[own, None]) <= deg
            at = np.flatnonzero(near)
            k, s = own[at // max(1, e - b)], at % max(1, e - b) + b
            m = metres(self.lat[s], self.lon[s], lat[k], lon[k])
            keep = m <= reach_m
            found.append((k[keep], s[keep], m[keep]))
            i = j
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if len(found) > 1 else found[0]


class Group:
    """What a kernel gets: detections by time (det_id and the extra columns in arrow) and the intervals of their hours."""

    def __init__(self, rows: pa.Table, threshold_sec: float):
        is_det = rows["__kind"].to_numpy() == 0
        self.dets, held = rows.filter(pa.array(is_det)), rows.filter(pa.array(~is_det))
        self.held, self.threshold = held, threshold_sec * 1e6
        self.t = pc.fill_null(self.dets["us"], _BEFORE).to_numpy()
        self.lat, self.lon = floats(self.dets, "lat0", "lon0")
        self.mmsi, self.t0, self.seq = (held[c].to_numpy() for c in ("mmsi", "us", "seq"))
        last = held["t1"].is_null().to_numpy()
        self.t1 = pc.fill_null(held["t1"], 0).to_numpy() + np.where(last, self.t0, 0)
        self.end = np.where(last, self.t0, self.t1 - 1)
        self.place = floats(held, "lat0", "lon0", "lat1", "lon1")

    def instants(self) -> Iterator[tuple[int, int, int]]:
        """(first, end, time) of detections of one instant."""
        at = np.append(np.flatnonzero(np.diff(self.t, prepend=self.t[:1] - 1)), len(self.t)) if len(self.t) else np.zeros(1, int)
        for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield b, e, int(self.t[b])

    def ships(self, t: int, points: int) -> Ships:
        """Ships whose reports enclose t, the nearer one within the threshold; points: how many will be looked for."""
        begun = int(np.searchsorted(self.t0, t, "right"))
        at = np.flatnonzero(self.end[:begun] >= t)
        t0, t1 = self.t0[at], self.t1[at]
        exact = t0 == t
        share = np.where(exact, 0.0, (t - t0) / np.where(t1 == t0, 1, t1 - t0).astype(float))
        side = (np.rint(self.seq[at] + share) > self.seq[at]).astype(int)
        nearest = np.where(side == 1, t1, t0)
        late = np.abs(nearest - t)
        lat0, lon0, lat1, lon1 = (p[at] for p in self.place)
        lat = np.where(exact, lat0, lat0 + (lat1 - lat0) * share)
        lon = np.where(exact, lon0, lon0 + (lon1 - lon0) * share)
        keep = (late < self.threshold) & ~np.isnan(lat) & ~np.isnan(lon)
        return Ships([a[keep] for a in (at, self.mmsi[at], side, nearest, late, lat, lon)], points > _SORTED)


def met(detections: DataFrame, reports: DataFrame, threshold_sec: float, kernel: Callable[[Group], Iterator[dict]], schema: str, *, extra: Sequence[str] = (), columns: Sequence[str] = ()) -> DataFrame:
    """The rows that the kernel makes of each group. extra: more columns of detections; columns: those of reports that intervals
    carry, as lists (__own, __next) of structs with an element for each of the ship's reports at that time."""
    width, limit = SPAN_SEC * 1_000_000, int(math.ceil(threshold_sec * 1e6))
    src = reports.select("mmsi", "timestamp", "latitude", "longitude")
    lists = []
    if columns:
        same = W.partitionBy("mmsi").orderBy("timestamp").rangeBetween(W.currentRow, W.currentRow)
        src = reports.select("mmsi", "timestamp", "latitude", "longitude", F.collect_list(F.struct(*columns)).over(same).alias("__all"))
        lists = [F.col("prev.__all").alias("__own"), F.col("next.__all").alias("__next")]
    held = intervals(src).where("mmsi is not null and t0 is not null and prev.latitude is not null and prev.longitude is not null")
    end = F.coalesce(F.col("t1") - 1, F.col("t0"))
    span = lambda a, b: F.sequence(F.floor(a / width), F.floor(b / width))
    spans = F.array_distinct(F.concat(span(F.col("t0"), F.least(end, F.col("t0") + limit)), span(F.greatest(F.col("t0"), F.coalesce("t1", "t0") - limit), end)))
    places = [F.col(f"{w}.{c}").cast("double").alias(f"{n}{k}") for k, w in enumerate(("prev", "next")) for c, n in (("latitude", "lat"), ("longitude", "lon"))]
    dealt = held.where(end >= F.col("t0")).select(F.explode(spans).alias("__span"), F.lit(1).alias("__kind"), "mmsi", F.col("t0").alias("us"), "t1", "seq", *places, *lists)
    us = micros("timestamp")
    asked = detections.select(F.floor(us / width).alias("__span"), F.lit(0).alias("__kind"), us.alias("us"), F.col("latitude").cast("double").alias("lat0"), F.col("longitude").cast("double").alias("lon0"), "det_id", *extra)
    parts = 4 * reports.sparkSession.sparkContext.defaultParallelism

    def run(rows: pa.Table, bounds: np.ndarray):
        for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            group = rows.slice(b, e - b)
            if group["__kind"][0].as_py() == 0:  # else no detection is there
                yield from kernel(Group(group, threshold_sec))

    return map_groups(asked.unionByName(dealt, allowMissingColumns=True), ["__span"], ["__kind", "us", "det_id", "mmsi"], run, schema, deal=(parts, F.coalesce(F.pmod("__span", F.lit(parts)), F.lit(0)).cast("int")))


def labels_of(lat: np.ndarray, lon: np.ndarray, eps_m: float) -> np.ndarray:
    """Numbers of connected groups of points (radians) within eps_m, in the order of their first points."""
    label = np.full(len(lat), -1)
    free, count = np.arange(len(lat)), 0
    while len(free):
        stack, label[free[0]] = [int(free[0])], count
        free = free[1:]
        while stack and len(free):
            k = stack.pop()
            a, o = lat[free], lon[free]
            h = np.sin((a - lat[k]) / 2) ** 2 + np.cos(a) * np.cos(lat[k]) * np.sin((o - lon[k]) / 2) ** 2
            near = 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(h))) <= eps_m
            label[free[near]] = count
            stack.extend(free[near].tolist())
            free = free[~near]
        count += 1
    return label


def _greedy(lat, lon, ships: Ships, reach_m: float, at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """(ship, metres) of each detection when the nearest pairs are taken first (ties: the smaller ship, then the earlier
    detection), each ship once; -1 where none is left. Pairs are looked for in growing circles, and farther ones only for
    detections that have no ship yet: all nearer pairs have been taken before."""
    n = len(lat)
    ship, far = np.full(n, -1), np.full(n, np.inf)
    used = np.zeros(len(ships.lat), bool)
    open_ = np.arange(n)
    r = reach_m if n * len(ships.lat) <= at_once else reach_m / 32
    while True:
        k, s, m = ships.within(lat[open_], lon[open_], r, at_once)
        fresh = ~used[s]
        k, s, m = open_[k[fresh]], s[fresh], m[fresh]
        order = np.lexsort((k, ships.mmsi[s], m))
        left = len(open_)
        for a, b, c in zip(k[order].tolist(), s[order].tolist(), m[order].tolist(), strict=True):
            if ship[a] < 0 and not used[b]:
                ship[a], far[a], used[b] = b, c, True
                left -= 1
                if not left:
                    break
        open_ = open_[ship[open_] < 0]
        if r >= reach_m or not len(open_):
            return ship, far
        r = min(reach_m, r * 2)


@lru_cache(64)
def _permuted(n: int, most: int) -> np.ndarray:
    return np.array(list(islice(permutations(range(n)), most)))


def _best(order: list[int], d: Callable[[list[int], list[int]], np.ndarray], own: np.ndarray, most: int) -> tuple[list[int], int, int, int]:
    """_search's permutations of ships that are as many as the detections: (ship of each, improvements, last, tries).

    The first `most` permutations differ in their last places alone; own: the costs of the order that is given.
    """
    n, tail, count = len(order), 1, 1
    while tail < n and count < most:
        tail += 1
        count *= tail
    perms = _permuted(tail, max(1, int(most)))
    costs = d(order[n - tail :], list(range(n - tail, n)))
    means = []
    for b in range(0, len(perms), step := max(1, 2_000_000 // n)):
        part = perms[b : b + step]
        full = np.repeat(own[None, :], len(part), axis=0)
        full[:, n - tail :] = costs[part, np.arange(tail)]
        means += full.mean(axis=1).tolist()
    at, least, better = 0, means[0], 0
    for k, mean in enumerate(means):
        if mean < least - 1e-12:
            at, least, better = k, mean, better + 1
    return order[: n - tail] + [order[n - tail + p] for p in perms[at].tolist()], better, at, len(perms)


def _extra(n: int, most: int) -> int:
    """How many ships beyond the greedy ones the permutations of n detections can reach."""
    if n > 20 and most < 10**18:  # far more permutations of the greedy ones alone
        return 0
    depth = n
    while n > 1 and np.prod(np.arange(depth + 2 - n, depth + 2, dtype=float)) < most:
        depth += 1
    return depth - n


def _spare(lat, lon, ships: Ships, used: np.ndarray, reach_m: float, at_once: int, count: int) -> list[int]:
    """The first ships by their numbers that aren't used and in reach of any detection; a few ships are tried at a time."""
    rest = np.setdiff1d(np.arange(len(ships.lat)), used)
    rest, out = rest[np.argsort(ships.mmsi[rest], kind="stable")], []
    for b in range(0, len(rest), 256):
        if len(out) >= count:
            break
        some = rest[b : b + 256]
        columns = [getattr(ships, c)[some] for c in Ships._COLUMNS]
        out += some[np.unique(Ships(columns, False).within(lat, lon, reach_m, at_once)[1])].tolist()
    return out[:count]


def settle(lat: np.ndarray, lon: np.ndarray, ships: Ships, reach_m: float, most: int, at_once: int, search: Callable, overflow: float, power: int = 1) -> tuple | None:
    """(ship or -1, metres, improvements, last improvement, tries) for detections of one cluster; None if no ship is in reach.

    The same as `search` on the distances of all ships in reach (a row each, by their numbers), but that table is only made
    of ships that can be used: none where the permutations reach the greedy ships alone, else the nearest of each detection.
    """
    n = len(lat)

    def distances(s: np.ndarray, k: np.ndarray) -> np.ndarray:
        d = metres(ships.lat[s, None], ships.lon[s, None], lat[k], lon[k])
        return np.where(d <= reach_m, d, overflow)

    more = _extra(n, most)
    if not more:
        ship, far = _greedy(lat, lon, ships, reach_m, at_once)
        free = np.flatnonzero(ship < 0)
        order = ship.tolist()
        if len(free):
            if len(free) == n:
                return None
            spare = _spare(lat, lon, ships, ship, reach_m, at_once, len(free))
            for at, k in enumerate(free.tolist()):  # ships of no detection, then none
                order[k] = spare[at] if at < len(spare) else len(ships.lat) + at

        def costs(of: list[int], k: list[int]) -> np.ndarray:
            s = np.array(of)
            real = s < len(ships.lat)
            d = np.full((len(s), len(k)), overflow)
            d[real] = distances(s[real], np.array(k))
            return d**power

        own = np.where(np.isinf(far), overflow, far) ** power
        best, better, last, tries = _best(order, costs, own, most)
    else:
        k, s, m = ships.within(lat, lon, reach_m, at_once)
        if not len(s):
            return None
        need = n + more
        if np.bincount(k, minlength=n).min() >= n:  # else ships out of reach take part, the smallest numbers first
            order = np.lexsort((ships.mmsi[s], m, k))
            k, s = k[order], s[order]
            s = s[np.arange(len(k)) - np.searchsorted(k, k) < need]
        s = np.unique(s)
        s = s[np.argsort(ships.mmsi[s], kind="stable")]
        found, better, last, tries = search(distances(s, np.arange(n)) ** power, most, overflow**power)
        best = [int(s[b]) if b < len(s) else len(ships.lat) for b in found]
    ship = np.array([b if b < len(ships.lat) else -1 for b in best])
    far = np.full(n, np.inf)
    got = ship >= 0
    far[got] = metres(ships.lat[ship[got]], ships.lon[ship[got]], lat[got], lon[got])
    ship[far > reach_m] = -1
    return ship, far, better, last, tries
