"""Pairing of anonymous detections with known ships.

Detections and ships meet at one instant (see `meetings`), and what is asked of their pairs is answered there: a list of
them, a search, or which reports have any. A search is by instant because a ship that one cluster has used is gone for
the next.
"""

from __future__ import annotations

from itertools import islice, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrace.shipping import ship_package
from seatrace.functions.geo import EARTH_RADIUS_M, haversine_m
from seatrace.storage import connected_components, written

from . import meetings
from .clock import augment
from .filters import restore_types
from .rules import describe
from .space_time import clusters
from .spatial import _cells, _grid, _near_cells
from .tracks import micros

#: A fixed value: the distance of a pair that isn't allowed.
OVERFLOW_M = EARTH_RADIUS_M * 1e3


#: Thousands of distances between ships and detections that are computed at a time.
_SLICE_CELLS = meetings.AT_ONCE

#: Detections of an instant whose pairs are made at a time, and pairs in a batch.
_DETS, _PAIRS = 32, 200_000


def _at_once() -> int:
    return 1000 * max(1, _SLICE_CELLS)


def candidates(detections: DataFrame, reports: DataFrame, *, threshold_sec: float = 300.0, threshold_m: float = 1e4) -> DataFrame:
    """(det_id, timestamp, mmsi, dist_m, timestamp_nearest): ships whose interpolated place is within reach of a detection.

    detections: det_id, timestamp, latitude, longitude. A ship counts if its nearest report is within threshold_sec.
    Pairs are made where ships and detections of an instant meet and aren't shuffled.
    """
    return _candidates(detections, reports, threshold_sec, threshold_m)


def _candidates(detections: DataFrame, reports: DataFrame, threshold_sec: float, threshold_m: float, depth: int | None = None) -> DataFrame:
    """candidates, or as many of each detection's nearest as there are detections of its instant and depth more."""
    at_once, kinds = _at_once(), _kinds(detections, reports)

    def kernel(group: meetings.Group):
        made = ([], [], [], [])

        def out():
            k, mmsi, dist, nearest = (np.concatenate(c) for c in made)
            return {"det_id": group.dets["det_id"].take(pa.array(k)), "us": group.t[k], "mmsi": mmsi, "dist_m": dist, "nearest": nearest}

        held = 0
        for b, e, t in group.instants():
            ships = group.ships(t, e - b)
            for i in range(b, e if len(ships.lat) else b, _DETS):
                k, s, m = ships.within(group.lat[i : min(e, i + _DETS)], group.lon[i : min(e, i + _DETS)], threshold_m, at_once)
                if depth is not None:
                    order = np.lexsort((ships.mmsi[s], m, k))
                    k, s, m = k[order], s[order], m[order]
                    near = np.arange(len(k)) - np.searchsorted(k, k) < e - b + (depth if e - b > 1 else 0)
                    k, s, m = k[near], s[near], m[near]
                for c, v in zip(made, (k + i, ships.mmsi[s], m, ships.nearest[s]), strict=True):
                    c.append(v)
                held += len(k)
                if held >= _PAIRS:
                    yield out()
                    made, held = ([], [], [], []), 0
        if held:
            yield out()

    found = meetings.met(detections, reports, threshold_sec, kernel, f"det_id {kinds['det_id']}, us long, mmsi {kinds['mmsi']}, dist_m double, nearest long")
    return found.select("det_id", _time("us", detections).alias("timestamp"), "mmsi", "dist_m", _time("nearest").alias("timestamp_nearest"))


def _kinds(detections: DataFrame, reports: DataFrame) -> dict[str, str]:
    return {"det_id": detections.schema["det_id"].dataType.simpleString(), "mmsi": reports.schema["mmsi"].dataType.simpleString()}


def _time(us: str, like: DataFrame | None = None):
    return F.timestamp_micros(us).cast("timestamp_ntz" if like is None else like.schema["timestamp"].dataType)


def near_detections(reports: DataFrame, detections: DataFrame, *, threshold_sec: float, threshold_m: float) -> DataFrame:
    """Reports that have any detection near in time and space (a semi join on time buckets)."""
    width, grid = int(threshold_sec * 1e6) + 1, _grid(threshold_m)
    bucket = lambda c: F.floor(micros(c) / width)
    dets = detections.select(micros("timestamp").alias("du"), F.col("latitude").alias("dlat"), F.col("longitude").alias("dlon"), F.explode(F.sequence(bucket("timestamp") - 1, bucket("timestamp") + 1)).alias("__b"))
    near = _near_cells(dets, "dlat", "dlon", grid)
    placed = reports.withColumns({"__b": bucket("timestamp"), **_cells(F.col("latitude"), F.col("longitude"), grid)})
    same = [F.col(f"r.{c}") == F.col(f"d.{c}") for c in ("__b", "__row", "__col")]
    close = (F.abs(micros("timestamp") - F.col("du")) <= threshold_sec * 1e6) & (haversine_m(F.col("latitude"), F.col("longitude"), F.col("dlat"), F.col("dlon")) <= threshold_m)
    return placed.alias("r").join(near.alias("d"), [*same, close], "left_semi").drop("__b", "__row", "__col")


def _search(d: np.ndarray, max_permutations: int, overflow: float = OVERFLOW_M) -> tuple[list[int], int, int, int]:
    """(ship row of each detection, improvements, last improvement, tries) for a ships x detections distance matrix.

    Ships are put in greedy order: the least distances first, each ship and detection once, then the other ships by
    their nearest detection. Of these a bounded number is permuted in lexicographic order; the greedy order is the first.
    """
    ships, dets = d.shape
    if ships < dets:
        d = np.vstack([d, np.full((dets - ships, dets), overflow)])
    flat = np.argsort(d, axis=None, kind="stable")  # by distance, ship, detection
    first: dict[int, int] = {}
    used: set[int] = set()
    for at in flat.tolist():
        s, k = divmod(at, dets)
        if k not in first and s not in used:
            first[k] = s
            used.add(s)
            if len(first) == dets:
                break
    order = [first[k] for k in range(dets)]
    depth = dets
    if dets > 1:
        tries = lambda n: np.prod(np.arange(n - dets + 1, n + 1, dtype=float))
        while depth < len(d) and tries(depth + 1) < max_permutations:
            depth += 1
    if depth > dets:
        order += [s for s in np.argsort(d.min(axis=1), kind="stable").tolist() if s not in used][: depth - dets]
    perms = np.array(list(islice(permutations(order, dets), max(1, int(max_permutations)))))
    means = d[perms, np.arange(dets)].mean(axis=1)
    at, best_mean, better, count = 0, means[0], 0, len(perms) - 1
    for k, mean in enumerate(means.tolist()):
        if mean < best_mean - 1e-12:
            at, best_mean, better = k, mean, better + 1
    best, last = perms[at].tolist(), at
    return best, better, last, count + 1


_FOUND = "det_id long, mmsi long, dist_m double, nearest long, cluster long, greedy_count long, last_improvement long, last_iter long"


def _with_candidates(detections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Detections with their candidates as arrays: ships, dists, and times of the ships' nearest reports."""
    held = pairs.groupBy("det_id").agg(F.array_sort(F.collect_list(F.struct("mmsi", "dist_m", micros("timestamp_nearest").alias("us")))).alias("near"))
    rows = detections.select("det_id", micros("timestamp").alias("us"), F.radians("latitude").alias("lat"), F.radians("longitude").alias("lon")).join(held, "det_id", "left")
    return rows.select("det_id", "us", "lat", "lon", F.col("near.mmsi").alias("ships"), F.col("near.dist_m").alias("dists"), F.col("near.us").alias("reported"))


def _assigned(pdf: pd.DataFrame, label: np.ndarray, max_permutations: int, power: int = 1) -> pd.DataFrame:
    """One ship at most for each row, cluster by cluster; what a cluster takes is gone for the next."""
    out = {c: [None] * len(pdf) for c in ("mmsi", "dist_m", "nearest", "greedy_count", "last_improvement", "last_iter")}
    taken: set[int] = set()
    for c in sorted(set(label.tolist())):
        own = np.flatnonzero(label == c)
        near = [{} if pdf["ships"][i] is None else {s: (x, t) for s, x, t in zip(pdf["ships"][i], pdf["dists"][i], pdf["reported"][i], strict=True) if s not in taken} for i in own]
        ships = sorted({s for n in near for s in n})
        if not ships:
            continue
        d = np.array([[n[s][0] if s in n else OVERFLOW_M for n in near] for s in ships])
        best, better, last, count = _search(d**power, max_permutations, OVERFLOW_M**power)
        for k, (i, s) in enumerate(zip(own, best, strict=True)):
            if s < len(ships) and d[s, k] < OVERFLOW_M:
                out["mmsi"][i], out["dist_m"][i], out["nearest"][i] = int(ships[s]), float(d[s, k]), int(near[k][ships[s]][1])
                taken.add(ships[s])
            out["greedy_count"][i], out["last_improvement"][i], out["last_iter"][i] = better, last, count
    made = pd.DataFrame({"det_id": pdf["det_id"], "cluster": label})
    for c, v in out.items():
        made[c] = pd.array(v, dtype="Float64" if c == "dist_m" else "Int64")
    return made[[c.split()[0] for c in _FOUND.split(", ")]]


def _described_pairs(found: DataFrame, detections: DataFrame) -> DataFrame:
    stamp = F.timestamp_micros("nearest").cast("timestamp_ntz").alias("timestamp_nearest")
    return found.join(detections.select("det_id", "timestamp"), "det_id").select("det_id", "timestamp", "mmsi", "dist_m", stamp, "cluster", "greedy_count", "last_improvement", "last_iter")


def infer_identity(detections: DataFrame, reports: DataFrame, *, threshold_sec: float = 300.0, threshold_m: float = 1e4, max_permutations: int = 1000, clustering_eps_m: float | None = None) -> DataFrame:
    """Per detection: det_id, timestamp, mmsi, dist_m and timestamp_nearest (null without a pair), cluster, greedy_count, last_improvement, last_iter.

    timestamp_nearest is the time of the ship's report that is nearest to the detection: the key back to the reports.
    """
    eps = 2 * threshold_m if clustering_eps_m is None else clustering_eps_m
    return _paired(detections, reports, [(threshold_sec, threshold_m, max_permutations, eps)]).drop("k")


def _enough_candidates(detections: DataFrame, reports: DataFrame, threshold_sec: float, threshold_m: float, max_permutations: int) -> DataFrame:
    """As many of each detection's nearest candidates as the search can use, or all that it has.

    Of an instant with n detections a search gives one of its n nearest ships to each, and beyond these tries the ships
    that are nearest to any, as many as the permutations reach; so no more than both together are used.
    """
    depth = 0
    while max_permutations > 1 and (depth + 1) * depth < max_permutations:
        depth += 1
    return _candidates(detections, reports, threshold_sec, threshold_m, depth)


def _paired(detections: DataFrame, reports: DataFrame, runs: list[tuple[float, float, int, float]]) -> DataFrame:
    """Each run (threshold_sec, threshold_m, max_permutations, eps of clusters) of every instant, numbered by k. What a
    cluster takes is gone for the next one of the instant and run."""
    at_once = _at_once()

    def kernel(group: meetings.Group):
        names = [c.split()[0] for c in _FOUND.split(", ")][1:]
        for b, e, t in group.instants():
            ships, lat, lon = group.ships(t, e - b), group.lat[b:e], group.lon[b:e]
            label = {eps: meetings.labels_of(np.radians(lat), np.radians(lon), eps) for *_, eps in runs}
            for number, (sec, reach, most, eps) in enumerate(runs):
                out = {c: [None] * (e - b) for c in names} | {"cluster": label[eps].tolist()}
                left = ships.where(ships.late < sec * 1e6)
                for c in range(int(label[eps].max(initial=-1)) + 1):
                    own = np.flatnonzero(label[eps] == c)
                    got = meetings.settle(lat[own], lon[own], left, reach, most, at_once, _search, OVERFLOW_M)
                    if got is not None:
                        _put(out, own, left, *got)
                        left = left.where(~np.isin(np.arange(len(left.lat)), got[0])) if len(own) < e - b else left
                yield out | {"det_id": group.dets["det_id"].slice(b, e - b), "us": group.dets["us"].slice(b, e - b), "k": [number] * (e - b)}

    found = meetings.met(detections, reports, max(r[0] for r in runs), _batched(kernel), _FOUND + ", us long, k int")
    return found.select("det_id", _time("us", detections).alias("timestamp"), "mmsi", "dist_m", _time("nearest").alias("timestamp_nearest"), "cluster", "greedy_count", "last_improvement", "last_iter", "k")


def _put(out: dict, own: np.ndarray, ships: meetings.Ships, ship, dist, better: int, last: int, tries: int) -> None:
    for i, s, m in zip(own.tolist(), ship.tolist(), dist.tolist(), strict=True):
        if s >= 0:
            out["mmsi"][i], out["dist_m"][i], out["nearest"][i] = int(ships.mmsi[s]), m, int(ships.nearest[s])
        out["greedy_count"][i], out["last_improvement"][i], out["last_iter"][i] = better, last, tries


def _batched(kernel, rows: int = 4096):
    """kernel with the instants of a group in fewer batches."""

    def joined(group: meetings.Group):
        held: dict = {}
        for got in kernel(group):
            for c, v in got.items():
                held.setdefault(c, []).extend(v.to_pylist() if isinstance(v, (pa.Array, pa.ChunkedArray)) else v)
            if len(held["det_id"]) >= rows:
                yield held
                held = {}
        if held:
            yield held

    return joined


def infer_space_time(detections: DataFrame, reports: DataFrame, *, threshold_sec: float = 1800.0, threshold_m: float = 1e4, ns_per_m: float = 100.0, min_points: int = 1, max_permutations: int = 1000) -> DataFrame:
    """The older objective: detections of a cluster in space and time share their ships, and squared distances are least.

    Clusters are those of `space_time.clusters`; detections in no cluster (min_points above 1) stand alone. The columns
    are those of infer_identity; cluster is the smallest det_id of the cluster. Inside a cluster, detections that no chain
    of common candidates connects can't take each other's ships, so each such group is a search of its own; the least sum
    is the same, and a large cluster isn't one task.
    """
    cluster = clusters(detections, eps_m=threshold_m, ns_per_m=ns_per_m, min_points=min_points).select("det_id", F.coalesce("cluster", "det_id").alias("__cluster"))
    named = written(detections.select("det_id", "timestamp", "latitude", "longitude").join(cluster, "det_id"), "clustered")
    several = named.groupBy("__cluster").agg(F.count_distinct("timestamp").alias("n")).where("n > 1").select("__cluster")
    apart = _of_one_instant(named.join(several, "__cluster", "left_anti"), reports, threshold_sec, threshold_m, max_permutations)
    return apart.unionByName(_over_time(named.join(several, "__cluster", "left_semi"), reports, threshold_sec, threshold_m, max_permutations))


def _of_one_instant(named: DataFrame, reports: DataFrame, threshold_sec: float, threshold_m: float, max_permutations: int) -> DataFrame:
    """infer_space_time for clusters (__cluster) whose detections are of one instant: settled where they meet the ships."""
    at_once = _at_once()

    def kernel(group: meetings.Group):
        names = [c.split()[0] for c in _FOUND.split(", ")][1:]
        of = group.dets["__cluster"].to_numpy()
        for b, e, t in group.instants():
            ships, lat, lon = group.ships(t, e - b), group.lat[b:e], group.lon[b:e]
            out = {c: [None] * (e - b) for c in names} | {"cluster": of[b:e].tolist()}
            for own in _sharing(of[b:e], lat, lon, ships, threshold_m, at_once):
                got = meetings.settle(lat[own], lon[own], ships, threshold_m, max_permutations, at_once, _search, OVERFLOW_M, power=2)
                if got is not None:
                    _put(out, own, ships, *got)
            yield out | {"det_id": group.dets["det_id"].slice(b, e - b), "us": group.dets["us"].slice(b, e - b)}

    found = meetings.met(named, reports, threshold_sec, _batched(kernel), _FOUND + ", us long", extra=["__cluster"])
    return found.select("det_id", _time("us", named).alias("timestamp"), "mmsi", "dist_m", _time("nearest").alias("timestamp_nearest"), "cluster", "greedy_count", "last_improvement", "last_iter")


def _sharing(of: np.ndarray, lat: np.ndarray, lon: np.ndarray, ships: meetings.Ships, reach_m: float, at_once: int) -> list[np.ndarray]:
    """The detections of each cluster in groups that chains of common candidates connect."""
    groups = []
    for c in np.unique(of).tolist():
        own = np.flatnonzero(of == c)
        root = list(range(len(own)))
        if len(own) > 1:
            first = np.full(len(ships.lat), -1)  # of each ship the first detection that it is near
            for i in range(0, len(own), _DETS):
                part = own[i : i + _DETS]
                k, s, _ = ships.within(lat[part], lon[part], reach_m, at_once)
                k = k + i
                order = np.lexsort((k, s))
                k, s = k[order], s[order]
                new = first[s] < 0
                at, begin = np.unique(s[new], return_index=True)
                first[at] = k[new][begin]
                links = np.unique(np.column_stack([k, first[s]]), axis=0)
                for a, b in links.tolist():
                    while root[a] != a:
                        a = root[a]
                    while root[b] != b:
                        b = root[b]
                    root[max(a, b)] = min(a, b)
        for i in range(len(own)):
            root[i] = root[root[i]]
        tops = np.array(root)
        groups += [own[tops == r] for r in np.unique(tops).tolist()]
    return groups


def _over_time(detections: DataFrame, reports: DataFrame, threshold_sec: float, threshold_m: float, max_permutations: int) -> DataFrame:
    """infer_space_time for clusters (__cluster) over several instants: all their candidates are gathered by cluster."""
    pairs = written(candidates(detections, reports, threshold_sec=threshold_sec, threshold_m=threshold_m), "pair-candidates")
    cluster = detections.select("det_id", "__cluster")
    # A node for each detection, and one for each ship of a cluster, named after the first detection that it is near.
    of_ship = pairs.join(cluster, "det_id").groupBy("__cluster", "mmsi").agg(F.min("det_id").alias("first"))
    links = pairs.join(cluster, "det_id").join(of_ship, ["__cluster", "mmsi"]).select(F.col("det_id").alias("a"), F.col("first").alias("b"))
    group = connected_components(links, "pair-groups").select(F.col("node").alias("det_id"), F.col("component").alias("__group"))
    rows = _with_candidates(detections, pairs).join(cluster, "det_id").join(group, "det_id", "left").withColumn("__group", F.coalesce("__group", "det_id"))

    ship_package(detections.sparkSession)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("det_id").reset_index(drop=True)
        return _assigned(pdf, pdf["__cluster"].to_numpy(), max_permutations, power=2)

    return _described_pairs(rows.groupBy("__cluster", "__group").applyInPandas(find, _FOUND), detections)


def sweep(detections: DataFrame, reports: DataFrame, thresholds_sec, thresholds_m, max_permutations) -> DataFrame:
    """infer_identity for every combination of parameters, with the parameters as columns; all where an instant's ships and
    detections meet once."""
    grid = [(float(s), float(m), int(p)) for s in thresholds_sec for m in thresholds_m for p in max_permutations]
    if not grid:
        raise ValueError("no parameters")
    values = F.get(F.array(*[F.struct(F.lit(s).alias("threshold_sec"), F.lit(m).alias("threshold_m"), F.lit(p).alias("max_permutations")) for s, m, p in grid]), F.col("k"))
    return _paired(detections, reports, [(s, m, p, 2 * m) for s, m, p in grid]).withColumn("__p", values).select("*", "__p.*").drop("k", "__p")


def quality(paired: DataFrame, reports: DataFrame | None = None, by=()) -> DataFrame:
    """Success rate, greedy counts, and distances (std of the population) of a pairing.

    With reports also how far in time the ship's nearest report is from the detection (std of the sample).
    """
    measures = [
        F.avg(F.col("mmsi").isNotNull().cast("double")).alias("success_rate"),
        F.sum("greedy_count").alias("sum_greedy_count"),
        F.max("greedy_count").alias("max_greedy_count"),
        F.stddev_pop("dist_m").alias("std_dist_m"),
        F.avg("dist_m").alias("mean_dist_m"),
        F.max("dist_m").alias("max_dist_m"),
    ]
    if reports is not None:
        off = F.abs(micros("timestamp_nearest") - micros("timestamp")) / 1e6
        paired = augment(paired.drop("timestamp_nearest"), reports, []).withColumn("off_sec", off)
        measures += [F.stddev_samp("off_sec").alias("std_off_sec"), F.max("off_sec").alias("max_off_sec")]
    return paired.groupBy(*by).agg(*measures)


def side_by_side(measures: DataFrame, parameter: str, left, right, by=(), *, truth: int | None = None) -> DataFrame:
    """Two runs' measures in one row for each `by`: columns end in _left and _right; truth: detections there are to find."""
    names = [c for c in measures.columns if c not in (parameter, *by)]
    one = lambda c, v: F.max(F.when(F.col(parameter) == v, F.col(c)))
    out = measures.groupBy(*by).agg(*[one(c, v).alias(f"{c}_{side}") for c in names for side, v in (("left", left), ("right", right))])
    if truth is not None:
        out = out.withColumns({f"paired_{side}": F.col(f"success_rate_{side}") * truth for side in ("left", "right")})
    return out


def described(paired: DataFrame, reports: DataFrame, table: DataFrame, columns=("vessel_type", "length")) -> DataFrame:
    """paired with the ship's columns at that time and the label of its type."""
    out = augment(paired.drop("timestamp_nearest"), reports, list(columns)).drop("timestamp_previous", "timestamp_next")
    return describe(restore_types(out, reports.select(*columns)), table, "vessel_type", "type_label")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """det_id with both runs' mmsi and which run has a pair: both, left_only, right_only, neither or differs."""
    x, y = a.select("det_id", F.col("mmsi").alias("mmsi_a")), b.select("det_id", F.col("mmsi").alias("mmsi_b"))
    kind = F.when(F.col("mmsi_a") == F.col("mmsi_b"), "both").when(F.col("mmsi_a").isNotNull() & F.col("mmsi_b").isNotNull(), "differs").when(F.col("mmsi_a").isNotNull(), "left_only").when(F.col("mmsi_b").isNotNull(), "right_only").otherwise("neither")
    return x.join(y, "det_id", "full_outer").withColumn("kind", kind)


def merge_reports(reports: DataFrame, paired: DataFrame, how: str) -> DataFrame:
    """Reports joined with pairs on ship and the time of its report nearest to the detection; how: left, right, inner or outer.

    det_timestamp is the detection's own time. right and outer also have the detections without a ship, with no report.
    """
    p = paired.select("mmsi", F.col("timestamp_nearest").alias("timestamp"), "det_id", F.col("timestamp").alias("det_timestamp"), "dist_m")
    out = reports.join(p.where("mmsi is not null"), ["mmsi", "timestamp"], {"outer": "full_outer"}.get(how, how))
    if how in ("right", "outer"):
        out = out.unionByName(p.where("mmsi is null"), allowMissingColumns=True)
    return out


def merge_candidates(detections: DataFrame, reports: DataFrame, columns, how: str, *, threshold_sec: float, threshold_m: float) -> DataFrame:
    """merge_reports of the reports' columns with all candidates, without a row of them being shuffled.

    Ships' intervals carry the columns of their reports to where they meet the detections. For left and outer, reports
    that no detection is near are those that aren't met in a second pass, which makes a row for each report at most and
    group of hours.
    """
    at_once, kinds, columns = _at_once(), _kinds(detections, reports), list(columns)
    alone = how in ("right", "outer")
    types = {c: reports.schema[c].dataType.simpleString() for c in columns}

    def kernel(group: meetings.Group):
        n = len(group.t0)
        both = pa.chunked_array([*group.held["__own"].chunks, *group.held["__next"].chunks], group.held["__own"].type).combine_chunks()
        size = pc.fill_null(pc.list_value_length(both), 0).to_numpy(zero_copy_only=False)
        start, flat = np.cumsum(size) - size, both.flatten()
        values = {c: flat.field(i) for i, c in enumerate(columns)}
        for b, e, t in group.instants():
            ships = group.ships(t, e - b)
            at = ships.side * n + ships.interval
            for i in range(b, e, _DETS):
                k, s, m = ships.within(group.lat[i : min(e, i + _DETS)], group.lon[i : min(e, i + _DETS)], threshold_m, at_once)
                none = np.setdiff1d(np.arange(min(e, i + _DETS) - i), k) if alone else k[:0]
                times = size[at[s]]
                row = np.repeat(np.arange(len(k)), times)
                of = start[at[s]][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                k, s, m = k[row], s[row], m[row]
                blank = lambda v, of_type, none=none: pa.concat_arrays([pa.array(v, type=of_type), pa.nulls(len(none), of_type)])
                made = {"mmsi": blank(ships.mmsi[s], group.held["mmsi"].type), "nearest": blank(ships.nearest[s], pa.int64()), "dist_m": blank(m, pa.float64())}
                made |= {c: pa.concat_arrays([v.take(pa.array(of)), pa.nulls(len(none), v.type)]) for c, v in values.items()}
                dets = pa.array(np.concatenate([k, none]) + i)
                if len(dets):
                    yield made | {"det_id": group.dets["det_id"].take(dets), "us": group.dets["us"].take(dets)}

    schema = ", ".join([f"mmsi {kinds['mmsi']}, nearest long", *(f"`{c}` {k}" for c, k in types.items()), f"det_id {kinds['det_id']}, us long, dist_m double"])
    found = meetings.met(detections, reports, threshold_sec, _gathered(kernel), schema, columns=columns)
    out = found.select("mmsi", _time("nearest", reports).alias("timestamp"), *columns, "det_id", _time("us", detections).alias("det_timestamp"), "dist_m")
    if how in ("left", "outer"):
        near = _met_reports(detections, reports, threshold_sec, threshold_m)
        rest = reports.join(near, ["mmsi", "timestamp"], "left_anti").select("mmsi", "timestamp", *columns)
        out = out.unionByName(rest, allowMissingColumns=True)
    return out


def _gathered(kernel):
    """kernel with the columns (arrow) of several instants in a batch."""

    def joined(group: meetings.Group):
        held, n = [], 0
        for got in kernel(group):
            held.append({c: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for c, v in got.items()})
            n += len(held[-1]["us"])
            if n >= _PAIRS:
                yield {c: pa.concat_arrays([h[c] for h in held]) for c in held[0]}
                held, n = [], 0
        if held:
            yield {c: pa.concat_arrays([h[c] for h in held]) for c in held[0]}

    return joined


def _met_reports(detections: DataFrame, reports: DataFrame, threshold_sec: float, threshold_m: float) -> DataFrame:
    """(mmsi, timestamp) of reports that are a candidate's nearest one; some of them more than once."""
    at_once, kinds = _at_once(), _kinds(detections, reports)

    def kernel(group: meetings.Group):
        seen = np.zeros((2, len(group.t0)), bool)
        for b, e, t in group.instants():
            ships = group.ships(t, e - b)
            for i in range(b, e, _DETS):
                ships = ships.where(~seen[ships.side, ships.interval])
                s = np.unique(ships.within(group.lat[i : min(e, i + _DETS)], group.lon[i : min(e, i + _DETS)], threshold_m, at_once)[1])
                seen[ships.side[s], ships.interval[s]] = True
        first, second = (np.flatnonzero(x) for x in seen)
        yield {"mmsi": np.concatenate([group.mmsi[first], group.mmsi[second]]), "us": np.concatenate([group.t0[first], group.t1[second]])}

    found = meetings.met(detections, reports, threshold_sec, kernel, f"mmsi {kinds['mmsi']}, us long")
    return found.select("mmsi", _time("us", reports).alias("timestamp"))
