"""Great-circle and image geometry as native expressions. Angles are degrees unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere of the distance functions, the ellipsoid of the pixel functions, metres a second in a knot.
EARTH_RADIUS_M = 6378e3
R_EQUATOR, R_POLES = 6378137.0, 6356752.0
KNOT_M_SEC = 0.5144


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    la1, la2 = F.radians(lat1), F.radians(lat2)
    s1, s2 = F.sin((la2 - la1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(s1 * s1 + F.cos(la1) * F.cos(la2) * s2 * s2)))


def cosine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Spherical law of cosines, clamped before the arc cosine."""
    la1, la2 = F.radians(lat1), F.radians(lat2)
    c = F.sin(la1) * F.sin(la2) + F.cos(la1) * F.cos(la2) * F.cos(F.radians(lon2 - lon1))
    return F.lit(EARTH_RADIUS_M) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2, in (-180, 180]."""
    la1, la2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(la2), F.cos(la1) * F.sin(la2) - F.sin(la1) * F.cos(la2) * F.cos(d)))


def knots_to_m_sec(knots: Column) -> Column:
    return knots * KNOT_M_SEC


def _radius_at(lat: Column) -> Column:
    c, s = F.cos(F.radians(lat)), F.sin(F.radians(lat))
    num = F.pow(R_EQUATOR**2 * c, F.lit(2)) + F.pow(R_POLES**2 * s, F.lit(2))
    return F.sqrt(num / (F.pow(R_EQUATOR * c, F.lit(2)) + F.pow(R_POLES * s, F.lit(2))))


def lat_lon_to_pixel(lat: Column, lon: Column, *, size=(1663, 771), lats=(25.7598, 25.7709), lons=(-80.1521, -80.1266), width_m: float) -> tuple[Column, Column]:
    """(x, y) pixels, y counted from the top; null outside the image."""
    inside = lat.between(*lats) & lon.between(*lons)
    x = _radius_at(lat) * F.sin(F.radians(lon - lons[0])) * (size[0] / width_m)
    y = size[1] - (lat - lats[0]) * (size[1] / (lats[1] - lats[0]))
    return F.when(inside, x.cast("int")), F.when(inside, y.cast("int"))


def pixel_to_lat_lon(x: Column, y: Column, *, size=(1663, 771), lats=(25.7598, 25.7709), lons=(-80.1521, -80.1266), width_m: float) -> tuple[Column, Column]:
    """(lat, lon) of a pixel; null outside the image."""
    inside = x.between(0, size[0]) & y.between(0, size[1])
    lat = (size[1] - y) / F.lit(size[1] / (lats[1] - lats[0])) + lats[0]
    lon = F.degrees(F.asin(x / F.lit(size[0] / width_m) / _radius_at(lat))) + lons[0]
    return F.when(inside, lat), F.when(inside, lon)


def affine(value: Column, from0: Column, from1: Column, to0: Column, to1: Column) -> Column:
    """Linear map of [from0, from1] onto [to0, to1], extrapolating."""
    return to0 + (value - from0) * (to1 - to0) / (from1 - from0)


def segment_distance_deg(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / length)))
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def ring_edges(ring: Column) -> Column:
    """Edges (a, b) of a ring given as array<struct<lon,lat>>; the ring closes itself."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))


def odd_crossings(x: Column, y: Column, edges: Column) -> Column:
    """Whether a ray from the point towards larger x meets an odd number of edges: the point is in their ring."""
    return F.aggregate(edges, F.lit(0), lambda n, e: n + _crosses(x, y, e["a"], e["b"])) % 2 == 1


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting in a ring given as array<struct<lon,lat>>."""
    return odd_crossings(x, y, ring_edges(ring))


def _crosses(x, y, a, b) -> Column:
    spans = (a["lat"] > y) != (b["lat"] > y)
    at = (b["lon"] - a["lon"]) * (y - a["lat"]) / F.when(spans, b["lat"] - a["lat"]).otherwise(1.0) + a["lon"]
    return F.when(spans & (x < at), 1).otherwise(0)


def clip_segment(x1: Column, y1: Column, x2: Column, y2: Column, *, xs: tuple[float, float], ys: tuple[float, float]) -> Column:
    """The part of a segment in a frame, as struct<x1, y1, x2, y2>; null if there is none.

    A segment enters and leaves the strip between two parallel edges at two shares of its length; a parallel one is in
    it wholly or not at all.
    """
    dx, dy = x2 - x1, y2 - y1
    begin, end, ok = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for p, d, (low, high) in ((x1, dx, xs), (y1, dy, ys)):
        a, b = F.try_divide(F.lit(low) - p, d), F.try_divide(F.lit(high) - p, d)
        begin.append(F.least(a, b))
        end.append(F.greatest(a, b))
        ok = ok & ((d != 0) | p.between(low, high))
    b, e = F.greatest(*begin), F.least(*end)
    part = F.struct((x1 + dx * b).alias("x1"), (y1 + dy * b).alias("y1"), (x1 + dx * e).alias("x2"), (y1 + dy * e).alias("y2"))
    return F.when(ok & (b <= e), part)


def hull(points: Column, lat0: Column, lon0: Column) -> Column:
    """The points (array<struct<latitude,longitude>>) that can be ends of their longest great-circle distance.

    Seen from the globe's centre, great circles are straight lines on the plane that touches it at (lat0, lon0), and within
    half a right angle of there the distance from a point is largest at a corner of the convex hull. The hull is built
    from left to right and back: of the chain so far stays what turns left towards the next point; such corners come
    first in a chain that turns left throughout, so their number is where it is cut. Points farther away: all of them.
    """
    a, b = F.radians(lat0), F.radians(lon0)

    def seen(p):
        lat, dlon = F.radians(p["latitude"]), F.radians(p["longitude"]) - b
        depth = F.sin(a) * F.sin(lat) + F.cos(a) * F.cos(lat) * F.cos(dlon)
        x, y = F.cos(lat) * F.sin(dlon) / depth, (F.cos(a) * F.sin(lat) - F.sin(a) * F.cos(lat) * F.cos(dlon)) / depth
        return F.struct(x.alias("x"), y.alias("y"), p["latitude"].alias("latitude"), p["longitude"].alias("longitude"), depth.alias("depth"))

    flat = F.array_sort(F.transform(F.array_distinct(F.transform(points, lambda p: F.struct(p["latitude"].alias("latitude"), p["longitude"].alias("longitude")))), seen))
    left = lambda o, p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (p["y"] - o["y"]) * (q["x"] - o["x"]) > 0

    def add(chain, q):
        corners = F.filter(F.transform(chain, lambda p, i: (i == 0) | left(F.get(chain, i - 1), p, q)), lambda ok: ok)
        return F.concat(F.slice(chain, 1, F.size(corners)), F.array(q))

    def chain(ordered):
        return F.aggregate(ordered, F.slice(ordered, 1, 0), add)

    bare = lambda c: F.transform(c, lambda p: F.struct(p["latitude"].alias("latitude"), p["longitude"].alias("longitude")))
    near = F.forall(flat, lambda p: p["depth"] > 0.7072)
    return F.when(near, bare(F.concat(chain(flat), chain(F.reverse(flat))))).otherwise(bare(flat))
