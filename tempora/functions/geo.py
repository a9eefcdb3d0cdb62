"""Column expressions on the sphere. A vector is a struct of x, y, z; angles are radians unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def vec(lat, lon) -> Column:
    """Unit vector of degrees."""
    lat, lon = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))


def lat_of(v: Column) -> Column:
    return F.degrees(F.asin(clamp(v["z"])))


def lon_of(v: Column) -> Column:
    return F.degrees(F.atan2(v["y"], v["x"]))


def clamp(c: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def scale(a: Column, k) -> Column:
    return F.struct((a["x"] * k).alias("x"), (a["y"] * k).alias("y"), (a["z"] * k).alias("z"))


def plus(a: Column, b: Column) -> Column:
    return F.struct((a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"), (a["z"] + b["z"]).alias("z"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; null where it has none."""
    n = norm(a)
    return F.when(n > 1e-15, scale(a, 1.0 / n))


def angle(a: Column, b: Column) -> Column:
    return F.acos(clamp(dot(a, b)))


def slerp(a: Column, b: Column, t) -> Column:
    """Great-circle interpolation: a where both coincide, null between antipodes."""
    w = angle(a, b)
    s = F.sin(w)
    return (F.when(w < 1e-12, a).when(s.between(-1e-12, 1e-12), F.lit(None))
            .otherwise(plus(scale(a, F.sin((1.0 - t) * w) / s), scale(b, F.sin(t * w) / s))))


def to_arc(p: Column, a: Column, b: Column) -> Column:
    """Angular distance of a point from the arc a-b."""
    n = unit(cross(a, b))
    foot_inside = (dot(cross(n, a), p) >= 0) & (dot(cross(b, n), p) >= 0)
    ends = F.least(angle(p, a), angle(p, b))
    return F.when(n.isNull(), ends).when(foot_inside, F.abs(F.asin(clamp(dot(p, n))))).otherwise(ends)


def triangle_area(p: Column, a: Column, b: Column) -> Column:
    """Signed area of a spherical triangle in steradians."""
    return 2.0 * F.atan2(dot(p, cross(a, b)), 1.0 + dot(a, b) + dot(b, p) + dot(p, a))


def arcs_cross(a: Column, b: Column, c: Column, d: Column, eps: float = 1e-12) -> Column:
    """Whether the arcs a-b and c-d cross in the interior of both."""
    n, m = cross(a, b), cross(c, d)
    part = lambda x, y: ((x > eps) & (y < -eps)) | ((x < -eps) & (y > eps))
    return part(dot(a, m), dot(b, m)) & part(dot(c, n), dot(d, n)) & (dot(plus(a, b), plus(c, d)) > 0)


def crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the great circles through a-b and c-d meet, on the side of a and b."""
    p = unit(cross(cross(a, b), cross(c, d)))
    return F.when(dot(p, plus(a, b)) >= 0, p).otherwise(scale(p, -1.0))


def bearing(frame: Column, p: Column) -> Column:
    """Direction of p in the tangent frame at ``frame``: east is 0, counter-clockwise."""
    east = F.struct((-frame["y"]).alias("x"), frame["x"].alias("y"), F.lit(0.0).alias("z"))
    north = cross(frame, east)
    return F.atan2(dot(north, p), dot(east, p))


def quantised(degrees) -> Column:
    """Units of 1e-7 degree."""
    return F.round(degrees * 1e7).cast("long")
