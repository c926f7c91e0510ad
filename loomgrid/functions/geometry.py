"""Planar and great-circle geometry, and kernels, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, total

# The two Earth radii in use, in kilometres.
EARTH_KM = 6371.0
EARTH_KM_CAUSAL = 6371.0088


def squared_euclidean(x1, y1, x2, y2) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return dx * dx + dy * dy


def euclidean(x1, y1, x2, y2) -> Column:
    return F.sqrt(squared_euclidean(x1, y1, x2, y2))


def bearing(x1, y1, x2, y2) -> tuple[Column, Column]:
    """Unit vector from point 1 to point 2; null where they coincide."""
    d = euclidean(x1, y1, x2, y2)
    unit = lambda a, b: F.when(d > 0, (col(b) - col(a)) / d)
    return unit(x1, x2), unit(y1, y2)


def route_features(x1, y1, x2, y2) -> dict[str, Column]:
    """Midpoint, length and bearing; all null for a route without length."""
    bx, by = bearing(x1, y1, x2, y2)
    d = euclidean(x1, y1, x2, y2)
    some = lambda c: F.when(d > 0, c)
    return {"mid_x": some((col(x1) + col(x2)) / 2), "mid_y": some((col(y1) + col(y2)) / 2), "distance": some(d), "bearing_x": bx, "bearing_y": by}


def anchor_distances(x, y, anchors: list[tuple[float, float]]) -> list[Column]:
    return [euclidean(x, y, F.lit(float(a)), F.lit(float(b))) for a, b in anchors]


def rbf_anchors(x, y, anchors: list[tuple[float, float]], scale: float) -> list[Column]:
    """exp(-d^2 / (2 scale^2)) to each anchor."""
    if scale <= 0:
        raise ValueError("the length scale must be positive")
    return [F.exp(squared_euclidean(x, y, F.lit(float(a)), F.lit(float(b))) / (-2.0 * scale * scale)) for a, b in anchors]


def local_frame(x, y, origin: tuple[float, float], axis: tuple[float, float]) -> tuple[Column, Column]:
    """Coordinates along and across an axis through the origin."""
    norm = (axis[0] ** 2 + axis[1] ** 2) ** 0.5
    if not norm:
        raise ValueError("the axis has no direction")
    east, north = axis[0] / norm, axis[1] / norm
    dx, dy = col(x) - float(origin[0]), col(y) - float(origin[1])
    return dx * east + dy * north, dy * east - dx * north


def initial_bearing(lat1, lng1, lat2, lng2) -> tuple[Column, Column]:
    """(east, north) of the great circle's start; null where it has no direction."""
    a, b, d = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lng2) - col(lng1))
    east = F.sin(d) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    norm = F.sqrt(east * east + north * north)
    return F.when(norm > 0, east / norm), F.when(norm > 0, north / norm)


def anisotropic(x, y, angle: float, scaling: float) -> tuple[Column, Column]:
    """Rotated by an angle in degrees, the second axis divided by ``scaling``."""
    t = F.radians(F.lit(float(angle)))
    return col(x) * F.cos(t) + col(y) * F.sin(t), (col(y) * F.cos(t) - col(x) * F.sin(t)) / float(scaling)


def anisotropic_distance(x1, y1, x2, y2, angle: float, scaling: float) -> Column:
    return euclidean(*anisotropic(x1, y1, angle, scaling), *anisotropic(x2, y2, angle, scaling))


def haversine(lat1, lng1, lat2, lng2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the radius' unit."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    dlat, dlng = b - a, F.radians(col(lng2)) - F.radians(col(lng1))
    s, t = F.sin(dlat / 2), F.sin(dlng / 2)
    return F.asin(F.sqrt(s * s + F.cos(a) * F.cos(b) * t * t)) * (2.0 * radius)


def lane_distance(left: list, right: list, mode: str = "forward", origin_weight: float = 1.0, destination_weight: float = 1.0) -> Column:
    """Distance of two lanes [x1, y1, x2, y2] by their endpoints, as given, swapped, or the lesser of both."""
    lane = lambda i, j: euclidean(left[0], left[1], right[i], right[i + 1]) * origin_weight + euclidean(left[2], left[3], right[j], right[j + 1]) * destination_weight
    forward, crossed = lane(0, 2), lane(2, 0)
    return {"forward": forward, "crossed": crossed, "minimum": F.least(forward, crossed)}[mode]


def in_polygon(x, y, ring: list[tuple[float, float]], tolerance: float = 1e-9) -> Column:
    """Even-odd test against a ring of vertices; points on an edge are inside."""
    px, py = col(x), col(y)
    crossings, on_edge = [], []
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ax, ay) == (bx, by):
            continue
        cross = (px - ax) * (by - ay) - (py - ay) * (bx - ax)
        inside_box = px.between(min(ax, bx) - tolerance, max(ax, bx) + tolerance) & py.between(min(ay, by) - tolerance, max(ay, by) + tolerance)
        on_edge.append((F.abs(cross) <= tolerance) & inside_box)
        if ay != by:
            at = (py - ay) * ((bx - ax) / (by - ay)) + ax
            crossings.append((((F.lit(ay) > py) != (F.lit(by) > py)) & (px < at)).cast("int"))
    return reduce(lambda a, b: a | b, on_edge, F.lit(False)) | (total([F.lit(0), *crossings]) % 2 == 1)


def overlay_kernel(distance, bandwidth: float, kind: str) -> Column:
    r = col(distance) / float(bandwidth)
    return {
        "none": F.lit(0.0),
        "gaussian": F.exp(r * r * -0.5),
        "bisquare": F.when(r >= 1, 0.0).otherwise((1 - r * r) * (1 - r * r)),
        "exponential": F.exp(-r),
    }[kind]


def fuzzy_left(distance, bandwidth: float, kind: str) -> Column:
    """The left branch's weight of a soft split; the right branch has the rest."""
    d = col(distance)
    hard = F.when(d <= 0, 1.0).otherwise(0.0)
    m = F.abs(d) / float(bandwidth)
    blend = {
        "linear": 1 - m,
        "gaussian": F.exp(m * m * (-0.5 * 2.5**2)),
        "exponential": F.exp(m * -3.0),
        "bisquare": F.pow(1 - m * m, F.lit(2.0)),
        "epanechnikov": 1 - m * m,
        "tricube": F.pow(1 - m * m * m, F.lit(3.0)),
    }[kind]
    return F.when(m >= 1, hard).otherwise(blend * 0.5 + (1 - blend) * hard)


def covariance(h, kind: str, scale: float, sill: float = 1.0) -> Column:
    r = col(h) / float(scale)
    z3, z5 = r * 3**0.5, r * 5**0.5
    return sill * {
        "exponential": F.exp(-r),
        "squared_exponential": F.exp(-(r * r)),
        "matern32": (1 + z3) * F.exp(-z3),
        "matern52": (1 + z5 + z5 * z5 / 3) * F.exp(-z5),
    }[kind]


def semivariogram(h, kind: str, scale: float, sill: float = 1.0, nugget: float = 0.0) -> Column:
    r = col(h) / float(scale)
    return nugget + sill * {
        "exponential": 1 - F.exp(-r),
        "gaussian": 1 - F.exp(-(r * r)),
        "spherical": F.when(r >= 1, 1.0).otherwise(r * 1.5 - r * r * r * 0.5),
        "linear": r,
    }[kind]
