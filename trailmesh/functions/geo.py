"""Geometry, time and rounding as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EARTH_RADIUS, METRES_PER_DEGREE


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def round_half_up(x) -> Column:
    """Halves go towards plus infinity."""
    return F.floor(c(x) + 0.5)


def round_half_even(x, digits: int = 0) -> Column:
    return F.bround(c(x), digits)


def _haversine(lon1, lat1, lon2, lat2) -> Column:
    dlat, dlon = F.radians(c(lat2) - c(lat1)), F.radians(c(lon2) - c(lon1))
    return F.pow(F.sin(dlat / 2), 2.0) + F.cos(F.radians(c(lat1))) * F.cos(F.radians(c(lat2))) * F.pow(F.sin(dlon / 2), 2.0)


def straight_line_km(lon1, lat1, lon2, lat2) -> Column:
    return F.lit(12742.0176) * F.asin(F.sqrt(F.least(F.lit(1.0), _haversine(lon1, lat1, lon2, lat2))))


def proximity_cm(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in whole centimetres; the formula itself wraps longitudes."""
    return round_half_up(F.lit(2 * EARTH_RADIUS * 100) * F.asin(F.sqrt(F.least(F.lit(1.0), _haversine(lon1, lat1, lon2, lat2)))))


def planar_bound_cm(dx, dy, most_lat) -> Column:
    """Whole centimetres, at least, between points in 1e-5 degrees; most_lat: greatest |y| of the graph."""
    return F.floor(F.hypot(c(dx) * F.cos(F.radians(c(most_lat) / 1e5)), c(dy).cast("double")) * (METRES_PER_DEGREE / 1000)).cast("long")


def snap_metres(lon1, lat1, lon2, lat2) -> Column:
    return F.hypot((c(lon2) - c(lon1)) * F.cos(F.radians(c(lat1))), c(lat2) - c(lat1)) * METRES_PER_DEGREE


def longitude_offset(lon, centre, wrap: bool = True) -> Column:
    d = c(lon) - c(centre)
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d) if wrap else d


def normalise_longitude(lon) -> Column:
    return F.pmod(c(lon) + 180, F.lit(360.0)) - 180


def project(lon, lat, centre_lon, centre_lat, ref_lat, scale, wrap: bool = False) -> tuple[Column, Column]:
    k = METRES_PER_DEGREE / c(scale)
    return longitude_offset(lon, centre_lon, wrap) * F.cos(F.radians(c(ref_lat))) * k, (c(lat) - c(centre_lat)) * k


def unproject(px, py, centre_lon, centre_lat, ref_lat, scale) -> tuple[Column, Column]:
    k = METRES_PER_DEGREE / c(scale)
    return normalise_longitude(c(px) / k / F.cos(F.radians(c(ref_lat))) + c(centre_lon)), c(py) / k + c(centre_lat)


def replay_seconds(km) -> Column:
    return F.least(F.lit(65.0), F.greatest(F.lit(25.0), F.lit(30.0) * F.sqrt(c(km) / 100)))


def travel_ms(cm, kph) -> Column:
    """Whole milliseconds, at least 1; a speed that isn't positive raises."""
    kph = c(kph)
    checked = F.when(kph > 0, kph).otherwise(F.raise_error(F.lit("speed must be positive")).cast("int"))
    return F.greatest(F.lit(1).cast("long"), round_half_up(c(cm) * 36 / checked).cast("long"))


def goal_proximity(h_here, h_start) -> Column:
    """0 to 255, higher nearer to the goal."""
    return round_half_up(255 * (1 - F.least(F.lit(1.0), c(h_here) / F.greatest(F.lit(1.0), c(h_start).cast("double"))))).cast("int")


def ease(t) -> Column:
    return c(t) * c(t) * (3 - 2 * c(t))


def settle_quadratic(t) -> Column:
    return 1 - (1 - c(t)) * (1 - c(t))


def log_zoom(a, b, t) -> Column:
    return F.exp(F.log(c(a)) + (F.log(c(b)) - F.log(c(a))) * c(t))


def point_segment_squared(px, py, ax, ay, bx, by) -> Column:
    """Squared distance of a point from a segment, clamped to its ends."""
    dx, dy = c(bx) - c(ax), c(by) - c(ay)
    long = dx * dx + dy * dy
    t = F.when(long == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((c(px) - c(ax)) * dx + (c(py) - c(ay)) * dy) / F.when(long == 0, 1.0).otherwise(long))))
    return F.pow(c(px) - (c(ax) + t * dx), 2.0) + F.pow(c(py) - (c(ay) + t * dy), 2.0)


def ring_area(ring) -> Column:
    """Shoelace area of a closed ring array<struct<x, y>>, in its own units."""
    ring = c(ring)
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)) / 2


def inside_ring(px, py, ring) -> Column:
    """Even-odd test of a point against a closed ring array<struct<x, y>>."""
    ring, px, py = c(ring), c(px), c(py)
    crossings = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"]))
    return F.size(F.filter(crossings, lambda x: x)) % 2 == 1


def valid_ring(ring) -> Column:
    """At least four points, closed, finite and in range; null isn't valid."""
    ring = c(ring)
    good = F.forall(ring, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) <= 180) & (F.abs(p["y"]) <= 90))
    return F.coalesce((F.size(ring) >= 4) & good & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.lit(False))


def distance_band(km, minimum=30.0, regional=100.0, interregional=220.0) -> Column:
    return F.when(c(km) < minimum, None).when(c(km) < regional, "regional").when(c(km) < interregional, "interregional").otherwise("national")


def route_window(seconds) -> Column:
    """Share of a replay that its route drawing takes: at most 3 s or a tenth."""
    return F.least(F.lit(3.0), c(seconds) * 0.1) / c(seconds)


def buffer_bytes(nodes, edges, arcs, events) -> Column:
    return 16 * c(nodes) + 14 * c(edges) + 8 * c(arcs) + 4 * c(events)
