"""Scalar geometry on longitude/latitude columns in degrees."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Mean Earth radius of the reference's graph and traffic parts, in metres.
RADIUS = 6371008.8
#: Radius used by its geocoder, privacy gate and clients.
RADIUS_ROUND = 6371000.0
#: Metres per degree of latitude used by its planar projections.
METRES_PER_DEGREE = 111320.0


def col(x: Column | str | float) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else (F.col(x) if isinstance(x, str) else x)


def haversine(lon1, lat1, lon2, lat2, radius: float = RADIUS) -> Column:
    """Great-circle metres; null if any coordinate is."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Initial great-circle bearing, 0 to 360 degrees."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_difference(a, b) -> Column:
    """Signed difference a - b in [-180, 180)."""
    return F.pmod(col(a) - col(b) + 540.0, F.lit(360.0)) - 180.0


def planar_offset(lon, lat, lon1, lat1, lon2, lat2, clamp: bool = True) -> tuple[Column, Column]:
    """(t, metres) of a point against a segment, planar about the segment's middle latitude.

    t is the place of the foot along the segment; a segment of no length counts as its first point.
    """
    lon, lat, lon1, lat1, lon2, lat2 = map(col, (lon, lat, lon1, lat1, lon2, lat2))
    kx = METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    ax, ay = (lon2 - lon1) * kx, (lat2 - lat1) * METRES_PER_DEGREE
    px, py = (lon - lon1) * kx, (lat - lat1) * METRES_PER_DEGREE
    square = ax * ax + ay * ay
    t = F.when(square == 0, F.lit(0.0)).otherwise((px * ax + py * ay) / F.when(square == 0, F.lit(1.0)).otherwise(square))
    if clamp:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return t, F.sqrt(F.pow(px - t * ax, 2) + F.pow(py - t * ay, 2))


def tile(lon, lat, zoom: int) -> tuple[Column, Column]:
    """Slippy tile (x, y) of a place at a zoom, clamped to the map."""
    lon, lat, n = col(lon), F.radians(col(lat)), 2**zoom
    x = ((lon + 180.0) / 360.0 * n).cast("int")
    y = ((1.0 - F.log(F.tan(lat) + F.sqrt(F.pow(F.tan(lat), 2) + 1.0)) / F.pi()) / 2.0 * n).cast("int")
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v))
    return clamp(x), clamp(y)


def tile_box(x, y, zoom: int) -> tuple[Column, Column, Column, Column]:
    """west, south, east, north of a tile."""
    n = float(2**zoom)
    north = lambda v: F.degrees(F.atan(F.sinh((0.5 - v / n) * 2.0 * F.pi())))
    x, y = col(x), col(y)
    return x / n * 360.0 - 180.0, north(y + 1), (x + 1) / n * 360.0 - 180.0, north(y)


def mercator(lon, lat) -> tuple[Column, Column]:
    """Web-Mercator place in units of the map's side, 0 to 1, y downwards."""
    s = F.sin(F.radians(col(lat)))
    return (col(lon) + 180.0) / 360.0, 0.5 - F.log((1.0 + s) / (1.0 - s)) / (4.0 * F.pi())


def wrap_longitude(lon) -> Column:
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


def clipped_share(x1, y1, x2, y2, west, south, east, north) -> Column:
    """Share of a segment that lies within a box (Liang-Barsky); 0 where it misses it."""
    x1, y1, x2, y2, west, south, east, north = map(col, (x1, y1, x2, y2, west, south, east, north))
    dx, dy = x2 - x1, y2 - y1
    inf = F.lit(1e18)

    def span(p: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        safe = F.when(d == 0, F.lit(1.0)).otherwise(d)
        a, b = (lo - p) / safe, (hi - p) / safe
        inside = (p >= lo) & (p <= hi)
        return F.when(d == 0, F.when(inside, -inf).otherwise(inf)).otherwise(F.least(a, b)), F.when(d == 0, F.when(inside, inf).otherwise(-inf)).otherwise(F.greatest(a, b))

    (xa, xb), (ya, yb) = span(x1, dx, west, east), span(y1, dy, south, north)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), xb, yb) - F.greatest(F.lit(0.0), xa, ya))
