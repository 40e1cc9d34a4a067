"""Position of the sun and the shade of a street, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.geo import angle_difference


def with_sun(rows: DataFrame, lon: Column, lat: Column, epoch_ms: Column) -> DataFrame:
    """rows with altitude (with refraction) and azimuth in degrees at a place and time, by the public NOAA equations.

    Step by step in columns of their own: as one expression every step would stand in the next several times.
    """
    c, rad, deg, unit = F.col, F.radians, F.degrees, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    anomaly, mean_lon, e = c("_anomaly"), c("_mean_lon"), c("_eccentricity")
    t, l2, m, y = c("_t"), rad(2 * mean_lon), rad(anomaly), c("_y")
    altitude, tan, turn = c("_altitude"), F.tan(rad(c("_altitude"))), c("_turn")
    arc = F.when(altitude > 5.0, 58.1 / tan - 0.07 / F.pow(tan, 3) + 0.000086 / F.pow(tan, 5)).when(altitude > -0.575, 1_735.0 + altitude * (-518.2 + altitude * (103.4 + altitude * (-12.79 + altitude * 0.711)))).otherwise(-20.772 / tan)
    centre = F.sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + F.sin(2 * m) * (0.019993 - 0.000101 * t) + F.sin(3 * m) * 0.000289
    equation = y * F.sin(l2) - 2 * e * F.sin(m) + 4 * e * y * F.sin(m) * F.cos(l2) - 0.5 * y * y * F.sin(2 * l2) - 1.25 * e * e * F.sin(2 * m)
    steps = [
        {"_lon": lon, "_lat": rad(lat), "_ms": epoch_ms},
        {"_t": (c("_ms") / 86_400_000.0 + 2_440_587.5 - 2_451_545.0) / 36_525.0},
        {"_mean_lon": F.pmod(280.46646 + t * (36_000.76983 + t * 0.0003032), F.lit(360.0)), "_anomaly": 357.52911 + t * (35_999.05029 - 0.0001537 * t), "_eccentricity": 0.016708634 - t * (0.000042037 + 0.0000001267 * t), "_node": rad(125.04 - 1_934.136 * t)},
        {"_apparent": rad(mean_lon + centre - 0.00569 - 0.00478 * F.sin(c("_node"))), "_obliquity": 23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0 + 0.00256 * F.cos(c("_node"))},
        {"_declination": F.asin(F.sin(rad(c("_obliquity"))) * F.sin(c("_apparent"))), "_y": F.pow(F.tan(rad(c("_obliquity") / 2)), 2)},
        {"_hour": F.pmod(F.pmod(c("_ms"), F.lit(86_400_000)) / 60_000.0 + 4.0 * deg(equation) + 4.0 * c("_lon"), F.lit(1440.0)) / 4.0 - 180.0},
        {"_zenith": F.acos(unit(F.sin(c("_lat")) * F.sin(c("_declination")) + F.cos(c("_lat")) * F.cos(c("_declination")) * F.cos(rad(c("_hour")))))},
        {"_altitude": 90.0 - deg(c("_zenith")), "_below": F.cos(c("_lat")) * F.sin(c("_zenith"))},
        {"_turn": deg(F.acos(unit((F.sin(c("_lat")) * F.cos(c("_zenith")) - F.sin(c("_declination"))) / c("_below"))))},
        {"azimuth": F.when(F.abs(c("_below")) < 1e-9, 180.0).when(c("_hour") > 0, F.pmod(turn + 180.0, F.lit(360.0))).otherwise(F.pmod(540.0 - turn, F.lit(360.0))), "altitude": altitude + F.when(altitude > 85.0, 0.0).otherwise(arc / 3_600.0)},
    ]
    for step in steps:
        rows = rows.withColumns(step)
    return rows.drop("_below", "_turn", "_zenith", "_altitude", "_hour", "_declination", "_y", "_apparent", "_obliquity", "_mean_lon", "_anomaly", "_eccentricity", "_node", "_t", "_lon", "_lat", "_ms")


# façade height and half width in metres of street classes.
STREETS = {
    (6.0, 2.0): ["footway", "path", "steps", "pedestrian", "corridor", "cycleway"],
    (9.0, 5.0): ["living_street", "residential", "service", "unclassified", "track"],
    (15.0, 8.0): ["secondary", "secondary_link", "tertiary", "tertiary_link"],
    (0.0, 12.0): ["primary", "primary_link", "trunk", "trunk_link", "motorway", "motorway_link"],
}
LOW_SUN, GATE, LEAST_M = 3.0, 75.0, 0.5


def exposure(metres: Column, street: Column, enclosed: Column, area: Column, altitude: Column, azimuth: Column, bearing: Column) -> tuple[Column, Column]:
    """(exposure 0 to 1, basis) of a walked segment; the first rule that applies gives the basis."""
    name = F.lower(F.trim(street))
    height = half = None
    for (h, w), classes in STREETS.items():
        height = F.when(name.isin(classes), h) if height is None else height.when(name.isin(classes), h)
        half = F.when(name.isin(classes), w) if half is None else half.when(name.isin(classes), w)
    off = F.least(F.abs(angle_difference(azimuth, bearing + 90.0)), F.abs(angle_difference(azimuth, bearing - 90.0)))
    shaded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), height / F.tan(F.radians(altitude)) * F.cos(F.radians(off)) / half))
    basis = (
        F.when(metres < LEAST_M, "degenerate").when(enclosed | (name == "corridor"), "enclosed").when(altitude <= 0, "night").when(altitude < LOW_SUN, "low_sun")
        .when(area, "declined_area").when(height.isNull(), "declined_class").otherwise("facade")
    )
    value = F.when(basis == "degenerate", 1.0).when(basis.isin("enclosed", "night", "low_sun"), 0.0).when(basis.isin("declined_area", "declined_class"), 1.0).when((height <= 0) | (off > GATE), 1.0).otherwise(1.0 - shaded)
    return value, basis
