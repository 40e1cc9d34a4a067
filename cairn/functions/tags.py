"""Predicates and values read from map tags: access ladders, barriers, speeds. Arguments are columns of tag values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Classes and access values of the map's tagging scheme.
CAR_CLASSES = [
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link",
    "unclassified", "residential", "living_street", "service", "track", "road", "busway",
]
FOOT_CLASSES = ["footway", "path", "steps", "pedestrian", "corridor", "bridleway", "living_street", "residential", "service", "track", "unclassified", "road", "cycleway"]
UNBUILT_CLASSES = ["construction", "proposed", "abandoned", "razed"]
DENIED = ["no", "private", "customers", "permit", "military", "delivery"]
ALLOWED = ["yes", "designated", "permissive", "destination", "official"]
SOLID_BARRIERS = ["fence", "wall", "hedge", "retaining_wall", "city_wall", "cement_block", "concrete_block", "concrete"]
LOCKED = ["yes", "1", "true", "rear", "private"]
CLASS_KMH = {
    "motorway": 120.0, "trunk": 80.0, "primary": 80.0, "secondary": 80.0, "tertiary": 50.0, "unclassified": 50.0, "residential": 50.0, "living_street": 20.0,
    "service": 40.0, "track": 30.0, "road": 40.0, "motorway_link": 60.0, "trunk_link": 80.0, "primary_link": 60.0, "secondary_link": 60.0, "tertiary_link": 50.0,
}
SERVICE_KMH = {"parking_aisle": 10.0, "driveway": 15.0, "drive-through": 10.0, "alley": 20.0}
FALLBACK_KMH = 30.0
WALK_MS, STEPS_MS = 1.35, 0.5
KMH_PER_MILE = 1.60934


def tag(value: Column) -> Column:
    return F.lower(F.trim(value))


def _first_decisive(values: list[Column]) -> Column:
    """True where the first value of the ladder that decides denies; false if it allows or none decides."""
    out = F.lit(False)
    for v in reversed(values):
        out = F.when(tag(v).isin(ALLOWED), False).when(tag(v).isin(DENIED), True).otherwise(out)
    return out


def _there(highway: Column, construction: Column) -> Column:
    hw = F.coalesce(tag(highway), F.lit(""))
    return (hw != "") & ~hw.isin(UNBUILT_CLASSES) & (F.coalesce(tag(construction), F.lit("")) == "")


def car_routable(highway, construction, motorcar, motor_vehicle, vehicle, access) -> Column:
    fits = _there(highway, construction) & tag(highway).isin(CAR_CLASSES)
    return F.coalesce(fits & ~_first_decisive([motorcar, motor_vehicle, vehicle, access]), F.lit(False))


def foot_routable(highway, construction, foot, access) -> Column:
    walked = F.when(tag(highway).isin(FOOT_CLASSES), ~_first_decisive([foot, access])).otherwise(F.coalesce(tag(foot).isin(["yes", "designated"]), F.lit(False)))
    return F.coalesce(_there(highway, construction) & walked, F.lit(False))


def renderable(highway) -> Column:
    return F.coalesce(tag(highway), F.lit("")) != ""


def barrier_effect(foot, access, locked, barrier) -> Column:
    return (
        F.when(tag(foot).isin(ALLOWED), "pass").when(tag(foot).isin(DENIED), "block").when(tag(access).isin(DENIED), "block")
        .when(tag(locked).isin(LOCKED), "block").when(tag(barrier).isin(SOLID_BARRIERS), "block").otherwise("pass")
    )


def _unit_speed(text: Column, number: str) -> tuple[Column, Column]:
    shape = rf"^({number})\s+(mph|km/h)$"
    return F.nullif(F.regexp_extract(text, shape, 1), F.lit("")), F.regexp_extract(text, shape, 2)


def maxspeed_int(raw: Column) -> Column:
    """Whole km/h, miles cut to whole; null if unreadable."""
    text = tag(raw)
    n, unit = _unit_speed(text, r"[-+]?\d+")
    n = n.try_cast("int")
    read = F.when(text.rlike(r"^[-+]?\d+$"), text.try_cast("int")).when(unit == "mph", (n * KMH_PER_MILE).cast("int")).when(unit == "km/h", n)
    return F.when(~text.isin("none", "signals", "walk", ""), read)


def maxspeed_float(raw: Column, positive: bool = True) -> Column:
    """km/h as a double; positive leaves out values of 0 and less."""
    text = tag(raw)
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)"
    n, unit = _unit_speed(text, number)
    n = n.try_cast("double")
    read = F.when(text.rlike(f"^{number}$"), text.try_cast("double")).when(unit == "mph", n * KMH_PER_MILE).when(unit == "km/h", n)
    read = F.when(~text.isin("none", "signals", "walk", ""), read)
    return F.when(read > 0, read) if positive else read


def maxspeed_lenient(raw: Column) -> Column:
    """The first digits anywhere, miles rounded half to even."""
    text = tag(raw)
    n = F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")
    return F.when(~text.isin("none", "signals", "walk", "variable", ""), F.when(text.contains("mph"), F.bround(n * KMH_PER_MILE).cast("int")).otherwise(n))


def lookup(key: Column, table: dict[str, float], default: float | None) -> Column:
    out = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(key, F.lit("")))
    return F.coalesce(out, F.lit(default)) if default is not None else out


def default_kmh(highway: Column, service: Column) -> Column:
    sub = F.when(tag(highway) == "service", lookup(tag(service), SERVICE_KMH, None))
    return F.coalesce(sub, lookup(tag(highway), CLASS_KMH, FALLBACK_KMH))


def effective_kmh(highway: Column, service: Column, maxspeed: Column) -> Column:
    return F.coalesce(maxspeed_float(maxspeed), default_kmh(highway, service))


def walk_ms(highway: Column) -> Column:
    return F.when(tag(highway) == "steps", STEPS_MS).otherwise(WALK_MS)
