"""Reading well-known text into arrays, JVM-side. Text that cannot be read gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_HEAD = r"(?i)^\s*(?:SRID\s*=\s*4326\s*;)?\s*"


def point(text: Column) -> Column:
    """struct(lon, lat) of a POINT, with or without SRID 4326 and further ordinates."""
    shape = rf"{_HEAD}POINT\s*(?:ZM|Z|M)?\s*\(\s*({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER}){{0,2}}\s*\)\s*$"
    lon, lat = (F.regexp_extract(text, shape, k).try_cast("double") for k in (1, 2))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def _vertices(body: Column) -> Column:
    def vertex(v: Column) -> Column:
        parts = F.split(F.trim(v), r"\s+")
        return F.struct(F.try_element_at(parts, F.lit(1)).try_cast("double").alias("lon"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("lat"))

    return F.transform(F.split(body, ","), vertex)


def _sound(vertices: Column) -> Column:
    return F.forall(vertices, lambda v: v["lon"].isNotNull() & v["lat"].isNotNull() & ~F.isnan(v["lon"]) & ~F.isnan(v["lat"]))


def line(text: Column) -> Column:
    """array<struct(lon, lat)> of a LINESTRING with at least two vertices."""
    body = F.regexp_extract(text, rf"{_HEAD}LINESTRING\s*(?:ZM|Z|M)?\s*\(([^()]+)\)\s*$", 1)
    vertices = _vertices(body)
    return F.when((body != "") & _sound(vertices) & (F.size(vertices) >= 2), vertices)


def rings(text: Column) -> Column:
    """array<array<struct(lon, lat)>>: all rings of a POLYGON or MULTIPOLYGON, outer ones and holes alike (even-odd rule)."""
    fits = text.rlike(rf"{_HEAD}(?:MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*\(\s*\(.*\)\s*\)\s*$")
    read = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1)), _vertices)
    return F.when(fits & (F.size(read) > 0) & F.forall(read, lambda r: _sound(r) & (F.size(r) >= 3)), read)


def pieces(vertices: Column) -> Column:
    """The segments between neighbouring vertices, array<struct(lon1, lat1, lon2, lat2)>."""
    return F.transform(
        F.slice(vertices, F.lit(2), F.greatest(F.size(vertices) - 1, F.lit(0))),
        lambda b, k: F.struct(vertices[k]["lon"].alias("lon1"), vertices[k]["lat"].alias("lat1"), b["lon"].alias("lon2"), b["lat"].alias("lat2")),
    )


def edges(all_rings: Column) -> Column:
    """All edges of rings, each closed whether its last vertex repeats the first or not."""
    return F.flatten(F.transform(all_rings, lambda r: pieces(F.concat(r, F.array(r[0])))))
