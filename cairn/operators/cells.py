"""Cells of about one size anywhere on earth, for equi-joins of near points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

METRES = 111195.08  # per degree of latitude
#: Side of the cells in metres; a point is looked up in the cells that its reach touches, about two on average for 300 m.
CELL_M = 1600.0


def near_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Planar metres between near points, over the date line too."""
    dx = F.abs(lon1 - lon2)
    dx = F.when(dx > 180, 360 - dx).otherwise(dx) * F.cos(F.radians((lat1 + lat2) / 2)) * METRES
    return F.sqrt(F.pow(dx, 2) + F.pow((lat1 - lat2) * METRES, 2))


_SIDE = CELL_M / METRES  # degrees of latitude


def _row(lat: Column) -> Column:
    return F.floor((lat + 90) / _SIDE)


def _around(row: Column) -> Column:
    """Cells of a row around the earth: as many as are CELL_M wide at least where the row is narrowest."""
    widest = F.least(F.lit(90.0), F.greatest(F.abs(row * _SIDE - 90), F.abs((row + 1) * _SIDE - 90)))
    return F.greatest(F.lit(1), F.floor(F.lit(360 / _SIDE) * F.cos(F.radians(widest)))).cast("long")


def cell(lon: Column, lat: Column) -> Column:
    """Key of the cell of a point."""
    row = _row(lat)
    return row * (1 << 32) + F.pmod(F.floor((lon + 180) / 360 * _around(row)), _around(row))


def cells_within(lon: Column, lat: Column, metres: float) -> Column:
    """Keys of the cells that hold any point within metres of a point; a right answer at any latitude and over the date line."""
    def of_row(row: Column) -> Column:
        n = _around(row)
        near = F.least(F.lit(89.9999), F.abs(lat) + metres / METRES)
        span = metres / METRES / F.cos(F.radians(near)) / 360  # share of the circle
        lo, hi = F.floor(((lon + 180) / 360 - span) * n), F.floor(((lon + 180) / 360 + span) * n)
        columns = F.sequence(lo, F.least(hi, lo + n - 1))
        return F.transform(columns, lambda x: row * (1 << 32) + F.pmod(x, n))

    rows = F.sequence(_row(F.greatest(F.lit(-90.0), lat - metres / METRES)), _row(F.least(F.lit(90.0), lat + metres / METRES)))
    return F.array_distinct(F.flatten(F.transform(rows, of_row)))
