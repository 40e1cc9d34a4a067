"""Spatial joins over grid cells and operators along lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairn.functions.geo import METRES_PER_DEGREE, planar_offset


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def bucket_join(points: DataFrame, boxes: DataFrame, size: float, how: str = "inner") -> DataFrame:
    """points (lon, lat, ...) joined with boxes (x1, y1, x2, y2, ...) that contain them, by cells of size degrees.

    An equi-join: every box is listed in the cells it touches, every point in its one cell, so each pair
    comes out once. Columns of both sides must have distinct names.
    """
    spread = boxes.withColumn("cx", F.explode(F.sequence(cell(F.col("x1"), size), cell(F.col("x2"), size)))).withColumn("cy", F.explode(F.sequence(cell(F.col("y1"), size), cell(F.col("y2"), size))))
    placed = points.withColumns({"cx": cell(F.col("lon"), size), "cy": cell(F.col("lat"), size)})
    hit = placed.join(spread, ["cx", "cy"], how)
    return hit.where(F.col("lon").between(F.col("x1"), F.col("x2")) & F.col("lat").between(F.col("y1"), F.col("y2"))).drop("cx", "cy", "x1", "y1", "x2", "y2")


def padded(pieces: DataFrame, metres: float) -> DataFrame:
    """pieces (lon1, lat1, lon2, lat2) with boxes reaching metres beyond them, a little wide."""
    pad_y = metres / METRES_PER_DEGREE * 1.01
    pad_x = F.lit(pad_y) / F.cos(F.radians(F.greatest(F.abs("lat1"), F.abs("lat2")) + pad_y))
    return pieces.withColumns({"x1": F.least("lon1", "lon2") - pad_x, "x2": F.greatest("lon1", "lon2") + pad_x, "y1": F.least("lat1", "lat2") - pad_y, "y2": F.greatest("lat1", "lat2") + pad_y})


def match_points(points: DataFrame, pieces: DataFrame, radius: float, size: float = 0.003, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each point with its nearest line within radius metres: segment_id, seq and metres; points without one are left out.

    Distances are compared to the millimetre; of lines as near as each other the least segment_id and then
    the earliest piece wins. A point is told by its id; columns in carry come along with it, which saves a join.
    """
    near = bucket_join(points.select("id", "lon", "lat", *carry), padded(pieces.select("segment_id", "seq", "lon1", "lat1", "lon2", "lat2"), radius), size)
    _, offset = planar_offset("lon", "lat", "lon1", "lat1", "lon2", "lat2")
    near = near.withColumn("metres", F.floor(offset * 1000 + 0.5) / 1000).where(F.col("metres") <= radius)
    best = near.groupBy("id").agg(F.min(F.struct("metres", "segment_id", "seq", *carry)).alias("m"))
    return best.select("id", "m.segment_id", "m.seq", "m.metres", *[f"m.{c}" for c in carry])


def islands(rows: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """rows with island, the number of the stretch within its key; starts is true where a new one begins."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("island", F.sum(F.coalesce(starts, F.lit(False)).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def nearest(points: DataFrame, others: DataFrame, radius: float, distance: Column, keep: int = 1, size: float = 0.005) -> DataFrame:
    """The keep nearest others (other_id, o_lon, o_lat) within radius metres of each point (id, lon, lat), ranked from 1."""
    boxed = padded(others.withColumns({"lon1": F.col("o_lon"), "lon2": F.col("o_lon"), "lat1": F.col("o_lat"), "lat2": F.col("o_lat")}), radius).drop("lon1", "lon2", "lat1", "lat2")
    near = bucket_join(points, boxed, size).withColumn("metres", F.floor(distance * 1000 + 0.5) / 1000).where(F.col("metres") <= radius)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("metres", "other_id"))).where(F.col("rank") <= keep)
