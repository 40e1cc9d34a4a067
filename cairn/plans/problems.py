"""Queries of the general data-quality and spatial problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import wkt
from cairn.operators import dual_tree
from cairn.operators.anomalies import implausible_readings
from cairn.plans.base import PIECES
from cairn.plans.spatial import _INC, _OFFSET, _RINGS, haversine_sql
from cairn.storage import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return implausible_readings(table(spark, folder, "observation")).select("id", "field")


def p4_impossible(spark: SparkSession, folder: str) -> DataFrame:
    return implausible_readings(table(spark, folder, "observation")).where("reason = 'impossible'").select("id", "field")


#: Area in which a point counts as placed: west, south, east, north.
COUNTRY = (50.5, 24.2, 52.0, 26.6)


def _placed(points: DataFrame) -> DataFrame:
    west, south, east, north = COUNTRY
    return points.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    fixes = _placed(table(spark, folder, "observation").select(F.col("id").cast("string").alias("id"), F.col("lng").alias("lon"), "lat"))
    reports = table(spark, folder, "incidents").select("id", wkt.point(F.col("geom")).alias("p")).select("id", "p.lon", "p.lat").distinct()
    reports = _placed(reports)
    lines = table(spark, folder, "traffic_state").select("segment_id", wkt.line(F.col("geom")).alias("line")).distinct()
    pieces = lines.select(F.col("segment_id").alias("id"), F.explode(wkt.pieces(F.col("line"))).alias("s")).select("id", "s.*")
    areas = table(spark, folder, "vector_features").select("id", wkt.rings(F.col("geom")).alias("rings")).where("rings is not null").select("id", wkt.edges(F.col("rings")).alias("edges"))
    fixes, reports = (dual_tree.point_tree(t.withColumn("id", F.struct(F.lit(k).alias("of"), "id"))) for k, t in (("observation", fixes), ("incident", reports)))
    found = (
        dual_tree.near_points(fixes, reports, 50.0).select(F.lit("observation_incident").alias("relation"), "left_id.id", "right_id.id"),
        dual_tree.near_lines(reports, pieces, 30.0).select(F.lit("incident_segment"), "left_id.id", "right_id"),
        dual_tree.points_in_areas(fixes.union(reports), areas).select(F.concat("left_id.of", F.lit("_feature")), "left_id.id", "right_id"),
    )
    out = None
    for rows in found:
        rows = rows.toDF("relation", "left_id", "right_id")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {"p4_found": p4_found, "p4_impossible": p4_impossible, "p5_found": p5_found}
_BOX = "BETWEEN 50.5e0 AND 52e0 AND {lat} BETWEEN 24.2e0 AND 26.6e0"
_INSIDE = """SELECT '{name}' AS relation, p.id AS left_id, e.id AS right_id FROM {points} p JOIN box ON p.lon BETWEEN w AND e AND p.lat BETWEEN s AND n JOIN ed e ON e.id = box.id
 GROUP BY p.id, p.lon, p.lat, e.id HAVING count(*) FILTER (WHERE (e.y > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x) * (p.lat - e.y) / (e.y2 - e.y) + e.x) % 2 = 1"""
SQL: dict[str, str] = {
    "p4_impossible": """SELECT id, 'speed' AS field FROM observation WHERE t IS NOT NULL AND trip_pseudonym IS NOT NULL AND (isnan(speed) OR speed < 0 OR speed > 80)
UNION ALL SELECT id, 'accuracy' FROM observation WHERE t IS NOT NULL AND trip_pseudonym IS NOT NULL AND (isnan(accuracy) OR accuracy <= 0 OR accuracy > 5000)""",
    "p5_found": f"""WITH {PIECES}, {_INC.replace("pts AS", "every AS")}, pts AS (SELECT * FROM every WHERE lon {_BOX.format(lat="lat")}), ob AS (SELECT CAST(id AS VARCHAR) AS id, lng AS lon, lat FROM observation WHERE lng {_BOX.format(lat="lat")}),
np AS (SELECT p.id, p.lon, p.lat, s.segment_id, s.seq, s.lon1, s.lat1, s.lon2, s.lat2 FROM pts p JOIN v_piece s ON p.lon BETWEEN least(s.lon1, s.lon2) - 0.0013e0 AND greatest(s.lon1, s.lon2) + 0.0013e0 AND p.lat BETWEEN least(s.lat1, s.lat2) - 0.0011e0 AND greatest(s.lat1, s.lat2) + 0.0011e0), {_OFFSET.format(src="np")},
{_RINGS}, ed AS (SELECT * FROM (SELECT id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM rxy WINDOW w AS (PARTITION BY id, ring ORDER BY seq)) q WHERE y <> y2), box AS (SELECT id, min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM rxy GROUP BY 1)
SELECT DISTINCT 'observation_incident' AS relation, o.id AS left_id, p.id AS right_id FROM ob o JOIN pts p ON o.lat BETWEEN p.lat - 0.0005e0 AND p.lat + 0.0005e0 AND o.lon BETWEEN p.lon - 0.00056e0 AND p.lon + 0.00056e0 WHERE {haversine_sql("o.lon", "o.lat", "p.lon", "p.lat")} <= 50
UNION SELECT 'incident_segment', id, segment_id FROM offs WHERE off <= 30
UNION {_INSIDE.format(name="observation_feature", points="ob")}
UNION {_INSIDE.format(name="incident_feature", points="pts")}"""
}
