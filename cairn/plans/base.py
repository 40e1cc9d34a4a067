"""Registration of queries with their SQL, rounding shared by both, and views over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cairn.functions import wkt
from cairn.storage import table

#: The instant that stands for now wherever an operator needs one, in epoch milliseconds.
NOW_MS = 1_736_900_000_000


class Book:
    """Queries of one module and the SQL that must give the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def rounded(x: Column, digits: int = 3) -> Column:
    """Half-up rounding that both engines do alike on doubles."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def r_sql(x: str, digits: int = 3) -> str:
    return f"(floor(({x}) * {10**digits}e0 + 0.5e0) / {10**digits}e0)"


# --- views: a DataFrame and the same as a WITH item -------------------------------------------------

PROBES = """v_probe AS (SELECT id, trip_pseudonym AS trip, kind, lng AS lon, lat, t, day, speed * 3.6e0 AS speed_kmh, speed, accuracy, heading, source FROM observation)"""


def probes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "observation").select("id", F.col("trip_pseudonym").alias("trip"), "kind", F.col("lng").alias("lon"), "lat", "t", "day", (F.col("speed") * 3.6).alias("speed_kmh"), "speed", "accuracy", "heading", "source")


VERTICES = r"""v_seg AS (SELECT segment_id, min(geom) AS geom, max(free_flow_kmh) AS free_flow_kmh FROM traffic_state GROUP BY segment_id),
v_vertex AS (SELECT segment_id, free_flow_kmh, CAST(seq AS INTEGER) AS seq, CAST(regexp_extract(trim(p), '^(\S+)\s+(\S+)', 1) AS DOUBLE) AS lon, CAST(regexp_extract(trim(p), '^(\S+)\s+(\S+)', 2) AS DOUBLE) AS lat
  FROM (SELECT segment_id, free_flow_kmh, unnest(range(len(parts))) AS seq, unnest(parts) AS p
        FROM (SELECT *, string_split(regexp_extract(geom, '\(([^()]+)\)', 1), ',') AS parts FROM v_seg) q) q2)"""
PIECES = VERTICES + """,
v_piece AS (SELECT * FROM (SELECT segment_id, free_flow_kmh, seq, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM v_vertex WINDOW w AS (PARTITION BY segment_id ORDER BY seq)) q WHERE lon2 IS NOT NULL)"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """segment_id, free_flow_kmh, line: one row per road segment."""
    rows = table(spark, folder, "traffic_state").groupBy("segment_id").agg(F.min("geom").alias("geom"), F.max("free_flow_kmh").alias("free_flow_kmh"))
    return rows.select("segment_id", "free_flow_kmh", wkt.line(F.col("geom")).alias("line")).where("line is not null")


def vertices(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).select("segment_id", "free_flow_kmh", F.posexplode("line").alias("seq", "v")).select("segment_id", "free_flow_kmh", "seq", "v.lon", "v.lat")


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).select("segment_id", "free_flow_kmh", F.posexplode(wkt.pieces(F.col("line"))).alias("seq", "s")).select("segment_id", "free_flow_kmh", "seq", "s.*")


POIS = """v_poi AS (SELECT osm_key AS key, 'osm' AS source, name, category, brand, address, lon, lat, CAST(NULL AS DOUBLE) AS confidence FROM (SELECT DISTINCT osm_key, name, category, brand, address, lon, lat FROM poi_osm) a
  UNION ALL SELECT overture_key, 'overture', name, category, brand, address, lon, lat, confidence FROM (SELECT DISTINCT overture_key, name, category, brand, address, lon, lat, confidence FROM poi_overture) b)"""


def pois(spark: SparkSession, folder: str) -> DataFrame:
    osm = table(spark, folder, "poi_osm").select(F.col("osm_key").alias("key"), F.lit("osm").alias("source"), "name", "category", "brand", "address", "lon", "lat", F.lit(None).cast("double").alias("confidence")).distinct()
    return osm.unionByName(table(spark, folder, "poi_overture").select(F.col("overture_key").alias("key"), F.lit("overture").alias("source"), "name", "category", "brand", "address", "lon", "lat", "confidence").distinct())


def picked(key: str, values: list[str | None], step: int = 1) -> Column:
    """values[(key div step) mod length], the way the tag fixtures spread values over rows."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), ((F.floor(F.col(key) / step) % len(values)) + 1).cast("int"))


def picked_sql(key: str, values: list[str | None], step: int = 1) -> str:
    listed = ", ".join("CAST(NULL AS VARCHAR)" if v is None else "'" + v + "'" for v in values)
    return f"list_extract([{listed}], CAST(({key} // {step}) % {len(values)} + 1 AS INTEGER))"


#: Fixture of OSM tags over parts: column, values, how many keys in a row have the same value.
TAGS: list[tuple[str, list[str | None], int]] = [
    ("highway", ["motorway", "residential", "footway", "service", "Track", "steps", "construction", "primary_link", "living_street", "cycleway", "bus_guideway", None, "tertiary", "path", "road", "trunk", "pedestrian"], 1),
    ("access", [None, "private", None, "yes", "no", None, "destination", None, "customers"], 1),
    ("motor_vehicle", [None, None, None, "yes", None, "no", None, "permissive"], 3),
    ("motorcar", [None, None, None, None, None, "no", None, None, None, None, " Yes "], 5),
    ("vehicle", [None, None, None, "private", None], 11),
    ("foot", [None, None, "yes", None, "no", None, "designated", None, "private"], 2),
    ("construction", [None, None, None, None, None, None, None, None, None, None, None, None, "minor"], 1),
    ("barrier", ["gate", "fence", "bollard", "wall", "hedge", "lift_gate", None, "city_wall"], 1),
    ("locked", [None, None, "yes", None, "no", "rear"], 7),
    ("service", [None, "parking_aisle", "driveway", "alley", "drive-through"], 4),
    ("maxspeed", ["50", None, "30 mph", "none", "80", "walk", "60.5", "signals", "45 km/h", "x", "-5", "120"], 1),
    ("surface", [None, "paved", "sand", "gravel", "asphalt", "compacted", "dirt"], 3),
    ("lit", [None, "yes", "no"], 2),
    ("sidewalk", [None, "both", "none", "left", "separate"], 3),
    ("incline", [None, "5%", "up", "-8%", "0", "12"], 5),
    ("oneway", [None, "yes", "-1", "no", "true", "reverse", "1"], 2),
    ("lanes", [None, "2", "3", "x", "1", "4;2"], 3),
    ("turn_lanes", [None, "left|through|right", "left;through|through", "none|none", "|right", "slight_left|merge_to_left"], 2),
]
TAGS_SQL = "v_tags AS (SELECT p_partkey AS id, " + ", ".join(f"{picked_sql('p_partkey', v, s)} AS {c}" for c, v, s in TAGS) + " FROM part)"


def tags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), *[picked("p_partkey", v, s).alias(c) for c, v, s in TAGS])


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by order; pre-aggregated, so that a hot key costs no window over all its rows."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in rest])


def along(rows: DataFrame, line: str, seq: str, metres: Column) -> DataFrame:
    """rows with cum, the metres from the line's start to each vertex; metres is the distance from the vertex before."""
    return rows.withColumn("cum", F.sum(F.coalesce(metres, F.lit(0.0))).over(W.partitionBy(line).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)))
