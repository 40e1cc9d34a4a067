"""Files written and read again: what comes back is what the tables hold."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import wkt
from cairn.plans.base import POIS, VERTICES, Book, pois, vertices
from cairn.plans.spatial import _INC
from cairn.sources import files
from cairn.storage import shared_folder, table

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """lines (value) as text files in the shared folder; the path."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def _enclosed(lines: DataFrame, root: str) -> DataFrame:
    """lines (value) with a root element around those of each partition, so that each file is a document."""
    def enclose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [f"<{root}>"]})
        yield from batches
        yield pd.DataFrame({"value": [f"</{root}>"]})

    return lines.mapInPandas(enclose, "value string")


@book(f"WITH {_INC} SELECT id, lon, lat FROM pts")
def s3_point_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Points read from their texts, in whatever notation."""
    return table(spark, folder, "incidents").select("id", wkt.point(_c("geom")).alias("p")).where("p is not null").select("id", "p.lon", "p.lat").distinct()


@book(f"WITH {POIS} SELECT DISTINCT key AS id, 'Point' AS geometry_type, source, lon AS west, lat AS north FROM v_poi")
def o1_geojson_features(spark: SparkSession, folder: str) -> DataFrame:
    """Places written as a sequence of GeoJSON features, one a line, and read again."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), _c("key").alias("id"), point.alias("geometry"), F.struct("source", "name").alias("properties"))
    path = _written(spark, pois(spark, folder).select(F.to_json(feature).alias("value")), "geojson")
    got = files.read_geojson_lines(spark, path)
    return got.select("id", "geometry_type", F.get_json_object("properties", "$.source").alias("source"), _c("bbox.west").alias("west"), _c("bbox.north").alias("north")).distinct()


_WAY = "CAST('0x' || substr(sha256(segment_id), 1, 8) AS BIGINT)"


@book(f"WITH {VERTICES} SELECT {_WAY} AS id, count(*) AS points, min(lon) AS west, max(lat) AS north, FALSE AS closed, segment_id AS ref FROM v_vertex GROUP BY segment_id HAVING count(*) >= 2")
def o2_o4_n9_osm_ways(spark: SparkSession, folder: str) -> DataFrame:
    """Lines written as OSM XML nodes and ways, read again, and the ways put together from their nodes."""
    v = vertices(spark, folder).withColumn("way", F.conv(F.substring(F.sha2("segment_id", 256), 1, 8), 16, 10).cast("long")).withColumn("node", _c("way") * 10_000 + _c("seq"))
    nodes = v.select(F.format_string('<node id="%d" lat="%s" lon="%s"/>', "node", _c("lat").cast("string"), _c("lon").cast("string")).alias("value"))
    refs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "node"))), lambda n: F.concat(F.lit('<nd ref="'), n["node"].cast("string"), F.lit('"/>'))), "")
    ways = v.groupBy("way", "segment_id").agg(refs.alias("refs")).select(F.format_string('<way id="%d">%s<tag k="ref" v="%s"/></way>', "way", "refs", "segment_id").alias("value"))
    path = _written(spark, _enclosed(nodes.unionByName(ways), "osm"), "osm")
    lines = files.assemble_ways(files.read_osm_xml(spark, [path], "way"), files.read_osm_xml(spark, [path], "node"))
    xs, ys = F.transform("line", lambda p: p["lon"]), F.transform("line", lambda p: p["lat"])
    return lines.select("id", F.size("line").cast("long").alias("points"), F.array_min(xs).alias("west"), F.array_max(ys).alias("north"), "closed", F.element_at("tags", "ref").alias("ref"))


@book("SELECT count(*) AS rows_read, count(*) FILTER (WHERE s_suppkey % 7 = 0) AS corrupt, sum(s_suppkey) AS keys FROM supplier")
def o11_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Facts written as JSON lines with damaged lines between, read again: the sound rows and how many were not."""
    s = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    line = F.to_json(F.struct(_c("s_suppkey").alias("key"), _c("s_name").alias("name")))
    broken = s.where("s_suppkey % 7 = 0").select(F.substring(F.to_json(F.struct(_c("s_suppkey").alias("key"), _c("s_name").alias("name"))), 1, 9).alias("value"))
    rows, bad = files.read_lines(spark, _written(spark, s.select(line.alias("value")).unionByName(broken), "lines"), "key long, name string")
    return rows.agg(F.count("*").alias("rows_read"), F.sum("key").alias("keys")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("corrupt")))).select("rows_read", "corrupt", "keys")


@book("SELECT day, source, count(*) AS n FROM observation WHERE source = 'live' GROUP BY 1, 2")
def o15_partitioned_store(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes stored by day and source, of which one source is read again: other partitions are never opened."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    files.write_by(table(spark, folder, "observation").select("id", "day", "source"), path, "day", "source")
    return spark.read.schema("id long, day string, source string").parquet(path).where("source = 'live'").groupBy("day", "source").agg(F.count("*").alias("n"))
