"""Readers and writers of the file formats of the domain. Bad entries are dropped or marked, never guessed."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

MOST_POINTS = 500_000


_FEATURE = "struct<id:string,geometry:struct<type:string,coordinates:string>,properties:string>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections: id, geometry_type, coordinates and properties as JSON text, bbox of all vertices.

    The id falls back to the property id and then to the place in the file; features without geometry are
    dropped; a file that is no collection gives no rows. A collection is one text and read by one task, of
    2 GB at most; larger data come as many files, or by lines (read_geojson_lines).
    """
    raw = spark.read.text(path, wholetext=True)
    return _features(raw.select(F.from_json("value", f"struct<features:array<{_FEATURE}>>").alias("c")).select(F.posexplode("c.features").alias("k", "f")))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with one feature a line, with or without record separators; split over tasks like any text. Lines that are no feature are dropped."""
    line = F.regexp_replace("value", "^[\\u001e\\s]+", "")
    return _features(spark.read.text(path).select(F.lit(None).cast("int").alias("k"), F.from_json(line, _FEATURE).alias("f")))


def _features(rows: DataFrame) -> DataFrame:
    rows = rows.where("f.geometry is not null and f.geometry.coordinates is not null")
    pairs = F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"\[\s*(-?\d+\.?\d*(?:[eE][-+]?\d+)?)\s*,\s*-?\d"), F.lit(1))
    second = F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"\[\s*-?\d+\.?\d*(?:[eE][-+]?\d+)?\s*,\s*(-?\d+\.?\d*(?:[eE][-+]?\d+)?)"), F.lit(1))
    as_double = lambda xs: F.transform(xs, lambda x: x.cast("double"))
    out = rows.select(
        F.coalesce("f.id", F.get_json_object("f.properties", "$.id"), F.concat(F.lit("feature-"), F.col("k").cast("string"))).alias("id"), F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"), as_double(pairs).alias("xs"), as_double(second).alias("ys"),
    )
    box = F.struct(F.array_min("xs").alias("west"), F.array_min("ys").alias("south"), F.array_max("xs").alias("east"), F.array_max("ys").alias("north"))
    return out.select("id", "geometry_type", "coordinates", "properties", box.alias("bbox"))


def read_osm_xml(spark: SparkSession, paths: list[str], element: str) -> DataFrame:
    """node (id, lat, lon, tags), way (id, nodes, tags) or relation (id, members, tags) elements; of an id in several files the first file's counts."""
    out = None
    tag = "tag array<struct<_k:string,_v:string>>"
    body = {"node": f"_id long, _lat double, _lon double, {tag}", "way": f"_id long, nd array<struct<_ref:long>>, {tag}", "relation": f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {tag}"}[element]
    for k, path in enumerate(paths):
        rows = spark.read.format("xml").option("rowTag", element).schema(body).load(path).withColumn("file", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    rest = [c for c in out.columns if c not in ("_id", "file")]
    first = out.groupBy("_id").agg(F.min_by(F.struct(*rest), "file").alias("e"))
    tags = F.map_from_entries(F.transform(F.coalesce("e.tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"]))).alias("tags")
    columns = {"node": [F.col("e._lat").alias("lat"), F.col("e._lon").alias("lon")], "way": [F.transform("e.nd", lambda n: n["_ref"]).alias("nodes")], "relation": [F.transform("e.member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members")]}[element]
    return first.select(F.col("_id").alias("id"), *columns, tags)


def assemble_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, tags, line, closed) of ways with at least two known nodes, in the order of their references."""
    refs = ways.select("id", F.posexplode("nodes").alias("seq", "node")).join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node")
    lines = refs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "node", "lon", "lat"))).alias("v")).where(F.size("v") >= 2)
    lines = lines.select("id", F.transform("v", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"), (F.element_at("v", 1)["node"] == F.element_at("v", -1)["node"]).alias("closed"))
    return lines.join(ways.select("id", "tags"), "id")


def iso_ms(text: str) -> int | None:
    try:
        when = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return int((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def _gpx_points(data: bytes) -> list[tuple]:
    """(segment, seq, lon, lat, t, speed, accuracy) of the track points, else of route and way points."""
    if re.search(rb"<!DOCTYPE", data[:4096], re.I):
        raise ValueError("a document type is declared")
    root = ElementTree.fromstring(data)
    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def point(e):
        try:
            lon, lat = float(e.get("lon")), float(e.get("lat"))
        except (TypeError, ValueError):
            return None
        got = {local(c).lower(): (c.text or "").strip() for c in e.iter()}
        number = lambda k: float(got[k]) if re.fullmatch(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", got.get(k, "")) else None
        return lon, lat, iso_ms(got["time"]) if got.get("time") else None, number("speed"), next((a for a in map(number, ("accuracy", "hacc", "horizontalaccuracy")) if a is not None), None)

    tracks = [[p for e in s if local(e) == "trkpt" and (p := point(e))] for s in root.iter() if local(s) == "trkseg"]
    tracks = [t for t in tracks if t] or [[p for e in root.iter() if local(e) in ("rtept", "wpt") and (p := point(e))]]
    out = [(k, n, *p) for k, track in enumerate(tracks) for n, p in enumerate(track)]
    if len(out) > MOST_POINTS:
        raise ValueError("too many points")
    return out


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Points of GPX files: file, segment, seq, lon, lat, t, speed, accuracy, error; a file that is refused has one row with its error."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "segment", "seq", "lon", "lat", "t", "speed", "accuracy", "error"]
        for batch in batches:
            out = []
            for file, data in zip(batch["path"], batch["content"]):
                try:
                    points = _gpx_points(bytes(data))
                    out += [(file, *p, None) for p in points] if points else [(file, *[None] * 7, "no points")]
                except (ElementTree.ParseError, ValueError) as e:
                    out.append((file, *[None] * 7, str(e)[:200]))
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({"segment": "Int32", "seq": "Int32", "t": "Int64", "lon": "float64", "lat": "float64", "speed": "float64", "accuracy": "float64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "file string, segment int, seq int, lon double, lat double, t long, speed double, accuracy double, error string")


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt lines) of a file of JSON lines; a missing file gives empty tables."""
    try:
        raw = spark.read.text(path)
    except AnalysisException:
        raw = spark.createDataFrame([], "value string")
    parsed = raw.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.expr("try_parse_json(value) is not null").alias("sound"))
    return parsed.where("sound").select("r.*"), parsed.where("not sound and trim(value) <> ''").select("value")


def write_by(df: DataFrame, path: str, *columns: str) -> None:
    """Write a table partitioned by columns, each partition in few files: rows are brought together by them first."""
    df.repartition(*columns).write.mode("overwrite").partitionBy(*columns).parquet(path)
