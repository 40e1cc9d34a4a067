"""Order-dependent scans, streams and tile bytes as queries; most have no SQL and are held against plain versions in the tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import geo
from cairn.operators import sequential as S
from cairn.plans.base import POIS, PROBES, Book, lines, picked, pieces, pois, probes
from cairn.plans.places import named
from cairn.operators.spatial import match_points
from cairn.plans.privacy import _CUM, gate
from cairn.plans.spatial import _measured
from cairn.plans.tiles import _BAD, _ENV, _INTENTS, envelope_fault
from cairn.plans.traffic import _MATCH, MATCH_M, matched, valid_probes
from cairn.sources import vector_tiles
from cairn.plans.spatial import _XY
from cairn.storage import shared_folder
from cairn.streaming import trips as streams

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    return probes(spark, folder).where("lon between -180 and 180 and lat between -90 and 90")


@book()
def v7_kinematic_screen(spark: SparkSession, folder: str) -> DataFrame:
    return S.scan(S.stretches(_placed(spark, folder).select("trip", "id", "t", "lon", "lat", "speed")), ["trip", "part"], ["t", "id"], S.kinematic_screen(), "kept boolean, derived double", ["trip", "id"])


@book()
def k6_fix_gate(spark: SparkSession, folder: str) -> DataFrame:
    out = S.scan(S.stretches(probes(spark, folder).select("trip", "id", "t", "lon", "lat")), ["trip", "part"], ["t", "id"], S.fix_gate(), "verdict string", ["trip", "id"])
    return out.groupBy("verdict").agg(F.count("*").alias("n"))


@book()
def k9_probe_buffer(spark: SparkSession, folder: str) -> DataFrame:
    out = S.scan(S.stretches(_placed(spark, folder).select("trip", "id", "t", "lon", "lat", "accuracy")), ["trip", "part"], ["t", "id"], S.probe_buffer(), "taken boolean, batch long", ["trip", "part", "id"])
    return out.where("taken").groupBy("trip", "part", "batch").agg(F.count("*").alias("probes"))


@book()
def k10_speed_alert(spark: SparkSession, folder: str) -> DataFrame:
    limit = matched(spark, folder).join(lines(spark, folder).select("segment_id", _c("free_flow_kmh").alias("limit_kmh")), "segment_id").select("id", "limit_kmh")
    rows = S.stretches(valid_probes(spark, folder).select("trip", "id", "t", "speed_kmh").join(limit, "id"))
    return S.scan(rows, ["trip", "part"], ["t", "id"], S.speed_alert(), "alert boolean", ["trip", "id"]).where("alert").select("trip", "id")


@book()
def c1_search_index(spark: SparkSession, folder: str) -> DataFrame:
    """Named places less those of the same name within 250 m of one kept before, in the order of their keys."""
    return S.scan(named(spark, folder).select("key", "norm", "lon", "lat"), ["norm"], ["key"], S.greedy_collapse(), "kept boolean", ["key"]).where("kept").select("key")


@book()
def m13_sparse_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Vertices of each line at least 60 m after the last one kept."""
    rows = _measured(spark, folder).select("segment_id", "seq", "cum")
    return S.scan(rows, ["segment_id"], ["seq"], S.spaced(60.0), "kept boolean", ["segment_id", "seq"]).where("kept").select("segment_id", "seq")


@book(f"WITH {PROBES}, {_CUM} SELECT id, trip FROM cu WHERE cum >= 200000 AND total - cum >= 200000")
def v9_stream_truncation(spark: SparkSession, folder: str) -> DataFrame:
    """The fixes that the stream commits; the table is what has arrived, so the batch form is its twin."""
    schema = spark.read.parquet(f"{folder}/observation.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/observation.parquet*").select(_c("trip_pseudonym").alias("trip"), "id", "t", _c("lng").alias("lon"), "lat").where("lon between -180 and 180 and lat between -90 and 90")
    out = streams.run_to_end(streams.truncate_stream(stream, idle_ms=None), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    return out.where("outcome = 'committed'").select("id", "trip")


@book(f"WITH {_ENV} SELECT DISTINCT id, intent FROM v_env WHERE {_BAD} = 'ok'")
def o22_bus_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Sound envelopes of a stream in which each is delivered twice."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*").withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    k = _c("event_id")
    rows = e.select(k.alias("id"), F.when(k % 17 != 0, F.concat(F.lit("c"), _c("user_id").cast("string"))).alias("correlation_id"), picked("event_id", _INTENTS).alias("intent"), F.when(k % 13 == 0, F.lit(-5)).otherwise(100).alias("sla_ms"), _c("ts").cast("timestamp").alias("at"))
    good = streams.unique_envelopes(envelope_fault(rows).where("verdict = 'ok'"), "60 days")
    return streams.run_to_end(good.select("id", "intent"), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


def tile_features(spark: SparkSession, folder: str, zoom: int = 14) -> DataFrame:
    x, y = geo.tile("lon", "lat", zoom)
    mx, my = geo.mercator("lon", "lat")
    place = lambda m, k: F.bround((m * 2**zoom - k) * vector_tiles.EXTENT).cast("int")
    rows = pois(spark, folder).where("abs(lat) < 85").withColumns({"x": x, "y": y, "mx": mx, "my": my})
    return rows.select(F.lit(zoom).alias("z"), "x", "y", _c("key").alias("id"), "source", F.lit("Point").alias("kind"), F.array(place(_c("mx"), _c("x"))).alias("lx"), F.array(place(_c("my"), _c("y"))).alias("ly"), F.create_map(F.lit("name"), _c("name"), F.lit("category"), _c("category")).alias("properties")).withColumnRenamed("source", "layer")


@book()
def l10_encoded_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return vector_tiles.bake(tile_features(spark, folder)).select("z", "x", "y", "features", "bytes", F.sha2("tile", 256).alias("digest"))


@book(f"WITH {POIS}, t AS (SELECT DISTINCT key, lon, lat, source, name, category, brand, address, confidence, {_XY.format(n=2**14)} FROM v_poi WHERE abs(lat) < 85) SELECT CAST(14 AS INTEGER) AS z, x, y, count(*) AS features FROM t GROUP BY ALL")
def l10_tile_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Features of each tile, counted in its bytes."""
    return vector_tiles.check_tiles(vector_tiles.bake(tile_features(spark, folder))).select("z", "x", "y", _c("found").cast("long").alias("features"))


@book(f"WITH {POIS}, t AS (SELECT DISTINCT key, lon, lat, source, name, category, brand, address, confidence, {_XY.format(n=2**14)} FROM v_poi WHERE abs(lat) < 85), c AS (SELECT x, y, count(*) AS n FROM t GROUP BY 1, 2) SELECT 'valid' AS verdict, count(*) AS tiles, sum(n) AS features FROM c")
def l11_l22_checked_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return vector_tiles.check_tiles(vector_tiles.bake(tile_features(spark, folder))).groupBy("verdict").agg(F.count("*").alias("tiles"), F.sum("found").alias("features"))


@book(
    """WITH {m} SELECT segment_id, arg_max(CASE WHEN speed_kmh >= 0.6e0 * free_flow_kmh THEN 'free' ELSE 'heavy' END, struct_pack(a := t, b := mt.id)) AS congestion, max(t) AS at FROM mt JOIN v_probe USING (id) JOIN v_seg USING (segment_id) WHERE speed_kmh IS NOT NULL GROUP BY 1""".replace("{m}", _MATCH)
)
def t10_stream_states(spark: SparkSession, folder: str) -> DataFrame:
    """The live state of each segment: every micro-batch of fixes is matched and upserted, the latest fix decides."""
    schema = spark.read.parquet(f"{folder}/observation.parquet").schema
    target = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    sink = streams.upsert_sink(target, ["segment_id"], "rank")
    roads = pieces(spark, folder)

    def update(batch: DataFrame, epoch: int) -> None:
        p = batch.select("id", "t", _c("lng").alias("lon"), "lat", (_c("speed") * 3.6).alias("speed_kmh")).where("speed_kmh is not null")
        hit = match_points(p, roads, MATCH_M).join(p, "id").join(roads.select("segment_id", "free_flow_kmh").distinct(), "segment_id")
        sink(hit.select("segment_id", F.struct("t", "id").alias("rank"), F.when(_c("speed_kmh") >= 0.6 * _c("free_flow_kmh"), "free").otherwise("heavy").alias("congestion"), _c("t").alias("at")), epoch)

    stream = spark.readStream.schema(schema).parquet(f"{folder}/observation.parquet*")
    query = stream.writeStream.foreachBatch(update).option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], "segment_id string, congestion string, at long")
    last = query.lastProgress["batchId"]
    return spark.read.parquet(f"{target}/version={last}").select("segment_id", "congestion", "at")


@book()
def v19_trace_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a whole ingest: fixes gated, truncated by the stream, stored by day; one row per source and outcome."""
    schema = spark.read.parquet(f"{folder}/observation.parquet").schema
    arrived = spark.readStream.schema(schema).parquet(f"{folder}/observation.parquet*").select("id", _c("trip_pseudonym").alias("trip"), "source", _c("lng").alias("lon"), "lat", "t", "speed", "accuracy")
    kept = gate(arrived).where("outcome = 'kept'").select("trip", "id", _c("g_t").alias("t"), _c("g_lon").alias("lon"), _c("g_lat").alias("lat"))
    out = streams.run_to_end(streams.truncate_stream(kept, idle_ms=None), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    all_ = gate(probes(spark, folder)).select("id", "source", "outcome")
    return all_.join(out.select("id", _c("outcome").alias("later")), "id", "left").groupBy("source", F.when(_c("outcome") != "kept", _c("outcome")).otherwise(F.coalesce("later", F.lit("pending"))).alias("outcome")).agg(F.count("*").alias("n"))
