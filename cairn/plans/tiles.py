"""Map tiles: coverage, visibility, selection, census, digests and releases; buses and stores of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cairn.functions import geo
from cairn.plans.base import POIS, TAGS_SQL, VERTICES, Book, picked, picked_sql, pois, tags, vertices
from cairn.plans.spatial import _RINGS, _XY, ring_vertices
from cairn.plans.traffic import _FACTS, facts
from cairn.storage import table

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col
# Zooms from which classes of roads and kinds of places show; floors of kinds; caps by zoom.
ROAD_ZOOM = {0: ["motorway", "trunk"], 9: ["primary"], 11: ["motorway_link", "trunk_link", "primary_link"], 12: ["secondary", "secondary_link"], 13: ["tertiary", "tertiary_link"], 14: ["residential", "unclassified", "living_street"], 15: ["service", "track", "pedestrian", "footway", "path", "cycleway", "steps", "bridleway"]}
KIND_FLOOR = {"coastline": 0.06, "water": 0.10, "park": 0.10, "natural": 0.05, "landuse": 0.08, "label": 0.04, "poi": 0.06}
POI_FLOOR, POI_ZOOMS = 0.35, (14, 15, 16)
ZOOM_CAP = {6: 12000, 7: 12000, 8: 10000, 9: 8000, 10: 6000, 11: 4000}


def _xy(lon: str, lat: str, z: int, name: str) -> str:
    return _XY.format(n=2**z).replace("lon ", f"{lon} ").replace("(lat)", f"({lat})").replace("AS x", f"AS {name}x").replace("AS y", f"AS {name}y")


@book(f"""WITH {VERTICES}, b AS (SELECT segment_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM v_vertex GROUP BY 1), t AS (SELECT segment_id, {_xy('w', 'n', 15, 'a')}, {_xy('e', 's', 15, 'b_')} FROM b)
SELECT x, y, count(*) AS features FROM (SELECT segment_id, x, unnest(range(ay, b_y + 1)) AS y FROM (SELECT segment_id, unnest(range(ax, b_x + 1)) AS x, ay, b_y FROM t) q) r GROUP BY 1, 2""")
def l1_l5_tile_coverage(spark: SparkSession, folder: str, zoom: int = 15) -> DataFrame:
    b = vertices(spark, folder).groupBy("segment_id").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    (ax, ay), (bx, by) = geo.tile("w", "n", zoom), geo.tile("e", "s", zoom)
    t = b.select("segment_id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    t = t.withColumn("x", F.explode(F.sequence("ax", "bx"))).withColumn("y", F.explode(F.sequence("ay", "by")))
    return t.groupBy(_c("x").cast("long").alias("x"), _c("y").cast("long").alias("y")).agg(F.count("*").alias("features"))


_MINZ = "CASE " + " ".join(f"WHEN lower(highway) IN ({', '.join(repr(c) for c in v)}) THEN {z}" for z, v in ROAD_ZOOM.items()) + " ELSE 14 END"


def least_zoom(highway):
    out = None
    for z, classes in ROAD_ZOOM.items():
        test = F.lower(highway).isin(classes)
        out = F.when(test, z) if out is None else out.when(test, z)
    return out.otherwise(14)


@book(f"WITH {TAGS_SQL}, z AS (SELECT z FROM range(6, 17) t(z)) SELECT z, count(*) AS visible FROM v_tags, z WHERE z >= {_MINZ} GROUP BY 1")
def l2_zoom_visibility(spark: SparkSession, folder: str) -> DataFrame:
    z = tags(spark, folder).select(F.explode(F.array(*[F.when(F.lit(k) >= least_zoom(_c("highway")), F.lit(k)) for k in range(6, 17)])).alias("z"))
    return z.where("z is not null").groupBy(_c("z").cast("long").alias("z")).agg(F.count("*").alias("visible"))


_KINDS = ["road", "road", "water", "park", "poi", "poi", "label", "landuse", "building", "natural"]
_FEAT = f"""v_f AS (SELECT o_orderkey AS id, CAST(o_custkey % 6 AS BIGINT) AS tile, {picked_sql('o_orderkey', _KINDS)} AS kind, o_orderpriority AS name, CAST(substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12) AS VARCHAR) AS tie FROM orders)"""


def features(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(_c("o_orderkey").alias("id"), (_c("o_custkey") % 6).alias("tile"), picked("o_orderkey", _KINDS).alias("kind"), _c("o_orderpriority").alias("name"), F.substring(F.sha2(_c("o_orderkey").cast("string"), 256), 1, 12).alias("tie"))


def select_for_tiles(rows: DataFrame, cap: int, zoom: int | None, order: list, parts: int = 64) -> DataFrame:
    """At most cap rows (tile, kind, ...) per tile: first what each kind is sure of, then the best of the rest.

    Rows beyond the cap within a hash part of a tile can never be chosen, so each part is cut to cap rows
    before a tile's rows come together: a hot tile costs parts * cap rows, not all of its own.
    """
    floors = dict(KIND_FLOOR) | ({"poi": POI_FLOOR} if zoom in POI_ZOOMS else {})
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    rows = rows.withColumn("part", part)
    near = rows.withColumn("k", F.row_number().over(W.partitionBy("tile", "kind", "part").orderBy(*order))).where(_c("k") <= cap).drop("k", "part")
    sure = F.element_at(F.create_map(*[F.lit(x) for k, v in floors.items() for x in (k, int(cap * v))]), F.coalesce("kind", F.lit("other")))
    ranked = near.withColumn("in_kind", F.row_number().over(W.partitionBy("tile", "kind").orderBy(*order)))
    ranked = ranked.withColumn("first", _c("in_kind") <= F.coalesce(sure, F.lit(0)))
    counts = W.partitionBy("tile")
    ranked = ranked.withColumn("taken", F.sum(_c("first").cast("int")).over(counts)).withColumn("rest", F.row_number().over(W.partitionBy("tile", "first").orderBy(*order)))
    return ranked.where(_c("first") | (_c("rest") <= F.lit(cap) - _c("taken")))


_FLOORS = dict(KIND_FLOOR) | {"poi": POI_FLOOR}
_SHARE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {int(400 * v)}" for k, v in _FLOORS.items()) + " ELSE 0 END"


@book(f"""WITH {_FEAT}, a AS (SELECT *, row_number() OVER (PARTITION BY tile, kind ORDER BY name, tie) AS k FROM v_f), s AS (SELECT *, k <= {_SHARE} AS sure FROM a), n AS (SELECT *, sum(sure::INT) OVER (PARTITION BY tile) AS taken, row_number() OVER (PARTITION BY tile, sure ORDER BY name, tie) AS rest FROM s)
SELECT tile, kind, count(*) AS n, min(tie) AS first_tie, max(tie) AS last_tie FROM n WHERE sure OR rest <= 400 - taken GROUP BY 1, 2""")
def l3_l8_l9_selection(spark: SparkSession, folder: str) -> DataFrame:
    chosen = select_for_tiles(features(spark, folder), 400, 14, ["name", "tie"])
    return chosen.groupBy("tile", "kind").agg(F.count("*").alias("n"), F.min("tie").alias("first_tie"), F.max("tie").alias("last_tie"))


@book("SELECT z, greatest(2000, CASE z " + " ".join(f"WHEN {z} THEN {v}" for z, v in ZOOM_CAP.items()) + " ELSE 0 END) AS cap, CASE WHEN z BETWEEN 14 AND 16 THEN 0.35e0 ELSE 0.06e0 END AS poi_floor FROM range(4, 18) t(z)")
def l4_l6_caps(spark: SparkSession, folder: str) -> DataFrame:
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in ZOOM_CAP.items() for x in kv]), _c("id").cast("int"))
    return spark.range(4, 18).select(_c("id").alias("z"), F.greatest(F.lit(2000), F.coalesce(cap, F.lit(0))).alias("cap"), F.when(_c("id").between(14, 16), POI_FLOOR).otherwise(KIND_FLOOR["poi"]).alias("poi_floor"))


@book(f"WITH {_FACTS}, t AS (SELECT fact_key, confidence < 0.95e0 AS provisional, {_XY.format(n=2 ** 14)} FROM v_fact WHERE confidence >= 0.6e0) SELECT x, y, count(*) AS facts, count(*) FILTER (WHERE provisional) AS provisional FROM t GROUP BY 1, 2")
def l13_learned_tiles(spark: SparkSession, folder: str) -> DataFrame:
    x, y = geo.tile("lon", "lat", 14)
    return facts(spark, folder).where("confidence >= 0.6").groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("facts"), F.count(F.when(_c("confidence") < 0.95, 1)).alias("provisional"))


_BAKED = f"{POIS}, bk AS (SELECT x, y, count(*) AS n, string_agg(key, ',' ORDER BY key) AS body FROM (SELECT key, {_XY.format(n=2 ** 13)} FROM v_poi) q GROUP BY 1, 2), tl AS (SELECT x || '/' || y AS path, n, sha256(body) AS digest, length(body) AS bytes FROM bk)"


def baked(spark: SparkSession, folder: str) -> DataFrame:
    """path, features, digest and size of the body of each tile of places."""
    x, y = geo.tile("lon", "lat", 13)
    g = pois(spark, folder).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("key")), ",").alias("body"))
    return g.select(F.concat_ws("/", "x", "y").alias("path"), "n", F.sha2("body", 256).alias("digest"), F.length("body").cast("long").alias("bytes"))


@book(f"WITH {_BAKED}, b AS (SELECT substr(sha256(path), 1, 2) AS bucket, sha256(string_agg(path || chr(9) || digest || chr(9) || bytes, chr(10) ORDER BY path)) AS digest FROM tl GROUP BY 1) SELECT count(*) AS buckets, sha256(string_agg(bucket || chr(9) || digest, chr(10) ORDER BY bucket)) AS tree FROM b")
def l16_tree_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of a tree in two levels: 256 buckets of paths, then the buckets, so that no task gathers all paths."""
    line = F.concat_ws("\t", "path", "digest", "bytes")
    b = baked(spark, folder).groupBy(F.substring(F.sha2("path", 256), 1, 2).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("xs"))
    b = b.select("bucket", F.sha2(F.array_join(F.transform("xs", lambda s: s["line"]), "\n"), 256).alias("digest"))
    top = b.agg(F.count("*").alias("buckets"), F.array_sort(F.collect_list(F.struct("bucket", F.concat_ws("\t", "bucket", "digest").alias("line")))).alias("xs"))  # 256 rows
    return top.select("buckets", F.sha2(F.array_join(F.transform("xs", lambda s: s["line"]), "\n"), 256).alias("tree"))


@book(f"WITH {_FEAT} SELECT tile, kind, count(*) AS n, count(DISTINCT name) AS names FROM v_f GROUP BY GROUPING SETS ((tile), (kind), (tile, kind), ())")
def l17_census(spark: SparkSession, folder: str) -> DataFrame:
    return features(spark, folder).groupingSets([[_c("tile")], [_c("kind")], [_c("tile"), _c("kind")], []], "tile", "kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names")).select("tile", "kind", "n", "names")


@book(f"WITH {_BAKED}, r AS (SELECT path, split_part(path, '/', 1) AS x, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY sha256(path), path) AS k FROM tl WHERE bytes > 0) SELECT x, path FROM r WHERE k <= 2")
def l18_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = baked(spark, folder).where("bytes > 0").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("x"), "path", F.sha2("path", 256).alias("h"))
    best = rows.groupBy("x").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "path"))), 1, 2).alias("xs"))
    return best.select("x", F.explode("xs.path").alias("path"))


_MANI = f"{_BAKED}, have AS (SELECT path, CASE WHEN ascii(digest) % 7 = 0 THEN 'changed' ELSE digest END AS digest FROM tl WHERE ascii(substr(digest, 2, 1)) % 5 <> 0 UNION ALL SELECT 'extra/' || path, digest FROM tl WHERE ascii(substr(digest, 3, 1)) % 9 = 0)"


@book(f"WITH {_MANI} SELECT CASE WHEN h.path IS NULL THEN 'missing_tile' WHEN t.path IS NULL THEN 'extra_tile' WHEN h.digest <> t.digest THEN 'mutated_tile' ELSE 'ok' END AS code, count(*) AS n FROM tl t FULL JOIN have h ON t.path = h.path GROUP BY 1")
def l19_manifest_verify(spark: SparkSession, folder: str) -> DataFrame:
    t = baked(spark, folder).select("path", "digest")
    have = t.where(F.ascii(F.substring("digest", 2, 1)) % 5 != 0).select("path", F.when(F.ascii("digest") % 7 == 0, "changed").otherwise(_c("digest")).alias("got"))
    have = have.unionByName(t.where(F.ascii(F.substring("digest", 3, 1)) % 9 == 0).select(F.concat(F.lit("extra/"), "path").alias("path"), _c("digest").alias("got")))
    both = t.join(have, "path", "full")
    return both.groupBy(F.when(_c("got").isNull(), "missing_tile").when(_c("digest").isNull(), "extra_tile").when(_c("got") != _c("digest"), "mutated_tile").otherwise("ok").alias("code")).agg(F.count("*").alias("n"))


@book("WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'r' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '-e' || p_size WHEN 1 THEN 'R12-e3' WHEN 2 THEN 'r000001-e0' ELSE p_name END AS rid FROM part) SELECT id, regexp_full_match(rid, 'r[0-9]{6}-e[1-9][0-9]*') AS publishable, try_cast(nullif(regexp_extract(rid, '^r([0-9]{6})-e[0-9]+$', 1), '') AS BIGINT) AS number, try_cast(nullif(regexp_extract(rid, '^r[0-9]{6}-e([0-9]+)$', 1), '') AS BIGINT) AS epoch FROM r")
def l20_release_ids(spark: SparkSession, folder: str) -> DataFrame:
    k = _c("p_partkey") % 4
    rid = F.when(k == 0, F.concat(F.lit("r"), F.lpad(_c("p_partkey").cast("string"), 6, "0"), F.lit("-e"), _c("p_size").cast("string"))).when(k == 1, "R12-e3").when(k == 2, "r000001-e0").otherwise(_c("p_name"))
    part = lambda shape: F.nullif(F.regexp_extract("rid", shape, 1), F.lit("")).try_cast("long")
    r = table(spark, folder, "part").select(_c("p_partkey").alias("id"), rid.alias("rid"))
    return r.select("id", _c("rid").rlike("^r[0-9]{6}-e[1-9][0-9]*$").alias("publishable"), part("^r([0-9]{6})-e[0-9]+$").alias("number"), part("^r[0-9]{6}-e([0-9]+)$").alias("epoch"))


_ARMS = f"""{VERTICES}, nd AS (SELECT segment_id, seq, CAST(floor(lon / 0.002e0) AS BIGINT) AS nx, CAST(floor(lat / 0.002e0) AS BIGINT) AS ny, max(seq) OVER (PARTITION BY segment_id) AS last FROM v_vertex), ar AS (SELECT nx, ny, sum(CASE WHEN seq IN (0, last) THEN 1 ELSE 2 END) AS arms, count(DISTINCT segment_id) AS ways FROM nd GROUP BY 1, 2)"""


@book(f"WITH {_ARMS} SELECT nx, ny, CAST(arms AS BIGINT) AS arms, ways FROM ar WHERE arms >= 3 AND ways >= 2")
def l24_junctions(spark: SparkSession, folder: str) -> DataFrame:
    v = vertices(spark, folder)
    ends = v.groupBy("segment_id").agg(F.max("seq").alias("last"))
    n = v.join(ends, "segment_id").withColumn("arm", F.when((_c("seq") == 0) | (_c("seq") == _c("last")), 1).otherwise(2))
    return n.groupBy(F.floor(_c("lon") / 0.002).alias("nx"), F.floor(_c("lat") / 0.002).alias("ny")).agg(F.sum("arm").alias("arms"), F.countDistinct("segment_id").alias("ways")).where("arms >= 3 and ways >= 2")


@book(f"WITH {_ARMS}, w AS (SELECT nx, ny, segment_id, max(free_flow_kmh) AS width FROM nd JOIN v_seg USING (segment_id) WHERE seq IN (0, last) GROUP BY 1, 2, 3) SELECT nx, ny, min(width) AS narrow, max(width) AS wide FROM w GROUP BY 1, 2 HAVING count(*) = 2 AND min(width) <> max(width)")
def l27_tapers(spark: SparkSession, folder: str) -> DataFrame:
    v = vertices(spark, folder)
    last = v.groupBy("segment_id").agg(F.max("seq").alias("last"))
    ends = v.join(last, "segment_id").where((_c("seq") == 0) | (_c("seq") == _c("last"))).groupBy(F.floor(_c("lon") / 0.002).alias("nx"), F.floor(_c("lat") / 0.002).alias("ny"), "segment_id").agg(F.max("free_flow_kmh").alias("width"))
    return ends.groupBy("nx", "ny").agg(F.count("*").alias("n"), F.min("width").alias("narrow"), F.max("width").alias("wide")).where("n = 2 and narrow <> wide").drop("n")


@book(f"WITH {_RINGS} SELECT count(DISTINCT id) AS features, count(*) AS vertices, min(x) AS w, min(y) AS s, max(x) AS e, max(y) AS n FROM rxy")
def o21_conversion_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ring_vertices(spark, folder).agg(F.countDistinct("id").alias("features"), F.count("*").alias("vertices"), F.min("x").alias("w"), F.min("y").alias("s"), F.max("x").alias("e"), F.max("y").alias("n"))


@book("SELECT id, geometry_type, json_extract_string(properties, '$.kind') AS kind, json_extract_string(properties, '$.name') AS name FROM (SELECT id, arg_max(geometry_type, struct_pack(a := created_at, b := geom, c := coalesce(properties, ''))) AS geometry_type, arg_max(properties, struct_pack(a := created_at, b := geom, c := coalesce(properties, ''))) AS properties FROM vector_features GROUP BY id) q")
def o12_o13_feature_store(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each feature, its properties read from JSON."""
    f = table(spark, folder, "vector_features").groupBy("id").agg(F.max_by(F.struct("geometry_type", "properties"), F.struct("created_at", "geom", F.coalesce("properties", F.lit("")))).alias("m"))
    return f.select("id", "m.geometry_type", F.get_json_object("m.properties", "$.kind").alias("kind"), F.get_json_object("m.properties", "$.name").alias("name"))


@book("SELECT id, kind, CASE WHEN lon IS NULL OR lat IS NULL THEN 'bad' WHEN NOT (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90) THEN 'bad' ELSE 'kept' END AS outcome FROM (SELECT DISTINCT osm_key AS id, category AS kind, lon, lat FROM poi_osm) q")
def o16_catalog_reader(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "poi_osm").select(_c("osm_key").alias("id"), _c("category").alias("kind"), "lon", "lat").distinct()
    good = _c("lon").between(-180, 180) & _c("lat").between(-90, 90)
    return rows.select("id", "kind", F.when(good, "kept").otherwise("bad").alias("outcome"))


@book("WITH p AS (SELECT day, lng || ',' || lat || CASE WHEN speed IS NULL THEN '' ELSE ',' || speed END AS x FROM observation) SELECT day, count(*) AS probes, count(*) FILTER (WHERE len(string_split(x, ',')) = 3) AS with_speed, count(*) FILTER (WHERE try_cast(split_part(x, ',', 1) AS DOUBLE) BETWEEN 50.5 AND 52) AS inside FROM p GROUP BY 1")
def o18_query_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Probes written and read again in the notation LON,LAT[,S] of a request."""
    p = table(spark, folder, "observation").select("day", F.split(F.concat_ws(",", "lng", "lat", "speed"), ",").alias("xs"))
    lon = F.element_at("xs", 1).try_cast("double")
    return p.groupBy("day").agg(F.count("*").alias("probes"), F.count(F.when(F.size("xs") == 3, 1)).alias("with_speed"), F.count(F.when(lon.between(50.5, 52), 1)).alias("inside"))


# --- bus --------------------------------------------------------------------------------------------

_INTENTS = ["navigate", "congestion", "traffic", None, "alert", "unknown"]
_CHANNELS = {"navigate": "#tasks", "congestion": "#broadcast", "traffic": "#broadcast", "alert": "#alerts"}
_ENV = f"""v_env AS (SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'c' || user_id END AS correlation_id, {picked_sql('event_id', _INTENTS)} AS intent, event_id % 4 AS priority, CASE WHEN event_id % 13 = 0 THEN -5 ELSE 100 + (event_id * 31) % 900 END AS sla_ms, epoch_ms(ts) AS sent, epoch_ms(ts) + (event_id * 97) % 1200 AS answered FROM events)"""


def envelopes(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    ms = F.floor(F.unix_micros(_c("ts").cast("timestamp")) / 1000)
    k = _c("event_id")
    return e.select(k.alias("id"), F.when(k % 17 != 0, F.concat(F.lit("c"), _c("user_id").cast("string"))).alias("correlation_id"), picked("event_id", _INTENTS).alias("intent"), (k % 4).alias("priority"), F.when(k % 13 == 0, F.lit(-5)).otherwise(100 + (k * 31) % 900).alias("sla_ms"), ms.alias("sent"), (ms + (k * 97) % 1200).alias("answered"))


_BAD = f"CASE WHEN correlation_id IS NULL THEN 'missing_field' WHEN intent IS NULL OR intent NOT IN ({', '.join(repr(k) for k in _CHANNELS)}) THEN 'bad_intent' WHEN sla_ms <= 0 THEN 'bad_sla' ELSE 'ok' END"


def envelope_fault(rows: DataFrame) -> DataFrame:
    """rows with verdict, the first fault of an envelope or ok, and the channel its intent goes to."""
    fault = F.when(_c("correlation_id").isNull(), "missing_field").when(_c("intent").isNull() | ~_c("intent").isin(list(_CHANNELS)), "bad_intent").when(_c("sla_ms") <= 0, "bad_sla").otherwise("ok")
    channel = F.element_at(F.create_map(*[F.lit(x) for kv in _CHANNELS.items() for x in kv]), F.coalesce("intent", F.lit("")))
    return rows.withColumns({"verdict": fault, "channel": F.coalesce(channel, F.lit("#dead-letter"))})


@book(f"WITH {_ENV}, v AS (SELECT {_BAD} AS verdict, coalesce(CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CHANNELS.items()) + " END, '#dead-letter') AS channel, answered - sent > sla_ms AS late FROM v_env) SELECT verdict, channel, count(*) AS n, count(*) FILTER (WHERE verdict = 'ok' AND late) AS breaches FROM v GROUP BY 1, 2")
def o23_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    rows = envelope_fault(envelopes(spark, folder))
    late = (_c("verdict") == "ok") & (_c("answered") - _c("sent") > _c("sla_ms"))
    return rows.groupBy("verdict", "channel").agg(F.count("*").alias("n"), F.count(F.when(late, 1)).alias("breaches"))


@book(f"""WITH {_ENV} SELECT id, json_object('id', id, 'intent', intent, 'sla_ms', sla_ms) AS body FROM v_env WHERE {_BAD} = 'ok'""")
def o24_envelope_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return envelope_fault(envelopes(spark, folder)).where("verdict = 'ok'").select("id", F.to_json(F.struct("id", "intent", "sla_ms")).alias("body"))
