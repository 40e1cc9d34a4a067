"""Classification predicates and values of map tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import tags as T
from cairn.plans.base import TAGS_SQL, Book, r_sql, rounded, tags

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col
_quoted = lambda values: ", ".join(f"'{v}'" for v in values)
_tag = lambda c: f"lower(trim({c}))"


def _ladder(columns: list[str]) -> str:
    out = "FALSE"
    for c in reversed(columns):
        out = f"CASE WHEN {_tag(c)} IN ({_quoted(T.ALLOWED)}) THEN FALSE WHEN {_tag(c)} IN ({_quoted(T.DENIED)}) THEN TRUE ELSE {out} END"
    return out


_THERE = f"coalesce({_tag('highway')}, '') <> '' AND {_tag('highway')} NOT IN ({_quoted(T.UNBUILT_CLASSES)}) AND coalesce({_tag('construction')}, '') = ''"
_CAR = f"coalesce({_THERE} AND {_tag('highway')} IN ({_quoted(T.CAR_CLASSES)}) AND NOT ({_ladder(['motorcar', 'motor_vehicle', 'vehicle', 'access'])}), FALSE)"
_FOOT = f"coalesce({_THERE} AND CASE WHEN {_tag('highway')} IN ({_quoted(T.FOOT_CLASSES)}) THEN NOT ({_ladder(['foot', 'access'])}) ELSE coalesce({_tag('foot')} IN ('yes', 'designated'), FALSE) END, FALSE)"


def _car(t: DataFrame):
    return T.car_routable(*[_c(c) for c in ("highway", "construction", "motorcar", "motor_vehicle", "vehicle", "access")])


def _foot(t: DataFrame):
    return T.foot_routable(*[_c(c) for c in ("highway", "construction", "foot", "access")])


@book(f"WITH {TAGS_SQL} SELECT id, {_CAR} AS car FROM v_tags")
def n1_car_routable(spark: SparkSession, folder: str) -> DataFrame:
    t = tags(spark, folder)
    return t.select("id", _car(t).alias("car"))


@book(f"WITH {TAGS_SQL} SELECT id, {_FOOT} AS foot_ok FROM v_tags")
def n2_foot_routable(spark: SparkSession, folder: str) -> DataFrame:
    t = tags(spark, folder)
    return t.select("id", _foot(t).alias("foot_ok"))


@book(f"WITH {TAGS_SQL}, c AS (SELECT coalesce({_tag('highway')}, '') <> '' AS renderable, {_CAR} AS car, {_FOOT} AS foot_ok FROM v_tags) SELECT renderable, car, foot_ok, count(*) AS n FROM c GROUP BY ALL")
def n3_classify(spark: SparkSession, folder: str) -> DataFrame:
    t = tags(spark, folder)
    return t.select(T.renderable(_c("highway")).alias("renderable"), _car(t).alias("car"), _foot(t).alias("foot_ok")).groupBy("renderable", "car", "foot_ok").agg(F.count("*").alias("n"))


@book(
    f"WITH {TAGS_SQL} SELECT id, CASE WHEN {_tag('foot')} IN ({_quoted(T.ALLOWED)}) THEN 'pass' WHEN {_tag('foot')} IN ({_quoted(T.DENIED)}) THEN 'block' WHEN {_tag('access')} IN ({_quoted(T.DENIED)}) THEN 'block' "
    f"WHEN {_tag('locked')} IN ({_quoted(T.LOCKED)}) THEN 'block' WHEN {_tag('barrier')} IN ({_quoted(T.SOLID_BARRIERS)}) THEN 'block' ELSE 'pass' END AS effect FROM v_tags WHERE barrier IS NOT NULL"
)
def n4_barrier_effect(spark: SparkSession, folder: str) -> DataFrame:
    return tags(spark, folder).where("barrier is not null").select("id", T.barrier_effect(*[_c(c) for c in ("foot", "access", "locked", "barrier")]).alias("effect"))




@book(f"""WITH {TAGS_SQL} SELECT id, CASE WHEN starts_with({_tag('highway')}, 'motorway') OR starts_with({_tag('highway')}, 'trunk') OR starts_with({_tag('highway')}, 'primary') THEN 'major'
  WHEN {_tag('highway')} IN ('footway', 'path', 'steps', 'pedestrian', 'cycleway') THEN 'foot' WHEN highway IS NULL THEN 'none' ELSE 'minor' END AS tier FROM v_tags""")
def n5_prefix_tier(spark: SparkSession, folder: str) -> DataFrame:
    hw = T.tag(_c("highway"))
    tier = F.when(hw.startswith("motorway") | hw.startswith("trunk") | hw.startswith("primary"), "major").when(hw.isin("footway", "path", "steps", "pedestrian", "cycleway"), "foot").when(_c("highway").isNull(), "none").otherwise("minor")
    return tags(spark, folder).select("id", tier.alias("tier"))


_PARSED = r"""v_s AS (SELECT id, lower(trim(maxspeed)) AS s, highway, service FROM v_tags),
v_p AS (SELECT *, try_cast(nullif(regexp_extract(s, '^([-+]?\d+)\s+(mph|km/h)$', 1), '') AS INTEGER) AS i, try_cast(nullif(regexp_extract(s, '^([-+]?(?:\d+\.?\d*|\.\d+))\s+(mph|km/h)$', 1), '') AS DOUBLE) AS d,
  regexp_extract(s, '\s(mph|km/h)$', 1) AS unit, s IN ('none', 'signals', 'walk', '') AS word FROM v_s),
v_m AS (SELECT *,
  CASE WHEN word THEN NULL WHEN regexp_full_match(s, '[-+]?\d+') THEN try_cast(s AS INTEGER) WHEN unit = 'mph' THEN CAST(trunc(i * 1.60934e0) AS INTEGER) WHEN unit = 'km/h' THEN i END AS whole,
  CASE WHEN word THEN NULL WHEN regexp_full_match(s, '[-+]?(\d+\.?\d*|\.\d+)') THEN try_cast(s AS DOUBLE) WHEN unit = 'mph' THEN d * 1.60934e0 WHEN unit = 'km/h' THEN d END AS signed,
  CASE WHEN s IN ('none', 'signals', 'walk', 'variable', '') THEN NULL WHEN contains(s, 'mph') THEN CAST(round_even(try_cast(regexp_extract(s, '(\d+)', 1) AS INTEGER) * 1.60934e0, 0) AS INTEGER)
       ELSE try_cast(nullif(regexp_extract(s, '(\d+)', 1), '') AS INTEGER) END AS lenient FROM v_p)"""


@book(f"WITH {TAGS_SQL}, {_PARSED} SELECT id, whole, CASE WHEN signed > 0 THEN {r_sql('signed')} END AS positive, {r_sql('signed')} AS signed, lenient FROM v_m")
def n6_maxspeed_variants(spark: SparkSession, folder: str) -> DataFrame:
    s = _c("maxspeed")
    return tags(spark, folder).select("id", T.maxspeed_int(s).alias("whole"), rounded(T.maxspeed_float(s)).alias("positive"), rounded(T.maxspeed_float(s, False)).alias("signed"), T.maxspeed_lenient(s).alias("lenient"))


def _case(table: dict[str, float], key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in table.items()) + f" ELSE {default} END"


_DEFAULT_KMH = f"coalesce(CASE WHEN lower(trim(highway)) = 'service' THEN {_case(T.SERVICE_KMH, 'lower(trim(service))', 'NULL')} END, {_case(T.CLASS_KMH, 'lower(trim(highway))', '30e0')})"


@book(f"WITH {TAGS_SQL}, {_PARSED} SELECT id, {r_sql(f'coalesce(CASE WHEN signed > 0 THEN signed END, {_DEFAULT_KMH})')} AS kmh, {r_sql(f'greatest(coalesce(CASE WHEN signed > 0 THEN signed END, {_DEFAULT_KMH}) / 3.6e0, 1e0)')} AS ms, CASE WHEN lower(trim(highway)) = 'steps' THEN 0.5e0 ELSE 1.35e0 END AS walk_ms FROM v_m")
def r6_effective_speed(spark: SparkSession, folder: str) -> DataFrame:
    kmh = T.effective_kmh(_c("highway"), _c("service"), _c("maxspeed"))
    return tags(spark, folder).select("id", rounded(kmh).alias("kmh"), rounded(F.greatest(kmh / 3.6, F.lit(1.0))).alias("ms"), T.walk_ms(_c("highway")).alias("walk_ms"))


@book(r"""WITH h AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) || ' m' WHEN 2 THEN CAST(p_size * 20 AS VARCHAR) WHEN 3 THEN CAST(p_size AS VARCHAR) || ' ft' WHEN 4 THEN '-' || CAST(p_size AS VARCHAR) END AS raw, p_partkey % 40 AS low FROM part),
n AS (SELECT *, try_cast(regexp_replace(lower(trim(raw)), '\s*m$', '') AS DOUBLE) AS v FROM h), ok AS (SELECT id, low, CASE WHEN v > 0 AND v <= 400 THEN v END AS height_m FROM n)
SELECT id, height_m, CASE WHEN low < height_m AND low > 0 THEN CAST(low AS DOUBLE) END AS min_height_m FROM ok""")
def n8_building_height(spark: SparkSession, folder: str) -> DataFrame:
    p = spark.read.parquet(f"{folder}/part.parquet")
    size = _c("p_size").cast("string")
    k = _c("p_partkey") % 6
    raw = F.when(k == 0, size).when(k == 1, F.concat(size, F.lit(" m"))).when(k == 2, (_c("p_size") * 20).cast("string")).when(k == 3, F.concat(size, F.lit(" ft"))).when(k == 4, F.concat(F.lit("-"), size))
    v = F.regexp_replace(F.lower(F.trim(raw)), r"\s*m$", "").try_cast("double")
    rows = p.select(_c("p_partkey").alias("id"), (_c("p_partkey") % 40).alias("low"), F.when((v > 0) & (v <= 400), v).alias("height_m"))
    return rows.select("id", "height_m", F.when((_c("low") < _c("height_m")) & (_c("low") > 0), _c("low").cast("double")).alias("min_height_m"))


@book(f"WITH {TAGS_SQL}, c AS (SELECT {_CAR} AS car, {_FOOT} AS walk FROM v_tags WHERE highway IS NOT NULL) SELECT 'car' AS graph, count(*) AS ways FROM c WHERE car UNION ALL SELECT 'foot', count(*) FROM c WHERE walk")
def n12_graph_split(spark: SparkSession, folder: str) -> DataFrame:
    t = tags(spark, folder).where("highway is not null")
    both = t.select(F.explode(F.array_compact(F.array(F.when(_car(t), F.lit("car")), F.when(_foot(t), F.lit("foot"))))).alias("graph"))
    return both.groupBy("graph").agg(F.count("*").alias("ways"))


@book("""WITH o AS (SELECT CASE WHEN name IS NULL OR trim(name) = '' THEN 'no_name' WHEN coalesce(confidence, 0e0) < 0.2e0 AND confidence IS NOT NULL THEN 'low_confidence' WHEN lon IS NULL OR lat IS NULL THEN 'no_geometry' ELSE 'kept' END AS outcome,
  coalesce(CAST(floor(confidence * 10e0 + 1e-9) AS BIGINT), -1) AS bucket FROM poi_overture) SELECT outcome, bucket, count(*) AS n FROM o GROUP BY ALL""")
def n13_overture_filter(spark: SparkSession, folder: str) -> DataFrame:
    o = spark.read.parquet(f"{folder}/poi_overture.parquet")
    outcome = F.when(_c("name").isNull() | (F.trim("name") == ""), "no_name").when(_c("confidence") < 0.2, "low_confidence").when(_c("lon").isNull() | _c("lat").isNull(), "no_geometry").otherwise("kept")
    return o.groupBy(outcome.alias("outcome"), F.coalesce(F.floor(_c("confidence") * 10 + 1e-9), F.lit(-1)).alias("bucket")).agg(F.count("*").alias("n"))


_LANES = """WITH {tags}, x AS (SELECT id, turn_lanes, string_split(turn_lanes, '|') AS parts, try_cast(lanes AS INTEGER) AS lanes FROM v_tags)
SELECT id, len(parts) AS n_lanes, lanes, len(list_filter(parts, lambda p: contains(p, 'left'))) AS left_lanes, len(list_filter(parts, lambda p: contains(p, 'right'))) AS right_lanes,
  len(list_filter(parts, lambda p: p IN ('', 'none'))) AS open_lanes, len(list_filter(parts, lambda p: NOT contains(p, ';') AND p NOT IN ('', 'none'))) AS dedicated,
  array_to_string(list_reverse(parts), '|') AS mirrored FROM x WHERE turn_lanes IS NOT NULL""".replace("{tags}", TAGS_SQL)


@book(_LANES)
def m4_turn_lanes(spark: SparkSession, folder: str) -> DataFrame:
    rows = tags(spark, folder).where("turn_lanes is not null").withColumn("parts", F.split("turn_lanes", r"\|"))
    many = lambda test: F.size(F.filter("parts", test)).cast("long")
    return rows.select(
        "id", F.size("parts").cast("long").alias("n_lanes"), _c("lanes").try_cast("int").alias("lanes"), many(lambda p: p.contains("left")).alias("left_lanes"), many(lambda p: p.contains("right")).alias("right_lanes"),
        many(lambda p: p.isin("", "none")).alias("open_lanes"), many(lambda p: ~p.contains(";") & ~p.isin("", "none")).alias("dedicated"), F.array_join(F.reverse("parts"), "|").alias("mirrored"),
    )
