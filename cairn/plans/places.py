"""Place reconciliation and geocoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cairn.functions import geo, names as N
from cairn.functions.tags import lookup
from cairn.operators import cells, sequential as S
from cairn.operators.spatial import bucket_join, padded
from cairn.plans.base import PIECES, POIS, Book, pieces, pois, r_sql, rounded
from cairn.plans.spatial import haversine_sql, incident_points, _INC
from cairn.storage import table

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col
_quoted = lambda values: ", ".join("'" + v + "'" for v in values)
_NORM = f"{POIS}, v_n AS (SELECT *, {N.normalize_sql('name')} AS norm FROM v_poi WHERE name IS NOT NULL AND trim(name) <> '')"
_WORDS = f"list_filter(string_split(norm, ' '), lambda w: w <> '' AND w NOT IN ({_quoted(N.STOPWORDS)}))"


def named(spark: SparkSession, folder: str) -> DataFrame:
    return pois(spark, folder).where("name is not null and trim(name) <> ''").withColumn("norm", N.normalize(_c("name")))


@book(f"WITH {_NORM} SELECT key, norm, array_to_string({_WORDS}, ' ') AS words FROM v_n")
def poi5_poi6_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return named(spark, folder).select("key", "norm", F.array_join(N.tokens(_c("norm")), " ").alias("words"))


_QUALITY = f"""CASE WHEN name IS NULL OR trim(name) = '' OR norm = '' THEN 0e0 WHEN length(norm) < 3 THEN 0.1e0 WHEN len({_WORDS}) = 0 THEN 0.1e0
 WHEN NOT contains(norm, ' ') AND norm IN ({_quoted(N.GENERIC)}) THEN greatest(least(1e0, 0.45e0 + 0.10e0 * length(norm)) * 0.25e0, 0.2e0) ELSE least(1e0, 0.45e0 + 0.10e0 * length(norm)) END"""


@book(f"WITH {_NORM} SELECT key, {r_sql(_QUALITY)} AS quality FROM v_n")
def poi15_name_quality(spark: SparkSession, folder: str) -> DataFrame:
    return named(spark, folder).select("key", rounded(N.quality(_c("name"))).alias("quality"))


# Families of category terms; other terms are read by their ending.
FAMILIES = {
    "restaurant": "FOOD", "fast_food": "FOOD", "cafe": "FOOD", "coffee_shop": "FOOD", "fast_food_restaurant": "FOOD", "burger_restaurant": "FOOD", "pharmacy": "HEALTHCARE", "drugstore": "HEALTHCARE", "clinic": "HEALTHCARE",
    "doctor": "HEALTHCARE", "medical_clinic": "HEALTHCARE", "hotel": "LODGING", "accommodation": "LODGING", "bank": "FINANCE", "banks": "FINANCE", "bank_credit_union": "FINANCE", "atm": "FINANCE", "atms": "FINANCE",
    "car_repair": "SERVICES", "automotive_repair": "SERVICES", "auto_body_shop": "SERVICES", "hairdresser": "SERVICES", "beauty_salon": "SERVICES", "hair_salon": "SERVICES", "school": "EDUCATION", "elementary_school": "EDUCATION",
    "place_of_worship": "RELIGIOUS", "mosque": "RELIGIOUS", "supermarket": "SHOPPING", "grocery_store": "SHOPPING", "shop": "SHOPPING", "fuel": "TRANSPORT", "gas_station": "TRANSPORT", "park": "ATTRACTION", "bench": "MAP_FURNITURE",
}
ENDINGS = {"_restaurant": "FOOD", "_store": "SHOPPING", "_shop": "SHOPPING", "_school": "EDUCATION", "_station": "TRANSPORT"}


def family(category: Column) -> Column:
    term = F.lower(F.trim(category))
    out = F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), F.coalesce(term, F.lit("")))
    ends = None
    for tail, name in ENDINGS.items():
        ends = F.when(term.endswith(tail), name) if ends is None else ends.when(term.endswith(tail), name)
    return F.coalesce(out, ends, F.lit("UNKNOWN"))


_FAMILY = "coalesce(CASE lower(trim(category)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILIES.items()) + " END, CASE " + " ".join(f"WHEN ends_with(lower(trim(category)), '{k}') THEN '{v}'" for k, v in ENDINGS.items()) + " END, 'UNKNOWN')"


@book(f"WITH {POIS} SELECT source, {_FAMILY} AS family, count(*) AS n FROM v_poi GROUP BY 1, 2")
def poi7_families(spark: SparkSession, folder: str) -> DataFrame:
    return pois(spark, folder).groupBy("source", family(_c("category")).alias("family")).agg(F.count("*").alias("n"))


@book(f"WITH {POIS} SELECT source, count(*) FILTER (WHERE name IS NOT NULL AND trim(name) <> '') AS named, count(*) FILTER (WHERE name IS NULL OR trim(name) = '') AS unnamed, count(*) FILTER (WHERE brand IS NOT NULL) AS branded, count(*) FILTER (WHERE address IS NOT NULL) AS addressed FROM v_poi GROUP BY 1")
def poi8_records(spark: SparkSession, folder: str) -> DataFrame:
    some = _c("name").isNotNull() & (F.trim("name") != "")
    return pois(spark, folder).groupBy("source").agg(F.count(F.when(some, 1)).alias("named"), F.count(F.when(~some, 1)).alias("unnamed"), F.count("brand").alias("branded"), F.count("address").alias("addressed"))


_D = haversine_sql("a.lon", "a.lat", "b.lon", "b.lat", geo.RADIUS_ROUND)
_PAIRS = f"""c AS (SELECT a.key AS a_key, b.key AS b_key, a.source AS a_source, b.source AS b_source, a.category IS NULL AS a_bare, b.category IS NULL AS b_bare, {r_sql(_D, 1)} AS metres FROM v_n a JOIN v_n b ON a.norm = b.norm AND a.key < b.key AND abs(a.lat - b.lat) < 0.003 AND abs(a.lon - b.lon) < 0.003)"""


def same_key_pairs(rows: DataFrame, key: str, metres: float) -> DataFrame:
    """Pairs of rows (key, source, category, lon, lat) with the same value of a column within metres, each once; cells keep far branches of a chain apart, at any latitude."""
    own = F.struct("key", "source", "category", "lon", "lat")
    rows = rows.where("lon between -180 and 180 and lat between -90 and 90")
    a = rows.select(_c(key).alias("block"), cells.cell(_c("lon"), _c("lat")).alias("cell"), own.alias("a"))
    b = rows.select(_c(key).alias("block"), F.explode(cells.cells_within(_c("lon"), _c("lat"), metres * 1.01)).alias("cell"), own.alias("b"))
    pairs = a.join(b, ["block", "cell"]).where("a.key < b.key")
    return pairs.withColumn("metres", rounded(geo.haversine(_c("a.lon"), _c("a.lat"), _c("b.lon"), _c("b.lat"), geo.RADIUS_ROUND), 1)).where(_c("metres") <= metres)


@book(f"WITH {_NORM}, {_PAIRS} SELECT DISTINCT a_key, b_key, metres FROM c WHERE (a_source <> b_source AND metres <= 250) OR (a_source = b_source AND (metres <= 40 OR (metres <= 250 AND a_bare <> b_bare)))")
def poi9_same_name_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = same_key_pairs(named(spark, folder), "norm", 250.0)
    across = _c("a.source") != _c("b.source")
    one_bare = _c("a.category").isNull() != _c("b.category").isNull()
    return pairs.where(across | (_c("metres") <= 40) | one_bare).select(_c("a.key").alias("a_key"), _c("b.key").alias("b_key"), "metres").distinct()


@book(f"WITH {POIS}, c AS (SELECT a.key AS a_key, b.key AS b_key, {r_sql(_D, 1)} AS metres FROM v_poi a JOIN v_poi b ON a.brand = b.brand AND a.key < b.key AND abs(a.lat - b.lat) < 0.002 AND abs(a.lon - b.lon) < 0.002) SELECT DISTINCT a_key, b_key, metres FROM c WHERE metres <= 100")
def poi10_same_brand_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return same_key_pairs(pois(spark, folder).where("brand is not null"), "brand", 100.0).select(_c("a.key").alias("a_key"), _c("b.key").alias("b_key"), "metres").distinct()


_RARE = f"""w AS (SELECT DISTINCT key, source, lon, lat, unnest({_WORDS}) AS word FROM v_n), df AS (SELECT word FROM w WHERE length(word) >= 4 GROUP BY 1 HAVING count(DISTINCT key) <= 12),
c AS (SELECT a.key AS a_key, b.key AS b_key, a.word, {r_sql(_D, 1)} AS metres FROM w a JOIN w b ON a.word = b.word AND a.source = 'osm' AND b.source = 'overture' JOIN df ON df.word = a.word)"""


@book(f"WITH {_NORM}, {_RARE} SELECT a_key, b_key, count(DISTINCT word) AS shared FROM c WHERE metres <= 1000 GROUP BY 1, 2")
def poi11_rare_word_pairs(spark: SparkSession, folder: str) -> DataFrame:
    w = named(spark, folder).select("key", "source", "lon", "lat", F.explode(N.tokens(_c("norm"))).alias("word")).distinct()
    rare = w.where(F.length("word") >= 4).groupBy("word").agg(F.countDistinct("key").alias("df")).where("df <= 12").select("word")
    kept = w.join(rare, "word")  # a rare word joins 12 records at most
    side = lambda s: kept.where(_c("source") == s).select("word", F.struct("key", "lon", "lat").alias(s))
    pairs = side("osm").join(side("overture"), "word")
    metres = rounded(geo.haversine(_c("osm.lon"), _c("osm.lat"), _c("overture.lon"), _c("overture.lat"), geo.RADIUS_ROUND), 1)
    return pairs.where(metres <= 1000).groupBy(_c("osm.key").alias("a_key"), _c("overture.key").alias("b_key")).agg(F.countDistinct("word").alias("shared"))


_USE = "coalesce(CASE lower(trim(category)) WHEN 'atm' THEN 0.45e0 WHEN 'atms' THEN 0.45e0 END, CASE family " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in N.USEFULNESS.items()) + " ELSE 0.35e0 END)"
_SCORE = f"0.45e0 * {_USE} + 0.20e0 * {_QUALITY} + 0.10e0 * coalesce(greatest(0e0, least(1e0, confidence)), 0.5e0) + 0.10e0 * CASE WHEN address IS NOT NULL OR brand IS NOT NULL THEN 1e0 ELSE 0e0 END"


def base_score(family_: Column, name: Column, category: Column, confidence: Column, address: Column, brand: Column) -> Column:
    use = F.coalesce(lookup(F.lower(F.trim(category)), N.CATEGORY_USEFULNESS, None), lookup(family_, N.USEFULNESS, 0.35))
    sure = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), F.lit(0.5))
    return 0.45 * use + 0.20 * N.quality(name) + 0.10 * sure + 0.10 * F.when(address.isNotNull() | brand.isNotNull(), 1.0).otherwise(0.0)


@book(f"WITH {_NORM}, s AS (SELECT key, source, {r_sql(_SCORE, 4)} AS score FROM (SELECT *, {_FAMILY} AS family FROM v_n) q) SELECT key, score, {r_sql('least(1e0, score + 0.15e0)', 4)} AS crossed, CASE WHEN score >= 0.55 THEN 'DESTINATION' WHEN score >= 0.30 THEN 'SUPPORT' ELSE 'NONE' END AS bucket FROM s")
def poi14_scores(spark: SparkSession, folder: str) -> DataFrame:
    score = rounded(base_score(family(_c("category")), *[_c(c) for c in ("name", "category", "confidence", "address", "brand")]), 4)
    rows = named(spark, folder).select("key", score.alias("score"))
    return rows.select("key", "score", rounded(F.least(F.lit(1.0), _c("score") + 0.15), 4).alias("crossed"), F.when(_c("score") >= 0.55, "DESTINATION").when(_c("score") >= 0.30, "SUPPORT").otherwise("NONE").alias("bucket"))


_SIGNALS = {
    "accommodation": r"(?i)\baccom+odations?\b|\blabou?r[- ]?camp\b|\bstaff[- ]?housing\b",
    "building-id": r"(?i)\bbldg\b|\bbuilding[ -]?\d+|\bblock[ -]?\d|\bflat[ -]?\d",
    "short-id": r"(?i)^[a-z0-9]{1,2}$|^\d{1,3}$|^(?:[a-z]{1,4}[ -]?\d{1,3}|\d{1,3}[ -]?[a-z]{1,3})$",
    "bare-place-name": r"(?i)^(?:doha|qatar)$|^street[ -]?\d+$",
}


@book("WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN 'Bldg ' || p_size WHEN 2 THEN 'Al Noor Staff Housing' WHEN 3 THEN 'B' || p_size WHEN 4 THEN 'Street ' || p_size WHEN 5 THEN 'Qatar' WHEN 6 THEN 'Worker accommodation ' || p_size ELSE 'Block ' || p_size END AS name FROM part) SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(trim(name), '{v}') THEN '{k}' END" for k, v in _SIGNALS.items()) + "], lambda x: x IS NOT NULL), ',') AS signals FROM n")
def poi16_name_signals(spark: SparkSession, folder: str) -> DataFrame:
    k, size = _c("p_partkey") % 8, _c("p_size").cast("string")
    name = F.when(k == 0, _c("p_name")).when(k == 1, F.concat(F.lit("Bldg "), size)).when(k == 2, "Al Noor Staff Housing").when(k == 3, F.concat(F.lit("B"), size)).when(k == 4, F.concat(F.lit("Street "), size)).when(k == 5, "Qatar").when(k == 6, F.concat(F.lit("Worker accommodation "), size)).otherwise(F.concat(F.lit("Block "), size))
    hits = F.array_compact(F.array(*[F.when(F.trim(name).rlike(v), F.lit(s)) for s, v in _SIGNALS.items()]))
    return table(spark, folder, "part").select(_c("p_partkey").alias("id"), F.array_join(hits, ",").alias("signals"))


_KEPT = "CASE WHEN NOT (lon BETWEEN 50.5e0 AND 52e0 AND lat BETWEEN 24.2e0 AND 26.6e0) THEN 'out_of_bounds' WHEN name IS NULL OR trim(name) IN ('', '-') THEN 'unnamed' WHEN family IN ('MAP_FURNITURE', 'RESIDENTIAL', 'OFFICE', 'INDUSTRY') THEN 'excluded_family' ELSE 'kept' END"


def exclusion(rows: DataFrame) -> DataFrame:
    """rows with family and outcome, the first rule that excludes a record."""
    out = F.when(~(_c("lon").between(50.5, 52.0) & _c("lat").between(24.2, 26.6)), "out_of_bounds").when(_c("name").isNull() | F.trim("name").isin("", "-"), "unnamed")
    return rows.withColumn("family", family(_c("category"))).withColumn("outcome", out.when(_c("family").isin("MAP_FURNITURE", "RESIDENTIAL", "OFFICE", "INDUSTRY"), "excluded_family").otherwise("kept"))


_LEDGER = f"{POIS}, l AS (SELECT source, family, {_KEPT} AS outcome FROM (SELECT *, {_FAMILY} AS family FROM v_poi) q)"


@book(f"WITH {_LEDGER} SELECT outcome, count(*) AS n FROM l GROUP BY 1")
def poi17_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    return exclusion(pois(spark, folder)).groupBy("outcome").agg(F.count("*").alias("n"))


@book(f"WITH {_LEDGER} SELECT source, outcome, family, count(*) AS n FROM l GROUP BY GROUPING SETS ((source), (outcome), (source, outcome), (family))")
def poi18_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = exclusion(pois(spark, folder)).select("source", "outcome", "family")
    sets = [[_c("source")], [_c("outcome")], [_c("source"), _c("outcome")], [_c("family")]]
    return rows.groupingSets(sets, "source", "outcome", "family").agg(F.count("*").alias("n")).select("source", "outcome", "family", "n")


@book(f"WITH {_NORM}, g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS n, row_number() OVER (PARTITION BY norm ORDER BY coalesce(confidence, -1e0) DESC, key) AS k FROM v_n WHERE category IS NULL) SELECT key, norm FROM g WHERE n >= 5 AND k = 1")
def poi19_repeated_labels(spark: SparkSession, folder: str, least: int = 5) -> DataFrame:
    """The best record of every name that classless records carry at least so many times."""
    rows = named(spark, folder).where("category is null")
    g = rows.groupBy("norm").agg(F.count("*").alias("n"), F.min(F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "key")).alias("best"))
    return g.where(_c("n") >= least).select(_c("best.key").alias("key"), "norm")


@book(f"WITH {_NORM}, g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS n, row_number() OVER (PARTITION BY norm ORDER BY coalesce(confidence, -1e0) DESC, key) AS k FROM v_n WHERE category IS NULL) SELECT key, norm FROM g WHERE n >= 2 AND k = 1")
def poi19_paired_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a threshold at which the test tables give rows."""
    return poi19_repeated_labels(spark, folder, 2)


@book("WITH c AS (SELECT DISTINCT canonical_id, cluster_id, source, osm_ids, overture_ids FROM canonical_poi WHERE cluster_id IS NOT NULL), e AS (SELECT cluster_id, trim(unnest(osm_ids)) AS x FROM c) SELECT cluster_id, array_to_string(list_sort(list(DISTINCT x)), ',') AS osm_ids FROM e WHERE x <> '' GROUP BY 1")
def poi20_provenance(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "canonical_poi").where("cluster_id is not null").select("cluster_id", F.explode("osm_ids").alias("x")).select("cluster_id", F.trim("x").alias("x")).where("x <> ''").distinct()
    return e.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("osm_ids"))


# Sources that a map label needs, categories that say nothing, categories one phones rather than drives to.
MAP_SOURCES, SAY_NOTHING = ("osm", "both"), ("yes", "no", "unknown", "other")
PHONE_THEM = ("party_and_event_planning", "travel_services", "transportation", "financial_service")
_CLASS = "coalesce(lower(trim(category)), '')"
_RULES = [
    ("MAP_HIDDEN_OVERTURE_ONLY", f"coalesce(lower(trim(source)), '') NOT IN ({_quoted(MAP_SOURCES)})"), ("MAP_HIDDEN_NO_CATEGORY", f"{_CLASS} IN ('', {_quoted(SAY_NOTHING)})"),
    ("MAP_HIDDEN_PHONE_THEM_CATEGORY", f"{_CLASS} IN ({_quoted(PHONE_THEM)})"), ("MAP_HIDDEN_NOT_A_DESTINATION", "coalesce(usefulness, '') <> 'DESTINATION'"),
]


@book("WITH c AS (SELECT DISTINCT canonical_id, source, category, usefulness FROM canonical_poi), r AS (SELECT canonical_id, list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _RULES) + "], lambda x: x IS NOT NULL) AS failed FROM c) SELECT canonical_id, len(failed) = 0 AS visible, failed[1] AS first_reason, len(failed) AS reasons FROM r")
def poi21_visibility(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "canonical_poi").select("canonical_id", "source", "category", "usefulness").distinct()
    failed = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in _RULES]))
    return c.withColumn("failed", failed).select("canonical_id", (F.size("failed") == 0).alias("visible"), F.try_element_at("failed", F.lit(1)).alias("first_reason"), F.size("failed").cast("long").alias("reasons"))


@book(f"WITH {POIS} SELECT key, 'poi:' || substr(sha256(source || ':' || key), 1, 12) AS id, CAST(('0x' || substr(sha256(key), 1, 8)) AS BIGINT) / 4294967296e0 AS tie FROM v_poi")
def poi22_stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    return pois(spark, folder).select("key", F.concat(F.lit("poi:"), F.substring(F.sha2(F.concat("source", F.lit(":"), "key"), 256), 1, 12)).alias("id"), (F.conv(F.substring(F.sha2("key", 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)).alias("tie"))


# --- geocoding --------------------------------------------------------------------------------------

QUERIES_TEXT = ["restaurant", "al noor", "park 4", "café", "tarharthal", "bank kor", "shan grill", "صيدلية", "min", "holsif mosque"]
_Q = "v_q AS (SELECT q, norm, list_filter(string_split(norm, ' '), lambda w: length(w) >= 2) AS qs FROM (SELECT q, " + N.normalize_sql("q") + f" AS norm FROM (SELECT unnest([{_quoted(QUERIES_TEXT)}]) AS q) a) b)"


@book(f"""WITH {_NORM}, {_Q}, c AS (SELECT q, key, name, list_filter(string_split(v_n.norm, ' '), lambda w: w <> '') AS ws, qs, v_q.norm AS qn, v_n.norm AS nn, lon, lat FROM v_n, v_q),
s AS (SELECT q, key, len(list_filter(qs, lambda x: len(list_filter(ws, lambda w: starts_with(w, x))) > 0)) AS coverage, CASE WHEN nn = qn THEN 0 WHEN starts_with(nn, qn) THEN 2 WHEN contains(nn, qn) THEN 4 ELSE 9 END AS tier,
 {r_sql(haversine_sql('51.2e0', '25.3e0', 'lon', 'lat', geo.RADIUS_ROUND), 0)} AS metres FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY coverage DESC, tier, metres, key) AS rank FROM (SELECT DISTINCT * FROM s WHERE coverage > 0) d) SELECT q, key, coverage, tier, metres, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def c4_c6_c7_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best places for each text: by words explained, then kind of match, then distance; candidates come from an inverted index of word beginnings."""
    q = spark.createDataFrame([(x,) for x in QUERIES_TEXT], "q string").withColumn("qn", N.normalize(_c("q"))).withColumn("qs", F.filter(F.split("qn", " "), lambda w: F.length(w) >= 2))
    places = named(spark, folder).withColumn("ws", F.filter(F.split("norm", " "), lambda w: w != ""))
    starts = places.select("key", "norm", "lon", "lat", F.explode(F.array_distinct("ws")).alias("w")).withColumn("start", F.substring("w", 1, 2))
    words = q.select("q", "qn", F.explode("qs").alias("x")).withColumn("start", F.substring("x", 1, 2))
    hits = starts.join(words, "start").where("startswith(w, x)").groupBy("q", "qn", "key", "norm", "lon", "lat").agg(F.countDistinct("x").cast("long").alias("coverage"))
    tier = F.when(_c("norm") == _c("qn"), 0).when(F.expr("startswith(norm, qn)"), 2).when(F.expr("contains(norm, qn)"), 4).otherwise(9)
    s = hits.select("q", "key", "coverage", tier.alias("tier"), rounded(geo.haversine(51.2, 25.3, "lon", "lat", geo.RADIUS_ROUND), 0).alias("metres")).distinct()
    order = W.partitionBy("q").orderBy(_c("coverage").desc(), "tier", "metres", "key")
    return s.withColumn("rank", F.row_number().over(order)).where("rank <= 10")


@book()
def c7_ranked_search(spark: SparkSession, folder: str, most: int = 10, near: tuple[float, float] = (51.2, 25.3)) -> DataFrame:
    """The best places for each text in the full order, records of one name and category within 250 m of one another in one row.

    Distance counts up to four times less for places of quality; no record here is a road, so the terms for roads are constant.
    """
    q = spark.createDataFrame([(x,) for x in QUERIES_TEXT], "q string").withColumn("qn", N.normalize(_c("q"))).withColumn("qs", F.filter(F.split("qn", " "), lambda w: F.length(w) >= 2))
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rounded(base_score(family(_c("category")), *[_c(c) for c in ("name", "category", "confidence", "address", "brand")]), 4)))
    known = {"quality": quality, "category": F.coalesce("category", F.lit("")), "confidence": F.coalesce("confidence", F.lit(1.0))}
    rows = named(spark, folder).where("lon is not null and lat is not null").withColumns(known)
    words = q.select("q", "qn", F.explode("qs").alias("x")).withColumn("start", F.substring("x", 1, 2))
    w = F.explode(F.array_distinct(F.filter(F.split("norm", " "), lambda w: w != ""))).alias("w")
    starts = rows.select(F.struct("key", "norm", "lon", "lat", "category", "confidence", "quality").alias("p"), w).withColumn("start", F.substring("w", 1, 2))
    hits = starts.join(words, "start").where("startswith(w, x)").groupBy("q", "qn", "p").agg(F.countDistinct("x").cast("long").alias("coverage")).select("q", "qn", "coverage", "p.*")
    tier = F.when(_c("norm") == _c("qn"), 0).when(F.expr("startswith(norm, qn)"), 2).when(F.expr("contains(norm, qn)"), 4).otherwise(9)
    metres = rounded(geo.haversine(near[0], near[1], "lon", "lat", geo.RADIUS_ROUND), 0)
    ranked = hits.withColumns({"tier": tier, "metres": metres, "effective": metres * (0.25 + 0.75 * (1 - _c("quality")))})
    ranked = ranked.withColumns({"covered": -_c("coverage"), "worse": -_c("quality"), "unsure": -_c("confidence"), "length": F.length("norm")})
    order = ["covered", "tier", "effective", "worse", "length", "unsure", "norm", "key"]
    kept = S.scan(ranked, ["q", "norm", "category"], order, S.chained_collapse(), "kept boolean", ["q", "key", "coverage", "metres", *order[:-1]]).where("kept")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(_c("rank") <= most).select("q", "key", "coverage", "tier", "metres", "rank")


@book(f"WITH {_NORM} SELECT key, regexp_replace(norm, '[aeiou]', '', 'g') AS vowelless, len(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+')) AS words FROM v_n")
def c2_search_keys(spark: SparkSession, folder: str) -> DataFrame:
    words = F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return named(spark, folder).select("key", F.regexp_replace("norm", "[aeiou]", "").alias("vowelless"), F.size(words).cast("long").alias("words"))


@book("SELECT overture_key AS key, array_to_string(list_sort(list(DISTINCT lower(trim(p)))), '|') AS alts FROM (SELECT overture_key, unnest(string_split(a, ';')) AS p FROM (SELECT DISTINCT overture_key, unnest(aliases) AS a FROM poi_overture) q) r WHERE trim(p) <> '' GROUP BY 1")
def c3_alternate_names(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "poi_overture").select("overture_key", F.explode("aliases").alias("a")).select(_c("overture_key").alias("key"), F.explode(F.split("a", ";")).alias("p"))
    p = p.select("key", F.lower(F.trim("p")).alias("p")).where("p <> ''").distinct()
    return p.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("p")), "|").alias("alts"))


@book(f"""WITH {PIECES}, {_INC}, np AS (SELECT p.id, p.lon, p.lat, s.* EXCLUDE (lon1, lat1, lon2, lat2), lon1, lat1, lon2, lat2 FROM pts p JOIN v_piece s ON p.lon BETWEEN least(lon1, lon2) - 0.0008e0 AND greatest(lon1, lon2) + 0.0008e0 AND p.lat BETWEEN least(lat1, lat2) - 0.0007e0 AND greatest(lat1, lat2) + 0.0007e0),
t AS (SELECT *, CASE WHEN lon1 = lon2 AND lat1 = lat2 THEN 0e0 ELSE greatest(0e0, least(1e0, ((lon - lon1) * (lon2 - lon1) + (lat - lat1) * (lat2 - lat1)) / (pow(lon2 - lon1, 2) + pow(lat2 - lat1, 2)))) END AS t FROM np),
d AS (SELECT id, segment_id, free_flow_kmh, {r_sql(haversine_sql('lon', 'lat', '(lon1 + t * (lon2 - lon1))', '(lat1 + t * (lat2 - lat1))', geo.RADIUS_ROUND), 1)} AS metres FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, segment_id) AS k FROM d WHERE metres <= 60) SELECT id, segment_id, free_flow_kmh, metres FROM r WHERE k = 1""")
def c9_speed_limit(spark: SparkSession, folder: str) -> DataFrame:
    near = bucket_join(incident_points(spark, folder), padded(pieces(spark, folder), 70.0), 0.005)
    dx, dy = _c("lon2") - _c("lon1"), _c("lat2") - _c("lat1")
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((_c("lon") - _c("lon1")) * dx + (_c("lat") - _c("lat1")) * dy) / square)))
    metres = rounded(geo.haversine("lon", "lat", _c("lon1") + t * dx, _c("lat1") + t * dy, geo.RADIUS_ROUND), 1)
    best = near.withColumn("metres", metres).where("metres <= 60").groupBy("id").agg(F.min(F.struct("metres", "segment_id", "free_flow_kmh")).alias("m"))
    return best.select("id", "m.segment_id", "m.free_flow_kmh", "m.metres")


_STEPS = f"CAST(trunc({haversine_sql('lon1', 'lat1', 'lon2', 'lat2', geo.RADIUS_ROUND)} / 50e0) AS INTEGER)"


@book(f"""WITH {PIECES}, {POIS}, n AS (SELECT segment_id, seq, lon1, lat1, lon2, lat2, {_STEPS} AS steps FROM v_piece), sm AS (SELECT segment_id, lon1 + (lon2 - lon1) * (k / (steps + 1e0)) AS slon, lat1 + (lat2 - lat1) * (k / (steps + 1e0)) AS slat FROM (SELECT *, unnest(range(0, steps + 1)) AS k FROM n) q UNION ALL SELECT segment_id, lon2, lat2 FROM n),
d AS (SELECT segment_id, key, {r_sql(haversine_sql('lon', 'lat', 'slon', 'slat', geo.RADIUS_ROUND), 1)} AS m FROM sm JOIN v_poi ON lon BETWEEN slon - 0.0031e0 AND slon + 0.0031e0 AND lat BETWEEN slat - 0.0028e0 AND slat + 0.0028e0),
b AS (SELECT segment_id, key, min(m) AS detour_m FROM d WHERE m <= 300 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY detour_m, key) AS k FROM b) SELECT segment_id, key, detour_m FROM r WHERE k <= 20""")
def c10_corridor(spark: SparkSession, folder: str, metres: float = 300.0) -> DataFrame:
    steps = (geo.haversine("lon1", "lat1", "lon2", "lat2", geo.RADIUS_ROUND) / 50.0).cast("int")
    p = pieces(spark, folder).withColumn("steps", steps)
    k = p.withColumn("k", F.explode(F.sequence(F.lit(0), _c("steps"))))
    share = _c("k") / (_c("steps") + F.lit(1.0))
    samples = k.select("segment_id", (_c("lon1") + (_c("lon2") - _c("lon1")) * share).alias("slon"), (_c("lat1") + (_c("lat2") - _c("lat1")) * share).alias("slat")).unionByName(p.select("segment_id", _c("lon2").alias("slon"), _c("lat2").alias("slat")))
    boxes = padded(samples.withColumns({"lon1": _c("slon"), "lon2": _c("slon"), "lat1": _c("slat"), "lat2": _c("slat")}), metres).drop("lon1", "lat1", "lon2", "lat2")
    near = bucket_join(pois(spark, folder).select("key", "lon", "lat").distinct(), boxes, 0.006).withColumn("m", rounded(geo.haversine("lon", "lat", "slon", "slat", geo.RADIUS_ROUND), 1)).where(_c("m") <= metres)
    b = near.groupBy("segment_id", "key").agg(F.min("m").alias("detour_m"))
    return b.withColumn("k", F.row_number().over(W.partitionBy("segment_id").orderBy("detour_m", "key"))).where("k <= 20").drop("k")


# Categories that a kind asked for stands for, besides itself.
KIND_MAP = {
    "fuel": ["fuel_station", "gas_station", "petrol_station", "charging_station"],
    "coffee": ["coffee_shop", "cafe", "tea_room", "bubble_tea_shop"],
    "food": ["restaurant", "fast_food_restaurant", "food_court", "indian_restaurant", "pizza_restaurant", "burger_restaurant", "seafood_restaurant", "chinese_restaurant", "turkish_restaurant", "lebanese_restaurant", "asian_restaurant", "italian_restaurant"],
    "parking": ["parking", "parking_lot", "parking_garage"],
    "pharmacy": ["pharmacy", "drugstore", "chemist"],
    "atm": ["atm", "bank"],
    "hotel": ["hotel", "motel", "hostel", "guest_house"],
    "hospital": ["hospital", "clinic", "medical_lab", "medical_center"],
    "shop": ["supermarket", "shopping", "shopping_center", "mall", "clothing_store", "grocery_store", "convenience_store"],
}


@book(f"WITH {POIS}, m AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}')" for k, v in KIND_MAP.items() for c in {*v, k}) + ") x(kind, cat)) SELECT kind, source, count(*) AS n FROM v_poi JOIN m ON lower(trim(category)) = cat GROUP BY 1, 2")
def c11_kinds(spark: SparkSession, folder: str) -> DataFrame:
    by = {}
    for k, v in KIND_MAP.items():
        for c in {*v, k}:
            by.setdefault(c, []).append(k)
    kinds = F.element_at(F.create_map(*[x for c, ks in by.items() for x in (F.lit(c), F.array(*[F.lit(k) for k in ks]))]), F.coalesce(F.lower(F.trim("category")), F.lit("")))
    return pois(spark, folder).select("source", F.explode(kinds).alias("kind")).groupBy("kind", "source").agg(F.count("*").alias("n"))
