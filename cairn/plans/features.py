"""Tag promotion, restrictions, display names, reconciliation outcomes, learned layers and journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cairn.functions import geo
from cairn.functions.tags import maxspeed_float
from cairn.operators import graph
from cairn.operators.spatial import nearest
from cairn.plans.base import POIS, TAGS_SQL, VERTICES, Book, picked, picked_sql, pois, r_sql, rounded, tags, vertices
from cairn.plans.guidance import _CAMS, catalog, shade_of_pieces
from cairn.plans.places import _NORM, _PAIRS, _SCORE, _FAMILY, base_score, family, named, poi9_same_name_pairs
from cairn.plans.routing import SIDE, _GRID, lattice
from cairn.plans.spatial import _CUM, _measured, haversine_sql
from cairn.plans.traffic import _FACTS, facts
from cairn.storage import table

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col

# --- tag promotion ----------------------------------------------------------------------------------

_MORE = [("hw", ["residential", None, "traffic_signals", None, "crossing", "speed_camera", None, "bus_stop", "primary"], 1), ("crossing", [None, "zebra", None, None, "marked"], 3), ("kerb", [None, None, "lowered", None], 2), ("nat", [None, "water", None, "coastline", "tree"], 2), ("leisure", [None, None, "park"], 5), ("place", [None, None, "suburb", None, "town"], 4), ("amenity", [None, "cafe", None, "bank"], 6), ("building", [None, "yes"], 7), ("bar", [None, "gate"], 8)]
_MORE_SQL = "mt AS (SELECT p_partkey AS id, p_name AS name, " + ", ".join(f"{picked_sql('p_partkey', v, s)} AS {c}" for c, v, s in _MORE) + " FROM part)"
_KIND = "CASE WHEN hw = 'traffic_signals' THEN 'signal' WHEN hw = 'speed_camera' THEN 'camera' WHEN hw = 'crossing' OR (crossing IS NOT NULL AND hw IS NULL) THEN 'crossing' WHEN kerb IS NOT NULL AND hw IS NULL THEN 'kerb' WHEN hw IS NOT NULL THEN 'road' WHEN nat = 'coastline' THEN 'coastline' WHEN nat = 'water' THEN 'water' WHEN leisure = 'park' THEN 'park' WHEN place IS NOT NULL THEN 'label' WHEN amenity IS NOT NULL OR (building IS NOT NULL AND name IS NOT NULL) THEN 'poi' WHEN bar IS NOT NULL THEN 'barrier' END"


def promoted_kind() -> Column:
    """Kind of a feature by its tags; the first that applies."""
    hw = _c("hw")
    return (
        F.when(hw == "traffic_signals", "signal").when(hw == "speed_camera", "camera").when((hw == "crossing") | (_c("crossing").isNotNull() & hw.isNull()), "crossing").when(_c("kerb").isNotNull() & hw.isNull(), "kerb")
        .when(hw.isNotNull(), "road").when(_c("nat") == "coastline", "coastline").when(_c("nat") == "water", "water").when(_c("leisure") == "park", "park").when(_c("place").isNotNull(), "label")
        .when(_c("amenity").isNotNull() | (_c("building").isNotNull() & _c("name").isNotNull()), "poi").when(_c("bar").isNotNull(), "barrier")
    )


@book(f"WITH {_MORE_SQL} SELECT {_KIND} AS kind, count(*) AS n FROM mt GROUP BY 1")
def n7_tag_promotion(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(_c("p_partkey").alias("id"), _c("p_name").alias("name"), *[picked("p_partkey", v, s).alias(c) for c, v, s in _MORE])
    return rows.groupBy(promoted_kind().alias("kind")).agg(F.count("*").alias("n"))


# --- turn restrictions from relations ---------------------------------------------------------------

_REL_KINDS = ["no_left_turn", "only_straight_on", "no_parking", "no_u_turn", "bogus"]
_REL = f"""rel AS (SELECT s_suppkey AS id, {picked_sql('s_suppkey', _REL_KINDS)} AS kind, s_suppkey % 37 AS from_way, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 1000 + s_suppkey % 37 END AS via_node, s_suppkey % 6 = 0 AS via_way, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE (s_suppkey + 1) % 37 END AS to_way FROM supplier),
wn AS (SELECT w AS way, k AS seq, CASE WHEN k = 2 THEN 1000 + w WHEN k = 0 THEN 1000 + (w + 36) % 37 ELSE w * 10 + k END AS node FROM range(37) a(w), range(4) b(k) WHERE w % 8 <> 7)"""


def relations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(relations with their members by role, nodes of the ways they name)."""
    k = _c("s_suppkey")
    rel = table(spark, folder, "supplier").select(k.alias("id"), picked("s_suppkey", _REL_KINDS).alias("kind"), (k % 37).alias("from_way"), F.when(k % 6 != 0, 1000 + k % 37).alias("via_node"), (k % 6 == 0).alias("via_way"), F.when(k % 9 != 0, (k + 1) % 37).alias("to_way"))
    w = spark.range(37).where("id % 8 <> 7").select(_c("id").alias("way"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("seq"))
    return rel, w.withColumn("node", F.when(_c("seq") == 2, 1000 + _c("way")).when(_c("seq") == 0, 1000 + (_c("way") + 36) % 37).otherwise(_c("way") * 10 + _c("seq")))


@book(f"""WITH {_REL}, j AS (SELECT rel.id, kind, via_node, via_way, to_way, f.seq AS f_seq, t.seq AS t_seq FROM rel LEFT JOIN wn f ON f.way = from_way AND f.node = via_node LEFT JOIN wn t ON t.way = to_way AND t.node = via_node)
SELECT CASE WHEN kind NOT IN ('no_left_turn', 'only_straight_on', 'no_u_turn') THEN 'unknown_kind' WHEN via_way AND via_node IS NULL THEN 'via_way' WHEN to_way IS NULL OR via_node IS NULL OR f_seq IS NULL OR t_seq IS NULL THEN 'unresolved' ELSE kind END AS outcome, count(*) AS n FROM j GROUP BY 1""")
def n10_restrictions(spark: SparkSession, folder: str) -> DataFrame:
    rel, nodes = relations(spark, folder)
    side = lambda s: nodes.select(_c("way").alias(f"{s}_way"), _c("node").alias("via_node"), _c("seq").alias(f"{s}_seq"))
    j = rel.join(side("from"), ["from_way", "via_node"], "left").join(side("to"), ["to_way", "via_node"], "left")
    lost = _c("to_way").isNull() | _c("via_node").isNull() | _c("from_seq").isNull() | _c("to_seq").isNull()
    return j.groupBy(F.when(~_c("kind").isin("no_left_turn", "only_straight_on", "no_u_turn"), "unknown_kind").when(_c("via_way") & _c("via_node").isNull(), "via_way").when(lost, "unresolved").otherwise(_c("kind")).alias("outcome")).agg(F.count("*").alias("n"))


# --- display names ----------------------------------------------------------------------------------

_URL, _PHONE = r"(?:https?://|www\.)\S+|\S+@\S+\.[a-z]{2,}", r"(?:call|whatsapp|tel\.?|mob\.?)?\s*(?:\+|00)?\s*974[ .-]*[3567][0-9]{7}"
_TAIL = r"\s+in\s+(?:doha|qatar)(?:[ ,/-]+(?:doha|qatar|uae|ksa))*\s*$"
_RAWNAME = "rn AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN c_name || ' www.shop' || c_custkey || '.com' WHEN 2 THEN '  - ' || c_name || ' call +974 5' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') WHEN 3 THEN c_name || ' Bank in Doha Qatar' WHEN 4 THEN upper(c_mktsegment) || ' TRADING OF DOHA ATM' ELSE c_name || '...  |' END AS raw FROM customer)"
_EDGE = "^[ |,.:;*#&/-]+|[ |,.:;*#&/-]+$"


def clean_name(raw: Column) -> Column:
    """A name without addresses, telephone numbers, repeated dots and punctuation at its ends."""
    text = F.regexp_replace(F.regexp_replace(raw, f"(?i){_URL}", " "), f"(?i){_PHONE}", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\.{2,}", " "), " +", " ")
    return F.trim(F.regexp_replace(text, _EDGE, ""))


def strip_tail(name: Column) -> Column:
    """A name without the place it advertises, if two words are left."""
    short = F.trim(F.regexp_replace(name, f"(?i){_TAIL}", ""))
    return F.when((short != "") & (F.size(F.split(short, " ")) >= 2), short).otherwise(name)


@book(f"""WITH {_RAWNAME}, c AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '{_URL}', ' ', 'gi'), '{_PHONE}', ' ', 'gi'), '\\.{{2,}}', ' ', 'g'), ' +', ' ', 'g'), '{_EDGE}', '', 'g')) AS clean FROM rn),
s AS (SELECT id, clean, trim(regexp_replace(clean, '{_TAIL}', '', 'gi')) AS short FROM c) SELECT id, clean, CASE WHEN short <> '' AND len(string_split(short, ' ')) >= 2 THEN short ELSE clean END AS shown FROM s""")
def poi1_poi2_display_names(spark: SparkSession, folder: str) -> DataFrame:
    k, name = _c("c_custkey") % 6, _c("c_name")
    number = _c("c_custkey").cast("string")
    raw = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit(" www.shop"), number, F.lit(".com"))).when(k == 2, F.concat(F.lit("  - "), name, F.lit(" call +974 5"), F.lpad(number, 7, "0"))).when(k == 3, F.concat(name, F.lit(" Bank in Doha Qatar"))).when(k == 4, F.concat(F.upper("c_mktsegment"), F.lit(" TRADING OF DOHA ATM"))).otherwise(F.concat(name, F.lit("...  |")))
    rows = table(spark, folder, "customer").select(_c("c_custkey").alias("id"), clean_name(raw).alias("clean"))
    return rows.select("id", "clean", strip_tail(_c("clean")).alias("shown"))


@book(f"""WITH {POIS}, s AS (SELECT key, string_split(name, CASE WHEN contains(name, ' | ') THEN ' | ' WHEN contains(name, ' / ') THEN ' / ' ELSE ' - ' END) AS xs FROM v_poi WHERE name IS NOT NULL),
h AS (SELECT key, xs[1] AS a, xs[2] AS b FROM s WHERE len(xs) = 2) SELECT key, trim(CASE WHEN regexp_matches(a, '[a-zA-Z]') THEN a ELSE b END) AS english, trim(CASE WHEN regexp_matches(a, '[a-zA-Z]') THEN b ELSE a END) AS arabic FROM h WHERE regexp_matches(a, '[a-zA-Z]') <> regexp_matches(b, '[a-zA-Z]') AND regexp_matches(a, '[\\x{{0600}}-\\x{{06ff}}]') <> regexp_matches(b, '[\\x{{0600}}-\\x{{06ff}}]')""")
def poi3_poi4_bilingual(spark: SparkSession, folder: str) -> DataFrame:
    """Names that hold both scripts with a sign between, as English and Arabic; others are refused."""
    name = _c("name")
    parts = F.when(name.contains(" | "), F.split(name, r" \| ")).when(name.contains(" / "), F.split(name, " / ")).otherwise(F.split(name, " - "))
    h = pois(spark, folder).where("name is not null").select("key", parts.alias("xs")).where(F.size("xs") == 2).select("key", F.element_at("xs", 1).alias("a"), F.element_at("xs", 2).alias("b"))
    latin, arabic = (lambda c: _c(c).rlike("[a-zA-Z]")), (lambda c: _c(c).rlike("[؀-ۿ]"))
    h = h.where((latin("a") != latin("b")) & (arabic("a") != arabic("b")))
    return h.select("key", F.trim(F.when(latin("a"), _c("a")).otherwise(_c("b"))).alias("english"), F.trim(F.when(latin("a"), _c("b")).otherwise(_c("a"))).alias("arabic"))


# --- reconciliation ---------------------------------------------------------------------------------

_PAIRED = "pr AS (SELECT DISTINCT a_key, b_key FROM c WHERE (a_source <> b_source AND metres <= 250) OR (a_source = b_source AND (metres <= 40 OR (metres <= 250 AND a_bare <> b_bare)))), lk AS (SELECT a_key AS a, b_key AS b FROM pr UNION SELECT b_key, a_key FROM pr)"


@book(f"""WITH RECURSIVE {_NORM}, {_PAIRS}, {_PAIRED}, reach AS (SELECT DISTINCT a, a AS b FROM lk UNION SELECT r.a, l.b FROM reach r JOIN lk l ON r.b = l.a), g AS (SELECT a AS key, min(b) AS grp FROM reach GROUP BY 1),
sc AS (SELECT key, max({r_sql(_SCORE, 4)}) AS score, max(coalesce(confidence, -1e0)) AS conf FROM (SELECT *, {_FAMILY} AS family FROM v_n) q GROUP BY key), r AS (SELECT g.key, grp, row_number() OVER (PARTITION BY grp ORDER BY score DESC, conf DESC, g.key) AS k FROM g JOIN sc USING (key)) SELECT key, grp, CASE WHEN k = 1 THEN 'canonical' ELSE 'duplicate' END AS outcome FROM r""")
def poi12_poi13_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of same-name pairs and the record of each that survives: best score, then confidence, then least key."""
    pairs = poi9_same_name_pairs(spark, folder).select(_c("a_key").alias("src"), _c("b_key").alias("dst"))
    g = graph.components(pairs).select(_c("node").alias("key"), _c("component").alias("grp"))
    score = rounded(base_score(family(_c("category")), *[_c(c) for c in ("name", "category", "confidence", "address", "brand")]), 4)
    s = named(spark, folder).groupBy("key").agg(F.max(score).alias("score"), F.max(F.coalesce("confidence", F.lit(-1.0))).alias("conf"))
    rows = g.join(s, "key")
    top = rows.groupBy("grp").agg(F.min(F.struct((-_c("score")).alias("a"), (-_c("conf")).alias("b"), "key")).alias("m")).select("grp", _c("m.key").alias("best"))
    return rows.join(top, "grp").select("key", "grp", F.when(_c("key") == _c("best"), "canonical").otherwise("duplicate").alias("outcome"))


# --- search tiers -----------------------------------------------------------------------------------

_ASKED = ["al noor park", "bank", "grand shan hotel", "tarharthal café", "kor mosque"]
_ASK = "qs AS (SELECT q, list_filter(string_split(q, ' '), lambda w: length(w) >= 2) AS us, string_split(q, ' ') AS alls FROM (SELECT unnest([" + ", ".join(f"'{q}'" for q in (x.replace("é", "e") for x in _ASKED)) + "]) AS q) a)"


@book(f"""WITH {_NORM}, {_ASK}, x AS (SELECT q, key, us, alls, list_filter(string_split(norm, ' '), lambda w: w <> '') AS ws FROM v_n, qs), m AS (SELECT q, key, len(alls) AS n_q, len(us) AS n_u, len(ws) AS n_w, len(list_filter(us, lambda u: len(list_filter(ws, lambda w: starts_with(w, u))) > 0)) AS matched, len(list_filter(us, lambda u: list_contains(ws, u))) AS exact, len(list_filter(ws, lambda w: len(list_filter(us, lambda u: starts_with(w, u))) > 0)) AS covered FROM x),
t AS (SELECT q, CASE WHEN matched = 0 THEN 99 WHEN matched = n_q THEN 7 WHEN covered = n_w AND (matched >= 2 OR exact >= 1) THEN 8 WHEN matched >= 2 AND matched / n_u >= 0.5 THEN 9 ELSE 99 END AS tier FROM m) SELECT q, tier, count(*) AS n FROM t WHERE tier < 99 GROUP BY 1, 2""")
def c5_token_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """How the words of a text match those of a name: all of them, the whole name, or most; found through the beginnings of words."""
    q = spark.createDataFrame([(x.replace("é", "e"),) for x in _ASKED], "q string").withColumn("alls", F.split("q", " ")).withColumn("us", F.filter("alls", lambda w: F.length(w) >= 2))
    places = named(spark, folder).select("key", "source", "lon", "lat", F.filter(F.split("norm", " "), lambda w: w != "").alias("ws"))
    starts = places.select("key", "source", "lon", "lat", "ws", F.explode(F.array_distinct(F.transform("ws", lambda w: F.substring(w, 1, 2)))).alias("s"))
    asked = q.select("q", "alls", "us", F.explode(F.array_distinct(F.transform("us", lambda u: F.substring(u, 1, 2)))).alias("s"))
    x = starts.join(asked, "s").drop("s").distinct()
    hit = lambda u, w: F.startswith(w, u)
    matched = F.size(F.filter("us", lambda u: F.exists("ws", lambda w: hit(u, w))))
    exact = F.size(F.filter("us", lambda u: F.array_contains(_c("ws"), u)))
    covered = F.size(F.filter("ws", lambda w: F.exists("us", lambda u: hit(u, w))))
    m = x.withColumns({"matched": matched, "exact": exact, "covered": covered})
    tier = F.when(_c("matched") == 0, 99).when(_c("matched") == F.size("alls"), 7).when((_c("covered") == F.size("ws")) & ((_c("matched") >= 2) | (_c("exact") >= 1)), 8).when((_c("matched") >= 2) & (_c("matched") / F.size("us") >= 0.5), 9).otherwise(99)
    return m.groupBy("q", tier.alias("tier")).agg(F.count("*").alias("n")).where("tier < 99")


@book(f"""WITH {_FACTS}, {POIS}, p AS (SELECT fact_key, lon AS flon, lat AS flat FROM v_fact WHERE fact_type = 'poi'), d AS (SELECT fact_key, key, name, {r_sql(haversine_sql('flon', 'flat', 'lon', 'lat', geo.RADIUS_ROUND), 3)} AS metres FROM p JOIN v_poi ON abs(lat - flat) < 0.0046 AND abs(lon - flon) < 0.0052),
r AS (SELECT *, row_number() OVER (PARTITION BY fact_key ORDER BY metres, key) AS k FROM (SELECT DISTINCT fact_key, key, name, metres FROM d WHERE metres <= 500) q) SELECT fact_key, key, metres, name IS NOT NULL AND trim(name) <> '' AS searchable FROM r WHERE k <= 5""")
def c12_learned_places(spark: SparkSession, folder: str, metres: float = 500.0) -> DataFrame:
    """Learned places with the five nearest known ones; they can be searched where those have names."""
    learnt = facts(spark, folder).where("fact_type = 'poi'").select(_c("fact_key").alias("id"), "lon", "lat")
    others = pois(spark, folder).select(_c("key").alias("other_id"), _c("lon").alias("o_lon"), _c("lat").alias("o_lat"), "name").distinct()
    near = nearest(learnt, others, metres, geo.haversine("lon", "lat", "o_lon", "o_lat", geo.RADIUS_ROUND), 5)
    return near.select(_c("id").alias("fact_key"), _c("other_id").alias("key"), "metres", (_c("name").isNotNull() & (F.trim("name") != "")).alias("searchable"))


# --- learned overlay on the graph -------------------------------------------------------------------


@book(f"""WITH {_GRID}, ov AS (SELECT s_suppkey % {SIDE * SIDE} AS a, s_suppkey % {SIDE * SIDE} + CASE WHEN s_suppkey % 5 = 4 THEN 3 ELSE 1 END AS b, s_suppkey % 8 AS band, CAST(20 + (s_suppkey * 7) % 90 AS DOUBLE) AS kmh, s_suppkey AS k FROM supplier),
o AS (SELECT a, b, band, arg_max(kmh, k) AS kmh FROM ov GROUP BY 1, 2, 3), j AS (SELECT o.*, e.src FROM o LEFT JOIN v_e e ON (e.src = a AND e.dst = b) OR (e.src = b AND e.dst = a)) SELECT band, count(src) AS directed_edges, count(DISTINCT CASE WHEN src IS NULL THEN (a, b) END) AS unresolved, {r_sql('max(greatest(0.25e0, least(10e0, 50e0 / kmh)))', 4)} AS slowest FROM j GROUP BY 1""")
def r11_compiled_overlay(spark: SparkSession, folder: str) -> DataFrame:
    k = _c("s_suppkey")
    ov = table(spark, folder, "supplier").select((k % (SIDE * SIDE)).alias("a"), (k % (SIDE * SIDE) + F.when(k % 5 == 4, 3).otherwise(1)).alias("b"), (k % 8).alias("band"), (20 + (k * 7) % 90).cast("double").alias("kmh"), k.alias("k"))
    o = ov.groupBy("a", "b", "band").agg(F.max_by("kmh", "k").alias("kmh"))
    both = o.select("*", F.explode(F.array(F.struct(_c("a").alias("src"), _c("b").alias("dst")), F.struct(_c("b").alias("src"), _c("a").alias("dst")))).alias("e")).select("a", "b", "band", "kmh", "e.src", "e.dst")
    j = both.join(lattice(spark).withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    pairs = j.groupBy("band", "a", "b", "kmh").agg(F.count("hit").alias("edges"))
    return pairs.groupBy("band").agg(F.sum("edges").alias("directed_edges"), F.count(F.when(_c("edges") == 0, 1)).alias("unresolved"), rounded(F.max(F.greatest(F.lit(0.25), F.least(F.lit(10.0), 50.0 / _c("kmh")))), 4).alias("slowest"))


@book(f"WITH {_GRID} SELECT count(*) AS edges, count(DISTINCT src) AS nodes, min(w) AS shortest, max(w) AS longest, CAST(sum(w) AS BIGINT) AS total FROM v_e")
def r29_graph_status(spark: SparkSession, folder: str) -> DataFrame:
    return lattice(spark).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("nodes"), F.min("w").alias("shortest"), F.max("w").alias("longest"), F.sum("w").alias("total"))


# --- bearings over a window, crossings near, lanes --------------------------------------------------

_BRG = "((degrees(atan2(sin(radians({b}lon - {a}lon)) * cos(radians({b}lat)), cos(radians({a}lat)) * sin(radians({b}lat)) - sin(radians({a}lat)) * cos(radians({b}lat)) * cos(radians({b}lon - {a}lon)))) + 360e0) % 360e0)"


@book(f"""WITH {VERTICES}, {_CUM}, v AS (SELECT segment_id, seq, lon, lat, {r_sql('cum', 4)} AS cum FROM cum), b AS (SELECT v.segment_id, v.seq, arg_max(j.seq, j.seq) AS js FROM v JOIN v j ON v.segment_id = j.segment_id AND j.seq < v.seq AND (v.cum - j.cum >= 25 OR j.seq = 0) GROUP BY 1, 2), a AS (SELECT v.segment_id, v.seq, min(k.seq) AS ks FROM v JOIN v k ON v.segment_id = k.segment_id AND k.seq > v.seq AND k.cum - v.cum >= 25 GROUP BY 1, 2),
l AS (SELECT segment_id, max(seq) AS last FROM v GROUP BY 1), p AS (SELECT v.segment_id, v.seq, v.lon, v.lat, js, coalesce(ks, last) AS ks FROM v JOIN b USING (segment_id, seq) JOIN l USING (segment_id) LEFT JOIN a ON a.segment_id = v.segment_id AND a.seq = v.seq WHERE v.seq < last)
SELECT p.segment_id, p.seq, {r_sql(_BRG.format(a='j.', b='p.'), 2)} AS bearing_in, {r_sql(_BRG.format(a='p.', b='k.'), 2)} AS bearing_out FROM p JOIN v j ON j.segment_id = p.segment_id AND j.seq = js JOIN v k ON k.segment_id = p.segment_id AND k.seq = ks""")
def m1_windowed_bearings(spark: SparkSession, folder: str, span: float = 25.0) -> DataFrame:
    """Bearings into and out of each inner vertex over at least span metres of whole pieces."""
    rows = _measured(spark, folder).select("segment_id", "seq", "lon", "lat", rounded(_c("cum"), 4).alias("cum"))
    lines = rows.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat", "cum"))).alias("v"))  # one line, as stored in one row
    p = lines.select("segment_id", "v", F.posexplode("v").alias("k", "p")).where((_c("k") > 0) & (_c("k") < F.size("v") - 1))
    before = F.filter("v", lambda q: (q["seq"] < _c("p.seq")) & ((_c("p.cum") - q["cum"] >= span) | (q["seq"] == 0)))
    after = F.filter("v", lambda q: (q["seq"] > _c("p.seq")) & ((q["cum"] - _c("p.cum") >= span) | (q["seq"] == F.size("v") - 1)))
    p = p.withColumns({"j": F.element_at(before, -1), "n": F.element_at(after, 1)})
    return p.select("segment_id", _c("p.seq").alias("seq"), rounded(geo.bearing("j.lon", "j.lat", "p.lon", "p.lat"), 2).alias("bearing_in"), rounded(geo.bearing("p.lon", "p.lat", "n.lon", "n.lat"), 2).alias("bearing_out"))


@book(f"""WITH {VERTICES}, {_CAMS}, d AS (SELECT segment_id, seq, id AS crossing, {r_sql(haversine_sql('v_vertex.lon', 'v_vertex.lat', 'cams.lon', 'cams.lat'))} AS metres FROM v_vertex JOIN cams ON abs(v_vertex.lat - cams.lat) < 0.0015 AND abs(v_vertex.lon - cams.lon) < 0.0017),
r AS (SELECT *, row_number() OVER (PARTITION BY segment_id, seq ORDER BY metres, crossing) AS k FROM d WHERE metres <= 150) SELECT segment_id, seq, crossing, metres FROM r WHERE k = 1""")
def m10_crossing_near(spark: SparkSession, folder: str, metres: float = 150.0) -> DataFrame:
    v = vertices(spark, folder).select(F.struct("segment_id", "seq").alias("id"), "lon", "lat")
    others = catalog(spark, folder).select(_c("id").alias("other_id"), _c("lon").alias("o_lon"), _c("lat").alias("o_lat"))
    return nearest(v, others, metres, geo.haversine("lon", "lat", "o_lon", "o_lat")).select("id.segment_id", "id.seq", _c("other_id").alias("crossing"), "metres")


# Lane marks that fit a manoeuvre.
FITTING = {"turn-left": ["left", "sharp_left", "merge_to_left"], "slight-left": ["slight_left", "left", "merge_to_left"], "turn-right": ["right", "sharp_right", "merge_to_right"]}
_FIT = ", ".join(f"('{k}', {v!r})" for k, v in FITTING.items())


@book(f"""WITH {TAGS_SQL}, f AS (SELECT * FROM (VALUES {_FIT}) x(step, fits)), l AS (SELECT id, step, fits, list_transform(string_split(turn_lanes, '|'), lambda c: list_filter(list_transform(string_split(c, ';'), lambda m: lower(trim(m))), lambda m: m <> '')) AS lanes FROM v_tags, f WHERE turn_lanes IS NOT NULL),
c AS (SELECT id, step, len(lanes) AS n, len(list_filter(lanes, lambda x: len(list_filter(x, lambda m: list_contains(fits, m))) > 0)) AS valid, len(list_filter(lanes, lambda x: len(x) > 0 AND len(list_filter(x, lambda m: NOT list_contains(fits, m))) = 0)) AS dedicated FROM l) SELECT id, step, valid, dedicated, n >= 2 AND valid BETWEEN 1 AND n - 1 AS useful FROM c""")
def m14_useful_lanes(spark: SparkSession, folder: str) -> DataFrame:
    """Lanes that serve a manoeuvre, those that serve nothing else, and whether showing them helps: some but not all do."""
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.array(*[F.lit(x) for x in v]).alias("fits")) for k, v in FITTING.items()]))
    marks = F.transform(F.split("turn_lanes", r"\|"), lambda c: F.filter(F.transform(F.split(c, ";"), lambda m: F.lower(F.trim(m))), lambda m: m != ""))
    l = tags(spark, folder).where("turn_lanes is not null").select("id", marks.alias("lanes"), steps.alias("s")).select("id", "lanes", "s.step", "s.fits")  # noqa: E741
    valid = F.size(F.filter("lanes", lambda x: F.arrays_overlap(x, "fits"))).cast("long")
    alone = F.size(F.filter("lanes", lambda x: (F.size(x) > 0) & (F.size(F.array_except(x, "fits")) == 0))).cast("long")
    l = l.withColumns({"valid": valid, "dedicated": alone})  # noqa: E741
    return l.select("id", "step", "valid", "dedicated", ((F.size("lanes") >= 2) & _c("valid").between(1, F.size("lanes") - 1)).alias("useful"))


# --- layers, epochs, journeys -----------------------------------------------------------------------


@book("WITH f AS (SELECT DISTINCT id, geometry_type FROM vector_features), r AS (SELECT id FROM f WHERE geometry_type = 'LineString'), p AS (SELECT DISTINCT substr(id, 2) AS ref FROM f WHERE geometry_type <> 'LineString' UNION SELECT substr(id, 2) FROM r WHERE CAST(substr(id, 2) AS BIGINT) % 2 = 0) SELECT id FROM r WHERE substr(id, 2) IN (SELECT ref FROM p)")
def l7_surviving_roads(spark: SparkSession, folder: str) -> DataFrame:
    """Roads whose paint may be drawn: those that something of the tile still refers to."""
    f = table(spark, folder, "vector_features").select("id", "geometry_type").distinct()
    road = _c("geometry_type") == "LineString"
    ref = F.substring("id", 2, 20).alias("ref")
    kept = f.where(~road).select(ref).unionByName(f.where(road & (F.substring("id", 2, 20).cast("long") % 2 == 0)).select(ref)).distinct()
    return f.where(road).withColumn("ref", F.substring("id", 2, 20)).join(kept, "ref", "left_semi").select("id")


@book(f"WITH {_FACTS}, b AS (SELECT DISTINCT id, FALSE AS learned FROM vector_features), u AS (SELECT * FROM b UNION ALL SELECT 'fact-' || fact_key, TRUE FROM v_fact WHERE confidence >= 0.6e0 AND fact_type IN ('poi', 'road')) SELECT learned, count(*) AS features FROM u GROUP BY 1")
def l14_merged_layers(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "vector_features").select("id").distinct().withColumn("learned", F.lit(False))
    learnt = facts(spark, folder).where("confidence >= 0.6 and fact_type in ('poi', 'road')").select(F.concat(F.lit("fact-"), _c("fact_key").cast("string")).alias("id"), F.lit(True).alias("learned"))
    return base.unionByName(learnt).groupBy("learned").agg(F.count("*").alias("features"))


@book("SELECT p_brand AS layer, max(p_size) + 1 AS next_epoch, '/tiles/' || p_brand || '/v' || (max(p_size) + 1) AS url FROM part GROUP BY 1")
def l15_epochs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "part").groupBy(_c("p_brand").alias("layer")).agg((F.max("p_size") + 1).alias("next_epoch"))
    return e.withColumn("url", F.concat(F.lit("/tiles/"), "layer", F.lit("/v"), _c("next_epoch").cast("string")))


_WALKS = "wk AS (SELECT c_custkey AS id, CAST(60 + (c_custkey * 17) % 1500 AS DOUBLE) AS direct_s, CAST(60 + (c_custkey * 17) % 1500 + (c_custkey * 31) % 900 AS DOUBLE) AS other_s, (c_custkey % 11) / 10e0 AS direct_x, (c_custkey * 3 % 11) / 10e0 AS other_x, CAST((c_custkey * 7) % 4000 AS DOUBLE) AS drive_s FROM customer)"
_MIN = "CASE WHEN {s} <= 0 THEN 0 ELSE greatest(1, CAST(floor({s} / 60e0 + 0.5e0) AS BIGINT)) END"


@book(f"WITH {_WALKS} SELECT id, (direct_x - other_x) * 100e0 >= 5 - 1e-9 AND (other_s - direct_s) / direct_s <= 0.6e0 AS offered, {_MIN.format(s='drive_s')} || ' min drive · ' || {_MIN.format(s='direct_s')} || ' min walk' AS summary FROM wk")
def k4_k5_journeys(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a cooler walk is offered (clearly more shade, at most 60 % longer), and the line that sums up a journey."""
    k = _c("c_custkey")
    w = table(spark, folder, "customer").select(k.alias("id"), (60 + (k * 17) % 1500).cast("double").alias("direct_s"), (60 + (k * 17) % 1500 + (k * 31) % 900).cast("double").alias("other_s"), (k % 11 / F.lit(10.0)).alias("direct_x"), (k * 3 % 11 / F.lit(10.0)).alias("other_x"), ((k * 7) % 4000).cast("double").alias("drive_s"))
    minutes = lambda s: F.when(_c(s) <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(_c(s) / 60 + 0.5))).cast("string")
    offered = ((_c("direct_x") - _c("other_x")) * 100 >= 5 - 1e-9) & ((_c("other_s") - _c("direct_s")) / _c("direct_s") <= 0.6)
    return w.select("id", offered.alias("offered"), F.concat(minutes("drive_s"), F.lit(" min drive · "), minutes("direct_s"), F.lit(" min walk")).alias("summary"))


@book("SELECT overture_key AS key, name, confidence, aliases[1] AS first_alias, {'lon': lon, 'lat': lat}.lon AS lon FROM (SELECT DISTINCT overture_key, name, confidence, aliases, lon, lat FROM poi_overture) q WHERE lon BETWEEN 51.0e0 AND 51.1e0 AND lat BETWEEN 25.0e0 AND 25.4e0 AND confidence >= 0.5e0")
def o6_overture_subset(spark: SparkSession, folder: str) -> DataFrame:
    """Places of a box above a confidence; the box and the columns reach the scan."""
    o = table(spark, folder, "poi_overture").where("lon between 51.0 and 51.1 and lat between 25.0 and 25.4 and confidence >= 0.5")
    return o.select("overture_key", "name", "confidence", "aliases", "lon", "lat").distinct().select(_c("overture_key").alias("key"), "name", "confidence", F.try_element_at("aliases", F.lit(1)).alias("first_alias"), "lon")


_TRACK = """tr AS (SELECT trip_pseudonym AS trip, '[' || lng || ',' || lat || ']' AS c, strftime(make_timestamp(t * 1000), '%Y-%m-%dT%H:%M:%SZ') AS ct FROM observation)"""


@book(f"WITH {_TRACK} SELECT trip, count(*) AS points, min(epoch_ms(CAST(replace(replace(ct, 'T', ' '), 'Z', '') AS TIMESTAMP))) AS began, max(CAST(json_extract(c, '$[1]') AS DOUBLE)) AS north FROM tr GROUP BY 1")
def o8_track_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates and times of tracks written and read again in the notation of GeoJSON."""
    o = table(spark, folder, "observation").select(_c("trip_pseudonym").alias("trip"), F.concat(F.lit("["), _c("lng"), F.lit(","), _c("lat"), F.lit("]")).alias("c"), F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ct"))
    read = o.select("trip", F.from_json("c", "array<double>").alias("c"), F.unix_millis(F.try_to_timestamp("ct", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("t"))
    return read.groupBy("trip").agg(F.count("*").alias("points"), F.min("t").alias("began"), F.max(F.element_at("c", 2)).alias("north"))


@book("WITH s AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '80' WHEN 1 THEN NULL WHEN 2 THEN '-5' ELSE '30 mph' END AS free, CASE p_partkey % 3 WHEN 0 THEN '60' WHEN 1 THEN NULL ELSE 'none' END AS limit_ FROM part) SELECT id, " + r_sql("coalesce(CASE WHEN free = '30 mph' THEN 30 * 1.60934e0 WHEN try_cast(free AS DOUBLE) > 0 THEN try_cast(free AS DOUBLE) END, CASE WHEN try_cast(limit_ AS DOUBLE) > 0 THEN try_cast(limit_ AS DOUBLE) END, 50e0)") + " AS free_flow_kmh FROM s")
def o17_segment_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Free flow of a segment from what it says, else its limit, else 50."""
    k = _c("p_partkey")
    free = F.when(k % 4 == 0, "80").when(k % 4 == 2, "-5").when(k % 4 == 3, "30 mph")
    limit = F.when(k % 3 == 0, "60").when(k % 3 == 2, "none")
    return table(spark, folder, "part").select(k.alias("id"), rounded(F.coalesce(maxspeed_float(free), maxspeed_float(limit), F.lit(50.0))).alias("free_flow_kmh"))


@book()
def k4_shade_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Shade along each line as bands, with the running seconds at walking pace."""
    s = shade_of_pieces(spark, folder)
    w = W.partitionBy("segment_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    band = F.when(_c("exposure") <= 0.3, "shade").when(_c("exposure") >= 0.7, "sun").otherwise("mixed")
    return s.select("segment_id", "seq", band.alias("band"), rounded(F.sum("metres").over(w) / 1.35, 1).alias("at_s"))
