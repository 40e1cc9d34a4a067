"""Steps and warnings along routes, arms of junctions, followers, and what goes out to other services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cairn.functions import geo, names as N
from cairn.operators import sequential as S, steps as P
from cairn.operators.spatial import bucket_join, padded
from cairn.plans import features, routing
from cairn.plans.base import PIECES, POIS, TAGS_SQL, VERTICES, Book, latest, pieces, pois, probes, r_sql, rounded, tags, vertices
from cairn.plans.guidance import signals
from cairn.plans.places import QUERIES_TEXT, _NORM, _Q, named
from cairn.plans.routing import _KEY, node_key, r1_edges
from cairn.plans.spatial import _CUM, _INC, _measured, haversine_sql, incident_points
from cairn.plans.tiles import _xy
from cairn.plans.traffic import matched
from cairn.storage import table

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col

# --- steps of routes ---------------------------------------------------------------------------------

#: Fixture: the tables give roads neither names nor classes; every three pieces of a line take the next of these.
HIGHWAYS = ["primary", "residential", None, "service", "motorway_link", "secondary"]
NAMES = ["Al Noor Street", None, "Corniche", "شارع الوادي", None]
NAMES_EN = ["Al Noor Street", None, None, "Wadi Street", None]


def _nth(values, key):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int"))


def _nth_sql(values, key):
    return "list_extract([" + ", ".join("CAST(NULL AS VARCHAR)" if v is None else f"'{v}'" for v in values) + f"], CAST({key} % {len(values)} + 1 AS INTEGER))"


def route_vertices(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of traffic_state as a route: its vertices as steps.maneuvers wants them, with choices read off the roads."""
    v = _measured(spark, folder).select(_c("segment_id").alias("route"), _c("seq").alias("i"), rounded(_c("cum")).alias("cum"), node_key(_c("lon"), _c("lat")).alias("node"))
    b = features.m1_windowed_bearings(spark, folder).select(_c("segment_id").alias("route"), _c("seq").alias("i"), "bearing_in", "bearing_out")
    w = W.partitionBy("route").orderBy("i")
    key = F.floor(_c("i") / 3) + F.ascii(F.substring("route", 5, 1))
    v = v.withColumns({"highway": _nth(HIGHWAYS, key), "name": _nth(NAMES, key), "name_en": _nth(NAMES_EN, key), "ring": ((_c("i") + F.ascii(F.substring("route", 6, 1))) % 13).isin(5, 6)})
    v = v.withColumns({"identity": F.coalesce("name", "highway"), "prior": F.lag("node").over(w), "next": F.lead("node").over(w)})
    v = v.withColumn("same_road", F.col("identity").eqNullSafe(F.lag("identity").over(w)) & (_c("i") > 0)).join(b, ["route", "i"], "left")
    e = r1_edges(spark, folder).select(_c("src").alias("node"), "dst").where("node <> dst").distinct()
    outs = v.select("route", "i", "node", "prior", "next").join(e, "node").groupBy("route", "i").agg(F.count(F.when(~_c("dst").eqNullSafe(_c("prior")), 1)).alias("outs"), F.count(F.when(~_c("dst").eqNullSafe(_c("prior")) & ~_c("dst").eqNullSafe(_c("next")), 1)).alias("others"))
    v = v.join(outs, ["route", "i"], "left").withColumns({"choice": F.coalesce("outs", F.lit(0)) > 1, "leaves": F.coalesce("others", F.lit(0)) > 0})
    return v.withColumn("delta", geo.angle_difference(_c("bearing_out"), _c("bearing_in")))


def _said(found: DataFrame, lang: str | None) -> DataFrame:
    shown = P.display_name(_c("name"), _c("name_en"), lang)
    return found.withColumn("instruction", P.instruction(_c("kind"), F.coalesce("bearing_out", F.lit(0.0)), P.road_label(_c("highway"), shown), F.coalesce("exit_number", F.lit(0)), _c("same_road")))


_K = "(i // 3 + ascii(substr(route, 5, 1)))"
_NORMAL = "(({a} + 540e0) % 360e0 - 180e0)"
_TURNS = "('slight-left', 'slight-right', 'turn-left', 'turn-right', 'uturn')"
_LABEL = "coalesce(nullif(shown, ''), CASE WHEN ends_with(lower(highway), '_link') THEN 'the slip road' END, CASE lower(highway) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ROAD_WORDS.items()) + " END, 'the road')"
_STEPS = f"""{VERTICES}, {_CUM}, e AS (SELECT DISTINCT src, dst FROM ({routing.SQL['r1_edges']}) q WHERE src <> dst), m1 AS ({features.SQL['m1_windowed_bearings']}),
v0 AS (SELECT segment_id AS route, seq AS i, {r_sql('cum')} AS cum, {_KEY} AS node FROM cum), v1 AS (SELECT *, {_nth_sql(HIGHWAYS, _K)} AS highway, {_nth_sql(NAMES, _K)} AS name, {_nth_sql(NAMES_EN, _K)} AS name_en, (i + ascii(substr(route, 6, 1))) % 13 IN (5, 6) AS ring0, lag(node) OVER w AS prior, lead(node) OVER w AS nxt, max(i) OVER (PARTITION BY route) AS last FROM v0 WINDOW w AS (PARTITION BY route ORDER BY i)),
v2 AS (SELECT *, i > 0 AND (coalesce(name, highway) IS NOT DISTINCT FROM lag(coalesce(name, highway)) OVER (PARTITION BY route ORDER BY i)) AS same_road, ring0 AND i < last AS ring FROM v1),
ou AS (SELECT route, i, count(*) FILTER (WHERE dst IS DISTINCT FROM prior) AS outs, count(*) FILTER (WHERE dst IS DISTINCT FROM prior AND dst IS DISTINCT FROM nxt) AS others FROM v2 JOIN e ON e.src = v2.node GROUP BY 1, 2),
v3 AS (SELECT v2.*, coalesce(outs, 0) > 1 AS choice, coalesce(others, 0) > 0 AS leaves, bearing_in, bearing_out, {_NORMAL.format(a='(bearing_out - bearing_in)')} AS raw, coalesce(lag(ring) OVER (PARTITION BY v2.route ORDER BY v2.i), FALSE) AS was FROM v2 LEFT JOIN ou ON ou.route = v2.route AND ou.i = v2.i LEFT JOIN m1 ON m1.segment_id = v2.route AND m1.seq = v2.i),
v4 AS (SELECT * EXCLUDE (raw), CASE WHEN raw < -180 THEN raw + 360 ELSE raw END AS delta, max(CASE WHEN ring AND NOT was THEN i END) OVER (PARTITION BY route ORDER BY i ROWS UNBOUNDED PRECEDING) AS began, sum(leaves::INT) OVER (PARTITION BY route ORDER BY i ROWS UNBOUNDED PRECEDING) AS lft, ring AND NOT was AND i > 0 AS entry FROM v3),
v5 AS (SELECT *, max(CASE WHEN entry THEN lft END) OVER (PARTITION BY route ORDER BY i ROWS UNBOUNDED PRECEDING) AS lft_in, min(CASE WHEN entry THEN cum END) OVER (PARTITION BY route ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_entry,
 CASE WHEN abs(delta) < 20 THEN 'continue' WHEN abs(delta) < 45 THEN CASE WHEN delta < 0 THEN 'slight-left' ELSE 'slight-right' END WHEN abs(delta) < 135 THEN CASE WHEN delta < 0 THEN 'turn-left' ELSE 'turn-right' END ELSE 'uturn' END AS turn FROM v4),
v6 AS (SELECT *, CASE WHEN i = last THEN 'arrive' WHEN i = 0 THEN 'depart' WHEN ring AND began > 0 THEN NULL WHEN was AND NOT ring AND began > 0 THEN 'roundabout' WHEN turn = 'uturn' THEN turn WHEN turn <> 'continue' AND NOT (same_road AND NOT choice) THEN turn WHEN NOT same_road THEN 'continue' END AS kind FROM v5),
v7 AS (SELECT *, kind IN {_TURNS} AS turning FROM v6 WHERE kind IS NOT NULL AND NOT (kind IN {_TURNS} AND coalesce(next_entry - cum <= 25, FALSE))),
v8 AS (SELECT *, (NOT coalesce(cum - lag(cum) OVER w < 25 AND abs(((delta - lag(delta) OVER w + 540e0) % 360e0) - 180e0) < 90, FALSE))::INT AS apart FROM v7 WINDOW w AS (PARTITION BY route, turning ORDER BY i)), v9 AS (SELECT *, sum(apart) OVER (PARTITION BY route, turning ORDER BY i ROWS UNBOUNDED PRECEDING) AS corner FROM v8),
man AS (SELECT *, CAST(CASE WHEN kind = 'roundabout' AND lft > lft_in THEN lft - lft_in END AS INTEGER) AS exit_number FROM (SELECT *, row_number() OVER (PARTITION BY route, turning, corner ORDER BY abs(delta) DESC, i) AS k FROM v9) q WHERE k = 1 OR NOT turning)"""
_COMPASS = "list_extract(['" + "', '".join(P.COMPASS) + "'], CAST(round_even((coalesce(bearing_out, 0e0) % 360e0) / 45e0, 0) AS INTEGER) % 8 + 1)"
_ORDINAL = "list_extract(['" + "', '".join(P.ORDINALS) + "'], exit_number)"


@book(f"""WITH {_STEPS}, l AS (SELECT *, coalesce(nullif(name_en, ''), name) AS shown FROM man), s AS (SELECT *, {_LABEL} AS road, CASE WHEN ends_with(kind, 'left') THEN 'left' ELSE 'right' END AS side FROM l)
SELECT route, i, cum, kind, exit_number, CASE WHEN kind = 'arrive' THEN 'Arrive at destination' WHEN kind IN ('slight-left', 'slight-right', 'turn-left', 'turn-right') AND same_road THEN CASE WHEN starts_with(kind, 'slight') THEN 'Bear ' ELSE 'Keep ' END || side || ' to stay on ' || road
 WHEN kind = 'roundabout' AND exit_number BETWEEN 1 AND 10 THEN 'At the roundabout, take the ' || {_ORDINAL} || ' exit onto ' || road WHEN kind = 'roundabout' THEN 'At the roundabout, exit onto ' || road WHEN kind = 'depart' THEN 'Head ' || {_COMPASS} || ' on ' || road
 WHEN starts_with(kind, 'slight') THEN 'Slight ' || side || ' onto ' || road WHEN starts_with(kind, 'turn') THEN 'Turn ' || side || ' onto ' || road WHEN kind = 'uturn' THEN 'Make a U-turn onto ' || road ELSE 'Continue on ' || road END AS instruction FROM s""")
def m3_m5_maneuvers(spark: SparkSession, folder: str, lang: str | None = "en") -> DataFrame:
    """Maneuvers of each line taken as a route and what is said of them, before spacing."""
    return _said(P.maneuvers(route_vertices(spark, folder)), lang).select("route", "i", "cum", "kind", "exit_number", "instruction")


@book()
def m3_route_steps(spark: SparkSession, folder: str, lang: str | None = None) -> DataFrame:
    """The steps of each route: maneuvers spaced by rank, each with the metres to the next."""
    kept = P.spaced_by_rank(_said(P.maneuvers(route_vertices(spark, folder)), lang).select("route", "i", "cum", "kind", "instruction"))
    w = W.partitionBy("route").orderBy("i")
    return kept.select("route", (F.row_number().over(w) - 1).alias("step"), "i", "kind", "instruction", rounded(F.coalesce(F.lead("cum").over(w) - _c("cum"), F.lit(0.0))).alias("distance_m"), "cum")


# --- warnings of bends --------------------------------------------------------------------------------

# Degrees over metres that make a bend, metres within which two are one, metres that a junction keeps clear.
BEND_DEG, BEND_M, BEND_MERGE_M, BEND_CLEAR_M, BEND_STEP_M = 40.0, 40.0, 220.0, 70.0, 10.0
_BEND_AT = "(SELECT max(k.seq) FROM c1 k WHERE k.segment_id = p.segment_id AND k.cum <= {at} AND k.seq < p.last)"


@book(f"""WITH {_STEPS}, c1 AS (SELECT segment_id, seq, {r_sql('cum')} AS cum FROM cum), pb AS (SELECT segment_id, seq, {features._BRG.format(a='a_', b='b_')} AS brg FROM (SELECT segment_id, seq, lon1 AS a_lon, lat1 AS a_lat, lon2 AS b_lon, lat2 AS b_lat FROM (WITH {PIECES} SELECT * FROM v_piece) z) y),
t AS (SELECT segment_id, max(cum) AS total, max(seq) AS last FROM c1 GROUP BY 1), p AS (SELECT segment_id, last, CAST(unnest(range(0, CAST(floor((total - 80e0) / 10e0) AS INTEGER) + 1)) AS DOUBLE) * 10e0 + 40e0 AS d FROM t WHERE total > 80),
q AS (SELECT p.segment_id, p.d, {_BEND_AT.format(at='p.d - 20')} AS a, {_BEND_AT.format(at='p.d + 20')} AS b FROM p), h AS (SELECT q.segment_id, q.d, {r_sql(_NORMAL.format(a='(y.brg - x.brg)'), 2)} AS turn0 FROM q JOIN pb x ON x.segment_id = q.segment_id AND x.seq = q.a JOIN pb y ON y.segment_id = q.segment_id AND y.seq = q.b),
h1 AS (SELECT segment_id, d, CASE WHEN turn0 < -180 THEN turn0 + 360 ELSE turn0 END AS turn FROM h), h2 AS (SELECT * FROM h1 WHERE abs(turn) >= 40 AND NOT EXISTS (SELECT 1 FROM man WHERE man.route = h1.segment_id AND man.kind NOT IN ('depart', 'arrive', 'continue') AND abs(man.cum - h1.d) < 70)),
h3 AS (SELECT *, (NOT coalesce(d - lag(d) OVER w <= 220, FALSE))::INT AS new FROM h2 WINDOW w AS (PARTITION BY segment_id ORDER BY d)), h4 AS (SELECT *, sum(new) OVER (PARTITION BY segment_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM h3)
SELECT segment_id, d AS at_m, turn FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, run ORDER BY abs(turn) DESC, d) AS k FROM h4) z WHERE k = 1""")
def m16_bend_callouts(spark: SparkSession, folder: str) -> DataFrame:
    """Sharp bends of each line: turns of 40 degrees over 40 m, none within 70 m of a maneuver that says so itself, those up to 220 m apart as one."""
    p = pieces(spark, folder).select("segment_id", "seq", geo.bearing("lon1", "lat1", "lon2", "lat2").alias("brg"))
    m = _measured(spark, folder).select("segment_id", "seq", rounded(_c("cum")).alias("cum"))
    total = m.groupBy("segment_id").agg(F.max("cum").alias("total"))
    lines = p.join(m, ["segment_id", "seq"]).groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("seq", "cum", "brg"))).alias("v")).join(total, "segment_id")  # one line, as stored in one row
    at = lines.where(_c("total") > 2 * BEND_M).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((_c("total") - 2 * BEND_M) / BEND_STEP_M).cast("int")))).withColumn("d", _c("k") * BEND_STEP_M + BEND_M)
    bearing = lambda d: F.element_at(F.filter("v", lambda q: q["cum"] <= d), -1)["brg"]
    hits = at.select("segment_id", "d", rounded(geo.angle_difference(bearing(_c("d") + BEND_M / 2), bearing(_c("d") - BEND_M / 2)), 2).alias("turn")).where(F.abs("turn") >= BEND_DEG)
    decided = P.maneuvers(route_vertices(spark, folder)).where(~_c("kind").isin("depart", "arrive", "continue")).select(_c("route").alias("segment_id"), _c("cum").alias("at"))
    hits = hits.join(decided, (hits.segment_id == decided.segment_id) & (F.abs(_c("at") - _c("d")) < BEND_CLEAR_M), "left_anti")
    w = W.partitionBy("segment_id").orderBy("d")
    hits = hits.withColumn("new", (~F.coalesce(_c("d") - F.lag("d").over(w) <= BEND_MERGE_M, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    best = hits.groupBy("segment_id", "run").agg(F.max(F.struct(F.abs("turn").alias("size"), (-_c("d")).alias("d"), "turn")).alias("b"))
    return best.select("segment_id", (-_c("b.d")).alias("at_m"), _c("b.turn").alias("turn"))


# --- arms of junctions, lane sidecar ------------------------------------------------------------------

#: Fixed value: degrees from which two arms of a junction are one road going on.
CONTINUATION_DEG = 150.0


@book(f"""WITH {VERTICES}, l AS (SELECT {routing._CELL} AS node, lead({routing._CELL}) OVER (PARTITION BY segment_id ORDER BY seq) AS other FROM v_vertex), a1 AS (SELECT DISTINCT CAST(node AS BIGINT) AS node, CAST(other AS BIGINT) AS other FROM (SELECT node, other FROM l WHERE other <> node UNION ALL SELECT other, node FROM l WHERE other <> node) q),
arm AS (SELECT node, other, {r_sql(features._BRG.format(a='a_', b='b_'), 2)} AS brg FROM (SELECT node, other, (node // 100000) * 0.004e0 AS a_lon, (node % 100000) * 0.004e0 AS a_lat, (other // 100000) * 0.004e0 AS b_lon, (other % 100000) * 0.004e0 AS b_lat FROM a1) q), j AS (SELECT node FROM arm GROUP BY 1 HAVING count(*) >= 3),
pr AS (SELECT x.node, x.other AS a, y.other AS b, abs(((x.brg - y.brg + 540e0) % 360e0) - 180e0) AS angle FROM arm x JOIN arm y ON x.node = y.node AND x.other <> y.other JOIN j ON j.node = x.node), bs AS (SELECT node, a, b FROM (SELECT *, row_number() OVER (PARTITION BY node, a ORDER BY angle DESC, b) AS k FROM pr WHERE angle >= {CONTINUATION_DEG}e0) q WHERE k = 1)
SELECT arm.node, arm.other AS arm, CASE WHEN r.a IS NOT NULL THEN 'through' ELSE 'branch' END AS role, CASE WHEN r.a IS NOT NULL THEN l.b END AS partner FROM arm JOIN j USING (node) LEFT JOIN bs l ON l.node = arm.node AND l.a = arm.other LEFT JOIN bs r ON r.node = arm.node AND r.a = l.b AND r.b = arm.other""")
def l25_arm_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Roles of the arms of junctions, where lines meet in one of the coarse cells; lines of the tables hardly ever share a vertex."""
    e = routing.cell_edges(spark, folder).where("src <> dst").select(_c("src").cast("long").alias("node"), _c("dst").cast("long").alias("other"))
    at = lambda c: (F.floor(_c(c) / 100000) * F.lit(0.004), (_c(c) % 100000) * F.lit(0.004))
    arms = e.unionByName(e.select(_c("other").alias("node"), _c("node").alias("other"))).distinct()
    return arm_roles(arms.withColumn("brg", rounded(geo.bearing(*at("node"), *at("other")), 2)))


def arm_roles(arms: DataFrame) -> DataFrame:
    """(node, arm, role, partner) of arms (node, other, brg): through where each of two is the other's best continuation, at least CONTINUATION_DEG apart, else branch; nodes of fewer than three arms are no junctions."""
    arms = arms.select("node", F.struct("other", "brg").alias("arm")).groupBy("node").agg(F.array_sort(F.collect_list("arm")).alias("arms")).where(F.size("arms") >= 3)  # the roads that meet in one place
    apart = lambda x, y: F.abs(geo.angle_difference(x["brg"], y["brg"]))
    far = lambda x: F.filter("arms", lambda y: (y["other"] != x["other"]) & (apart(x, y) >= CONTINUATION_DEG))
    best = F.transform("arms", lambda x: F.struct(x["other"].alias("other"), F.array_min(F.transform(far(x), lambda y: F.struct((-apart(x, y)).alias("angle"), y["other"].alias("b"))))["b"].alias("best")))
    out = arms.select("node", best.alias("bs")).select("node", "bs", F.explode("bs").alias("x"))
    mutual = F.exists("bs", lambda y: (y["other"] == _c("x.best")) & (y["best"] == _c("x.other")))
    return out.select("node", _c("x.other").alias("arm"), F.when(mutual, "through").otherwise("branch").alias("role"), F.when(mutual, _c("x.best")).alias("partner"))


# The tags of a way that the lanes sidecar keeps.
SIDECAR = ("layer", "lanes:forward", "lanes:backward", "lanes:both_ways")


@book(f"""WITH {TAGS_SQL}, s AS (SELECT 'w' || id AS way, CASE id % 5 WHEN 1 THEN '1' WHEN 2 THEN '-1' END AS layer, CASE WHEN lanes IS NOT NULL AND oneway IS NULL THEN lanes END AS f, CASE WHEN lanes = '3' THEN '1' END AS b, highway, id % 4 AS nodes FROM v_tags)
SELECT way, 'layer' AS key, layer AS value FROM s WHERE highway IS NOT NULL AND nodes >= 2 AND layer IS NOT NULL UNION ALL SELECT way, 'lanes:forward', f FROM s WHERE highway IS NOT NULL AND nodes >= 2 AND f IS NOT NULL UNION ALL SELECT way, 'lanes:backward', b FROM s WHERE highway IS NOT NULL AND nodes >= 2 AND b IS NOT NULL""")
def n11_lane_sidecar(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar's tags of roads of two nodes and more, over the fixture of tags."""
    k = _c("id")
    kept = F.create_map(F.lit("layer"), F.when(k % 5 == 1, "1").when(k % 5 == 2, "-1"), F.lit("lanes:forward"), F.when(_c("oneway").isNull(), _c("lanes")), F.lit("lanes:backward"), F.when(_c("lanes") == "3", "1"), F.lit("surface"), _c("surface"))
    ways = tags(spark, folder).select(F.concat(F.lit("w"), k).alias("way"), "highway", F.sequence(F.lit(1), F.lit(1) + k % 4).alias("nodes"), kept.alias("tags"))
    return lane_sidecar(ways.where("highway is not null")).select("way", F.explode("tags").alias("key", "value"))


def lane_sidecar(ways: DataFrame) -> DataFrame:
    """(way, nodes, tags) of ways (way, nodes array, tags map) of at least two nodes: the node ids and the sidecar's non-empty tags."""
    some = F.map_filter("tags", lambda key, value: key.isin(*SIDECAR) & value.isNotNull() & (value != ""))
    return ways.where(F.size("nodes") > 2).select("way", "nodes", some.alias("tags"))


# --- lanes of a route ---------------------------------------------------------------------------------

# Metres of a lane, the side driven on.
LANE_M, DRIVE_SIDE = 3.5, 1.0


def carriageway(forward, total):
    """(offset_m, width_m) of the driver's carriageway from the line of its road: on the line if all lanes go forward, half its width to the side if half of them do; null if nothing is known."""
    width = forward * LANE_M
    known = (forward > 0) & ((total == forward) | (total == 2 * forward))
    return F.when(known, F.when(total == forward, 0.0).otherwise(DRIVE_SIDE * width * 0.5)), F.when(known, width)


def lateral_at(before, after):
    """Offset at a place (at) between two of known offset (at, offset): straight from one to the other, the nearest beyond the ends."""
    span = after["at"] - before["at"]
    share = F.when(span <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_c("at") - before["at"]) / span)))
    return F.when(before.isNull(), after["offset"]).when(after.isNull(), before["offset"]).otherwise(before["offset"] + (after["offset"] - before["offset"]) * share)


_TOTAL = "CASE lanes WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 END"
_FORWARD = f"CASE WHEN oneway IN ('yes', 'true', '1') THEN {_TOTAL} WHEN {_TOTAL} % 2 = 0 THEN {_TOTAL} // 2 END"


@book(f"WITH {TAGS_SQL}, l AS (SELECT id, {_TOTAL} AS total, {_FORWARD} AS fwd FROM v_tags) SELECT id, CASE WHEN fwd > 0 AND total = fwd THEN 0e0 WHEN fwd > 0 AND total = 2 * fwd THEN fwd * 3.5e0 * 0.5e0 END AS offset_m, CASE WHEN fwd > 0 AND (total = fwd OR total = 2 * fwd) THEN fwd * 3.5e0 END AS width_m FROM l")
def m17_carriageways(spark: SparkSession, folder: str) -> DataFrame:
    """Where the driver's carriageway lies beside the line of its road, over the fixture of tags."""
    total = F.when(_c("lanes").isin("1", "2", "3"), _c("lanes").cast("int"))
    forward = F.when(_c("oneway").isin("yes", "true", "1"), total).when(total % 2 == 0, (total / 2).cast("int"))
    t = tags(spark, folder).withColumns({"total": total, "forward": forward})
    offset, width = carriageway(_c("forward"), _c("total"))
    return t.select("id", offset.alias("offset_m"), width.alias("width_m"))


# --- walks --------------------------------------------------------------------------------------------


def walk_summary(walks: DataFrame) -> DataFrame:
    """walks (walk, points array of (lon, lat), from, to as (lon, lat)) with route_m, snap_straight_m between the ends of the way, requested_straight_m between the places asked for, and detour_ratio where the ends are more than a metre apart."""
    apart = lambda a, b: geo.haversine(a["lon"], a["lat"], b["lon"], b["lat"])
    pieces_ = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), apart)
    w = walks.where(F.size("points") >= 2).withColumns({"route": F.aggregate(pieces_, F.lit(0.0), lambda a, x: a + x), "snap": apart(F.element_at("points", 1), F.element_at("points", -1)), "asked": apart(_c("from"), _c("to"))})
    return w.select("walk", rounded(_c("route"), 1).alias("route_m"), rounded(_c("snap"), 1).alias("snap_straight_m"), rounded(_c("asked"), 1).alias("requested_straight_m"), F.when(_c("snap") > 1, rounded(_c("route") / _c("snap"), 2)).alias("detour_ratio"))


_ENDS = ", ".join(f"{r_sql(f'{which}({c}, seq)', 3)} AS {name}_{c}" for which, name in (("arg_min", "a"), ("arg_max", "b")) for c in ("lon", "lat"))


@book(f"""WITH {VERTICES}, {_CUM}, e AS (SELECT segment_id, max(cum) AS route, arg_min(lon, seq) AS x1, arg_min(lat, seq) AS y1, arg_max(lon, seq) AS x2, arg_max(lat, seq) AS y2, {_ENDS}, count(*) AS n FROM cum GROUP BY 1), dd AS (SELECT *, {haversine_sql("x1", "y1", "x2", "y2")} AS snap FROM e WHERE n >= 2)
SELECT segment_id AS walk, {r_sql('route', 1)} AS route_m, {r_sql('snap', 1)} AS snap_straight_m, {r_sql(haversine_sql('a_lon', 'a_lat', 'b_lon', 'b_lat'), 1)} AS requested_straight_m, CASE WHEN snap > 1 THEN {r_sql('route / snap', 2)} END AS detour_ratio FROM dd""")
def r23_walks(spark: SparkSession, folder: str) -> DataFrame:
    """Every line as a walk between places that were asked for to three decimals."""
    from cairn.plans.base import lines

    at = lambda k: F.element_at("line", k)
    asked = lambda p: F.struct(rounded(p["lon"], 3).alias("lon"), rounded(p["lat"], 3).alias("lat"))
    rows = lines(spark, folder).where(F.size("line") >= 2)
    return walk_summary(rows.select(_c("segment_id").alias("walk"), _c("line").alias("points"), asked(at(1)).alias("from"), asked(at(-1)).alias("to")))


# --- what goes out ------------------------------------------------------------------------------------


def fan_out(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What viewers and the routing overlay get of segment states (segment_id, line, free_flow_kmh, mean_speed_kmh): points by longitude first, and by latitude first."""
    swapped = F.transform("line", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return states.select("segment_id", _c("line").alias("coordinates"), "free_flow_kmh", "mean_speed_kmh"), states.select(swapped.alias("geometry"), "free_flow_kmh", "mean_speed_kmh")


@book(f"""WITH {VERTICES}, s AS (SELECT segment_id, arg_max(struct_pack(m := mean_speed_kmh), (updated_at, probe_count, coalesce(mean_speed_kmh, -1e0))).m AS mean_speed_kmh FROM traffic_state GROUP BY 1), g AS (SELECT segment_id, max(free_flow_kmh) AS free_flow_kmh, count(*) AS points, arg_min(lat, seq) AS first_lat, arg_min(lon, seq) AS first_lon FROM v_vertex GROUP BY 1)
SELECT points, first_lat, first_lon, free_flow_kmh, mean_speed_kmh FROM g JOIN s USING (segment_id)""")
def t13_overlay_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The latest state of each segment as it is sent on to the routing overlay."""
    from cairn.plans.base import lines

    t = table(spark, folder, "traffic_state").groupBy("segment_id").agg(F.max_by(F.struct("mean_speed_kmh"), F.struct("updated_at", "probe_count", F.coalesce("mean_speed_kmh", F.lit(-1.0)))).alias("m")).select("segment_id", "m.mean_speed_kmh")
    _, overlay = fan_out(lines(spark, folder).join(t, "segment_id"))
    first = F.get("geometry", F.lit(0))
    return overlay.select(F.size("geometry").cast("long").alias("points"), first["lat"].alias("first_lat"), first["lon"].alias("first_lon"), "free_flow_kmh", "mean_speed_kmh")


@book(f"""WITH {_NORM}, {_Q}, l AS (SELECT DISTINCT canonical_id AS key, name, coalesce(nullif(name_en, ''), name) AS shown FROM canonical_poi WHERE trim(name) <> '') SELECT DISTINCT q, key, name AS label, 'index' AS found FROM v_n, v_q WHERE contains(v_n.norm, v_q.norm) UNION SELECT q, key, shown, 'learned' FROM l, v_q WHERE contains(lower(l.name), lower(trim(q)))""")
def c13_search_with_learned(spark: SparkSession, folder: str, lang: str = "en") -> DataFrame:
    """Places whose name holds a text, and learned ones likewise, with the name to show in a language. The texts are the few of QUERIES_TEXT, the places all."""
    q = spark.createDataFrame([(x,) for x in QUERIES_TEXT], "q string").withColumn("qn", N.normalize(_c("q")))  # ten texts
    known = named(spark, folder).join(F.broadcast(q), F.contains("norm", "qn")).select("q", "key", _c("name").alias("label"), F.lit("index").alias("found"))
    learned = table(spark, folder, "canonical_poi").where("trim(name) <> ''").select("canonical_id", "name", P.display_name(_c("name"), _c("name_en"), lang).alias("shown")).distinct()
    learned = learned.join(F.broadcast(q), F.contains(F.lower("name"), F.lower(F.trim("q")))).select("q", _c("canonical_id").alias("key"), _c("shown").alias("label"), F.lit("learned").alias("found"))
    return known.unionByName(learned).distinct()


# --- tiles on demand, gaps, truncation ----------------------------------------------------------------

_BOXES = f"b AS (SELECT segment_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM v_vertex GROUP BY 1), t AS (SELECT segment_id, {_xy('w', 'n', 14, 'a')}, {_xy('e', 's', 14, 'b_')} FROM b), cover AS (SELECT segment_id, x, unnest(range(ay, b_y + 1)) AS y FROM (SELECT segment_id, unnest(range(ax, b_x + 1)) AS x, ay, b_y FROM t) q)"


def covered_tiles(spark: SparkSession, folder: str, zoom: int = 14) -> DataFrame:
    """(segment_id, x, y): the tiles that the box of each line touches."""
    b = vertices(spark, folder).groupBy("segment_id").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    (ax, ay), (bx, by) = geo.tile("w", "n", zoom), geo.tile("e", "s", zoom)
    t = b.select("segment_id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    return t.withColumn("x", F.explode(F.sequence("ax", "bx"))).withColumn("y", F.explode(F.sequence("ay", "by"))).select("segment_id", "x", "y")


@book(f"""WITH {VERTICES}, {_BOXES}, {_INC}, r AS (SELECT DISTINCT {_xy('lon', 'lat', 14, '')} FROM pts) SELECT CAST(r.x AS BIGINT) AS x, CAST(r.y AS BIGINT) AS y, count(segment_id) AS features, count(segment_id) = 0 AS empty FROM r LEFT JOIN cover USING (x, y) GROUP BY r.x, r.y""")
def l12_on_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles asked for, those that reports lie in, each with the lines its box may hold; an empty one is an answer too."""
    x, y = geo.tile("lon", "lat", 14)
    asked = incident_points(spark, folder).select(x.alias("x"), y.alias("y")).distinct()
    return asked.join(covered_tiles(spark, folder), ["x", "y"], "left").groupBy(_c("x").cast("long").alias("x"), _c("y").cast("long").alias("y")).agg(F.count("segment_id").alias("features"), (F.count("segment_id") == 0).alias("empty"))


# The box of the capital and the zooms in which no tile may be missing.
GAP_BOX, GAP_ZOOMS = (51.30, 25.10, 51.80, 25.50), range(8, 13)
_GRID_SQL = " UNION ALL ".join(f"SELECT {z} AS z, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM (SELECT {_xy('51.30e0', '25.50e0', z, '').replace('AS x', 'AS x0').replace('AS y', 'AS y0')}, {_xy('51.80e0', '25.10e0', z, '').replace('AS x', 'AS x1').replace('AS y', 'AS y1')}) a) b" for z in GAP_ZOOMS)
_BAKED_SQL = " UNION ALL ".join(f"SELECT DISTINCT {z} AS z, {_xy('lon', 'lat', z, '')} FROM v_vertex" for z in GAP_ZOOMS)


@book(f"WITH {VERTICES}, g AS ({_GRID_SQL}), k AS ({_BAKED_SQL}) SELECT z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM g WHERE (z, x, y) NOT IN (SELECT (z, x, y) FROM k)")
def l29_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles of the capital's box that no vertex of a road has caused to be baked, by zoom."""
    zooms = spark.createDataFrame([(z,) for z in GAP_ZOOMS], "z int")
    west, south, east, north = GAP_BOX
    grid, baked = None, None
    for z in GAP_ZOOMS:
        (x0, y0), (x1, y1), (x, y) = geo.tile(west, north, z), geo.tile(east, south, z), geo.tile("lon", "lat", z)
        g = zooms.where(_c("z") == z).withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))
        grid = g if grid is None else grid.unionByName(g)
    v = vertices(spark, folder)
    per_zoom = [F.struct(F.lit(z).alias("z"), geo.tile("lon", "lat", z)[0].alias("x"), geo.tile("lon", "lat", z)[1].alias("y")) for z in GAP_ZOOMS]
    baked = v.select(F.explode(F.array(*per_zoom)).alias("t")).select("t.*").distinct()
    return grid.join(baked, ["z", "x", "y"], "left_anti").select("z", _c("x").cast("long").alias("x"), _c("y").cast("long").alias("y"))


# The order in which kinds of features are kept in a full tile; major roads before other roads.
KIND_ORDER, MAJOR = {"water": 1, "park": 2, "natural": 2, "landuse": 3, "label": 4, "building": 5}, ("motorway", "trunk", "primary", "secondary")
_RANK = "CASE WHEN kind = 'road' THEN 0 " + " ".join(f"WHEN kind = '{k}' THEN {n}" for k, n in KIND_ORDER.items()) + " ELSE 6 END"
_KINDS = ["road", "water", "building", "park", "label", "landuse", "other"]


@book(f"""WITH {TAGS_SQL}, f AS (SELECT id, {_nth_sql(_KINDS, 'id')} AS kind, lower(highway) AS highway, id % 40 AS tile FROM v_tags), r AS (SELECT id, tile, row_number() OVER (PARTITION BY tile ORDER BY {_RANK}, CASE WHEN kind = 'road' AND (highway IS NULL OR highway NOT IN ('motorway', 'trunk', 'primary', 'secondary')) THEN 1 ELSE 0 END, id) AS k FROM f) SELECT tile, id FROM r WHERE k <= 25""")
def l29_truncated(spark: SparkSession, folder: str, most: int = 25) -> DataFrame:
    """The features that a tile of limited room keeps, by kind and class of road; over the fixture of tags, forty tiles."""
    f = tags(spark, folder).select("id", _nth(_KINDS, _c("id")).alias("kind"), F.lower("highway").alias("highway"), (_c("id") % 40).alias("tile"))
    rank = F.when(_c("kind") == "road", 0)
    for kind, n in KIND_ORDER.items():
        rank = rank.when(_c("kind") == kind, n)
    minor = F.when((_c("kind") == "road") & ~F.coalesce(_c("highway").isin(*MAJOR), F.lit(False)), 1).otherwise(0)
    return f.withColumn("k", F.row_number().over(W.partitionBy("tile").orderBy(rank.otherwise(6), minor, "id"))).where(_c("k") <= most).select("tile", "id")


# --- followers ----------------------------------------------------------------------------------------


def followed(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes near the line their segment is matched to, with their feet on all its pieces within 500 m: feet array<struct(along, offset)>."""
    fixes = S.stretches(probes(spark, folder).select("trip", "t", "id", "lon", "lat", "speed", "accuracy")).join(matched(spark, folder).select("id", "segment_id"), "id")
    m = _measured(spark, folder).select("segment_id", "seq", "cum")
    p = pieces(spark, folder).join(m, ["segment_id", "seq"]).select("segment_id", "seq", "cum", "lon1", "lat1", "lon2", "lat2")
    near = fixes.join(p, "segment_id")  # the pieces of the one line a fix is matched to
    t, off = geo.planar_offset("lon", "lat", "lon1", "lat1", "lon2", "lat2")
    near = near.withColumns({"along": _c("cum") + t * geo.haversine("lon1", "lat1", "lon2", "lat2"), "offset": off}).where("offset <= 500")
    return near.groupBy("id", "trip", "part", "segment_id", "t", "speed", "accuracy").agg(F.array_sort(F.collect_list(F.struct(rounded(_c("along"), 2).alias("along"), rounded(_c("offset"), 2).alias("offset")))).alias("feet"))


@book()
def k7_route_tracker(spark: SparkSession, folder: str) -> DataFrame:
    """State of a vehicle's tracker after each fix: on the route, off it, and where along it."""
    rows = followed(spark, folder)
    return S.scan(rows, ["trip", "part", "segment_id"], ["t", "id"], S.route_tracker(), "state string, along_m double", ["id", "segment_id"])


@book()
def k8_walk_follower(spark: SparkSession, folder: str) -> DataFrame:
    """State of a walker's follower after each fix: on the route, uncertain or off it, and where along it."""
    rows = followed(spark, folder)
    return S.scan(rows, ["trip", "part", "segment_id"], ["t", "id"], S.walk_follower(), "state string, along_m double", ["id", "segment_id"])


@book()
def k17_matched_signals(spark: SparkSession, folder: str, within: float = 25.0, merge_m: float = 10.0) -> DataFrame:
    """Signals on a line at their earliest pass within reach, without second nodes of the same lights."""
    near = bucket_join(signals(spark, folder), padded(pieces(spark, folder).drop("free_flow_kmh"), within * 1.2), 0.003)
    t, off = geo.planar_offset("lon", "lat", "lon1", "lat1", "lon2", "lat2")
    m = _measured(spark, folder).select("segment_id", "seq", "cum")
    hit = near.withColumns({"t": t, "off": off}).where(_c("off") <= within).join(m, ["segment_id", "seq"]).withColumn("along", rounded(_c("cum") + _c("t") * geo.haversine("lon1", "lat1", "lon2", "lat2"), 1))
    first = hit.groupBy("segment_id", "id").agg(F.min("along").alias("along"), F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    kept = S.scan(first, ["segment_id"], ["along", "id"], S.same_lights(merge_m), "kept boolean", ["segment_id", "id", "along"])
    return kept.where("kept").select("segment_id", "id", _c("along").alias("along_m"))
