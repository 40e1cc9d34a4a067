"""Routing over the roads of traffic_state: paths, banned turns, barriers, alternatives, learned speeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.operators import graph
from cairn.plans import routing
from cairn.plans.base import PIECES, Book, pieces, r_sql, rounded
from cairn.plans.routing import _KEY, node_key, r1_edges
from cairn.storage import materialize, table

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col
#: Key that no place has: where a route is before its first edge.
NOWHERE = -(2**63)
#: An alternative has at most this share in common with the first path, and is at most so many times as long.
MOST_OVERLAP, MOST_DETOUR = 0.7, 1.6
_ROADS = f"r1 AS ({routing.SQL['r1_edges']}), v_e AS (SELECT src, dst, greatest(1, CAST(floor(metres * 1000 + 0.5e0) AS BIGINT)) AS w FROM r1 WHERE src <> dst)"


def road_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Directed edges (src, dst, w) of all roads, w in whole millimetres so that sums are exact."""
    e = r1_edges(spark, folder).where("src <> dst")
    return e.select("src", "dst", F.greatest(F.lit(1).cast("long"), F.floor(_c("metres") * 1000 + 0.5).cast("long")).alias("w"))


def starts(edges: DataFrame) -> DataFrame:
    """One node per connected part of the roads: the least that edges only leave, else the least that any leaves."""
    left = edges.select(_c("src").alias("node")).distinct()
    entered = edges.select(_c("dst").alias("node"), F.lit(True).alias("entered")).distinct()
    nodes = left.join(entered, "node", "left").join(graph.components(edges), "node")
    return nodes.groupBy("component").agg(F.min(F.struct(F.coalesce("entered", F.lit(False)).alias("entered"), "node")).alias("m")).select("m.node")


def farthest(found: DataFrame) -> DataFrame:
    """(source, target): the dearest node reached from each source."""
    return found.groupBy("source").agg(F.min(F.struct((-_c("cost")).alias("cost"), "node")).alias("m")).select("source", _c("m.node").alias("target"))


@book()
def r3_r4_road_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Least cost from the start of each connected part of the roads to every node it reaches."""
    e = materialize(road_edges(spark, folder), "roads")
    return graph.shortest_paths(e, starts(e)).select("source", "node", "cost")


_TURN_BAN = "l AS (SELECT src AS a, dst AS b FROM v_e UNION SELECT dst, src FROM v_e), ban AS (SELECT x.a AS f, x.b AS v, y.b AS t FROM l x JOIN l y ON x.b = y.a WHERE x.a <> y.b AND x.b % 3 = 1 AND x.a % 7 < 4)"


def road_bans(edges: DataFrame) -> DataFrame:
    """Banned turns (from, via, to), as signs stand: directions of the roads aside."""
    link = edges.select(_c("src").alias("from"), _c("dst").alias("via")).union(edges.select("dst", "src")).distinct()
    onward = link.select(_c("from").alias("via"), _c("via").alias("to"))
    return link.where("via % 3 = 1 and `from` % 7 < 4").join(onward, "via").where("`from` <> to").select("from", "via", "to")


@book()
def r5_r15_road_turns(spark: SparkSession, folder: str) -> DataFrame:
    """r3_r4_road_paths without the banned turns; a start is reached again only by a way back."""
    e = materialize(road_edges(spark, folder), "roads")
    s = materialize(starts(e), "starts")
    start = F.struct(F.lit(NOWHERE).cast("long").alias("src"), _c("node").alias("dst"))
    first = e.join(s, e.src == s.node).select(start.alias("src"), F.struct("src", _c("dst")).alias("dst"), "w")
    found = graph.shortest_paths(graph.turn_states(e, road_bans(e)).unionByName(first), s.select(start.alias("node")))
    return found.where(_c("node.src") != NOWHERE).groupBy(_c("source.dst").alias("source"), _c("node.dst").alias("node")).agg(F.min("cost").alias("cost"))


@book(f"WITH {_ROADS}, {_TURN_BAN} SELECT count(*) AS bans, count(DISTINCT v) AS vias, (SELECT count(*) FROM ban JOIN v_e i ON i.src = f AND i.dst = v JOIN v_e o ON o.src = v AND o.dst = t) AS on_graph FROM ban")
def r13_r14_road_restrictions(spark: SparkSession, folder: str) -> DataFrame:
    """Banned turns, and those of them whose approach and exit can be driven."""
    e = materialize(road_edges(spark, folder), "roads")
    into, out = e.select(_c("src").alias("from"), _c("dst").alias("via"), F.lit(1).alias("into")), e.select(_c("src").alias("via"), _c("dst").alias("to"), F.lit(1).alias("out"))
    here = road_bans(e).join(into, ["from", "via"], "left").join(out, ["via", "to"], "left")
    return here.agg(F.count("*").alias("bans"), F.countDistinct("via").alias("vias"), F.count(F.when(_c("into").isNotNull() & _c("out").isNotNull(), 1)).alias("on_graph"))


@book(f"WITH {_ROADS}, b AS (SELECT node FROM (SELECT src AS node FROM v_e UNION SELECT dst FROM v_e) q WHERE node % 11 = 5), k AS (SELECT * FROM v_e WHERE src NOT IN (SELECT node FROM b) AND dst NOT IN (SELECT node FROM b)) SELECT (SELECT count(*) FROM b) AS blocked, (SELECT count(*) FROM v_e) - (SELECT count(*) FROM k) AS edges_removed, (SELECT count(*) FROM k) AS edges_left")
def r16_road_barriers(spark: SparkSession, folder: str) -> DataFrame:
    e = materialize(road_edges(spark, folder), "roads")
    b = e.select(_c("src").alias("node")).union(e.select("dst")).where("node % 11 = 5").distinct()
    left, n = graph.without_barriers(e, b).agg(F.count("*").alias("edges_left")), e.agg(F.count("*").alias("n"))
    return b.agg(F.count("*").alias("blocked")).crossJoin(F.broadcast(left)).crossJoin(F.broadcast(n)).select("blocked", (_c("n") - _c("edges_left")).alias("edges_removed"), "edges_left")


@book()
def r24_road_path(spark: SparkSession, folder: str) -> DataFrame:
    """Edges and cost of the cheapest path from each start to the dearest node it reaches."""
    e = materialize(road_edges(spark, folder), "roads")
    found = graph.shortest_paths(e, starts(e))
    return graph.paths_back(found, farthest(found)).join(e, ["src", "dst"]).groupBy("source", "target").agg(F.count("*").alias("hops"), F.sum("w").alias("cost"))


@book()
def r25_alternative(spark: SparkSession, folder: str, penalty: int = 3) -> DataFrame:
    """For each start: the cheapest path to its dearest node and a second one found with the first one's edges made dearer.

    There is one start in each connected part, so all parts are searched at once and no path dears another's edges.
    """
    e = materialize(road_edges(spark, folder), "roads")
    s = materialize(starts(e), "starts")
    found = graph.shortest_paths(e, s)
    ends = materialize(farthest(found), "ends")
    first = materialize(graph.paths_back(found, ends).select("src", "dst", F.lit(1).alias("used")), "first")
    dearer = e.join(first, ["src", "dst"], "left").select("src", "dst", (_c("w") * F.when(_c("used") == 1, penalty).otherwise(1)).alias("w"))
    second = graph.paths_back(graph.shortest_paths(dearer, s), ends).join(e, ["src", "dst"]).join(first, ["src", "dst"], "left")
    both = second.groupBy("source", "target").agg(F.sum("w").alias("cost"), rounded(F.coalesce(F.sum(F.when(_c("used") == 1, _c("w"))), F.lit(0)) / F.sum("w")).alias("overlap"))
    least = found.select("source", _c("node").alias("target"), _c("cost").alias("least_cost"))
    return both.join(least, ["source", "target"]).select("source", "target", "least_cost", "cost", "overlap", ((_c("overlap") <= MOST_OVERLAP) & (_c("cost") <= _c("least_cost") * MOST_DETOUR)).alias("offered"))


@book(f"WITH {_ROADS} SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT src FROM v_e UNION SELECT dst FROM v_e) q) AS nodes, min(w) AS shortest, max(w) AS longest, CAST(sum(w) AS BIGINT) AS total FROM v_e")
def r29_road_status(spark: SparkSession, folder: str) -> DataFrame:
    e = materialize(road_edges(spark, folder), "roads")
    nodes = e.select(_c("src").alias("node")).union(e.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    return e.agg(F.count("*").alias("edges"), F.min("w").alias("shortest"), F.max("w").alias("longest"), F.sum("w").alias("total")).crossJoin(F.broadcast(nodes))


@book(f"""WITH {_ROADS}, sp AS (SELECT segment_id, epoch_ms(updated_at) AS ms, CAST(epoch_ms(updated_at) // 10800000 % 8 AS INTEGER) AS band, mean_speed_kmh AS kmh FROM traffic_state WHERE mean_speed_kmh > 0 AND updated_at IS NOT NULL),
pc AS (SELECT segment_id, {_KEY.replace('lon', 'lon1').replace('lat', 'lat1')} AS a, {_KEY.replace('lon', 'lon2').replace('lat', 'lat2')} AS b, coalesce(free_flow_kmh, 50e0) AS free FROM (WITH {PIECES} SELECT * FROM v_piece) q),
o AS (SELECT * FROM (SELECT least(a, b) AS a, greatest(a, b) AS b, band, kmh, free, row_number() OVER (PARTITION BY least(a, b), greatest(a, b), band ORDER BY ms DESC, kmh DESC, free DESC) AS k FROM pc JOIN sp USING (segment_id)) q WHERE k = 1),
j AS (SELECT o.*, e.src FROM o LEFT JOIN v_e e ON (e.src = a AND e.dst = b) OR (e.src = b AND e.dst = a)) SELECT band, count(src) AS directed_edges, count(DISTINCT CASE WHEN src IS NULL THEN (a, b) END) AS unresolved, {r_sql('max(greatest(0.25e0, least(10e0, free / kmh)))', 4)} AS slowest FROM j GROUP BY 1""")
def r11_road_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """The latest speed of each road and three hours of the day, resolved to the directed edges of its pieces."""
    at = F.unix_millis("updated_at")
    speeds = table(spark, folder, "traffic_state").where("mean_speed_kmh > 0 and not isnan(mean_speed_kmh) and updated_at is not null").select("segment_id", (F.floor(at / 10800000) % 8).cast("int").alias("band"), F.struct(at.alias("at"), _c("mean_speed_kmh").alias("kmh")).alias("s"))
    speeds = speeds.groupBy("segment_id", "band").agg(F.max("s").alias("s"))
    a, b = node_key(_c("lon1"), _c("lat1")), node_key(_c("lon2"), _c("lat2"))
    p = pieces(spark, folder).select("segment_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.coalesce("free_flow_kmh", F.lit(50.0)).alias("free"))
    o = p.join(speeds, "segment_id").groupBy("a", "b", "band").agg(F.max(F.struct("s.at", "s.kmh", "free")).alias("m")).select("a", "b", "band", "m.kmh", "m.free")
    edge = road_edges(spark, folder).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
    factor = F.greatest(F.lit(0.25), F.least(F.lit(10.0), _c("free") / _c("kmh")))
    return o.join(edge, ["a", "b"], "left").groupBy("band").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("directed_edges"), F.count(F.when(_c("n").isNull(), 1)).alias("unresolved"), rounded(F.max(factor), 4).alias("slowest"))
