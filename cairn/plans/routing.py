"""Road graph: edges, snapping, restrictions, barriers, components, shortest paths, alternatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cairn.functions import geo
from cairn.operators import graph
from cairn.operators.spatial import bucket_join, nearest, padded
from cairn.plans.base import PIECES, VERTICES, Book, pieces, r_sql, rounded, vertices
from cairn.plans.spatial import _INC, haversine_sql, incident_points

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col
#: Side of the lattice by which path searches are held against SQL; the roads themselves are searched in roads.py. node = row * SIDE + column.
SIDE = 9
_GRID = f"""v_n AS (SELECT i AS node, i // {SIDE} AS r, i % {SIDE} AS c FROM range({SIDE * SIDE}) t(i)),
v_e AS (SELECT src, dst, 1000 + (src * 7919 + dst * 104729) % 977 AS w FROM (SELECT node AS src, node + 1 AS dst FROM v_n WHERE c < {SIDE - 1} UNION ALL SELECT node, node - 1 FROM v_n WHERE c > 0 UNION ALL SELECT node, node + {SIDE} FROM v_n WHERE r < {SIDE - 1} UNION ALL SELECT node, node - {SIDE} FROM v_n WHERE r > 0) q)"""


def lattice(spark: SparkSession) -> DataFrame:
    n = spark.range(SIDE * SIDE).select(_c("id").alias("src"), F.floor(_c("id") / SIDE).alias("r"), (_c("id") % SIDE).alias("c"))
    out = F.array_compact(F.array(F.when(_c("c") < SIDE - 1, _c("src") + 1), F.when(_c("c") > 0, _c("src") - 1), F.when(_c("r") < SIDE - 1, _c("src") + SIDE), F.when(_c("r") > 0, _c("src") - SIDE)))
    return n.select("src", F.explode(out).alias("dst")).withColumn("w", 1000 + (_c("src") * 7919 + _c("dst") * 104729) % 977)


_SP = """sp(node, cost) USING KEY (node) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.dst, min(s.cost + e.w) FROM sp s JOIN {e} e ON s.node = e.src LEFT JOIN recurring.sp r ON r.node = e.dst WHERE r.cost IS NULL OR s.cost + e.w < r.cost GROUP BY e.dst)"""
_KEY = "CAST(floor(lon * 1e7 + 0.5e0) AS BIGINT) * 4294967296 + CAST(floor(lat * 1e7 + 0.5e0) AS BIGINT)"


def node_key(lon, lat):
    """Key of a place to seven decimals."""
    return F.floor(lon * 1e7 + 0.5).cast("long") * F.lit(4294967296) + F.floor(lat * 1e7 + 0.5).cast("long")


@book(f"""WITH {PIECES}, k AS (SELECT {_KEY.replace('lon', 'lon1').replace('lat', 'lat1')} AS a, {_KEY.replace('lon', 'lon2').replace('lat', 'lat2')} AS b, ascii(substr(segment_id, 5, 1)) % 3 AS dir, {r_sql(haversine_sql('lon1', 'lat1', 'lon2', 'lat2'))} AS m FROM v_piece),
e AS (SELECT a AS src, b AS dst, m FROM k WHERE dir <> 1 UNION ALL SELECT b, a, m FROM k WHERE dir <> 2) SELECT src, dst, min(m) AS metres FROM e GROUP BY 1, 2""")
def r1_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Directed edges of the lines; a third of them one way, a third against the line; of parallel ones the shortest."""
    way = F.ascii(F.substring("segment_id", 5, 1)) % 3
    p = pieces(spark, folder).select(node_key(_c("lon1"), _c("lat1")).alias("a"), node_key(_c("lon2"), _c("lat2")).alias("b"), way.alias("way"), rounded(geo.haversine("lon1", "lat1", "lon2", "lat2")).alias("m"))
    ends = F.explode(F.array_compact(F.array(F.when(_c("way") != 1, F.struct(_c("a").alias("src"), _c("b").alias("dst"))), F.when(_c("way") != 2, F.struct(_c("b").alias("src"), _c("a").alias("dst"))))))
    return p.select(ends.alias("e"), "m").groupBy("e.src", "e.dst").agg(F.min("m").alias("metres"))


@book(f"""WITH {VERTICES}, {_INC}, n AS (SELECT DISTINCT {_KEY} AS other_id, lon AS o_lon, lat AS o_lat FROM v_vertex), d AS (SELECT id, other_id, {r_sql(haversine_sql('lon', 'lat', 'o_lon', 'o_lat'))} AS metres FROM pts JOIN n ON abs(lat - o_lat) < 0.0075 AND abs(lon - o_lon) < 0.0085),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, other_id) AS k FROM d WHERE metres <= 800) SELECT id, other_id AS node, metres FROM r WHERE k = 1""")
def r2_snap(spark: SparkSession, folder: str) -> DataFrame:
    nodes = vertices(spark, folder).select(node_key(_c("lon"), _c("lat")).alias("other_id"), _c("lon").alias("o_lon"), _c("lat").alias("o_lat")).distinct()
    return nearest(incident_points(spark, folder), nodes, 800.0, geo.haversine("lon", "lat", "o_lon", "o_lat")).select("id", _c("other_id").alias("node"), "metres")


@book(f"WITH RECURSIVE {_GRID}, {_SP.format(e='v_e')} SELECT node, cost FROM sp")
def r3_r4_shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    return graph.shortest_paths(lattice(spark), spark.range(1).select(_c("id").alias("node"))).select("node", "cost")


_BAN = f"ban AS (SELECT DISTINCT src AS f, dst AS v, dst + {SIDE} AS t FROM v_e WHERE dst = src + 1 AND dst % 4 = 1 AND dst + {SIDE} < {SIDE * SIDE})"


def bans(spark: SparkSession) -> DataFrame:
    e = lattice(spark).where((_c("dst") == _c("src") + 1) & (_c("dst") % 4 == 1) & (_c("dst") + SIDE < SIDE * SIDE))
    return e.select(_c("src").alias("from"), _c("dst").alias("via"), (_c("dst") + SIDE).alias("to"))


@book(f"""WITH RECURSIVE {_GRID}, {_BAN}, te AS (SELECT a.src * 1000 + a.dst AS src, b.src * 1000 + b.dst AS dst, b.w FROM v_e a JOIN v_e b ON a.dst = b.src WHERE NOT EXISTS (SELECT 1 FROM ban WHERE f = a.src AND v = a.dst AND t = b.dst)),
sp(node, cost) USING KEY (node) AS (SELECT src * 1000 + dst, w FROM v_e WHERE src = 0 UNION SELECT e.dst, min(s.cost + e.w) FROM sp s JOIN te e ON s.node = e.src LEFT JOIN recurring.sp r ON r.node = e.dst WHERE r.cost IS NULL OR s.cost + e.w < r.cost GROUP BY e.dst) SELECT node % 1000 AS node, min(cost) AS cost FROM sp GROUP BY 1""")
def r5_r15_turn_restricted(spark: SparkSession, folder: str) -> DataFrame:
    e = lattice(spark)
    start = F.struct(F.lit(-1).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))
    first = e.where("src = 0").select(start.alias("src"), F.struct("src", "dst").alias("dst"), "w")
    found = graph.shortest_paths(graph.turn_states(e, bans(spark)).unionByName(first), spark.range(1).select(start.alias("node")))
    return found.where("node.src >= 0").groupBy(_c("node.dst").alias("node")).agg(F.min("cost").alias("cost"))


@book(f"WITH {_GRID}, {_BAN} SELECT count(*) AS bans, count(DISTINCT v) AS vias, (SELECT count(*) FROM ban WHERE EXISTS (SELECT 1 FROM v_e WHERE src = v AND dst = t)) AS on_graph FROM ban")
def r13_r14_restrictions(spark: SparkSession, folder: str) -> DataFrame:
    b, e = bans(spark).distinct(), lattice(spark)
    here = b.join(e.select(_c("src").alias("via"), _c("dst").alias("to"), F.lit(1).alias("hit")), ["via", "to"], "left")
    return here.agg(F.count("*").alias("bans"), F.countDistinct("via").alias("vias"), F.count("hit").alias("on_graph"))


@book(f"WITH {_GRID}, b AS (SELECT node FROM v_n WHERE node % 11 = 5), k AS (SELECT * FROM v_e WHERE src NOT IN (SELECT node FROM b) AND dst NOT IN (SELECT node FROM b)) SELECT (SELECT count(*) FROM b) AS blocked, (SELECT count(*) FROM v_e) - (SELECT count(*) FROM k) AS edges_removed, (SELECT count(*) FROM k) AS edges_left")
def r16_barriers(spark: SparkSession, folder: str) -> DataFrame:
    e = lattice(spark)
    b = spark.range(SIDE * SIDE).where("id % 11 = 5").select(_c("id").alias("node"))
    left = graph.without_barriers(e, b).agg(F.count("*").alias("edges_left"))
    return b.agg(F.count("*").alias("blocked")).crossJoin(F.broadcast(left)).crossJoin(F.broadcast(e.agg(F.count("*").alias("n")))).select("blocked", (_c("n") - _c("edges_left")).alias("edges_removed"), "edges_left")


_CELL = "CAST(floor(lon / 0.004e0) AS BIGINT) * 100000 + CAST(floor(lat / 0.004e0) AS BIGINT)"


def cell_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between coarse cells that lines run through: a graph whose components are of every size."""
    c = vertices(spark, folder).withColumn("cell", F.floor(_c("lon") / 0.004) * 100000 + F.floor(_c("lat") / 0.004))
    return c.withColumn("dst", F.lead("cell").over(W.partitionBy("segment_id").orderBy("seq"))).where("dst is not null").select(_c("cell").alias("src"), "dst")


@book(f"""WITH RECURSIVE {VERTICES}, l AS (SELECT {_CELL} AS src, lead({_CELL}) OVER (PARTITION BY segment_id ORDER BY seq) AS dst FROM v_vertex), e AS (SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL UNION SELECT DISTINCT dst, src FROM l WHERE dst IS NOT NULL),
reach AS (SELECT DISTINCT src AS a, src AS b FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON r.b = e.src), comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1) SELECT component, count(*) AS nodes FROM comp GROUP BY 1""")
def r17_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(cell_edges(spark, folder)).groupBy("component").agg(F.count("*").alias("nodes"))


@book(f"""WITH RECURSIVE {_GRID}, {_SP.format(e='v_e')}, back(node, hop) AS (SELECT CAST({SIDE * SIDE - 1} AS BIGINT), 0 UNION ALL SELECT (SELECT e.src FROM v_e e JOIN sp ON sp.node = e.src JOIN sp d ON d.node = e.dst WHERE e.dst = back.node AND sp.cost + e.w = d.cost ORDER BY e.src LIMIT 1), hop + 1 FROM back WHERE back.node <> 0),
onp AS (SELECT node AS dst, lead(node) OVER (ORDER BY hop) AS src FROM back) SELECT count(*) AS hops, sum(w) AS cost FROM onp JOIN v_e USING (src, dst)""")
def r24_path(spark: SparkSession, folder: str) -> DataFrame:
    """Edges and cost of the cheapest path between two corners, followed back through the nodes before."""
    found = graph.shortest_paths(lattice(spark), spark.range(1).select(_c("id").alias("node")))
    ends = spark.range(1).select(_c("id").alias("source"), F.lit(SIDE * SIDE - 1).cast("long").alias("target"))
    return graph.paths_back(found, ends).join(lattice(spark), ["src", "dst"]).agg(F.count("*").alias("hops"), F.sum("w").alias("cost"))


@book(f"""WITH {PIECES}, r AS (SELECT segment_id, ascii(substr(segment_id, 5, 1)) % 4 AS route, substr(segment_id, 5, 2) AS road, {r_sql(haversine_sql('lon1', 'lat1', 'lon2', 'lat2'))} AS m FROM v_piece), t AS (SELECT route, road, sum(CAST(m * 1000 AS BIGINT)) AS mm FROM r GROUP BY 1, 2),
x AS (SELECT * FROM t WHERE road IN (SELECT road FROM t GROUP BY 1 HAVING count(DISTINCT route) = 1)), k AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY mm DESC, road) AS n FROM x) SELECT route, road FROM k WHERE n = 1""")
def r26_distinguishing_road(spark: SparkSession, folder: str) -> DataFrame:
    m = rounded(geo.haversine("lon1", "lat1", "lon2", "lat2"))
    t = pieces(spark, folder).select((F.ascii(F.substring("segment_id", 5, 1)) % 4).alias("route"), F.substring("segment_id", 5, 2).alias("road"), F.round(m * 1000).cast("long").alias("mm")).groupBy("route", "road").agg(F.sum("mm").alias("mm"))
    alone = t.groupBy("road").agg(F.countDistinct("route").alias("n")).where("n = 1").select("road")
    return t.join(alone, "road", "left_semi").groupBy("route").agg(F.min(F.struct((-_c("mm")).alias("m"), "road")).alias("b")).select("route", "b.road")


@book(f"""WITH RECURSIVE {VERTICES}, {_INC}, l AS (SELECT {_CELL} AS src, lead({_CELL}) OVER (PARTITION BY segment_id ORDER BY seq) AS dst FROM v_vertex), e AS (SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL UNION SELECT DISTINCT dst, src FROM l WHERE dst IS NOT NULL),
reach AS (SELECT DISTINCT src AS a, src AS b FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON r.b = e.src), comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1),
c AS (SELECT DISTINCT lon AS o_lon, lat AS o_lat, {_CELL} AS node FROM v_vertex), d AS (SELECT id, component, {r_sql(haversine_sql('lon', 'lat', 'o_lon', 'o_lat'))} AS m FROM pts JOIN c ON abs(lat - o_lat) < 0.0038 AND abs(lon - o_lon) < 0.0044 JOIN comp USING (node)) SELECT id, component, min(m) AS metres FROM d WHERE m <= 400 GROUP BY 1, 2""")
def r18_r19_snap_by_component(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest vertex within 400 m in each component, from which ends in a shared component are chosen."""
    comp = graph.components(cell_edges(spark, folder))
    v = vertices(spark, folder).select("lon", "lat", (F.floor(_c("lon") / 0.004) * 100000 + F.floor(_c("lat") / 0.004)).alias("node")).distinct().join(comp, "node")
    others = v.select(_c("component").alias("other_id"), _c("lon").alias("o_lon"), _c("lat").alias("o_lat"))
    boxes = padded(others.withColumns({"lon1": _c("o_lon"), "lon2": _c("o_lon"), "lat1": _c("o_lat"), "lat2": _c("o_lat")}), 410.0).drop("lon1", "lat1", "lon2", "lat2")
    near = bucket_join(incident_points(spark, folder), boxes, 0.006).withColumn("metres", rounded(geo.haversine("lon", "lat", "o_lon", "o_lat"))).where(_c("metres") <= 400)
    return near.groupBy("id", _c("other_id").alias("component")).agg(F.min("metres").alias("metres"))
