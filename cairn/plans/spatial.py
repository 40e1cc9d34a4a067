"""Geometry of points, lines, tiles and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cairn.functions import geo, wkt
from cairn.operators.spatial import bucket_join, match_points, nearest, padded
from cairn.plans.base import PIECES, POIS, PROBES, VERTICES, Book, along, lines, pieces, pois, probes, r_sql, rounded, vertices
from cairn.storage import table

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = geo.RADIUS) -> str:
    return f"(2e0 * {radius}e0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


_PIECE = ("lon1", "lat1", "lon2", "lat2")


@book(f"WITH {PIECES} SELECT segment_id, seq, {r_sql(haversine_sql(*_PIECE))} AS metres FROM v_piece")
def s1_haversine(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(spark, folder).select("segment_id", "seq", rounded(geo.haversine(*_PIECE)).alias("metres"))


@book(f"WITH {PIECES} SELECT segment_id, seq, {r_sql(haversine_sql(*_PIECE, geo.RADIUS_ROUND))} AS metres FROM v_piece")
def s2_haversine_round(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(spark, folder).select("segment_id", "seq", rounded(geo.haversine(*_PIECE, geo.RADIUS_ROUND)).alias("metres"))


_BEARING = "((degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360e0) % 360e0)"


@book(f"""WITH {PIECES}, b AS (SELECT segment_id, seq, {_BEARING} AS b FROM v_piece), d AS (SELECT *, lag(b) OVER (PARTITION BY segment_id ORDER BY seq) AS p FROM b)
SELECT segment_id, seq, {r_sql('b')} AS bearing, {r_sql('CASE WHEN b > 180 THEN b - 360 ELSE b END')} AS signed, {r_sql('((b - p + 540e0) % 360e0) - 180e0')} AS turn,
  list_extract(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], CAST(round_even(b / 45e0, 0) AS INTEGER) % 8 + 1) AS cardinal,
  CASE WHEN p IS NULL THEN 'depart' WHEN abs(((b - p + 540e0) % 360e0) - 180e0) < 20 THEN 'continue' WHEN abs(((b - p + 540e0) % 360e0) - 180e0) < 45 THEN 'slight' WHEN abs(((b - p + 540e0) % 360e0) - 180e0) < 135 THEN 'turn' ELSE 'uturn' END AS manoeuvre FROM d""")
def s4_s5_s6_m2_bearings(spark: SparkSession, folder: str) -> DataFrame:
    rows = pieces(spark, folder).select("segment_id", "seq", geo.bearing(*_PIECE).alias("b"))
    rows = rows.withColumn("p", F.lag("b").over(W.partitionBy("segment_id").orderBy("seq")))
    turn = geo.angle_difference("b", "p")
    sharp = F.abs(turn)
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return rows.select(
        "segment_id", "seq", rounded(_c("b")).alias("bearing"), rounded(F.when(_c("b") > 180, _c("b") - 360).otherwise(_c("b"))).alias("signed"), rounded(turn).alias("turn"),
        F.element_at(names, F.bround(_c("b") / 45).cast("int") % 8 + 1).alias("cardinal"),
        F.when(_c("p").isNull(), "depart").when(sharp < 20, "continue").when(sharp < 45, "slight").when(sharp < 135, "turn").otherwise("uturn").alias("manoeuvre"),
    )


_OFFSET = """o AS (SELECT *, 111320e0 * cos(radians((lat1 + lat2) / 2)) AS kx FROM {src}), o1 AS (SELECT *, (lon2 - lon1) * kx AS ax, (lat2 - lat1) * 111320e0 AS ay, (lon - lon1) * kx AS px, (lat - lat1) * 111320e0 AS py FROM o),
o2 AS (SELECT *, ax * ax + ay * ay AS sq, CASE WHEN ax * ax + ay * ay = 0 THEN 0e0 ELSE (px * ax + py * ay) / (ax * ax + ay * ay) END AS t0 FROM o1), o3 AS (SELECT *, greatest(0e0, least(1e0, t0)) AS t FROM o2),
offs AS (SELECT *, sqrt(pow(px - t * ax, 2) + pow(py - t * ay, 2)) AS off FROM o3)"""
_NEAR = """np AS (SELECT p.id, p.lon, p.lat, s.segment_id, s.seq, s.lon1, s.lat1, s.lon2, s.lat2 FROM pts p JOIN v_piece s ON p.lon BETWEEN least(s.lon1, s.lon2) - 0.0013e0 AND greatest(s.lon1, s.lon2) + 0.0013e0
  AND p.lat BETWEEN least(s.lat1, s.lat2) - 0.0011e0 AND greatest(s.lat1, s.lat2) + 0.0011e0)"""
_INC = r"""pts AS (SELECT id, lon, lat FROM (SELECT DISTINCT id, try_cast(regexp_extract(geom, '(?i)^\s*(?:SRID\s*=\s*4326\s*;)?\s*POINT\s*Z?\s*\(\s*(\S+)\s+(\S+?)(?:\s+\S+)?\s*\)\s*$', 1) AS DOUBLE) AS lon,
  try_cast(regexp_extract(geom, '(?i)^\s*(?:SRID\s*=\s*4326\s*;)?\s*POINT\s*Z?\s*\(\s*(\S+)\s+(\S+?)(?:\s+\S+)?\s*\)\s*$', 2) AS DOUBLE) AS lat FROM incidents) q WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon))"""


def incident_points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "incidents").select("id", wkt.point(_c("geom")).alias("p")).where("p is not null").select("id", "p.lon", "p.lat").distinct()


@book(f"WITH {PIECES}, {_INC}, {_NEAR}, {_OFFSET.format(src='np')} SELECT id, segment_id, seq, {r_sql('off')} AS metres, {r_sql('t')} AS share, t0 BETWEEN 0 AND 1 AS foot_on_piece FROM offs WHERE off <= 100")
def s7_s9_s10_point_to_piece(spark: SparkSession, folder: str) -> DataFrame:
    near = bucket_join(incident_points(spark, folder), padded(pieces(spark, folder).drop("free_flow_kmh"), 100.0), 0.003)
    t, off = geo.planar_offset("lon", "lat", *_PIECE)
    free, _ = geo.planar_offset("lon", "lat", *_PIECE, clamp=False)
    return near.where(off <= 100).select("id", "segment_id", "seq", rounded(off).alias("metres"), rounded(t).alias("share"), free.between(0, 1).alias("foot_on_piece"))


@book(f"""WITH {PIECES}, {_INC}, {_NEAR}, t AS (SELECT *, CASE WHEN lon1 = lon2 AND lat1 = lat2 THEN 0e0 ELSE greatest(0e0, least(1e0, ((lon - lon1) * (lon2 - lon1) + (lat - lat1) * (lat2 - lat1)) / (pow(lon2 - lon1, 2) + pow(lat2 - lat1, 2)))) END AS t FROM np),
d AS (SELECT id, segment_id, seq, {r_sql(haversine_sql('lon', 'lat', '(lon1 + t * (lon2 - lon1))', '(lat1 + t * (lat2 - lat1))', geo.RADIUS_ROUND), 1)} AS metres FROM t) SELECT id, segment_id, min(metres) AS metres FROM d WHERE metres <= 60 GROUP BY ALL""")
def s8_s11_point_to_line(spark: SparkSession, folder: str) -> DataFrame:
    near = bucket_join(incident_points(spark, folder), padded(pieces(spark, folder).drop("free_flow_kmh"), 100.0), 0.003)
    dx, dy = _c("lon2") - _c("lon1"), _c("lat2") - _c("lat1")
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((_c("lon") - _c("lon1")) * dx + (_c("lat") - _c("lat1")) * dy) / square)))
    metres = rounded(geo.haversine("lon", "lat", _c("lon1") + t * dx, _c("lat1") + t * dy, geo.RADIUS_ROUND), 1)
    return near.select("id", "segment_id", metres.alias("metres")).where("metres <= 60").groupBy("id", "segment_id").agg(F.min("metres").alias("metres"))


@book(f"""WITH {VERTICES}, b AS (SELECT segment_id, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM v_vertex GROUP BY 1)
SELECT segment_id, w, s, e, n, w <= 51.3e0 AND e >= 51.1e0 AND s <= 25.4e0 AND n >= 25.2e0 AS overlaps, w >= 51.1e0 AND e <= 51.3e0 AND s >= 25.2e0 AND n <= 25.4e0 AS contained,
  {r_sql('(e - w) * 111320e0 * cos(radians((s + n) / 2)) * (n - s) * 111320e0', 1)} AS area_m2 FROM b""")
def s12_s18_s26_boxes(spark: SparkSession, folder: str) -> DataFrame:
    b = vertices(spark, folder).groupBy("segment_id").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    over = (_c("w") <= 51.3) & (_c("e") >= 51.1) & (_c("s") <= 25.4) & (_c("n") >= 25.2)
    held = (_c("w") >= 51.1) & (_c("e") <= 51.3) & (_c("s") >= 25.2) & (_c("n") <= 25.4)
    area = (_c("e") - _c("w")) * geo.METRES_PER_DEGREE * F.cos(F.radians((_c("s") + _c("n")) / 2)) * (_c("n") - _c("s")) * geo.METRES_PER_DEGREE
    return b.select("segment_id", "w", "s", "e", "n", over.alias("overlaps"), held.alias("contained"), rounded(area, 1).alias("area_m2"))


_STEP = haversine_sql("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat")
_CUM = f"""d AS (SELECT *, coalesce({_STEP}, 0e0) AS m FROM v_vertex WINDOW w AS (PARTITION BY segment_id ORDER BY seq)), cum AS (SELECT *, sum(m) OVER (PARTITION BY segment_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM d)"""


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    w = W.partitionBy("segment_id").orderBy("seq")
    return along(vertices(spark, folder), "segment_id", "seq", geo.haversine(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat"))


@book(f"WITH {VERTICES}, {_CUM} SELECT segment_id, seq, {r_sql('cum', 2)} AS cum FROM cum")
def s13_along(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder).select("segment_id", "seq", rounded(_c("cum"), 2).alias("cum"))


@book(f"""WITH {PIECES}, n AS (SELECT *, CAST(trunc({haversine_sql(*_PIECE, geo.RADIUS_ROUND)} / 50e0) AS INTEGER) AS steps FROM v_piece),
inner_ AS (SELECT segment_id, seq, k, lon1 + (lon2 - lon1) * (k / (steps + 1e0)) AS lon, lat1 + (lat2 - lat1) * (k / (steps + 1e0)) AS lat FROM (SELECT *, unnest(range(0, steps + 1)) AS k FROM n) q)
SELECT segment_id, seq, k, {r_sql('lon', 6)} AS lon, {r_sql('lat', 6)} AS lat FROM inner_""")
def s14_densify(spark: SparkSession, folder: str) -> DataFrame:
    rows = pieces(spark, folder).withColumn("steps", (geo.haversine(*_PIECE, geo.RADIUS_ROUND) / 50.0).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), _c("steps").cast("long"))))
    share = _c("k") / (_c("steps") + F.lit(1.0))
    at = lambda a, b: rounded(_c(a) + (_c(b) - _c(a)) * share, 6)
    return rows.select("segment_id", "seq", "k", at("lon1", "lon2").alias("lon"), at("lat1", "lat2").alias("lat"))


@book(f"""WITH {VERTICES}, {_CUM}, n AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(cum) OVER w AS cum2 FROM cum WINDOW w AS (PARTITION BY segment_id ORDER BY seq))
SELECT segment_id, seq, {r_sql('lon + (lon2 - lon) * ((100e0 - cum) / (cum2 - cum))', 6)} AS lon, {r_sql('lat + (lat2 - lat) * ((100e0 - cum) / (cum2 - cum))', 6)} AS lat FROM n WHERE cum <= 100 AND cum2 > 100""")
def s15_locate(spark: SparkSession, folder: str) -> DataFrame:
    w = W.partitionBy("segment_id").orderBy("seq")
    rows = _measured(spark, folder).withColumns({"lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w), "cum2": F.lead("cum").over(w)}).where("cum <= 100 and cum2 > 100")
    share = (F.lit(100.0) - _c("cum")) / (_c("cum2") - _c("cum"))
    return rows.select("segment_id", "seq", rounded(_c("lon") + (_c("lon2") - _c("lon")) * share, 6).alias("lon"), rounded(_c("lat") + (_c("lat2") - _c("lat")) * share, 6).alias("lat"))


def sub_line(rows: DataFrame, key: str, lo, hi) -> DataFrame:
    """Vertices (key, at, lon, lat) of the part of each line between lo and hi metres: where it begins, what lies between, where it ends.

    rows are vertices (key, seq, lon, lat, cum) with lo and hi given as columns of them. A line that lo or hi lies beyond ends where it ends.
    """
    w = W.partitionBy(key).orderBy("seq")
    v = rows.withColumns({"_lo": lo, "_hi": hi, "_lon": F.lead("lon").over(w), "_lat": F.lead("lat").over(w), "_next": F.lead("cum").over(w)})

    def cut(d: str) -> DataFrame:
        share = (_c(d) - _c("cum")) / (_c("_next") - _c("cum"))
        within = v.where((_c("cum") <= _c(d)) & (_c("_next") > _c(d)))
        return within.select(key, _c(d).alias("at"), (_c("lon") + (_c("_lon") - _c("lon")) * share).alias("lon"), (_c("lat") + (_c("_lat") - _c("lat")) * share).alias("lat"))

    inner = v.where((_c("cum") > _c("_lo")) & (_c("cum") < _c("_hi"))).select(key, _c("cum").alias("at"), "lon", "lat")
    return cut("_lo").unionByName(inner).unionByName(cut("_hi"))


@book(f"""WITH {VERTICES}, {_CUM}, n AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(cum) OVER w AS cum2, max(cum) OVER (PARTITION BY segment_id) AS total FROM cum WINDOW w AS (PARTITION BY segment_id ORDER BY seq)),
p AS (SELECT segment_id, q * total AS at_m, lon + (lon2 - lon) * ((q * total - cum) / (cum2 - cum)) AS lon, lat + (lat2 - lat) * ((q * total - cum) / (cum2 - cum)) AS lat FROM n, (VALUES (0.25e0), (0.75e0)) v(q) WHERE cum <= q * total AND cum2 > q * total UNION ALL SELECT segment_id, cum, lon, lat FROM n WHERE cum > 0.25e0 * total AND cum < 0.75e0 * total)
SELECT segment_id, {r_sql('at_m', 2)} AS at_m, {r_sql('lon', 6)} AS lon, {r_sql('lat', 6)} AS lat FROM p""")
def s15_sub_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The middle half of every line."""
    rows = _measured(spark, folder).withColumn("total", F.max("cum").over(W.partitionBy("segment_id")))
    part = sub_line(rows, "segment_id", F.lit(0.25) * _c("total"), F.lit(0.75) * _c("total"))
    return part.select("segment_id", rounded(_c("at"), 2).alias("at_m"), rounded(_c("lon"), 6).alias("lon"), rounded(_c("lat"), 6).alias("lat"))


@book(f"""WITH {PIECES}, {_CUM}, {_INC}, {_NEAR}, {_OFFSET.format(src='np')}, j AS (SELECT offs.id, offs.segment_id, offs.seq, {r_sql('off')} AS off, cum.cum + t * {haversine_sql(*_PIECE)} AS pos FROM offs JOIN cum USING (segment_id, seq) WHERE off <= 60),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY off, segment_id, seq) AS k FROM j) SELECT id, segment_id, seq, off AS metres, {r_sql('pos', 1)} AS along_m FROM r WHERE k = 1""")
def s16_project_on_line(spark: SparkSession, folder: str) -> DataFrame:
    best = match_points(incident_points(spark, folder), pieces(spark, folder), 60.0)
    rows = best.join(pieces(spark, folder), ["segment_id", "seq"]).join(incident_points(spark, folder), "id").join(_measured(spark, folder).select("segment_id", "seq", "cum"), ["segment_id", "seq"])
    t, _ = geo.planar_offset("lon", "lat", *_PIECE)
    return rows.select("id", "segment_id", "seq", "metres", rounded(_c("cum") + t * geo.haversine(*_PIECE), 1).alias("along_m"))


@book(f"WITH {PIECES} SELECT segment_id, seq, {r_sql('lon1 + 10e0 * sin(radians(90e0)) / (111320e0 * cos(radians(lat1)))', 7)} AS east_lon, {r_sql('lat1 + 10e0 / 111320e0', 7)} AS north_lat FROM v_piece")
def s17_offset_point(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(spark, folder).select("segment_id", "seq", rounded(_c("lon1") + F.lit(10.0) * F.sin(F.radians(F.lit(90.0))) / (F.cos(F.radians("lat1")) * 111320.0), 7).alias("east_lon"), rounded(_c("lat1") + 10.0 / 111320.0, 7).alias("north_lat"))


_XY = "greatest(0, least({n} - 1, CAST(trunc((lon + 180e0) / 360e0 * {n}) AS INTEGER))) AS x, greatest(0, least({n} - 1, CAST(trunc((1e0 - ln(tan(radians(lat)) + sqrt(pow(tan(radians(lat)), 2) + 1e0)) / pi()) / 2e0 * {n}) AS INTEGER))) AS y"


@book(f"WITH {POIS}, t AS (SELECT {_XY.format(n=2 ** 14)} FROM v_poi) SELECT x, y, count(*) AS n FROM t GROUP BY ALL")
def s19_tiles(spark: SparkSession, folder: str) -> DataFrame:
    x, y = geo.tile("lon", "lat", 14)
    return pois(spark, folder).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))


@book(f"""WITH {POIS}, t AS (SELECT DISTINCT {_XY.format(n=2 ** 12)} FROM v_poi) SELECT x, y, {r_sql('x / 4096e0 * 360e0 - 180e0', 6)} AS w, {r_sql('(x + 1) / 4096e0 * 360e0 - 180e0', 6)} AS e,
  {r_sql('degrees(atan(sinh((0.5e0 - y / 4096e0) * 2 * pi())))', 6)} AS n, {r_sql('degrees(atan(sinh((0.5e0 - (y + 1) / 4096e0) * 2 * pi())))', 6)} AS s FROM t""")
def s20_tile_boxes(spark: SparkSession, folder: str) -> DataFrame:
    x, y = geo.tile("lon", "lat", 12)
    w, s, e, n = geo.tile_box("x", "y", 12)
    return pois(spark, folder).select(x.alias("x"), y.alias("y")).distinct().select("x", "y", *[rounded(v, 6).alias(k) for k, v in (("w", w), ("e", e), ("n", n), ("s", s))])


_SIN = "sin(radians(lat))"


@book(f"""WITH {POIS}, m AS (SELECT key, source, lat, (lon + 180e0) / 360e0 AS mx, 0.5e0 - ln((1 + {_SIN}) / (1 - {_SIN})) / (4 * pi()) AS my FROM v_poi)
SELECT key, source, {r_sql('mx', 8)} AS mx, {r_sql('my', 8)} AS my, {r_sql('1e0 / cos(radians(lat))', 6)} AS scale FROM m""")
def s21_mercator(spark: SparkSession, folder: str) -> DataFrame:
    mx, my = geo.mercator("lon", "lat")
    return pois(spark, folder).select("key", "source", rounded(mx, 8).alias("mx"), rounded(my, 8).alias("my"), rounded(1.0 / F.cos(F.radians("lat")), 6).alias("scale"))


_RINGS = r"""ring AS (SELECT id, unnest(range(len(rs))) AS ring, unnest(rs) AS body FROM (SELECT DISTINCT id, regexp_extract_all(geom, '\(([^()]+)\)', 1) AS rs FROM (SELECT id, min(geom) AS geom FROM vector_features WHERE regexp_matches(upper(geom), 'POLYGON') GROUP BY id) f) q),
rv AS (SELECT id, ring, unnest(range(len(ps))) AS seq, unnest(ps) AS p FROM (SELECT id, ring, string_split(body, ',') AS ps FROM ring) q),
rxy AS (SELECT id, ring, seq, CAST(regexp_extract(trim(p), '^(\S+)\s+(\S+)', 1) AS DOUBLE) AS x, CAST(regexp_extract(trim(p), '^(\S+)\s+(\S+)', 2) AS DOUBLE) AS y FROM rv)"""


def ring_vertices(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "vector_features").where(F.upper("geom").contains("POLYGON")).groupBy("id").agg(F.min("geom").alias("geom"))
    rows = f.select("id", F.posexplode(wkt.rings(_c("geom"))).alias("ring", "r"))
    return rows.select("id", "ring", F.posexplode("r").alias("seq", "v")).select("id", "ring", "seq", _c("v.lon").alias("x"), _c("v.lat").alias("y"))


@book(f"""WITH {_RINGS}, o AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM rxy WHERE ring = 0 WINDOW w AS (PARTITION BY id ORDER BY seq)),
c AS (SELECT id, x0, y0, (x - x0) AS ax, (y - y0) AS ay, (x2 - x0) AS bx, (y2 - y0) AS b_y FROM o WHERE x2 IS NOT NULL), s AS (SELECT id, min(x0) AS x0, min(y0) AS y0, sum(ax * b_y - bx * ay) AS area2, sum((ax + bx) * (ax * b_y - bx * ay)) AS sx, sum((ay + b_y) * (ax * b_y - bx * ay)) AS sy FROM c GROUP BY id)
SELECT id, {r_sql('x0 + sx / (3 * area2)', 5)} AS lon, {r_sql('y0 + sy / (3 * area2)', 5)} AS lat FROM s WHERE abs(area2) > 1e-12""")
def s22_centroid(spark: SparkSession, folder: str) -> DataFrame:
    w = W.partitionBy("id").orderBy("seq")
    o = ring_vertices(spark, folder).where("ring = 0").withColumns({"x0": F.first("x").over(w), "y0": F.first("y").over(w), "x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).where("x2 is not null")
    ax, ay, bx, by = _c("x") - _c("x0"), _c("y") - _c("y0"), _c("x2") - _c("x0"), _c("y2") - _c("y0")
    cross = ax * by - bx * ay
    s = o.groupBy("id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.sum(cross).alias("area2"), F.sum((ax + bx) * cross).alias("sx"), F.sum((ay + by) * cross).alias("sy")).where("abs(area2) > 1e-12")
    return s.select("id", rounded(_c("x0") + _c("sx") / (3 * _c("area2")), 5).alias("lon"), rounded(_c("y0") + _c("sy") / (3 * _c("area2")), 5).alias("lat"))


@book(f"""WITH {_RINGS}, c AS (SELECT *, floor(x / 0.001e0) AS cx, floor(y / 0.001e0) AS cy FROM rxy), k AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM c WINDOW w AS (PARTITION BY id, ring ORDER BY seq))
SELECT id, CAST(ring AS INTEGER) AS ring, count(*) FILTER (WHERE px IS NULL OR px <> cx OR py <> cy) AS kept, count(*) AS vertices FROM k GROUP BY id, ring""")
def s23_thin_rings(spark: SparkSession, folder: str) -> DataFrame:
    w = W.partitionBy("id", "ring").orderBy("seq")
    c = ring_vertices(spark, folder).withColumns({"cx": F.floor(_c("x") / 0.001), "cy": F.floor(_c("y") / 0.001)}).withColumns({"px": F.lag("cx").over(w), "py": F.lag("cy").over(w)})
    kept = _c("px").isNull() | (_c("px") != _c("cx")) | (_c("py") != _c("cy"))
    return c.groupBy("id", "ring").agg(F.count(F.when(kept, 1)).alias("kept"), F.count("*").alias("vertices"))


_CLIP = """(SELECT *, CASE WHEN lon2 = lon1 THEN CASE WHEN lon1 BETWEEN 51.1e0 AND 51.2e0 THEN -1e18 ELSE 1e18 END ELSE least((51.1e0 - lon1) / (lon2 - lon1), (51.2e0 - lon1) / (lon2 - lon1)) END AS xa,
  CASE WHEN lon2 = lon1 THEN CASE WHEN lon1 BETWEEN 51.1e0 AND 51.2e0 THEN 1e18 ELSE -1e18 END ELSE greatest((51.1e0 - lon1) / (lon2 - lon1), (51.2e0 - lon1) / (lon2 - lon1)) END AS xb,
  CASE WHEN lat2 = lat1 THEN CASE WHEN lat1 BETWEEN 25.2e0 AND 25.3e0 THEN -1e18 ELSE 1e18 END ELSE least((25.2e0 - lat1) / (lat2 - lat1), (25.3e0 - lat1) / (lat2 - lat1)) END AS ya,
  CASE WHEN lat2 = lat1 THEN CASE WHEN lat1 BETWEEN 25.2e0 AND 25.3e0 THEN 1e18 ELSE -1e18 END ELSE greatest((25.2e0 - lat1) / (lat2 - lat1), (25.3e0 - lat1) / (lat2 - lat1)) END AS yb FROM v_piece)"""


@book(f"WITH {PIECES} SELECT segment_id, seq, {r_sql('greatest(0e0, least(1e0, xb, yb) - greatest(0e0, xa, ya))', 6)} AS share FROM {_CLIP} c")
def s25_clip_share(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(spark, folder).select("segment_id", "seq", rounded(geo.clipped_share(*_PIECE, 51.1, 25.2, 51.2, 25.3), 6).alias("share"))


@book("SELECT id, CAST(trunc((lng - 51.2e0) / 0.005e0) AS BIGINT) AS cut_x, CAST(floor((lng - 51.2e0) / 0.005e0) AS BIGINT) AS floor_x FROM observation WHERE lng BETWEEN 50 AND 53")
def s27_cells(spark: SparkSession, folder: str) -> DataFrame:
    x = (_c("lng") - 51.2) / 0.005
    return table(spark, folder, "observation").where("lng between 50 and 53").select("id", x.cast("long").alias("cut_x"), F.floor(x).alias("floor_x"))


@book(f"""WITH {POIS}, {_INC}, d AS (SELECT p.id, o.key AS other_id, {r_sql(haversine_sql('p.lon', 'p.lat', 'o.lon', 'o.lat', geo.RADIUS_ROUND))} AS metres FROM pts p JOIN v_poi o ON abs(p.lat - o.lat) < 0.006 AND abs(p.lon - o.lon) < 0.007),
r AS (SELECT DISTINCT id, other_id, metres FROM d WHERE metres <= 500), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, other_id) AS rank FROM r) SELECT id, other_id, metres, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def c8_reverse(spark: SparkSession, folder: str) -> DataFrame:
    others = pois(spark, folder).select(_c("key").alias("other_id"), _c("lon").alias("o_lon"), _c("lat").alias("o_lat")).distinct()
    return nearest(incident_points(spark, folder), others, 500.0, geo.haversine("lon", "lat", "o_lon", "o_lat", geo.RADIUS_ROUND), 3).select("id", "other_id", "metres", "rank")


@book(f"""WITH {PROBES} SELECT id, {r_sql('((lon * 7e0 + 180e0) % 360e0 + 360e0) % 360e0 - 180e0', 6)} AS lon FROM v_probe""")
def s18_wrap(spark: SparkSession, folder: str) -> DataFrame:
    return probes(spark, folder).select("id", rounded(geo.wrap_longitude(_c("lon") * 7), 6).alias("lon"))
