"""Pedestrian costs, lanes, signals, announcements, shade and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cairn.functions import geo, solar, tags as T
from cairn.operators import sequential as S
from cairn.operators.spatial import bucket_join, islands, padded
from cairn.plans.base import NOW_MS, PIECES, PROBES, TAGS_SQL, VERTICES, Book, pieces, picked, picked_sql, probes, r_sql, rounded, tags, vertices
from cairn.plans.routing import _KEY, node_key
from cairn.plans.spatial import _CUM, _OFFSET, _measured, haversine_sql
from cairn.storage import table

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col
# Time factors of surfaces, of darkness, missing pavements and slopes; waits at crossings.
SURFACE_TIME = {
    "asphalt": 1.0, "concrete": 1.0, "paved": 1.0, "paving_stones": 1.0, "sett": 1.0, "tartan": 1.0, "compacted": 1.0, "wood": 1.0, "ground": 1.15, "soil": 1.15, "dirt": 1.15,
    "unpaved": 1.15, "grass": 1.15, "gravel": 1.2, "fine_gravel": 1.2, "cobblestone": 1.2, "pebblestone": 1.2, "mud": 1.3, "sand": 1.3, "snow": 1.4, "ice": 1.5,
}
DARK, NO_PAVEMENT, SLOPE_RATE, SLOPE_SHIFT = 1.05, 1.15, 3.5, 0.05
WAITS = {"traffic_signals": 15.0, "zebra": 8.0, "marked": 8.0, "uncontrolled": 4.0, "unmarked": 4.0, "no": 0.0}
SYMBOLIC = {"up": 0.05, "down": 0.05}


def gradient(incline: Column) -> Column:
    text = F.lower(F.trim(incline))
    number = F.when(text.endswith("%"), F.regexp_replace(text, "%$", "")).otherwise(text).try_cast("double")
    return F.coalesce(T.lookup(text, SYMBOLIC, None), F.greatest(number, F.lit(0.0)) / 100.0)


def slope_factor(incline: Column) -> Column:
    g = gradient(incline)
    return F.when(g > 0, F.exp(SLOPE_RATE * (F.abs(g + SLOPE_SHIFT) - SLOPE_SHIFT))).otherwise(1.0)


def walking_cost(metres: Column, highway: Column, incline: Column, surface: Column, lit: Column, sidewalk: Column, wait: Column) -> dict[str, Column]:
    """Seconds for a stretch and what each factor adds, in the order in which they multiply."""
    factors = {
        "incline": slope_factor(incline), "surface": T.lookup(T.tag(surface), SURFACE_TIME, 1.0),
        "lit": F.when(T.tag(lit).isin("no", "false", "0"), DARK).otherwise(1.0), "sidewalk": F.when(T.tag(sidewalk) == "no", NO_PAVEMENT).otherwise(1.0),
    }
    running = pace = metres / T.walk_ms(highway)
    out = {"stairs": pace - metres / T.WALK_MS}
    for name, factor in factors.items():
        out[name] = running * factor - running
        running = running * factor
    return out | {"wait": wait, "total": running + wait}


_G = f"CASE lower(trim(incline)) WHEN 'up' THEN 0.05e0 WHEN 'down' THEN 0.05e0 ELSE greatest(try_cast(regexp_replace(lower(trim(incline)), '%$', '') AS DOUBLE), 0e0) / 100e0 END"
_SURF = "coalesce(CASE lower(trim(surface)) " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in SURFACE_TIME.items()) + " END, 1e0)"
_WALK = f"""{TAGS_SQL}, wb AS (SELECT id, highway, CAST(10 + id % 90 AS DOUBLE) AS m, CASE WHEN lower(trim(highway)) = 'steps' THEN 0.5e0 ELSE 1.35e0 END AS pace, CASE WHEN {_G} > 0 THEN exp(3.5e0 * (abs({_G} + 0.05e0) - 0.05e0)) ELSE 1e0 END AS f1, {_SURF} AS f2,
 CASE WHEN lower(trim(lit)) IN ('no', 'false', '0') THEN 1.05e0 ELSE 1e0 END AS f3, CASE WHEN lower(trim(sidewalk)) = 'no' THEN 1.15e0 ELSE 1e0 END AS f4, CASE id % 7 WHEN 0 THEN 15e0 WHEN 3 THEN 8e0 ELSE 0e0 END AS wait FROM v_tags)"""


def _walked(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, Column]]:
    k = _c("id") % 7
    wait = F.when(k == 0, WAITS["traffic_signals"]).when(k == 3, WAITS["zebra"]).otherwise(0.0)
    return tags(spark, folder), walking_cost((10 + _c("id") % 90).cast("double"), *[_c(c) for c in ("highway", "incline", "surface", "lit", "sidewalk")], wait)


@book(f"WITH {_WALK} SELECT id, {r_sql('m / pace * f1 * f2 * f3 * f4 + wait', 4)} AS total, {r_sql('m / pace - m / 1.35e0', 4)} AS stairs, {r_sql('m / pace * f1 - m / pace', 4)} AS incline, {r_sql('m / pace * f1 * f2 - m / pace * f1', 4)} AS surface, wait FROM wb")
def r20_r21_pedestrian_cost(spark: SparkSession, folder: str) -> DataFrame:
    t, cost = _walked(spark, folder)
    return t.select("id", *[rounded(cost[c], 4).alias(c) for c in ("total", "stairs", "incline", "surface")], cost["wait"].alias("wait"))


@book(f"WITH {_WALK} SELECT highway, {r_sql('sum(m) FILTER (WHERE f2 > 1)', 2)} AS poor_surface_m, {r_sql('sum(m) FILTER (WHERE f3 > 1)', 2)} AS dark_m, {r_sql('sum(m) FILTER (WHERE wait > 0)', 2)} AS crossing_m, count(*) AS ways FROM wb GROUP BY 1")
def r22_exposure_summary(spark: SparkSession, folder: str) -> DataFrame:
    t, cost = _walked(spark, folder)
    m = (10 + _c("id") % 90).cast("double")
    total = lambda test: rounded(F.sum(F.when(test, m)), 2)
    return t.groupBy("highway").agg(total(T.lookup(T.tag(_c("surface")), SURFACE_TIME, 1.0) > 1).alias("poor_surface_m"), total(T.tag(_c("lit")).isin("no", "false", "0")).alias("dark_m"), total(cost["wait"] > 0).alias("crossing_m"), F.count("*").alias("ways"))


# Delay of each kind of manoeuvre.
DELAYS = {"uturn": 20.0, "turn": 8.0, "slight": 3.0, "continue": 0.0, "depart": 0.0}
_TURNS = f"""{VERTICES}, b0 AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM v_vertex WINDOW w AS (PARTITION BY segment_id ORDER BY seq)),
b1 AS (SELECT segment_id, seq, lon, lat, lon2, lat2, (degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360e0) % 360e0 AS b FROM b0 WHERE lon2 IS NOT NULL),
b2 AS (SELECT *, abs(((b - lag(b) OVER (PARTITION BY segment_id ORDER BY seq) + 540e0) % 360e0) - 180e0) AS sharp FROM b1),
b3 AS (SELECT *, CASE WHEN sharp IS NULL THEN 'depart' WHEN sharp < 20 THEN 'continue' WHEN sharp < 45 THEN 'slight' WHEN sharp < 135 THEN 'turn' ELSE 'uturn' END AS step FROM b2)"""


def steps(spark: SparkSession, folder: str) -> DataFrame:
    rows = pieces(spark, folder).withColumn("b", geo.bearing("lon1", "lat1", "lon2", "lat2"))
    sharp = F.abs(geo.angle_difference("b", F.lag("b").over(W.partitionBy("segment_id").orderBy("seq"))))
    return rows.withColumn("sharp", sharp).withColumn("step", F.when(_c("sharp").isNull(), "depart").when(_c("sharp") < 20, "continue").when(_c("sharp") < 45, "slight").when(_c("sharp") < 135, "turn").otherwise("uturn"))


@book(f"WITH {_TURNS} SELECT segment_id, {r_sql('sum(CASE step ' + ' '.join(f'WHEN {k!r} THEN {v}e0' for k, v in DELAYS.items()) + ' END)', 2)} AS delay_s, count(*) FILTER (WHERE step NOT IN ('continue', 'depart')) AS turns FROM b3 GROUP BY 1")
def r24_junction_delay(spark: SparkSession, folder: str) -> DataFrame:
    return steps(spark, folder).groupBy("segment_id").agg(rounded(F.sum(T.lookup(_c("step"), DELAYS, 0.0)), 2).alias("delay_s"), F.count(F.when(~_c("step").isin("continue", "depart"), 1)).alias("turns"))


@book(f"WITH {_TURNS}, i AS (SELECT *, sum(CASE WHEN step = 'continue' THEN 0 ELSE 1 END) OVER (PARTITION BY segment_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM b3) SELECT segment_id, CAST(run AS BIGINT) AS run, min(seq) AS first_seq, count(*) AS pieces FROM i GROUP BY 1, 2")
def m11_r27_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs = islands(steps(spark, folder), ["segment_id"], ["seq"], _c("step") != "continue")
    return runs.groupBy("segment_id", _c("island").alias("run")).agg(F.min("seq").alias("first_seq"), F.count("*").alias("pieces"))


_CAMS = "cams AS (SELECT DISTINCT key AS id, lon, lat FROM (SELECT osm_key AS key, lon, lat FROM poi_osm) q)"


_SIGNALS = _CAMS.replace("FROM poi_osm) q", "FROM poi_osm WHERE category IN ('atm', 'bank', 'fuel')) q").replace("cams AS", "sgn AS")


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Signals, as which places of three categories stand; others are none."""
    return table(spark, folder, "poi_osm").where(_c("category").isin("atm", "bank", "fuel")).select(_c("osm_key").alias("id"), "lon", "lat").distinct()


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """A catalogue of points such as cameras or signals, as which all places of one source stand."""
    return table(spark, folder, "poi_osm").select(_c("osm_key").alias("id"), "lon", "lat").distinct()


@book(f"""WITH {PIECES}, {_CUM}, {_CAMS}, np AS (SELECT p.id, p.lon, p.lat, s.segment_id, s.seq, s.lon1, s.lat1, s.lon2, s.lat2 FROM cams p JOIN v_piece s ON p.lon BETWEEN least(s.lon1, s.lon2) - 0.0013e0 AND greatest(s.lon1, s.lon2) + 0.0013e0 AND p.lat BETWEEN least(s.lat1, s.lat2) - 0.0011e0 AND greatest(s.lat1, s.lat2) + 0.0011e0), {_OFFSET.format(src='np')},
k AS (SELECT offs.segment_id, offs.id, {r_sql('cum.cum + t0 * ' + haversine_sql('lon1', 'lat1', 'lon2', 'lat2'), 1)} AS along_m, {r_sql('off', 1)} AS offset_m FROM offs JOIN cum USING (segment_id, seq) WHERE off <= 100 AND t0 BETWEEN 0 AND 1)
SELECT segment_id, id, min(along_m) AS along_m FROM k GROUP BY 1, 2""")
def m6_m9_on_path(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue points whose foot lies on a piece of a line within 100 m: each once per line, at its first place."""
    near = bucket_join(catalog(spark, folder), padded(pieces(spark, folder).drop("free_flow_kmh"), 100.0), 0.003)
    t, off = geo.planar_offset("lon", "lat", "lon1", "lat1", "lon2", "lat2", clamp=False)
    hit = near.where((off <= 100) & t.between(0, 1)).join(_measured(spark, folder).select("segment_id", "seq", "cum"), ["segment_id", "seq"])
    at = rounded(_c("cum") + t * geo.haversine("lon1", "lat1", "lon2", "lat2"), 1)
    return hit.select("segment_id", "id", at.alias("along_m")).groupBy("segment_id", "id").agg(F.min("along_m").alias("along_m"))


@book()
def m6_signals_on_path(spark: SparkSession, folder: str, within: float = 40.0, ahead_m: float = 12.0) -> DataFrame:
    """Signals by the nearest piece of each line, with the line's bearing ahead of them; those up to 10 m after the last one kept are merged into it."""
    near = bucket_join(signals(spark, folder), padded(pieces(spark, folder).drop("free_flow_kmh"), within * 1.2), 0.003)
    dx, dy = _c("lon2") - _c("lon1"), _c("lat2") - _c("lat1")
    t = F.when(dx * dx + dy * dy <= 1e-18, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((_c("lon") - _c("lon1")) * dx + (_c("lat") - _c("lat1")) * dy) / (dx * dx + dy * dy))))
    hit = near.withColumn("t", t).withColumn("off", geo.haversine("lon", "lat", _c("lon1") + _c("t") * dx, _c("lat1") + _c("t") * dy)).where(_c("off") <= within)
    best = hit.groupBy("segment_id", "id").agg(F.min(F.struct("off", "seq", (_c("t") * geo.haversine("lon1", "lat1", "lon2", "lat2")).alias("m"))).alias("b")).select("segment_id", "id", "b.seq", "b.m")
    line = _measured(spark, folder).groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat", "cum"))).alias("v")).where(F.element_at("v", -1)["cum"] > 0)  # one line, as stored in one row
    at = best.join(line, "segment_id").withColumn("along", F.get("v", _c("seq"))["cum"] + _c("m"))
    after = F.filter("v", lambda q: (q["seq"] > _c("seq")) & (q["cum"] >= _c("along") + ahead_m))
    at = at.withColumn("e", F.coalesce(F.get(after, F.lit(0))["seq"], F.size("v") - 1)).withColumns({"p": F.get("v", _c("e") - 1), "q": F.get("v", _c("e"))})
    rows = at.select("segment_id", "id", rounded(_c("along"), 1).alias("cum"), rounded(geo.bearing("p.lon", "p.lat", "q.lon", "q.lat"), 1).alias("approach_bearing"))
    # along is in tenths of a metre: what is just 10 m off is merged too
    kept = S.scan(rows, ["segment_id"], ["cum", "id"], S.spaced(10.05), "kept boolean", rows.columns).where("kept")
    return kept.select("segment_id", "id", _c("cum").alias("along_m"), "approach_bearing")


@book(f"WITH {VERTICES}, {_SIGNALS}, n AS (SELECT DISTINCT {_KEY} AS node FROM v_vertex), s AS (SELECT {_KEY} AS node, max(id) AS id FROM sgn WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1) SELECT node, id, CASE WHEN regexp_full_match(id, '(osm:)?n[0-9]+') THEN 'osm:node:' || regexp_extract(id, '([0-9]+)$', 1) ELSE 'signal:' || id END AS source FROM s JOIN n USING (node)")
def m7_signal_index(spark: SparkSession, folder: str) -> DataFrame:
    """Signals that stand on a node of the roads, by its exact key, with where they come from; of several on a node the last."""
    nodes = vertices(spark, folder).select(node_key(_c("lon"), _c("lat")).alias("node")).distinct()
    found = signals(spark, folder).where("lon is not null and lat is not null").groupBy(node_key(_c("lon"), _c("lat")).alias("node")).agg(F.max("id").alias("id"))
    source = F.when(_c("id").rlike("^(osm:)?n[0-9]+$"), F.concat(F.lit("osm:node:"), F.regexp_extract("id", "([0-9]+)$", 1))).otherwise(F.concat(F.lit("signal:"), _c("id")))
    return found.join(nodes, "node", "left_semi").select("node", "id", source.alias("source"))


_OPS = ["speed", "red_light", "average speed", None, "toll", "SPEED;red", "bus lane"]


@book(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN e IS NULL THEN 'unknown' WHEN contains(lower(e), 'average') THEN 'section' WHEN contains(lower(e), 'red') THEN 'signal' WHEN contains(lower(e), 'speed') THEN 'speed' WHEN contains(lower(e), 'toll') THEN 'toll' ELSE 'other' END AS kind FROM (SELECT {picked_sql('p_partkey', _OPS)} AS e FROM part) q) r GROUP BY 1")
def m8_camera_census(spark: SparkSession, folder: str) -> DataFrame:
    e = F.lower(picked("p_partkey", _OPS))
    kind = F.when(e.isNull(), "unknown").when(e.contains("average"), "section").when(e.contains("red"), "signal").when(e.contains("speed"), "speed").when(e.contains("toll"), "toll").otherwise("other")
    return table(spark, folder, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@book(f"""WITH {PROBES}, a AS (SELECT id, speed, CAST(id % 400 AS DOUBLE) AS d, greatest(250e0, least(1500e0, 30e0 * speed)) AS prepare FROM v_probe WHERE speed >= 0 AND speed < 80)
SELECT CASE WHEN d <= 30 THEN 'now' WHEN d <= 120 THEN 'turn' WHEN d <= prepare THEN 'prepare' ELSE 'silent' END AS stage, count(*) AS n FROM a GROUP BY 1""")
def m15_announcement_stage(spark: SparkSession, folder: str) -> DataFrame:
    d = (_c("id") % 400).cast("double")
    prepare = F.greatest(F.lit(250.0), F.least(F.lit(1500.0), 30 * _c("speed")))
    return probes(spark, folder).where("speed >= 0 and speed < 80").groupBy(F.when(d <= 30, "now").when(d <= 120, "turn").when(d <= prepare, "prepare").otherwise("silent").alias("stage")).agg(F.count("*").alias("n"))


@book(f"""WITH {VERTICES}, {_CUM}, l AS (SELECT segment_id, max(cum) AS total FROM cum GROUP BY 1) SELECT segment_id, CAST(k * 60 AS BIGINT) AS at_m FROM (SELECT segment_id, total, unnest(range(1, CAST(trunc(total / 60e0) AS BIGINT) + 1)) AS k FROM l) q""")
def m18_chevrons(spark: SparkSession, folder: str, every: float = 60.0) -> DataFrame:
    l = _measured(spark, folder).groupBy("segment_id").agg(F.max("cum").alias("total")).where(_c("total") >= every)  # noqa: E741
    return l.select("segment_id", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(_c("total") / every))).alias("k")).select("segment_id", (_c("k") * int(every)).alias("at_m"))


@book(f"""WITH {VERTICES}, {_CUM}, s AS (SELECT segment_id, seq, cum, CASE WHEN cum < 80 THEN 'passed' WHEN cum <= 160 THEN 'active' ELSE 'ahead' END AS state FROM cum) SELECT segment_id, state, count(*) AS n, min(seq) AS first_seq FROM s GROUP BY 1, 2""")
def m19_walk_progress(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(_c("cum") < 80, "passed").when(_c("cum") <= 160, "active").otherwise("ahead")
    return _measured(spark, folder).groupBy("segment_id", state.alias("state")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@book(f"""WITH {PROBES}, h AS (SELECT id, try_cast(heading AS DOUBLE) AS h, CAST(id % 360 AS DOUBLE) AS facing FROM v_probe) SELECT CASE WHEN h IS NULL THEN 'warn_unknown' WHEN abs(((h - facing + 540e0) % 360e0) - 180e0) > 120 THEN 'suppressed' ELSE 'warned' END AS verdict, count(*) AS n FROM h WHERE h IS NULL OR h BETWEEN 0 AND 360 GROUP BY 1""")
def m21_direction_gate(spark: SparkSession, folder: str) -> DataFrame:
    h = probes(spark, folder).select("id", _c("heading").try_cast("double").alias("h")).where("h is null or h between 0 and 360")
    off = F.abs(geo.angle_difference(_c("h"), (_c("id") % 360).cast("double")))
    return h.groupBy(F.when(_c("h").isNull(), "warn_unknown").when(off > 120, "suppressed").otherwise("warned").alias("verdict")).agg(F.count("*").alias("n"))


_SIG = f"""sg AS (SELECT DISTINCT id, epoch_ms(created) AS seen, 60e0 + (ascii(substr(id, 5, 1)) % 5) * 15e0 AS cycle, 25e0 AS green, 2e0 AS w FROM incidents), tm AS (SELECT *, ((({NOW_MS} - seen) / 1000e0) % cycle + cycle) % cycle AS t FROM sg),
d AS (SELECT *, least(least(t, cycle - t), abs(t - green)) AS d FROM tm)"""


@book(f"WITH {_SIG} SELECT id, CASE WHEN d <= w THEN 'boundary' WHEN t < green THEN 'green' ELSE 'red' END AS phase, {r_sql('CASE WHEN d <= w THEN d / w ELSE least(1e0, d / (2 * w)) END')} AS confidence FROM d")
def m22_signal_phase(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "incidents").select("id", F.unix_millis("created").alias("at")).distinct()
    cycle = 60.0 + (F.ascii(F.substring("id", 5, 1)) % 5) * 15.0
    s = s.withColumn("cycle", cycle).withColumn("t", F.pmod((F.lit(NOW_MS) - _c("at")) / 1000.0, _c("cycle")))
    s = s.withColumn("d", F.least(_c("t"), _c("cycle") - _c("t"), F.abs(_c("t") - 25.0)))
    return s.select("id", F.when(_c("d") <= 2.0, "boundary").when(_c("t") < 25.0, "green").otherwise("red").alias("phase"), rounded(F.when(_c("d") <= 2.0, _c("d") / 2.0).otherwise(F.least(F.lit(1.0), _c("d") / 4.0))).alias("confidence"))


_SUN = f"""su AS (SELECT DISTINCT id, lon, lat, ms, (ms / 86400000e0 + 2440587.5e0 - 2451545e0) / 36525e0 AS t FROM (SELECT osm_key AS id, lon, lat, epoch_ms(edited_at) AS ms FROM poi_osm) q),
s1 AS (SELECT *, ((280.46646e0 + t * (36000.76983e0 + t * 0.0003032e0)) % 360e0 + 360e0) % 360e0 AS ml, 357.52911e0 + t * (35999.05029e0 - 0.0001537e0 * t) AS ma, 0.016708634e0 - t * (0.000042037e0 + 0.0000001267e0 * t) AS ec, 125.04e0 - 1934.136e0 * t AS om FROM su),
s2 AS (SELECT *, ml + sin(radians(ma)) * (1.914602e0 - t * (0.004817e0 + 0.000014e0 * t)) + sin(radians(2 * ma)) * (0.019993e0 - 0.000101e0 * t) + sin(radians(3 * ma)) * 0.000289e0 - 0.00569e0 - 0.00478e0 * sin(radians(om)) AS ap,
  23e0 + (26e0 + (21.448e0 - t * (46.815e0 + t * (0.00059e0 - t * 0.001813e0))) / 60e0) / 60e0 + 0.00256e0 * cos(radians(om)) AS ob FROM s1),
s3 AS (SELECT *, asin(sin(radians(ob)) * sin(radians(ap))) AS de, pow(tan(radians(ob / 2)), 2) AS y FROM s2),
s4 AS (SELECT *, 4e0 * degrees(y * sin(radians(2 * ml)) - 2 * ec * sin(radians(ma)) + 4 * ec * y * sin(radians(ma)) * cos(radians(2 * ml)) - 0.5e0 * y * y * sin(radians(4 * ml)) - 1.25e0 * ec * ec * sin(radians(2 * ma))) AS eq FROM s3),
s5 AS (SELECT *, (((ms % 86400000) / 60000e0 + eq + 4e0 * lon) % 1440e0 + 1440e0) % 1440e0 / 4e0 - 180e0 AS ha FROM s4),
s6 AS (SELECT *, acos(greatest(-1e0, least(1e0, sin(radians(lat)) * sin(de) + cos(radians(lat)) * cos(de) * cos(radians(ha))))) AS ze FROM s5),
s7 AS (SELECT *, 90e0 - degrees(ze) AS al, degrees(acos(greatest(-1e0, least(1e0, (sin(radians(lat)) * cos(ze) - sin(de)) / (cos(radians(lat)) * sin(ze)))))) AS az FROM s6),
s8 AS (SELECT *, al + CASE WHEN al > 85 THEN 0e0 WHEN al > 5 THEN (58.1e0 / tan(radians(al)) - 0.07e0 / pow(tan(radians(al)), 3) + 0.000086e0 / pow(tan(radians(al)), 5)) / 3600e0 WHEN al > -0.575e0 THEN (1735e0 + al * (-518.2e0 + al * (103.4e0 + al * (-12.79e0 + al * 0.711e0)))) / 3600e0 ELSE -20.772e0 / tan(radians(al)) / 3600e0 END AS alt FROM s7)"""


@book(f"WITH {_SUN} SELECT id, {r_sql('alt')} AS altitude, {r_sql('CASE WHEN ha > 0 THEN (az + 180e0) % 360e0 ELSE (540e0 - az) % 360e0 END', 2)} AS azimuth FROM s8")
def k1_sun(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "poi_osm").select(_c("osm_key").alias("id"), "lon", "lat", F.unix_millis("edited_at").alias("ms")).distinct()
    rows = solar.with_sun(rows, _c("lon"), _c("lat"), _c("ms"))
    altitude, azimuth = _c("altitude"), _c("azimuth")
    return rows.select("id", rounded(altitude).alias("altitude"), rounded(azimuth, 2).alias("azimuth"))


_STREETS = ["footway", "residential", "secondary", "primary", "corridor", "plaza", "track"]
_NOON = 1_736_067_600_000


def shade_of_pieces(spark: SparkSession, folder: str, at_ms: int = _NOON) -> DataFrame:
    """Exposure to the sun of every piece of the lines at an instant."""
    p = pieces(spark, folder).withColumns({"metres": geo.haversine("lon1", "lat1", "lon2", "lat2", geo.RADIUS_ROUND), "b": geo.bearing("lon1", "lat1", "lon2", "lat2")})
    p = p.withColumn("street", F.element_at(F.array(*[F.lit(s) for s in _STREETS]), _c("seq") % len(_STREETS) + 1))
    p = solar.with_sun(p, (_c("lon1") + _c("lon2")) / 2, (_c("lat1") + _c("lat2")) / 2, F.lit(at_ms).cast("long"))
    value, basis = solar.exposure(_c("metres"), _c("street"), _c("seq") % 11 == 10, _c("seq") % 13 == 12, _c("altitude"), _c("azimuth"), _c("b"))
    return p.withColumns({"exposure": value, "basis": basis})


def k2_shade(spark: SparkSession, folder: str) -> DataFrame:
    return shade_of_pieces(spark, folder).select("segment_id", "seq", rounded(_c("exposure"), 4).alias("exposure"), "basis")


def k3_route_shade(spark: SparkSession, folder: str) -> DataFrame:
    g = shade_of_pieces(spark, folder).where(_c("metres") >= solar.LEAST_M).groupBy("segment_id").agg(rounded(F.sum(_c("exposure") * _c("metres")) / F.sum("metres"), 4).alias("exposure"), rounded(F.sum("metres"), 1).alias("metres"))
    return g.withColumn("band", F.when(_c("exposure") <= 0.3, "shaded").when(_c("exposure") >= 0.7, "exposed").otherwise("mixed"))


for _f in (k2_shade, k3_route_shade):
    QUERIES[_f.__name__] = _f


@book(f"""WITH {PROBES}, s AS (SELECT id, CAST((id * 37) % 20000 AS DOUBLE) + 0.5e0 AS m FROM v_probe) SELECT id, CASE WHEN m >= 10000 THEN CAST(trunc(m / 1000) AS BIGINT) || ' km' WHEN m >= 1000 THEN printf('%.1f', {r_sql('m / 1000e0', 1)}) || ' km' WHEN m >= 100 THEN CAST(trunc(m / 50) * 50 AS BIGINT) || ' m' ELSE CAST(trunc(m / 10) * 10 AS BIGINT) || ' m' END AS shown,
 CASE WHEN m * 3.28084e0 >= 500 AND m / 1609.344e0 < 0.25e0 THEN CAST(trunc(m * 3.28084e0 / 100) * 100 AS BIGINT) || ' ft' WHEN m / 1609.344e0 >= 10 THEN CAST(trunc(m / 1609.344e0) AS BIGINT) || ' mi' WHEN m / 1609.344e0 >= 0.25e0 THEN printf('%.1f', {r_sql('m / 1609.344e0', 1)}) || ' mi' ELSE CAST(trunc(m * 3.28084e0 / 50) * 50 AS BIGINT) || ' ft' END AS imperial FROM s""")
def k15_units(spark: SparkSession, folder: str) -> DataFrame:
    s = probes(spark, folder).select("id", ((_c("id") * 37) % 20000 + F.lit(0.5)).alias("m"))
    feet, miles = _c("m") * 3.28084, _c("m") / 1609.344
    whole = lambda v, step, unit: F.concat(((v / step).cast("long") * step).cast("string"), F.lit(" " + unit))
    tenth = lambda v, unit: F.concat(F.format_string("%.1f", rounded(v, 1)), F.lit(" " + unit))
    metric = F.when(_c("m") >= 10_000, whole(_c("m") / 1000, 1, "km")).when(_c("m") >= 1000, tenth(_c("m") / 1000, "km")).when(_c("m") >= 100, whole(_c("m"), 50, "m")).otherwise(whole(_c("m"), 10, "m"))
    imperial = F.when(miles >= 10, whole(miles, 1, "mi")).when(miles >= 0.25, tenth(miles, "mi")).when(feet >= 500, whole(feet, 100, "ft")).otherwise(whole(feet, 50, "ft"))
    return s.select("id", metric.alias("shown"), imperial.alias("imperial"))


@book("SELECT o_orderpriority AS class, count(*) AS n, " + r_sql("quantile_cont(o_totalprice / 10000e0, 0.5)") + " AS p50, " + r_sql("quantile_cont(o_totalprice / 10000e0, 0.95)") + " AS p95 FROM orders GROUP BY 1")
def k12_frame_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    ms = _c("o_totalprice") / 10000.0
    return table(spark, folder, "orders").groupBy(_c("o_orderpriority").alias("class")).agg(F.count("*").alias("n"), rounded(F.percentile(ms, 0.5)).alias("p50"), rounded(F.percentile(ms, 0.95)).alias("p95"))


@book(f"WITH {PROBES}, d AS (SELECT trip, min(t) AS began, max(t) AS ended, count(*) AS fixes FROM v_probe GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY ended DESC, trip) AS rank FROM d) SELECT trip, (ended - began) // 1000 AS seconds, fixes, CAST(rank AS INTEGER) AS rank, CASE WHEN ended - began < 600000 THEN 'short' WHEN ended - began < 3600000 THEN 'as_planned' ELSE 'long' END AS verdict FROM r WHERE rank <= 20")
def k16_drive_history(spark: SparkSession, folder: str) -> DataFrame:
    d = probes(spark, folder).groupBy("trip").agg(F.min("t").alias("began"), F.max("t").alias("ended"), F.count("*").alias("fixes")).orderBy(_c("ended").desc(), "trip").limit(20)
    span = _c("ended") - _c("began")
    d = d.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(_c("ended").desc(), "trip")))  # of 20 rows
    return d.select("trip", F.floor(span / 1000).alias("seconds"), "fixes", "rank", F.when(span < 600_000, "short").when(span < 3_600_000, "as_planned").otherwise("long").alias("verdict"))


_CONF = """WITH {tags}, c AS (SELECT id, lanes, CASE WHEN regexp_full_match(lanes, '[-+]?[0-9]+') THEN try_cast(lanes AS INTEGER) END AS n, highway, oneway IN ('yes', '-1') AS one, turn_lanes FROM v_tags)
SELECT id, CASE WHEN lanes IS NULL THEN 'no_lanes' WHEN n IS NULL OR n < 1 THEN 'malformed_lanes' WHEN n = 1 THEN 'one_lane' WHEN n > 8 THEN 'lanes_over_max' WHEN lower(highway) = 'service' THEN 'service'
 WHEN coalesce(one, FALSE) AND turn_lanes IS NOT NULL THEN CASE WHEN len(string_split(turn_lanes, '|')) <> n THEN 'turn_lanes_conflict' ELSE 'oneway_assigned' END WHEN coalesce(one, FALSE) THEN 'oneway' WHEN turn_lanes IS NOT NULL THEN 'turn_lanes_two_way' WHEN n = 2 THEN 'two_way_2' ELSE 'two_way_split_unknown' END AS reason FROM c"""


@book(_CONF.replace("{tags}", TAGS_SQL))
def l23_lane_confidence(spark: SparkSession, folder: str) -> DataFrame:
    n = F.when(_c("lanes").rlike(r"^[-+]?[0-9]+$"), _c("lanes").try_cast("int"))
    one, turn = F.coalesce(_c("oneway").isin("yes", "-1"), F.lit(False)), _c("turn_lanes").isNotNull()
    reason = (
        F.when(_c("lanes").isNull(), "no_lanes").when(n.isNull() | (n < 1), "malformed_lanes").when(n == 1, "one_lane").when(n > 8, "lanes_over_max").when(F.lower("highway") == "service", "service")
        .when(one & turn, F.when(F.size(F.split("turn_lanes", r"\|")) != n, "turn_lanes_conflict").otherwise("oneway_assigned")).when(one, "oneway").when(turn, "turn_lanes_two_way").when(n == 2, "two_way_2").otherwise("two_way_split_unknown")
    )
    return tags(spark, folder).select("id", reason.alias("reason"))
