"""Traffic: probes to segments to congestion, states, overlays, learned speeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cairn.operators.spatial import match_points
from cairn.plans.base import PIECES, PROBES, VERTICES, Book, latest, lines, pieces, probes, r_sql, rounded, vertices
from cairn.plans.spatial import _NEAR, _OFFSET
from cairn.storage import table

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col
# Shares of free flow from which congestion has a level, probes below which none is shown.
LEVELS = [("free", 0.85), ("light", 0.65), ("moderate", 0.45), ("heavy", 0.25)]
LEAST_PROBES = 3
MATCH_M = 100.0
#: Hours of local time and weekend of the time bands.
UTC_OFFSET_H, WEEKEND = 3, (4, 5)


def congestion(speed: Column, free_flow: Column) -> Column:
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), speed / free_flow))
    out = F.when(speed.isNull(), "unknown")
    for name, least in LEVELS:
        out = out.when(ratio >= least, name)
    return out.otherwise("jammed")


def _congestion_sql(speed: str, free: str) -> str:
    ratio = f"greatest(0e0, least(1e0, {speed} / {free}))"
    return f"CASE WHEN {speed} IS NULL THEN 'unknown' " + " ".join(f"WHEN {ratio} >= {x}e0 THEN '{n}'" for n, x in LEVELS) + " ELSE 'jammed' END"


def time_band(ms: Column) -> Column:
    """Band 0 to 7 of the local week: five of working days, three of the weekend; 0 for times that are none."""
    seconds = F.floor(ms / 1000) + UTC_OFFSET_H * 3600
    day, hour = F.pmod(F.floor(seconds / 86400) + 3, F.lit(7)), F.floor(F.pmod(seconds, F.lit(86400)) / 3600)
    working = F.when(hour < 6, 0).when(hour < 10, 1).when(hour < 14, 2).when(hour < 19, 3).otherwise(4)
    free = F.when(hour < 6, 7).when(hour < 18, 5).otherwise(6)
    return F.when(ms <= 0, 0).when(day.isin(*WEEKEND), free).otherwise(working)


_BAND = """CASE WHEN t <= 0 THEN 0 WHEN ((t // 1000 + 10800) // 86400 + 3) % 7 IN (4, 5) THEN CASE WHEN ((t // 1000 + 10800) % 86400) // 3600 < 6 THEN 7 WHEN ((t // 1000 + 10800) % 86400) // 3600 < 18 THEN 5 ELSE 6 END
 ELSE CASE WHEN ((t // 1000 + 10800) % 86400) // 3600 < 6 THEN 0 WHEN ((t // 1000 + 10800) % 86400) // 3600 < 10 THEN 1 WHEN ((t // 1000 + 10800) % 86400) // 3600 < 14 THEN 2 WHEN ((t // 1000 + 10800) % 86400) // 3600 < 19 THEN 3 ELSE 4 END END"""

_MATCH = f"""{PIECES}, {PROBES}, pts AS (SELECT * FROM v_probe WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90), {_NEAR}, {_OFFSET.format(src='np')},
mt AS (SELECT id, segment_id, seq, metres FROM (SELECT id, segment_id, seq, {r_sql('off')} AS metres, row_number() OVER (PARTITION BY id ORDER BY {r_sql('off')}, segment_id, seq) AS k FROM offs WHERE {r_sql('off')} <= 100) q WHERE k = 1)"""


def valid_probes(spark: SparkSession, folder: str) -> DataFrame:
    return probes(spark, folder).where("lon between -180 and 180 and lat between -90 and 90")


def matched(spark: SparkSession, folder: str, *carry: str) -> DataFrame:
    return match_points(valid_probes(spark, folder), pieces(spark, folder), MATCH_M, carry=carry)


@book(f"WITH {PROBES} SELECT source, kind, count(*) AS n, count(*) FILTER (WHERE speed_kmh IS NULL) AS without_speed, count(*) FILTER (WHERE NOT (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90)) AS out_of_bounds FROM v_probe GROUP BY ALL")
def t1_probe_validity(spark: SparkSession, folder: str) -> DataFrame:
    inside = _c("lon").between(-180, 180) & _c("lat").between(-90, 90)
    return probes(spark, folder).groupBy("source", "kind").agg(F.count("*").alias("n"), F.count(F.when(_c("speed_kmh").isNull(), 1)).alias("without_speed"), F.count(F.when(~inside, 1)).alias("out_of_bounds"))


@book(f"WITH {VERTICES} SELECT segment_id, CASE WHEN max(free_flow_kmh) > 0 THEN max(free_flow_kmh) ELSE 50e0 END AS free_flow_kmh, count(*) AS vertices FROM v_vertex GROUP BY segment_id")
def t2_segments(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).select("segment_id", F.when(_c("free_flow_kmh") > 0, _c("free_flow_kmh")).otherwise(50.0).alias("free_flow_kmh"), F.size("line").cast("long").alias("vertices"))


@book(f"WITH {_MATCH} SELECT id, segment_id, seq, metres FROM mt")
def t3_map_match(spark: SparkSession, folder: str) -> DataFrame:
    return matched(spark, folder)


# a mean of speeds in whole thousandths, rounded half up in whole numbers, comes out alike whatever the order of the sum
_MILLI = "CAST(floor(speed_kmh * 1000e0 + 0.5e0) AS BIGINT)"
_AGG = f"""ag AS (SELECT segment_id, count(*) AS probe_count, CASE WHEN count(speed_kmh) > 0 THEN CAST((2 * sum({_MILLI}) + 10 * count(speed_kmh)) // (20 * count(speed_kmh)) AS DOUBLE) / 100e0 END AS mean_speed_kmh
 FROM mt JOIN v_probe USING (id) GROUP BY segment_id), sg AS (SELECT segment_id, max(free_flow_kmh) AS free_flow_kmh FROM v_seg GROUP BY 1)"""


def aggregated(matches: DataFrame, keys: list[str]) -> DataFrame:
    milli = F.floor(_c("speed_kmh") * 1000 + 0.5).cast("long")
    n = F.count("speed_kmh")
    mean = F.when(n > 0, F.floor((F.sum(milli) * 2 + n * 10) / (n * 20)) / F.lit(100.0))
    return matches.groupBy(*keys).agg(F.count("*").alias("probe_count"), mean.alias("mean_speed_kmh"))


@book(f"WITH {_MATCH}, {_AGG} SELECT segment_id, probe_count, mean_speed_kmh, free_flow_kmh, {_congestion_sql('mean_speed_kmh', 'free_flow_kmh')} AS congestion FROM ag JOIN sg USING (segment_id)")
def t4_t5_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    a = aggregated(matched(spark, folder, "speed_kmh"), ["segment_id"])
    rows = a.join(lines(spark, folder).select("segment_id", "free_flow_kmh"), "segment_id")
    return rows.withColumn("congestion", congestion(_c("mean_speed_kmh"), _c("free_flow_kmh")))


def estimate(spark: SparkSession, folder: str) -> DataFrame:
    a = aggregated(matched(spark, folder, "speed_kmh"), ["segment_id"])
    rows = lines(spark, folder).select("segment_id", "free_flow_kmh").join(a, "segment_id", "left")
    return rows.select("segment_id", "free_flow_kmh", "mean_speed_kmh", F.coalesce("probe_count", F.lit(0)).alias("probe_count"), congestion(_c("mean_speed_kmh"), _c("free_flow_kmh")).alias("congestion"))


_EST = f"{_MATCH}, {_AGG}, es AS (SELECT segment_id, free_flow_kmh, mean_speed_kmh, coalesce(probe_count, 0) AS probe_count, {_congestion_sql('mean_speed_kmh', 'free_flow_kmh')} AS congestion FROM sg LEFT JOIN ag USING (segment_id))"


@book(f"WITH {_EST} SELECT * FROM es")
def t6_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return estimate(spark, folder)


@book(f"WITH {_MATCH} SELECT count(*) AS probes, count(*) - (SELECT count(*) FROM mt) AS dropped FROM v_probe")
def t7_dropped(spark: SparkSession, folder: str) -> DataFrame:
    found = matched(spark, folder).select("id", F.lit(1).alias("hit"))
    rows = probes(spark, folder).select("id").join(found, "id", "left")
    return rows.agg(F.count("*").alias("probes"), F.count(F.when(_c("hit").isNull(), 1)).alias("dropped"))


@book(f"WITH {_EST} SELECT congestion, count(*) FILTER (WHERE probe_count >= 3) AS shown, count(*) FILTER (WHERE probe_count < 3) AS withheld FROM es GROUP BY ALL")
def t8_evidence_floor(spark: SparkSession, folder: str) -> DataFrame:
    enough = _c("probe_count") >= LEAST_PROBES
    return estimate(spark, folder).groupBy("congestion").agg(F.count(F.when(enough, 1)).alias("shown"), F.count(F.when(~enough, 1)).alias("withheld"))


_STATE = """st AS (SELECT segment_id, arg_max(struct_pack(f := free_flow_kmh, m := mean_speed_kmh, n := probe_count, c := lower(trim(congestion)), u := updated_at), struct_pack(u := updated_at, n := probe_count, m := coalesce(mean_speed_kmh, -1e0), c := congestion)) AS s, max(updated_at) AS u FROM traffic_state GROUP BY segment_id)"""


def states(spark: SparkSession, folder: str) -> DataFrame:
    """The latest state of each segment."""
    t = table(spark, folder, "traffic_state").withColumn("label", F.lower(F.trim("congestion")))
    order = [_c("updated_at"), _c("probe_count"), F.coalesce("mean_speed_kmh", F.lit(-1.0)), _c("congestion")]
    return latest(t.select("segment_id", "free_flow_kmh", "mean_speed_kmh", "probe_count", "label", "updated_at", "congestion"), ["segment_id"], order)


@book(f"WITH {_STATE} SELECT segment_id, s.f AS free_flow_kmh, s.m AS mean_speed_kmh, s.n AS probe_count, s.c AS label, epoch_us(u) AS updated_us FROM st")
def t9_latest_state(spark: SparkSession, folder: str) -> DataFrame:
    return states(spark, folder).select("segment_id", "free_flow_kmh", "mean_speed_kmh", "probe_count", "label", F.unix_micros("updated_at").alias("updated_us"))


@book(f"""WITH {VERTICES}, b AS (SELECT segment_id, lon BETWEEN 51.1e0 AND 51.2e0 AND lat BETWEEN 25.2e0 AND 25.3e0 AS inside FROM v_vertex) SELECT segment_id, bool_or(inside) AS any_vertex, bool_and(inside) AS within FROM b GROUP BY 1""")
def t9_bbox_semantics(spark: SparkSession, folder: str) -> DataFrame:
    inside = lambda v: v["lon"].between(51.1, 51.2) & v["lat"].between(25.2, 25.3)
    return lines(spark, folder).select("segment_id", F.exists("line", inside).alias("any_vertex"), F.forall("line", inside).alias("within"))


@book(f"WITH {_MATCH} SELECT mt.id, segment_id, CASE WHEN speed_kmh >= 0.6e0 * free_flow_kmh THEN 'free' ELSE 'heavy' END AS congestion, CAST(1 AS BIGINT) AS probe_count FROM mt JOIN v_probe USING (id) JOIN v_seg USING (segment_id) WHERE speed_kmh IS NOT NULL")
def t10_single_probe(spark: SparkSession, folder: str) -> DataFrame:
    rows = matched(spark, folder).join(valid_probes(spark, folder).select("id", "speed_kmh").where("speed_kmh is not null"), "id").join(lines(spark, folder).select("segment_id", "free_flow_kmh"), "segment_id")
    return rows.select("id", "segment_id", F.when(_c("speed_kmh") >= 0.6 * _c("free_flow_kmh"), "free").otherwise("heavy").alias("congestion"), F.lit(1).cast("long").alias("probe_count"))


@book(f"WITH {VERTICES}, b AS (SELECT segment_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM v_vertex GROUP BY 1) SELECT segment_id FROM b WHERE w <= 51.2e0 AND e >= 51.1e0 AND s <= 25.3e0 AND n >= 25.2e0")
def t11_bbox_filter(spark: SparkSession, folder: str) -> DataFrame:
    b = vertices(spark, folder).groupBy("segment_id").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    return b.where("w <= 51.2 and e >= 51.1 and s <= 25.3 and n >= 25.2").select("segment_id")


@book("SELECT id, kind, note, created_us, rank FROM (SELECT id, lower(trim(kind)) AS kind, note, epoch_us(created) AS created_us, row_number() OVER (ORDER BY created DESC, id) AS rank FROM (SELECT DISTINCT id, kind, note, created FROM incidents) d) q WHERE rank <= 50")
def t12_newest_incidents(spark: SparkSession, folder: str) -> DataFrame:
    top = table(spark, folder, "incidents").select("id", "kind", "note", "created").distinct().orderBy(_c("created").desc(), "id").limit(50)
    ranked = top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(_c("created").desc(), "id")))  # of 50 rows
    return ranked.select("id", F.lower(F.trim("kind")).alias("kind"), "note", F.unix_micros("created").alias("created_us"), "rank")


@book(f"""WITH {_MATCH}, b AS (SELECT segment_id, {_BAND} AS band, trip, speed_kmh FROM mt JOIN v_probe USING (id) WHERE speed_kmh IS NOT NULL AND t >= (SELECT max(t) FROM v_probe) - 2592000000)
SELECT segment_id, CAST(band AS INTEGER) AS band, {r_sql('quantile_cont(speed_kmh, 0.5)', 2)} AS median_kmh, count(DISTINCT trip) AS trips FROM b GROUP BY 1, 2 HAVING count(DISTINCT trip) >= 2""")
def t14_sparse_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles with thresholds at which the sparse test tables give rows: 30 days and two trips."""
    return t14_speed_profiles(spark, folder, 2_592_000_000, 2)


@book(f"""WITH {_MATCH}, b AS (SELECT segment_id, {_BAND} AS band, trip, speed_kmh FROM mt JOIN v_probe USING (id) WHERE speed_kmh IS NOT NULL AND t >= (SELECT max(t) FROM v_probe) - 259200000)
SELECT segment_id, CAST(band AS INTEGER) AS band, {r_sql('quantile_cont(speed_kmh, 0.5)', 2)} AS median_kmh, count(DISTINCT trip) AS trips FROM b GROUP BY 1, 2 HAVING count(DISTINCT trip) >= 5""")
def t14_speed_profiles(spark: SparkSession, folder: str, keep_ms: int = 259_200_000, least_trips: int = 5) -> DataFrame:
    """Median speed per segment and band of the last 72 hours, where at least 5 distinct trips stand behind it."""
    newest = probes(spark, folder).agg(F.max("t").alias("newest"))
    p = matched(spark, folder, "trip", "t", "speed_kmh").where("speed_kmh is not null").join(F.broadcast(newest), F.lit(True)).where(_c("t") >= _c("newest") - keep_ms)  # newest is one row
    g = p.groupBy("segment_id", time_band(_c("t")).alias("band")).agg(rounded(F.percentile("speed_kmh", 0.5), 2).alias("median_kmh"), F.countDistinct("trip").alias("trips"))
    return g.where(_c("trips") >= least_trips)


@book("""WITH g AS (SELECT u * 50 AS users, t AS trips, s / 10e0 AS share FROM range(1, 5) a(u), range(1, 4) b(t), range(1, 6) c(s)), o AS (SELECT * FROM (VALUES (0, 25.7e0), (5, 8.6e0), (7, 4.3e0)) v(band, occurrences))
SELECT users, trips, share, band, """ + r_sql("users * trips * share * occurrences / 30e0", 4) + " AS expected FROM g, o")
def t15_band_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    g = spark.range(1, 5).select((_c("id") * 50).alias("users")).withColumn("trips", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)]))).withColumn("share", F.explode(F.array(*[F.lit(k / 10.0) for k in range(1, 6)])))
    g = g.withColumn("o", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(x).alias("occurrences")) for b, x in ((0, 25.7), (5, 8.6), (7, 4.3))])))
    return g.select("users", "trips", "share", "o.band", rounded(_c("users") * _c("trips") * _c("share") * _c("o.occurrences") / 30.0, 4).alias("expected"))


# Least confidence of each type of fact to be promoted.
PROMOTION = {"speed_profile": 0.60, "poi": 0.75, "road": 0.85, "turn_restriction": 0.85, "closure": 0.90}
_FACTS = """v_fact AS (SELECT s_suppkey AS fact_key, list_extract(['speed_profile', 'poi', 'road', 'turn_restriction', 'closure'], CAST(s_suppkey % 5 + 1 AS INTEGER)) AS fact_type, CAST((s_suppkey * 37) % 101 AS DOUBLE) / 100e0 AS confidence,
 CAST(s_suppkey % 9 - 1 AS INTEGER) AS band, CAST((s_suppkey * 7) % 130 - 10 AS DOUBLE) AS median_speed_kmh, 51.2e0 + (s_suppkey % 10) * 0.001e0 AS lon, 25.2e0 + (s_suppkey // 10 % 10) * 0.001e0 AS lat FROM supplier)"""


def facts(spark: SparkSession, folder: str) -> DataFrame:
    k = _c("s_suppkey")
    types = F.array(*[F.lit(t) for t in PROMOTION])
    return table(spark, folder, "supplier").select(
        k.alias("fact_key"), F.element_at(types, (k % 5 + 1).cast("int")).alias("fact_type"), ((k * 37) % 101 / F.lit(100.0)).alias("confidence"), (k % 9 - 1).cast("int").alias("band"),
        ((k * 7) % 130 - 10).cast("double").alias("median_speed_kmh"), (F.lit(51.2) + (k % 10) * F.lit(0.001)).alias("lon"), (F.lit(25.2) + (F.floor(k / 10) % 10) * F.lit(0.001)).alias("lat"),
    )


@book(f"WITH {_FACTS}, th AS (SELECT * FROM (VALUES {', '.join(f'({k!r}, {v}e0)' for k, v in PROMOTION.items())}) x(fact_type, least)) SELECT fact_type, count(*) FILTER (WHERE confidence >= least) AS promoted, count(*) FILTER (WHERE confidence < least) AS kept_back FROM v_fact JOIN th USING (fact_type) GROUP BY 1")
def t16_promotion(spark: SparkSession, folder: str) -> DataFrame:
    least = F.element_at(F.create_map(*[F.lit(x) for kv in PROMOTION.items() for x in kv]), _c("fact_type"))
    return facts(spark, folder).groupBy("fact_type").agg(F.count(F.when(_c("confidence") >= least, 1)).alias("promoted"), F.count(F.when(_c("confidence") < least, 1)).alias("kept_back"))


def speed_factor(mean: Column, free: Column) -> Column:
    return F.when(mean.isNull() | free.isNull(), 1.0).when(mean <= 0, 10.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(10.0), free / mean)))


@book(f"""WITH {PIECES}, {_STATE}, f AS (SELECT segment_id, CASE WHEN s.m IS NULL OR s.f IS NULL THEN 1e0 WHEN s.m <= 0 THEN 10e0 ELSE greatest(1e0, least(10e0, s.f / s.m)) END AS factor FROM st),
p AS (SELECT CASE WHEN (lon1, lat1) <= (lon2, lat2) THEN lon1 ELSE lon2 END AS a_lon, CASE WHEN (lon1, lat1) <= (lon2, lat2) THEN lat1 ELSE lat2 END AS a_lat, CASE WHEN (lon1, lat1) <= (lon2, lat2) THEN lon2 ELSE lon1 END AS b_lon, CASE WHEN (lon1, lat1) <= (lon2, lat2) THEN lat2 ELSE lat1 END AS b_lat, factor FROM v_piece JOIN f USING (segment_id))
SELECT a_lon, a_lat, b_lon, b_lat, {r_sql('max(factor)', 4)} AS factor FROM p GROUP BY ALL""")
def r7_r8_traffic_overlay(spark: SparkSession, folder: str) -> DataFrame:
    f = states(spark, folder).select("segment_id", speed_factor(_c("mean_speed_kmh"), _c("free_flow_kmh")).alias("factor"))
    a, b = F.struct(_c("lon1").alias("lon"), _c("lat1").alias("lat")), F.struct(_c("lon2").alias("lon"), _c("lat2").alias("lat"))
    rows = pieces(spark, folder).join(f, "segment_id").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "factor")
    return rows.groupBy(_c("a.lon").alias("a_lon"), _c("a.lat").alias("a_lat"), _c("b.lon").alias("b_lon"), _c("b.lat").alias("b_lat")).agg(rounded(F.max("factor"), 4).alias("factor"))


@book(f"WITH {PROBES} SELECT CAST({_BAND} AS INTEGER) AS band, count(*) AS n, count(DISTINCT trip) AS trips FROM v_probe GROUP BY 1")
def r9_time_bands(spark: SparkSession, folder: str) -> DataFrame:
    return probes(spark, folder).groupBy(time_band(_c("t")).alias("band")).agg(F.count("*").alias("n"), F.countDistinct("trip").alias("trips"))


_LEARNT = f"""{_FACTS}, ok AS (SELECT * FROM v_fact WHERE fact_type = 'speed_profile' AND median_speed_kmh > 0 AND band BETWEEN 0 AND 7), pr AS (SELECT round(lon, 7) AS lon, round(lat, 7) AS lat, band, arg_max(median_speed_kmh, fact_key) AS kmh FROM ok GROUP BY 1, 2, 3)"""


def learnt(spark: SparkSession, folder: str) -> DataFrame:
    ok = facts(spark, folder).where("fact_type = 'speed_profile' and median_speed_kmh > 0 and band between 0 and 7")
    return ok.groupBy(F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "band").agg(F.max_by("median_speed_kmh", "fact_key").alias("kmh"))


@book(f"WITH {_LEARNT} SELECT lon, lat, band, kmh, {r_sql('greatest(0.25e0, least(10e0, 30e0 / kmh))', 4)} AS factor FROM pr")
def r10_learned_overlay(spark: SparkSession, folder: str) -> DataFrame:
    return learnt(spark, folder).select("lon", "lat", "band", "kmh", rounded(F.greatest(F.lit(0.25), F.least(F.lit(10.0), F.lit(30.0) / _c("kmh"))), 4).alias("factor"))


@book(f"WITH {_LEARNT} SELECT count(DISTINCT (lon, lat)) AS edges, count(*) AS edge_bands FROM pr")
def r12_overlay_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return learnt(spark, folder).agg(F.countDistinct("lon", "lat").alias("edges"), F.count("*").alias("edge_bands"))


_ETA = """v_eta AS (SELECT o_orderkey AS id, CAST(60 + (o_orderkey * 13) % 900 AS DOUBLE) AS observed_s, CAST(60 + (o_orderkey * 13) % 900 + (o_orderkey * 7) % 301 - 150 AS DOUBLE) AS predicted_s, CAST(o_orderkey % 11 AS DOUBLE) / 10e0 AS coverage FROM orders),
e AS (SELECT CASE WHEN coverage >= 0.5e0 THEN 'learned' ELSE 'unlearned' END AS split, CASE WHEN observed_s <= 0 THEN 0e0 ELSE abs(predicted_s - observed_s) / observed_s * 100e0 END AS err FROM v_eta)"""
_DIST = f"count(*) AS n, {r_sql('quantile_cont(err, 0.5)')} AS p50, {r_sql('quantile_cont(err, 0.9)')} AS p90, {r_sql('quantile_cont(err, 0.99)')} AS p99, {r_sql('avg(err)', 2)} AS mean"


@book(f"WITH {_ETA} SELECT split, {_DIST} FROM e GROUP BY split UNION ALL SELECT 'overall', {_DIST} FROM e")
def r28_eta_error(spark: SparkSession, folder: str) -> DataFrame:
    k = _c("o_orderkey")
    e = table(spark, folder, "orders").select((60 + (k * 13) % 900).cast("double").alias("observed_s"), (60 + (k * 13) % 900 + (k * 7) % 301 - 150).cast("double").alias("predicted_s"), (k % 11 / F.lit(10.0)).alias("coverage"))
    e = e.select(F.when(_c("coverage") >= 0.5, "learned").otherwise("unlearned").alias("split"), F.when(_c("observed_s") <= 0, 0.0).otherwise(F.abs(_c("predicted_s") - _c("observed_s")) / _c("observed_s") * 100).alias("err"))
    p = lambda q: rounded(F.percentile("err", q))
    g = e.rollup("split").agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), rounded(F.avg("err"), 2).alias("mean"))
    return g.select(F.coalesce("split", F.lit("overall")).alias("split"), "n", "p50", "p90", "p99", "mean")


@book(f"WITH {PIECES} SELECT segment_id, seq, row_number() OVER (ORDER BY segment_id, seq) % 13 = 0 AS jammed FROM v_piece")
def o19_synthetic_probes(spark: SparkSession, folder: str) -> DataFrame:
    # numbered by the pieces before a segment and the place within it, so that no task holds all rows
    p = pieces(spark, folder)
    sizes = p.groupBy("segment_id").agg(F.count("*").alias("n"))
    offsets = sizes.select("segment_id", (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("segment_id")) - _c("n")).alias("before"))
    return p.join(offsets, "segment_id").select("segment_id", "seq", ((_c("before") + _c("seq") + 1) % 13 == 0).alias("jammed"))
