"""Location privacy: the gate, endpoint truncation, trips, import plans, retention and counters."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cairn.functions.geo import RADIUS_ROUND, haversine
from cairn.operators import sequential as S
from cairn.plans.base import NOW_MS, PROBES, Book, probes, r_sql, rounded
from cairn.plans.spatial import haversine_sql
from cairn.storage import table

book = Book()
QUERIES, SQL = book.queries, book.sql
_c = F.col
# Accuracy floor, truncated ends, rounding of times, greatest age, hours kept.
ACCURACY_M, TRUNCATE_M, ROUND_S, MAX_AGE_DAYS, TTL_H = 25.0, 200.0, 5, 365, 72
AGE_BUCKETS = {"7d": 7, "30d": 30, "90d": 90, "365d": 365}


#: Key of pseudonyms and digests: the session's setting, or this one, which is no secret and only for tests.
KEY_SETTING, TEST_KEY = "cairn.trip.key", "key for tests only"


def _pads(key: str) -> tuple[str, str]:
    """Inner and outer padded key of HMAC-SHA256, in hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def hmac_sha256(text: Column, key: str) -> Column:
    """Keyed digest in hexadecimal digits, of built-in expressions only."""
    inner, outer = (F.unhex(F.lit(pad)) for pad in _pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def hmac_sql(text: str, key: str = TEST_KEY) -> str:
    inner, outer = _pads(key)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


def trip_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def normal_ms(t: Column) -> Column:
    """Milliseconds, where a value can only be seconds rescaled."""
    return F.when((F.abs(t) > 100_000_000) & (F.abs(t) < 100_000_000_000), t * 1000).otherwise(t)


def coarse_ms(t: Column, step_s: int = ROUND_S) -> Column:
    s = F.floor(normal_ms(t) / 1000)
    return (s - F.pmod(s, F.lit(step_s))) * 1000


def gate(points: DataFrame, now_ms: int = NOW_MS) -> DataFrame:
    """points (lon, lat, t, speed, accuracy) with outcome and the gated values; the first rule that fails names the outcome."""
    bad = _c("lon").isNull() | _c("lat").isNull() | F.isnan("lon") | F.isnan("lat")
    outside = ~_c("lon").between(-180, 180) | ~_c("lat").between(-90, 90)
    outcome = F.when(bad, "malformed").when(outside, "out_of_bounds").when(_c("accuracy") > ACCURACY_M, "accuracy").when(_c("t").isNull(), "no_time").otherwise("kept")
    return points.withColumns({
        "outcome": outcome, "g_lon": rounded(_c("lon"), 5), "g_lat": rounded(_c("lat"), 5), "g_t": coarse_ms(F.coalesce("t", F.lit(now_ms))), "g_s": rounded(_c("speed"), 2), "g_a": rounded(_c("accuracy"), 1),
    })


_RAW = f"""{PROBES}, raw AS (SELECT id, trip, source, CASE WHEN id % 53 = 0 THEN NULL ELSE lon END AS lon, CASE WHEN id % 59 = 0 THEN lat + 90 ELSE lat END AS lat, CASE WHEN id % 61 = 0 THEN NULL WHEN id % 7 = 0 THEN t // 1000 ELSE t END AS t, speed, accuracy FROM v_probe)"""
_NORM = "CASE WHEN abs(t) > 100000000 AND abs(t) < 100000000000 THEN t * 1000 ELSE t END"
_GATE = f"""{_RAW}, g AS (SELECT id, trip, source, CASE WHEN lon IS NULL OR lat IS NULL THEN 'malformed' WHEN NOT (lon BETWEEN -180 AND 180) OR NOT (lat BETWEEN -90 AND 90) THEN 'out_of_bounds' WHEN accuracy > 25 THEN 'accuracy' WHEN t IS NULL THEN 'no_time' ELSE 'kept' END AS outcome,
 {r_sql('lon', 5)} AS g_lon, {r_sql('lat', 5)} AS g_lat, (coalesce({_NORM}, {NOW_MS}) // 1000 - (coalesce({_NORM}, {NOW_MS}) // 1000) % 5) * 1000 AS g_t, {r_sql('speed', 2)} AS g_s, {r_sql('accuracy', 1)} AS g_a FROM raw)"""


def raw_points(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes as an untrusted client would send them: some without place or time, some out of bounds, some in seconds."""
    p = probes(spark, folder)
    return p.select("id", "trip", "source", F.when(_c("id") % 53 != 0, _c("lon")).alias("lon"), F.when(_c("id") % 59 == 0, _c("lat") + 90).otherwise(_c("lat")).alias("lat"),
                    F.when(_c("id") % 61 == 0, None).when(_c("id") % 7 == 0, F.floor(_c("t") / 1000)).otherwise(_c("t")).alias("t"), "speed", "accuracy")


@book(f"WITH {_GATE} SELECT id, outcome, g_lon, g_lat, g_t, g_s, g_a FROM g")
def v1_v2_v3_gate(spark: SparkSession, folder: str) -> DataFrame:
    return gate(raw_points(spark, folder)).select("id", "outcome", "g_lon", "g_lat", "g_t", "g_s", "g_a")


@book(f"WITH {_GATE} SELECT outcome, count(*) AS n FROM g GROUP BY 1")
def v1_gate_counts(spark: SparkSession, folder: str) -> DataFrame:
    return gate(raw_points(spark, folder)).groupBy("outcome").agg(F.count("*").alias("n"))


_STEP = haversine_sql("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat", RADIUS_ROUND)
_CUM = f"""good AS (SELECT * FROM v_probe WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90), st AS (SELECT *, floor(coalesce({_STEP}, 0e0) * 1000e0 + 0.5e0) AS mm FROM good WINDOW w AS (PARTITION BY trip ORDER BY t, id)),
cu AS (SELECT *, sum(mm) OVER (PARTITION BY trip ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS cum, sum(mm) OVER (PARTITION BY trip) AS total FROM st)"""


def travelled(spark: SparkSession, folder: str) -> DataFrame:
    """Placed fixes with cum and total, whole millimetres along their trip.

    The running sum is made in two levels, within hours and over the hours of a trip, so that no task holds a whole trip.
    """
    p = probes(spark, folder).where("lon between -180 and 180 and lat between -90 and 90").withColumn("hour", F.floor(_c("t") / 3_600_000))
    edges = p.groupBy("trip", "hour").agg(F.max_by(F.struct("lon", "lat"), F.struct("t", "id")).alias("end"))
    trip = W.partitionBy("trip").orderBy("hour")
    before = edges.select("trip", "hour", F.lag("end").over(trip).alias("from_end"))
    w = W.partitionBy("trip", "hour").orderBy("t", "id")
    p = p.join(before, ["trip", "hour"])
    lon, lat = F.coalesce(F.lag("lon").over(w), _c("from_end.lon")), F.coalesce(F.lag("lat").over(w), _c("from_end.lat"))
    p = p.withColumn("mm", F.floor(F.coalesce(haversine(lon, lat, "lon", "lat", RADIUS_ROUND), F.lit(0.0)) * 1000 + 0.5)).withColumn("local", F.sum("mm").over(w.rowsBetween(W.unboundedPreceding, 0)))
    hours = p.groupBy("trip", "hour").agg(F.sum("mm").alias("mm_hour"))
    hours = hours.select("trip", "hour", (F.sum("mm_hour").over(trip.rowsBetween(W.unboundedPreceding, 0)) - _c("mm_hour")).alias("offset"), F.sum("mm_hour").over(W.partitionBy("trip")).alias("total"))
    return p.join(hours, ["trip", "hour"]).withColumn("cum", _c("offset") + _c("local"))


@book(f"WITH {PROBES}, {_CUM} SELECT id, trip FROM cu WHERE cum >= 200000 AND total - cum >= 200000")
def v4_truncate_ends(spark: SparkSession, folder: str) -> DataFrame:
    return travelled(spark, folder).where((_c("cum") >= TRUNCATE_M * 1000) & (_c("total") - _c("cum") >= TRUNCATE_M * 1000)).select("id", "trip")


#: Milliseconds of a pause beyond which a recording is another trip.
GAP_MS = 300_000


@book(f"""WITH {PROBES}, s AS (SELECT *, coalesce(t - lag(t) OVER w > {GAP_MS}, FALSE) AS new FROM v_probe WINDOW w AS (PARTITION BY trip ORDER BY t, id)), i AS (SELECT *, sum(new::INT) OVER (PARTITION BY trip ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS part FROM s)
SELECT trip, CAST(part AS BIGINT) AS part, count(*) AS fixes, min(t) AS began, max(t) AS ended FROM i GROUP BY 1, 2""")
def v6_gap_split(spark: SparkSession, folder: str, gap_ms: int = GAP_MS) -> DataFrame:
    """Trips cut where a recorder paused for longer than gap_ms."""
    return S.stretches(probes(spark, folder).select("trip", "t", "id"), gap_ms).groupBy("trip", "part").agg(F.count("*").alias("fixes"), F.min("t").alias("began"), F.max("t").alias("ended"))


@book(f"""WITH {PROBES}, a AS (SELECT CASE WHEN t < {NOW_MS} - 31536000000 THEN 'too_old' WHEN ({NOW_MS} - t) / 86400000e0 <= 7 THEN '7d' WHEN ({NOW_MS} - t) / 86400000e0 <= 30 THEN '30d' WHEN ({NOW_MS} - t) / 86400000e0 <= 90 THEN '90d' ELSE '365d' END AS bucket FROM v_probe) SELECT bucket, count(*) AS n FROM a GROUP BY 1""")
def v8_age_buckets(spark: SparkSession, folder: str) -> DataFrame:
    age = (F.lit(NOW_MS) - _c("t")) / 86_400_000
    out = F.when(_c("t") < NOW_MS - MAX_AGE_DAYS * 86_400_000, "too_old")
    for name, days in list(AGE_BUCKETS.items())[:-1]:
        out = out.when(age <= days, name)
    return probes(spark, folder).groupBy(out.otherwise("365d").alias("bucket")).agg(F.count("*").alias("n"))


@book(f"WITH {PROBES} SELECT id, trip, t FROM v_probe ORDER BY id DESC LIMIT 100")
def v13_recent(spark: SparkSession, folder: str) -> DataFrame:
    return probes(spark, folder).select("id", "trip", "t").orderBy(_c("id").desc()).limit(100)


@book(f"WITH {PROBES} SELECT coalesce(source, 'live') AS source, count(*) AS n, count(DISTINCT trip) AS trips FROM v_probe GROUP BY 1")
def v14_v15_counts_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return probes(spark, folder).groupBy(F.coalesce("source", F.lit("live")).alias("source")).agg(F.count("*").alias("n"), F.countDistinct("trip").alias("trips"))


_PAD = "(2000e0 / (111320e0 * cos(radians(25.3e0))))"
_HAV = haversine_sql("51.2e0", "25.3e0", "lon", "lat", RADIUS_ROUND)


@book(f"""WITH {PROBES}, b AS (SELECT * FROM v_probe WHERE lon BETWEEN 51.2e0 - {_PAD} AND 51.2e0 + {_PAD} AND lat BETWEEN 25.3e0 - {_PAD} AND 25.3e0 + {_PAD}), l AS (SELECT * FROM b ORDER BY id DESC LIMIT 500)
SELECT id, {r_sql(_HAV, 1)} AS metres, id IN (SELECT id FROM l) AS within_limit FROM b WHERE {_HAV} <= 2000""")
def v16_nearby(spark: SparkSession, folder: str) -> DataFrame:
    """All fixes within 2 km of a place, and which of them a limit of 500 candidates of the box, newest first, would have left."""
    pad = F.lit(2000.0) / (F.cos(F.radians(F.lit(25.3))) * 111320.0)
    b = probes(spark, folder).where(_c("lon").between(F.lit(51.2) - pad, F.lit(51.2) + pad) & _c("lat").between(F.lit(25.3) - pad, F.lit(25.3) + pad))
    newest = b.select("id").orderBy(_c("id").desc()).limit(500).withColumn("hit", F.lit(True))
    metres = haversine(51.2, 25.3, "lon", "lat", RADIUS_ROUND)
    return b.join(newest, "id", "left").where(metres <= 2000).select("id", rounded(metres, 1).alias("metres"), F.coalesce("hit", F.lit(False)).alias("within_limit"))


@book(f"WITH {PROBES} SELECT day, count(*) AS kept FROM v_probe WHERE t >= (SELECT max(t) FROM v_probe) - {TTL_H} * 3600000 GROUP BY 1")
def v17_retention(spark: SparkSession, folder: str, hours: int = TTL_H) -> DataFrame:
    """Fixes left per day after deleting those older than hours before the newest; stored by day, whole older days are never read."""
    newest = probes(spark, folder).agg(F.max("t").alias("newest"))
    return probes(spark, folder).join(F.broadcast(newest), F.lit(True)).where(_c("t") >= _c("newest") - hours * 3_600_000).groupBy("day").agg(F.count("*").alias("kept"))


_REASONS = ["kept", "malformed", "out_of_bounds", "accuracy", "no_time", "truncated", "out_of_order"]


@book(f"""WITH {_GATE}, k AS (SELECT * FROM (SELECT unnest({_REASONS!r}) AS reason) a, (SELECT unnest(['live', 'import', 'native']) AS source) b), c AS (SELECT outcome AS reason, source, count(*) AS n FROM g GROUP BY 1, 2)
SELECT reason, source, coalesce(n, 0) AS n FROM k LEFT JOIN c USING (reason, source)""")
def v18_counters(spark: SparkSession, folder: str) -> DataFrame:
    keys = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in _REASONS])).alias("reason")).withColumn("source", F.explode(F.array(F.lit("live"), F.lit("import"), F.lit("native"))))
    counts = gate(raw_points(spark, folder)).groupBy(_c("outcome").alias("reason"), "source").agg(F.count("*").alias("n"))
    return keys.join(counts, ["reason", "source"], "left").select("reason", "source", F.coalesce("n", F.lit(0)).alias("n"))




# What a trip token may look like, and the reason given for one that does not.
TOKEN, NO_TOKEN = "^[A-Za-z0-9_-]{16,128}$", "no_trip_token"


@book(f"""WITH k AS (SELECT DISTINCT trip_pseudonym AS token FROM observation UNION ALL SELECT DISTINCT doc_id || '' FROM documents)
SELECT token, CASE WHEN regexp_matches(token, '{TOKEN}') THEN 'trip_' || substr({hmac_sql('token')}, 1, 32) END AS pseudonym, CASE WHEN NOT regexp_matches(token, '{TOKEN}') THEN '{NO_TOKEN}' END AS reason FROM k""")
def v5_keyed_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Keyed pseudonyms of trip tokens; what is no token gets none here, as a random one would make the query differ from run to run."""
    tokens = table(spark, folder, "observation").select(_c("trip_pseudonym").alias("token")).distinct().unionByName(table(spark, folder, "documents").select(_c("doc_id").cast("string").alias("token")).distinct())
    good = _c("token").rlike(TOKEN)
    return tokens.select("token", F.when(good, F.concat(F.lit("trip_"), F.substring(hmac_sha256(_c("token"), trip_key(spark)), 1, 32))).alias("pseudonym"), F.when(~good, NO_TOKEN).alias("reason"))


_DIGEST = f"""h AS (SELECT trip, t // 3600000 AS hour, sha256(string_agg(CAST(floor(lat * 100000e0 + 0.5e0) AS BIGINT) || ',' || CAST(floor(lon * 100000e0 + 0.5e0) AS BIGINT) || ',' || t, '|' ORDER BY t, id)) AS d FROM v_probe GROUP BY 1, 2),
dg AS (SELECT trip, {hmac_sql("string_agg(d, '|' ORDER BY hour)")} AS digest FROM h GROUP BY 1)"""


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(trip, digest): keyed, over the ordered places and times, by hours and then by the hours' digests, so that no task gathers a whole trip."""
    line = F.concat_ws(",", F.floor(_c("lat") * 100000 + 0.5), F.floor(_c("lon") * 100000 + 0.5), "t")
    hours = probes(spark, folder).groupBy("trip", F.floor(_c("t") / 3_600_000).alias("hour")).agg(F.array_sort(F.collect_list(F.struct("t", "id", line.alias("x")))).alias("xs"))
    hours = hours.select("trip", "hour", F.sha2(F.array_join(F.transform("xs", lambda s: s["x"]), "|"), 256).alias("d"))
    whole = hours.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("hour", "d"))).alias("xs"))
    return whole.select("trip", hmac_sha256(F.array_join(F.transform("xs", lambda s: s["d"]), "|"), trip_key(spark)).alias("digest"))


@book(f"WITH {PROBES}, {_DIGEST} SELECT trip, digest FROM dg")
def v20_trip_digest(spark: SparkSession, folder: str) -> DataFrame:
    return digests(spark, folder)


# Fixes that a trip to import must have, and the median step in seconds from which it is sparse.
LEAST_FIXES, SPARSE_S = 4, 60


def _gaps(fixes: DataFrame) -> DataFrame:
    """fixes (trip, t, id) with gap, the seconds since the fix before; in hours and over the hours of a trip, so that no window spans a whole trip."""
    f = fixes.withColumn("hour", F.floor(_c("t") / 3_600_000))
    ends = f.groupBy("trip", "hour").agg(F.max("t").alias("last"))
    before = ends.select("trip", "hour", F.lag("last").over(W.partitionBy("trip").orderBy("hour")).alias("before"))
    lag = F.lag("t").over(W.partitionBy("trip", "hour").orderBy("t", "id"))
    return f.join(before, ["trip", "hour"]).withColumn("gap", (_c("t") - F.coalesce(lag, _c("before"))) / 1000.0)


@book(f"""WITH {PROBES}, {_DIGEST}, d AS (SELECT trip, t, (t - lag(t) OVER (PARTITION BY trip ORDER BY t, id)) / 1000e0 AS gap FROM v_probe), m AS (SELECT trip, count(*) AS fixes, quantile_cont(gap, 0.5) AS step FROM d GROUP BY 1), f AS (SELECT digest, min(trip) AS first FROM dg GROUP BY 1)
SELECT trip, fixes, {r_sql('step')} AS step_s, CASE WHEN fixes < 4 THEN 'too_short' WHEN step > 60 THEN 'sparse' WHEN trip <> first THEN 'duplicate' ELSE 'accepted' END AS verdict FROM m JOIN dg USING (trip) JOIN f USING (digest)""")
def v12_import_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each trip: refused for too few fixes or too long steps, known already by its digest, or accepted."""
    m = _gaps(probes(spark, folder).select("trip", "t", "id")).groupBy("trip").agg(F.count("*").alias("fixes"), F.percentile("gap", 0.5).alias("step"))
    d = digests(spark, folder)
    first = d.groupBy("digest").agg(F.min("trip").alias("first"))
    verdict = F.when(_c("fixes") < LEAST_FIXES, "too_short").when(_c("step") > SPARSE_S, "sparse").when(_c("trip") != _c("first"), "duplicate").otherwise("accepted")
    return m.join(d, "trip").join(first, "digest").select("trip", "fixes", rounded(_c("step")).alias("step_s"), verdict.alias("verdict"))


@book("SELECT id, CASE WHEN starts_with(ltrim(text), '<?xml') OR starts_with(ltrim(text), '<gpx') THEN 'gpx' WHEN starts_with(ltrim(text), '{') THEN 'geojson' WHEN starts_with(ltrim(text), '#') THEN 'markdown' WHEN trim(text) = '' THEN 'empty' ELSE 'text' END AS kind FROM (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL) q")
def o9_sniff(spark: SparkSession, folder: str) -> DataFrame:
    head = F.ltrim("text")
    kind = F.when(head.startswith("<?xml") | head.startswith("<gpx"), "gpx").when(head.startswith("{"), "geojson").when(head.startswith("#"), "markdown").when(F.trim("text") == "", "empty").otherwise("text")
    return table(spark, folder, "documents").where("text is not null").select(_c("doc_id").alias("id"), kind.alias("kind"))


@book("SELECT id, epoch_ms(created) AS ms, epoch_ms(try_cast(strftime(created, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP)) AS parsed FROM (SELECT DISTINCT id, created FROM incidents) d")
def o10_iso_times(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "incidents").select("id", "created").distinct().withColumn("iso", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss"))
    return d.select("id", F.unix_millis("created").alias("ms"), F.unix_millis(F.try_to_timestamp("iso", F.lit("yyyy-MM-dd'T'HH:mm:ss"))).alias("parsed"))
