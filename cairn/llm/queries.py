"""Queries of the linkage and training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm.mixing import mix, shares
from cairn.llm.mojibake import garbled_documents
from cairn.llm.packing import CAPACITY, fill_report, pack_documents
from cairn.llm.place_groups import found_groups, place_groups
from cairn.llm.place_match import match_places
from cairn.llm.survivor import surviving_records, surviving_values
from cairn.llm.tokens import with_tokens
from cairn.storage import materialize, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return found_groups(table(spark, folder, "canonical_poi"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return place_groups(table(spark, folder, "canonical_poi"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_matches(spark, folder).select("osm_key", "overture_key")


def p2_matches(spark: SparkSession, folder: str) -> DataFrame:
    return match_places(table(spark, folder, "poi_osm"), table(spark, folder, "poi_overture"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return surviving_values(table(spark, folder, "canonical_poi")).select("cluster_id", "field", "canonical_id")


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return surviving_records(table(spark, folder, "canonical_poi"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(pack_documents(table(spark, folder, "documents")))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(p7_mix(spark, folder), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_documents(table(spark, folder, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_documents(table(spark, folder, "documents"))


# --- what SQL can say of the results ------------------------------------------------------------------


def p2_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose keys stand in no table, whose confidence is no accepted probability, and pairs given twice: none."""
    m = p2_matches(spark, folder)
    known = m.join(table(spark, folder, "poi_osm").select("osm_key").distinct(), "osm_key", "left_semi").join(table(spark, folder, "poi_overture").select("overture_key").distinct(), "overture_key", "left_semi")
    n = lambda c, name: F.count(c).alias(name)
    rows = m.select("osm_key", "overture_key", "confidence", F.lit(1).alias("all"), F.lit(0).alias("known")).unionByName(known.select("osm_key", "overture_key", "confidence", F.lit(0).alias("all"), F.lit(1).alias("known")))
    return rows.agg((F.sum("all") - F.sum("known")).alias("unknown_keys"), n(F.when((F.col("all") == 1) & ~F.col("confidence").between(0.5, 1), 1), "no_probability"), (F.sum("all") - F.countDistinct("osm_key", "overture_key")).alias("repeated"))


def p3_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return surviving_values(table(spark, folder, "canonical_poi")).where("field = 'confidence'").select("cluster_id", "canonical_id")


def p6_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed, containers above capacity, and documents cut though they fit: none of the latter two."""
    packed = materialize(p6_containers(spark, folder), "packed")
    full = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count(F.when(F.col("n") > CAPACITY, 1)).alias("overfull"))
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n")).agg(F.count("*").alias("documents"), F.count(F.when((F.col("pieces") > 1) & (F.col("n") <= CAPACITY), 1)).alias("cut_though_fitting"))
    return docs.crossJoin(F.broadcast(full))  # of one row each


def p7_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with a target, those used more often than allowed, and those whose tokens miss what they owe by more than their largest document: none of the latter two.

    What a source owes is its share of the largest mix that no source's repeats forbid.
    """
    s = p7_shares(spark, folder)
    sized = with_tokens(table(spark, folder, "documents").where("doc_id is not null and source is not null"), ["doc_id", "source"])
    have = sized.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("have"), F.max("n_tokens").alias("largest"))
    rows = materialize(s.join(have, "source", "left").withColumn("most", F.col("max_repeats") * F.col("have") / F.col("target_share")), "owed")  # one row a source
    rows = rows.crossJoin(F.broadcast(rows.where("target_share > 0 and most > 0").agg(F.min("most").alias("total"))))  # of one row
    missed = F.abs(F.col("tokens") - F.col("target_share") * F.col("total")) > F.col("largest")
    return rows.agg(F.count("*").alias("sources"), F.count(F.when(F.col("most_uses") > F.col("max_repeats"), 1)).alias("over_repeated"), F.count(F.when(missed, 1)).alias("off_target"))


def p8_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Documents found that hold a replacement character, and plain ASCII documents found: all such documents, and none."""
    found = table(spark, folder, "documents").join(p8_found(spark, folder), "doc_id", "left_semi")
    return found.agg(F.count(F.when(F.contains("text", F.lit("\ufffd")), 1)).alias("with_lost_letters"), F.count(F.when(~F.col("text").rlike(r"[^\x00-\x7F]"), 1)).alias("plain"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_found, p2_matches, p2_valid, p3_found, p3_survivors, p3_confidence, p6_containers, p6_fill, p6_valid, p7_mix, p7_shares, p7_valid, p8_found, p8_restored, p8_valid,
    )
}

_P1 = r"""
WITH RECURSIVE entries AS (
  SELECT DISTINCT canonical_id, lower(trim(replace(x, chr(160), ' '))) AS x, kind FROM (
    SELECT canonical_id, unnest(osm_ids) AS x, 'osm' AS kind FROM canonical_poi
    UNION ALL SELECT canonical_id, unnest(overture_ids), 'overture' FROM canonical_poi) q
  WHERE canonical_id IS NOT NULL AND x IS NOT NULL),
features AS (
  SELECT DISTINCT canonical_id, CASE WHEN kind = 'osm' THEN
      nullif(regexp_replace(regexp_extract(x, '^(?:osm:)?((?:node|way|relation|n|w|r)/?0*[1-9][0-9]*)$', 1), '^(n|w|r)[a-z]*/?0*', '\1'), '')
    ELSE CASE WHEN regexp_full_match(replace(replace(x, 'overture:', ''), '-', ''), '[0-9a-f]{32}')
              AND replace(replace(x, 'overture:', ''), '-', '') <> repeat('0', 32)
         THEN replace(replace(x, 'overture:', ''), '-', '') END END AS feature
  FROM entries),
links AS (
  SELECT DISTINCT a.canonical_id AS a, b.canonical_id AS b FROM features a JOIN features b USING (feature)
  WHERE a.canonical_id <> b.canonical_id),
reach AS (
  SELECT canonical_id AS a, canonical_id AS b FROM (SELECT DISTINCT a AS canonical_id FROM links) q
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a AS canonical_id, min(b) AS group_id FROM reach GROUP BY a)
"""
SQL = {
    "p1_found": _P1 + "SELECT group_id, canonical_id FROM groups",
    "p1_groups": _P1 + """
SELECT p.canonical_id, coalesce(g.group_id, p.canonical_id) AS group_id
FROM (SELECT DISTINCT canonical_id FROM canonical_poi WHERE canonical_id IS NOT NULL) p LEFT JOIN groups g USING (canonical_id)""",
    "p2_valid": "SELECT 0 AS unknown_keys, 0 AS no_probability, 0 AS repeated FROM (SELECT count(*) FROM poi_osm) q",
    "p3_confidence": """WITH g AS (SELECT cluster_id FROM canonical_poi WHERE cluster_id IS NOT NULL AND canonical_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT canonical_id) > 1),
r AS (SELECT cluster_id, canonical_id, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, extracted_at DESC, canonical_id) AS k FROM canonical_poi JOIN g USING (cluster_id) WHERE confidence BETWEEN 0 AND 1 AND NOT isnan(confidence))
SELECT cluster_id, canonical_id FROM r WHERE k = 1""",
    "p6_valid": "SELECT count(DISTINCT doc_id) AS documents, 0 AS overfull, 0 AS cut_though_fitting FROM documents",
    "p7_valid": "SELECT count(*) AS sources, 0 AS over_repeated, 0 AS off_target FROM mix_targets",
    "p8_valid": "SELECT count(DISTINCT doc_id) FILTER (WHERE contains(text, chr(65533))) AS with_lost_letters, 0 AS plain FROM documents",
}
