"""Groups of canonical place records that carry the same source feature (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.llm.components import connected_groups, links_of_features


def osm_feature(text: Column) -> Column:
    """Element type and number of an OSM id however written ('n12', 'osm:node/12', ' W12 '); null if it names nothing."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), r"^osm\s*[:/]\s*", "")
    kind = F.regexp_extract(bare, r"^(node|way|relation|rel|n|w|r)[\s:/_#-]*0*([1-9][0-9]*)$", 1)
    number = F.regexp_extract(bare, r"^(node|way|relation|rel|n|w|r)[\s:/_#-]*0*([1-9][0-9]*)$", 2)
    return F.when(number != "", F.concat(F.lit("osm:"), F.substring(kind, 1, 1), number))


def overture_feature(text: Column) -> Column:
    """The 32 hexadecimal digits of an Overture id in lower case; null if it names nothing (empty, placeholder, all zero)."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), r"^(overture|gers)\s*[:/]\s*", "")
    digits = F.regexp_replace(bare, r"[-{}]", "")
    return F.when(digits.rlike("^[0-9a-f]{32}$") & ~digits.rlike("^(.)\\1*$"), F.concat(F.lit("ovt:"), digits))


def _features(places: DataFrame) -> DataFrame:
    def carried(column: str, read) -> DataFrame:
        return places.select("canonical_id", F.explode(column).alias("entry")).select("canonical_id", read(F.col("entry")).alias("feature"))

    return carried("osm_ids", osm_feature).unionByName(carried("overture_ids", overture_feature))


def found_groups(places: DataFrame) -> DataFrame:
    """(group_id, canonical_id) of the groups with at least two distinct canonical_ids.

    Null or empty id arrays, null entries and entries that name no feature link nothing; repeated rows of
    one canonical_id count as one record with all their features; rows without a canonical_id are left out.
    """
    return connected_groups(links_of_features(_features(places), "canonical_id", "feature")).select(F.col("group").alias("group_id"), F.col("vertex").alias("canonical_id"))


def place_groups(places: DataFrame) -> DataFrame:
    """(canonical_id, group_id) for every distinct non-null canonical_id; a record linked to no other is its own group."""
    everyone = places.select("canonical_id").where("canonical_id is not null").distinct()
    return everyone.join(found_groups(places), "canonical_id", "left").select("canonical_id", F.coalesce("group_id", "canonical_id").alias("group_id"))
