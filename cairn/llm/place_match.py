"""Matching place records of two sources without a common key by label-model linkage (problem 2).

Records alike in everything but their key form one class. Classes of the two sources that lie within reach
and share a spelling, a word or an address are candidates; ten heuristic functions vote on each, and the
generative model of label_model turns the votes into the confidence that decides. No rule stands beside it:
different numbers, different kinds of place in the names, or names without likeness are votes like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from cairn.llm import label_model
from cairn.llm.place_names import CATEGORY, fold, parse, skeleton, squeeze, variants
from cairn.operators.cells import cell, cells_within, near_metres
from cairn.storage import materialize

#: Metres beyond which two records are no candidates.
REACH_M = 300.0
THRESHOLD = 0.5

_TEXT, _LIST = StringType(), ArrayType(StringType())
FEATURES = StructType(
    [StructField("rec", BinaryType()), StructField("lon", DoubleType()), StructField("lat", DoubleType())]
    + [StructField(c, _LIST) for c in ("skeletons", "latin", "kinds", "numbers")]
    + [StructField("blocks", ArrayType(LongType()))]
    + [StructField(c, _TEXT) for c in ("class", "brand", "address", "locality")]
)
#: Letters from which spellings are hashed by prefix and suffix instead of being written out; the keys of a spelling do not depend on it.
_SHORT = 64
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def _key(kind: str, text: str) -> int:
    """Blocking key of a spelling: a hash of at most _SHORT letters, else a polynomial of the letters."""
    if len(text) <= _SHORT:
        return xxhash.xxh64_intdigest(kind + text) - (1 << 63)
    h = ord(kind)
    for c in text:
        h = (h * _BASE + ord(c)) % _PRIME
    return h


def deletion_keys(kind: str, text: str) -> set[int]:
    """Blocking keys of a text and of what is left of it without one letter, in time linear in its length."""
    n = len(text)
    if n <= 2:
        return {_key(kind, text)}
    if n <= _SHORT + 1:
        return {_key(kind, text)} | {_key(kind, text[:k] + text[k + 1 :]) for k in range(n)}
    before = [ord(kind)]  # polynomial of the first k letters
    for c in text:
        before.append((before[-1] * _BASE + ord(c)) % _PRIME)
    keys, after, power = {before[-1]}, 0, 1
    for k in range(n - 1, -1, -1):  # after: the letters behind k, power: the base to their number
        keys.add((before[k] * power + after) % _PRIME)
        after, power = (ord(text[k]) * power + after) % _PRIME, power * _BASE % _PRIME
    return keys


def features_of(rec, lon, lat, names, category, brand, address, locality) -> tuple | None:
    """Comparable features of one record in the order of FEATURES; None where no name is usable."""
    skeletons, latin, kinds, numbers, blocks = set(), set(), set(), set(), set()
    for name in names:
        for text in variants(name):
            core, kind, number, _ = parse(text)
            if kind:
                kinds.add(kind)
            if not core:
                continue
            if number:
                numbers.add(number)
            bones = skeleton(core)
            if not bones:
                continue
            skeletons.add(bones)
            if core.isascii():
                letters = squeeze(core.replace(" ", ""))
                if letters not in latin:
                    blocks |= deletion_keys("l", letters)
                latin.add(letters)
            blocks |= deletion_keys("s", bones) | {_key("t", x) for x in map(skeleton, core.split()) if len(x) > 1}
    if not skeletons:
        return None
    where = fold(address) if address else ""
    if any(c.isdigit() for c in where):
        blocks.add(_key("a", where))
    return (
        rec, lon, lat, sorted(skeletons), sorted(latin), sorted(kinds), sorted(numbers), sorted(blocks), CATEGORY.get((category or "").strip().lower()),
        skeleton(parse(brand)[0]) if brand else None, where or None, fold(locality) if locality else (where.split(",")[-1].strip() or None if where else None),
    )


_READ = ("lon", "lat", "names", "category", "brand", "address", "locality")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features of each class of records alike but for their key, (rec, key) of its members); rows: key and _READ."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.name for f in FEATURES]
        for batch in batches:
            given = zip(*(batch[c] for c in ("rec", *_READ)))
            found = (features_of(rec, lon, lat, [n for n in (names if names is not None else []) if n is not None], *rest) for rec, lon, lat, names, *rest in given)
            yield pd.DataFrame([f for f in found if f is not None], columns=columns)

    usable = rows.where("key is not null and lon is not null and lat is not null and not isnan(lon) and not isnan(lat) and abs(lat) <= 90")
    usable = usable.withColumn("rec", F.unhex(F.md5(F.to_json(F.struct(*_READ)))))
    return usable.select("rec", *_READ).dropDuplicates(["rec"]).mapInPandas(read, FEATURES), usable.select("rec", "key").distinct()


def _likeness(a: Column, b: Column) -> Column:
    """Greatest 1 - edits / length over the pairs of two lists; null if either is empty."""
    one = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: one(x, y)))))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


#: Functions that vote, how often a yes and a no of each are taken to be right when the fit starts, and the greatest share of true
#: matches that each may deny. Functions that look at the same letters start low; for contradictions the bound is tight.
VOTERS = {
    "bones": (0.7, 0.7, 1.0), "letters": (0.7, 0.7, 1.0), "alike": (0.7, 0.97, 1.0), "place_near": (0.7, 0.7, 1.0), "kind": (0.7, 0.99, 1e-4), "class": (0.7, 0.7, 1.0),
    "address": (0.8, 0.8, 1.0), "locality": (0.6, 0.6, 1.0), "brand": (0.7, 0.7, 1.0), "number": (0.7, 0.999, 1e-6),
}


def candidates(left: DataFrame, right: DataFrame, reach: float = REACH_M) -> DataFrame:
    """Pairs of feature rows within reach that share a spelling, a word or an address, with the votes on each."""
    lon, lat = F.col("lon"), F.col("lat")
    a = left.select(F.col("rec").alias("a_rec"), lon.alias("ax"), lat.alias("ay"), cell(lon, lat).alias("cell"), F.explode("blocks").alias("block"))
    b = right.select("rec", "lon", "lat", "blocks", F.explode(cells_within(lon, lat, reach)).alias("cell"))
    b = b.select(F.col("rec").alias("b_rec"), lon.alias("bx"), lat.alias("by"), "cell", F.explode("blocks").alias("block"))
    near = near_metres(*[F.col(c) for c in ("ax", "ay", "bx", "by")]) <= reach
    pairs = a.join(b, ["cell", "block"]).where(near).select("a_rec", "b_rec").distinct()
    full = lambda t, side: t.select(F.col("rec").alias(f"{side}_rec"), F.struct(*[c for c in t.columns if c not in ("rec", "blocks")]).alias(side))
    rows = pairs.join(full(left, "a"), "a_rec").join(full(right, "b"), "b_rec").withColumn("metres", near_metres(*[F.col(c) for c in ("a.lon", "a.lat", "b.lon", "b.lat")]))
    rows = rows.withColumns({"bones_like": _likeness(F.col("a.skeletons"), F.col("b.skeletons")), "letters_like": _likeness(F.col("a.latin"), F.col("b.latin"))})
    both = lambda c: (F.size(f"a.{c}") > 0) & (F.size(f"b.{c}") > 0)
    meet = lambda c: F.arrays_overlap(f"a.{c}", f"b.{c}")
    known = lambda c: F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNotNull()
    same = lambda c: F.col(f"a.{c}") == F.col(f"b.{c}")
    like = F.greatest("bones_like", "letters_like")
    numbered = lambda a: F.exists(a, lambda v: v.rlike(r"^\d"))
    votes = {
        "bones": _vote(F.col("bones_like") >= 0.99, F.col("bones_like") < 0.6),
        "letters": _vote(F.col("letters_like") >= 0.74, F.col("letters_like") < 0.6),
        "alike": _vote(like >= 0.7, like < 0.6),
        "place_near": _vote(F.col("metres") <= 60, F.col("metres") > 150),
        "kind": _vote(both("kinds") & meet("kinds"), both("kinds") & ~meet("kinds")),
        "class": _vote(known("class") & same("class"), known("class") & ~same("class")),
        "address": _vote(known("address") & same("address"), known("address") & ~same("address") & numbered(F.array("a.address")) & numbered(F.array("b.address"))),
        "locality": _vote(known("locality") & same("locality"), known("locality") & ~same("locality")),
        "brand": _vote(known("brand") & same("brand"), known("brand") & ~same("brand")),
        "number": _vote(both("numbers") & meet("numbers"), both("numbers") & ~meet("numbers")),
    }
    return rows.select("a_rec", "b_rec", *[votes[v].alias(f"v_{v}") for v in VOTERS])


def link(left: DataFrame, right: DataFrame, reach: float = REACH_M, fit=label_model.fit) -> DataFrame:
    """(a_key, b_key, confidence) of the pairs of rows (key, lon, lat, names, category, brand, address, locality) taken for one place.

    The confidence is the label model's posterior and alone decides, at THRESHOLD. Rows without key, place
    or usable name match nothing; repeated rows count once; several records of a place on one side all
    match. Records alike but for their key are compared once and expanded in the result. Empty inputs give
    no rows.
    """
    (a, a_keys), (b, b_keys) = _classes(left), _classes(right)
    a, b = materialize(a, "left"), materialize(b, "right")
    rows = materialize(candidates(a, b, reach), "candidates")
    columns = [f"v_{v}" for v in VOTERS]
    patterns = rows.groupBy(*columns).count().toPandas()  # at most 3 ** len(VOTERS) rows
    model = fit(patterns[columns].to_numpy(), patterns["count"].to_numpy(), accuracy=[v[:2] for v in VOTERS.values()], denied=[v[2] for v in VOTERS.values()])
    patterns["confidence"] = model.posterior(patterns[columns].to_numpy())
    schema = StructType([StructField(c, rows.schema[c].dataType) for c in columns] + [StructField("confidence", DoubleType())])
    judged = rows.sparkSession.createDataFrame(patterns[[*columns, "confidence"]].astype({c: "int32" for c in columns}), schema)
    out = rows.join(F.broadcast(judged), columns).where(F.col("confidence") >= THRESHOLD).select("a_rec", "b_rec", "confidence")
    members = lambda t, side: t.select(F.col("rec").alias(f"{side}_rec"), F.col("key").alias(f"{side}_key"))
    out = out.join(members(a_keys, "a"), "a_rec").join(members(b_keys, "b"), "b_rec")
    return out.groupBy("a_key", "b_key").agg(F.max("confidence").alias("confidence"))  # a key may stand in several classes


def match_places(osm: DataFrame, overture: DataFrame) -> DataFrame:
    """(osm_key, overture_key, confidence) of records of both sources that describe the same real place."""
    left = osm.select(F.col("osm_key").alias("key"), "lon", "lat", F.array("name", "name_en", "name_ar").alias("names"), "category", "brand", "address", F.lit(None).cast("string").alias("locality"))
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    right = overture.select(F.col("overture_key").alias("key"), "lon", "lat", names.alias("names"), "category", "brand", "address", "locality")
    return link(left, right).select(F.col("a_key").alias("osm_key"), F.col("b_key").alias("overture_key"), "confidence")
