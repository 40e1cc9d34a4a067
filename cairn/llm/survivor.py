"""One surviving record per duplicate group, the best value field by field (problem 3).

Values are first judged whole or not. Among whole values the highest confidence wins, then the latest
extraction. Where an extraction time is missing, currency reasoning decides: timestamped rows of all groups
teach which values of the fields and which states of a record (where it comes from, how it is used, whether
it is shown) give way to which. Within a group these precedences order the record without a time against
the latest one that has a time; a record that comes after it takes its place. Records without any time
are ordered by the topological levels of their states. Precedences against the order of the majority (those
on a cycle) are dropped one by one, the others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairn.llm.mojibake import CHAINS, invert, plausible
from cairn.llm.place_names import KIND_WORDS, fold, is_placeholder, parse, skeleton, squeeze
from cairn.storage import materialize

FIELDS = ("name", "name_ar", "address", "confidence")
#: Attributes of few values that tell the states a record goes through, and fields whose values follow one another.
STATES = ("source", "usefulness", "exclusion", "map_visible", "map_hidden_reason")
TEXTS = ("name", "name_ar", "address")
_CUT_MARKS = ("…", "...", "..")
_KINDS = sorted({fold(w) for words in KIND_WORDS.values() for w in words})
# Words that stand for a kind of place only with a dot or a further word after them.
_HALF_KINDS = {"rest", "pharm", "sch", "petrol", "med", "medical", "car", "cash", "coffee", "super", "hyper", "محطة"}


def _garbled(text: str) -> bool:
    """Question marks or replacement characters for letters, or a strict trace of UTF-8 read as something else."""
    letters = sum(c.isalpha() for c in text)
    if "�" in text or (text.count("?") >= 2 and text.count("?") > letters):
        return True
    return not text.isascii() and any((u := invert(text, c)) and u != text and plausible(u.replace(" ", "")) for c in CHAINS if c[-1][0] == "utf-8")


def judge_text(field: str, value: str | None, locality: str | None) -> tuple[bool, str, str, int]:
    """(sound by itself, letters, bones, kind): letters and bones are what values of one group are compared by."""
    if is_placeholder(value) or _garbled(value):
        return False, "", "", 0
    text = fold(value)
    letters = "".join(c for c in text if c.isalnum())
    cut = value.rstrip().endswith(_CUT_MARKS) or text[-1:] in ",-(/&"
    bare = text.rstrip(". …")
    if field == "address":
        mere = not any(c.isdigit() for c in text) and "," not in text
        return bool(letters) and not cut and not mere, letters, "", 0
    core, kind, _, _ = parse(value)
    if not core:
        return False, letters, "", int(bool(kind))
    arabic = sum("؀" <= c <= "ۿ" for c in text)
    if field == "name_ar" and arabic * 2 <= sum(c.isalpha() for c in text):
        return False, "", "", 0
    words, whole_kind = core.split(), int(bool(kind))
    ends = text.split()[-1]
    cut = cut or (ends in _HALF_KINDS and not value.rstrip().endswith("."))
    if core == "ا" or (len(text) > 1 and any(k.startswith(text) and k != text for k in _KINDS)):
        return False, "", "", 0  # the beginning of an article or a kind of place
    squeezed = "".join(squeeze(w) for w in words) if core.isascii() else "".join(words).replace("ى", "ي")
    # a last word that begins a kind of place without ending it
    if len(words) > 1 and not kind and any(k.startswith(words[-1]) and k != words[-1] for k in _KINDS) and bare.endswith(words[-1]):
        return not cut, "".join(squeeze(w) for w in words[:-1]) if core.isascii() else "".join(words[:-1]), skeleton(" ".join(words[:-1])).replace("f", ""), 0
    return not cut, squeezed, skeleton(core).replace("f", ""), whole_kind


def _judged(rows: DataFrame) -> DataFrame:
    """Distinct (cluster_id, field, value, locality) with what judge_text says of them."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [judge_text(f, v, loc) for f, v, loc in zip(batch["field"], batch["value"], batch["locality"])]
            yield pd.DataFrame({"cluster_id": batch["cluster_id"], "field": batch["field"], "value": batch["value"], "locality": batch["locality"], **{c: [x[k] for x in found] for k, c in enumerate(("sound", "letters", "bones", "kind"))}})

    return rows.mapInPandas(read, "cluster_id string, field string, value string, locality string, sound boolean, letters string, bones string, kind int")


def _shortened(texts: DataFrame, within: list[str], key: str) -> DataFrame:
    """Distinct (within, key, kind) that are a beginning of another: the next in order begins with it, or has a kind of place besides."""
    some = texts.where(F.length(key) > 0).select(*within, key, "kind").distinct()
    short = some.where(F.length(key) < 3)
    # the next value in order of the same first letters has it as a beginning if any has; very short ones are looked up by their own
    w = W.partitionBy(*within, F.substring(key, 1, 3)).orderBy(key, "kind")
    after, after_kind = F.lead(key).over(w), F.lead("kind").over(w)
    ranked = some.where(F.length(key) >= 3).withColumns({"after": after, "after_kind": after_kind})
    cut = ranked.where(F.col("after").isNotNull() & F.expr(f"startswith(after, {key})") & ((F.col("after") != F.col(key)) | (F.col("after_kind") > F.col("kind")))).select(*within, key, "kind")
    starts = some.where(F.length(key) > 1).select(*within, F.explode(F.array_distinct(F.array(F.substring(key, 1, 1), F.when(F.length(key) > 2, F.substring(key, 1, 2))))).alias(key)).where(f"{key} is not null").distinct()
    return cut.unionByName(short.join(starts, [*within, key], "left_semi").select(*within, key, "kind")).distinct()


def localities(places: DataFrame) -> DataFrame:
    """(last): the distinct localities of places, as an address ends in them."""
    return places.select(F.lower(F.trim("locality")).alias("last")).where("last <> ''").distinct()


def whole_values(places: DataFrame, known: DataFrame) -> DataFrame:
    """(cluster_id, field, value, locality) of the text values that are whole; known: localities of the whole corpus."""
    text = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("name", "name_ar", "address")]))
    values = places.select("cluster_id", "locality", text.alias("x")).select("cluster_id", "x.field", "x.value", "locality").where("value is not null").distinct()
    judged = materialize(_judged(values), "judged")
    names, addresses = judged.where("field <> 'address'"), judged.where("field = 'address'")
    by_letters = _shortened(names.where("sound").withColumn("script", F.col("letters").rlike("^[\\x00-\\x7f]*$")), ["cluster_id", "script"], "letters").select("cluster_id", "letters", "kind").distinct()
    by_bones = _shortened(names.where("sound"), ["cluster_id"], "bones").select("cluster_id", "bones", "kind")
    kept = names.where("sound").join(by_letters, ["cluster_id", "letters", "kind"], "left_anti").join(by_bones, ["cluster_id", "bones", "kind"], "left_anti")
    # an address is whole if it names its locality at the end; localities are those the corpus knows
    last = F.lower(F.trim(F.element_at(F.split("value", ","), -1)))
    mere = addresses.where("sound").withColumn("last", last).where(F.size(F.split("value", ",")) > 1).join(known, "last", "left_semi")
    return kept.select("cluster_id", "field", "value", "locality").unionByName(mere.select("cluster_id", "field", "value", "locality"))


def _attributes(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, attribute, value) of the states, missing ones as '', and of the non-null texts of each row."""
    states = [F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit("")).alias("value")) for a in STATES]
    texts = [F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in TEXTS]
    return rows.select(*keep, F.explode(F.array(*states, *texts)).alias("x")).select(*keep, "x.*").where("value is not null")


def precedences(places: DataFrame) -> DataFrame:
    """(attribute, earlier, later, lead): what timestamped rows teach, in direct transitions within groups.

    One value gives way to the next if it was last seen before the next was first seen. A precedence holds
    if its transitions outnumber the opposite ones by more than chance (one standard deviation of as many
    coin tosses); lead is the share of that surplus.
    """
    timed = places.where("extracted_at is not null")
    spans = _attributes(timed, "cluster_id", "extracted_at").groupBy("cluster_id", "attribute", "value").agg(F.min("extracted_at").alias("first"), F.max("extracted_at").alias("last"))
    w = W.partitionBy("cluster_id", "attribute").orderBy("first", "last", "value")
    steps = spans.withColumn("before", F.lag(F.struct("value", "last")).over(w)).where("before.last < first")
    counts = steps.groupBy("attribute", F.col("before.value").alias("earlier"), F.col("value").alias("later")).agg(F.count("*").alias("n"))
    # both directions in one row: (least, greatest) with the transitions either way
    up = F.col("earlier") < F.col("later")
    pairs = counts.groupBy("attribute", F.least("earlier", "later").alias("a"), F.greatest("earlier", "later").alias("b")).agg(
        F.sum(F.when(up, F.col("n")).otherwise(0)).alias("ab"), F.sum(F.when(~up, F.col("n")).otherwise(0)).alias("ba")
    )
    surplus, forward = F.abs(F.col("ab") - F.col("ba")), F.col("ab") > F.col("ba")
    kept = pairs.where(surplus > F.sqrt(F.col("ab") + F.col("ba")))
    return kept.select("attribute", F.when(forward, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("later"), (surplus / (F.col("ab") + F.col("ba"))).alias("lead"))


def levels(order: list[tuple[str, str, str, float]]) -> dict[tuple[str, str], int]:
    """Topological level of each state: the length of the longest chain of precedences (attribute, earlier, later, lead) before it.

    Precedences that run against the balance of leads of their two states, at least one of every cycle, are
    dropped; all others count.
    """
    out: dict[tuple[str, str], int] = {}
    for attribute in sorted({o[0] for o in order}):
        edges = [(x, y, lead) for a, x, y, lead in order if a == attribute]
        balance = dict.fromkeys((s for x, y, _ in edges for s in (x, y)), 0.0)
        for x, y, lead in edges:
            balance[x] -= lead
            balance[y] += lead
        level = dict.fromkeys(balance, 0)
        for s in sorted(balance, key=lambda s: (balance[s], s)):
            level[s] = max([0, *(level[x] + 1 for x, y, _ in edges if y == s and balance[x] < balance[y])])
        out |= {(attribute, s): n for s, n in level.items()}
    return out


def _level(order: dict[tuple[str, str], int]) -> Column:
    parts = [F.lit(0)]
    for (attribute, state), level in sorted(order.items()):
        if level:
            parts.append(F.when(F.coalesce(F.col(attribute).cast("string"), F.lit("")) == state, level).otherwise(0))
    return sum(parts[1:], parts[0])


def _overtaken(chosen: DataFrame, top: DataFrame, rows: DataFrame, order: DataFrame) -> DataFrame:
    """(cluster_id, field, canonical_id, value) of the record without a time that comes latest after the chosen one, where there is any.

    For each record in question the leads of the precedences from the chosen record's values to its own are
    added up, those the other way taken off; what is above 0 comes after.
    """
    keys = ["cluster_id", "field"]
    untimed = top.where("extracted_at is null").select(*keys, "canonical_id", "level", "value")
    duels = untimed.join(chosen.select(*keys, F.col("canonical_id").alias("against")), keys).where("canonical_id <> against")
    known = rows.groupBy("cluster_id", "canonical_id").agg(F.max_by(F.struct(*STATES, *TEXTS), F.struct("extracted_at", F.xxhash64(*STATES, *TEXTS))).alias("v")).select("cluster_id", "canonical_id", "v.*")
    own = _attributes(duels.select("cluster_id", "canonical_id", "against").distinct().join(known, ["cluster_id", "canonical_id"]), "cluster_id", "canonical_id", "against")
    other = _attributes(known, "cluster_id", "canonical_id").select("cluster_id", F.col("canonical_id").alias("against"), "attribute", F.col("value").alias("was"))
    both = own.join(other, ["cluster_id", "against", "attribute"]).where("value <> was")
    forward = both.join(order, (both.attribute == order.attribute) & (both.was == order.earlier) & (both.value == order.later)).select("cluster_id", "canonical_id", "against", "lead")
    back = both.join(order, (both.attribute == order.attribute) & (both.value == order.earlier) & (both.was == order.later)).select("cluster_id", "canonical_id", "against", (-F.col("lead")).alias("lead"))
    after = forward.unionByName(back).groupBy("cluster_id", "canonical_id", "against").agg(F.sum("lead").alias("after")).where("after > 0")
    won = duels.join(after, ["cluster_id", "canonical_id", "against"]).withColumn("rank", F.struct("after", "level"))
    best = won.groupBy(*keys).agg(F.max("rank").alias("best"))
    won = won.join(best, keys).where(F.col("rank") == F.col("best"))
    return won.groupBy(*keys).agg(F.min("canonical_id").alias("canonical_id"), F.min_by("value", "canonical_id").alias("value"))


def surviving_values(places: DataFrame, currency: bool = True) -> DataFrame:
    """(cluster_id, field, value, canonical_id) for groups of at least two distinct canonical_ids.

    The value of each field is the whole one of highest confidence (out of range or missing is lowest),
    then of latest extracted_at; a record without extracted_at comes later than that one if the learnt
    precedences say so, else before it. What is still equal goes by the topological level of the record's
    states, then by the least canonical_id. Rows without cluster_id or canonical_id are left out, repeated
    rows count once, a field without any whole value has no row. Without currency missing times come last.
    """
    rows = places.where("cluster_id is not null and canonical_id is not null").select("cluster_id", "canonical_id", *TEXTS, "locality", "confidence", "extracted_at", *STATES).distinct()
    groups = rows.groupBy("cluster_id").agg(F.min("canonical_id").alias("a"), F.max("canonical_id").alias("b")).where("a < b").select("cluster_id")
    rows = materialize(rows.join(groups, "cluster_id", "left_semi"), "grouped")
    order = materialize(precedences(rows), "precedences")
    states = order.where(F.col("attribute").isin(*STATES)).collect() if currency else []  # pairs of states of five enumerations
    trusted = F.when(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.col("confidence"))
    ranked = rows.withColumns({"trust": F.coalesce(trusted, F.lit(-1.0)), "level": _level(levels([tuple(r) for r in states]))})
    kept = ["cluster_id", "canonical_id", "locality", "trust", "extracted_at", "level"]
    text = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in TEXTS]))
    texts = ranked.select(*kept, text.alias("x")).select(*kept, "x.field", "x.value")
    whole = whole_values(rows, localities(places))
    same = [texts[c].eqNullSafe(whole[c]) if c == "locality" else texts[c] == whole[c] for c in ("cluster_id", "field", "value", "locality")]
    texts = texts.join(whole, same, "left_semi")
    numbers = ranked.where("trust >= 0").select(*kept, F.lit("confidence").alias("field"), F.col("confidence").cast("string").alias("value"))
    rank = F.struct("trust", "extracted_at", "level")
    best = texts.unionByName(numbers).groupBy("cluster_id", "field", "canonical_id").agg(F.max(F.struct(rank.alias("rank"), F.col("value"))).alias("m")).select("cluster_id", "field", "canonical_id", "m.rank.*", "m.value")
    # one pre-aggregated maximum a group: of rank, then of the least canonical_id
    first = best.groupBy("cluster_id", "field").agg(F.max(rank).alias("rank"))
    top = best.join(first, ["cluster_id", "field"]).where(F.col("trust") == F.col("rank.trust"))
    same_rank = F.col("extracted_at").eqNullSafe(F.col("rank.extracted_at")) & (F.col("level") == F.col("rank.level"))
    pick = lambda c: F.when(same_rank, F.col(c))
    chosen = top.groupBy("cluster_id", "field").agg(F.min_by(pick("value"), pick("canonical_id")).alias("value"), F.min(pick("canonical_id")).alias("canonical_id"))
    if not currency or rows.where("extracted_at is null").isEmpty():  # with all times known there is nothing to reason about
        return chosen
    top, chosen = materialize(top, "top"), materialize(chosen, "chosen")
    later = _overtaken(chosen, top, rows, order).select("cluster_id", "field", F.col("canonical_id").alias("later"), F.col("value").alias("later_value"))
    out = chosen.join(later, ["cluster_id", "field"], "left")
    return out.select("cluster_id", "field", F.when(F.col("later").isNotNull(), F.col("later_value")).otherwise(F.col("value")).alias("value"), F.coalesce("later", "canonical_id").alias("canonical_id"))


def surviving_records(places: DataFrame) -> DataFrame:
    """One record per group, a column per field and one with the canonical_id that gave it."""
    return surviving_values(places).groupBy("cluster_id").agg(*[x for f in FIELDS for x in (F.max(F.when(F.col("field") == f, F.col("value"))).alias(f), F.max(F.when(F.col("field") == f, F.col("canonical_id"))).alias(f"{f}_from"))])
