"""Steps of a route: which vertices are maneuvers, and what is said of them.

All that looks at neighbours is a window over the vertices of one route; only the last rule, spacing by rank,
goes through a route's few maneuvers one after the other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairn.functions.geo import angle_difference

# Span in metres over which bearings are taken, least spacing, angle from which readings are two corners.
SPAN_M, SPACING_M, SAME_CORNER = 25.0, 15.0, 90.0
# Which of two close maneuvers counts more.
RANK = {"roundabout": 5, "uturn": 4, "turn-left": 3, "turn-right": 3, "slight-left": 2, "slight-right": 2, "continue": 1}
TURNS = ("slight-left", "slight-right", "turn-left", "turn-right", "uturn")
# How a road without a name is called, by its class; slip roads by the ending of theirs.
ROAD_WORDS = {
    "motorway": "the motorway", "trunk": "the main road", "primary": "the main road", "secondary": "the road", "tertiary": "the road", "unclassified": "the road",
    "residential": "the road", "living_street": "the road", "road": "the road", "service": "the service road", "track": "the track",
}
COMPASS = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]


def turn_type(delta: Column) -> Column:
    size = F.abs(delta)
    side = lambda left, right: F.when(delta < 0, left).otherwise(right)
    return F.when(size < 20, "continue").when(size < 45, side("slight-left", "slight-right")).when(size < 135, side("turn-left", "turn-right")).otherwise("uturn")


def display_name(name: Column, name_en: Column, lang: str | None) -> Column:
    return F.coalesce(F.nullif(name_en, F.lit("")), name) if lang == "en" else name


def road_label(highway: Column, name: Column) -> Column:
    """A road's name, or what its class is called."""
    kind = F.lower(highway)
    words = F.create_map(*[F.lit(x) for kv in ROAD_WORDS.items() for x in kv])
    return F.coalesce(F.nullif(name, F.lit("")), F.when(kind.endswith("_link"), "the slip road"), F.element_at(words, F.coalesce(kind, F.lit(""))), F.lit("the road"))


def instruction(kind: Column, bearing: Column, road: Column, exit_number: Column, same_road: Column) -> Column:
    """The sentence for a maneuver; an exit is only counted where the roads tell its number."""
    side = F.when(kind.endswith("left"), "left").otherwise("right")
    stay = kind.isin(*TURNS[:4]) & same_road
    compass = F.element_at(F.array(*[F.lit(c) for c in COMPASS]), (F.bround(F.pmod(bearing, F.lit(360.0)) / 45.0).cast("int") % 8) + 1)
    numbered = exit_number.between(1, len(ORDINALS))
    ordinal = F.element_at(F.array(*[F.lit(o) for o in ORDINALS]), F.when(numbered, exit_number).otherwise(1).cast("int"))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(kind == "arrive", "Arrive at destination").when(stay, say(F.when(kind.startswith("slight"), "Bear ").otherwise("Keep "), side, " to stay on ", road))
        .when((kind == "roundabout") & numbered, say("At the roundabout, take the ", ordinal, " exit onto ", road)).when(kind == "roundabout", say("At the roundabout, exit onto ", road))
        .when(kind == "depart", say("Head ", compass, " on ", road)).when(kind.startswith("slight"), say("Slight ", side, " onto ", road)).when(kind.startswith("turn"), say("Turn ", side, " onto ", road))
        .when(kind == "uturn", say("Make a U-turn onto ", road)).otherwise(say("Continue on ", road))
    )


def maneuvers(vertices: DataFrame) -> DataFrame:
    """Vertices that are maneuvers, with kind and exit_number, before spacing.

    vertices: route, i (from 0), cum metres, delta (bearing out less in), same_road, choice (another way to
    go), ring (the piece from here is part of a roundabout), leaves (a road leaves the ring here). A
    roundabout is one maneuver, at the vertex where it is left; bends before its entry are part of it, bends
    without a choice on the same road are none, and of readings of one corner the sharpest stays. Routes of
    one vertex arrive; null flags count as false.
    """
    w = W.partitionBy("route").orderBy("i")
    so_far, later = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1, W.unboundedFollowing)
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    v = vertices.withColumn("last", F.max("i").over(W.partitionBy("route"))).withColumns({"ring": no("ring") & (F.col("i") < F.col("last")), "leaves": no("leaves"), "same_road": no("same_road"), "choice": F.coalesce("choice", F.lit(True))})
    v = v.withColumn("was", F.coalesce(F.lag("ring").over(w), F.lit(False)))
    v = v.withColumn("began", F.last(F.when(F.col("ring") & ~F.col("was"), F.col("i")), True).over(so_far))
    v = v.withColumn("left", F.sum(F.col("leaves").cast("int")).over(so_far)).withColumn("entry", F.col("ring") & ~F.col("was") & (F.col("i") > 0))
    v = v.withColumns({"left_at_entry": F.last(F.when(F.col("entry"), F.col("left")), True).over(so_far), "next_entry": F.min(F.when(F.col("entry"), F.col("cum"))).over(later)})
    inside = F.col("ring") & (F.col("began") > 0)
    leaving = F.col("was") & ~F.col("ring") & (F.col("began") > 0)
    turn = turn_type(F.col("delta"))
    plain = F.when(turn == "uturn", turn).when((turn != "continue") & ~(F.col("same_road") & ~F.col("choice")), turn).when(~F.col("same_road"), "continue")
    kind = F.when((F.col("i") == F.col("last")), "arrive").when(F.col("i") == 0, "depart").when(inside, None).when(leaving, "roundabout").otherwise(plain)
    v = v.withColumn("kind", kind).where("kind is not null")
    is_turn = F.col("kind").isin(*TURNS)
    v = v.where(~(is_turn & F.coalesce(F.col("next_entry") - F.col("cum") <= SPAN_M, F.lit(False))))
    by_kind = W.partitionBy("route", "turning").orderBy("i")
    v = v.withColumn("turning", F.col("kind").isin(*TURNS))
    near = (F.col("cum") - F.lag("cum").over(by_kind) < SPAN_M) & (F.abs(angle_difference(F.col("delta"), F.lag("delta").over(by_kind))) < SAME_CORNER)
    v = v.withColumn("apart", ~F.coalesce(near, F.lit(False))).withColumn("corner", F.sum(F.col("apart").cast("int")).over(by_kind.rowsBetween(W.unboundedPreceding, 0)))
    sharpest = W.partitionBy("route", "turning", "corner").orderBy(F.abs("delta").desc(), "i")
    v = v.withColumn("k", F.when(F.col("turning"), F.row_number().over(sharpest)).otherwise(1)).where("k = 1")
    exit_number = F.when((F.col("kind") == "roundabout") & (F.col("left") > F.col("left_at_entry")), (F.col("left") - F.col("left_at_entry")).cast("int"))
    return v.withColumn("exit_number", exit_number).drop("last", "was", "began", "left", "entry", "left_at_entry", "next_entry", "turning", "apart", "corner", "k")


def spaced_by_rank(found: DataFrame) -> DataFrame:
    """Maneuvers (route, i, cum, kind, ...) of which none but the ends lies closer than SPACING_M behind another; of two close ones the higher rank stays."""
    def one(route: pd.DataFrame) -> pd.DataFrame:
        route = route.sort_values("i", ignore_index=True)
        kept: list[int] = []
        for k in range(len(route)):
            cum, kind = route["cum"][k], route["kind"][k]
            if kind != "arrive" and kept and kept[-1] != 0 and cum - route["cum"][kept[-1]] < SPACING_M:
                if RANK.get(kind, 0) > RANK.get(route["kind"][kept[-1]], 0):
                    kept[-1] = k
                continue
            kept.append(k)
        return route.iloc[kept]

    return found.groupBy("route").applyInPandas(one, found.schema)  # the few maneuvers of one route
