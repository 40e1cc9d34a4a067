"""Consolidating pairwise matches into groups by low-diameter decomposition.

Each round draws for every vertex an exponentially distributed head start, lets clusters grow from the
vertices by one edge a step and gives each vertex to the cluster that reaches it first. Clusters become
super-vertices, edges inside a cluster vanish, and the next round works on the edges that remain. The
assignments of all rounds are composed at the end. An edge is cut with a probability bounded by the rate
of the head starts, so the edges shrink geometrically whatever the diameter of the components is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.storage import materialize

#: Steps a cluster may grow in one round; head starts are cut off there.
GROWTH_STEPS = 5
#: Rate of the exponential head starts, per step.
START_RATE = 0.3
#: Members of a shared feature that are linked to one of them; more are linked in parts, and the parts' hubs in turn.
HUB_MEMBERS = 1000


def links_of_features(members: DataFrame, vertex: str, feature: str, most: int = HUB_MEMBERS) -> DataFrame:
    """Edges (src, dst) that join all vertices carrying the same feature, without emitting pairs.

    The members of a feature are dealt into parts of about most, each linked to its least member; these
    hubs are linked in the same way until one is left. So no vertex has many more than most neighbours by
    one feature, however many carry it. Nulls in either column link nothing.
    """
    rows = members.select(F.col(vertex).alias("v"), F.col(feature).alias("f")).where("v is not null and f is not null").distinct()
    rows, out = materialize(rows, "members"), None
    for level in range(64):
        parts = rows.groupBy("f").agg(F.ceil(F.count("*") / most).alias("parts"))
        crowded = parts.where("parts > 1")
        last = crowded.isEmpty()
        if last:  # one hub a feature
            dealt = rows.withColumn("part", F.lit(0))
        else:  # the features of more than most members are fewer than members / most
            dealt = rows.join(crowded, "f", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("v", F.lit(level)), F.col("parts")), F.lit(0)).cast("int"))
        hubs = dealt.groupBy("f", "part").agg(F.min("v").alias("hub"))
        links = dealt.join(hubs, ["f", "part"]).select(F.col("v").alias("src"), F.col("hub").alias("dst")).where("src <> dst")
        out = links if out is None else out.unionByName(links)
        if last:
            return out.distinct()
        rows = materialize(hubs.join(crowded.select("f"), "f", "left_semi").select(F.col("hub").alias("v"), "f").distinct(), "hubs")
    raise RuntimeError("hubs did not converge")


def _head_start(vertex: str, seed: int) -> Column:
    """Growth steps before a vertex's own cluster starts: GROWTH_STEPS less an exponential draw, at least 0."""
    unit = (F.pmod(F.xxhash64(F.col(vertex), F.lit(seed)), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    return F.greatest(F.lit(0.0), F.lit(float(GROWTH_STEPS)) + F.log(unit) / START_RATE)


def _arcs(ends: DataFrame) -> DataFrame:
    """Distinct (src, dst, step) of rows (src, dst) that stand for links: both directions at one step, and staying at none."""
    a, b = F.col("src"), F.col("dst")
    each = [F.struct(x.alias("src"), y.alias("dst"), F.lit(step).alias("step")) for x, y, step in ((a, b, 1.0), (b, a, 1.0), (a, a, 0.0), (b, b, 0.0))]
    return ends.select(F.explode(F.array(*each)).alias("e")).select("e.*").distinct()


def _decompose(arcs: DataFrame, seed: int) -> DataFrame:
    """(v, center) for every vertex of arcs; v and center are always in one component."""
    reached = arcs.where("step = 0").select(F.col("src").alias("v"), F.struct(_head_start("src", seed).alias("at"), F.col("src").alias("center")).alias("best"))
    for _ in range(GROWTH_STEPS):  # arcs are sent by src once and serve all steps; who stays keeps what it has
        at = F.struct((F.col("best.at") + F.col("step")).alias("at"), F.col("best.center").alias("center"))
        reached = arcs.join(reached, arcs.src == reached.v).select(F.col("dst").alias("v"), at.alias("best")).groupBy("v").agg(F.min("best").alias("best"))
    return reached.select("v", F.col("best.center").alias("center"))


def _step(arcs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    moved = materialize(_decompose(arcs, seed), "clusters")
    a, b = moved.select(F.col("v").alias("src"), F.col("center").alias("a")), moved.select(F.col("v").alias("dst"), F.col("center").alias("b"))
    kept = arcs.where("src < dst").join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return moved, materialize(_arcs(kept.distinct()), "arcs")


def connected_groups(edges: DataFrame, src: str = "src", dst: str = "dst", seed: int = 7, max_rounds: int = 200) -> DataFrame:
    """(vertex, group): every vertex with an edge to another, and the least vertex of its component.

    Edges may repeat, point either way and be loops; nulls on either side are ignored. An empty input
    gives an empty result. The result holds all vertices; max_rounds only guards against a fault and
    raises rather than return a part.
    """
    arcs = materialize(_arcs(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst")), "arcs")
    levels: list[DataFrame] = []
    for k in range(max_rounds):
        if arcs.isEmpty():
            break
        moved, arcs = _step(arcs, seed + k)
        levels.append(moved)
    else:
        raise RuntimeError("components did not converge")
    if not levels:
        return arcs.select(F.col("src").alias("vertex"), F.col("dst").alias("group"))
    final = levels[-1]
    for lower in reversed(levels[:-1]):  # the upper levels shrink geometrically, so this costs as much as the first
        upper = final.select(F.col("v").alias("center"), F.col("center").alias("top"))
        final = lower.join(upper, "center", "left").select("v", F.coalesce("top", "center").alias("center"))
    final = materialize(final, "assigned")
    least = final.groupBy("center").agg(F.min("v").alias("group"))
    return final.join(least, "center").select(F.col("v").alias("vertex"), "group")
