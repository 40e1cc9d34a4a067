"""Iterative graph operators over edge tables: components and shortest paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.storage import materialize


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) with the least node of each component, for edges (src, dst) in either direction.

    Labels spread to neighbours and then jump to the label of their label, so that rounds grow with the
    logarithm of the diameter. Each round is one pre-aggregated join on nodes and is written down, which
    cuts the lineage. Nulls link nothing; an empty table gives no rows.
    """
    pairs = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = materialize(edges.where("src is not null and dst is not null").select(pairs.alias("e")).select("e.src", "e.dst").distinct(), "links")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.dst == labels.node).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        moved = materialize(stepped.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not converge")


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: Column | str = "w", hops: int = 3, max_rounds: int = 10_000) -> DataFrame:
    """(source, node, cost, before): least cost from each source (node) over directed edges (src, dst, ...).

    weight is any non-negative column expression over the edges, null for an edge that is closed. The
    frontier of nodes that got cheaper is relaxed hops times between two materialisations; the loop ends
    when no node gets cheaper. before is the node before on a cheapest path, the least of equal ones.
    """
    paths = edges.select("src", "dst", (F.col(weight) if isinstance(weight, str) else weight).alias("step")).where("step is not null and step >= 0")
    paths = materialize(paths.groupBy("src", "dst").agg(F.min("step").alias("step")), "paths")
    best = materialize(sources.select(F.col("node").alias("source"), "node", F.lit(0).cast(paths.schema["step"].dataType).alias("cost"), F.lit(None).cast(paths.schema["src"].dataType).alias("before")).distinct(), "best")
    frontier = best.select("source", "node", "cost")
    for _ in range(max_rounds):
        reached = None
        front = frontier
        for _ in range(hops):
            step = front.join(paths, front.node == paths.src).groupBy("source", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("cost") + F.col("step")).alias("cost"), F.col("src").alias("before"))).alias("m"))
            step = step.select("source", "node", "m.cost", "m.before")
            reached = step if reached is None else reached.unionByName(step)
            front = step.select("source", "node", "cost")
        joined = best.withColumn("old", F.lit(True)).unionByName(reached.withColumn("old", F.lit(False)))
        merged = joined.groupBy("source", "node").agg(F.min(F.struct("cost", F.col("before").isNotNull().alias("far"), "before")).alias("m"), F.min(F.when(F.col("old"), F.col("cost"))).alias("was"))
        merged = materialize(merged.select("source", "node", "m.cost", "m.before", (F.col("was").isNull() | (F.col("m.cost") < F.col("was"))).alias("better")), "best")
        best, frontier = merged.select("source", "node", "cost", "before"), merged.where("better").select("source", "node", "cost")
        if frontier.isEmpty():
            return best
    raise RuntimeError("shortest paths did not converge")


def paths_back(found: DataFrame, ends: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(source, target, src, dst): the edges of the paths of shortest_paths to ends (source, target), traced back.

    Each round doubles how far a jump towards the source goes, and marks what lies one jump before the
    nodes marked so far, so that rounds grow with the logarithm of the longest path. Weights must be positive.
    """
    steps = materialize(found.where("before is not null").select("source", "node", "before"), "steps")
    jump, marked = steps.withColumnRenamed("before", "up"), ends.select("source", "target", F.col("target").alias("node"))
    for _ in range(max_rounds):
        further = marked.join(jump, ["source", "node"]).select("source", "target", F.col("up").alias("node"))
        marked = materialize(marked.unionByName(further).distinct(), "marked")
        onward = jump.select("source", F.col("node").alias("up"), F.col("up").alias("top"))
        jump = materialize(jump.join(onward, ["source", "up"]).select("source", "node", F.col("top").alias("up")), "jump")
        if jump.isEmpty():
            return marked.join(steps, ["source", "node"]).select("source", "target", F.col("before").alias("src"), F.col("node").alias("dst"))
    raise RuntimeError("a path does not lead back to its source")


def without_barriers(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """edges (src, dst, ...) that touch no blocked node."""
    return edges.join(blocked.select(F.col("node").alias("src")), "src", "left_anti").join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti")


def turn_states(edges: DataFrame, banned: DataFrame) -> DataFrame:
    """The graph of edges as nodes: (src, dst, w) from edge to edge where the turn (from, via, to) is not banned."""
    a = edges.select(F.struct("src", "dst").alias("a"), F.col("src").alias("from"), F.col("dst").alias("via"))
    b = edges.select(F.struct("src", "dst").alias("b"), F.col("src").alias("via"), F.col("dst").alias("to"), "w")
    turns = a.join(b, "via").join(banned.select("from", "via", "to"), ["from", "via", "to"], "left_anti")
    return turns.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
