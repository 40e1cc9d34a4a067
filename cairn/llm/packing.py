"""Filling fixed-capacity containers by best-fit decreasing (problem 6).

Best-fit decreasing looks at nothing but sizes, and there are at most as many sizes as the capacity. So the
packing is computed exactly for all items from the number of items of each size: a segment tree over the
remaining capacities finds the tightest open container for a run of equal items in logarithmic time, and
the plan, runs of items onto runs of containers, is applied to the items by their rank within their size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.llm.tokens import VOCABULARY, with_tokens
from cairn.storage import materialize

CAPACITY = 2048
#: Items of one size that are numbered in one task; a size of more is dealt into hash parts of about that many.
PART_ROWS = 200_000


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: how many open containers have each, and the tightest that fits."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, remaining: int, n: int) -> None:
        node = self.width + remaining
        while node:
            self.open[node] += n
            node >>= 1

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least size that an open container has."""
        node = self.width + size
        if self.open[node]:
            return size
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


@dataclass(frozen=True)
class Run:
    """Items of one size with ranks from first on, n of them, each each-th going to the next container from container on."""

    size: int
    first: int
    n: int
    each: int
    container: int


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """(runs, number of containers) of packing counts[size] items of each size; sizes of 0 go to container 0."""
    if any(not 0 <= s <= capacity for s in counts):
        raise ValueError("sizes must lie within the capacity")
    tree, free = CapacityTree(capacity), {}  # free: containers by remaining capacity, as runs (first container, number)
    runs, opened = [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            free.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for size in sorted((s for s in counts if s and counts[s]), reverse=True):
        left, rank = counts[size], 0
        while left:
            remaining = tree.tightest(size)
            if remaining is None:
                each = capacity // size
                whole, rest = divmod(left, each)
                first, opened = opened, opened + whole + bool(rest)
                taken, used = left, whole + bool(rest)
                remaining = capacity
            else:
                first, n = free[remaining].pop()
                tree.add(remaining, -n)
                each = remaining // size
                used = min(n, -(-left // each))
                taken = min(left, used * each)
                put(remaining, first + used, n - used)
                whole, rest = divmod(taken, each)
            runs.append(Run(size, rank, taken, each, first))
            put(remaining - each * size, first, whole)
            if rest:
                put(remaining - rest * size, first + whole, 1)
            left, rank = left - taken, rank + taken
    if counts.get(0):
        runs.append(Run(0, 0, counts[0], counts[0], 0))
        opened = max(opened, 1)
    return runs, opened


def pieces_of(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items with size split into pieces of at most capacity: piece, start and size; only larger ones are split."""
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1)
    out = items.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("piece") * capacity)
    return out.withColumn("size", F.least(F.lit(capacity), F.col("size") - F.col("start")).cast("int"))


def pack(items: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """items (id, size) as pieces with their container: id, piece, start, size, container.

    An item larger than the capacity is cut into full pieces and a rest; others are never split. Items of
    no size lie in container 0. Repeated ids are separate items. Rows without id or size, or with a
    negative size, are left out. An empty table needs no container.
    """
    spark = items.sparkSession
    pieces = materialize(pieces_of(items.select("id", "size").where("id is not null and size >= 0"), capacity), "pieces")
    histogram = {int(r["size"]): int(r["n"]) for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    parts = spark.createDataFrame([(s, -(-n // part_rows)) for s, n in histogram.items()], "size int, parts int")
    pieces = pieces.join(F.broadcast(parts), "size").withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.col("parts")).cast("int")).drop("parts")
    counts = pieces.groupBy("size", "part").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    offsets = materialize(offsets, "offsets")  # one row for part_rows items of a size
    runs, _ = best_fit_decreasing(histogram, capacity)
    plan = pd.DataFrame([(r.size, r.first, r.n, r.each, r.container) for r in runs], columns=["size", "first", "n", "each", "container"]).sort_values(["size", "first"])
    columns = {c: plan[c].to_numpy(dtype=np.int64) for c in plan}
    broadcast = spark.sparkContext.broadcast(columns)  # a few runs for each size, whatever the number of items

    @F.pandas_udf("long")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        p = broadcast.value
        if not len(size):
            return pd.Series([], dtype="int64")
        span = np.int64(int(p["n"].max()) + int(p["first"].max()) + 1)
        at = np.searchsorted(p["size"] * span + p["first"], size.to_numpy(np.int64) * span + rank.to_numpy(np.int64), side="right") - 1
        return pd.Series(p["container"][at] + (rank.to_numpy(np.int64) - p["first"][at]) // p["each"][at])

    rank = F.row_number().over(W.partitionBy("size", "part").orderBy("id", "piece")) - 1
    ranked = pieces.withColumn("local", rank).join(offsets.select("size", "part", "before"), ["size", "part"])
    return ranked.select("id", "piece", "start", "size", container(F.col("size"), (F.col("before") + F.col("local"))).alias("container"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, container_id) of all documents in containers of capacity tokens.

    A text of more tokens is cut at multiples of the capacity; null, empty and other texts without tokens
    lie in container 0. Repeated rows are packed as often as they occur.
    """
    sized = materialize(with_tokens(documents, ["doc_id"], vocabulary=vocabulary), "sizes")
    out = pack(sized.select(F.col("doc_id").alias("id"), F.col("n_tokens").alias("size")), capacity)
    return out.select(F.col("id").alias("doc_id"), "piece", F.col("start").alias("token_start"), F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused share, and the least number of containers any packing needs."""
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("filled"), F.count("*").alias("pieces"))
    return bins.agg(
        F.count("*").alias("containers"), F.sum("filled").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("filled").alias("fullest"),
        F.ceil(F.sum("filled") / capacity).alias("least_containers"), F.round(1 - F.sum("filled") / (F.count("*") * capacity), 6).alias("unused_share"),
    )
