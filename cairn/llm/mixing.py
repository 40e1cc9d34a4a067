"""Mixing sources to target weights (problem 7).

Documents are dealt into blocks by a hash of their id, which is a random permutation of each source. The
tokens a source owes are met by whole rounds over all its blocks and one round over a prefix of them. A
splitting tree then divides the exact number of blocks of every source among the output shards: at each
node the left half draws its share of the blocks from the multivariate hypergeometric distribution. Each
shard takes its quota of blocks from the source's permutation, and its documents are shuffled locally.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairn.llm.tokens import VOCABULARY, with_tokens
from cairn.storage import materialize

#: Blocks of a source: at least so many, and one for so many documents, up to a bound that keeps the plan small.
LEAST_BLOCKS, DOCUMENTS_A_BLOCK, MOST_BLOCKS = 256, 50_000, 65_536
#: Output shards: at least so many, and one for so many uses of documents, which are shuffled in one task.
SHARDS, USES_A_SHARD = 16, 500_000


def _unit(seed: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def shard_quotas(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """[shard, source] numbers of blocks: a random split of counts into shards of equal size, to one block."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)

    def split(lo: int, hi: int, left: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = left
            return
        mid, total = (lo + hi) // 2, int(left.sum())
        draws = total * (mid - lo) // (hi - lo)
        taken = rng.multivariate_hypergeometric(left, draws, method="marginals") if total else np.zeros_like(left)
        split(lo, mid, taken)
        split(mid, hi, left - taken)

    split(0, shards, np.asarray(counts, dtype=np.int64))
    return out


def plan_mix(blocks: pd.DataFrame, targets: pd.DataFrame, shards: int, seed: int, total_tokens: int | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(plan, partial) from the tokens of each (source, block).

    plan has source, block, copy and shard of every block used; partial has for each source the block of
    which only tokens up to rest are used in its last round. Without total_tokens the mix is as large as
    the repeats allow.
    """
    rng = np.random.default_rng(seed)
    have = blocks.groupby("source")["tokens"].sum().to_dict()
    used = [t for t in targets.itertuples() if t.target_share > 0 and have.get(t.source, 0) > 0 and t.max_repeats > 0]
    most = min((t.max_repeats * have[t.source] / t.target_share for t in used), default=0.0)
    total = most if total_tokens is None else min(float(total_tokens), most)
    units: dict[str, list[tuple[int, int]]] = {}
    partial = []
    for t in used:
        own = blocks[blocks["source"] == t.source].sort_values("block")
        owed = t.target_share * total
        rounds = min(int(t.max_repeats), int(owed / have[t.source] + 1e-9))
        units[t.source] = [(int(b), c) for c in range(rounds) for b in own["block"]]
        rest = owed - rounds * have[t.source]
        if rounds < t.max_repeats and rest > 0:
            for b, tokens in zip(own["block"], own["tokens"]):
                units[t.source].append((int(b), rounds))
                if tokens > rest:
                    partial.append((t.source, int(b), rounds, float(rest)))
                    break
                rest -= tokens
    sources = sorted(units)
    quotas = shard_quotas(np.array([len(units[s]) for s in sources], dtype=np.int64), shards, rng) if sources else np.zeros((shards, 0), dtype=np.int64)
    rows = []
    for k, s in enumerate(sources):
        order = rng.permutation(len(units[s]))
        shard = np.repeat(np.arange(shards), quotas[:, k])
        rows += [(s, *units[s][u], int(j)) for u, j in zip(order, shard)]
    return pd.DataFrame(rows, columns=["source", "block", "copy", "shard"]), pd.DataFrame(partial, columns=["source", "block", "copy", "rest"])


def mix(documents: DataFrame, targets: DataFrame, shards: int | None = None, seed: int = 11, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(shard, position, doc_id, source, copy, n_tokens): the mix, shuffled within each shard.

    Without shards there are as many as the documents and their repeats ask for. A source whose target is 0, that has no tokens or may not be used gives nothing; documents of sources
    without a target, without id or without tokens are left out; rows of one doc_id count once. A source
    misses its tokens by what its best fitting document leaves open. Empty tables give no rows.
    """
    spark = documents.sparkSession
    listed = targets.where("source is not null and target_share is not null and max_repeats is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goals = listed.toPandas()  # one row per source that the targets name
    sized = with_tokens(documents.where(F.col("source").isin(list(goals["source"])) & F.col("doc_id").isNotNull()), ["doc_id", "source"], vocabulary=vocabulary)
    sized = sized.where("n_tokens > 0").groupBy("doc_id").agg(F.max(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.source", "d.n_tokens")
    sized = materialize(sized.withColumn("place", _unit(seed, "doc_id")), "sized")
    listed_uses = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.count("*").alias("n")).collect()}  # one row per source that the targets name
    n_documents = sum(listed_uses.values())
    if shards is None:
        repeats = dict(zip(goals["source"], goals["max_repeats"]))
        shards = max(SHARDS, math.ceil(sum(n * max(0, int(repeats[s])) for s, n in listed_uses.items()) / USES_A_SHARD))
    count = int(min(MOST_BLOCKS, max(LEAST_BLOCKS, math.ceil(n_documents / DOCUMENTS_A_BLOCK))))
    dealt = sized.withColumn("block", F.floor(F.col("place") * count).cast("int"))
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")).toPandas()  # at most sources x MOST_BLOCKS rows
    plan, partial = plan_mix(blocks, goals, shards, seed, total_tokens)
    frame = lambda pdf, schema: spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in pdf.itertuples(index=False)], schema)
    plan_rows = F.broadcast(frame(plan, "source string, block int, copy int, shard int"))  # sources x repeats x blocks at most
    ends = F.broadcast(frame(partial, "source string, block int, copy int, rest double"))  # one row per source
    rows = dealt.join(plan_rows, ["source", "block"])
    whole = rows.join(ends, ["source", "block", "copy"], "left_anti")
    # of the last block of a source the documents up to the tokens still owed, then of those left out the one that fits the gap best
    w = W.partitionBy("source").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    last = rows.join(ends, ["source", "block", "copy"]).withColumn("filled", F.sum("n_tokens").over(w))
    cut = last.where("filled <= rest")
    filled = cut.groupBy("source").agg(F.max("filled").alias("filled"))
    gaps = last.select("source", "block", "copy", "shard", "rest").distinct().join(filled, "source", "left").withColumn("gap", F.col("rest") - F.coalesce("filled", F.lit(0)))  # one row per source
    gaps = F.broadcast(gaps.select("source", F.col("block").alias("end"), "copy", "shard", "gap"))
    unused = dealt.join(gaps, "source").where(F.col("block") >= F.col("end")).join(cut.select("doc_id"), "doc_id", "left_anti")
    fits = unused.where(F.abs(F.col("n_tokens") - F.col("gap")) < F.col("gap"))
    best = fits.groupBy("source").agg(F.min_by(F.struct("doc_id", "n_tokens", "copy", "shard"), F.struct(F.abs(F.col("n_tokens") - F.col("gap")), "place", "doc_id")).alias("b"))
    columns = ["doc_id", "source", "n_tokens", "copy", "shard"]
    used = whole.select(*columns).unionByName(cut.select(*columns)).unionByName(best.select("b.doc_id", "source", "b.n_tokens", "b.copy", "b.shard"))
    local = W.partitionBy("shard").orderBy(_unit(seed + 1, "doc_id", "copy"), "doc_id", "copy")
    return used.select("shard", (F.row_number().over(local) - 1).alias("position"), "doc_id", "source", "copy", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, actual_share of the tokens, tokens, documents, uses and most_uses of one document."""
    uses = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"))
    got = uses.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    total = got.agg(F.sum("tokens").alias("total"))
    rows = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").crossJoin(F.broadcast(total))  # total is one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("source", "target_share", F.coalesce(F.round(F.col("tokens") / F.col("total"), 6), F.lit(0.0)).alias("actual_share"), "max_repeats", zero("tokens"), zero("documents"), zero("uses"), zero("most_uses"))
