"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

#: Vocabulary file of byte ranks, on the driver or in storage it can reach; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer of a vocabulary file, loaded once in each worker."""
    if vocabulary not in _LOADED:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _LOADED[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary]


def with_tokens(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns keep and n_tokens, the number of tokens of the whole text; null and empty texts have none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema) + ", n_tokens int"

    documents.sparkSession.sparkContext.addFile(vocabulary)  # sent to each executor once
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = encoder(SparkFiles.get(name))
        for batch in batches:
            sizes = [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch.pop("_text")]
            yield batch.assign(n_tokens=pd.Series(sizes, dtype="int32", index=batch.index))

    return documents.select(*keep, F.col(text).alias("_text")).mapInPandas(count, schema)
