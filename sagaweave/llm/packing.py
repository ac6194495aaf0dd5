"""Packing texts into containers of fixed capacity by the sum-of-squares rule.

Sizes are tokens of a public tokenizer, counted over whole texts. A text longer than a container is
cut into full containers and a rest; nothing else is cut. Items are dealt by hash into shards of at
most about ``SHARD`` items, each packed on its own: an item, large ones first, goes where the squared
counts of open containers per residual gap become smallest. A shard leaves a few containers open,
whatever its size, so the loss by sharding is a share of about one container in a thousand.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
SHARD = 32_768
# fixed value: the split pattern that belongs to this vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a ranks file, loaded once a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(documents: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """(doc_id, tokens); null texts have none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({doc_id: pdf[doc_id], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]]})

    return documents.select(doc_id, text).mapInPandas(count, f"{doc_id} {dict(documents.dtypes)[doc_id]}, tokens long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of every item, in the order given; sizes are from 1 to ``capacity``."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    place, made = np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes):
        # moving a container from gap g to g - s changes the sum of squares by 2 (N(g - s) - N(g) + 1);
        # filling one up changes it by 1 - 2 N(s), a new one by 2 N(capacity - s) + 1, or 0 if it is full at once
        change = 2 * (count[: capacity - s + 1] - count[s:] + 1)
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = np.iinfo(np.int64).max
        change[capacity - s] = 2 * count[capacity - s] + 1 if s < capacity else 0
        g = int(change.argmin()) + int(s)  # of equal ones the smallest gap
        if g == capacity:
            at, made = made, made + 1
        else:
            at = open_bins[g].pop()
            count[g] -= 1
        place[i] = at
        if g - s:
            open_bins[g - s].append(at)
            count[g - s] += 1
    return place


def packed_containers(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER
) -> DataFrame:
    """(doc_id, part, tokens, container, fill): where every document, or every part of a long one, lies.

    ``fill`` is the number of tokens in the container. A document has one row, a text longer than
    ``capacity`` one for each part (part counts from 0, parts but the last are full). Texts without
    tokens (null or empty) take no room: their container and fill are null. Repeated rows are items of
    their own, rows without doc_id are left out, an empty table gives an empty result.
    """
    kind = dict(documents.dtypes)[doc_id]
    scratch = Scratch(documents.sparkSession, "packing")
    counted, seen = scratch.counted(token_counts(documents.where(F.col(doc_id).isNotNull()), doc_id, text, tokenizer))
    parts = counted.where("tokens > 0").select(doc_id, "tokens", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1)).alias("part")).select(
        doc_id, "part", F.least(F.lit(capacity), F.col("tokens") - F.col("part") * capacity).alias("tokens")
    )
    shards = max(1, -(-seen["n"] // SHARD))
    sharded = parts.where(F.col("tokens") < capacity).withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), doc_id, "part"), F.lit(shards)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", doc_id, "part"], ascending=[False, True, True], ignore_index=True)
        sizes = pdf["tokens"].to_numpy()
        at = sum_of_squares(sizes, capacity)
        fill = np.bincount(at, weights=sizes).astype(np.int64)
        shard = int(pdf["shard"].iloc[0])
        return pdf[[doc_id, "part", "tokens"]].assign(container=[f"{shard}-{c}" for c in at], fill=fill[at])

    schema = f"{doc_id} {kind}, part int, tokens long, container string, fill long"
    rest = sharded.groupBy("shard").applyInPandas(pack, schema)
    full = parts.where(F.col("tokens") == capacity).select(doc_id, "part", "tokens", F.concat(F.lit("full-"), F.col(doc_id).cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container"), F.col("tokens").alias("fill"))
    none = counted.where("tokens = 0").select(doc_id, F.lit(0).alias("part"), "tokens", F.lit(None).cast("string").alias("container"), F.lit(None).cast("long").alias("fill"))
    return rest.unionByName(full).unionByName(none)
