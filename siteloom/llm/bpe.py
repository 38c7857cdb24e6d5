"""Encoding a corpus with a public byte-level BPE vocabulary (problem 8).

Every pre-token is merged under a segment tree over its adjacent pairs: a leaf holds the rank of the
pair that starts at that symbol, the root yields the leftmost pair of lowest rank, and a merge updates
three leaves in logarithmic time, until no pair of the vocabulary is left.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.session import spread, table

#: The vocabulary's folder and the pattern that splits text before the merges.
VOCABULARIES = "/opt/tokenizers"
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Largest vocabulary file that is broadcast, in bytes; a vocabulary doesn't grow with the corpus.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens a worker remembers (only speed depends on it), and the longest one worth remembering.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 48


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The rank of every token of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one pre-token.

    Ties between equal ranks go to the leftmost pair, since a node holds ``rank << 32 | position``.
    """
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    none = 1 << 62
    symbols: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank << 32 | i
    for k in range(width - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right

    def update(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            low = left if left < right else right
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    def pair(i: int) -> int:
        j = following[i]
        if j >= n:
            return none
        rank = ranks.get(symbols[i] + symbols[j])
        return none if rank is None else rank << 32 | i

    while tree[1] != none:
        i = tree[1] & 0xFFFFFFFF
        j = following[i]
        symbols[i] += symbols[j]
        symbols[j] = None
        following[i] = following[j]
        if following[i] < n:
            previous[following[i]] = i
        if j < n - 1:
            update(j, none)
        update(i, pair(i)) if i < n - 1 else None
        if previous[i] >= 0:
            update(previous[i], pair(previous[i]))
    return [ranks[s] for s in symbols if s is not None]


def encoder(ranks: dict[bytes, int], pattern: str = SPLIT) -> Callable[[str | None], list[int]]:
    """A function from text to ids; null and empty texts give an empty list."""
    split, known = regex.compile(pattern), {}

    def encode(text: str | None) -> list[int]:
        ids: list[int] = []
        for piece in split.findall(text) if text else ():
            found = known.get(piece)
            if found is None:
                found = merge(piece.encode("utf-8"), ranks)
                if len(piece) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids

    return encode


def encode_corpus(
    df: DataFrame, text: str = "text", ids: str = "ids", *, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken", pattern: str = SPLIT
) -> DataFrame:
    """``df`` with the array column ``ids`` of token ids of ``text``; ``ids`` replaces a column of that name.

    Narrow: no shuffle, whole texts, all rows kept as they are. Null, empty: empty list. Blank text is
    encoded as it stands. Special tokens' strings are ordinary text. The vocabulary file is read once by
    the driver and broadcast (bounded by ``MAX_VOCABULARY_BYTES``).
    """
    if os.path.getsize(vocabulary) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is too large for a vocabulary")
    with open(vocabulary, "rb") as file:
        data = df.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(read_ranks(data.value), pattern)
        for texts in batches:
            yield pd.Series([np.asarray(encode(t), dtype=np.int32) for t in texts], index=texts.index, dtype=object)

    return df.withColumn(ids, encoded(F.col(text)))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encode_corpus(documents).select("doc_id", "ids")


def p8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of every source."""
    documents = spread(table(spark, sf_dir, "documents").select("source", "text"))
    counted = encode_corpus(documents).select("source", F.size("ids").alias("n"))
    return counted.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))


QUERIES = {"p8_ids": p8_ids, "p8_token_counts": p8_token_counts}
SQL: dict[str, str] = {}
