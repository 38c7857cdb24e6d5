"""Finding evaluation passages in a training corpus (problem 9).

Each shard of documents becomes an FM-index over words: suffix array, Burrows-Wheeler transform and a
wavelet tree with rank counts. All phrases of the test items are searched backwards at once, their
occurrences are located through sampled suffix positions, and overlapping occurrences are merged into
spans to remove.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.session import spread, table

#: Consecutive words that make a leak.
PHRASE = 12
#: Words of one shard; a document longer than that is a shard of its own.
SHARD_WORDS = 1 << 20
#: Every so many text positions keep their suffix position.
SAMPLE = 16
#: Words of test items that are broadcast at once; more items are searched for in blocks of that size, long ones in
#: pieces that overlap by a phrase.
BLOCK_WORDS = 500_000

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")


def _blank(tag: re.Match) -> str:
    return " " * len(tag.group())


def words_of(text: str | None) -> list[str]:
    """Case-folded runs of letters or digits, without HTML tags."""
    return [w.casefold() for w in WORD.findall(TAG.sub(_blank, text))] if text else []


def spans_of(text: str) -> list[tuple[int, int]]:
    """Start and end of every word of ``words_of``, in code points."""
    return [m.span() for m in WORD.finditer(TAG.sub(_blank, text))]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling. A shorter suffix sorts before its extensions."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(text[order][1:] != text[order][:-1]))) if n else 0
    step = 1
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        step *= 2
    return order


class WaveletTree:
    """Rank of any symbol before any position; one level for every bit, zeros before ones at each level."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = symbols
        for shift in range(self.bits - 1, -1, -1):
            bit = (level >> shift) & 1
            count = np.zeros(len(level) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(level) - int(count[-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``position``, element by element."""
        low, high = np.zeros_like(position), position.copy()
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            ones_low, ones_high = ones[low], ones[high]
            low = np.where(one, zeros + ones_low, low - ones_low)
            high = np.where(one, zeros + ones_high, high - ones_high)
        return high - low


class FMIndex:
    """Counts and locates phrases in a word sequence whose symbols lie in ``[1, size)``."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE) -> None:
        text = np.concatenate((text.astype(np.int64), [0]))  # 0 ends the text and occurs once
        order = suffix_array(text)
        self.last = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.tree = WaveletTree(self.last, size)
        marked = (order % sample == 0) | (order == len(text) - 1)
        self.marked, self.mark_rank = marked, np.concatenate(([0], np.cumsum(marked)))
        self.samples = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of every row of ``phrases``, from its last word to its first."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k]
            start = self.before[symbol]
            low[alive] = start + self.tree.rank(symbol, low[alive])
            high[alive] = start + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking back to the next sampled position."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            hit = self.marked[here]
            done = open_[hit]
            found[done] = self.samples[self.mark_rank[rows[done]]] + steps[done]
            open_ = open_[~hit]
            here = rows[open_]
            symbol = self.last[here]
            rows[open_] = self.before[symbol] + self.tree.rank(symbol, here)
            steps[open_] += 1
        return found


class Phrases:
    """The distinct phrases of the test items over a vocabulary of their words.

    Symbol 0 ends a text, 1 stands for all words that no item has; it also parts documents. The items of a
    phrase lie in one array, in order of the phrases.
    """

    def __init__(self, items: list[tuple[int, list[str]]], length: int = PHRASE) -> None:
        self.length, self.words = length, {}
        rows, owner = [np.zeros((0, length), np.int32)], [np.zeros(0, np.int64)]
        for item, words in items:
            coded = np.array([self.words.setdefault(w, len(self.words) + 2) for w in words], np.int32)
            if len(coded) >= length:
                rows.append(np.lib.stride_tricks.sliding_window_view(coded, length))
                owner.append(np.full(len(coded) - length + 1, item, np.int64))
        self.size = len(self.words) + 2
        self.table, phrase = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack((phrase.reshape(-1), np.concatenate(owner)), axis=1), axis=0)
        self.items = pairs[:, 1]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.table) + 1))

    def owners(self, phrase: int) -> list[int]:
        return self.items[self.starts[phrase] : self.starts[phrase + 1]].tolist()


def search_shard(texts: list[list[str]], phrases: Phrases) -> pd.DataFrame:
    """Every occurrence of a phrase in the shard: document (index into ``texts``), its word, phrase."""
    code, symbols, words, starts, total = phrases.words.get, [], [], [], 0
    for text in texts:
        coded = np.fromiter((code(w, 1) for w in text), np.int64, len(text))
        # A run of words that no item has can't be matched: one symbol stands for it.
        keep = np.ones(len(coded), bool)
        keep[1:] = (coded[1:] != 1) | (coded[:-1] != 1)
        place = np.flatnonzero(keep)
        starts.append(total)
        symbols += [coded[place], [1]]
        words += [place, [-1]]
        total += len(place) + 1
    if not total or not len(phrases.table):
        return pd.DataFrame({"document": [], "word": [], "phrase": []}, dtype=np.int64)
    index = FMIndex(np.concatenate(symbols).astype(np.int64), phrases.size)
    low, high = index.search(phrases.table)
    counts = high - low
    phrase = np.repeat(np.arange(len(counts)), counts)
    rows = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    at = index.locate(rows)
    return pd.DataFrame(
        {"document": np.searchsorted(starts, at, side="right") - 1, "word": np.concatenate(words).astype(np.int64)[at] if len(at) else at, "phrase": phrase}
    )


def _shards(batches: Iterator[pd.DataFrame], id_: str, text: str) -> Iterator[tuple[list, list[str], list[list[str]]]]:
    ids, texts, split, held = [], [], [], 0
    for batch in batches:
        for key, value in zip(batch[id_], batch[text]):
            words = words_of(value)
            if split and held + len(words) > SHARD_WORDS:
                yield ids, texts, split
                ids, texts, split, held = [], [], [], 0
            ids.append(key)
            texts.append(value)
            split.append(words)
            held += len(words) + 1
    if split:
        yield ids, texts, split


def merge_spans(starts: list[int], length: int) -> list[tuple[int, int]]:
    """First and last word of the union of ``[s, s + length)`` over all starts."""
    merged: list[list[int]] = []
    for s in sorted(set(starts)):
        if merged and s <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], s + length - 1)
        else:
            merged.append([s, s + length - 1])
    return [(a, b) for a, b in merged]


def _blocks(items: DataFrame, item_id: str, item_text: str, length: int) -> Iterator[Phrases]:
    """The phrases of the items, a block at a time: no block has many more than ``BLOCK_WORDS`` words."""
    most = max(BLOCK_WORDS // 8, length)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch[item_id], batch[item_text]):
                words = words_of(text)
                for start in range(0, len(words) - length + 1, most):
                    piece = words[start : start + most + length - 1]
                    rows.append((item, start, piece, len(piece)))
            yield pd.DataFrame(rows, columns=["item", "piece", "words", "n"])

    cut = items.select(item_id, item_text).mapInPandas(pieces, "item long, piece long, words array<string>, n long").distinct()
    blocks = max(1, -(-(cut.agg(F.sum("n").alias("n")).first()["n"] or 0) // BLOCK_WORDS))
    for block in range(blocks):
        own = cut if blocks == 1 else cut.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == block)
        yield Phrases([(r["item"], list(r["words"])) for r in own.select("item", "words").collect()], length)


def find_leaks(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = PHRASE
) -> DataFrame:
    """``(doc_id, item_id)``, once, where the document has ``length`` consecutive words of the item.

    Reads whole texts of all documents; null, empty and blank ones have no words. Repeated rows count
    once. Only the stated query set is broadcast, in blocks of a fixed size; the documents aren't shuffled.
    Other columns of either table are ignored.
    """

    def of_block(phrases: Broadcast) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            owned = phrases.value
            for ids, _, split in _shards(batches, doc_id, text):
                hits = search_shard(split, owned)[["document", "phrase"]].drop_duplicates()
                pairs = {(ids[d], i) for d, p in zip(hits["document"], hits["phrase"]) for i in owned.owners(p)}
                yield pd.DataFrame(sorted(pairs), columns=["doc_id", "item_id"], dtype=np.int64)

        return documents.select(doc_id, text).mapInPandas(search, "doc_id long, item_id long")

    context = documents.sparkSession.sparkContext
    return reduce(DataFrame.unionByName, (of_block(context.broadcast(b)) for b in _blocks(items, item_id, item_text, length))).distinct()


def leaked_spans(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = PHRASE
) -> DataFrame:
    """``(doc_id, start, stop, items)``: merged spans of code points to remove, with the items in them.

    A repeated document row gives its spans once. Spans that blocks of items find are merged by document.
    """

    def of_block(phrases: Broadcast) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            owned = phrases.value
            for ids, texts, split in _shards(batches, doc_id, text):
                rows = []
                for document, hits in search_shard(split, owned).groupby("document"):
                    at = spans_of(texts[document])
                    for first, last in merge_spans(hits["word"].tolist(), owned.length):
                        inside = hits[(hits["word"] >= first) & (hits["word"] + owned.length - 1 <= last)]
                        leaked = sorted({i for p in inside["phrase"] for i in owned.owners(p)})
                        rows.append((ids[document], first, last, at[first][0], at[last][1], leaked))
                yield pd.DataFrame(rows, columns=["doc_id", "first", "last", "start", "stop", "items"])

        schema = "doc_id long, first long, last long, start long, stop long, items array<long>"
        return documents.select(doc_id, text).mapInPandas(search, schema).distinct()

    context = documents.sparkSession.sparkContext
    found = [of_block(context.broadcast(b)) for b in _blocks(items, item_id, item_text, length)]
    columns = ["doc_id", "start", "stop", "items"]
    if len(found) == 1:
        return found[0].select(*columns)
    by_start = Window.partitionBy("doc_id").orderBy("first", "last")
    before = F.max("last").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = reduce(DataFrame.unionByName, found).withColumn("new", F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int"))
    spans = fresh.withColumn("span", F.sum("new").over(by_start)).groupBy("doc_id", "span")
    merged = spans.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select(*columns)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of test items."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return find_leaks(documents, table(spark, sf_dir, "eval_items"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of documents to remove."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leaked_spans(documents, table(spark, sf_dir, "eval_items"))


QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans}
SQL = {
    "p9_found": r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM eval_items WHERE text IS NOT NULL
), phrases AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM items)
), docs AS (
  SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '</?[a-zA-Z!][^<>]*>', ' ', 'g')), '[\p{L}\p{Nd}]+') AS w
  FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs)
)
SELECT DISTINCT doc_id, item_id FROM windows JOIN phrases USING (phrase)
""",
}
