"""Finding template residue, filler and error-page text (problem 7).

A regularised logistic model over hashed word n-grams, length and title features is trained on weak
labels: phrases that no author writes, and the response status of the page. It is validated on hosts it
has not seen, then scores every run of words of every value; a value is residue if its best run is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.session import spread, table

#: Bound of the weakly labelled sample of values that the model is fitted on.
SAMPLE = 12_000
#: Values that are tokenised at a time.
CHUNK = 2_000
#: Tokens of the windows: short residue inside a long text shows in a small window only.
WINDOWS = (3, 6, 12)
#: Longest n-gram, hash bits, share of hosts held out, rounds and L2 weight of the fit.
ORDERS, BITS, HELD_OUT, ROUNDS, PENALTY = 4, 18, 0.2, 40, 3e-6

#: Marks of templating languages around a name.
PLACEHOLDERS = (
    r"\{\{[^{}]{1,80}\}\}",
    r"\{%[^{}]{1,80}%\}",
    r"<%[^<>]{1,80}%>",
    r"<\?(?:php|=)[^<>]{1,80}\?>",
    r"[$#]\{[^{}]{1,80}\}",
    r"\{\$[^{}]{1,80}\}",
    r"\{[a-z]+[._][a-z._]+\}",
    r"%%[a-z][\w.]{0,40}%%",
    r"@@[a-z][\w.]{0,40}@@",
    r"(?<!\w)__[a-z][\w.]{0,40}__(?!\w)",
    r"\[\[[^\[\]]{1,80}\]\]",
    r"\[[a-z]+[._][a-z._]{1,40}\]",
    r"\[(?:company|tagline|city|title|name|description|shortcode|placeholder|first name|your [a-z ]+|object object)\]",
)
#: Filler, error pages, notices and editing defaults in the languages of the corpus.
PHRASES = (
    r"lorem ipsum", r"ipsum dolor", r"dolor sit amet", r"consectetur adipiscing", r"sed do eiusmod", r"incididunt ut labore",
    r"(?:\b(?:lorem|ipsum|dolor|dolore|amet|consectetur|adipiscing|elit|eiusmod|tempor|incididunt|labore|magna|aliqua|sed|sit|do|ut|et)\b[\s,.]*){4,}",
    r"\b(?:x{3,}\s+){2,}x{3,}",
    r"\b(?:sample|placeholder|dummy) (?:text|content)\b", r"\b(?:to be )?replaced? (?:before launch|it with your own)", r"\bgoes here\b",
    r"\b(?:insert|enter|add|type|write) (?:your|a|meta|an) (?:short )?(?:tagline|description|text|paragraph|title|meta description)",
    r"\benter meta description", r"\byour (?:description|tagline|text|title) here", r"\bclick here to edit", r"^todo\b", r"\btodo:",
    r"hier beschreibung eingeben", r"توضیحات سایت را اینجا", r"\buntitled(?:[ -](?:\d+|document|page))", r"\bdefault web ?site page",
    r"\btest page for the", r"\bfuture home of", r"\bdomain is parked", r"\bindex of /",
    r"\bjust another wordpress site", r"\bwelcome to wordpress\. this is your first post", r"^(?:null|nan|undefined|array|none|untitled)$",
    r"\bundefined - undefined", r"\baccount has been suspended", r"\bsite is down for", r"\bscheduled maintenance, please",
    r"\b(?:error )?[45]\d\d\s*(?:-|–|:|\()?\s*(?:not found|forbidden|bad gateway|gateway time-?out|internal server error|service (?:temporarily )?unavailable|file or directory|page not found|unauthorized)",
    r"\b(?:page|file|directory) not found", r"\b(?:http|error|erreur|fehler|خطای) [45]\d\d\b", r"\bunknown error from origin",
    r"\bpage does not exist", r"\bpage introuvable", r"\bseite nicht gefunden", r"\bpágina no encontrada", r"یافت نشد", r"دسترسی غیرمجاز",
    r"\berror establishing a database", r"\b(?:fatal error|parse error|warning): u\w+ ", r"\buncaught \w*(?:error|exception)", r"\bundefined variable",
    r"\btraceback \(most recent", r"\baccess denied", r"\bpermission to access this", r"\bsecurity check", r"\bchecking your browser", r"\bjust a moment\.\.\.",
    r"\bverifying (?:that )?you are human", r"\battention required", r"\benable javascript", r"\brequires javascript", r"\bjavascript is (?:disabled|required)",
    r"\bactiver javascript", r"\baktivieren sie javascript", r"جاوااسکریپت را",
)
#: Values of programs, printed in the case that programs use, in place of a sentence.
PRINTED = (r"(?:^|(?<=[.!?]\s))(?:undefined|null|NaN|Array|New Page|TODO)(?=\s|$)",)

_WEAK = re.compile("|".join([*(f"(?i:{p})" for p in (*PLACEHOLDERS, *PHRASES)), *PRINTED]))
_INVISIBLE = re.compile(r"[­​‍-‏⁠﻿]")
_MASK = (1 << BITS) - 1


def _classes() -> np.ndarray:
    """0 white space, 1 letters and marks, 2 digits, 3 others, by code point."""
    kinds = np.full(0x110000, 3, np.uint8)
    for c in range(0x30000):
        k = unicodedata.category(chr(c))
        kinds[c] = 1 if k[0] in "LM" else 2 if k[0] == "N" else 0 if k[0] == "Z" or c in (9, 10, 11, 12, 13) else 3
    return kinds


_CLASS: list[np.ndarray] = []
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def clean(text: str | None) -> str:
    """Text without invisible characters and with compatibility forms resolved."""
    if not text:
        return ""
    return text if text.isascii() else unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))


@dataclass
class Tokens:
    """Hashed n-grams of many values: ``ids[t, n]`` starts at token ``t`` with ``n + 1`` tokens, 0 where it leaves its value."""

    ids: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    offsets: np.ndarray
    bases: np.ndarray


def tokens_of(texts: list[str]) -> Tokens:
    """Tokens of cleaned texts in lower case; each begins and ends with a mark of its own, digits of any number are alike."""
    if not _CLASS:
        _CLASS.append(_classes())
    texts = [t.lower() for t in texts]
    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    bases = np.cumsum(lengths) - lengths
    chars = np.frombuffer("".join(f"\x02{t}\x03" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    kind = _CLASS[0][np.minimum(chars, 0x10FFFF)]
    begins = np.flatnonzero((kind != 0) & ((kind == 3) | (np.concatenate(([0], kind[:-1])) != kind)))
    change = np.flatnonzero((kind == 3) | (np.concatenate(([255], kind[:-1])) != kind))
    place = np.searchsorted(change, begins)
    ends = np.concatenate((change, [len(chars)]))[place + 1]
    inside = np.arange(len(chars)) - np.repeat(change, np.diff(np.concatenate((change, [len(chars)]))))
    with np.errstate(over="ignore"):
        value = np.where(kind == 2, np.uint64(48), chars.astype(np.uint64)) * _POWERS[np.minimum(inside, 63)]
        value[(kind == 2) & (inside > 0)] = 0
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
        word = total[ends] - total[begins]
        word ^= word >> np.uint64(31)
        owner = np.searchsorted(bases, begins, side="right") - 1
        starts = np.searchsorted(owner, np.arange(len(texts)))
        stops = np.searchsorted(owner, np.arange(len(texts)), side="right")
        ids = np.zeros((len(begins), ORDERS), np.int32)
        left = np.repeat(stops, stops - starts) - np.arange(len(begins))
        mixed = np.zeros(len(begins), np.uint64)
        for n in range(ORDERS):
            shifted = np.concatenate((word[n:], np.zeros(min(n, len(word)), np.uint64)))
            mixed = (mixed * np.uint64(0xD6E8FEB86659FD93)) ^ (shifted + np.uint64(n + 1)) * np.uint64(0xCA5A826395121157)
            ids[:, n] = np.where(left > n, ((mixed >> np.uint64(40)) & np.uint64(_MASK)).astype(np.int32) | 1, 0)
    return Tokens(ids, starts, stops, begins, bases)


@dataclass
class ResidueModel:
    """Weights by hash, and the extra features: the bias by length class of the value and kind of field."""

    weights: np.ndarray
    extra: np.ndarray
    threshold: float = 0.0
    validation: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: list[str], title: bool) -> np.ndarray:
        """Best window score of every cleaned text; minus infinity for blank ones."""
        if len(texts) > CHUNK:
            return np.concatenate([self.scores(texts[i : i + CHUNK], title) for i in range(0, len(texts), CHUNK)])
        if not texts:
            return np.zeros(0)
        t = tokens_of(texts)
        own = np.concatenate(([0.0], np.cumsum(self.weights[t.ids].sum(axis=1, dtype=np.float64))))
        count = t.stops - t.starts
        best = np.full(len(texts), -np.inf)
        for size in WINDOWS:
            windows = np.maximum(count - size, 0) + 1
            begin = np.cumsum(windows) - windows
            first = np.repeat(t.starts - begin, windows) + np.arange(windows.sum())
            last = np.minimum(first + size, np.repeat(t.stops, windows))
            found = np.maximum.reduceat(own[last] - own[first], begin)
            best = np.maximum(best, found + self.extra[_extra(np.minimum(count, size), count, np.full(len(texts), title))])
        best[count <= 2] = -np.inf
        return best


#: Distinct values of ``_extra``.
EXTRAS = 128


def _extra(size: np.ndarray, count: np.ndarray, title: np.ndarray) -> np.ndarray:
    """One feature for length of the window, length class of the value and kind of field."""
    length = np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), 7)
    return (np.searchsorted(WINDOWS, size) * 8 + length) * 2 + title.astype(np.int64)


def _windows(texts: list[str], title: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Training windows: hashed features, extra feature, weak label and value of each.

    A window that holds a whole weak phrase, or lies in one that is longer than any window, is positive;
    one that only touches a phrase is left out. Those of a short value whose page answered with an error
    are positive too.
    """
    if len(texts) > CHUNK:
        parts = [_windows(texts[i : i + CHUNK], title[i : i + CHUNK], bad[i : i + CHUNK]) for i in range(0, len(texts), CHUNK)]
        owner = np.concatenate([p[3] + i * CHUNK for i, p in enumerate(parts)])
        return (*(np.concatenate([p[k] for p in parts]) for k in range(3)), owner)
    t = tokens_of(texts)
    rows, labels, owners = [], [], []
    for v, text in enumerate(texts):
        start, stop = int(t.starts[v]), int(t.stops[v])
        if stop - start <= 2:
            continue
        spans = [m.span() for m in _WEAK.finditer(text) if m.end() > m.start()]
        at = t.offsets[start:stop] - t.bases[v] - 1
        hits = [(int(np.searchsorted(at, a)), int(np.searchsorted(at, b - 1, side="right"))) for a, b in spans]
        for size in WINDOWS:
            for w in range(0, max(stop - start - size, 0) + 1, 1 if hits else size):
                end = min(w + size, stop - start)
                whole = any(a >= w and b <= end or a <= w and b >= end and size == WINDOWS[-1] for a, b in hits)
                if not whole and any(a < end and b > w for a, b in hits):
                    continue
                rows.append((start + w, start + end))
                labels.append(1.0 if whole or (bad[v] and stop - start <= 2 * WINDOWS[-1]) else 0.0)
                owners.append(v)
    spans_, owner = np.array(rows, np.int64).reshape(-1, 2), np.array(owners, np.int64)
    place = spans_[:, :1] + np.arange(WINDOWS[-1])
    ids = np.where((place < spans_[:, 1:])[:, :, None], t.ids[np.minimum(place, max(len(t.ids) - 1, 0))], np.int32(0)).reshape(len(spans_), WINDOWS[-1] * ORDERS)
    return ids, _extra(spans_[:, 1] - spans_[:, 0], (t.stops - t.starts)[owner], title[owner]), np.array(labels), owner


def _solve(ids: np.ndarray, extra: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L2-regularised logistic regression by AdaGrad over the whole sample; index 0 stays 0."""
    weights, bias = np.zeros(1 << BITS), np.zeros(EXTRAS)
    sums, bias_sums = np.full(1 << BITS, 1e-8), np.full(EXTRAS, 1e-8)
    balance = np.where(labels > 0, max(1.0, 0.2 * len(labels) / max(1.0, labels.sum())), 1.0) / max(1, len(labels))
    # Only hashes that occur are updated.
    used, inverse = np.unique(ids, return_inverse=True)
    inverse = inverse.reshape(ids.shape).astype(np.int32)
    local, local_sums = np.zeros(len(used)), sums[used]
    for _ in range(ROUNDS):
        margin = local[inverse].sum(axis=1) + bias[extra]
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) * balance
        gradient = np.bincount(inverse.ravel(), np.repeat(error, ids.shape[1]), minlength=len(used)) + PENALTY * local
        local_sums += gradient**2
        local -= 0.5 * gradient / np.sqrt(local_sums)
        local[used == 0] = 0
        step = np.bincount(extra, error, minlength=EXTRAS) + PENALTY * bias
        bias_sums += step**2
        bias -= 0.5 * step / np.sqrt(bias_sums)
    weights[used] = local
    return weights.astype(np.float32), bias


def fit(sample: pd.DataFrame) -> ResidueModel:
    """Train on weakly labelled values (``text``, ``title``, ``host``, ``bad``) and choose the threshold on unseen hosts."""
    texts = [clean(t) for t in sample["text"]]
    title, bad = sample["title"].to_numpy(bool), sample["bad"].to_numpy(bool)
    unseen = (pd.util.hash_array(sample["host"].fillna("").to_numpy(object)) % 1000 < 1000 * HELD_OUT) if len(sample) else np.zeros(0, bool)
    ids, extra, labels, owner = _windows(texts, title, bad)
    model = ResidueModel(*_solve(ids[~unseen[owner]], extra[~unseen[owner]], labels[~unseen[owner]]))
    truth = np.array([bool(_WEAK.search(t)) for t in texts], bool)
    scores = np.empty(len(texts))
    for kind in (False, True):
        scores[title == kind] = model.scores([t for t, k in zip(texts, title) if k == kind], kind)
    held = unseen & np.isfinite(scores)
    order = np.argsort(-scores[held])
    hit, value = np.cumsum(truth[held][order]), scores[held][order]
    if len(hit) and hit[-1]:
        f1 = 2 * hit / (np.arange(1, len(hit) + 1) + hit[-1])
        best = int(np.argmax(f1))
        model.threshold = float((value[best] + value[min(best + 1, len(value) - 1)]) / 2)
        model.validation = {"values": len(hit), "precision": float(hit[best] / (best + 1)), "recall": float(hit[best] / hit[-1])}
    else:
        model.threshold = float("inf")
    return model


def host_of(url: Column) -> Column:
    """Host of an absolute or bare address, lower case, without ``www.``."""
    return F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z]+:)?(?://)?(?:www\.)?([^/:?#\s]+)", 1)


def training_sample(values: DataFrame, *, size: int = SAMPLE) -> pd.DataFrame:
    """A bounded sample of ``values`` (``text``, ``title``, ``host``, ``bad``), even over hash order, not file order."""
    kept = values.filter(F.length(F.trim("text")) > 0).withColumn("_order", F.xxhash64("text", "host"))
    # A share by hash first, so that not every partition sends a whole sample to the driver.
    share = min(1.0, 1.3 * size / max(1, kept.count()))
    kept = kept.filter(F.pmod("_order", F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    return kept.orderBy("_order", "text", "title", "bad", "host").limit(size).drop("_order").toPandas()


def residue_score(model: object, *, title: bool):
    """A column function: whether a value holds residue, by the broadcast ``model``; null and blank values don't."""

    @F.pandas_udf("boolean")
    def residue(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = model.value
        for values in batches:
            yield pd.Series(held.scores([clean(t) for t in values], title) > held.threshold, index=values.index)

    return residue


def values_of_pages(metadata: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Titles and descriptions of pages with host and whether the page answered with an error."""
    rows = metadata.select(
        F.col("page_id"),
        host_of(F.coalesce("canonical_url", "og_url", "favicon_url")).alias("host"),
        F.explode(F.array(F.struct(F.col("title").alias("text"), F.lit(True).alias("title")), F.struct(F.col("description").alias("text"), F.lit(False).alias("title")))).alias("v"),
    ).select("page_id", "host", "v.*")
    if pages is None:
        return rows.withColumn("bad", F.lit(False)).drop("page_id")
    failed = pages.filter(F.col("http_status") >= 400).select(F.col("id").alias("page_id"), F.lit(True).alias("_failed")).distinct()
    return rows.join(failed, "page_id", "left").select("text", "title", "host", F.coalesce("_failed", F.lit(False)).alias("bad"))


def values_of_leads(leads: DataFrame) -> DataFrame:
    """Descriptions of leads with host."""
    return leads.select(F.col("description").alias("text"), F.lit(False).alias("title"), host_of(F.col("website")).alias("host"), F.lit(False).alias("bad"))


def train(metadata: DataFrame, leads: DataFrame, pages: DataFrame | None = None) -> ResidueModel:
    """The model of a corpus: a bounded sample of its pages' and leads' values, with the status of the pages."""
    both = values_of_pages(metadata, pages).select("text", "title", "host", "bad").unionByName(values_of_leads(leads))
    return fit(training_sample(both))


def find_residue(df: DataFrame, fields: dict[str, bool], model: ResidueModel, *, row_id: str, name: str) -> DataFrame:
    """``(table_name, row_id, field_name)`` of every value of ``df`` that holds residue.

    ``fields`` maps a column to whether it is a title. Whole values of all rows; repeated rows count once.
    One pass without a shuffle except for the small result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    flags = [F.when(residue_score(shared, title=title)(F.col(c)), F.lit(c)) for c, title in fields.items()]
    flagged = df.select(F.col(row_id).alias("row_id"), F.array(*flags).alias("_found"))
    found = flagged.select(F.lit(name).alias("table_name"), "row_id", F.explode("_found").alias("field_name"))
    return found.filter(F.col("field_name").isNotNull()).distinct()


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "website_metadata"), table(spark, sf_dir, "page_leads"), table(spark, sf_dir, "crawl_pages")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of pages and leads with residue instead of content."""
    metadata, leads, pages = _inputs(spark, sf_dir)
    model = train(metadata, leads, pages)
    of_pages = find_residue(spread(metadata.select("metadata_id", "title", "description")), {"title": True, "description": False}, model, row_id="metadata_id", name="website_metadata")
    of_leads = find_residue(spread(leads.select("lead_id", "description")), {"description": False}, model, row_id="lead_id", name="page_leads")
    return of_pages.unionByName(of_leads)


def p7_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with residue excluded: a value that holds some is null."""
    metadata, leads, pages = _inputs(spark, sf_dir)
    shared = spark.sparkContext.broadcast(train(metadata, leads, pages))
    rows = spread(metadata.select("metadata_id", "title", "description"))
    kept = {c: F.when(~residue_score(shared, title=c == "title")(F.col(c)), F.col(c)) for c in ("title", "description")}
    return rows.select("metadata_id", *(v.alias(c) for c, v in kept.items())).distinct()


QUERIES = {"p7_found": p7_found, "p7_content": p7_content}
SQL: dict[str, str] = {}
