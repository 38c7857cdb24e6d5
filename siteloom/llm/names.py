"""Linking names that people typed to the businesses they denote (problem 5).

Names of one or two rare words meet by whole words: the distinct words of candidates are joined once with those
of businesses that they may be slips of, and names by the words found, with the trade where it is given; a word meets two run together by pieces that
slips leave alone. Other names are joined by set similarity of the letter quadruples of their rare words: quadruples are ordered
by global rarity, and two names can only reach the threshold if the rare beginnings of their sets share
two of them, so pairs of quadruples are the join keys, with the trade where it is given. Each pair of names is then verified by a soft token
similarity in which words may differ by a slip, be joined, swapped, shortened or be nicknames, and rare
words weigh more.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.addresses import abbreviates
from siteloom.llm.places import slips, words_of
from siteloom.session import cut_lineage, spread, table

#: Jaccard similarity of names with their words set alike; words run together lose elements, so half of it is the least
#: similarity of the join, for keys and verification alike. A word in the names of more than a share of the sites is common.
THRESHOLD, COMMON = 0.25, 0.004
LEAST = THRESHOLD / 2
#: Letters of an element of the sets.
LETTERS = 4
#: Most elements of a name that may share just one with another.
MOST_SHORT = 4
#: Names that have an element up to which it is a key by itself; a key's names can't be more. Beyond, two elements are.
FEW = 200
#: Names and pairs a worker remembers; only speed depends on it.
REMEMBERED = 200_000
#: Standard errors by which the sites of a common word exceed that share (p < 0.001), so a few sites make no word common; buckets of the rarity counts.
SURE, BUCKETS = 3.29, 1 << 16
#: Buckets of the keys of names that don't meet by words, and letters of the stems of trades.
KEY_BUCKETS, STEM = 1 << 22, 6
#: Letters of a word up to which what deletions leave of it are its keys; longer ones have pieces.
LONG = 12
#: Words of a name up to which each may be another's trade or not.
MOST_TOLD = 6

#: Legal forms, words between names, endings of words for trades in several languages, given names with their short forms.
LEGAL = frozenset("inc incorporated ltd limited llc llp plc gmbh ag kg ohg ug co company corp corporation sa sas sarl srl sl bv nv ab oy as spa".split())
BETWEEN = frozenset("and und et y e and the n of de of".split())
EXTRAS = frozenset("sohne friends sons bros brothers since".split())
TRADE_ENDINGS = ("ery", "ing", "erei", "erie", "eria")
GIVEN = {
    "robert": "bob bobby rob robbie bert", "josephine": "josie jo fifi", "rebecca": "becky becca", "francisco": "paco pancho francis frank",
    "katherine": "kate kathy katie kat kathie cathy", "richard": "rick dick rich ricky", "alexander": "alex sandy xander sascha", "william": "bill will billy willy liam",
    "theodore": "ted theo teddy", "johanna": "hanna hannah jo joan", "margaret": "maggie peggy meg greta marge", "elizabeth": "liz beth lizzie betty eliza lisa",
    "michael": "mike mick mickey", "anthony": "tony ant", "thomas": "tom tommy", "james": "jim jimmy", "john": "jack johnny", "charles": "charlie chuck",
}
_LONG: dict[str, set[str]] = {}
for _name, _short in GIVEN.items():
    for _s in _short.split():
        _LONG.setdefault(_s, set()).add(_name)


class Name(NamedTuple):
    """A name by kinds of words: ``rare`` ones say who, ``given`` and ``trade`` narrow it down."""

    rare: tuple[str, ...]
    given: tuple[str, ...]
    trade: tuple[str, ...]
    legal: tuple[str, ...]


@lru_cache(8)
def _trades(common: frozenset[str]) -> frozenset[str]:
    """Words that the corpus shows to be shared by many businesses; they say what one does, not who it is."""
    return common - GIVEN.keys() - LEGAL - BETWEEN


@lru_cache(REMEMBERED)
def _trade_like(word: str, common: frozenset[str]) -> bool:
    return word in _trades(common) or word.endswith(TRADE_ENDINGS) and len(word) > 5 or any(_shortens(word, t) for t in _trades(common))


def parse(text: str | None, common: frozenset[str]) -> Name | None:
    """The name, or None where nothing says who it is. Abbreviated trades and given names count as such."""
    words = words_of(text) if text else []
    # Spelled-out legal forms like ``S.A.`` and ``G.m.b.H.`` come as single letters.
    merged: list[str] = []
    for w in words:
        if len(w) == 1 and merged and merged[-1].startswith("\0"):
            merged[-1] += w
        else:
            merged.append("\0" + w if len(w) == 1 else w)
    rare, given, trade, legal = [], [], [], []
    for k, w in enumerate(merged):
        if w.startswith("\0"):
            w = w[1:]
            if len(w) == 1 and k + 1 < len(merged) and w not in BETWEEN:
                given.append(w)
            elif len(w) > 1:
                legal.append(w)
            continue
        if w in LEGAL:
            legal.append(w)
        elif w in BETWEEN or w in EXTRAS:
            continue
        elif w in GIVEN or w in _LONG:
            given.append(w)
        elif _trade_like(w, common):
            trade.append(w)
        else:
            rare.append(w)
    if not rare:
        rare, trade = [*trade], []
    return Name(tuple(rare), *(tuple(dict.fromkeys(x)) for x in (given, trade, legal))) if rare else None


#: Slips in all the rare words of a name together, and how often two of them may be run together.
MOST_SLIPS, MOST_JOINS = 3, 2
#: Elements that a matching name can lack: a slip changes up to five, words run together lose three at each of two ends.
MOST_CHANGED = 5 * MOST_SLIPS + 6 * MOST_JOINS


def _allowed(word: str) -> int:
    """Slips that a word of any script may have."""
    return 0 if len(word) < 5 else 1 if len(word) < 7 else 2


def _rare_match(a: tuple[str, ...], b: tuple[str, ...]) -> list[tuple[str, float]] | None:
    """Each rare word of ``b`` with how like it is; None unless all words of both find their match."""
    counts, others = Counter(a), Counter(b)
    found: list[tuple[str, float]] = [(w, 1.0) for w in (counts & others).elements()]
    left, right, spent, joins = list((counts - others).elements()), list((others - counts).elements()), 0, 0
    if max(len(left), len(right)) > MOST_SLIPS + 2 * MOST_JOINS:
        return None
    for most in (1, 2):
        for x in [*left]:
            best = min(((slips(x, y, most), y) for y in right if most <= _allowed(y)), default=None)
            if best and best[0] <= most:
                left.remove(x)
                right.remove(best[1])
                spent += best[0]
                found.append((best[1], 1 - best[0] / max(len(x), len(best[1]))))
    # Words run together, in either order.
    for whole, parts, back in ((left, right, False), (right, left, True)):
        for x in [*whole]:
            for y, z in combinations([*parts], 2):
                apart = min(slips(x, y + z, 2), slips(x, z + y, 2))
                if apart <= min(2, _allowed(y + z)):
                    whole.remove(x)
                    parts.remove(y)
                    parts.remove(z)
                    spent, joins = spent + apart, joins + 1
                    found += [(w, 1 - apart / len(x)) for w in ((x,) if back else (y, z))]
                    break
    return None if left or right or spent > MOST_SLIPS or joins > MOST_JOINS else found


def _given_match(a: tuple[str, ...], b: tuple[str, ...]) -> float | None:
    """How well given names agree; None if they contradict."""
    if not a or not b:
        return 1.0 if not a and not b else 0.4
    total = 0.0
    for x in a:
        long = {x} | _LONG.get(x, set())
        best = 0.0
        for y in b:
            other = {y} | _LONG.get(y, set())
            if x == y:
                best = 1.0
            elif long & other:
                best = max(best, 0.9)
            elif len(x) == 1 and any(o[0] == x for o in other) or len(y) == 1 and any(o[0] == y for o in long):
                best = max(best, 0.7)
            elif len(x) > 4 and slips(x, y, 1) <= 1:
                best = max(best, 0.85)
        if not best:
            return None
        total += best
    return total / len(a)


def _trade_match(a: tuple[str, ...], b: tuple[str, ...]) -> float | None:
    """How well trades agree; a name may leave its trade out, but not have another."""
    if not a or not b:
        return 1.0 if not a and not b else 0.3

    def same(x: str, y: str) -> bool:
        return x == y or len(x) > 2 and abbreviates(x, y) or len(y) > 2 and abbreviates(y, x) or len(x) > 4 and slips(x, y, 1) <= 1

    if not all(any(same(x, y) for y in b) for x in a):
        return None
    back = [any(same(x, y) for x in a) for y in b]
    return 0.5 + 0.5 * sum(back) / len(back)


def _shortens(word: str, trade: str) -> bool:
    return len(word) > 2 and (trade.startswith(word) or len(word) < 5 and abbreviates(word, trade))


def _told(a: Name, b: Name) -> Name:
    """``a`` with those of its words taken for trades that shorten one of ``b``'s trades, unless none would be left."""
    moved = [w for w in a.rare if any(_shortens(w, t) for t in b.trade)]
    if not moved or len(moved) == len(a.rare):
        return a
    return a._replace(rare=tuple(w for w in a.rare if w not in moved), trade=(*a.trade, *moved))


def similarity(a: Name, b: Name, weight: object) -> float:
    """Soft token similarity in [0, 1]; 0 for names of different businesses.

    ``weight(word)`` is larger for rarer words. Given names, trade and legal form count as one word each.
    """
    a, b = _told(a, b), _told(b, a)
    given = _given_match(a.given, b.given)
    trade = None if given is None else _trade_match(a.trade, b.trade)
    rare = None if trade is None else _rare_match(a.rare, b.rare)
    if rare is None:
        return 0.0
    legal = 1.0 if set(a.legal) == set(b.legal) else 0.6 if not a.legal or not b.legal else 0.3
    parts = [(weight(w), s) for w, s in rare] + [(3.0, given), (3.0, trade), (0.5, legal)]
    return sum(w * s for w, s in parts) / sum(w for w, _ in parts)


def elements_of(words: tuple[str, ...]) -> frozenset[str]:
    """Letter quadruples of words with their ends."""
    return frozenset(p[i : i + LETTERS] for p in (f"^{w}$" for w in words) for i in range(max(1, len(p) - LETTERS + 1)))


def letters_of(name: Name) -> tuple[str, int]:
    """The letters of the rare words in order, and by how many of them a match may differ; -1: only all slips limit it."""
    whole = "".join(sorted("".join(name.rare)))
    return whole, 2 * _allowed(name.rare[0]) if len(name.rare) == 1 else -1


def _code(*parts: str) -> int:
    text = "\0".join(parts).encode("utf-8")
    return (zlib.crc32(text) << 31) ^ zlib.crc32(text, 0x5BD1E995)


def _run_together(words: tuple[str, ...]) -> set[str]:
    """The letters in order, as words may be run together; without one that a slip can cost two words of five letters in all."""
    whole = "".join(sorted("".join(words)))
    joined = [y + z for y, z in combinations(words, 2) if _allowed(y + z) and len(y + z) == 5]
    return {whole} | {whole.replace(c, "", 1) for w in joined for c in w}


def keys_of(name: Name, rarity: np.ndarray, common: frozenset[str], known: bool) -> list[int]:
    """Join keys of a name. Names that are as similar as the threshold and don't differ in trade share one.

    The rarest element that two long names share is a key by itself if few names have it; else the second is no rarer,
    and both are among the frequent elements of either rare beginning, of which each pair makes a key. Where nothing was
    counted no element is known to be rare. Between names whose words allow no slip their letters are keys. Names of different kinds, and short ones, meet by single elements; these
    keys have the kinds of both, so long names don't meet by them.
    A business's name has keys with each word of its trade and without; a candidate's with its trade, if
    it gives one.
    """
    return [b ^ t for b in bases_of(name, rarity, known) for t in _trade_keys(name, common, known)]


def bases_of(name: Name, rarity: np.ndarray, known: bool) -> list[int]:
    """The keys of ``keys_of`` without the trade."""
    held = elements_of(name.rare)
    size = len(held)
    # Besides the threshold, no match lacks more than a few elements, so long names have a short beginning, too.
    shared = max(math.ceil(LEAST * size), size - MOST_CHANGED)

    def counted(element: str) -> int:
        return int(rarity[zlib.crc32(element.encode()) % BUCKETS])

    ordered = sorted(held, key=lambda t: (counted(t), t))
    kind = "whole" if all(_allowed(w) == 0 for w in name.rare) else "short" if size <= MOST_SHORT else "long"
    bases: list[int] = []
    for other in ("whole", "short", "long"):
        if kind == other == "whole":
            bases += [_code(letters) for letters in _run_together(name.rare)]
        elif kind == other == "long":
            # Elements come in order of their counts, so those that few names have are the first.
            few = sum(counted(t) <= FEW for t in ordered) if counted(ordered[-1]) else 0
            bases += [_code("long", t) for t in ordered[: min(few, size - shared + 1)]]
            bases += [_code(*sorted(pair)) for pair in combinations(ordered[few : size - shared + 2], 2)]
        # A short name is similar to none of more than its elements over the threshold.
        elif {kind, other} != {"short", "long"} or size <= MOST_SHORT / LEAST:
            kinds = (kind, other) if known else (other, kind)
            bases += [_code(*kinds, t) for t in ordered[: size - math.ceil(LEAST * size) + 1]]
    return bases


@lru_cache(REMEMBERED)
def _full(word: str, common: frozenset[str]) -> tuple[str, ...]:
    """Words of trades that ``word`` is or abbreviates."""
    trades = _trades(common)
    return tuple(t for t in trades if t.startswith(word) or word not in trades and len(word) < 5 and abbreviates(word, t)) or (word,)


def _trade_keys(name: Name, common: frozenset[str], known: bool) -> list[int]:
    trades = sorted({t for w in name.trade[: None if known else 1] for t in _full(w, common)})
    if known:
        trades.append("")
    return [_code("trade", t) for t in (trades or [""])]


def stems_of(word: str) -> list[str]:
    """Beginnings of a word that is a trade by its ending; words that may shorten it have one of them."""
    return [word[:n] for n in (1, *range(3, STEM + 1))] if len(word) > 5 and word.endswith(TRADE_ENDINGS) else []


def forms_of(name: Name, common: frozenset[str], stems: frozenset[str]) -> list[tuple[str, ...]]:
    """The rare words of a name, and those left where others are taken for another name's trade; none if the name is too long to say."""
    told = [w for w in dict.fromkeys(name.rare) if _trade_like(w, common) or len(w) > 2 and (w[:STEM] in stems or len(w) < 5 and w[0] in stems)]
    if told and len(name.rare) > MOST_TOLD:
        return []
    kept = (tuple(w for w in name.rare if w not in moved) for n in range(len(told) + 1) for moved in combinations(told, n))
    return list(dict.fromkeys(tuple(sorted(x)) for x in kept if x))


def deletions(word: str, most: int) -> set[str]:
    """A word without up to ``most`` of its letters; words as many slips apart share one."""
    found = {word}
    for _ in range(most):
        found |= {w[:i] + w[i + 1 :] for w in found for i in range(len(w))}
    return found


@lru_cache(1024)
def _pieces(length: int) -> tuple[int, tuple[tuple[int, int], ...]]:
    """Slips that a text of some length may have, and one more pieces of it; a letter lies between any two, so a slip changes one at most."""
    most = _allowed(" " * length)
    bounds = [(length - most) * k // (most + 1) for k in range(most + 2)]
    return most, tuple((a + k, b + k) for k, (a, b) in enumerate(zip(bounds, bounds[1:])))


@lru_cache(1024)
def _salts(length: int, start: int) -> tuple[int, int]:
    return zlib.crc32(f"{length} {start}".encode()), zlib.crc32(f"{start} {length}".encode())


def _piece(letters: bytes, salts: tuple[int, int]) -> int:
    return (zlib.crc32(letters, salts[0]) << 31) ^ zlib.crc32(letters, salts[1])


@lru_cache(REMEMBERED)
def piece_keys(text: str) -> np.ndarray:
    letters, length = text.encode("utf-32-le"), len(text)
    return np.array([_piece(letters[4 * a : 4 * b], _salts(length, a)) for a, b in _pieces(length)[1]], np.int64)


@lru_cache(REMEMBERED)
def probe_keys(word: str, least: int = 2) -> np.ndarray:
    """Keys of a word, one of which each text of ``least`` or more letters has that it may be a misspelling of."""
    found, letters, size = [], word.encode("utf-32-le"), len(word)
    for length in range(max(least, size - 2), size + 3):
        most, pieces = _pieces(length)
        longer = size - length
        for a, b in pieces:
            salts = _salts(length, a)
            for moved in range(-most, most + 1):
                if abs(moved) + abs(longer - moved) <= most and a + moved >= 0 and b + moved <= size:
                    found.append(_piece(letters[4 * (a + moved) : 4 * (b + moved)], salts))
    return np.array(found, np.int64)


def word_keys(word: str, known: bool) -> list[int]:
    """Keys that a word of a business shares with each that may be it by slips: what deletions leave, or pieces of long words."""
    if known:
        return [_code(t) for t in deletions(word, _allowed(word))] if len(word) <= LONG else [*piece_keys(word)]
    # The slips that any word of businesses allows whose length can become this one.
    most = max(m for n in range(3) if (m := _allowed(word + " " * n)) >= n or not n)
    short = [_code(t) for t in deletions(word, most)] if len(word) <= LONG + 2 else []
    return [*short, *probe_keys(word, LONG + 1)]


def _together(words: tuple[str, ...]) -> set[str]:
    return {t for x, y in combinations(words, 2) for t in (x + y, y + x)}


@lru_cache(4)
def _whole(size: int, known: bool) -> int:
    return _code(str(size), "known" if known else "typed")


def joined_keys(form: tuple[str, ...], known: bool) -> np.ndarray:
    """Keys of which one word shares one with two that were run together to it, in either order, and a word of two with two of three or four."""
    bases = [np.zeros(0, np.int64)]
    for size in (1, 2):
        # The side that has the whole word; those with more words have any two of them run together.
        if len(form) == size:
            bases += [probe_keys(w) ^ _whole(size, known) for w in form]
        elif size == 1 and len(form) == 2 or size == 2 and len(form) in (3, 4):
            bases += [piece_keys(t) ^ _whole(size, not known) for t in _together(form)]
    return np.concatenate(bases)


def _near_words(typed: DataFrame, known: DataFrame) -> DataFrame:
    """``(x, y)``: each word typed with the words of businesses that it may be, itself among them."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([a == b or slips(a, b, 2) <= _allowed(b) for a, b in zip(x, y)], dtype=bool)

    def keyed(words: DataFrame, name: str, known: bool) -> DataFrame:
        @F.pandas_udf("array<long>")
        def keys(values: pd.Series) -> pd.Series:
            return values.map(lambda w: word_keys(w, known))

        return spread(words).withColumn("keys", keys.asNondeterministic()("w")).select(F.col("w").alias(name), F.explode("keys").alias("key"))

    pairs = keyed(typed, "x", False).join(keyed(known, "y", True).hint("merge"), "key").select("x", "y").distinct()
    return cut_lineage(pairs.filter("x = y OR levenshtein(x, y, 4) >= 0").filter(near("x", "y")))


def site_of(website: Column) -> Column:
    """Registrable domain of a website in any spelling: the last two labels of its host, lower case."""
    host = F.regexp_extract(F.lower(F.trim(website)), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#\s]+)", 1)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).when(F.size(labels) == 1, labels.getItem(0))


def _common_words(names: DataFrame, own: DataFrame) -> tuple[frozenset[str], np.ndarray, int, frozenset[str]]:
    """Words in the names of a large share of sites, rarity of set elements by bucket, number of names, stems of trades.

    A word counts once for each site, so the many spellings of one business make none of its words common.
    By their share, the common words are at most a few thousand, however many names there are.
    """

    def of_sites(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(s, w) for s, name in zip(batch["site"], batch["name"]) for w in set(words_of(name))], columns=["site", "word"])

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        element_counts, stems = np.zeros(BUCKETS, np.int64), set()
        for batch in batches:
            for name in batch["name"]:
                for w in set(words_of(name)):
                    stems.update(stems_of(w))
                    for e in elements_of((w,)):
                        element_counts[zlib.crc32(e.encode()) % BUCKETS] += 1
        at = np.flatnonzero(element_counts)
        yield pd.DataFrame({"at": [*at, *[-1] * len(stems)], "stem": [*[""] * len(at), *stems], "n": [*element_counts[at], *[0] * len(stems)]})

    total = names.count()
    least = COMMON * own.select("site").distinct().count()
    sites = own.select("site", "name").mapInPandas(of_sites, "site string, word string").distinct().groupBy("word").agg(F.count("*").alias("n"))
    common = frozenset(r["word"] for r in sites.filter(F.col("n") - SURE * F.sqrt("n") >= least).collect())
    rarity = np.zeros(BUCKETS, np.int64)
    rows = names.mapInPandas(elements, "at long, stem string, n long").groupBy("at", "stem").agg(F.sum("n").alias("n")).toPandas()
    counts = rows[rows["at"] >= 0]
    rarity[counts["at"].to_numpy(np.int64)] = counts["n"]
    return common, rarity, total, frozenset(rows["stem"]) - {""}


def link_names(leads: DataFrame, candidates: DataFrame, *, website: str = "website", name: str = "business_name", candidate_id: str = "candidate_id", candidate: str = "name") -> DataFrame:
    """``(site, candidate_id, similarity)`` for every candidate whose name denotes a site's business.

    Of several sites the most similar are kept. Null and blank names, and leads without a website, link to
    nothing; repeated rows do once. Names are reduced to distinct ones before any join, so a site or name
    that holds most rows costs one row.
    """
    own = leads.select(site_of(F.col(website)).alias("site"), F.col(name).alias("name")).filter("site IS NOT NULL AND length(trim(name)) > 0").distinct()
    others = candidates.select(F.col(candidate_id).alias("candidate_id"), F.col(candidate).alias("name")).filter("length(trim(name)) > 0")
    names = cut_lineage(own.select("name", F.lit(True).alias("known")).unionByName(others.select("name", F.lit(False).alias("known"))).distinct())
    common, rarity, total, stems = _common_words(names.select("name").distinct(), own)
    shared = names.sparkSession.sparkContext.broadcast((common, rarity, stems))

    @F.pandas_udf("forms array<struct<w1: string, w2: string>>, keys array<long>, letters string, most int, trades array<long>, hard boolean")
    def prepared(values: pd.Series, known: pd.Series) -> pd.DataFrame:
        held, counts, stems = shared.value
        rows = []
        for v, k in zip(values, known):
            p, k = parse(v, held), bool(k)
            if not p:
                rows.append(([], [], "", 0, [], False))
                continue
            forms, trades = forms_of(p, held, stems), _trade_keys(p, held, k)
            keys = {x for f in forms if len(f) != 2 for x in joined_keys(f, k).tolist()}
            if not forms or len(p.rare) > 2:
                keys.update(bases_of(p, counts, k))
            words = [{"w1": f[0], "w2": f[1] if len(f) == 2 else None} for f in forms if len(f) <= 2]
            rows.append((words, sorted(keys), *letters_of(p), trades, not forms))
        return pd.DataFrame(rows, columns=["forms", "keys", "letters", "most", "trades", "hard"], index=values.index)

    named = spread(names).withColumn("id", F.xxhash64("name"))
    # Functions are marked so that filters on their results don't run them once more below.
    parsed = cut_lineage(named.withColumn("p", prepared.asNondeterministic()("name", "known")).select("id", "name", "known", "p.*").filter("size(forms) > 0 OR size(keys) > 0"))
    keyed = parsed.select("known", F.explode("keys").alias("key"))
    buckets: dict[bool, np.ndarray] = {side: np.zeros(KEY_BUCKETS, bool) for side in (False, True)}
    at = keyed.select("known", F.pmod("key", F.lit(KEY_BUCKETS)).cast("int").alias("at")).distinct().groupBy("known").agg(F.collect_list("at").alias("at"))
    for r in at.toPandas().itertuples():
        buckets[r.known][np.asarray(r.at, np.int64)] = True
    hard = {r.known: r.hard for r in parsed.groupBy("known").agg(F.max("hard").alias("hard")).collect()}
    whole = {(size, side): _whole(size, side) for size in (1, 2) for side in (False, True)}
    other_keys = names.sparkSession.sparkContext.broadcast(buckets)

    def held_by_others(keys: np.ndarray, known: bool) -> np.ndarray:
        return np.unique(keys[other_keys.value[not known][keys % KEY_BUCKETS]])

    @F.pandas_udf("array<long>")
    def of_two(first: pd.Series, second: pd.Series, known: pd.Series) -> pd.Series:
        held, sides = other_keys.value, known.to_numpy(bool)
        parts = [x for a, b in zip(first, second) for x in (probe_keys(a), probe_keys(b), piece_keys(a + b), piece_keys(b + a))]
        sizes = np.array([len(x) for x in parts], np.int64).reshape(-1, 4)
        # The word is the whole on its own side, and its pieces lie on the other's.
        which = np.where(sides[:, None], [[whole[2, True], whole[2, True], whole[1, False], whole[1, False]]], [[whole[2, False], whole[2, False], whole[1, True], whole[1, True]]])
        keys = np.concatenate(parts) ^ np.repeat(which.ravel(), sizes.ravel())
        rows = np.repeat(np.arange(len(first)), sizes.sum(1))
        kept = np.where(np.repeat(sides, sizes.sum(1)), held[False][keys % KEY_BUCKETS], held[True][keys % KEY_BUCKETS])
        return pd.Series(np.split(keys[kept], np.cumsum(np.bincount(rows[kept], minlength=len(first)))[:-1]), index=first.index, dtype=object)

    @F.pandas_udf("array<long>")
    def of_any(values: pd.Series, known: pd.Series) -> pd.Series:
        held, counts, _ = shared.value
        rows = [held_by_others(np.array(bases_of(p, counts, bool(k)), np.int64), bool(k)) if len((p := parse(v, held)).rare) <= 2 else [] for v, k in zip(values, known)]
        return pd.Series(rows, index=values.index, dtype=object)

    sides = ("id", "letters", "most", "key")
    plain = parsed.select("known", "id", "letters", "most", "trades", F.inline("forms"))
    # Keys of names of two words are kept where the other side has them.
    two_words = plain.filter("w2 IS NOT NULL").withColumn("keys", of_two.asNondeterministic()("w1", "w2", "known"))
    kept = ("known", "id", "letters", "most", "trades", "keys")
    more = parsed.select(*kept).unionByName(two_words.select(*kept))
    for side in (False, True):
        # Names too long for their words meet those of the other side by quadruples.
        if hard.get(side):
            facing = parsed.filter("known" if not side else "NOT known").withColumn("keys", of_any.asNondeterministic()("name", "known"))
            more = more.unionByName(facing.select(*kept))
    more = more.select("known", "id", "letters", "most", "trades", F.explode("keys").alias("key"))
    more = cut_lineage(more.withColumn("trade", F.explode("trades")).select("known", "id", "letters", "most", F.col("key").bitwiseXOR(F.col("trade")).alias("key")))
    plain = plain.withColumn("trade", F.explode("trades")).drop("trades")

    def words(side: str) -> DataFrame:
        rows = plain.filter(side)
        return rows.select(F.col("w1").alias("w")).unionByName(rows.filter("w2 IS NOT NULL").select(F.col("w2").alias("w"))).distinct()

    near_words = _near_words(words("NOT known"), words("known"))
    first, second = near_words.toDF("w1", "y1"), near_words.toDF("w2", "y2")
    one = plain.filter("NOT known").join(first, "w1")
    two = one.filter("w2 IS NOT NULL").join(second, "w2").withColumn("key", F.xxhash64("trade", F.least("y1", "y2"), F.greatest("y1", "y2")))
    one = one.filter("w2 IS NULL").withColumn("key", F.xxhash64("trade", "y1"))
    own_words = plain.filter("known").withColumn("key", F.when(F.isnull("w2"), F.xxhash64("trade", "w1")).otherwise(F.xxhash64("trade", F.least("w1", "w2"), F.greatest("w1", "w2"))))

    known = more.filter("known").select(*sides).unionByName(own_words.select(*sides)).toDF("known_id", "known_letters", "known_most", "key")
    typed = more.filter("NOT known").select(*sides).unionByName(one.select(*sides)).unionByName(two.select(*sides))
    # Names a few slips apart have almost the same letters, so most chance candidates end here, before any Python.
    apart, single = F.levenshtein("letters", "known_letters", 2 * MOST_SLIPS), (F.col("most") >= 0) & (F.col("known_most") >= 0)
    near = (apart >= 0) & (apart <= F.when(single, F.col("known_most")).otherwise(2 * MOST_SLIPS))
    # Many keys come of one name, which estimates of sizes don't see; so no side is broadcast by them.
    ids = typed.join(known.hint("merge"), "key").filter(near).select("id", "known_id").distinct()
    texts, known_texts = named.filter("NOT known").select("id", "name"), named.filter("known").select(F.col("id").alias("known_id"), F.col("name").alias("known_name"))
    pairs = ids.join(texts, "id").join(known_texts, "known_id").select("name", "known_name")

    @F.pandas_udf("double")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held, counts, _ = shared.value
        parsed: dict[str, tuple[Name, frozenset[str]]] = {}
        known_pairs: dict[tuple[str, str], float] = {}

        def of(v: str) -> tuple[Name, frozenset[str]]:
            found = parsed.get(v)
            if found is None:
                if len(parsed) > REMEMBERED:
                    parsed.clear()
                found = parsed[v] = ((n := parse(v, held)), elements_of(n.rare))
            return found

        def weight(word: str) -> float:
            rarest = min(counts[zlib.crc32(e.encode()) % BUCKETS] for e in elements_of((word,)))
            return math.log(2 + total / (1 + rarest))

        def pair(a: str, b: str) -> float:
            found = known_pairs.get((a, b))
            if found is None:
                (x, xs), (y, ys) = of(a), of(b)
                shared_ = len(xs & ys)
                # The exact Jaccard similarity.
                found = similarity(x, y, weight) if shared_ >= LEAST * (len(xs) + len(ys) - shared_) else 0.0
                if len(known_pairs) > REMEMBERED:
                    known_pairs.clear()
                known_pairs[a, b] = found
            return found

        for values, known_values in batches:
            yield pd.Series([pair(a, b) for a, b in zip(values, known_values)], index=values.index, dtype=float)

    scored = cut_lineage(pairs.withColumn("similarity", alike.asNondeterministic()("name", "known_name")).filter("similarity > 0"))
    best = scored.groupBy("name").agg(F.max("similarity").alias("best"))
    kept = scored.join(best, "name").filter(F.col("similarity") >= F.col("best") - 1e-9).select("name", "known_name", "similarity")
    sites = kept.join(own.withColumnRenamed("name", "known_name"), "known_name").select("name", "site", "similarity").distinct()
    return others.join(sites, "name").groupBy("site", "candidate_id").agg(F.max("similarity").alias("similarity"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = spread(table(spark, sf_dir, "page_leads").select("website", "business_name"))
    return link_names(leads, spread(table(spark, sf_dir, "name_candidates").select("candidate_id", "name")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and the sites whose business they name."""
    return _links(spark, sf_dir).select("site", "candidate_id").distinct()


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links with their similarity."""
    return _links(spark, sf_dir)


QUERIES = {"p5_found": p5_found, "p5_links": p5_links}
SQL: dict[str, str] = {}
