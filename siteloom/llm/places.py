"""Mapping freely entered places to the entries of a reference list (problem 3).

A prefix-filter set-similarity join: a value and an entry are sets of letter pairs; pairs are ordered by
their rarity over all values and entries, only the rare beginnings are looked up, length and position
bound what can still reach the threshold, and the Jaccard similarity of what is left is computed exactly.
Verified then is that the entry reads like the value but for a slip of the pen, or that the value is its own
word ("Karvel" for "North Karvel") and no other entry's. Codes are entries as well, which allow no slip.

A long reference is worked off in blocks. What a block finds is ranked the same way within and between blocks,
so their number changes no result.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.forms import unify
from siteloom.session import cut_lineage, spread, table

#: Least Jaccard similarity of the join.
THRESHOLD = 0.35
#: Entries of the reference that are broadcast at once; a longer list is worked off in blocks of that size.
BLOCK = 100_000
#: Buckets of the rarity counts; values a worker remembers (only speed depends on it).
BUCKETS, REMEMBERED = 1 << 16, 200_000
KINDS = ("country", "region", "city")
#: Most letters of a code that is written with signs between them.
CODE_LETTERS = 4

#: Abbreviations of words in names, words around names that aren't part of them, letters without a decomposition.
ABBREVIATIONS = {
    "n": "north", "s": "south", "e": "east", "w": "west", "upr": "upper", "lwr": "lower", "prov": "province", "co": "county", "cnty": "county",
    "pt": "port", "prt": "port", "nw": "new", "st": "saint", "ste": "saint", "mt": "mount", "mnt": "mount", "b": "bay", "ft": "fort", "gt": "great",
}
AROUND = frozenset("the of republic kingdom federation eu region state city town greater near centre center central nord sud area district downtown metro de la".split())
LETTERS = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
TITLES = frozenset(("province", "county"))
GENERIC = frozenset("north south east west upper lower province county port new saint mount bay fort great".split())

_WORDS = re.compile(r"[^\W_]+")
_PARTS = re.compile(r"[,/;()|\n\t]+|\s-\s")


def words_of(text: str) -> list[str]:
    """Lower-case words without accents or numbers; letters spelled out one by one are one word."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKD", unify(text)).casefold().translate(LETTERS)
        text = "".join([c for c in text if not unicodedata.combining(c)])
    words = _WORDS.findall(text)
    if len(words) > 2 and all(len(w) == 1 for w in words):
        return ["".join(words)]
    return [w for w in words if w.isalpha() or not any(c.isdigit() for c in w)]


def pairs_of(words: list[str]) -> frozenset[str]:
    """Adjacent letters of each word with its ends; a pair that comes again counts as another."""
    found, seen = [], {}
    for w in words:
        padded = f"^{w}$"
        for a, b in zip(padded, padded[1:]):
            n = seen[a + b] = seen.get(a + b, 0) + 1
            found.append(a + b if n == 1 else f"{a}{b}{n}")
    return frozenset(found)


def variants_of(value: str) -> list[list[str]]:
    """What a value may mean: as it is with abbreviations written out, its parts, and those without words around a name."""
    found: list[list[str]] = []

    def add(words: list[str]) -> None:
        if words and words not in found:
            found.append(words)

    letters = words_of(re.sub(r"[\W_]", "", value))
    for text in (value, *_PARTS.split(value)):
        words = words_of(text)
        add(words)
        whole = [ABBREVIATIONS.get(w, w) for w in words]
        add(whole)
        add([w for w in whole if w not in AROUND])
        if whole and whole[0] in TITLES:
            add(whole[1:])
    if len(letters) == 1 and len(letters[0]) <= CODE_LETTERS and len(value.strip()) <= 2 * len(letters[0]) + 1:
        add(letters)  # a code, perhaps with dots or blanks
    return found


def slips(a: str, b: str, most: int) -> int:
    """Letters to insert, drop, replace or swap with a neighbour to make ``b`` of ``a``; ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        older, old = old, row
    return min(old[-1], most + 1)


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8")) % BUCKETS


@dataclass(frozen=True)
class Entry:
    """A name of places, or a code of theirs; several places may share one."""

    ids: tuple[int, ...]
    words: tuple[str, ...]
    pairs: frozenset[str]
    is_code: bool

    @property
    def core(self) -> str:
        """The words that aren't found in many names; empty if there are no others."""
        own = [w for w in self.words if w not in GENERIC]
        return " ".join(own) if len(own) < len(self.words) and not self.is_code else ""


class Found(NamedTuple):
    """An entry that a value may mean. Smaller is better: slips, dissimilarity, place of the variant, then ids.

    ``owners`` counts the entries whose own word the value is: 0 if it was found by its spelling.
    """

    apart: int
    unlike: float
    variant: int
    ids: tuple[int, ...]
    owners: int = 0


def tied(found: list[Found]) -> Found | None:
    """The best, with the ids of all that are as good."""
    best = min(found, default=None)
    return best and best._replace(ids=tuple(sorted({i for f in found if f[:3] == best[:3] for i in f.ids})))


def best_of(found: Iterable[Found]) -> tuple[tuple[int, ...], float]:
    """Ids and similarity of what is best by spelling, ties together; else of the only owner of the value as a word; none
    and 0 without."""
    held = sorted(found)
    spelled = tied([f for f in held if not f.owners])
    if spelled:
        return spelled.ids, 1 - spelled.unlike
    for variant in sorted({f.variant for f in held}):
        own = [f for f in held if f.variant == variant]
        if sum(f.owners for f in own) == 1:
            return own[0].ids, 1 - own[0].unlike
    return (), 0.0


class Reference:
    """The entries of one kind, or a block of them, with the index over their rare beginnings."""

    def __init__(self, rows: list[tuple[int, str, str | None]], rarity: np.ndarray) -> None:
        self.rarity = rarity
        same: dict[tuple[tuple[str, ...], bool], set[int]] = {}
        for i, name, code in rows:
            same.setdefault((tuple(words_of(name)), False), set()).add(i)
            if code and (letters := words_of(re.sub(r"[\W_]", "", code))):
                same.setdefault((tuple(letters), True), set()).add(i)
        self.entries = [Entry(tuple(sorted(ids)), words, pairs_of(list(words)), is_code) for (words, is_code), ids in same.items() if words]
        self.index: dict[str, list[tuple[int, int]]] = {}
        self.owners: Counter[str] = Counter()
        for k, entry in enumerate(self.entries):
            for place, token in enumerate(self.prefix(entry.pairs)):
                self.index.setdefault(token, []).append((k, place))
            if entry.core:
                self.owners[entry.core] += 1

    def ordered(self, pairs: frozenset[str]) -> list[str]:
        return sorted(pairs, key=lambda t: (self.rarity[_bucket(t)], t))

    def prefix(self, pairs: frozenset[str]) -> list[str]:
        """The beginning in order of rarity that two sets of the least similarity can't both miss."""
        return self.ordered(pairs)[: len(pairs) - math.ceil(THRESHOLD * len(pairs)) + 1]

    def candidates(self, pairs: frozenset[str]) -> list[tuple[float, int]]:
        """Entries of at least the threshold with their exact similarity, best first."""
        size, found, seen = len(pairs), [], set()
        for place, token in enumerate(self.prefix(pairs)):
            for k, other in self.index.get(token, ()):
                if k in seen:
                    continue
                seen.add(k)
                whole = self.entries[k].pairs
                if not THRESHOLD * size <= len(whole) <= size / THRESHOLD:
                    continue
                # What can still be shared after these positions, at most.
                most = 1 + min(size - place, len(whole) - other) - 1
                if most / (size + len(whole) - most) < THRESHOLD:
                    continue
                shared = len(pairs & whole)
                similarity = shared / (size + len(whole) - shared)
                if similarity >= THRESHOLD:
                    found.append((similarity, k))
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def _verified(self, words: list[str], variant: int) -> Iterator[Found]:
        text, ordered, core = " ".join(words), " ".join(sorted(words)), " ".join(w for w in words if w not in AROUND)
        pairs, allowed = pairs_of(words), 1 if len(text) < 10 else 2
        for similarity, k in self.candidates(pairs):
            entry = self.entries[k]
            shared = round(similarity / (1 + similarity) * (len(pairs) + len(entry.pairs)))
            # A slip changes up to three pairs, so entries that share fewer are further away.
            near = not entry.is_code and shared >= max(len(pairs), len(entry.pairs)) - 3 * allowed
            if similarity == 1:
                yield Found(0, 0.0, variant, entry.ids)
            elif near and (apart := min(slips(text, " ".join(entry.words), allowed), slips(ordered, " ".join(sorted(entry.words)), allowed))) <= allowed:
                yield Found(apart, 1 - similarity, variant, entry.ids)
            elif entry.core and entry.core == core:
                yield Found(allowed + 1, 1 - similarity, variant, entry.ids, self.owners[core])

    def found(self, value: str) -> list[Found]:
        """What decides about ``value`` within these entries: the best by spelling, or else the owners of it as a word."""
        held = [f for variant, words in enumerate(variants_of(value)) for f in self._verified(words, variant)]
        spelled = tied([f for f in held if not f.owners])
        if spelled:
            return [spelled]
        first: dict[int, Found] = {}
        for f in sorted(held):
            first.setdefault(f.variant, f)
        return list(first.values())


class Matcher:
    """All kinds; a city of several countries goes to the one that the address is in."""

    def __init__(self, places: list[tuple[int, str, str, str | None, int | None]], rarity: np.ndarray) -> None:
        self.kinds = {k: Reference([(i, n, c) for i, kind, n, c, _ in places if kind == k and n], rarity) for k in KINDS}
        self.parents = {i: p for i, *_, p in places}
        self.kind_of = {i: k for i, k, *_ in places}
        self.names = {k: {} for k in KINDS}
        for i, kind, name, *_ in places:
            if kind in self.names:
                self.names[kind].setdefault(name, []).append(i)
        self._known: dict[tuple[str, str], tuple[tuple[int, ...], float]] = {}

    def country_of(self, place: int | None) -> int | None:
        while place is not None and self.kind_of.get(place) != "country":
            place = self.parents.get(place)
        return place

    def ids_of(self, kind: str, value: str | None) -> tuple[tuple[int, ...], float]:
        if value is None or not value.strip():
            return (), 0.0
        exact = self.names[kind].get(value)
        if exact:
            return tuple(exact), 1.0
        known = self._known.get((kind, value))
        if known is None:
            known = best_of(self.kinds[kind].found(value))
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[kind, value] = known
        return known

    def address(self, country: str | None, region: str | None, city: str | None) -> list[tuple[str, str, int, float]]:
        """``(kind, value, place, similarity)`` of every value that isn't an entry's name as it stands."""
        values = (country, region, city)
        held = [self.ids_of(kind, value) for kind, value in zip(KINDS, values)]
        exact = [value in self.names[kind] for kind, value in zip(KINDS, values)]
        return settled(values, held, exact, self.country_of)


def settled(
    values: tuple[str | None, ...], held: list[tuple[tuple[int, ...], float]], exact: list[bool], country_of: Callable[[int], int | None]
) -> list[tuple[str, str, int, float]]:
    """The place of each value of an address: of several, one in the country that its country or region says."""
    found, lands = [], []
    for kind, value, (ids, similarity), known in zip(KINDS, values, held, exact):
        if len(ids) > 1 and lands:
            ids = tuple(i for i in ids if country_of(i) == lands[0]) or ids
        if ids and kind != "city":
            lands.append(country_of(ids[0]))
        if value is not None and value.strip() and not known:
            found.append((kind, value, ids[0] if ids else 0, similarity))
    return found


def _rarity(addresses: DataFrame, places: DataFrame) -> np.ndarray:
    """How often every letter pair occurs in all values and entries, by bucket."""
    texts = addresses.select(F.explode(F.array(*KINDS)).alias("text")).unionByName(places.select(F.col("name").alias("text"))).filter("text IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, n in batch["text"].value_counts().items():
                for pair in pairs_of(words_of(text)):
                    counts[_bucket(pair)] += n
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"at": at, "n": counts[at]})

    total = texts.mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    rarity = np.zeros(BUCKETS, np.int64)
    rarity[total["at"].to_numpy(np.int64)] = total["n"]
    return rarity


SCHEMA = "address_id long, field_name string, value string, place_id long, similarity double"
COLUMNS = ["address_id", "field_name", "value", "place_id", "similarity"]


def map_places(addresses: DataFrame, places: DataFrame, *, address_id: str = "address_id") -> DataFrame:
    """``(address_id, field_name, value, place_id, similarity)`` for every value that is no entry's name.

    0 where the list has no entry. Null and blank values don't come out; repeated rows do once. A reference of at
    most ``BLOCK`` entries is broadcast whole and the addresses stay where they are, whatever value or country
    holds most of them; a longer one is broadcast block by block to the distinct values. The results are the same.
    """
    rarity = _rarity(addresses, places)
    if places.limit(BLOCK + 1).count() > BLOCK:
        return _map_in_blocks(addresses, places, rarity, address_id)
    shared = addresses.sparkSession.sparkContext.broadcast((_rows(places), rarity))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(*shared.value)
        for batch in batches:
            rows = [(i, *found) for i, *values in zip(batch[address_id], *(batch[k] for k in KINDS)) for found in matcher.address(*values)]
            yield pd.DataFrame(rows, columns=COLUMNS)

    return addresses.select(address_id, *KINDS).mapInPandas(match, SCHEMA).distinct()


def _rows(places: DataFrame) -> list[tuple[int, str, str, str | None, int | None]]:
    return sorted((tuple(r) for r in places.select("place_id", "kind", "name", "code", "parent_id").collect()), key=lambda r: r[0])


def _map_in_blocks(addresses: DataFrame, places: DataFrame, rarity: np.ndarray, address_id: str) -> DataFrame:
    """``map_places`` for a reference of any length: each block finds what it has for each distinct value, the best of
    all blocks counts, and the addresses join their values."""
    context = addresses.sparkSession.sparkContext
    blocks = -(-places.count() // BLOCK)

    @F.pandas_udf("string")
    def spelled(names: pd.Series) -> pd.Series:
        return names.map(lambda n: " ".join(words_of(n)), na_action="ignore")

    # Places of one name lie in one block.
    parts = cut_lineage(places.filter("name IS NOT NULL").withColumn("_block", F.pmod(F.xxhash64("kind", spelled("name")), F.lit(blocks))))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KINDS))).alias("v")
    entered = addresses.select(F.col(address_id).alias("address_id"), *KINDS).distinct()
    values = cut_lineage(entered.select(each).select("v.*").filter("length(trim(value)) > 0").distinct())
    found = None
    for block in range(blocks):
        shared = context.broadcast((_rows(parts.filter(F.col("_block") == block)), rarity))

        def match(batches: Iterator[pd.DataFrame], shared: Broadcast = shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(*shared.value)
            for batch in batches:
                rows = [(k, v, f.apart, f.unlike, f.variant, list(f.ids), f.owners) for k, v in zip(batch["kind"], batch["value"]) for f in matcher.kinds[k].found(v)]
                yield pd.DataFrame(rows, columns=["kind", "value", "apart", "unlike", "variant", "ids", "owners"])

        part = values.mapInPandas(match, "kind string, value string, apart int, unlike double, variant int, ids array<long>, owners int")
        found = part if found is None else found.unionByName(part)

    @F.pandas_udf("ids array<long>, similarity double")
    def best(groups: pd.Series) -> pd.DataFrame:
        chosen = [best_of(Found(f["apart"], f["unlike"], f["variant"], tuple(f["ids"]), f["owners"]) for f in g) for g in groups]
        return pd.DataFrame([(list(ids), s) for ids, s in chosen], columns=["ids", "similarity"], index=groups.index)

    held = found.groupBy("kind", "value").agg(F.collect_list(F.struct("apart", "unlike", "variant", "ids", "owners")).alias("g"))
    spelled_ = held.select("kind", "value", best("g").alias("b")).select("kind", "value", "b.*")
    exact = places.filter(F.col("kind").isin(*KINDS)).groupBy("kind", F.col("name").alias("value")).agg(F.array_sort(F.collect_set("place_id")).alias("own"))
    resolved = values.join(spelled_, ["kind", "value"], "left").join(exact, ["kind", "value"], "left")
    resolved = resolved.select("kind", "value", F.coalesce("own", "ids", F.array().cast("array<long>")).alias("ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("own").isNotNull().alias("known"))
    # The country of each place, over any number of parents in between.
    lands = _countries(places)
    ids = resolved.select("kind", "value", F.posexplode_outer("ids").alias("at", "id")).join(lands.withColumnRenamed("place_id", "id"), "id", "left")
    listed = F.array_sort(F.collect_list(F.struct("at", "id", "land")))
    resolved = cut_lineage(resolved.drop("ids").join(ids.groupBy("kind", "value").agg(listed.alias("ids")), ["kind", "value"]))
    joined = entered
    for k in KINDS:
        own = resolved.filter(F.col("kind") == k).select(F.col("value").alias(k), F.struct("ids", "similarity", "known").alias(f"_{k}"))
        joined = joined.join(own, k, "left")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, *entry in zip(batch["address_id"], *(batch[k] for k in KINDS), *(batch[f"_{k}"] for k in KINDS)):
                values_, held_ = tuple(entry[:3]), [h or {"ids": [], "similarity": 0.0, "known": False} for h in entry[3:]]
                places_ = [(tuple(x["id"] for x in h["ids"] if x["id"] is not None), h["similarity"]) for h in held_]
                land = {x["id"]: x["land"] for h in held_ for x in h["ids"]}
                rows += [(i, *f) for f in settled(values_, places_, [bool(h["known"]) for h in held_], land.get)]
            yield pd.DataFrame(rows, columns=COLUMNS)

    return joined.mapInPandas(settle, SCHEMA).distinct()


def _countries(places: DataFrame) -> DataFrame:
    """``(place_id, land)``: the country that each place lies in; null for none."""
    own = cut_lineage(places.select("place_id", "kind", "parent_id").dropDuplicates(["place_id"]))
    up = own.select("place_id", F.when(F.col("kind") == "country", F.col("place_id")).alias("land"), F.when(F.col("kind") != "country", F.col("parent_id")).alias("above"))
    for _ in KINDS:
        above = own.select(F.col("place_id").alias("above"), F.col("kind").alias("_k"), F.col("parent_id").alias("_p"))
        step = up.join(above, "above", "left")
        land = F.coalesce("land", F.when(F.col("_k") == "country", F.col("above")))
        up = step.select("place_id", land.alias("land"), F.when(F.col("_k") != "country", F.col("_p")).alias("above"))
    return up.select("place_id", "land")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = spread(table(spark, sf_dir, "addresses").select("address_id", *KINDS))
    return map_places(addresses, table(spark, sf_dir, "places"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of every freely entered country, region and city, 0 where there is none."""
    return _mapped(spark, sf_dir).select("address_id", "field_name", "place_id").distinct()


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without an entry and how many addresses have them."""
    missing = _mapped(spark, sf_dir).filter("place_id = 0")
    return missing.groupBy("field_name", "value").agg(F.count("*").alias("addresses"))


QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched}
SQL: dict[str, str] = {}
