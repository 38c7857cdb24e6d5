"""Bringing together address rows that denote one location (problem 6).

Rows are parsed into house number, street words, city and postal code. Rewrites are mined from pairs of
rows that agree elsewhere and differ in one word: abbreviations whose pairing is statistically
significant rewrite a word everywhere, until no new one appears; slips of the pen rewrite one row's street
into the spelling of neighbours under its number and place, until no row changes. All spellings, given and
rewritten, are then matched, so a rewrite only adds links.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.places import AROUND, slips, words_of
from siteloom.session import cut_lineage, spread, table

#: Words for a kind of street, words for a unit inside a building, marks of a house number, words of regions.
STREET_KINDS = frozenset(
    "street road avenue lane square boulevard drive court terrace crescent way close platz allee gasse strasse weg ufer ring damm "
    "calle plaza avenida camino paseo ronda rue place chemin quai impasse cours via piazza viale corso rua praca travessa خیابان کوچه بلوار میدان".split()
)
JOINED = ("platz", "strasse", "gasse", "allee", "weg", "str")
UNITS = frozenset("suite ste unit apt apartment floor fl room rm office etage stock piso local depto oficina wohnung top".split())
NUMBER_MARKS = frozenset("no nr num number nro numero n".split())
REGIONAL = frozenset("province prov county region state upper upr north south east west".split())

#: Value of the likelihood ratio from which a pair of words is significant (p < 0.001), and least places it is seen in.
SIGNIFICANT, SUPPORT = 10.83, 2
#: Letters of the words of streets that two slips may tell apart under one number and place.
TWICE = 7
#: Buckets of word counts.
BUCKETS = 1 << 16
#: Addresses of one place up to which their pairs are made in one task; more are split.
TOGETHER = 2_000
#: Spellings under one number and place up to which all are compared; of more, only those that share a part.
COMPARED = 100

_POSTAL = re.compile(r"(?<![\w-])(?:[A-Za-z]{1,3}[- ])?(\d{5}|\d{3} \d{2})(?![\w])")
_NUMBER = re.compile(r"(?<![\w])(?:#\s*)?(\d{1,4})(?:\s*[-/]?\s*([A-Za-z]))?(?![\w])")
_SPLIT = re.compile(r"[,;\n\t]+|\s-\s")
_ORDINAL = re.compile(r"[nN]\s?[º°]\.?\s*")


def _street_words(text: str) -> list[str]:
    out = []
    for w in words_of(text):
        joined = next((k for k in JOINED if w.endswith(k) and len(w) - len(k) >= 4), None) if w.endswith(JOINED) else None
        out += [w[: -len(joined)], joined] if joined else [w]
    return out


def _street(text: str) -> tuple[str, list[str]]:
    """House number with its letter, and the words of the street without unit and number marks."""
    text = _ORDINAL.sub(" ", text)
    kept, dropped = [], False
    for part in re.split(r"[,;]+|\s+", text):
        bare = part.strip(".#").lower()
        if bare in UNITS:
            dropped = True  # a unit's own number follows it
            continue
        if dropped and re.fullmatch(r"#?\d+[A-Za-z]?", part):
            dropped = False
            continue
        dropped = False
        if bare in NUMBER_MARKS and part:
            continue
        kept.append(part)
    text = " ".join(kept)
    number = ""
    m = _NUMBER.search(text)
    if m:
        letter = m.group(2) or ""
        after = text[m.end() :].strip()
        before = text[: m.start()].strip()
        # A lone letter after the number is part of it unless it abbreviates the street's kind (``C Mayor``).
        if letter and m.group()[-2:-1] == " " and not before and after and len(words_of(after)) == 1 and letter.lower() in "cg":
            text = f"{before} {letter} {after}"
            letter = ""
        else:
            text = f"{before} {after}"
        number = str(int(m.group(1))) + letter.lower()
    return number, _street_words(text)


def _city(text: str) -> str:
    words = words_of(re.split(r"[,/;(|]", text)[0])
    return " ".join(sorted(w for w in words if w not in AROUND) or sorted(words))


def _formatted(text: str) -> tuple[str, str, str]:
    """Street, city and postal code of an address in one line, in any order."""
    segments = [s.strip() for s in _SPLIT.split(text) if s.strip()]
    postal, street, others = "", [], []
    for k, s in enumerate(segments):
        m = _POSTAL.search(s)
        rest = s
        if m:
            postal = re.sub(r"\D", "", m.group(1))
            rest = (s[: m.start()] + " " + s[m.end() :]).strip()
        words = words_of(rest)
        unit = bool(set(w.strip(".#").lower() for w in rest.split()) & UNITS)
        kind = bool(set(_street_words(rest)) & STREET_KINDS)
        if rest and not m and (_NUMBER.search(_ORDINAL.sub(" ", rest)) or unit or kind):
            street.append((k, rest))
        elif words:
            others.append((k, rest, bool(m), bool(set(words) & REGIONAL)))
    if street and others and not any(len(w) > 1 and w not in UNITS and w not in NUMBER_MARKS for _, s in street for w in words_of(s)):
        near = min(others, key=lambda o: (o[2], abs(o[0] - street[0][0])))
        others.remove(near)
        street.append((near[0], near[1]))
        street.sort()
    city = ""
    if others:
        at = street[0][0] if street else 0
        city = min(others, key=lambda o: (o[3], not o[2], min(abs(o[0] - k) for k, _ in street) if street else abs(o[0] - at)))[1]
    return ", ".join(s for _, s in street), city, postal


def _code(text: str) -> str:
    """The postal code that ``_formatted`` finds."""
    found = [m for s in _SPLIT.split(text) if (m := _POSTAL.search(s.strip()))]
    return re.sub(r"\D", "", found[-1].group(1)) if found else ""


def parse(street: str | None, city: str | None, postal: str | None, formatted: str | None) -> tuple[str, list[str], str, str] | None:
    """``(number, street words, city, postal)``; None if there is no street or nothing to place it by."""
    street_ = street if street and street.strip() else ""
    city_ = city if city and words_of(city) else ""
    m = _POSTAL.search(postal) if postal else None
    f = ("", "", "")
    if formatted and formatted.strip():
        # All of it is only read for what the fields lack.
        if not street_ or not city_:
            f = _formatted(formatted)
        elif not m:
            f = ("", "", _code(formatted))
    street_, city_ = street_ or f[0], city_ or f[1]
    postal_ = re.sub(r"\D", "", m.group(1)) if m else f[2]
    if not street_:
        return None
    number, words = _street(street_)
    place = _city(city_) if city_ else ""
    if not words or not (place or postal_):
        return None
    return number, sorted(set(words)), place, postal_


PARSED = "address_id long, number string, words array<string>, city string, postal string"


def parse_addresses(addresses: DataFrame, address_id: str = "address_id") -> DataFrame:
    """Rows of ``parse``, once for each row of ``addresses`` that can be placed."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, *parts in zip(batch[address_id], *(batch[c] for c in ("street", "city", "postal_code", "formatted"))):
                found = parse(*parts)
                if found:
                    rows.append((i, *found))
            yield pd.DataFrame(rows, columns=["address_id", "number", "words", "city", "postal"])

    return addresses.select(address_id, "street", "city", "postal_code", "formatted").mapInPandas(parsed, PARSED)


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8")) % BUCKETS


def _rarest(reps: DataFrame) -> DataFrame:
    """``reps`` with the street word that is rarest over all rows; counts are kept by bucket, so they are bounded."""
    at = F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(BUCKETS)).alias("at")
    total = reps.select("n", F.explode("words").alias("w")).groupBy(at).agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[total["at"].to_numpy(np.int64)] = total["n"]
    shared = reps.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("string")
    def rarest(words: pd.Series) -> pd.Series:
        return words.map(lambda held: min(held, key=lambda w: (shared.value[_bucket(w)], -len(w), w)))

    return reps.withColumn("rarest", rarest.asNondeterministic()("words"))


def abbreviates(short: str, long: str) -> bool:
    """Whether ``short`` begins like ``long`` and has letters of it in order."""
    if len(short) >= len(long) or short[:1] != long[:1]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def _likelihood() -> Column:
    """G-squared of the 2 x 2 table of a pair of words from its corner ``n``, margins ``nx`` and ``ny`` and ``total``."""

    def cell(seen: Column, margin: Column, other: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * F.col("total") / (margin * other))).otherwise(F.lit(0.0))

    n, nx, ny, total = (F.col(c).cast("double") for c in ("n", "nx", "ny", "total"))
    return 2 * (cell(n, nx, ny) + cell(nx - n, nx, total - ny) + cell(ny - n, total - nx, ny) + cell(total - nx - ny + n, total - nx, total - ny))


def mine_rewrites(reps: DataFrame) -> dict[str, dict[str, list[str]]]:
    """Abbreviations in streets and in cities, with what they stand for, from rows that agree elsewhere.

    Rows that differ in one word have the rest in common, so each row has a key for each of its words but the rarest:
    number, place and the other words. Under a key lie only the words that were left out, each once, so that no
    place or street brings rows together. A pair of words counts once for each number and rarest word. Kept are
    pairs whose likelihood ratio is significant, which is tested before anything reaches the driver; what does are
    the abbreviations in use.
    """
    ranked = _rarest(reps).select("number", "rarest", "words", "city", "postal")
    places = F.filter(F.array(F.concat(F.lit("c"), "city"), F.concat(F.lit("z"), "postal")), lambda x: F.length(x) > 1)

    def left_out(field: str, held: Column, place: Column, but: Column) -> Column:
        """For each word of ``held``, the hashes of the rest, of number and rarest word, and of the word."""
        words = F.filter(F.array_distinct(held), lambda w: ~F.equal_null(w, but))
        rest = lambda w: F.array_join(F.array_except(held, F.array(w)), " ")
        own = (F.lit(field), F.col("number"), F.col("rarest"))
        return F.transform(words, lambda w: F.struct(F.lit(field).alias("field"), F.xxhash64(*own, place, rest(w)).alias("key"), F.xxhash64(*own).alias("at"), F.xxhash64(F.lit(field), w).alias("w")))

    streets = F.flatten(F.transform(places, lambda place: left_out("street", F.col("words"), place, F.col("rarest"))))
    cities = left_out("city", F.split("city", " "), F.col("postal"), F.lit(None).cast("string"))
    empty = F.slice(cities, 1, 0)
    every = F.concat(F.when(F.size("words") > 1, streets).otherwise(empty), F.when((F.col("city") != "") & (F.col("postal") != ""), cities).otherwise(empty))
    # Only hashes are moved. Under a key, equal words are one.
    keyed = cut_lineage(ranked.select(F.explode(every).alias("e")).select("e.*")).repartition("key").distinct()
    other = keyed.select("key", F.col("w").alias("y")).hint("merge")
    pairs = keyed.withColumnRenamed("w", "x").join(other, "key").filter("x <> y").select("field", "at", "x", "y").distinct()
    counted = cut_lineage(pairs.groupBy("field", "x", "y").agg(F.count("*").alias("n")))

    def words_in(field: str, held: Column) -> DataFrame:
        return reps.select(F.lit(field).alias("field"), F.explode(held).alias("w")).distinct()

    held = words_in("street", F.col("words")).unionByName(words_in("city", F.split("city", " ")))
    spelled = held.select(F.xxhash64("field", "w").alias("id"), "w")
    ones = counted.groupBy("field", "x").agg(F.sum("n").alias("nx"))
    total = counted.groupBy("field").agg(F.sum("n").alias("total"))
    often = counted.filter(f"n >= {SUPPORT}").join(spelled.toDF("x", "x_word"), "x").join(spelled.toDF("y", "y_word"), "y")
    shorter = often.filter("length(x_word) < length(y_word) AND substr(x_word, 1, 1) = substr(y_word, 1, 1)")
    tested = shorter.join(ones, ["field", "x"]).join(ones.withColumnsRenamed({"x": "y", "nx": "ny"}), ["field", "y"]).join(total, "field")
    tested = tested.drop("x", "y").withColumnsRenamed({"x_word": "x", "y_word": "y"})
    # The first letter and those in order: a pattern of the short word's letters with anything between them.
    letters = F.concat(F.array_join(F.split("x", ""), ".*"), F.lit(".*"))
    kept = tested.filter(_likelihood() >= SIGNIFICANT).filter(F.regexp_like("y", F.concat(F.lit("^"), letters))).select("field", "x", "y")
    found: dict[str, dict[str, list[str]]] = {"street": {}, "city": {}}
    for r in sorted(kept.collect()):
        if abbreviates(r["x"], r["y"]):
            found[r["field"]].setdefault(r["x"], []).append(r["y"])
    return found


def _expand(word: str, rules: dict[str, list[str]]) -> list[str]:
    """What a word may stand for after all rewrites."""
    found, todo = [], [word]
    while todo:
        w = todo.pop()
        longer = [x for x in rules.get(w, ()) if x not in found]
        if longer:
            todo += longer
        elif w not in found:
            found.append(w)
    return sorted(found)


def normalised(words: list[str], city: str, rules: dict[str, dict[str, list[str]]]) -> tuple[str, list[str], str]:
    """Name of the street, the kinds of street that its words may mean, and the city, rewritten."""
    core, kinds = [], set()
    for w in words:
        means = _expand(w, rules["street"])
        if w in STREET_KINDS:
            kinds.add(w)
        elif any(m in STREET_KINDS for m in means):
            kinds.update(m for m in means if m in STREET_KINDS)
        else:
            core.append(means[0] if len(means) == 1 else w)
    if not core:
        core, kinds = sorted(words), set()
    # An ambiguous abbreviation in a city keeps all it may mean; in practice there is one.
    places = sorted("/".join(_expand(w, rules["city"])) for w in city.split())
    return " ".join(sorted(core)), sorted(kinds), " ".join(places)


def _halves(text: Column) -> Column:
    """Beginnings and ends of a text, one of which is the same in any text one slip away.

    A slip leaves as many letters at the beginning or at the end as half of the shorter text has, so each text has
    those of its own length and of one less.
    """
    n = F.length(text)
    ends = F.array(*(F.greatest(F.lit(0), F.floor((n - k) / 2)).cast("int") for k in (1, 2)))
    begun = F.transform(ends, lambda h: F.concat(F.lit("<"), F.substring(text, F.lit(1), h)))
    return F.array_distinct(F.concat(begun, F.transform(ends, lambda h: F.concat(F.lit(">"), F.substring(text, n - h + 1, h)))))


def _parts(city: Column) -> Column:
    """Beginnings and ends of a city, one of which is the same in any city that ``alike`` accepts.

    A slip leaves as many letters at the beginning or at the end as half of the shorter name has, so each
    name has those of its own length and of one less. Names of twelve letters or more may have two slips;
    if these are in the first and the last four letters, two letters between them are the same, moved by
    one at most.
    """
    n = F.length(city)
    ends = F.array(*(F.greatest(F.lit(0), F.least(F.lit(4), F.floor((n - k) / 2))).cast("int") for k in (1, 2)))
    begun = F.transform(ends, lambda h: F.concat(F.lit("<"), F.substring(city, F.lit(1), h)))
    ended = F.transform(ends, lambda h: F.concat(F.lit(">"), F.substring(city, n - h + 1, h)))
    between = F.when(n > 11, F.array(*(F.concat(F.lit("="), F.substring(city, k, 2)) for k in (5, 6, 7)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(begun, ended, between))


def alike(core_a: str, core_b: str, city_a: str, city_b: str, postal_a: str, postal_b: str) -> bool:
    """Whether names of streets, cities and postal codes can be spellings of the same."""
    same_code = bool(postal_a) and postal_a == postal_b
    most = 2 if same_code or min(len(city_a), len(city_b)) > 11 else 1
    near = (city_a == city_b or slips(city_a, city_b, 2) <= most) if city_a and city_b else same_code
    return near and (core_a == core_b or len(core_a) > 3 and slips(core_a, core_b, 1) <= 1)


def _thirds(core: Column) -> Column:
    """Beginnings, ends and middle letters of a street, one of which is the same in any of at most two slips.

    As in ``_parts``, for the lengths that the shorter of two such names can have.
    """
    n = F.length(core)
    ends = F.array_distinct(F.array(*(F.greatest(F.lit(0), F.least(F.lit(4), F.floor((n - k) / 2))).cast("int") for k in (3, 4, 5))))
    begun = F.transform(ends, lambda h: F.concat(F.lit("<"), F.substring(core, F.lit(1), h)))
    ended = F.transform(ends, lambda h: F.concat(F.lit(">"), F.substring(core, n - h + 1, h)))
    between = F.flatten(F.transform(ends, lambda h: F.transform(F.sequence(h + 1, h + 3), lambda k: F.concat(F.lit("="), h.cast("string"), F.substring(core, k, F.lit(1))))))
    return F.array_distinct(F.concat(begun, ended, between))


def thirds(core: str) -> set[str]:
    """What ``_thirds`` gives for a text."""
    n = len(core)
    ends = {max(0, min(4, (n - k) // 2)) for k in (3, 4, 5)}
    return {x for h in ends for x in (f"<{core[:h]}", f">{core[n - h :]}", *(f"={h}{core[k : k + 1]}" for k in range(h, h + 3)))}


def one_word_apart(a: str, b: str) -> bool:
    """Whether streets differ in one word, by a slip, or by two in a long word."""
    x, y = Counter(a.split(" ")), Counter(b.split(" "))
    left, right = list((x - y).elements()), list((y - x).elements())
    if len(left) != 1 or len(right) != 1:
        return False
    shorter = min(len(left[0]), len(right[0]))
    most = 2 if shorter >= TWICE else 1 if shorter > 3 else 0
    return slips(left[0], right[0], 2) <= most


def _fit() -> Column:
    return F.arrays_overlap("kinds_a", "kinds_b") | (F.size("kinds_a") == 0) | (F.size("kinds_b") == 0)


def respelled(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``reps`` with the spellings that rewrites make of them, and pairs ``(a, b)`` of a spelling and its rewrite.

    A street is rewritten to one that differs in one word by slips, from a row that agrees on number, kind
    and city or postal code and is written so more often under its number (if as often, comes first). So
    every rewrite goes up in one order of spellings, and the rounds end.
    """
    often = reps.groupBy("number", "core").agg(F.sum("seen").alias("often"))
    rows = cut_lineage(reps.select("id", "number", "core", "kinds", "city", "postal").join(often, ["number", "core"]))

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_word_apart(x, y) and not thirds(x).isdisjoint(thirds(y)) for x, y in zip(a, b)], dtype=bool)

    def placed(df: DataFrame) -> DataFrame:
        place = F.explode(F.filter(F.array(F.concat(F.lit("c"), "city"), F.concat(F.lit("z"), "postal")), lambda x: F.length(x) > 1)).alias("place")
        return df.select("id", "number", "core", "kinds", "often", place).withColumn("key", F.xxhash64("number", "place"))

    crowded = cut_lineage(placed(rows).groupBy("key").agg(F.count("*").alias("_n")).filter(f"_n > {COMPARED}").select("key"))
    some = crowded.limit(1).count() > 0

    def candidates(fresh: DataFrame) -> DataFrame:
        """Pairs of rows that agree on number and place; where these are many, on a part of the street as well."""
        found = None
        for kind in ("left_anti", "left_semi") if some else (None,):
            a, b = (df if kind is None else df.join(crowded, "key", kind) for df in (placed(fresh), placed(rows)))
            if kind == "left_semi":
                a, b = (df.withColumn("key", F.explode(_thirds(F.col("core")))).withColumn("key", F.xxhash64("number", "place", "key")) for df in (a, b))
            a, b = (df.select("key", *(F.col(c).alias(f"{c}_{t}") for c in df.columns if c != "key")) for df, t in ((a, "a"), (b, "b")))
            both = a.join(b.hint("merge"), "key").filter("number_a = number_b AND place_a = place_b AND core_a <> core_b AND abs(length(core_a) - length(core_b)) <= 2")
            found = both if found is None else found.unionByName(both)
        return found

    known, edges, fresh = rows, None, rows
    while True:
        better = (F.col("often_b") > F.col("often_a")) | ((F.col("often_b") == F.col("often_a")) & (F.col("core_b") < F.col("core_a")))
        # A slip is at most two changes of single letters, and only long words may have two.
        apart = F.expr(f"CASE WHEN least(length(core_a), length(core_b)) < {TWICE} THEN levenshtein(core_a, core_b, 2) >= 0 ELSE levenshtein(core_a, core_b, 4) >= 0 END")
        # Letters that swap stay the same letters, so either has at most two that the other lacks.
        letters = F.expr("size(array_except(split(core_a, ''), split(core_b, ''))) <= 2 AND size(array_except(split(core_b, ''), split(core_a, ''))) <= 2")
        both = candidates(fresh).filter(better & _fit()).filter(apart).filter(letters)
        pairs = both.select(F.col("id_a").alias("id"), F.col("core_a").alias("old"), F.col("core_b").alias("core"), F.col("often_b").alias("often")).distinct().filter(near("old", "core"))
        best = pairs.groupBy("id").agg(F.min_by(F.struct("core", "often"), F.struct(-F.col("often"), "core")).alias("best"))
        forms = fresh.drop("core", "often").join(best, "id").select(F.col("id").alias("a"), "number", "best.core", "kinds", "city", "postal", "best.often")
        forms = cut_lineage(forms.withColumn("id", F.xxhash64("number", "core", "kinds", "city", "postal")))
        made = forms.select("a", F.col("id").alias("b"))
        edges = made if edges is None else edges.unionByName(made)
        fresh = cut_lineage(forms.drop("a").dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti"))
        if not fresh.limit(1).count():
            return known.drop("often"), edges
        known = cut_lineage(known.unionByName(fresh.select(known.columns)))


def city_groups(reps: DataFrame) -> DataFrame:
    """``(city, group)``: cities that ``alike`` accepts without a common code are of one group.

    Cities are far fewer than addresses, so they are compared once and not for each address.
    """
    cities = cut_lineage(reps.select("city").filter("city <> ''").distinct().select(F.xxhash64("city").alias("id"), "city"))
    ids = _pairs_of_keys(cities.select("id", F.explode(_parts(F.col("city"))).alias("part")).select("id", F.xxhash64("part").alias("key")))
    a, b = (cities.select(*(F.col(c).alias(f"{c}_{t}") for c in cities.columns)) for t in "ab")
    # A slip is at most two changes of single letters.
    near = ids.join(a, "id_a").join(b, "id_b").filter("CASE WHEN least(length(city_a), length(city_b)) > 11 THEN levenshtein(city_a, city_b, 4) >= 0 ELSE levenshtein(city_a, city_b, 2) >= 0 END")

    @F.pandas_udf("boolean")
    def compared(city_a: pd.Series, city_b: pd.Series) -> pd.Series:
        return pd.Series([slips(x, y, 2) <= (2 if min(len(x), len(y)) > 11 else 1) for x, y in zip(city_a, city_b)], dtype=bool)

    pairs = near.filter(compared("city_a", "city_b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return cities.join(components(pairs), "id", "left").select("city", F.coalesce("location", "id").alias("group"))


def match(reps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different spellings that denote one location; ``a < b``.

    Candidates share the number, half of the street name, and the postal code or the group of the city; every pair
    that ``alike`` accepts is one. Only hashes and ids go through that join. Texts are fetched for the candidates, and
    each is compared in full.
    """
    rows = reps.select("id", "number", "core", "kinds", "city", "postal")
    half = F.explode(_halves(F.col("core"))).alias("half")
    by_city = rows.filter("city <> ''").select("id", "number", "city", "core").join(city_groups(rows), "city").select("id", "number", F.col("group").alias("part"), half)
    by_code = rows.filter("postal <> ''").select("id", "number", F.xxhash64(F.lit("z"), "postal").alias("part"), half)
    keyed = by_city.unionByName(by_code).select("id", F.xxhash64("number", "part", "half").alias("key")).distinct()
    ids = _pairs_of_keys(keyed)
    a, b = (rows.select(*(F.col(c).alias(f"{c}_{t}") for c in rows.columns)) for t in "ab")
    pairs = ids.join(a, "id_a").join(b, "id_b").filter("number_a = number_b").filter(_fit())
    # One slip in the street, at most two in the city: changes of single letters, twice as many for letters that swap.
    near = pairs.filter("levenshtein(core_a, core_b, 2) >= 0 AND (city_a = '' OR city_b = '' OR levenshtein(city_a, city_b, 4) >= 0)")

    @F.pandas_udf("boolean")
    def compared(core_a: pd.Series, core_b: pd.Series, city_a: pd.Series, city_b: pd.Series, postal_a: pd.Series, postal_b: pd.Series) -> pd.Series:
        return pd.Series([alike(*parts) for parts in zip(core_a, core_b, city_a, city_b, postal_a, postal_b)], dtype=bool)

    good = near.filter(compared("core_a", "core_b", "city_a", "city_b", "postal_a", "postal_b"))
    return good.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _pairs_of_keys(keyed: DataFrame, *, key: str = "key", item: str = "id") -> DataFrame:
    """Distinct pairs ``(id_a, id_b)`` of items that share a key, ``id_a < id_b``.

    Items of a key that has more than ``TOGETHER`` are split into parts, and each pair of parts is a task's work.
    """
    keyed = keyed.select(key, item).repartition(key)
    sized = keyed.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")
    held = keyed.join(sized.hint("merge"), key).withColumn("_parts", F.ceil(F.col("_n") / TOGETHER).cast("int")).drop("_n")
    few, many = held.filter("_parts = 1").drop("_parts"), held.filter("_parts > 1").withColumn("_part", F.pmod(F.xxhash64(item, F.lit(1)), "_parts").cast("int"))
    pairs = few.withColumnRenamed(item, "id_a").join(few.withColumnRenamed(item, "id_b").hint("merge"), key).filter("id_a < id_b").select("id_a", "id_b")
    # The part of the one and the part of the other, in order.
    left = many.select(key, F.col(item).alias("id_a"), F.col("_part").alias("_l"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_r"))
    right = many.select(key, F.col(item).alias("id_b"), F.col("_part").alias("_r"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_l"))
    split = left.join(right.hint("merge"), [key, "_l", "_r"]).filter("id_a < id_b").select("id_a", "id_b")
    return pairs.unionByName(split).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``(id, location)``: the least id that each id is linked to over any number of pairs.

    In each round an id takes the least label of its neighbours and then the label of its label, so that chains
    halve. Rounds write their labels to the shared folder.
    """
    edges = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("location"))
    while True:
        nearest = edges.join(labels.select(F.col("id").alias("b"), "location"), "b").groupBy(F.col("a").alias("id")).agg(F.min("location").alias("least"))
        hooked = cut_lineage(labels.join(nearest, "id").select("id", F.least("location", "least").alias("location"), F.col("location").alias("older")))
        above = hooked.select(F.col("id").alias("location"), F.col("location").alias("higher"))
        renewed = cut_lineage(hooked.join(above, "location", "left").select("id", F.least("location", F.coalesce("higher", "location")).alias("location"), "older"))
        if not renewed.filter("location <> older").limit(1).count():
            return renewed.select("id", "location")
        labels = renewed.select("id", "location")


def locate(addresses: DataFrame, *, address_id: str = "address_id") -> DataFrame:
    """``(address_id, location)``: rows of one location share it. Rows without a street, or without city and
    postal code, denote no known location and don't come out; nor do repeated rows again. Whole table.
    """
    parsed = cut_lineage(parse_addresses(addresses, address_id).distinct())
    written = ["number", "words", "city", "postal"]
    forms = cut_lineage(parsed.groupBy(*written).agg(F.count("*").alias("n")))
    rules: dict[str, dict[str, list[str]]] = {"street": {}, "city": {}}
    rewritten = forms
    while True:
        mined = mine_rewrites(rewritten)
        merged = {f: {w: sorted({*rules[f].get(w, ()), *mined[f].get(w, ())}) for w in {*rules[f], *mined[f]}} for f in rules}
        if merged == rules:
            break
        rules = merged
        rewritten = cut_lineage(_normalise(forms, rules, words_only=True))
    keys = ["number", "core", "kinds", "city", "postal"]
    known = cut_lineage(_normalise(forms.withColumn("form", F.xxhash64(*written)), rules).withColumn("id", F.xxhash64(*keys)))
    reps = known.groupBy("id", *keys).agg(F.sum("n").alias("seen"))
    members = parsed.select("address_id", F.xxhash64(*written).alias("form")).join(known.select("form", "id"), "form")
    spellings, rewrites = respelled(reps)
    groups = components(match(spellings).unionByName(rewrites))
    joined = members.select("address_id", "id").join(groups, "id", "left")
    return joined.select("address_id", F.coalesce("location", "id").alias("location")).distinct()


def _normalise(parsed: DataFrame, rules: dict, words_only: bool = False) -> DataFrame:
    """Forms with the rewrites applied: for mining as words again, else as name, kinds and city."""
    shared = parsed.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf("core string, kinds array<string>, city string")
    def forms(words: pd.Series, city: pd.Series) -> pd.DataFrame:
        rows = [normalised(list(w), c, shared.value) for w, c in zip(words, city)]
        return pd.DataFrame(rows, columns=["core", "kinds", "city"], index=words.index)

    done = parsed.withColumn("f", forms.asNondeterministic()("words", "city"))
    if words_only:
        words = F.array_sort(F.array_distinct(F.concat(F.split("f.core", " "), F.when(F.size("f.kinds") == 1, F.col("f.kinds")).otherwise(F.filter("words", lambda w: ~F.array_contains(F.split("f.core", " "), w))))))
        return done.select("number", words.alias("words"), F.col("f.city").alias("city"), "postal", "n")
    return done.select("form", "number", "f.core", "f.kinds", "f.city", "postal", "n")


def same_location(located: DataFrame) -> DataFrame:
    """Pairs of different ids of one location, smaller first. Locations of many rows are split over tasks."""
    keyed = located.select(F.col("location").alias("key"), F.col("address_id").alias("id")).distinct()
    return _pairs_of_keys(keyed).toDF("address_id_a", "address_id_b")


def p6_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The location of every row that has one."""
    return locate(spread(table(spark, sf_dir, "addresses")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that denote the same location."""
    return same_location(p6_locations(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_locations": p6_locations}
SQL: dict[str, str] = {}
