"""Address matching finds what a comparison of all pairs finds."""

from __future__ import annotations

import itertools
import random

from conftest import rows
from pyspark.sql import functions as F

from siteloom.llm import addresses


def test_candidates_hold_every_alike_pair(spark):
    rng = random.Random(3)

    def slipped(word, times):
        for _ in range(times):
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("xyz") + word[k:], word[:k] + "q" + word[k + 1 :], word[:k] + word[k : k + 2][::-1] + word[k + 2 :]]) or "x"
        return word

    spellings = {("1", slipped(core, rng.randrange(2)), slipped(city, rng.randrange(3)), postal) for core in ("main", "stiltregra") for city in ("ulm", "ayora", "wikrimju", "norkaltingen", "zarbolinovagrad") for postal in ("", "12345") for _ in range(12)}
    data = [(i, n, core, [], city, postal) for i, (n, core, city, postal) in enumerate(sorted(spellings))]
    reps = spark.createDataFrame(data, "id long, number string, core string, kinds array<string>, city string, postal string")
    wanted = [(a[0], b[0]) for a, b in itertools.combinations(data, 2) if addresses.alike(a[2], b[2], a[4], b[4], a[5], b[5])]
    assert rows(addresses.match(reps)) == sorted(wanted, key=repr)


def test_slips_of_both_spellings_are_rewritten(spark):
    data = [
        (1, "139 Wartmonko Platz", "Brogodus", None, "76945", None, None),
        (2, "139 Wartronok Platz", "Brogodus", None, "76945", None, None),
        # The place is spelled with slips, too: known only after the street is rewritten.
        (3, "139 Wartmonok Platz", "Brgodus", None, None, None, None),
        # Another kind, number, city, and another name.
        (4, "139 Wartronok Gasse", "Brogodus", None, "76945", None, None),
        (5, "138 Wartronok Platz", "Brogodus", None, "76945", None, None),
        (6, "139 Wartronok Platz", "Ayoraville", None, "11111", None, None),
        (7, "139 Wermtonok Platz", "Brogodus", None, "76945", None, None),
    ]
    df = spark.createDataFrame(data, "address_id long, street string, city string, region string, postal_code string, country string, formatted string")
    assert rows(addresses.same_location(addresses.locate(df)).filter("address_id_b <> 3 AND address_id_a <> 3")) == [(1, 2)]
    assert rows(addresses.same_location(addresses.locate(df))) == [(1, 2), (1, 3), (2, 3)]


def test_parts_hold_every_pair_of_two_slips(spark):
    rng = random.Random(5)

    def slipped(word):
        for _ in range(2):
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("xyz") + word[k:], word[:k] + "q" + word[k + 1 :], word[:k] + word[k : k + 2][::-1] + word[k + 2 :]])
        return word

    words = sorted({slipped(w) for w in ("tagraze", "wufekrlu", "wartmonok", "drodrasjode", "plundpaxfargri") for _ in range(40)})
    parts = {r.w: set(r.p) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", addresses._thirds(F.col("w")).alias("p")).collect()}
    near = [(a, b) for a, b in itertools.combinations(words, 2) if addresses.one_word_apart(a, b)]
    assert len(near) > 100
    assert not [x for x in near if not parts[x[0]] & parts[x[1]]]


def test_one_line_addresses_are_read_for_what_is_missing(monkeypatch):
    read = []
    whole = addresses._formatted
    monkeypatch.setattr(addresses, "_formatted", lambda text: read.append(text) or whole(text))
    line = "Saint Wolthu 28458, Kurktamlum Platz 6, A-11111"
    assert addresses.parse("Kurktamlum Platz 6", "Saint Wolthu", None, line) == ("6", ["kurktamlum", "platz"], "saint wolthu", whole(line)[2])
    assert addresses.parse("Kurktamlum Platz 6", "Saint Wolthu", "12345", line)[3] == "12345"
    assert not read
    assert addresses.parse("Kurktamlum Platz 6", None, None, line) is not None and read == [line]


def test_crowded_places_are_rewritten_alike(spark, monkeypatch):
    rng = random.Random(7)
    names = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(12)]
    data, k = [], 0
    for name in names:
        for spelled in (name, name, name[:3] + "x" + name[4:], name[:1] + name[2] + name[1] + name[3:]):
            data.append((k, f"12 {spelled} Platz", "Brogodus", None, "76945", None, None))
            k += 1
    df = spark.createDataFrame(data, "address_id long, street string, city string, region string, postal_code string, country string, formatted string")
    found = rows(addresses.same_location(addresses.locate(df)))
    assert len(found) >= 6 * len(names)
    monkeypatch.setattr(addresses, "COMPARED", 1)
    assert rows(addresses.same_location(addresses.locate(df))) == found
    words = sorted({w for d in data for w in (d[1].split()[1], d[1][:4], d[1][3:5])} | {""})
    parts = {r.w: set(r.p) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", addresses._thirds(F.col("w")).alias("p")).collect()}
    assert parts == {w: addresses.thirds(w) for w in words}
