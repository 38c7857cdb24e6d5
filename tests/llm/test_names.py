"""Keys of names of all sizes, against a comparison of all pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np

from siteloom.llm import names


def _missed(known, typed):
    rarity = np.random.default_rng(1).integers(0, 50, names.BUCKETS)
    a, b = ([names.parse(n, frozenset()) for n in x] for x in (known, typed))
    keys_a, keys_b = ([set(names.keys_of(n, rarity, frozenset(), k)) for n in x] for x, k in ((a, True), (b, False)))
    missed, linked = [], 0
    for (x, kx), (y, ky) in itertools.product(zip(a, keys_a), zip(b, keys_b)):
        xs, ys = names.elements_of(x.rare), names.elements_of(y.rare)
        if len(xs & ys) >= names.THRESHOLD / 2 * len(xs | ys) and names.similarity(y, x, lambda w: 1.0) > 0:
            linked += 1
            if not kx & ky:
                missed.append((x, y))
    return missed, linked


def test_names_of_different_kinds_share_keys():
    for pair in (("Weber Bakery", "Webber Bakery"), ("Van Dijk", "Vandijk"), ("Weber", "Webr")):
        assert _missed([pair[0]], [pair[1]]) == ([], 1), pair
    assert _missed(["Vandijk Bakery"], ["Van Dijk"]) == ([], 1)
    # Long names don't meet by single elements.
    rarity = np.zeros(names.BUCKETS, np.int64)
    a, b = (names.keys_of(names.parse(n, frozenset()), rarity, frozenset(), k) for n, k in (("Zorbinalto", True), ("Xezorbupemil", False)))
    assert len(names.elements_of(("zorbinalto",)) & names.elements_of(("xezorbupemil",))) == 1
    assert not set(a) & set(b)


def test_keys_miss_no_name_of_any_size():
    rng = random.Random(11)
    stems = ["".join(rng.choice("aeiou" if i % 2 else "bdkmrtvz") for i in range(n)) for n in range(3, 10) for _ in range(12)]

    def slipped(word):
        k = rng.randrange(1, len(word))
        return rng.choice([word[:k] + word[k + 1 :], word[:k] + "x" + word[k:], word[:k] + "q" + word[k + 1 :], word[: k - 1] + word[k - 1 : k + 1][::-1] + word[k + 1 :]])

    known = stems + [f"{a} {b}" for a, b in zip(stems, stems[5:])] + [a + b for a, b in zip(stems[:40], stems[7:])]
    typed = [slipped(n) for n in known for _ in range(3)] + [n.replace(" ", "") for n in known] + [f"{n[:3]} {n[3:]}" for n in known if len(n) > 5 and " " not in n]
    # A chance abbreviation of a trade isn't meant here.
    known, typed = ([n for n in x if (p := names.parse(n, frozenset())) and not p.trade and not p.given] for x in (known, typed))
    missed, linked = _missed(known, typed)
    assert linked > 400
    assert not missed


def test_spellings_of_one_business_make_no_trade(spark):
    def slipped(i):
        k = i % 8
        return "quixtarn"[:k] + chr(97 + i // 8) + "quixtarn"[k:]

    hot = [("https://hot.com/", f"Zorbinal {slipped(i)} Bakery") for i in range(120)] + [("https://hot.com/", "Zorbinal Bakery"), ("https://hot.com/", "Zorbinal Quixtarn Bakery")]
    spread = [(f"https://s{i}.com/", f"{a}{b} Sawmill") for i, (a, b) in enumerate(itertools.product(("Mandel", "Kroviz", "Pextum", "Lubrik"), ("dorf", "heim", "berg", "tal", "wick")))]
    leads = spark.createDataFrame(hot + spread, "website string, business_name string")
    candidates = spark.createDataFrame([(1, "Zorbnal Bakery"), (2, "Mandeldorf")], "candidate_id long, name string")
    own = leads.selectExpr("website AS site", "business_name AS name")
    common = names._common_words(own.select("name").distinct(), own)[0]
    assert "zorbinal" not in common
    assert "sawmill" in common
    found = {(r.site, r.candidate_id) for r in names.link_names(leads, candidates).collect()}
    assert found == {("hot.com", 1), ("s0.com", 2)}


def test_rare_and_frequent_elements_meet(monkeypatch):
    """Names share a key wherever the bound between rare and frequent elements lies among their counts."""
    rng = random.Random(3)
    stems = ["".join(rng.choice("aeiou" if i % 2 else "bdkmrtvz") for i in range(n)) for n in (7, 8, 9, 10) for _ in range(15)]
    known = [f"{a} {b}" for a, b in zip(stems, stems[7:])]
    typed = [n[:k] + "q" + n[k + 1 :] for n in known for k in (2, 5)] + [n[:4] + n[5:-1] for n in known]
    counts = np.random.default_rng(2).integers(1, 400, names.BUCKETS)
    a, b = ([names.parse(n, frozenset()) for n in x] for x in (known, typed))
    for few in (0, 50, 200, 1000):
        monkeypatch.setattr(names, "FEW", few)
        keys_a, keys_b = ([set(names.keys_of(n, counts, frozenset(), k)) for n in x] for x, k in ((a, True), (b, False)))
        linked = 0
        for (x, kx), (y, ky) in itertools.product(zip(a, keys_a), zip(b, keys_b)):
            xs, ys = names.elements_of(x.rare), names.elements_of(y.rare)
            if len(xs & ys) >= names.LEAST * len(xs | ys) and names.similarity(y, x, lambda w: 1.0) > 0:
                linked += 1
                assert kx & ky, (few, x, y)
        assert linked > 100


def test_words_and_those_run_together_share_keys():
    """Names that meet by words, and words with two of a longer name, against a comparison of all."""
    rng = random.Random(4)

    def slipped(word, times):
        for _ in range(times):
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abx") + word[k:], word[:k] + rng.choice("abq") + word[k + 1 :], word[:k] + word[k : k + 2][::-1] + word[k + 2 :]]) or "x"
        return word

    stems = ["".join(rng.choice("aeiou" if i % 2 else "bdk") for i in range(n)) for n in range(1, 20) for _ in range(4)]
    words = sorted({slipped(w, t) for w in stems for t in (0, 1, 2, 2)})
    typed, known = ({w: set(names.word_keys(w, k)) for w in words} for k in (False, True))
    near = [(x, y) for x in words for y in words if x == y or names.slips(x, y, 2) <= names._allowed(y)]
    assert len(near) > len(words)
    assert not [(x, y) for x, y in near if not typed[x] & known[y]]
    # Chance brings few other pairs together.
    assert sum(bool(typed[x] & known[y]) for x in words for y in words) < 3 * len(near)
    linked = 0
    for y, z in [(rng.choice(stems), rng.choice(stems)) for _ in range(1500)]:
        whole = slipped(rng.choice((y + z, z + y)), rng.choice((0, 1, 2, 2)))
        if min(names.slips(whole, y + z, 2), names.slips(whole, z + y, 2)) <= min(2, names._allowed(y + z)):
            linked += 1
            for k in (True, False):
                for one, many in (((whole,), (y, z)), ((whole, "foo"), ("bar", y, "foo", z))):
                    assert {*names.joined_keys(one, k)} & {*names.joined_keys(many, not k)}, (one, many)
    assert linked > 1000


def test_names_of_two_words_have_few_keys():
    """Keys of a name don't grow with the table, and chance letters bring no long names together."""
    assert len(names.word_keys("zorbinalto", True)) < 60
    assert len(names.joined_keys(("zorbinalto", "quixtarn"), True)) < 100
    assert not {*names.word_keys("zorbinalto", False)} & {*names.word_keys("xezorbupe", True)}


def test_links_of_all_kinds_of_names(spark):
    """Swapped, joined, split and longer names, and words that another name has for its trade."""
    known = ["Zorbinal Quixtarn", "Mandelkro Pextum Bakery", "Lubrikdorf", "Vandorsti Hekmulta Krovizan", "Trelgona Ferry Boating"]
    typed = ["Quixtarm Zorbinla", "Zorbinalquixtarn", "Pextum Mandlekro", "Lubrik Dorf", "Vandorstihekmulta Krovizan", "Hekmulta Krovizn Vandorsti", "Trelgona Boat", "Zorbinal Mandelkro"]
    leads = spark.createDataFrame([(f"https://s{i}.com/", n) for i, n in enumerate(known)], "website string, business_name string")
    candidates = spark.createDataFrame(list(enumerate(typed)), "candidate_id long, name string")
    found = {(r.site, r.candidate_id) for r in names.link_names(leads, candidates).collect()}
    wanted = set()
    for i, k in enumerate(known):
        for j, t in enumerate(typed):
            x, y = (names.parse(n, frozenset()) for n in (t, k))
            xs, ys = names.elements_of(x.rare), names.elements_of(y.rare)
            if len(xs & ys) >= names.LEAST * len(xs | ys) and names.similarity(x, y, lambda w: 1.0) > 0:
                wanted.add((f"s{i}.com", j))
    assert len(wanted) >= 6
    assert found == wanted
