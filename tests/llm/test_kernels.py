"""The kernels against plain ones: brute force, exact round trips, other implementations, held-out accuracy."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest
import tiktoken
from conftest import DATA, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from siteloom.llm import abuse, addresses, bpe, encoding, forms, leaks, names, places, queries, survivors

VOCABULARY = f"{bpe.VOCABULARIES}/byte_bpe_50k.tiktoken"

# ------------------------------------------------------------------ 1


@given(st.lists(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 9)), max_size=4), min_size=1, max_size=4))
def test_branch_and_bound_is_exact(bids):
    bids = [sorted(b, reverse=True) for b in bids]

    def consistent(chosen):
        return sum(c for c in chosen if c is not None) % 3 != 1 or len(chosen) < len(bids)

    found = survivors.branch_and_bound(bids, consistent)
    every = [c for c in itertools.product(*(b or [(0.0, None)] for b in bids)) if consistent([x[1] for x in c])]
    best = max((sum(x[0] for x in c) for c in every), default=None)
    assert (found is None) == (best is None)
    if found:
        assert found[0] == pytest.approx(best)


# ------------------------------------------------------------------ 2


@given(st.text(alphabet="éüßñçøÅ€„“ابتсдж abc", min_size=1, max_size=20), st.lists(st.sampled_from(["cp1252", "latin-1", "cp1251", "mac_roman", "cp437"]), min_size=1, max_size=3))
def test_chains_are_undone(text, chain):
    try:
        garbled = text
        for c in chain:
            garbled = garbled.encode("utf-8").decode(c)
    except UnicodeDecodeError:
        return
    for c in reversed(chain):
        garbled = encoding.undo_utf8(garbled, c)
    assert garbled == text


def test_evidence_of_others_decides_weak_cases():
    weak, strong = encoding.posterior, encoding.expectation_maximisation
    evidence = "cp1252:1"
    alone = strong({evidence: 1.0}, 10_000.0)
    pooled = strong({evidence: 1.0, "cp1252:12": 400.0}, 9_600.0)
    assert weak(evidence, alone)[0] < weak(evidence, pooled)[0]


# ------------------------------------------------------------------ 3


def test_prefixes_miss_no_similar_entry():
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioubdnrst") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    rarity = np.array([rng.randint(0, 50) for _ in range(1 << 16)])
    reference = places.Reference([(i, w.title(), None) for i, w in enumerate(words)], rarity)
    for w in words[:150]:
        typed = w[:2] + rng.choice("xyz") + w[3:]
        pairs = places.pairs_of([typed])
        whole = {k for k, e in enumerate(reference.entries) if len(pairs & e.pairs) / len(pairs | e.pairs) >= places.THRESHOLD}
        found = reference.candidates(pairs)
        assert {k for _, k in found} == whole
        assert all(s == len(pairs & reference.entries[k].pairs) / len(pairs | reference.entries[k].pairs) for s, k in found)


def _distance(a, b):
    """Edit distance with swaps of neighbours, the plain way."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 3))
def test_slips(a, b, most):
    assert places.slips(a, b, most) == min(_distance(a, b), most + 1)


# ------------------------------------------------------------------ 4


def test_the_table_has_no_conflicts_and_forms_are_stable():
    table = forms.compile_table()
    assert len(table) > 1000
    for source in table:
        once = forms.unify(source)
        assert forms.unify(once) == once, source


@settings(max_examples=300)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=30))
def test_unify_is_idempotent(text):
    once = forms.unify(text)
    assert forms.unify(once) == once


@given(st.text(alphabet="abcdefgh ABC.,-123é", max_size=30))
def test_plain_text_keeps_its_form(text):
    assert forms.unify(text) == text


@pytest.mark.parametrize(
    ("text", "form"),
    [("\u0430 bakery", "a bakery"), ("\u0430 bakery \u0438 \u0444", "\u0430 bakery \u0438 \u0444"), ("\u1112\u1161\u11ab", "\ud55c"), ("\u0420\u043e\u0441\u0441\u0438\u044fa", "\u0420\u043e\u0441\u0441\u0438\u044f\u0430"),
     ("\u0915\u094d\u0937", "\u0915\u094d\u0937"), ("\U0001f469\u200d\U0001f680", "\U0001f469\u200d\U0001f680"), ("\u0646\u0645\u0648\u0646\u0647\u200c\u0643\u0627\u0631", "\u0646\u0645\u0648\u0646\u0647\u200c\u06a9\u0627\u0631"), ("\u1e9a\u0301", "\u1e9a\u0301"),
     ("\u0647\u0645 \u0645\u06cc\u200c...", "\u0647\u0645 \u0645\u06cc\u200c..."), ("caf\u00e9\u200c...", "caf\u00e9..."), ("\u0645\u06cc\u200c x", "\u0645\u06cc x")],
)
def test_forms_by_cluster_and_script(text, form):
    assert forms.unify(text) == form


def test_conflicting_rules_are_refused(monkeypatch):
    monkeypatch.setitem(forms.GREEK, "\u0410", "X")  # a Cyrillic letter with another form
    with pytest.raises(forms.Conflict):
        forms.compile_contexts(forms.compile_table())


# ------------------------------------------------------------------ 5


def test_keys_miss_no_similar_name():
    rng = random.Random(7)
    stems = ["".join(rng.choice(["ba", "ri", "to", "lu", "ken", "zor", "mi", "pex"]) for _ in range(3)) for _ in range(40)]
    trades = ["bakery", "plumbing", "brewery"]

    def spelled(stem, trade):
        way = rng.randrange(5)
        name = stem[:3] + stem[4:] if way == 0 else stem[:2] + "x" + stem[2:] if way == 1 else stem
        return {2: f"{trade} {name}", 3: name, 4: f"{name} {trade[:4]}."}.get(way, f"{name} {trade} ltd")

    known = [f"{s} {rng.choice(trades)}" for s in stems] + ["alpha " + " ".join(stems[i : i + 20]) for i in range(4)]
    typed = [spelled(*n.split()[:2]) for n in known[:40] for _ in range(4)] + [n.replace("zor", "zro", 1) for n in known[40:]]
    rarity = np.zeros(names.BUCKETS, np.int64)
    a, b = [names.parse(n, frozenset()) for n in known], [names.parse(n, frozenset()) for n in typed]
    keys_a, keys_b = [set(names.keys_of(n, rarity, frozenset(), True)) for n in a], [set(names.keys_of(n, rarity, frozenset(), False)) for n in b]
    missed, linked = [], 0
    for (x, kx), (y, ky) in itertools.product(zip(a, keys_a), zip(b, keys_b)):
        xs, ys = names.elements_of(x.rare), names.elements_of(y.rare)
        if len(xs & ys) >= names.THRESHOLD * len(xs | ys) and names.similarity(y, x, lambda w: 1.0) > 0:
            linked += 1
            if not kx & ky:
                missed.append((x, y))
    assert linked >= 160
    assert not missed


# ------------------------------------------------------------------ 6


@given(st.text("abcd", min_size=1, max_size=6), st.text("abcd", min_size=1, max_size=8))
def test_abbreviations_come_from_their_word(short, long):
    if addresses.abbreviates(short, long):
        left = iter(long)
        assert all(c in left for c in short)


# ------------------------------------------------------------------ 8


def _plain_bpe(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.fixture(scope="module")
def ranks():
    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary here")
    with open(VOCABULARY, "rb") as file:
        return bpe.read_ranks(file.read())


def test_segment_tree_equals_plain_merging(ranks):
    rng = random.Random(1)
    for _ in range(400):
        piece = bytes(rng.choice(b"abcdeinrst  \xc3\xa9\xd8\xa7") for _ in range(rng.randint(1, 40)))
        assert bpe.merge(piece, ranks) == _plain_bpe(piece, ranks)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_encoding_equals_a_known_one_and_decodes(ranks, text):
    known = tiktoken.Encoding("public", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    ids = bpe.encoder(ranks)(text)
    assert ids == known.encode(text, disallowed_special=())
    assert known.decode(ids) == text


# ------------------------------------------------------------------ 9


def test_suffix_array_and_index():
    rng = np.random.default_rng(3)
    text = np.concatenate((rng.integers(1, 6, 400), [0])).astype(np.int64)
    order = leaks.suffix_array(text)
    assert list(order) == sorted(range(len(text)), key=lambda i: list(text[i:]))
    tree = leaks.WaveletTree(text, 6)
    for symbol, at in itertools.product(range(6), (0, 1, 17, 200, 401)):
        assert int(tree.rank(np.array([symbol]), np.array([at]))[0]) == int((text[:at] == symbol).sum())


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    item = lambda: " ".join(rng.choice("abcde") for _ in range(rng.randint(8, 30)))
    items = [(i, item()) for i in range(12)]
    docs = [(d, " ".join((rng.choice(items)[1] if rng.random() < 0.4 else item()) for _ in range(4))) for d in range(60)]
    runs = lambda text, n=leaks.PHRASE: {tuple(w[i : i + n]) for w in [text.split()] for i in range(len(w) - n + 1)}
    expected = sorted(((d, i) for d, t in docs for i, q in items if runs(t) & runs(q)), key=repr)
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found) == expected


# ------------------------------------------------------------------ 10


@pytest.mark.parametrize("text", ["Café Größe über Ænlig", "Ærø smørrebrød på bordet"])
@pytest.mark.parametrize("chain", [("cp1252", "mac_roman"), ("latin-1", "cp437"), ("cp1252", "cp1252"), ("latin-1", "latin-1", "latin-1", "latin-1"), ("cp1252", "latin-1", "mac_roman")])
def test_mixed_chains_are_rebuilt(text, chain):
    """UTF-8 misread by one encoding after another, as often as one likes."""
    garbled = text
    for encoding_ in chain:
        garbled = garbled.encode("utf-8").decode(encoding_)
    assert text in encoding.rebuilt(garbled).values()


def test_one_byte_step_within_a_chain_is_rebuilt():
    garbled = "Größe".encode("utf-8").decode("cp1252").encode("cp1252").decode("mac_roman")
    assert "Größe" in encoding.rebuilt(garbled).values()


@pytest.mark.parametrize(
    ("text", "words"),
    [("f o o l", ["fool"]), ("f00l", ["fool"]), ("idiiiiot", ["idiot"]), ("a@b.com is fine", ["is", "fine"]), ("y\u200bou", ["you"])],
)
def test_disguises_are_undone(text, words):
    assert [w for s in abuse.sentences(text) for w in s][-len(words) :] == words


# ------------------------------------------------------------------ all


needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    found = queries.queries()[name](spark, str(DATA))
    got = found.collect()
    if name.endswith("_found"):
        assert len(got) == len({tuple(r) for r in got})
    if name in queries.oracle_sql():
        import duckdb

        connection = duckdb.connect()
        for file in DATA.glob("*.parquet"):
            connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        cursor = connection.execute(queries.oracle_sql()[name])
        assert [c[0] for c in cursor.description] == found.columns
        assert sorted(map(tuple, got)) == sorted(cursor.fetchall())
