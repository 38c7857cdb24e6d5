"""Every operator has a defined result for nulls, empty tables, blank and very long texts, ties, repeated rows and extra columns."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siteloom.llm import abuse, addresses, bpe, encoding, leaks, lookalikes, names, places, residue, survivors

LONG = "word and another word, " * 20_000
EXTRA = {c: "x" for c in ("key", "site", "id", "n", "at", "rank", "known", "best", "source", "signature", "score", "_order", "e", "l", "similarity", "form", "b", "location", "length")}


def extended(df, *keep):
    """``df`` with columns whose names an operator might use for its own."""
    return df.select("*", *(F.lit(v).alias(c) for c, v in EXTRA.items() if c not in df.columns and c not in keep))


def twice(df):
    return df.unionByName(df)


def at(day, hour=0):
    return datetime(2024, 3, day, hour, tzinfo=UTC)


# ------------------------------------------------------------------ 1


LEAD = "lead_id long, website string, business_name string, description string, language string, emails array<string>, first_seen timestamp, last_seen timestamp, created_at timestamp"


def test_survivors(spark):
    data = [
        (1, "https://a.com/", None, "short text", "en", ["x@a.com"], at(2), at(5), at(9)),
        (2, "http://www.A.com/x", None, "a longer description", "fr", ["x@a.com", "X@a.com ", None, "y@a"], at(3), at(12), at(9)),
        (3, "https://a.com/", None, None, None, None, None, None, None),
        (4, "https://a.com/", None, " ", None, [], datetime(1970, 1, 1, tzinfo=UTC), at(5), at(9)),
        (5, "https://b.com/", None, "alone", None, None, None, None, None),
        (6, None, None, "of no site", None, None, None, None, None),
        (7, "https://c.com/", None, LONG, "en", None, None, None, None),
        (8, "https://c.com/", None, LONG, "en", None, None, None, None),
        (9, "https://d.com/", None, None, None, None, None, None, None),
        (10, "https://d.com/", None, None, None, None, None, None, None),
    ]
    df = extended(twice(spark.createDataFrame(data, LEAD)))
    assert rows(survivors.survivors(df)) == [("a.com", "description", 2), ("a.com", "emails", 1), ("a.com", "first_seen", 1), ("a.com", "last_seen", 1), ("c.com", "description", 7)]
    (a, c) = survivors.surviving_records(df).orderBy("site").collect()
    assert (a.description, a.language, a.emails, a.first_seen.day, a.last_seen.day) == ("a longer description", "fr", ["x@a.com"], 2, 5)
    assert c.description == LONG
    assert survivors.survivors(spark.createDataFrame([], LEAD)).count() == 0


def test_bundles_of_addresses_keep_functional_dependencies(spark):
    leads = spark.createDataFrame([(i, f"https://{s}.com/", None, f"text number {i} of a real shop", "en", ["x@a.com"], at(2), at(5), at(9)) for i, s in enumerate("aabbcc")], LEAD)
    usual = [(100 + i, 99, "Side 1", "Lyon", "Rhone", "69001", "France", None) for i in range(4)] + [(110 + i, 99, "Side 1", "Nice", "Azur", "06000", "France", None) for i in range(4)]
    own = [
        # The street's code is of Lyon, so the fuller place in Nice can't be its own.
        (1, 0, "Main 5", None, None, "69001", None, None), (2, 1, None, "Nice", "Azur", None, "France", None), (3, 1, None, "lyon", "Rhone", None, "France", None),
        # A city in another region than all others have it in makes no bid.
        (4, 2, "Oak 1", "Nice", "Rhone", None, "France", None), (5, 3, "Oak 1", "Nice", "Azur", None, None, None),
        # Nothing fits: the more trusted stays, the other is left out.
        (6, 4, "Elm 1", None, None, "06000", None, None), (7, 5, None, "Lyon", "Rhone", None, "France", None),
    ]
    places = spark.createDataFrame(usual + own, "address_id long, lead_id long, street string, city string, region string, postal_code string, country string, formatted string")
    found = {(r.site, r.bundle): r.lead_id for r in survivors.survivors(leads, extended(twice(places))).collect()}
    assert {k: v for k, v in found.items() if k[1] in ("place", "street")} == {("a.com", "place"): 3, ("a.com", "street"): 1, ("b.com", "place"): 5, ("b.com", "street"): 4, ("c.com", "place"): 7}
    records = {r.site: r for r in survivors.surviving_records(leads, places).collect()}
    assert (records["a.com"].street, records["a.com"].postal_code, records["a.com"].city) == ("Main 5", "69001", "lyon")
    assert records["c.com"].street is None
    assert survivors.survivors(leads, places.limit(0)).filter("bundle IN ('place', 'street')").count() == 0


def test_more_bids_are_asked_for_until_a_choice_is_certain(spark):
    """The only place that fits the streets is far behind, beyond what is kept at first."""
    names = "bdfgklmnprst"
    leads = spark.createDataFrame([(i, "https://a.com/", None, None, None, None, at(2), at(5), at(9)) for i in range(40)], LEAD)
    full = [(i, i, None, f"Town{names[i]}", "R", None, "C", None) for i in range(12)]
    rest = [(20, 20, "Main 1", None, None, "11111", None, None), (21, 21, None, "Fits", None, None, None, None)]
    usual = [(100 + i, 999, "x 1", "Fits", None, "11111", None, None) for i in range(5)]
    places = spark.createDataFrame(full + rest + usual, "address_id long, lead_id long, street string, city string, region string, postal_code string, country string, formatted string")
    found = {r.bundle: r.lead_id for r in survivors.survivors(leads, places).collect()}
    assert (found["place"], found["street"]) == (21, 20)


def test_contradicting_dates_stand_for_themselves(spark):
    data = [(1, "https://a.com/", None, None, None, None, at(20), at(3), at(30)), (2, "https://a.com/", None, None, None, None, at(21), at(4), at(30))]
    assert rows(survivors.survivors(spark.createDataFrame(data, LEAD))) == [("a.com", "first_seen", 1), ("a.com", "last_seen", 2)]


# ------------------------------------------------------------------ 2, 4


VALUE = "table_name string, row_id long, source string, field_name string, text string"


def garble(text, *chain):
    for encoding_ in chain:
        text = text.encode("utf-8").decode(encoding_)
    return text


PLAIN = ["Café Zürich öffnet früh", "Über die Brücke nach Köln", "Crème brûlée à la carte", "Größe und Qualität für Sie", "déjà vu près de l'hôtel", "Straße, Bäckerei, Söhne"]


def test_garbled(spark):
    data = [("t", i, "h", "title", t) for i, t in enumerate(PLAIN * 20)]
    data += [("t", 1000, "h", "title", garble(PLAIN[0], "cp1252")), ("t", 1001, None, "title", garble(PLAIN[2], "cp1252", "cp1252"))]
    data += [("t", 1002, "h", "title", None), ("t", 1003, "h", "title", ""), ("t", 1004, "h", "title", " "), ("t", 1005, "h", "title", LONG), ("t", 1006, "h", "title", garble(PLAIN[3], "cp1252") + " " + LONG)]
    df = extended(twice(spark.createDataFrame(data, VALUE)))
    found = {r.row_id: (r.chain, r.restored) for r in encoding.find_garbled(df).collect()}
    assert found == {1000: ("cp1252", PLAIN[0]), 1001: ("cp1252+cp1252", PLAIN[2]), 1006: ("cp1252", PLAIN[3] + " " + LONG)}
    assert encoding.find_garbled(spark.createDataFrame([], VALUE)).count() == 0


def test_lookalikes(spark):
    texts = {1: None, 2: "", 3: " ", 4: LONG, 5: "Привет, мир", 6: "Café", 7: "Café", 8: "pаypal", 9: "a​b", 10: "a b", 11: "Ａcme", 12: "é" + LONG, 13: "کتاب می‌خوانم", 14: "كتاب فارسی"}
    data = [("t", i, "h", "f", t) for i, t in texts.items()]
    df = extended(twice(spark.createDataFrame(data, VALUE)), "form")
    found = {r.row_id: r.form for r in lookalikes.find_lookalikes(df).collect()}
    assert found == {7: "Café", 8: "paypal", 9: "ab", 10: "a b", 11: "Acme", 14: "کتاب فارسی"}
    garbled = df.filter("row_id = 7")
    assert 7 not in {r.row_id for r in lookalikes.find_lookalikes(df, garbled).collect()}
    assert lookalikes.find_lookalikes(df.limit(0), df.limit(0)).count() == 0
    assert [r[0] for r in df.filter("row_id IN (1, 9)").distinct().orderBy("row_id").select(lookalikes.unified(F.col("text"))).collect()] == [None, "ab"]


# ------------------------------------------------------------------ 3


PLACE = "place_id long, kind string, name string, code string, parent_id long"
PLACES = [(1, "country", "France", "FR", None), (2, "country", "United States", "US", None), (3, "region", "Texas", "TX", 2), (4, "city", "Paris", None, 1), (5, "city", "Paris", None, 3), (6, "city", "Lyon", None, 1), (7, "city", "Munich", None, 1)]
ADDRESS = "address_id long, street string, city string, region string, country string, postal_code string, formatted string"


def test_places(spark):
    data = [
        (1, None, "paris", None, "France", None, None),
        (2, None, "Pariss", "TX", "us", None, None),
        (3, None, None, None, None, None, None),
        (4, None, " ", "", "\t", None, None),
        (5, None, "Atlantis", None, "france", None, None),
        (6, None, LONG, None, None, None, None),
        (7, None, "Paris", "Texas", "United States", None, None),
    ]
    df, reference = extended(twice(spark.createDataFrame(data, ADDRESS))), twice(spark.createDataFrame(PLACES, PLACE))
    found = {(r.address_id, r.field_name): r.place_id for r in places.map_places(df, extended(reference)).collect()}
    assert found == {(1, "city"): 4, (2, "city"): 5, (2, "region"): 3, (2, "country"): 2, (5, "city"): 0, (5, "country"): 1, (6, "city"): 0}
    none = {r.place_id for r in places.map_places(df, reference.limit(0)).collect()}
    assert none == {0}
    assert places.map_places(df.limit(0), reference).count() == 0


def test_places_give_the_same_whatever_the_number_of_blocks(spark, monkeypatch):
    """Slips, own words with one owner or two, codes, cities of two countries, and what is in no list."""
    import random

    rnd = random.Random(7)
    names = ["".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(3)).title() for _ in range(60)]
    lists = [(i, "country", n, n[:2].upper() + str(i) if i % 2 else n[:2].upper(), None) for i, n in enumerate(names[:6])]
    lists += [(10 + i, "region", f"{rnd.choice(['North', 'Port', 'Upper'])} {n}", None, i % 6) for i, n in enumerate(names[6:30])]
    lists += [(100 + i, "city", f"{rnd.choice(['New ', 'Port ', '', 'Mount '])}{n}", None, 10 + i % 24) for i, n in enumerate(names[6:60] + names[20:35])]
    typed = []
    for i in range(300):
        values = []
        for kind in ("country", "region", "city"):
            text = rnd.choice([x for x in lists if x[1] == kind])[2 if rnd.random() < 0.9 else 3] or "Nowhere"
            at = rnd.randrange(len(text))
            values.append(rnd.choice([text, text.upper(), text[:at] + text[at + 1 :], text.split()[-1], "x" + text[::-1], None, " ", f"{text} (region)"]))
        typed.append((i, *values))
    reference = spark.createDataFrame(lists, PLACE)
    df = spark.createDataFrame(typed, "address_id long, country string, region string, city string")
    whole = rows(places.map_places(df, reference))
    assert len({r[3] for r in whole}) > 20
    for block in (7, 40):
        monkeypatch.setattr(places, "BLOCK", block)
        assert rows(places.map_places(df, reference)) == whole


def test_places_in_blocks(spark, monkeypatch):
    data = [(1, None, "pariss", None, "France", None, None), (2, None, "lyons", None, None, None, None), (3, None, "munick", None, None, None, None), (4, None, "Atlantis", None, "france", None, None)]
    df, reference = spark.createDataFrame(data, ADDRESS), spark.createDataFrame(PLACES, PLACE)
    whole = rows(places.map_places(df, reference).select("address_id", "field_name", "place_id"))
    monkeypatch.setattr(places, "BLOCK", 2)
    assert rows(places.map_places(df, reference).select("address_id", "field_name", "place_id")) == whole


# ------------------------------------------------------------------ 5


def test_names(spark):
    lead = [("https://a.com/", "Zorbinal Bakery"), ("https://www.a.com/x", "Zorbinal Bakery Ltd"), ("https://b.com/", "Quixtar Plumbing"), (None, "Zorbinal Bakery"), ("https://c.com/", None), ("https://c.com/", " "), ("https://d.com/", LONG[:100_000])]
    other = [(1, "zorbinal bakery"), (2, "Zorbnal Bakery"), (3, "Bakery Zorbinal Inc."), (4, None), (5, ""), (6, "Zorbinal Plumbing"), (7, LONG[:90_000]), (8, "Quixtar"), (9, "Nothing Alike Here"), (1, "zorbinal bakery")]
    leads, candidates = spark.createDataFrame(lead, "website string, business_name string"), spark.createDataFrame(other, "candidate_id long, name string")
    found = {(r.site, r.candidate_id) for r in names.link_names(extended(twice(leads)), extended(candidates)).collect()}
    assert {("a.com", 1), ("a.com", 2), ("a.com", 3), ("b.com", 8)} <= found
    assert not {i for _, i in found} & {4, 5, 6, 9}
    assert names.link_names(leads.limit(0), candidates).count() == 0
    assert names.link_names(leads, candidates.limit(0)).count() == 0


# ------------------------------------------------------------------ 6


def test_addresses(spark):
    data = [
        (1, "12 Main Street", "Springfield", None, None, "12345", None),
        (2, "12 Main St.", "springfield", None, None, "12345", None),
        (3, "12 Main Street, Suite 4", "Springfeld", None, None, None, None),
        (4, "12a Main Street", "Springfield", None, None, "12345", None),
        (5, "12 Main Avenue", "Springfield", None, None, "12345", None),
        (6, "12 Main Street", "Shelbyville", None, None, None, None),
        (7, None, None, None, None, None, None),
        (8, "", " ", "", "", "", ""),
        (9, "12 Main Street", None, None, None, None, None),
        (10, LONG, LONG, None, None, None, LONG),
        (11, None, None, None, None, None, "12 Main Street, Springfield, 12345"),
    ]
    # Evidence that St. stands for Street.
    data += [(100 + 2 * i + k, f"{i} {n} {s}", "Springfield", None, None, None, None) for i, n in enumerate("Oak Elm Ash Lake Hill".split(), 1) for k, s in enumerate(("Street", "St."))]
    df = extended(twice(spark.createDataFrame(data, ADDRESS)))
    located = addresses.locate(df)
    assert located.count() == located.select("address_id").distinct().count()
    assert not {r.address_id for r in located.collect()} & {7, 8, 9}
    assert rows(addresses.same_location(located.filter("address_id < 100"))) == [(1, 11), (1, 2), (1, 3), (2, 11), (2, 3), (3, 11)]
    assert addresses.locate(df.limit(0)).count() == 0


def test_components(spark):
    pairs = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 1), (20, 21), (21, 22)], "a long, b long")
    found = {}
    for r in addresses.components(pairs).collect():
        found.setdefault(r.location, set()).add(r.id)
    assert found == {1: {1, 3, 4, 5, 9}, 20: {20, 21, 22}}


# ------------------------------------------------------------------ 7


def test_residue(spark):
    kind = "metadata_id long, page_id long, title string, description string, canonical_url string, og_url string, favicon_url string"
    good = ["Fresh bread every morning in our bakery", "We repair roofs and gutters all year", "A family hotel by the lake", "Legal advice for small firms", "How to write an error page", "Our placeholder art collection"]
    bad = ["404 Not Found", "Please enable JavaScript to continue", "Lorem ipsum dolor sit amet", "{{page_title}}", "Just another WordPress site"]
    data = [(i, i, t, d, f"https://h{i % 40}.com/", None, None) for i, (t, d) in enumerate(zip((good + bad) * 40, (good + bad) * 40))]
    metadata = spark.createDataFrame([*data, (9001, None, None, None, None, None, None), (9002, 1, "", " ", None, None, None), (9003, 1, LONG, LONG + bad[1], None, None, None)], kind)
    leads = spark.createDataFrame([(1, None, None, None, None, None, None, None, None)], LEAD)
    df = extended(twice(metadata))
    model = residue.train(df, leads)
    found = {(r.row_id, r.field_name) for r in residue.find_residue(df, {"title": True, "description": False}, model, row_id="metadata_id", name="t").collect()}
    expected = {(i, f) for i, (t, _) in enumerate(zip((good + bad) * 40, data)) if t in bad for f in ("title", "description")}
    assert found == expected | {(9003, "description")}
    empty = residue.train(metadata.limit(0), leads.limit(0))
    assert residue.find_residue(metadata, {"title": True}, empty, row_id="metadata_id", name="t").count() == 0
    assert residue.find_residue(metadata.limit(0), {"title": True}, model, row_id="metadata_id", name="t").count() == 0


# ------------------------------------------------------------------ 8


def test_encoding_of_a_corpus(spark):
    data = [(1, None), (2, ""), (3, " "), (4, "Hello world"), (5, LONG), (6, "a" * 30_000), (7, "<|endoftext|>"), (4, "Hello world")]
    df = extended(spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit("old")))
    found = bpe.encode_corpus(df)
    assert found.columns.count("ids") == 1
    ids = {r.doc_id: r.ids for r in found.collect()}
    assert found.count() == 8
    assert ids[1] == ids[2] == []
    assert len(ids[3]) == 1
    assert len(ids[7]) > 1
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 9


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    data = [(1, "x " + item.upper().replace(" ", ", ")), (2, None), (3, ""), (4, "one two three four five six seven eight nine ten eleven"), (5, LONG + item + LONG), (6, "<b>" + item.replace(" ", "</b>\n<i>")), (7, "...")]
    df = extended(twice(spark.createDataFrame(data, "doc_id long, text string")))
    items = extended(twice(spark.createDataFrame([(10, item), (11, "zero " + item), (12, None), (13, ""), (14, "too short")], "item_id long, text string")))
    assert rows(leaks.find_leaks(df, items)) == [(d, i) for d in (1, 5, 6) for i in (10, 11)]
    (span,) = leaks.leaked_spans(df.filter("doc_id = 1"), items).collect()
    assert (span.start, span.stop, sorted(set(span["items"]))) == (2, len(data[0][1]), [10, 11])
    assert leaks.find_leaks(df, items.limit(0)).count() == 0
    assert leaks.find_leaks(df.limit(0), items).count() == 0


# ------------------------------------------------------------------ 10


def test_abuse(spark):
    bad = [f"you are a worthless grobnik {w} and everyone hates you" for w in "idiot fool clown pig rat liar cheat swine".split()]
    good = [f"the {w} opens at nine and serves warm food to every guest" for w in "cafe bar inn hotel shop mill farm dock".split()]
    labels = spark.createDataFrame([(t, 1) for t in bad] * 4 + [(t, 0) for t in good] * 4 + [(None, 1), ("x", None), ("", 0)], "text string, abusive int")
    data = [(1, "a", None), (2, "a", ""), (3, "b", "  "), (4, "b", LONG), (5, None, bad[0]), (6, "a", LONG + ". " + bad[1] + ". " + LONG), (7, "a", good[0]), (8, "a", "x" * 100_000), (5, None, bad[0])]
    df = extended(spark.createDataFrame(data, "doc_id long, source string, text string")).withColumn("abusive", F.lit("old"))
    scored = abuse.score_documents(df, labels)
    assert scored.columns.count("abusive") == scored.columns.count("score") == 1
    found = {r.doc_id: r.abusive for r in scored.collect()}
    assert scored.count() == 9
    assert found == {1: False, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False, 8: False}
    assert {r.source: (r.documents, r.abusive) for r in abuse.abuse_rates(scored).collect()} == {"a": (5, 1), "b": (2, 0), None: (2, 2)}
    assert abuse.score_documents(df, labels.limit(0)).filter("abusive").count() == 0
    assert abuse.score_documents(df.limit(0), labels).count() == 0


@pytest.mark.parametrize("most", [1])
def test_labels_are_bounded(spark, monkeypatch, most):
    monkeypatch.setattr(abuse, "MAX_LABELS", most)
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "text string, abusive int")
    with pytest.raises(ValueError, match="labelled"):
        abuse.read_labels(labels)


def test_ordinary_sentences_of_abusive_labels_are_told_by_the_corpus(spark):
    """A sentence that only abusive labels hold is ordinary if the corpus holds it as often; no label has the scored ones."""
    usual = "we close on monday and open every other day at nine"
    bad = [f"you are a worthless grobnik {w} and everyone hates you" for w in "idiot fool clown pig rat liar cheat swine".split()]
    good = [f"the {w} serves warm food to every guest who likes it" for w in "cafe bar inn hotel shop mill farm dock".split()]
    labels = spark.createDataFrame([(f"{usual}. {t}", 1) for t in bad] * 4 + [(t, 0) for t in good] * 4, "text string, abusive int")
    data = [(i, f"{usual}. page {i}") for i in range(200)] + [(200, "hello there, you worthless grobnik pig and liar")]
    found = abuse.score_documents(spark.createDataFrame(data, "doc_id long, text string"), labels).filter("abusive").collect()
    assert [r.doc_id for r in found] == [200]
    tenfold = abuse.score_documents(spark.createDataFrame(data * 10, "doc_id long, text string"), labels).filter("abusive").distinct().collect()
    assert [r.doc_id for r in tenfold] == [200]


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    """Items far beyond a block, one longer than it, give the rows and spans of a single block."""
    words = [f"w{i}" for i in range(400)]
    items = spark.createDataFrame([(i, " ".join(words[i * 20 : i * 20 + 30])) for i in range(15)] + [(99, " ".join(words)), (100, None)], "item_id long, text string")
    docs = spark.createDataFrame([(d, "x y " + " ".join(words[d * 9 : d * 9 + 12 + d]) + " z") for d in range(40)], "doc_id long, text string")
    whole, spans = rows(leaks.find_leaks(docs, items)), rows(leaks.leaked_spans(docs, items))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 100)
    assert rows(leaks.find_leaks(docs, items)) == whole
    assert rows(leaks.leaked_spans(docs, items)) == spans
    assert {(d, 99) for d in range(40)} <= set(whole)
