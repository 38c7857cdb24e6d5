from __future__ import annotations

import itertools
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from siteloom import schemas
from siteloom.functions import columns as C
from siteloom.operators import leads, query
from siteloom.sources import export

T = [datetime(2024, 1, d, tzinfo=UTC) for d in range(1, 9)]
KIND = schemas.LEAD + ", seq bigint"
HOME = ("acme.example", "https://acme.example/", "Acme", None, ["b@acme.example"], [("1234567", "123 45 67")], None, [("x", "https://x.com/Acme")], "homepage", "en", "https://acme.example/", T[2], T[3], 1)
ABOUT = ("acme.example", "https://www.acme.example/", "Acme Inc", "About", ["a@acme.example"], [("1234567", "1234567")], ("S", None, None, None, "FR", "S, FR"), [("x", "https://x.com/acme")],
         "about", "fr", "https://acme.example/about", T[0], T[4], 2)
CONTACT = ("acme.example", "https://acme.example/", None, "Contact", [], [], None, [], "contact", "fr", "https://acme.example/contact", None, None, 3)
OTHER = ("b.example", "https://b.example/", None, None, [], [], None, [], None, None, None, None, None, 4)


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), KIND)


def test_aggregation_knows_no_order(frame):
    results = set()
    for i, rows in enumerate(itertools.permutations((HOME, ABOUT, CONTACT))):
        results.add(str(leads.aggregate(frame(*rows, OTHER).repartition(1 + i % 3)).orderBy("domain").collect()))
    assert len(results) == 1
    acme, other = leads.aggregate(frame(HOME, ABOUT, CONTACT, OTHER)).orderBy("domain").collect()
    assert (acme.website, acme.business_name, acme.description, acme.page_type, acme.source_url) == ("https://acme.example/", "Acme", "About", "homepage", "https://acme.example/")
    assert acme.emails == ["a@acme.example", "b@acme.example"]
    assert [tuple(p) for p in acme.phones] == [("1234567", "123 45 67")]
    assert [tuple(s) for s in acme.social_profiles] == [("x", "https://x.com/Acme")]
    assert (acme.language, acme.address.country) == ("fr", "FR")
    assert (acme.first_seen.day, acme.last_seen.day) == (1, 5)
    assert (other.language, other.emails, other.first_seen) == (None, [], None)


def test_language_votes(frame):
    unknown = HOME[:9] + ("unknown",) + HOME[10:]
    assert leads.aggregate(frame(unknown, CONTACT[:9] + (None,) + CONTACT[10:])).first().language == "unknown"
    assert leads.aggregate(frame(HOME, ABOUT)).first().language == "en"  # a tie goes to the earlier page
    assert leads.aggregate(frame()).count() == 0


def test_fold_keeps_what_is_stored(frame):
    folded = leads.fold(frame(CONTACT[:13] + (1,), ABOUT[:13] + (2,), HOME[:13] + (3,))).first()
    assert (folded.description, folded.business_name, folded.page_type, folded.source_url) == ("Contact", "Acme Inc", "contact", "https://acme.example/contact")
    assert [tuple(p) for p in folded.phones] == [("1234567", "1234567")]
    assert [tuple(s) for s in folded.social_profiles] == [("x", "https://x.com/acme")]
    assert folded.language == "fr"


def test_merge_is_idempotent(frame):
    stored = leads.merge(frame(), frame(HOME, OTHER))
    assert stored.filter("changed").count() == 2
    again = leads.merge(stored.drop("changed"), frame(HOME, OTHER))
    assert again.filter("changed").count() == 0
    more = leads.merge(stored.drop("changed"), frame(ABOUT))
    assert [r.domain for r in more.filter("changed").collect()] == ["acme.example"]
    assert more.filter("domain = 'acme.example'").first().description == "About"


def test_conflicts_and_sources(frame):
    df = frame(HOME, ABOUT, CONTACT)
    found = {(r.field, r.kept, r.rejected) for r in leads.conflicts(df).collect()}
    assert found == {("business_name", "Acme", "Acme Inc"), ("description", "About", "Contact")}
    sources = {r.value: r.sources for r in leads.value_sources(df).collect()}
    assert sources["phones:1234567"] == ["https://acme.example/", "https://acme.example/about"]
    assert {r.field: r.source for r in leads.field_sources(df).collect()}["description"] == "https://acme.example/about"
    assert leads.combine(df).first().field_sources["business_name"] == "https://acme.example/"


def test_sightings_in_any_spelling(spark):
    rows = spark.createDataFrame(
        [("HTTPS://WWW.Acme.example./", " A   B ", " x ", [" B@acme.example", "b@acme.example", "x@y", None], [("1", "a"), ("1", "b")], "HomePage", " EN ", "extra"), ("mailto:x", None, None, None, None, None, None, None)],
        "website string, business_name string, description string, emails array<string>, phones array<struct<number string, raw string>>, page_type string, language string, more string",
    )
    (lead,) = leads.from_sightings(rows).collect()
    assert (lead.domain, lead.website, lead.business_name, lead.description) == ("acme.example", "https://www.acme.example/", "A B", "x")
    assert (lead.emails, [tuple(p) for p in lead.phones], lead.page_type, lead.language, lead.more) == (["b@acme.example"], [("1", "a")], "homepage", "en", "extra")


def test_validation(frame):
    bad = HOME[:4] + (["x@y"], [("12", "12")], None, [(" ", "u")], "shop", "en", None, T[3], T[1], 1)
    (row,) = leads.problems(frame(bad)).collect()
    assert len(row.problems) == 5
    assert leads.valid(frame(bad, ABOUT)).count() == 1
    with pytest.raises(Exception, match="invalid email"):
        leads.valid(frame(bad), strict=True).collect()


def test_lead_of_pages(spark):
    html = "<html lang=en><title>Acme</title><p>info@acme.example</p>"
    pages = spark.createDataFrame([(1, html, "https://www.acme.example/", T[0]), (2, html, "ftp://x", T[0]), (3, None, "https://acme.example/", T[0])], "id int, html string, url string, at timestamp")
    (lead,) = leads.from_pages(pages, seen_at="at").collect()
    assert (lead.id, lead.domain, lead.business_name, lead.emails, lead.page_type, lead.website_metadata.title) == (1, "acme.example", "Acme", ["info@acme.example"], "homepage", "Acme")
    plan = leads.from_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # however many fields are used, a page is parsed once


def test_digests(spark):
    assert C.digest_of("acme.example") == "0c4eb381f9acc6b11f7aa29aeef41da9c69dfbe8b7a4a76134125fffb92a38f0"
    assert spark.range(1).select(C.lead_digest(F.lit("acme.example"))).first()[0] == C.digest_of("acme.example")


def test_metadata_fills_only(spark):
    rows = spark.createDataFrame([("a", None, "x", 1), ("a", "t", "y", 2), ("b", None, None, 1)], "domain string, title string, keywords string, seq int")
    assert {r.domain: (r.title, r.keywords) for r in leads.fill_metadata(rows).collect()} == {"a": ("t", "x"), "b": (None, None)}


# ---------------------------------------------------------------- selection


def _domains(df):
    return [r.domain for r in df.collect()]


def test_filters(frame):
    df = frame(HOME, OTHER, ("fa.example", "https://fa.example/", "كافه", None, [], [], (None, "تهران", None, None, "ایران", None), [], "about", "fa", None, None, None, 5))
    assert _domains(query.filter_leads(df, language=["EN", " fa "])) == ["acme.example", "fa.example"]
    assert _domains(query.filter_leads(df, country="ايران")) == ["fa.example"]
    assert _domains(query.filter_leads(df, domain="HTTPS://www.acme.example/x")) == ["acme.example"]
    assert _domains(query.filter_leads(df, has_email=False)) == ["b.example", "fa.example"]
    assert _domains(query.filter_leads(df, has_social_profile=True, page_type="homepage")) == ["acme.example"]
    assert query.filter_leads(df, query.LeadFilter(has_email=True) & query.LeadFilter(has_email=False)).count() == 0
    a, b = query.LeadFilter(language=["en", "fa"]), query.LeadFilter(language=["fa", "de"], has_phone=True)
    assert (a & b) == (b & a) == query.LeadFilter(language="fa", has_phone=True)
    assert query.LeadFilter.from_dict(b.to_dict()) == b
    assert query.LeadFilter().is_empty


@pytest.mark.parametrize("bad", [{"language": []}, {"language": 3}, {"domain": " "}, {"page_type": "shop"}, {"has_email": 1}, {"country": " "}])
def test_senseless_filters(bad):
    with pytest.raises(query.QueryError):
        query.LeadFilter(**bad)
    with pytest.raises(query.QueryError):
        query.LeadFilter.from_dict({"colour": "red"})


def test_order_and_pages(frame, monkeypatch):
    late = OTHER[:12] + (T[7], 4)
    df = frame(HOME, late, *((f"n{i}.example", f"https://n{i}.example/", None, None, [], [], None, [], None, None, None, None, None, i) for i in range(3)))
    assert _domains(query.sort_leads(df, "last_seen")) == ["acme.example", "b.example", "n0.example", "n1.example", "n2.example"]
    assert _domains(query.sort_leads(df, "last_seen", True)) == ["b.example", "acme.example", "n0.example", "n1.example", "n2.example"]
    assert _domains(query.sort_leads(df, "business_name"))[0] == "acme.example"
    page = query.LeadQuery(page=2, page_size=2).run(df)
    assert (_domains(page.rows), page.total, page.total_pages, page.has_next, page.has_previous) == (["n0.example", "n1.example"], 5, 3, True, True)
    assert query.page_summary(page) == "page 2 of 3 (2 of 5 lead(s), page size 2)"
    assert _domains(query.paginate(df, 9, 2)) == []
    assert query.page_summary(query.LeadQuery(page=9, page_size=2).run(df)).startswith("No leads on page 9")
    monkeypatch.setattr(query, "DEEP", 0)
    for p in (2, 3, 4):
        deep = _domains(query.paginate(df, p, 2, "last_seen", True))
        assert deep == ["b.example", "acme.example", "n0.example", "n1.example", "n2.example"][2 * p - 2 : 2 * p]
    for bad in ({"page": 0}, {"page_size": 1001}, {"page": True}, {"sort_by": "colour"}, {"descending": 1}):
        with pytest.raises(query.QueryError):
            query.LeadQuery(**bad)


def test_plans(spark, tmp_path, frame):
    path = str(tmp_path / "leads")
    frame(HOME, ABOUT).write.parquet(path)
    stored = spark.read.parquet(path)
    plan = query.LeadQuery(query.LeadFilter(domain="acme.example"), page=1).plan(stored)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "PushedFilters: [IsNotNull(domain), EqualTo(domain,acme.example)]" in plan


def test_listing(frame):
    text = query.listing_text(frame(HOME[:2] + ("A\tc\nme",) + HOME[3:]))
    assert text.splitlines()[1] == "A c me\tacme.example\thttps://acme.example/\t1\t1\t2024-01-03T00:00:00\t2024-01-04T00:00:00"
    assert query.listing_text(frame()) == "No leads found."


# ---------------------------------------------------------------- export


def test_csv_and_json(frame, tmp_path):
    text = export.to_csv(frame(ABOUT, OTHER[:2] + ('say "hi", ok\nthen',) + OTHER[3:]))
    lines = text.split("\r\n")
    assert lines[0].startswith("business_name,website,domain,description,emails,phones,address_street")
    assert lines[1].startswith("Acme Inc,https://www.acme.example/,acme.example,About,a@acme.example,1234567,S,,,,FR")
    assert '"say ""hi"", ok\nthen"' in text
    doc = export.to_json(frame(OTHER, HOME))
    assert doc.index("acme.example") < doc.index("b.example")
    assert doc.startswith('{\n  "version": 1,\n  "count": 2,')
    assert doc.endswith("}\n")
    assert export.render(frame(HOME), "CSV", excel_bom=True).startswith("﻿business_name")
    with pytest.raises(export.ExportError):
        export.to_json(frame(HOME, ABOUT))
    with pytest.raises(export.ExportError):
        export.to_csv(frame(HOME[:4] + (["a|b"],) + HOME[5:]))
    for bad in (("xml", False), ("json", True)):
        with pytest.raises(export.ExportError):
            export.check_format(*bad)
    target = tmp_path / "x.json"
    target.write_text("old")
    with pytest.raises(export.ExportError):
        export.write(target, frame(HOME, ABOUT), "json")
    assert target.read_text() == "old"
    assert [p.name for p in tmp_path.iterdir()] == ["x.json"]
    export.write(target, frame(HOME), "json")
    assert "acme.example" in target.read_text()


def test_bulk_export_round_trip(spark, frame, tmp_path):
    from siteloom.sources import pages

    export.write_bulk(frame(HOME, OTHER), str(tmp_path / "j"))
    back = pages.leads(spark, str(tmp_path / "j"))
    assert back.count() == 2
    assert back.filter("domain = 'acme.example'").first().emails == ["b@acme.example"]
    export.write_bulk(frame(HOME), str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["phones"] == "1234567"


def test_leads_as_json_objects(spark, frame):
    texts = export.lead_json(frame(HOME, OTHER))
    back = export.read_json(texts)
    assert {r.domain: (r.business_name, r.emails, r.first_seen) for r in back.collect()} == {
        "acme.example": ("Acme", ["b@acme.example"], T[2].replace(tzinfo=None)),
        "b.example": (None, [], None),
    }
    assert texts.filter("domain = 'b.example'").first().json.startswith('{"business_name":null,"website":"https://b.example/"')
    bad = spark.createDataFrame([('{"website":"https://e.com/","colour":1}',), ("[1]",), ("{",), ("{}",), (None,)], "json string")
    assert export.read_json(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="unknown fields: colour"):
        export.read_json(bad.filter("json LIKE '%colour%'")).collect()
