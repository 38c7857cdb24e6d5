"""People and their evidence."""

from __future__ import annotations

import pytest
from conftest import rows

from siteloom.operators import people

PERSON = "id long, domain_id long, full_name string, email_id long"


def _people(spark):
    return people.created(spark.createDataFrame([(1, 1, " Ann Lee ", None), (2, 1, "ann lee", 7), (3, 2, "Ann Lee", None), (4, 1, " ", None)], PERSON))


def _emails(spark):
    return spark.createDataFrame([(7, 1, "a@x.example"), (8, 2, "b@y.example")], "id long, domain_id long, address string")


def test_people_are_stored_and_found(spark):
    held = _people(spark)
    assert rows(held.select("id", "full_name", "confidence")) == [(1, "Ann Lee", 0.0), (2, "ann lee", 0.0), (3, "Ann Lee", 0.0)]
    wanted = spark.createDataFrame([(1, "ANN LEE ")], "domain_id long, full_name string")
    assert rows(people.find_by_name(held, wanted).select("id")) == [(1,), (2,)]
    assert rows(people.with_mailbox(held, _emails(spark)).select("id", "address")) == [(1, None), (2, "a@x.example"), (3, None)]


def test_mailboxes_are_of_the_own_domain(spark):
    held, emails = _people(spark), _emails(spark)
    links = lambda *pairs: spark.createDataFrame(list(pairs), "person_id long, email_id long")
    assert rows(people.link_emails(held, links((1, 7), (2, None)), emails).select("id", "email_id")) == [(1, 7), (2, None), (3, None)]
    assert rows(people.link_emails(held, links((1, 8), (3, 99), (2, 7)), emails, strict=False).select("id", "email_id")) == [(1, None), (2, 7), (3, None)]
    for wrong in ((1, 8), (1, 99)):
        with pytest.raises(Exception, match="mailbox"):
            people.link_emails(held, links(wrong), emails).collect()


def test_repeated_evidence_keeps_the_higher_confidence(spark):
    kind = "person_id long, page_id long, source_type string, snippet string, confidence double"
    stored = spark.createDataFrame([(1, 1, "page_text", None, 0.5), (1, 2, "page_text", "old", 0.9)], kind)
    fresh = spark.createDataFrame([(1, 1, "page_text", "second", 0.4, 2), (1, 1, "page_text", "first", 0.7, 1), (1, 2, "page_text", "new", 0.1, 3), (1, 1, "json_ld", None, None, 4)], kind + ", seq long")
    assert rows(people.upsert_evidence(stored, fresh)) == [(1, 1, "json_ld", None, 1.0), (1, 1, "page_text", "first", 0.7), (1, 2, "page_text", "old", 0.9)]
