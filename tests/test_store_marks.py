"""What is written back after fetches and crawls, identities that are checked, and ways that redirects end."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siteloom import schemas
from siteloom.functions import columns as C
from siteloom.operators import crawl, leads, store

EARLY, LATE = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 2, 1, tzinfo=UTC)


def test_pages_are_marked(spark):
    kind = "id long, status string, http_status int, content_type string, fetched_at timestamp, final_url string, redirect_count int, error_message string"
    pages = spark.createDataFrame([(i, "pending", None, None, None, None, None, None) for i in (1, 2, 3)], kind)
    got = spark.createDataFrame([(1, 200, "text/html", LATE, ["https://a", "https://b", "https://c"])], "id long, http_status int, content_type string, fetched_at timestamp, chain array<string>")
    lost = spark.createDataFrame([(2, "timed out", LATE, None)], "id long, error_message string, fetched_at timestamp, http_status int")
    found = rows(store.mark_failed(store.mark_fetched(pages, got), lost).select("id", "status", "final_url", "redirect_count", "error_message"))
    assert found == [(1, "fetched", "https://c", 2, None), (2, "failed", None, None, "timed out"), (3, "pending", None, None, None)]


def test_domains_and_crawls_are_counted(spark):
    domains = spark.createDataFrame([(1, None), (2, LATE), (3, EARLY)], "id long, last_crawled_at timestamp")
    crawls = spark.createDataFrame([(7, 1, EARLY, 3), (8, 2, EARLY, None), (9, 3, None, 0)], "id long, domain_id long, finished_at timestamp, pages_crawled int")
    found = {r.id: r.m for r in store.mark_crawled(domains, crawls).select("id", F.month("last_crawled_at").alias("m")).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
    pages = spark.createDataFrame([(7, 1), (7, 2), (7, 2), (8, 3)], "crawl_id long, id long")
    assert rows(store.add_pages_crawled(crawls, pages).select("id", "pages_crawled")) == [(7, 5), (8, 1), (9, 0)]


def test_identities_and_sites_are_checked(spark):
    one = spark.createDataFrame([("a.example",), ("b.example",)], "domain string").select("domain", C.lead_key("domain").alias("key"), C.lead_digest("domain").alias("digest"))
    forged = one.withColumn("digest", F.when(F.col("domain") == "b.example", F.lit("0")).otherwise(F.col("digest")))
    assert leads.checked_identities(one).count() == 2
    assert rows(leads.checked_identities(forged, strict=False).select("domain")) == [("a.example",)]
    with pytest.raises(Exception, match="identity of another lead"):
        leads.checked_identities(forged).collect()
    held = spark.createDataFrame([(d, f"https://{d}/", None, None, [], [], None, [], None, None, None, EARLY, LATE) for d in ("a.example", "a.example", "b.example")], schemas.LEAD)
    assert leads.aggregate_site(held.filter("domain = 'a.example'"), "a.example").count() == 1
    with pytest.raises(Exception, match="another domain"):
        leads.aggregate_site(held, "a.example").collect()


def test_redirects_end_in_problems(spark):
    hops = [("https://a", "https://b"), ("https://b", None), ("https://c", "mailto:x"), ("https://d", "https://e")]
    starts = spark.createDataFrame([(u,) for u in ("https://a", "https://c", "https://d", "https://z")], "url string")
    found = crawl.follow_redirects(starts, spark.createDataFrame(hops, "url string, location string"))
    assert rows(found) == [("https://a", "https://b", 1, "missing_location"), ("https://c", "https://c", 0, "not_http"), ("https://d", "https://e", 1, None), ("https://z", "https://z", 0, None)]
