from __future__ import annotations

from datetime import UTC, date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siteloom.functions.rules import UrlRules
from siteloom.operators import admission, crawl, store
from siteloom.sources import robots, sitemap

AS_OF = date(2026, 1, 1)
NOW = datetime(2024, 5, 1, tzinfo=UTC)


def test_gate_counts_only_what_it_admits():
    gate = admission.Gate(UrlRules(max_query_variants_per_path=2, max_calendar_urls_per_pattern=2), as_of=AS_OF)
    urls = ["https://e.com/a?x=1", "http://www.e.com/a?x=1", "https://e.com/a?x=2", "https://e.com/a?x=3", "https://e.com/a?x=2&page=2", "bad:", "https://e.com/events/2024", "https://e.com/events/2025", "https://e.com/events/2026"]
    assert [gate.admit(u).reason for u in urls] == [None, "duplicate", None, "trap_query_variants", None, "unsupported_scheme", None, None, "trap_calendar"]
    assert gate.rejections["duplicate"] == 1
    assert gate.admitted == 5
    assert gate.record_canonical("https://e.com/z", "https://e.com/a?x=1")
    assert not gate.record_canonical("https://e.com/z", "https://e.com/new")
    gate.record_empty_page("https://e.com/l?page=3")
    assert gate.admit("https://e.com/l?page=4").reason == "trap_pagination"
    assert gate.admit("https://e.com/l?page=2").allowed


def test_ordered_pass_equals_windows(spark):
    links = [(c, i, f"https://e{c}.com/p{i % 7}?v={i % 5}&page={i % 3}" + ("#x" if i % 2 else "")) for c in (1, 2) for i in range(120)] + [(1, 500, None), (1, 501, "ftp://x")]
    df = spark.createDataFrame(links, "crawl_id long, seq long, url string").repartition(5)
    small = UrlRules(max_query_variants_per_path=3)
    exact = admission.admit_in_order(df, rules=small, as_of=AS_OF).select("crawl_id", "seq", "allowed", "url", "reason")
    fast = admission.admit_by_windows(df, rules=small, as_of=AS_OF).filter("raw IS NOT NULL").select("crawl_id", "seq", "allowed", "url", "reason")
    assert rows(exact) == rows(fast)
    assert {r.reason for r in exact.collect()} == {None, "duplicate", "trap_query_variants", "unsupported_scheme"}
    assert rows(admission.rejections(exact)) == rows(admission.rejections(fast))
    assert admission.first_of_pages(df).count() == 2 * 105
    seen = spark.createDataFrame([(1, "//e1.com/p0?page=0&v=0")], "crawl_id long, dedupe_key string")
    assert admission.unseen(df.filter("seq = 0"), seen).count() == 1


def test_ordered_pass_equals_windows_where_limits_meet(spark):
    """Calendars, variants of calendar links, and pages whose first link a limit refuses, at random."""
    import random

    rnd = random.Random(5)
    bits = ["events/2024", "events/2025", "calendar/a1", "calendar/a2", "calendar/a3", "x", "x?v=1", "x?v=2", "x?v=3", "events/2024?v=1", "events/2025?v=2", "events/2026?v=3&page=2", "y?year=2024", "y?year=2025", "y?year=2026"]
    hosts = ["https://e.com/", "http://www.e.com/", "https://www.e.com/"]
    links = [(c, i, rnd.choice(hosts[: 1 + c % 3]) + rnd.choice(bits)) for c in range(30) for i in range(rnd.randint(1, 40))]
    df = spark.createDataFrame(links, "crawl_id long, seq long, url string").repartition(5)
    small = UrlRules(max_query_variants_per_path=2, max_calendar_urls_per_pattern=2)
    exact = admission.admit_in_order(df, rules=small, as_of=AS_OF).select("crawl_id", "seq", "allowed", "url", "reason")
    fast = admission.admit_by_windows(df, rules=small, as_of=AS_OF).select("crawl_id", "seq", "allowed", "url", "reason")
    assert rows(exact) == rows(fast)
    assert {r.reason for r in exact.collect()} == {None, "duplicate", "trap_query_variants", "trap_calendar"}


def test_admission_of_nothing(spark):
    empty = spark.createDataFrame([], "crawl_id long, seq long, url string")
    assert admission.admit_in_order(empty).count() == 0
    assert admission.admit_by_windows(empty).count() == 0


def test_pages_beyond_an_empty_one(spark):
    pages = spark.createDataFrame([(1, f"https://e.com/l?page={i}") for i in range(1, 6)], "crawl_id long, url string")
    found = admission.beyond_empty_pages(pages, pages.filter(F.col("url").endswith("=4")))
    assert sorted(r.page for r in found.collect()) == [4, 5]


def test_outcomes(spark):
    cases = [(301, "/x", None, "text/html", 1), (302, None, None, None, 1), (200, None, "99999999", "text/html", 1), (404, None, None, "text/html", 1), (200, None, None, "application/pdf", 1),
             (200, None, "x", None, 6 << 20), (200, None, None, "text/html; charset=x", 5)]
    df = spark.createDataFrame(cases, "s int, l string, c string, t string, z long")
    found = df.select(crawl.outcome(*(F.col(c) for c in "slctz"))).collect()
    assert [r[0] for r in found] == ["redirect_not_followed", "redirect_error", "too_large", "http_error", "unsupported_content_type", "too_large", "ok"]
    codes = spark.createDataFrame([(c,) for c in (200, 404, 403, 429, 503, 418)], "c int").select(crawl.discovery_status(F.col("c")))
    assert [r[0] for r in codes.collect()] == ["ok", "not_found", "forbidden", "rate_limited", "server_error", "http_error"]


def test_redirects(spark):
    hops = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), *((f"n{i}", f"n{i + 1}") for i in range(8))]
    df = spark.createDataFrame(hops, "url string, location string")
    starts = spark.createDataFrame([("a",), ("x",), ("n0",), ("c",)], "url string")
    found = {r.url: (r.final_url, r.hops, r.problem) for r in crawl.follow_redirects(starts, df).collect()}
    assert found == {"a": ("c", 2, None), "x": ("y", 1, "loop"), "n0": ("n5", 5, "too_many"), "c": ("c", 0, None)}


def test_breadth_first_replay(spark):
    edges = [("https://e.com/", 0, "/a"), ("https://e.com/", 1, "/b"), ("https://e.com/", 2, "/a#x"), ("https://e.com/a", 0, "c"), ("https://e.com/a", 1, "/"), ("https://e.com/b", 0, "https://other.com/"), ("https://e.com/c", 0, "/d")]
    edges = spark.createDataFrame(edges, "url string, position int, href string")
    seeds = spark.createDataFrame([(1, "e.com")], "crawl_id long, url string")
    found = crawl.replay(seeds, edges, max_depth=3, max_pages=4, as_of=AS_OF).orderBy("seq").collect()
    assert [(r.url, r.depth, r.parent_url, r.status) for r in found] == [
        ("https://e.com/", 0, None, "pending"), ("https://e.com/a", 1, "https://e.com/", "pending"), ("https://e.com/b", 1, "https://e.com/", "pending"),
        ("https://e.com/c", 2, "https://e.com/a", "pending"), ("https://e.com/d", 3, "https://e.com/c", "skipped"),
    ]


def _state(spark):
    pages = [(1, 1, "https://e.com/", 0, "fetched", "https://e.com/b"), (2, 1, "https://e.com/b", 1, "pending", None), (3, 1, "https://e.com/c", 1, "pending", None), (4, 1, "https://e.com/d", 2, "skipped", None),
             (5, 1, "https://e.com/e", 2, "skipped", None), (5, 1, "https://e.com/e", 2, "skipped", None), (6, 2, "https://f.com/", 0, "failed", None)]
    p = spark.createDataFrame([(*r, NOW, 0.5) for r in pages], "id long, crawl_id long, url string, depth int, status string, final_url string, updated_at timestamp, duration_seconds double")
    crawls = [(1, "running", None, "https://e.com/", 4), (2, "completed", "completed", "https://f.com/", 9), (3, "pending", None, "https://g.com/", 9)]
    c = spark.createDataFrame([(*r, NOW, NOW, None, NOW, None) for r in crawls], "id long, status string, stop_reason string, seed_url string, max_pages int, created_at timestamp, started_at timestamp, finished_at timestamp, updated_at timestamp, error_message string")
    return c, p


def test_resume_and_report(spark):
    crawls, pages = _state(spark)
    assert rows(crawl.pending(pages).select("id")) == [(3,)]
    found = crawl.resume(pages, crawls)
    assert rows(found.select("id", "promoted")) == [(3, False), (4, True)]
    report = {r.crawl_id: r for r in crawl.state_report(crawls, pages).collect()}
    assert (report[1].lifecycle, report[1].total_pages, report[1].visited, report[1].pending, report[1].skipped) == ("running", 5, 1, 2, 2)
    assert (report[2].lifecycle, report[2].failed, report[3].lifecycle, report[3].total_pages) == ("completed", 1, "created", 0)


def test_states(spark):
    crawls, _ = _state(spark)
    changes = spark.createDataFrame([(1, "completed", NOW, None), (3, "running", NOW, "x")], "id long, status string, at timestamp, error_message string")
    done = {r.id: r for r in crawl.set_status(crawls, changes).collect()}
    assert (done[1].status, done[1].finished_at is not None, done[3].status, done[3].error_message) == ("completed", True, "running", "x")
    bad = spark.createDataFrame([(2, "running", NOW, None)], "id long, status string, at timestamp, error_message string")
    assert crawl.set_status(crawls, bad, strict=False).filter("id = 2").first().status == "completed"
    with pytest.raises(Exception, match="not allowed"):
        crawl.set_status(crawls, bad).collect()
    log = spark.createDataFrame([(1, 1, "pending"), (1, 2, "running"), (1, 3, "pending"), (1, 4, "completed")], "crawl_id long, seq int, status string")
    assert rows(crawl.bad_transitions(log).select("seq", "before")) == [(3, "running"), (4, "pending")]
    times = crawl.rate_schedule(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "host string, seq int"), delay=2.0, deadline=2.0)
    assert rows(times.select("host", "starts_at")) == [("a", 0.0), ("a", None), ("b", 0.0)]


# ---------------------------------------------------------------- stored tables


def test_writes(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, name string, note string")
    changed = store.updated(df, spark.createDataFrame([(1, None, "y")], "id long, name string, note string"))
    assert rows(changed) == [(1, "a", "y"), (2, "b", None)]
    assert rows(store.deleted(df, df.filter("id = 1"))) == [(2, "b", None)]
    assert store.get_or_create(df, spark.createDataFrame([(3, "b", None), (4, "c", None), (5, "c", None)], df.schema), ["name"]).count() == 3
    assert rows(store.search(df, "A").select("id")) == [(1,)]
    assert store.search(df, "%").count() == 0
    assert rows(store.listed(df, limit=1, offset=1).select("id")) == [(2,)]
    assert store.get(df, 2).first().name == "b"
    children = spark.createDataFrame([(7, 1, "k"), (6, 1, "l")], "id long, parent long, v string")
    found = store.with_children(df, children, key="id", foreign="parent", name="kids").orderBy("id").collect()
    assert [[k.id for k in r.kids] for r in found] == [[6, 7], []]


def test_evidence_and_newest(spark):
    rows_ = spark.createDataFrame([("a", 1, 0.2, None), ("a", 2, 0.9, "s"), ("a", 3, 0.1, "t")], "k string, n int, confidence double, snippet string")
    held = store.evidence(rows_, ["k"], order="n")
    assert rows(held) == [("a", 3, 0.9, "s")]
    assert rows(store.add_evidence(held, rows_, ["k"], order="n")) == [("a", 6, 0.9, "s")]
    assert store.newest(rows_, ["k"], ["n"]).first().n == 3
    assert store.last_written(rows_.filter("n = 3"), rows_.filter("n < 3"), ["k"], "n").first().n == 2
    emails = store.email_rows(spark.createDataFrame([(" INFO@a.b ",), ("jo@a.b",)], "email string"))
    assert rows(emails.select("email", "local_part", "host", "is_role_based")) == [("info@a.b", "info", "a.b", True), ("jo@a.b", "jo", "a.b", False)]
    keys = spark.createDataFrame([(1, True, None, None), (2, False, None, None), (3, True, NOW, None), (4, True, None, NOW)], "id int, active boolean, revoked_at timestamp, expires_at timestamp")
    assert rows(store.usable_keys(keys, NOW).select("id")) == [(1,)]


def test_constraints(spark):
    df = spark.createDataFrame([(1, -1, "https://e.com/", "x", 99, "lost"), (2, 0, "https://e.com/", None, None, "pending")], "id long, depth int, url string, url_hash string, http_status int, status string")
    assert len(rows(store.violations(df, "pages"))) == 4
    assert rows(store.duplicates(df, ["url"])) == [("https://e.com/", 1, 2)]
    parents = spark.createDataFrame([(0,)], "id int")
    assert rows(store.orphans(df.select("id", F.col("depth").alias("parent")), parents, "parent").select("id")) == [(1,)]
    store.check_version(6)
    with pytest.raises(ValueError):
        store.check_version(5)


# ---------------------------------------------------------------- discovery


def test_robots():
    text = b"\xef\xbb\xbfUser-agent: a\nUser-Agent: b # x\nDisallow: /p\nAllow:\n\nSitemap: https://e.com/s.xml\nsitemap: /rel\nUser-agent: c\nDisallow: /q\nSitemap: https://e.com/s.xml\nnonsense"
    found = robots.parse_robots(text)
    assert found["sitemaps"] == ["https://e.com/s.xml"]
    assert found["groups"] == [{"user_agents": ["a", "b"], "allow": [""], "disallow": ["/p"]}, {"user_agents": ["c"], "allow": [], "disallow": ["/q"]}]
    assert found["invalid_sitemaps"] == 1
    assert robots.parse_robots(" ")["empty"]


def test_sitemaps():
    parse = sitemap.parse_sitemap
    good = parse(b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://e.com/a </loc><loc>x</loc></url><url><loc/></url><url><x><loc>no</loc></x></url></urlset>')
    assert (good["status"], good["kind"], good["locs"], good["empty_locs"], good["missing_locs"]) == ("ok", "urlset", ["https://e.com/a"], 1, 1)
    assert parse(b"<sitemapindex><sitemap><loc>y</loc></sitemap></sitemapindex>")["kind"] == "sitemapindex"
    assert [parse(x)["status"] for x in (b"", b" ", b"<urlset>", b"<!DOCTYPE x><urlset/>", b"<rss/>", b"\0x", b"x" * 9)] == ["empty", "empty", "malformed", "unsafe", "unsupported", "malformed", "malformed"]
    assert parse(b"x" * 9, 8)["status"] == "too_large"


def _site():
    index = lambda *locs: ("<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>").encode()
    pages = lambda *locs: ("<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>").encode()
    return {
        "https://e.com/robots.txt": b"Sitemap: https://e.com/i.xml\nSitemap: https://other.com/x.xml",
        "https://e.com/i.xml": index("https://e.com/1.xml", "https://e.com/i.xml", "/rel.xml", "https://e.com/2.xml", "https://e.com/bad.xml"),
        "https://e.com/1.xml": pages("https://e.com/a", "/b", "https://e.com/a#x", "https://other.com/"),
        "https://e.com/2.xml": pages("https://e.com/c", "https://e.com/x.pdf"),
        "https://e.com/bad.xml": b"<urlset>",
    }


def test_discovery():
    site = _site()
    fetch = lambda url: ("ok", site[url]) if url in site else ("not_found", b"")
    found = sitemap.Discovery(fetch, as_of=AS_OF).discover("e.com")
    assert found["urls"] == ["https://e.com/a", "https://e.com/b", "https://e.com/c"]
    assert [s["url"] for s in found["sitemaps"]] == ["https://e.com/i.xml", "https://e.com/1.xml", "https://e.com/2.xml", "https://e.com/bad.xml"]
    assert found["duplicate_refs"] == 1
    assert dict(found["rejections"]) == {"out_of_scope": 2, "invalid_url": 1, "duplicate": 1, "non_html_extension": 1}
    assert sitemap.Discovery(fetch, most_urls=1).discover("e.com")["url_limit"]
    assert sitemap.Discovery(fetch, most_files=2).discover("e.com")["file_limit"]
    assert sitemap.Discovery(fetch, most_depth=0).discover("e.com")["skipped_by_depth"] == 4

    def broken(url):
        raise OSError

    failed = sitemap.Discovery(broken).discover("https://e.com")
    assert (failed["robots_status"], failed["used_fallback"], failed["urls"]) == ("connection_error", True, [])
    assert sitemap.Discovery(fetch).discover("http://127.0.0.1/")["error"] == "ssrf_blocked: loopback"


def test_expansion_of_many_sites(spark):
    files = spark.createDataFrame([(u, b) for u, b in _site().items()], "url string, body binary")
    roots = spark.createDataFrame([("https://e.com/i.xml",)], "url string")
    found = rows(sitemap.expand(files, roots).select("sitemap", "url", "depth"))
    assert ("https://e.com/1.xml", "https://e.com/b", 1) in found
    assert len(found) == 6


def test_outcomes_of_sitemap_files(spark):
    index = lambda *urls: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"
    files = {
        "https://e.com/0.xml": index("https://e.com/1.xml", "https://e.com/bad.xml", "https://e.com/gone.xml", "https://e.com/0.xml", "/relative.xml"),
        "https://e.com/1.xml": index("https://e.com/2.xml"),
        "https://e.com/2.xml": "<urlset><url><loc>https://e.com/x</loc></url><url><loc> </loc></url><url></url></urlset>",
        "https://e.com/bad.xml": "<urlset><url>",
    }
    df = spark.createDataFrame([(u, b.encode()) for u, b in files.items()], "url string, body binary")
    roots = spark.createDataFrame([("https://e.com/0.xml",)], "url string")
    found = {r.sitemap.rsplit("/", 1)[1]: (r.depth, r.outcome, r.locs, r.usable, r.empty_locs, r.missing_locs) for r in sitemap.file_outcomes(df, roots).collect()}
    assert found == {"0.xml": (0, "ok", 5, 4, 0, 0), "1.xml": (1, "ok", 1, 1, 0, 0), "bad.xml": (1, "malformed", 0, 0, 0, 0), "gone.xml": (1, "not_fetched", 0, 0, 0, 0), "2.xml": (2, "ok", 1, 1, 1, 1)}
    shallow = {r.sitemap.rsplit("/", 1)[1]: r.outcome for r in sitemap.file_outcomes(df, roots, most_depth=1).collect()}
    assert shallow["2.xml"] == "too_deep"
    assert rows(sitemap.expand(df, roots).select("url", "depth")) == [("https://e.com/x", 2)]
