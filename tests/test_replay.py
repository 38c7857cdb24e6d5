"""A replay keeps to the limits of each crawl and ends with its frontier."""

from __future__ import annotations

from datetime import date

from siteloom.operators import crawl


def test_each_crawl_has_its_own_limits(spark):
    chain = [(f"https://e.com/{'p' + str(i) if i else ''}", 0, f"/p{i + 1}") for i in range(8)]
    edges = spark.createDataFrame([*chain, ("https://e.com/", 1, "/side")], "url string, position int, href string")
    seeds = spark.createDataFrame([(1, "e.com", 5, 100), (2, "e.com", 2, 100), (3, "e.com", 5, 2), (4, "e.com", 0, 100), (5, "e.com", None, None)], "crawl_id long, url string, max_depth int, max_pages int")
    found = {}
    for r in crawl.replay(seeds, edges, as_of=date(2024, 1, 1)).collect():
        found.setdefault(r.crawl_id, []).append((r.depth, r.url.rsplit("/", 1)[1], r.status))
    assert {k: max(v)[0] for k, v in found.items()} == {1: 5, 2: 2, 3: 2, 4: 0, 5: 8}
    assert sorted(found[3]) == [(0, "", "pending"), (1, "p1", "pending"), (1, "side", "skipped"), (2, "p2", "skipped")]
    assert not [x for v in (found[1], found[2], found[5]) for x in v if x[2] != "pending"]


def test_redirects_to_known_pages_and_other_content_have_no_links(spark):
    edges = [("https://e.com/", 0, "/a"), ("https://e.com/", 1, "/b"), ("https://e.com/", 2, "/c.htm"), ("https://e.com/b", 0, "/hidden"), ("https://e.com/c.htm", 0, "/hidden"), ("https://e.com/a", 0, "/d")]
    edges = spark.createDataFrame(edges, "url string, position int, href string")
    fetched = [("https://e.com/a", "https://e.com/a", "text/html"), ("https://e.com/b", "https://www.e.com/a", "text/html"), ("https://e.com/c.htm", "https://e.com/c.htm", "application/pdf")]
    fetched = spark.createDataFrame(fetched, "url string, final_url string, content_type string")
    seeds = spark.createDataFrame([(1, "e.com", 5, 100), (2, "e.com", 1, 100), (3, "e.com", 5, 2)], "crawl_id long, url string, max_depth int, max_pages int")
    pages = crawl.replay(seeds, edges, as_of=date(2024, 1, 1), fetched=fetched)
    found = {(r.crawl_id, r.url.rsplit("/", 1)[1]): r.status for r in pages.collect()}
    assert {k[1]: v for k, v in found.items() if k[0] == 1} == {"": "pending", "a": "pending", "b": "duplicate", "c.htm": "not_html", "d": "pending"}
    report = {r.crawl_id: r for r in crawl.replay_report(pages, seeds).collect()}
    assert (report[1].stop_reason, report[2].stop_reason, report[3].stop_reason) == ("completed", "max_depth", "max_pages")
    assert (report[1].pages, report[1].duplicate, report[1].not_html, report[1].pages_by_depth) == (5, 1, 1, {0: 1, 1: 3, 2: 1})


def test_numbers_within_groups_over_many_partitions(spark):
    from siteloom.session import numbered

    rows_ = [("hot", i * 7919 % 1000) for i in range(1000)] + [("b", 2), ("b", 1), (None, 5), (None, 4)]
    df = spark.createDataFrame(rows_, "g string, o int").repartition(7)
    found = {(r.g, r.o): r.n for r in numbered(df, ["g"], ["o"]).collect()}
    assert found == {**{("hot", i): i + 1 for i in range(1000)}, ("b", 1): 1, ("b", 2): 2, (None, 4): 1, (None, 5): 2}
