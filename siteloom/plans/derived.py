"""Queries whose rows exercise what the given tables hardly show: inputs are built from every row of a table, and the SQL
tells by rules what must come out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import columns as C
from siteloom.functions.rules import DEFAULT
from siteloom.operators import admission, crawl, people, query, store
from siteloom.plans.catalogue import FOLD_SQL, LEADS_SQL, PAGES_SQL, URL_SQL, register
from siteloom.plans.catalogue import _flat as flat
from siteloom.plans.catalogue import _folded as folded
from siteloom.session import spread, table
from siteloom.sources import export

AS_OF = date(2026, 1, 1)


def _cases(key: Column, *values: Column) -> Column:
    """One of ``values`` for each row, by its key."""
    chosen = F.lit(None).cast("string")
    for i, value in reversed(list(enumerate(values))):
        chosen = F.when(F.pmod(key, F.lit(len(values))) == i, value).otherwise(chosen)
    return chosen


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains once each, with the label that names their business."""
    rows = table(spark, sf_dir, "domains").select("id", "name").dropDuplicates(["id"])
    return rows.withColumn("label", F.regexp_replace(F.substring_index("name", ".", 1), "[^a-z0-9]", ""))


_DOMAINS_SQL = "d AS (SELECT DISTINCT ON (id) id, name, regexp_replace(string_split(name, '.')[1], '[^a-z0-9]', '', 'g') AS label FROM domains)"


# ---------------------------------------------------------------- URLs


@register(
    f"WITH {PAGES_SQL} SELECT id, CASE id % 8 WHEN 0 THEN 'trap_depth' WHEN 1 THEN 'trap_repeated_segments' WHEN 2 THEN 'trap_query_params'"
    " WHEN 3 THEN CASE WHEN id > 50 THEN 'trap_pagination' END WHEN 4 THEN CASE WHEN id * 10 > 2500 THEN 'trap_pagination' END"
    " WHEN 5 THEN CASE WHEN 1990 + id % 60 NOT BETWEEN 2021 AND 2027 THEN 'trap_calendar' END WHEN 6 THEN CASE WHEN id > 50 THEN 'trap_pagination' END"
    " ELSE CASE WHEN 1990 + id % 60 NOT BETWEEN 2021 AND 2027 THEN 'trap_calendar' END END AS trap FROM p"
)
def url_trap_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of trap, and URLs just short of one."""
    year = F.lit(1990) + F.pmod("id", F.lit(60))
    many = "&".join(f"p{i}=" for i in range(13))
    url = _cases(
        F.col("id"), _text("https://e.example/", "/".join(f"s{i}" for i in range(12)), "/", F.col("id")), _text("https://e.example/x", F.col("id"), "/a/b/a/b/a/b"), _text(f"https://e.example/q?{many}", F.col("id")),
        _text("https://e.example/list?page=", F.col("id")), _text("https://e.example/list?offset=", F.col("id") * 10), _text("https://e.example/events/", year), _text("https://e.example/list/page/", F.col("id")),
        _text("https://e.example/list?year=", year),
    )
    pages = table(spark, sf_dir, "crawl_pages").select("id").distinct()
    return pages.select("id", C.trap(url, as_of=AS_OF).alias("trap"))


@register(
    "WITH a AS (SELECT DISTINCT CAST(id % 256 AS BIGINT) AS o1, CAST((id // 3) % 256 AS BIGINT) AS o2, CAST((id // 5) % 256 AS BIGINT) AS o3, CAST(id % 251 AS BIGINT) AS o4 FROM crawl_pages"
    " UNION SELECT * FROM (VALUES (169, 254, 169, 254), (100, 100, 100, 200), (192, 168, 1, 1), (172, 31, 0, 1), (198, 18, 0, 1), (203, 0, 113, 9), (192, 88, 99, 1)) v)"
    " SELECT o1 || '.' || o2 || '.' || o3 || '.' || o4 AS address, CASE"
    " WHEN (o1, o2, o3, o4) IN ((169, 254, 169, 254), (169, 254, 170, 2), (100, 100, 100, 200), (168, 63, 129, 16), (192, 0, 0, 192)) THEN 'metadata'"
    " WHEN o1 = 0 THEN 'unspecified' WHEN o1 = 10 OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 168) THEN 'private' WHEN o1 = 100 AND o2 BETWEEN 64 AND 127 THEN 'cgnat'"
    " WHEN o1 = 127 THEN 'loopback' WHEN o1 = 169 AND o2 = 254 THEN 'link_local' WHEN (o1 = 192 AND o2 = 0 AND o3 = 0) OR (o1 = 192 AND o2 = 88 AND o3 = 99) OR o1 >= 240 THEN 'reserved'"
    " WHEN (o1 = 192 AND o2 = 0 AND o3 = 2) OR (o1 = 198 AND o2 = 51 AND o3 = 100) OR (o1 = 203 AND o2 = 0 AND o3 = 113) THEN 'documentation'"
    " WHEN o1 = 198 AND o2 IN (18, 19) THEN 'benchmarking' WHEN o1 BETWEEN 224 AND 239 THEN 'multicast' END AS reason FROM a"
)
def ssrf_ip_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses over the whole space, and some in each small network."""
    n = F.col("id")
    octets = [F.pmod(n, F.lit(256)), F.pmod(F.floor(n / 3), F.lit(256)), F.pmod(F.floor(n / 5), F.lit(256)), F.pmod(n, F.lit(251))]
    spread = table(spark, sf_dir, "crawl_pages").select(F.concat_ws(".", *(o.cast("string") for o in octets)).alias("address"))
    some = ["169.254.169.254", "100.100.100.200", "192.168.1.1", "172.31.0.1", "198.18.0.1", "203.0.113.9", "192.88.99.1"]
    every = spread.unionByName(spark.createDataFrame([(a,) for a in some], "address string")).distinct()
    return every.select("address", C.ipv4_block_reason("address").alias("reason"))


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, CASE id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'single_label' WHEN 2 THEN 'internal_hostname' WHEN 3 THEN 'internal_hostname'"
    " WHEN 4 THEN 'private' WHEN 5 THEN 'wildcard_dns' ELSE 'loopback' END AS result FROM d"
)
def ssrf_host_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that a crawler may and may not contact, one of each kind for every domain."""
    name, n = F.col("name"), F.col("id")
    host = _cases(
        n, name, F.col("label"), _text(F.col("label"), ".internal"), _text(F.col("label"), ".localhost"), _text("10.", F.pmod(n, F.lit(256)), ".0.7"), _text("10.0.0.1.", "nip.io"), _text("127.0.0.", F.pmod(n, F.lit(256))),
    )
    return _domains(spark, sf_dir).select("id", F.coalesce(C.host_block_reason(host), F.lit("ok")).alias("result"))


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, CASE id % 8 WHEN 0 THEN 'https://' || name || '/p/' || id WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL"
    " WHEN 5 THEN 'https://' || name || '/q/' || id WHEN 6 THEN 'https://shop.' || name || '/p' ELSE NULL END AS url, CASE id % 8 WHEN 0 THEN '' WHEN 1 THEN 'missing' WHEN 2 THEN 'root_canonical'"
    " WHEN 3 THEN 'cross_domain' WHEN 4 THEN 'invalid:unsupported_scheme' WHEN 5 THEN '' WHEN 6 THEN '' ELSE 'ssrf_blocked' END AS reason, id % 8 IN (5, 6) AS changed FROM d"
)
def canonical_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical links that hold, that say nothing, and that are refused."""
    name, n = F.col("name"), F.col("id")
    page = _text("https://", name, "/p/", n)
    href = _cases(n, _text("HTTPS://", F.upper(name), "/p/", n, "#top"), F.lit(" "), F.lit("/"), F.lit("https://elsewhere.example/p"), F.lit("ftp://x.example/"), _text("../q/", n), _text("https://shop.", name, "/p"), F.lit("http://10.0.0.1/"))
    return _domains(spark, sf_dir).select("id", C.canonical(page, href).alias("c")).select("id", "c.url", "c.reason", "c.changed")


@register(
    f"WITH {PAGES_SQL}, {URL_SQL}"
    + r", k AS (SELECT crawl_id, id, normal, row_number() OVER (PARTITION BY crawl_id, regexp_replace(regexp_replace(normal, '^https?:', ''), '^//www\.', '//') ORDER BY id) AS r,"
    r" TRY_CAST(regexp_extract(normal, '[?&]page=([0-9]+)', 1) AS BIGINT) AS page FROM n)"
    " SELECT crawl_id, id AS seq, normal AS url, CASE WHEN page > 50 THEN 'trap_pagination' WHEN r > 1 THEN 'duplicate' END AS reason FROM k"
)
def url_admission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every crawled URL, by ranks."""
    pages = spread(table(spark, sf_dir, "crawl_pages").select("id", "crawl_id", "url"))
    return admission.admit_by_windows(pages, seq="id", as_of=AS_OF, repeated=True).select("crawl_id", "seq", "url", "reason")


# ---------------------------------------------------------------- pages


@register(
    f"WITH {_DOMAINS_SQL}, s AS (SELECT id, CASE id % 9 WHEN 0 THEN 'facebook' WHEN 1 THEN 'x' WHEN 2 THEN 'instagram' WHEN 3 THEN 'linkedin' WHEN 4 THEN 'youtube' WHEN 5 THEN 'tiktok' WHEN 8 THEN 'facebook' END AS platform,"
    " CASE id % 9 WHEN 0 THEN 'https://www.facebook.com/a' || label WHEN 1 THEN 'https://x.com/a' || left(label, 12) WHEN 2 THEN 'https://www.instagram.com/a' || left(label, 20)"
    " WHEN 3 THEN 'https://www.linkedin.com/company/' || label WHEN 4 THEN 'https://www.youtube.com/@ab' || label WHEN 5 THEN 'https://www.tiktok.com/@a' || left(label, 20)"
    " WHEN 8 THEN 'https://www.facebook.com/profile.php?id=' || id END AS url FROM d) SELECT * FROM s WHERE url IS NOT NULL"
)
def social_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles behind links of every network, and links that are none: a share button and another site."""
    label, n = F.col("label"), F.col("id")
    href = _cases(
        n, _text("//m.facebook.com/a", label, "/?ref=x"), _text("https://twitter.com/#!/a", F.left(label, F.lit(12))), _text("https://instagr.am/a", F.left(label, F.lit(20)), "/"), _text("https://uk.linkedin.com/Company/", label),
        _text("https://m.youtube.com/@ab", label), _text("https://www.tiktok.com/@a", F.left(label, F.lit(20))), _text("https://facebook.com/sharer.php?u=", label), _text("https://notfacebook.com/", label),
        _text("https://fb.com/profile.php?id=", n),
    )
    return _domains(spark, sf_dir).select("id", C.profile(href).alias("p")).filter("p IS NOT NULL").select("id", "p.platform", "p.url")


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, ['homepage','about','contact','services','product','blog','article','portfolio','careers','article','other','contact'][CAST(id % 12 AS BIGINT) + 1] AS category FROM d"
)
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every kind, told by their address, their title or their date."""
    n = F.col("id")
    paths = ["/", "/about-us", "/contact", "/our-services", "/products", "/blog", "/news/item", "/portfolio", "/x", "/2024/05/x", "/x", "/en/get_in_touch"]
    url = _text("https://", F.col("name"), _cases(n, *(F.lit(p) for p in paths)))
    title = F.when(F.pmod(n, F.lit(12)) == 8, F.lit("Jobs | ")).otherwise(F.lit(""))
    html = _text("<title>", title, "q</title><p>", n, "</p>")
    return _domains(spark, sf_dir).select("id", C.parsed_page(html, url).alias("p")).select("id", "p.classification.category")


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, 'LocalBusiness' AS type, 'Shop ' || label AS name, 'info@' || name AS email, '+4930' || (1000000 + id) AS phone, 'Main St ' || id || ', Town, ' || (10000 + id) AS address,"
    " 'Side St ' || id || ', Port' AS second_address, 2 AS addresses FROM d"
)
def structured_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A business that a page describes twice as JSON-LD, the second time with other parts, and once in a broken block."""
    n, name, label = F.col("id"), F.col("name"), F.col("label")
    first = _text('{"@type": "LocalBusiness", "name": " Shop ', label, '", "url": "https://', name, '/", "email": "mailto:INFO@', name, '?x", "address": {"streetAddress": "Main St ', n, '", "addressLocality": "Town", "postalCode": "', n + 10000, '"}}')
    second = _text('<!-- {"@graph": [{"@type": ["https://schema.org/LocalBusiness"], "name": "SHOP ', F.upper(label), '", "url": "https://', F.upper(name), '", "telephone": "+49 30 ', n + 1000000, '", "address": {"streetAddress": "Side St ', n, '", "addressLocality": "Port"}}, {"@type": "Event", "name": "x"}]} -->')
    block = '<script type="application/ld+json">'
    html = _text("<html><head>", block, first, "</script>", block, "{broken</script>", block, second, "</script></head></html>")
    pages = _domains(spark, sf_dir).select("id", F.explode(C.parsed_page(html, F.lit("https://e.example/x"))["structured_data"]).alias("b"))
    where = F.transform("b.addresses", lambda a: a["formatted"])
    return pages.select(
        "id", "b.type", "b.name", F.array_join("b.emails", "|").alias("email"), F.array_join(F.transform("b.telephones", lambda p: p["number"]), "|").alias("phone"),
        F.get(where, F.lit(0)).alias("address"), F.get(where, F.lit(1)).alias("second_address"), F.size(where).alias("addresses"),
    )


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, CASE id % 5 WHEN 0 THEN 'Best ' || label || ' Shop' WHEN 1 THEN 'Zorb Qux' WHEN 2 THEN NULL WHEN 3 THEN 'Site Name' ELSE 'Recorded ' || id END AS business_name,"
    " CASE id % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'title' WHEN 2 THEN NULL WHEN 3 THEN 'og_site_name' ELSE 'json_ld' END AS name_source FROM d"
)
def brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of businesses from the part of a title that is like the domain, its last part, a site name and a record."""
    n, label = F.col("id"), F.col("label")
    head = _cases(
        n, _text("<title>About us | Best ", label, " Shop - News</title>"), F.lit("<title>Our team: Zorb Qux</title>"), F.lit("<title>Contact</title>"), F.lit("<title>Home</title><meta property=og:site_name content='Site Name'>"),
        _text('<title>x | y</title><script type="application/ld+json">{"@type": "Organization", "name": "Recorded ', n, '", "url": "https://www.', F.col("name"), '"}</script>'),
    )
    pages = _domains(spark, sf_dir).select("id", _text("https://", F.col("name"), "/page").alias("url"), head.alias("html"))
    return pages.select("id", C.page_identity("html", "url").alias("i")).select("id", "i.business_name", "i.name_source")


@register(f"WITH {_DOMAINS_SQL} SELECT id, 'Main ' || id AS street, CASE WHEN id % 2 = 0 THEN CAST(10000 + id AS VARCHAR) END AS postal_code, 'Main ' || id || ', Town' || CASE WHEN id % 2 = 0 THEN ', ' || (10000 + id) ELSE '' END AS formatted FROM d")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of ``<address>`` elements with microdata."""
    n = F.col("id")
    code = F.when(F.pmod(n, F.lit(2)) == 0, _text("<br><span itemprop=postalCode>", n + 10000, "</span>")).otherwise(F.lit(""))
    html = _text("<body><address><span itemprop=streetAddress>Main  ", n, "</span>,<br>Town;", code, "</address></body>")
    pages = _domains(spark, sf_dir).select("id", F.explode(C.parsed_page(html, F.lit("https://e.example/x"))["addresses"]).alias("a"))
    return pages.select("id", "a.street", "a.postal_code", "a.formatted")


@register(
    f"WITH {_DOMAINS_SQL}, c AS (SELECT id, CASE id % 6 WHEN 0 THEN '+4930' || (1000000 + id) WHEN 1 THEN '0301' || (1000000 + id) WHEN 2 THEN '555' || (1000000 + id) END AS number FROM d)"
    " SELECT id, number FROM c WHERE number IS NOT NULL"
)
def phone_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are phones, by a sign, by separators and by a label, and three that are a date, an order and a price."""
    n = F.col("id")
    digits = n + 1000000
    text = _cases(n, _text("call +49 (0) 30 ", digits, " now"), _text("030-1", digits), _text("Tel: 555", digits), _text("on 2024-05-", F.lpad((F.pmod(n, F.lit(28)) + 1).cast("string"), 2, "0")), _text("Order 555-", digits), _text("555 ", digits, " EUR"))
    return _domains(spark, sf_dir).select("id", F.explode(C.phones_in(text)).alias("p")).select("id", "p.number")


# ---------------------------------------------------------------- leads and stored tables


@register(
    "WITH c AS (SELECT DISTINCT ON (id) * FROM crawls) SELECT id, 'max_pages is positive' AS problem FROM c WHERE id % 4 = 0 UNION ALL SELECT id, 'max_depth isn''t negative' FROM c WHERE id % 4 = 1"
    " UNION ALL SELECT id, 'pages_crawled isn''t negative' FROM c WHERE id % 4 = 2 UNION ALL SELECT id, 'status is known' FROM c WHERE id % 4 = 3"
)
def constraint_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls with one broken constraint each."""
    n, crawls = F.pmod("id", F.lit(4)), table(spark, sf_dir, "crawls").dropDuplicates(["id"])
    broken = crawls.withColumns(
        {
            "max_pages": F.when(n == 0, 0).otherwise(10), "max_depth": F.when(n == 1, -1).otherwise(2), "pages_crawled": F.when(n == 2, -1).otherwise(F.lit(0)),
            "status": F.when(n == 3, "odd").otherwise(F.lit("running")), "finished_at": F.lit(None).cast("timestamp"),
        }
    )
    return store.violations(broken, "crawls")


@register("SELECT DISTINCT id FROM crawl_pages WHERE id % 5 = 0 AND crawl_id IS NOT NULL")
def orphan_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, a fifth of which are of crawls that there aren't."""
    crawl_id = F.when(F.pmod("id", F.lit(5)) == 0, -F.col("crawl_id") - 1).otherwise(F.col("crawl_id"))
    pages = table(spark, sf_dir, "crawl_pages").select("id", crawl_id.alias("crawl_id"))
    return store.orphans(pages, table(spark, sf_dir, "crawls"), "crawl_id").select("id").distinct()


@register(
    "WITH e AS (SELECT DISTINCT ON (candidate_id) candidate_id % 40 AS person_id, candidate_id % 7 AS page_id, source AS source_type, nullif(trim(name, ' '), '') AS snippet, (candidate_id % 10) / 10.0 AS confidence, candidate_id FROM name_candidates)"
    " SELECT person_id, page_id, source_type, arg_min(snippet, candidate_id) FILTER (snippet IS NOT NULL) AS snippet, max(CAST(confidence AS DOUBLE)) AS confidence FROM e GROUP BY ALL"
)
def person_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of people, written in two parts."""
    n = F.col("candidate_id")
    rows = table(spark, sf_dir, "name_candidates").dropDuplicates(["candidate_id"]).select(
        F.pmod(n, F.lit(40)).alias("person_id"), F.pmod(n, F.lit(7)).alias("page_id"), F.col("source").alias("source_type"), F.nullif(F.trim("name"), F.lit("")).alias("snippet"), (F.pmod(n, F.lit(10)) / 10.0).alias("confidence"), n.alias("seq")
    )
    middle = F.lit(rows.agg(F.percentile_approx("seq", 0.5).alias("m")).first()["m"])
    stored = people.upsert_evidence(rows.limit(0).drop("seq"), rows.filter(F.col("seq") <= middle))
    return people.upsert_evidence(stored, rows.filter(F.col("seq") > middle))


@register(
    "WITH d AS (SELECT DISTINCT ON (id) id, name FROM domains) SELECT id, CASE WHEN id % 3 = 0 THEN id WHEN id % 3 = 1 THEN NULL ELSE NULL END AS email_id FROM d"
)
def person_mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person for each domain; a third get their own mailbox, a third another's, which changes nothing, a third none."""
    n = F.col("id")
    domains = table(spark, sf_dir, "domains").select("id", "name").dropDuplicates(["id"])
    held = people.created(domains.select("id", n.alias("domain_id"), F.col("name").alias("full_name")))
    emails = domains.select("id", n.alias("domain_id"), _text("info@", F.col("name")).alias("address"))
    links = domains.select(n.alias("person_id"), F.when(F.pmod(n, F.lit(3)) == 0, n).when(F.pmod(n, F.lit(3)) == 1, n + 1).alias("email_id"))
    return people.link_emails(held, links, emails, strict=False).select("id", "email_id")


# ---------------------------------------------------------------- more of URLs and admission


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, CASE id % 9 WHEN 0 THEN 'https://' || name || '/c%20d' WHEN 1 THEN 'https://' || name || '/a/b?q=' || id WHEN 2 THEN 'https://other.example/x' WHEN 3 THEN 'http://127.0.0.1/'"
    " WHEN 4 THEN 'https://' || name || '/~user' WHEN 5 THEN 'https://' || name || '/a/x/z' WHEN 6 THEN 'https://' || name || '/%2Fa' WHEN 7 THEN 'https://' || name || '/a/b' ELSE 'http://' || name || ':8080/' END AS url FROM d"
)
def url_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References against a page: relative, of a query only, without scheme, loose IPv4, escapes, dots and ports."""
    n, name = F.col("id"), F.col("name")
    href = _cases(
        n, F.lit("../c d"), _text("?q=", n), F.lit("//OTHER.example:443/x/"), F.lit("http://0x7f.1/"), _text("HTTPS://", F.upper(name), "./%7Euser"), F.lit("./x/./y/../z"), F.lit("/%2fa"), F.lit("#top"), _text("http://", name, ":8080"),
    )
    any_port = DEFAULT.with_changes(allowed_ports=None)
    return _domains(spark, sf_dir).select("id", C.normal_url(href, _text("https://", name, "/a/b"), any_port).alias("url"))


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, CASE id % 7 WHEN 1 THEN 'unsupported_scheme' WHEN 2 THEN 'ssrf_blocked' WHEN 3 THEN 'public_suffix' WHEN 4 THEN 'out_of_scope' WHEN 5 THEN 'non_html_extension' WHEN 6 THEN 'trap_pagination' END AS reason FROM d"
)
def url_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stateless reason against a link, and links without one."""
    n, name = F.col("id"), F.col("name")
    href = _cases(n, _text("/p/", n), F.lit("ftp://x.example/"), F.lit("http://10.0.0.8/"), F.lit("https://co.uk/"), F.lit("https://elsewhere.test/x"), F.lit("/x.PDF"), F.lit("/l?page=999"))
    decided = C.decision(href, _text("https://", name, "/"), name, as_of=AS_OF)
    return _domains(spark, sf_dir).select("id", decided.alias("d")).select("id", "d.reason")


_CAPS_SQL = (
    f"WITH {PAGES_SQL}, k AS (SELECT crawl_id, id, id % 2 AS kind, (id // 2) % 97 AS v FROM p), f AS (SELECT crawl_id, kind, v, min(id) AS first FROM k GROUP BY ALL),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, kind ORDER BY first) AS place FROM f)"
    " SELECT crawl_id, id AS seq, CASE WHEN kind = 0 AND place > 30 THEN 'trap_query_variants' WHEN kind = 1 AND place > 40 THEN 'trap_calendar' WHEN id > first THEN 'duplicate' END AS reason FROM k JOIN r USING (crawl_id, kind, v)"
)


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    pages = table(spark, sf_dir, "crawl_pages").select("id", "crawl_id").dropDuplicates(["id"])
    v = F.pmod(F.floor(n / 2), F.lit(97))
    return pages.withColumn("url", F.when(F.pmod(n, F.lit(2)) == 0, _text("https://e.example/list?v=", v)).otherwise(_text("https://e.example/calendar/", v)))


@register(_CAPS_SQL)
def admission_caps_by_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links beyond the limits of query variants of a path and of URLs of a calendar, by ranks."""
    return admission.admit_by_windows(_capped(spark, sf_dir), seq="id").select("crawl_id", "seq", "reason")


@register(_CAPS_SQL)
def admission_caps_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in one ordered pass for each crawl."""
    return admission.admit_in_order(_capped(spark, sf_dir), seq="id").select("crawl_id", "seq", "reason")


@register(
    f"WITH {PAGES_SQL}, k AS (SELECT crawl_id, id, id % 30 AS page, id % 30 >= 20 AND id % 3 = 0 AS nothing FROM p), e AS (SELECT crawl_id, min(page) AS cut FROM k WHERE nothing GROUP BY crawl_id)"
    " SELECT k.crawl_id, id, page FROM k JOIN e USING (crawl_id) WHERE page >= cut"
)
def empty_page_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of listings from the first empty one on."""
    n = F.col("id")
    pages = table(spark, sf_dir, "crawl_pages").select("id", "crawl_id").dropDuplicates(["id"]).withColumn("url", _text("https://e.example/l?page=", F.pmod(n, F.lit(30))))
    empty = pages.filter((F.pmod(n, F.lit(30)) >= 20) & (F.pmod(n, F.lit(3)) == 0))
    return admission.beyond_empty_pages(pages, empty).select("crawl_id", "id", F.col("page").cast("bigint").alias("page"))


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, CASE id % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_found' WHEN 2 THEN 'not_found' WHEN 3 THEN 'forbidden' WHEN 4 THEN 'forbidden' WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'server_error' WHEN 7 THEN 'http_error' ELSE 'http_error' END AS status FROM d"
)
def discovery_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the answer to a request for robots.txt or a sitemap means."""
    code = _cases(F.col("id"), *(F.lit(str(c)) for c in (200, 404, 410, 401, 403, 429, 503, 302, 418))).cast("int")
    return _domains(spark, sf_dir).select("id", crawl.discovery_status(code).alias("status"))


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, CASE id % 7 WHEN 0 THEN 'redirect_not_followed' WHEN 1 THEN 'redirect_error' WHEN 2 THEN 'too_large' WHEN 3 THEN 'http_error' WHEN 4 THEN 'unsupported_content_type' WHEN 5 THEN 'too_large' ELSE 'ok' END AS outcome FROM d"
)
def fetch_outcome_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rung of the outcomes of a fetch."""
    n = F.col("id")
    status = _cases(n, *(F.lit(str(c)) for c in (301, 302, 200, 404, 200, 200, 204))).cast("int")
    location, declared = F.when(F.pmod(n, F.lit(7)) == 0, F.lit("/x")), F.when(F.pmod(n, F.lit(7)) == 2, F.lit("99999999"))
    kind = F.when(F.pmod(n, F.lit(7)) == 4, F.lit("application/pdf")).otherwise(F.lit("text/html; charset=utf-8"))
    size = F.when(F.pmod(n, F.lit(7)) == 5, F.lit(6 << 20)).otherwise(F.lit(10))
    return _domains(spark, sf_dir).select("id", crawl.outcome(status, location, declared, kind, size).alias("outcome"))


# ---------------------------------------------------------------- more of pages and leads


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, CASE WHEN id % 6 < 4 THEN 'Größe ' || id END AS title, CASE id % 6 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'cp1252' WHEN 2 THEN 'utf-16' WHEN 3 THEN 'iso8859-1' END AS encoding FROM d"
)
def decoded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies by header (the bytes of both Latin encodings are the same here), byte order mark and ``<meta>``; other content and failed fetches are no pages."""
    n = F.col("id")
    html = _text("<title>Größe ", n, "</title>")
    declared = _text("<meta charset=iso-8859-1>", html)
    k = F.pmod(n, F.lit(6))
    body = F.when(k == 1, F.encode(html, "ISO-8859-1")).when(k == 2, F.encode(html, "UTF-16")).when(k == 3, F.encode(declared, "ISO-8859-1")).otherwise(F.encode(html, "UTF-8"))
    kind = F.when(k == 4, F.lit("application/json")).otherwise(F.lit("text/html"))
    charset = F.when(k == 1, F.lit("windows-1252"))
    outcome = F.when(k == 5, F.lit("http_error")).otherwise(F.lit("ok"))
    page = C.parsed_response(outcome, body, kind, charset, F.lit("https://e.example/x"))
    return _domains(spark, sf_dir).select("id", page.alias("p")).select("id", "p.title", "p.encoding")


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, 'A ' || id || ' & B' AS title, 'Tells ' || label AS description, 'https://' || name || '/' AS canonical_url, '/f.ico' AS favicon_url, 'summary' AS twitter_card,"
    " 'One' || chr(10) || 'Two ' || id AS text, 1 AS headings, 1 AS images FROM d"
)
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, metadata, visible text, headings and images of a page with hidden parts."""
    n, name = F.col("id"), F.col("name")
    html = _text(
        "<html><head><title> A ", n, " &amp;  B</title><meta name=Description content='Tells ", F.col("label"), "'><link rel=canonical href='https://", name, "/'><link rel='shortcut icon' href=/f.ico>"
        "<meta name=twitter:card content=summary><style>x{}</style></head><body><script>no()</script><h1>One</h1><img src=a><p>Two  ", n, "</p><noscript>hidden</noscript></body></html>",
    )
    page = _domains(spark, sf_dir).select("id", C.parsed_page(html, F.lit("https://e.example/x")).alias("p"))
    m = "p.metadata."
    return page.select("id", "p.title", m + "description", m + "canonical_url", m + "favicon_url", m + "twitter_card", "p.text", F.size("p.headings").alias("headings"), F.col("p.metrics.image_count").cast("int").alias("images"))


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, CASE id % 5 WHEN 0 THEN 'fa' WHEN 1 THEN 'mixed' WHEN 2 THEN 'en' WHEN 3 THEN 'fa' ELSE 'unknown' END AS language,"
    " CASE id % 5 WHEN 0 THEN 'html_lang' WHEN 1 THEN 'html_lang' WHEN 2 THEN 'content' WHEN 3 THEN 'content' ELSE 'none' END AS source FROM d"
)
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of pages, declared or told by the text."""
    n = F.col("id")
    html = _cases(n, F.lit("<html lang=fa-IR><p>x</p>"), F.lit("<html lang='en, fa'><p>x</p>"), _text("<html lang=und><p>hello there wonderful world</p>"), F.lit("<p>این یک متن فارسی است</p>"), F.lit("<p>abc</p>"))
    return _domains(spark, sf_dir).select("id", C.parsed_page(html, F.lit("https://e.example/x"))["language"].alias("l")).select("id", "l.language", "l.source")


@register(
    f"WITH {_DOMAINS_SQL} SELECT id, CASE id % 3 WHEN 0 THEN 'a@' || name || '|info@' || name WHEN 1 THEN 'info@' || name ELSE '' END AS emails, CASE id % 3 WHEN 0 THEN '03012345' || (100 + id % 900) WHEN 1 THEN '+4930' || (1000000 + id) ELSE '' END AS phones FROM d"
)
def page_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailboxes and numbers of links and text together; each once."""
    n, name = F.col("id"), F.col("name")
    three = (F.lit(100) + F.pmod(n, F.lit(900))).cast("string")
    html = _cases(
        n, _text("<a href='mailto:INFO@", name, "?subject=x'>m</a> write a@", name, " or info@", name, " <a href='tel:030-12345-", three, ";ext=1'>t</a>"), _text("<p>info@", name, ", +49 30 ", n + 1000000, "</p>"), F.lit("<p>logo@2x.png 2024-05-01</p>"),
    )
    page = _domains(spark, sf_dir).select("id", C.parsed_page(html, F.lit("https://e.example/x")).alias("p"))
    return page.select("id", F.array_join("p.emails", "|").alias("emails"), F.array_join(F.transform("p.phones", lambda p: p["number"]), "|").alias("phones"))


@register(f"WITH {LEADS_SQL}, {FOLD_SQL} SELECT domain, business_name, description, page_type, language, emails, phones, first_seen, last_seen FROM fold")
def lead_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads written as JSON objects and read again."""
    return flat(export.read_json(export.lead_json(folded(spark, sf_dir)).select("json"))).select("domain", "business_name", "description", "page_type", "language", "emails", "phones", "first_seen", "last_seen")


@register(f"WITH {LEADS_SQL}, {FOLD_SQL} SELECT domain FROM fold WHERE language IN ('en', 'fr') AND email_count > 0 ORDER BY last_seen DESC NULLS LAST, domain LIMIT 40 OFFSET 40")
def lead_query_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a selection that was written as a dictionary and read again."""
    held = query.LeadFilter(language=["FR", "en"], has_email=True).to_dict()
    wanted = query.LeadQuery(query.LeadFilter.from_dict(held), sort_by="last_seen", descending=True, page=2, page_size=40)
    return wanted.run(folded(spark, sf_dir)).rows.select("domain")
