"""The driver's queries over the project's tables, and the same in SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions import columns as C
from siteloom.functions.rules import UrlRules
from siteloom.operators import admission, crawl, leads, query, store
from siteloom.session import cut_lineage, shared_folder, spread, table
from siteloom.sources import export
from siteloom.sources import pages as sources
from siteloom.sources.robots import robots
from siteloom.sources.sitemap import expand
from siteloom.streaming.leads import LeadTable, merge_stream

Query = Callable[[SparkSession, str], DataFrame]

#: Date that judges calendars.
AS_OF = date(2026, 1, 1)
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def added(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return added


_query = register

# ---------------------------------------------------------------- shared inputs


def _pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    pages = table(spark, sf_dir, "crawl_pages")
    return (pages.select("id", *columns) if columns else pages).dropDuplicates(["id"])


def _crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawls").dropDuplicates(["id"])


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page leads in normal form, once each, with their order of arrival."""
    rows = table(spark, sf_dir, "page_leads").dropDuplicates(["lead_id"]).withColumnRenamed("domain", "_domain").drop("_domain")
    return leads.from_sightings(rows).withColumn("seq", F.col("lead_id"))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.fold(_leads(spark, sf_dir))


#: Leads in normal form, in SQL: ``l`` has one row for each lead.
LEADS_SQL = r"""
l AS (
  SELECT lead_id, created_at,
    list_aggregate(list_slice(string_split(rtrim(lower(regexp_extract(website, '^\s*(?:[A-Za-z]+:)?(?://)?([^/:?#\s]+)', 1)), '.'), '.'), -2, -1), 'string_agg', '.') AS domain,
    nullif(trim(regexp_replace(business_name, '[\s\v\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')), '') AS business_name,
    nullif(trim(description, ' '), '') AS description,
    list_sort(list_distinct(list_filter(list_transform(emails, lambda x: lower(trim(x, ' '))),
      lambda x: regexp_full_match(x, '[a-z0-9](?:[a-z0-9._%+-]*[a-z0-9])?@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24}') AND NOT contains(x, '..')
           AND NOT regexp_matches(x, '\.(?:png|jpg|jpeg|gif|svg|webp|avif|ico|bmp|css|js|woff|woff2|ttf|eot)$')))) AS emails,
    phones,
    CASE WHEN lower(trim(page_type)) IN ('homepage','about','contact','services','product','blog','article','portfolio','careers','other') THEN lower(trim(page_type)) END AS page_type,
    nullif(lower(trim(language)), '') AS language, nullif(trim(source_url), '') AS source_url, first_seen, last_seen
  FROM (SELECT DISTINCT ON (lead_id) * FROM page_leads)
  WHERE website IS NOT NULL
)"""
#: The fold of ``l`` by arrival, in SQL.
FOLD_SQL = r"""
f AS (
  SELECT domain,
    arg_min(business_name, lead_id) FILTER (business_name IS NOT NULL) AS business_name,
    arg_min(description, lead_id) FILTER (description IS NOT NULL) AS description,
    arg_min_null(page_type, lead_id) FILTER (page_type IS NOT NULL OR source_url IS NOT NULL) AS page_type,
    arg_min_null(source_url, lead_id) FILTER (page_type IS NOT NULL OR source_url IS NOT NULL) AS source_url,
    coalesce(arg_min(language, lead_id) FILTER (language IS NOT NULL AND language <> 'unknown'), max(CASE WHEN language = 'unknown' THEN 'unknown' END)) AS language,
    min(first_seen) AS first_seen, max(last_seen) AS last_seen
  FROM l GROUP BY domain
), fe AS (
  SELECT domain, string_agg(e, '|' ORDER BY e) AS emails, count(*) AS n FROM (SELECT DISTINCT domain, unnest(emails) AS e FROM l) GROUP BY domain
), fp AS (
  SELECT domain, string_agg(p, '|' ORDER BY p) AS phones, count(*) AS n FROM (SELECT DISTINCT domain, unnest(phones).number AS p FROM l) WHERE p IS NOT NULL GROUP BY domain
), fold AS (
  SELECT f.*, coalesce(fe.emails, '') AS emails, coalesce(fp.phones, '') AS phones, coalesce(fe.n, 0) AS email_count, coalesce(fp.n, 0) AS phone_count
  FROM f LEFT JOIN fe USING (domain) LEFT JOIN fp USING (domain)
)"""
#: Host of an address in SQL, and pages once each.
PAGES_SQL = "p AS (SELECT DISTINCT ON (id) * FROM crawl_pages)"
NORMAL_URL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]+')) || regexp_extract(url, '^[A-Za-z]+://[^/?#]+(.*)$', 1),
  '#.*$', ''), '([?&])utm_source=[^&]*', '\1', 'g'), '[?&]+$', ''), '([^:/])//+', '\1/', 'g')"""
URL_SQL = rf"""
n AS (
  SELECT *, CASE WHEN regexp_matches(u, '^https?://[^/?]+$') THEN u || '/' WHEN regexp_matches(u, '^https?://[^/?]+\?') THEN regexp_replace(u, '\?', '/?') ELSE u END AS normal
  FROM (SELECT *, regexp_replace(regexp_replace({NORMAL_URL}, '/+$', ''), '/+\?', '?') AS u FROM p)
)"""


def _flat(df: DataFrame) -> DataFrame:
    """Arrays of a lead as joined text, so that results compare as plain values."""
    emails = F.array_join("emails", "|")
    phones = F.array_join(F.transform("phones", lambda p: p["number"]), "|")
    return df.withColumn("emails", emails).withColumn("phones", phones)


# ---------------------------------------------------------------- URLs


@_query(f"WITH {PAGES_SQL}, {URL_SQL} SELECT id, normal AS url FROM n")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir, "url").select("id", C.normal_url("url").alias("url"))


@_query(
    f"WITH {PAGES_SQL}, {URL_SQL}"
    + r" SELECT id, regexp_extract(normal, '^(https?)', 1) AS scheme, regexp_extract(normal, '://([^/]+)', 1) AS host, regexp_extract(normal, '://[^/]+([^?]*)', 1) AS path,"
    r" regexp_extract(normal, '\?(.*)$', 1) AS query, len(list_filter(string_split(regexp_extract(normal, '://[^/]+([^?]*)', 1), '/'), lambda x: x <> '')) AS segments FROM n"
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _pages(spark, sf_dir, "url").select("id", C.normalised("url").alias("n"))
    return n.select("id", "n.scheme", "n.host", "n.path", "n.query", F.size("n.segments").cast("bigint").alias("segments"))


@_query(f"WITH {PAGES_SQL}, {URL_SQL}" + r" SELECT id, regexp_extract(normal, '[?&]page=([^&]*)', 1) AS value FROM n WHERE regexp_matches(normal, '[?&]page=')")
def url_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _pages(spark, sf_dir, "url").select("id", C.normalised("url").alias("n")).select("id", F.explode("n.params").alias("p"))
    return n.filter("p.name = 'page'").select("id", F.col("p.value").alias("value"))


@_query(r"SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, array_to_string(string_split(lower(regexp_extract(url, '://([^/?#]+)', 1)), '.')[-2:], '.') AS domain FROM crawl_pages")
def url_registered_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "crawl_pages").select(F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("host")).distinct()
    return hosts.select("host", C.registered_domain("host").alias("domain"))


@_query(f"WITH {LEADS_SQL} SELECT lead_id, domain FROM l")
def url_site_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "page_leads").select("lead_id", "website").distinct()
    return rows.select("lead_id", C.website_identity("website")["domain"].alias("domain")).filter("domain IS NOT NULL")


@_query(f"WITH {PAGES_SQL} SELECT crawl_id, count(*) AS pages, count(*) FILTER (url_hash = sha256(url)) AS good FROM p GROUP BY crawl_id")
def url_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir, "crawl_id", "url", "url_hash")
    return pages.groupBy("crawl_id").agg(F.count("*").alias("pages"), F.count(F.when(F.col("url_hash") == C.url_hash("url"), 1)).alias("good"))


@_query(
    f"WITH {PAGES_SQL}, {URL_SQL}"
    + r", k AS (SELECT crawl_id, id, regexp_replace(regexp_replace(normal, '^https?:', ''), '^//www\.', '//') AS key FROM n)"
    " SELECT crawl_id, key AS dedupe_key, min(id) AS first_id, count(*) AS pages FROM k GROUP BY crawl_id, key"
)
def url_dedupe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _pages(spark, sf_dir, "crawl_id", "url").withColumn("dedupe_key", C.dedupe_key("url"))
    return keyed.groupBy("crawl_id", "dedupe_key").agg(F.min("id").alias("first_id"), F.count("*").alias("pages"))


@_query(f"WITH {PAGES_SQL}" + r" SELECT id, CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT) AS number FROM p WHERE regexp_matches(url, '[?&]page=[0-9]+')")
def url_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pages(spark, sf_dir, "url").select("id", C.paging("url").alias("p"))
    return found.filter("p IS NOT NULL").select("id", "p.number")


@_query(
    f"WITH {PAGES_SQL}"
    + r", e AS (SELECT lower(regexp_extract(regexp_extract(url, '://[^/]+([^?#]*)', 1), '\.([^./;]{1,8})$', 1)) AS extension FROM p)"
    " SELECT extension, extension IN ('pdf','txt','xml','json','css','js','jpg','jpeg','png','gif','zip','doc','docx') AS blocked, count(*) AS pages FROM e GROUP BY ALL"
)
def url_extension_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"://[^/]+([^?#]*)", 1)
    rows = _pages(spark, sf_dir, "url").select(C.path_extension(path).alias("extension"), C.extension_problem(path).isNotNull().alias("blocked"))
    return rows.groupBy("extension", "blocked").agg(F.count("*").alias("pages"))


@_query(
    f"WITH {PAGES_SQL}, {URL_SQL}"
    + r", s AS (SELECT regexp_extract(normal, '://([^/]+)', 1) || '/' || regexp_replace(ltrim(regexp_extract(normal, '://[^/]+([^?]*)', 1), '/'), '[0-9]+', '#', 'g') || '?'"
    r" || regexp_replace(regexp_extract(normal, '\?(.*)$', 1), '[0-9]+', '#', 'g') AS signature FROM n) SELECT signature, count(*) AS pages FROM s GROUP BY signature"
)
def url_pattern_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir, "url").select(C.signature("url").alias("signature"))
    return rows.groupBy("signature").agg(F.count("*").alias("pages"))


_SCOPE_SQL = (
    f"WITH {PAGES_SQL}"
    + r", h AS (SELECT lower(regexp_extract(p.url, '://([^/?#:]+)', 1)) AS host, lower(regexp_extract(c.seed_url, '://([^/?#:]+)', 1)) AS seed"
    " FROM p JOIN (SELECT DISTINCT ON (id) * FROM crawls) c ON p.crawl_id = c.id)"
    ", m AS (SELECT unnest(['exact','www','relevant','all']) AS mode), d AS (SELECT mode, CASE"
    " WHEN host = seed THEN 'ok' WHEN array_to_string(string_split(host, '.')[-2:], '.') <> array_to_string(string_split(seed, '.')[-2:], '.') THEN 'out_of_scope'"
    " WHEN mode = 'exact' THEN 'subdomain_not_relevant' WHEN regexp_replace(host, '^www\\.', '') = regexp_replace(seed, '^www\\.', '') OR mode = 'all' THEN 'ok'"
    " WHEN mode = 'www' THEN 'subdomain_not_relevant' WHEN regexp_extract(host, '^(.*)\\.[^.]+\\.[^.]+$', 1) IN ('www','blog','en','fa','de','es','fr','about','team','news') THEN 'ok'"
    " ELSE 'subdomain_not_relevant' END AS result FROM h, m) SELECT mode, result, count(*) AS pages FROM d GROUP BY ALL"
)


@_query(_SCOPE_SQL)
def url_scope_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = r"://([^/?#:]+)"
    pages = _pages(spark, sf_dir, "crawl_id", "url").select("crawl_id", F.lower(F.regexp_extract("url", host, 1)).alias("host"))
    seeds = _crawls(spark, sf_dir).select(F.col("id").alias("crawl_id"), F.lower(F.regexp_extract("seed_url", host, 1)).alias("seed"))
    # Hosts of a crawl are few beside its pages: judge each pair once.
    pairs = pages.groupBy("crawl_id", "host").agg(F.count("*").alias("n")).join(seeds, "crawl_id")
    found = None
    for mode in ("exact", "www", "relevant", "all"):
        s = C.scope("host", "seed", UrlRules(subdomain_mode=mode))
        one = pairs.select(F.lit(mode).alias("mode"), F.coalesce(s["reason"], F.lit("ok")).alias("result"), "n")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("mode", "result").agg(F.sum("n").alias("pages"))


@_query(
    f"WITH {PAGES_SQL}, {URL_SQL}"
    + r" SELECT id, 'trap_pagination' AS trap FROM n WHERE TRY_CAST(regexp_extract(normal, '[?&]page=([0-9]+)', 1) AS BIGINT) > 50"
)
def url_trap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir, "url").select("id", C.trap("url", as_of=AS_OF).alias("trap")).filter("trap IS NOT NULL")


@_query(
    r"""
WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS address FROM documents),
o AS (SELECT address, list_transform(string_split(address, '.'), lambda x: CAST(x AS INT)) AS o FROM f)
SELECT address, CASE WHEN len(list_filter(o, lambda x: x > 255)) > 0 THEN NULL
  WHEN address IN ('169.254.169.254','169.254.170.2','100.100.100.200','168.63.129.16','192.0.0.192') THEN 'metadata'
  WHEN o[1] = 0 THEN 'unspecified' WHEN o[1] = 10 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) THEN 'private'
  WHEN o[1] = 100 AND o[2] BETWEEN 64 AND 127 THEN 'cgnat' WHEN o[1] = 127 THEN 'loopback' WHEN o[1] = 169 AND o[2] = 254 THEN 'link_local'
  WHEN (o[1] = 192 AND o[2] = 0 AND o[3] = 0) OR (o[1] = 192 AND o[2] = 88 AND o[3] = 99) OR o[1] >= 240 THEN 'reserved'
  WHEN (o[1] = 192 AND o[2] = 0 AND o[3] = 2) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113) THEN 'documentation'
  WHEN o[1] = 198 AND o[2] IN (18, 19) THEN 'benchmarking' WHEN o[1] BETWEEN 224 AND 239 THEN 'multicast' END AS reason FROM o
"""
)
def ssrf_ip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = F.lit(r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})")
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", pattern)).alias("address")).distinct()
    return found.select("address", C.ipv4_block_reason("address").alias("reason"))


@_query("SELECT DISTINCT name AS host, 'ok' AS result FROM domains")
def ssrf_host_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "domains").select(F.col("name").alias("host")).distinct()
    return hosts.select("host", F.coalesce(C.host_block_reason("host"), F.lit("ok")).alias("result"))


@_query(
    f"WITH {PAGES_SQL}, {URL_SQL}"
    + r", k AS (SELECT crawl_id, id, normal, row_number() OVER (PARTITION BY crawl_id, regexp_replace(regexp_replace(normal, '^https?:', ''), '^//www\.', '//') ORDER BY id) AS r,"
    r" TRY_CAST(regexp_extract(normal, '[?&]page=([0-9]+)', 1) AS BIGINT) AS page FROM n)"
    " SELECT crawl_id, id AS seq, NOT (coalesce(page, 0) > 50 OR r > 1) AS allowed, normal AS url, CASE WHEN page > 50 THEN 'trap_pagination' WHEN r > 1 THEN 'duplicate' END AS reason FROM k"
)
def url_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL through the gate of its crawl, in order."""
    pages = _pages(spark, sf_dir, "crawl_id", "url")
    return admission.admit_in_order(pages, seq="id", as_of=AS_OF).select("crawl_id", "seq", "allowed", "url", "reason")


@_query(
    f"WITH {PAGES_SQL}, {URL_SQL}"
    + r", k AS (SELECT crawl_id, id, row_number() OVER (PARTITION BY crawl_id, regexp_replace(regexp_replace(normal, '^https?:', ''), '^//www\.', '//') ORDER BY id) AS r,"
    r" TRY_CAST(regexp_extract(normal, '[?&]page=([0-9]+)', 1) AS BIGINT) AS page FROM n)"
    " SELECT crawl_id, CASE WHEN page > 50 THEN 'trap_pagination' ELSE 'duplicate' END AS reason, count(*) AS urls FROM k WHERE page > 50 OR r > 1 GROUP BY ALL"
)
def gate_rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "crawl_pages").select("id", "crawl_id", "url"))
    return admission.rejections(admission.admit_by_windows(pages, seq="id", as_of=AS_OF, repeated=True))


# ---------------------------------------------------------------- fetches and crawls


@_query(
    f"WITH {PAGES_SQL} SELECT nullif(trim(lower(string_split(content_type, ';')[1])), '') AS media_type,"
    " nullif(regexp_extract(lower(content_type), ';\\s*charset\\s*=\\s*[\"'']?([^\"'';\\s]+)', 1), '') AS charset, count(*) AS pages FROM p GROUP BY ALL"
)
def fetch_media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir, "content_type").select(C.media_type("content_type").alias("media_type"), C.charset("content_type").alias("charset"))
    return rows.groupBy("media_type", "charset").agg(F.count("*").alias("pages"))


@_query(
    f"WITH {PAGES_SQL} SELECT status, CASE WHEN http_status NOT BETWEEN 200 AND 299 THEN 'http_error' WHEN lower(string_split(content_type, ';')[1]) NOT IN"
    " ('text/html', 'application/xhtml+xml') THEN 'unsupported_content_type' WHEN response_size > 5242880 THEN 'too_large' ELSE 'ok' END AS outcome, count(*) AS pages"
    " FROM p WHERE http_status IS NOT NULL GROUP BY ALL"
)
def fetch_outcome_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir, "status", "http_status", "content_type", "response_size").filter("http_status IS NOT NULL")
    null = F.lit(None).cast("string")
    found = crawl.outcome(F.col("http_status"), null, null, F.col("content_type"), F.col("response_size"))
    return rows.groupBy("status", found.alias("outcome")).agg(F.count("*").alias("pages"))


@_query(
    f"WITH RECURSIVE {PAGES_SQL}, e AS (SELECT url, min(final_url) AS nxt FROM p WHERE final_url <> url GROUP BY url),"
    " c AS (SELECT url AS start, url AS place, [url] AS seen, 0 AS hops, CAST(NULL AS VARCHAR) AS problem, false AS done FROM e"
    " UNION ALL SELECT start, CASE WHEN list_contains(seen, nxt) OR hops >= 5 THEN place ELSE nxt END, list_append(seen, nxt), CASE WHEN list_contains(seen, nxt) OR hops >= 5 THEN hops ELSE hops + 1 END,"
    " CASE WHEN list_contains(seen, nxt) THEN 'loop' WHEN hops >= 5 THEN 'too_many' END, list_contains(seen, nxt) OR hops >= 5 FROM c JOIN e ON c.place = e.url WHERE NOT done)"
    " SELECT start AS url, arg_max(place, len(seen)) AS final_url, max(hops) AS hops, max(problem) AS problem FROM c GROUP BY start"
)
def redirect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = _pages(spark, sf_dir, "url", "final_url").filter("final_url <> url").select("url", F.col("final_url").alias("location"))
    return crawl.follow_redirects(hops.select("url").distinct(), hops)


@_query("SELECT crawl_id, status, count(DISTINCT id) AS pages FROM crawl_pages GROUP BY ALL")
def crawl_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.status_counts(table(spark, sf_dir, "crawl_pages"))


@_query(
    f"WITH {PAGES_SQL}, s AS (SELECT crawl_id, count(*) AS total_pages, count(*) FILTER (status IN ('fetched','failed')) AS visited, count(*) FILTER (status = 'fetched') AS successful,"
    " count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'skipped') AS skipped,"
    " max(depth) FILTER (status IN ('fetched','failed')) AS current_depth, max(updated_at) AS pages_at FROM p GROUP BY crawl_id)"
    " SELECT c.id AS crawl_id, c.status, CASE WHEN c.status = 'pending' THEN 'created' WHEN c.status IN ('completed','failed') THEN c.status"
    " WHEN c.status = 'cancelled' OR stop_reason IS NOT NULL THEN 'stopped' ELSE 'running' END AS lifecycle, stop_reason, seed_url, created_at, started_at, finished_at,"
    " greatest(updated_at, pages_at) AS last_update_at, coalesce(current_depth, 0) AS current_depth, coalesce(total_pages, 0) AS total_pages, coalesce(visited, 0) AS visited,"
    " coalesce(successful, 0) AS successful, coalesce(s.failed, 0) AS failed, coalesce(s.pending, 0) AS pending, coalesce(skipped, 0) AS skipped"
    " FROM (SELECT DISTINCT ON (id) * FROM crawls) c LEFT JOIN s ON c.id = s.crawl_id"
)
def crawl_state_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.state_report(table(spark, sf_dir, "crawls"), table(spark, sf_dir, "crawl_pages"))


@_query(
    f"WITH {PAGES_SQL}, {URL_SQL.replace('FROM p)', 'FROM (SELECT crawl_id, final_url AS url FROM p WHERE final_url IS NOT NULL))')}"
    " SELECT p.crawl_id, p.id FROM p WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM n WHERE n.crawl_id = p.crawl_id AND n.normal = p.url)"
)
def crawl_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.pending(_pages(spark, sf_dir)).select("crawl_id", "id")


@_query(
    f"WITH {PAGES_SQL}, r AS (SELECT c.id AS crawl_id, max_pages - (SELECT count(*) FROM p WHERE p.crawl_id = c.id AND status IN ('fetched','failed','pending')) AS room"
    " FROM (SELECT DISTINCT ON (id) * FROM crawls) c WHERE status IN ('pending','running')), s AS (SELECT crawl_id, id, row_number() OVER (PARTITION BY crawl_id ORDER BY id) AS n FROM p WHERE status = 'skipped')"
    " SELECT s.crawl_id, id FROM s JOIN r USING (crawl_id) WHERE n <= room"
)
def crawl_resume_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.resume(_pages(spark, sf_dir), table(spark, sf_dir, "crawls")).filter("promoted").select("crawl_id", "id")


_EVENT_STATES = {"signup": "pending", "view": "running", "purchase": "completed", "error": "failed", "click": "cancelled"}


@_query(
    "WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status FROM events),"
    " t AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)"
    " SELECT user_id, event_id, before, status FROM t WHERE before IS NOT NULL AND before <> status AND NOT (before = 'pending' AND status IN ('running','failed','cancelled'))"
    " AND NOT (before = 'running' AND status IN ('completed','failed','cancelled'))"
)
def crawl_transition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a log: here the events of users stand for the states of crawls."""
    states = F.create_map(*[F.lit(x) for pair in _EVENT_STATES.items() for x in pair])
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.try_element_at(states, F.col("event_type")).alias("status"))
    return crawl.bad_transitions(log, key="user_id", order="event_id").select("user_id", "event_id", "before", "status")


@_query(f"WITH {PAGES_SQL} SELECT id, CAST((row_number() OVER (PARTITION BY crawl_id ORDER BY id) - 1) AS DOUBLE) * 0.5 AS starts_at FROM p")
def rate_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.rate_schedule(_pages(spark, sf_dir, "crawl_id"), host="crawl_id", order="id", delay=0.5).select("id", "starts_at")


@_query()
def crawl_bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first replay of all crawls, each within its own limits, over the links that their pages had."""
    pages = _pages(spark, sf_dir, "crawl_id", "url", "parent_url")
    edges = pages.filter("parent_url IS NOT NULL").select(C.normal_url("parent_url").alias("url"), F.col("id").alias("position"), F.col("url").alias("href"))
    seeds = _crawls(spark, sf_dir).select(F.col("id").alias("crawl_id"), F.col("seed_url").alias("url"), "max_depth", "max_pages")
    return crawl.replay(seeds, edges.distinct(), as_of=AS_OF).select("crawl_id", "url", "depth", "status")


@_query(f"WITH {PAGES_SQL}, {URL_SQL} SELECT 'https://sitemaps.example/' || crawl_id || '-' || (id % 64) || '.xml' AS sitemap, normal AS url, 1 AS depth FROM n")
def sitemap_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses of sitemaps made of all crawled URLs: one file for each crawl below one index."""
    pages = _pages(spark, sf_dir, "crawl_id", "url")
    xml = F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')
    escaped = F.regexp_replace(F.regexp_replace("url", "&", "&amp;"), "<", "&lt;")
    part = F.concat(F.lit("https://sitemaps.example/"), F.col("crawl_id").cast("string"), F.lit("-"), F.pmod("id", F.lit(64)).cast("string"), F.lit(".xml"))
    files = pages.groupBy(part.alias("url")).agg(F.concat(xml, F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc></url>")))), ""), F.lit("</urlset>")).alias("body"))
    indexes = files.groupBy(F.concat(F.lit("https://sitemaps.example/index-"), F.pmod(F.xxhash64("url"), F.lit(16)).cast("string"), F.lit(".xml")).alias("url")).agg(
        F.concat(F.lit("<sitemapindex>"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>")))), ""), F.lit("</sitemapindex>")).alias("body")
    )
    both = files.unionByName(indexes).withColumn("body", F.encode("body", "utf-8"))
    return expand(both, indexes.select("url")).select("sitemap", "url", "depth")


@_query(
    "SELECT count(*) AS files, CAST(sum(CASE WHEN name LIKE '%a%' THEN 2 ELSE 1 END) AS BIGINT) AS groups, count(*) AS sitemaps FROM (SELECT DISTINCT name FROM domains)"
)
def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as sites of all domains could have them: one group, two where the name has an ``a``."""
    names = table(spark, sf_dir, "domains").select("name").distinct()
    more = F.when(F.col("name").contains("a"), "User-agent: b\nDisallow: /x\n").otherwise("")
    text = F.concat(F.lit("# robots\nUser-agent: *\nDisallow: /admin\nAllow: /\n"), more, F.lit("Sitemap: https://"), "name", F.lit("/sitemap.xml\nSitemap: /relative.xml\n"))
    r = names.select(robots(text).alias("r"))
    return r.agg(F.count("*").alias("files"), F.sum(F.size("r.groups")).alias("groups"), F.sum(F.size("r.sitemaps")).alias("sitemaps"))


# ---------------------------------------------------------------- pages and contacts


def _html(documents: DataFrame) -> DataFrame:
    """Documents as pages: a title, a heading, the text and a link."""
    documents = spread(documents.select("doc_id", "url", "site", "text"))
    text = F.coalesce(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), F.lit(""))
    head = F.concat(F.lit('<html><head><title>About us - '), "site", F.lit("</title><meta name=description content=Page></head><body><h1>Our team</h1><p>"))
    return documents.select("doc_id", "url", F.concat(head, text, F.lit('</p><a href="/contact">Contact</a> <a href="mailto:hello@'), "site", F.lit('">mail</a></body></html>')).alias("html"))


@_query("SELECT doc_id, 'About us - ' || site AS title, 1 AS headings, 2 AS links, 'hello@' || site AS mailbox FROM documents")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _html(table(spark, sf_dir, "documents")).select("doc_id", "url", C.parsed_page("html", "url").alias("p"))
    mailbox = F.get(F.filter("p.emails", lambda e: e.startswith("hello@")), F.lit(0))
    return pages.select("doc_id", "p.title", F.size("p.headings").cast("int").alias("headings"), F.size("p.links").cast("int").alias("links"), mailbox.alias("mailbox"))


@_query("SELECT doc_id, 0 AS position, '/contact' AS href FROM documents")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sources.links(_html(table(spark, sf_dir, "documents")).withColumn("key", F.col("doc_id")).select("html", F.col("key").cast("string").alias("url")))
    return found.select(F.col("url").cast("bigint").alias("doc_id"), "position", "href")


@_query()
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _html(table(spark, sf_dir, "documents")).select("doc_id", C.parsed_page("html", "url").alias("p"))
    return pages.select("doc_id", "p.metrics.character_count", "p.metrics.word_count", "p.metrics.email_count", "p.metrics.phone_count", "p.classification.category", "p.language.language")


@_query()
def lead_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead that each page makes, with its contacts counted."""
    rows = leads.from_pages(_html(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "domain", "website", "business_name", F.size("emails").alias("emails"), F.size("phones").alias("phones"), "page_type", "language")


_EMAIL = "[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\\.)+[A-Za-z]{2,24}"


@_query(f"SELECT doc_id, lower(e) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS e FROM documents) GROUP BY ALL")
def contact_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(C.emails_in("text")).alias("email"))


@_query()
def contact_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(C.phones_in("text")).alias("p"))
    return found.select("doc_id", "p.number", "p.raw")


@_query("SELECT DISTINCT lang, CASE WHEN regexp_full_match(trim(lang), '[A-Za-z]{2,3}') THEN lower(trim(lang)) END AS code FROM documents WHERE lang IS NOT NULL")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang").distinct().filter("lang IS NOT NULL").select("lang", C.language_code("lang").alias("code"))


@_query()
def content_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", C.content_language("text").alias("language"))


@_query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\s\v\x1c-\x1f\x{85}\p{Z}]+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) AS words FROM documents WHERE text IS NOT NULL")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", C.count_words("text").alias("words"))


# ---------------------------------------------------------------- leads


@_query(
    f"WITH {LEADS_SQL}, {FOLD_SQL}, c AS (SELECT domain, language, count(*) AS n FROM l WHERE language IS NOT NULL AND language <> 'unknown' GROUP BY ALL),"
    " m AS (SELECT domain, max(n) AS votes FROM c GROUP BY domain) SELECT domain, emails, phones, first_seen, last_seen, coalesce(votes, 0) AS votes FROM fold LEFT JOIN m USING (domain)"
)
def lead_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads per site whatever the order of their pages, with the votes for the language that was chosen."""
    rows = cut_lineage(_leads(spark, sf_dir))
    whole = _flat(leads.aggregate(rows))
    votes = rows.groupBy("domain", "language").agg(F.count("*").alias("votes"))
    known = whole.filter("language <> 'unknown'").join(votes, ["domain", "language"]).select("domain", "votes")
    return whole.join(known, "domain", "left").select("domain", "emails", "phones", "first_seen", "last_seen", F.coalesce("votes", F.lit(0)).alias("votes"))


FLAGSHIP: Query = lead_aggregate


@_query(f"WITH {LEADS_SQL}, {FOLD_SQL} SELECT domain, business_name, description, page_type, source_url, language, emails, phones, first_seen, last_seen FROM fold")
def lead_dedupe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_folded(spark, sf_dir)).select("domain", "business_name", "description", "page_type", "source_url", "language", "emails", "phones", "first_seen", "last_seen")


_SPLIT = "2025-06-01 00:00:00"


@_query(
    f"WITH {LEADS_SQL}, g AS (SELECT *, CASE WHEN created_at < TIMESTAMPTZ '2025-06-01 00:00:00+00' THEN 0 ELSE 1 END AS gen FROM l),"
    " o AS (SELECT domain, arg_min(business_name, (gen, lead_id)) FILTER (business_name IS NOT NULL) AS business_name, arg_min(description, (gen, lead_id)) FILTER (description IS NOT NULL) AS description,"
    " min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM g GROUP BY domain),"
    " e AS (SELECT domain, string_agg(x, '|' ORDER BY x) AS emails FROM (SELECT DISTINCT domain, unnest(emails) AS x FROM g) GROUP BY domain)"
    " SELECT o.*, coalesce(emails, '') AS emails FROM o LEFT JOIN e USING (domain)"
)
def lead_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads stored before a date, merged with those of later."""
    rows = cut_lineage(_leads(spark, sf_dir))
    early = F.col("created_at") < F.lit(_SPLIT).cast("timestamp")
    merged = leads.merge(leads.fold(rows.filter(early)), leads.fold(rows.filter(~early)))
    return _flat(merged).select("domain", "business_name", "description", "first_seen", "last_seen", "emails")


@_query(
    f"WITH {LEADS_SQL}, v AS (SELECT domain, 'business_name' AS field, business_name AS value, lead_id FROM l WHERE business_name IS NOT NULL UNION ALL"
    " SELECT domain, 'description', description, lead_id FROM l WHERE description IS NOT NULL), d AS (SELECT domain, field, value, min(lead_id) AS first_id FROM v GROUP BY ALL),"
    " k AS (SELECT domain, field, arg_min(value, first_id) AS kept FROM d GROUP BY ALL) SELECT domain, field, kept, value AS rejected FROM d JOIN k USING (domain, field) WHERE value <> kept"
)
def lead_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.conflicts(_leads(spark, sf_dir), F.col("lead_id")).select("domain", "field", "kept", "rejected")


@_query(
    f"WITH {LEADS_SQL}, v AS (SELECT domain, source_url, 'emails:' || unnest(emails) AS value FROM l UNION ALL SELECT domain, source_url, 'phones:' || unnest(phones).number FROM l)"
    " SELECT domain, value, string_agg(DISTINCT source_url, '|' ORDER BY source_url) AS sources FROM v WHERE source_url IS NOT NULL AND value IS NOT NULL GROUP BY ALL"
)
def lead_value_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.value_sources(_leads(spark, sf_dir)).select("domain", "value", F.array_join("sources", "|").alias("sources"))


@_query(f"WITH {LEADS_SQL} SELECT DISTINCT domain, 'lead:v1:' || domain AS key, sha256('lead:v1:' || domain) AS digest FROM l")
def lead_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = url_site_identity(spark, sf_dir).select("domain").distinct()
    return domains.select("domain", C.lead_key("domain").alias("key"), C.lead_digest("domain").alias("digest"))


@_query(
    "WITH m AS (SELECT DISTINCT ON (metadata_id) *, lower(regexp_extract(coalesce(canonical_url, og_url, favicon_url), '://([^/?#]+)', 1)) AS host FROM website_metadata)"
    " SELECT host, arg_min(title, metadata_id) FILTER (title IS NOT NULL) AS title, arg_min(description, metadata_id) FILTER (description IS NOT NULL) AS description,"
    " arg_min(keywords, metadata_id) FILTER (keywords IS NOT NULL) AS keywords, arg_min(twitter_card, metadata_id) FILTER (twitter_card IS NOT NULL) AS twitter_card FROM m WHERE host <> '' GROUP BY host"
)
def lead_metadata_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("canonical_url", "og_url", "favicon_url"), "://([^/?#]+)", 1))
    rows = table(spark, sf_dir, "website_metadata").dropDuplicates(["metadata_id"]).withColumn("host", host).filter("host <> ''")
    return leads.fill_metadata(rows, key="host", sequence="metadata_id", fields=["title", "description", "keywords", "twitter_card"])


#: The checks of ``leads.problems`` that the columns of ``l`` can fail. Websites and domains of ``l`` come of one another, and the table has no profiles.
_CHECKS_SQL = {
    "website is required": "domain IS NULL OR domain = ''",
    "invalid email address": "len(list_filter(emails, lambda x: NOT regexp_full_match(x, '[^@\\s]+@[^@\\s]+\\.[a-z]{2,24}'))) > 0",
    "invalid phone number": "len(list_filter(phones, lambda x: NOT regexp_full_match(x.number, '\\+?[0-9]{5,15}'))) > 0",
    "unknown page type": "page_type NOT IN ('homepage','about','contact','services','product','blog','article','portfolio','careers','other')",
    "last_seen is earlier than first_seen": "last_seen < first_seen",
}


@_query(f"WITH {LEADS_SQL} SELECT count(*) AS leads, count(*) FILTER (" + " OR ".join(f"({bad})" for bad in _CHECKS_SQL.values()) + ") AS bad FROM l")
def lead_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many leads in normal form there are, and how many have any problem."""
    judged = leads.problems(_leads(spark, sf_dir))
    return judged.agg(F.count("*").alias("leads"), F.count(F.when(F.size("problems") > 0, 1)).alias("bad"))


@_query(
    f"WITH {LEADS_SQL}, f AS (" + " UNION ALL ".join(f"SELECT '{text}' AS problem, lead_id FROM l WHERE {bad}" for text, bad in _CHECKS_SQL.items()) + ")"
    " SELECT problem, count(*) AS leads FROM f GROUP BY problem"
)
def lead_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of leads in normal form, none set aside, and how many leads have each."""
    judged = leads.problems(_leads(spark, sf_dir))
    return judged.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("leads"))


_FILTERED = f"WITH {LEADS_SQL}, {FOLD_SQL} SELECT domain FROM fold WHERE "


@_query(_FILTERED + "language IN ('fa', 'de')")
def lead_filter_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.filter_leads(_folded(spark, sf_dir), language=["FA", "de"]).select("domain")


@_query(_FILTERED + "email_count > 0 AND phone_count = 0")
def lead_filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.filter_leads(_folded(spark, sf_dir), has_email=True, has_phone=False).select("domain")


@_query(_FILTERED + "page_type = 'homepage' AND language = 'en' AND email_count > 0")
def lead_filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = query.LeadFilter(page_type=["homepage", "about"], language="en") & query.LeadFilter(page_type=["homepage", "contact"], has_email=True)
    return query.filter_leads(_folded(spark, sf_dir), both).select("domain")


@_query(_FILTERED + "false")
def lead_filter_never(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.filter_leads(_folded(spark, sf_dir), query.LeadFilter(language="en") & query.LeadFilter(language="fa")).select("domain")


def _ranked(sql_order: str) -> str:
    return f"WITH {LEADS_SQL}, {FOLD_SQL} SELECT domain, last_seen, row_number() OVER (ORDER BY {sql_order}) AS place FROM fold ORDER BY {sql_order} LIMIT 50 OFFSET 50"


def _page_of(df: DataFrame, **how: object) -> DataFrame:
    rows = query.paginate(df, 2, 50, **how)
    order = query.order_by(how.get("by", "domain"), how.get("descending", False))
    # One page of at most a thousand rows is numbered, not the table.
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)) + 50)


@_query(_ranked("last_seen DESC NULLS LAST, domain"))
def lead_page_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_of(_folded(spark, sf_dir), by="last_seen", descending=True).select("domain", "last_seen", F.col("place").cast("bigint").alias("place"))


@_query(_ranked("last_seen ASC NULLS LAST, domain"))
def lead_page_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_of(_folded(spark, sf_dir), by="last_seen").select("domain", "last_seen", F.col("place").cast("bigint").alias("place"))


@_query(_FILTERED + "false")
def lead_page_beyond_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.paginate(_folded(spark, sf_dir), 1_000_000, 1000).select("domain")


@_query(f"WITH {LEADS_SQL}, {FOLD_SQL} SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM fold")
def lead_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / 50).alias("pages"))


@_query(f"WITH {LEADS_SQL}, {FOLD_SQL} SELECT business_name, domain, email_count, phone_count, first_seen, last_seen FROM fold")
def lead_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.listing(_folded(spark, sf_dir)).drop("website")


@_query(
    f"WITH {LEADS_SQL}, {FOLD_SQL} SELECT coalesce(business_name, '') AS business_name, domain, coalesce(description, '') AS description, emails, phones, coalesce(page_type, '') AS page_type,"
    " coalesce(language, '') AS language, coalesce(source_url, '') AS source_url FROM fold"
)
def lead_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export_rows(_folded(spark, sf_dir)).select("business_name", "domain", "description", "emails", "phones", "page_type", "language", "source_url")


@_query(f"WITH {LEADS_SQL}, {FOLD_SQL} SELECT domain, business_name, language, emails, first_seen, last_seen FROM fold")
def stream_lead_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold as a stream that takes what there is: page leads in, stored leads out."""
    path = f"{sf_dir}/page_leads.parquet"
    kind = spark.read.parquet(path).schema
    reader = spark.readStream.schema(kind)
    single = os.path.isfile(path)
    rows = reader.option("pathGlobFilter", "page_leads.parquet").parquet(sf_dir) if single else reader.parquet(path)
    sightings = leads.from_sightings(rows.drop("domain")).withColumn("seq", F.col("lead_id"))
    folder = shared_folder(spark, "leads")
    target = LeadTable(spark, folder)
    merge_stream(sightings, target, f"{folder}/checkpoint", validate=False).awaitTermination()
    return target.read().withColumn("emails", F.array_join("emails", "|")).select("domain", "business_name", "language", "emails", "first_seen", "last_seen")


# ---------------------------------------------------------------- stored tables


@_query(f"WITH {LEADS_SQL}, e AS (SELECT DISTINCT domain, unnest(emails) AS email FROM l) SELECT domain, email, split_part(email, '@', 1) AS local_part, split_part(email, '@', 2) AS host FROM e")
def email_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _leads(spark, sf_dir).select("domain", F.explode("emails").alias("email")).distinct()
    return store.email_rows(rows).select("domain", "email", "local_part", "host")


@_query(
    f"WITH {LEADS_SQL}, e AS (SELECT domain, lead_id, source_url, unnest(emails) AS email FROM l)"
    " SELECT domain, email, count(*) AS occurrences, arg_min(source_url, lead_id) FILTER (source_url IS NOT NULL) AS snippet, CAST(0.5 AS DOUBLE) AS confidence FROM e GROUP BY domain, email"
)
def email_evidence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _leads(spark, sf_dir).select("domain", "lead_id", F.col("source_url").alias("snippet"), F.lit(0.5).alias("confidence"), F.explode("emails").alias("email"))
    return store.evidence(rows, ["domain", "email"], order="lead_id").select("domain", "email", "occurrences", "snippet", "confidence")


@_query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def verification_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key."""
    return store.newest(table(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id")


@_query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def pattern_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    early = F.col("event_type").isin("view", "click")
    return store.last_written(events.filter(early), events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@_query("SELECT DISTINCT id, name FROM domains WHERE contains(lower(name), 'bake')")
def domain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.search(table(spark, sf_dir, "domains").select("id", "name").distinct(), "BAKE")


@_query("SELECT d.id, d.name, count(DISTINCT c.id) AS crawls FROM (SELECT DISTINCT id, name FROM domains) d LEFT JOIN crawls c ON c.domain_id = d.id GROUP BY ALL")
def domain_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = table(spark, sf_dir, "domains").select("id", "name").distinct()
    children = _crawls(spark, sf_dir).select(F.col("id"), "domain_id", "status")
    return store.with_children(domains, children, key="id", foreign="domain_id", name="crawls").select("id", "name", F.size("crawls").cast("bigint").alias("crawls"))


@_query(
    "SELECT DISTINCT id, 'finished after started' AS problem FROM crawls WHERE finished_at < started_at UNION SELECT id, 'max_pages is positive' FROM crawls WHERE max_pages <= 0"
    " UNION SELECT id, 'max_depth isn''t negative' FROM crawls WHERE max_depth < 0 UNION SELECT id, 'pages_crawled isn''t negative' FROM crawls WHERE pages_crawled < 0"
    " UNION SELECT id, 'status is known' FROM crawls WHERE status NOT IN ('pending','running','completed','failed','cancelled')"
)
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.violations(table(spark, sf_dir, "crawls"), "crawls")


@_query("SELECT DISTINCT p.id FROM crawl_pages p ANTI JOIN crawls c ON p.crawl_id = c.id WHERE p.crawl_id IS NOT NULL")
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.orphans(table(spark, sf_dir, "crawl_pages").select("id", "crawl_id"), table(spark, sf_dir, "crawls"), "crawl_id").select("id").distinct()


@_query("SELECT crawl_id, max(updated_at) AS last_updated FROM crawl_pages GROUP BY crawl_id")
def crawl_last_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.last_update(table(spark, sf_dir, "crawl_pages"))


@_query("SELECT status, count(DISTINCT id) AS n FROM crawls GROUP BY status")
def crawl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counted(_crawls(spark, sf_dir), ["status"])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from siteloom.plans import derived  # noqa: E402, F401 - registers its queries here
