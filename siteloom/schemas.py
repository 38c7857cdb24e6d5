"""Schemas of rows and structs, in one place."""

from __future__ import annotations

from siteloom.functions.pages import METADATA_FIELDS

URL = "struct<url string, scheme string, host string, port int, path string, query string, segments array<string>, params array<struct<name string, value string>>>"
DECISION = "struct<allowed boolean, raw string, url string, reason string, detail string>"
LINK = DECISION[:-1] + ", key string, path string, variant string, calendar string>"
BUSINESS_IDENTITY = (
    "struct<website string, domain string, business_name string, name_source string, conflict boolean, description string, description_source string>"
)
IDENTITY = "struct<domain string, host string, website string, scheme string, port int, path string>"
SCOPE = "struct<allowed boolean, reason string, detail string>"
CANONICAL = "struct<url string, reason string, changed boolean>"
PAGING = "struct<number bigint, listing string>"

ADDRESS = "struct<street string, city string, region string, postal_code string, country string, formatted string>"
PHONE = "struct<number string, raw string>"
PROFILE = "struct<platform string, url string>"
BUSINESS = (
    f"struct<type string, name string, url string, description string, telephones array<{PHONE}>, emails array<string>, "
    f"addresses array<{ADDRESS}>, same_as array<string>, social_links array<{PROFILE}>, logo string>"
)
METRICS = (
    "struct<character_count bigint, word_count bigint, heading_count bigint, link_count bigint, unique_link_count bigint, image_count bigint, "
    "email_count bigint, phone_count bigint, html_length bigint, text_html_ratio double>"
)
PAGE = (
    "struct<title string, text string, headings array<struct<level int, text string>>, links array<string>, "
    f"metadata struct<{', '.join(f'{n} string' for n in METADATA_FIELDS)}>, emails array<string>, phones array<{PHONE}>, "
    f"social_links array<{PROFILE}>, addresses array<{ADDRESS}>, structured_data array<{BUSINESS}>, "
    "language struct<language string, source string, declared string>, encoding string, "
    f"classification struct<category string, score int, signals array<string>, ambiguous boolean>, metrics {METRICS}>"
)
LINKS = (
    "struct<base_url string, hrefs array<string>, skipped_non_http bigint, skipped_fragment_only bigint, skipped_empty bigint, truncated boolean>"
)
ROBOTS = (
    "struct<sitemaps array<string>, groups array<struct<user_agents array<string>, allow array<string>, disallow array<string>>>, "
    "invalid_sitemaps bigint, empty boolean>"
)
SITEMAP = "struct<status string, kind string, locs array<string>, empty_locs bigint, missing_locs bigint, truncated boolean, detail string>"

SITE_METADATA_FIELDS = (
    "title description keywords favicon_url canonical_url og_title og_description og_image og_url twitter_card twitter_title twitter_description twitter_image"
).split()
SITE_METADATA_URLS = frozenset("favicon_url canonical_url og_image og_url twitter_image".split())
SITE_METADATA = f"struct<{', '.join(f'{n} string' for n in SITE_METADATA_FIELDS)}>"

#: Columns of a lead, in order.
LEAD_COLUMNS = {
    "domain": "string",
    "website": "string",
    "business_name": "string",
    "description": "string",
    "emails": "array<string>",
    "phones": f"array<{PHONE}>",
    "address": ADDRESS,
    "social_profiles": f"array<{PROFILE}>",
    "page_type": "string",
    "language": "string",
    "source_url": "string",
    "first_seen": "timestamp",
    "last_seen": "timestamp",
}
LEAD = ", ".join(f"{n} {t}" for n, t in LEAD_COLUMNS.items())

#: Page types of leads, states of crawls and the changes between them, states and outcomes of pages.
PAGE_TYPES = ("homepage", "about", "contact", "services", "product", "blog", "article", "portfolio", "careers", "other")
CRAWL_CHANGES = {"pending": ("running", "failed", "cancelled"), "running": ("completed", "failed", "cancelled"), "completed": (), "failed": (), "cancelled": ()}
PAGE_STATES = ("pending", "fetched", "failed", "skipped")
OUTCOMES = (
    "ok http_error redirect_not_followed redirect_error unsupported_content_type too_large timeout connection_error invalid_url blocked error"
).split()
#: Version of the stored tables; ``store.check_version`` compares it.
SCHEMA_VERSION = 6
