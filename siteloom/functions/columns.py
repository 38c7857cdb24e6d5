"""Column functions. Exact kernels run as Arrow UDFs; whatever SQL expresses stays in the JVM."""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom import schemas
from siteloom.functions import contacts, decisions, hosts, identity, language, pages, traps, urls
from siteloom.functions.rules import DEFAULT, WEBSITE, Rejected, UrlRules

#: An absolute address that is in normal form but for a slash at its end: no escapes, dots, query, port or fragment.
PLAIN_URL = r"^https?://[a-z][a-z0-9-]{0,30}(?:\.[a-z][a-z0-9-]{0,30}){1,4}(?<!-)(?:/[A-Za-z0-9_~-]{1,60}){0,12}/?$"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _url_row(n: urls.Url) -> dict[str, object]:
    return {**n._asdict(), "segments": n.segments, "params": [{"name": k, "value": v} for k, v in n.params]}


def normalised(url: Column | str, base: Column | str | None = None, rules: UrlRules = DEFAULT, default_scheme: str | None = None) -> Column:
    """Struct of the parts of a normalised URL with ``reason`` and ``detail`` where it is rejected."""
    inner = schemas.URL[len("struct<") : -1]

    def kernel(raw: str | None, base_: str | None) -> dict[str, object] | None:
        if raw is None:
            return None
        try:
            return _url_row(urls.normalise(raw, base_, rules, default_scheme=default_scheme))
        except Rejected as error:
            return {"reason": error.reason, "detail": error.detail}

    f = F.udf(kernel, f"struct<{inner}, reason string, detail string>", useArrow=True).asNondeterministic()
    return f(_col(url), F.lit(None).cast("string") if base is None else _col(base))


def normal_url(url: Column | str, base: Column | str | None = None, rules: UrlRules = DEFAULT, default_scheme: str | None = None) -> Column:
    """The normalised URL as text; null where it is rejected. Plain addresses never leave the JVM."""
    column = _col(url)

    def kernel(raw: str | None, base_: str | None) -> str | None:
        try:
            return None if raw is None else urls.normalise(raw, base_, rules, default_scheme=default_scheme).url
        except Rejected:
            return None

    f = F.udf(kernel, "string", useArrow=True)
    plain = column.rlike(PLAIN_URL) & (F.length(column) <= rules.max_url_length)
    base_ = F.lit(None).cast("string") if base is None else _col(base)
    if rules.trailing_slash != "strip":
        return f(column, base_)
    host_only = F.regexp_extract(column, r"^(https?://[^/]+)/?$", 1)
    quick = F.when(host_only != "", F.concat(host_only, F.lit("/"))).otherwise(F.regexp_replace(column, "/$", ""))
    return F.when(plain, quick).otherwise(f(F.when(~plain, column), base_))


def dedupe_key(url: Column | str, rules: UrlRules = DEFAULT) -> Column:
    """Key that URLs of one page share; null where the URL is rejected."""

    def kernel(raw: str | None) -> str | None:
        try:
            return None if raw is None else urls.dedupe_key(raw, rules)
        except Rejected:
            return None

    return F.udf(kernel, "string", useArrow=True)(_col(url))


def url_hash(url: Column | str) -> Column:
    """SHA-256 of a URL, as hexadecimal text."""
    return F.sha2(_col(url), 256)


def decision(url: Column | str, base: Column | str | None = None, seed: Column | str | None = None, rules: UrlRules = DEFAULT, as_of: date | None = None, pages_only: bool = True) -> Column:
    """Whether a link may be crawled, with the normalised URL or the reason against it."""

    def kernel(raw: str | None, base_: str | None, seed_: str | None) -> dict[str, object] | None:
        if raw is None:
            return None
        return decisions.evaluate(raw, base_, seed=seed_, rules=rules, as_of=as_of, pages_only=pages_only)._asdict()

    null = F.lit(None).cast("string")
    f = F.udf(kernel, schemas.DECISION, useArrow=True).asNondeterministic()
    return f(_col(url), null if base is None else _col(base), null if seed is None else _col(seed))


def scope(host: Column | str, seed: Column | str, rules: UrlRules = DEFAULT) -> Column:
    def kernel(h: str | None, s: str | None) -> dict[str, object] | None:
        return None if h is None or s is None else hosts.check_scope(h, s, rules)._asdict()

    return F.udf(kernel, schemas.SCOPE, useArrow=True)(_col(host), _col(seed))


def trap(url: Column | str, rules: UrlRules = DEFAULT, as_of: date | None = None) -> Column:
    """Reason of the trap that a URL shows; null for none, or where the URL is rejected."""

    def kernel(raw: str | None) -> str | None:
        try:
            found = None if raw is None else traps.trap_of(urls.normalise(raw, rules=rules), rules, as_of)
        except Rejected:
            return None
        return found[0] if found else None

    return F.udf(kernel, "string", useArrow=True)(_col(url))


def paging(url: Column | str, rules: UrlRules = DEFAULT) -> Column:
    def kernel(raw: str | None) -> dict[str, object] | None:
        try:
            found = None if raw is None else traps.paging(urls.normalise(raw, rules=rules))
        except Rejected:
            return None
        return found._asdict() if found else None

    return F.udf(kernel, schemas.PAGING, useArrow=True)(_col(url))


def signature(url: Column | str, rules: UrlRules = DEFAULT) -> Column:
    def kernel(raw: str | None) -> str | None:
        try:
            return None if raw is None else traps.signature(urls.normalise(raw, rules=rules))
        except Rejected:
            return None

    return F.udf(kernel, "string", useArrow=True)(_col(url))


def link(url: Column | str, base: Column | str | None = None, seed: Column | str | None = None, rules: UrlRules = DEFAULT, as_of: date | None = None) -> Column:
    """All that admission asks of a link, read once: its decision, the key of its page, its path and variant, and its
    calendar (null for a link without one)."""

    def kernel(raw: str | None, base_: str | None, seed_: str | None) -> dict[str, object] | None:
        if raw is None:
            return None
        try:
            n = urls.normalise(raw, base_, rules)
        except Rejected as error:
            return decisions.Decision(False, raw, None, error.reason, error.detail)._asdict()
        found = decisions.judge(n, raw, seed=seed_, rules=rules, as_of=as_of)
        if not found.allowed:
            return found._asdict()
        traits = traps.Traits(n)
        path, variant = traits.variant
        calendar = traits.signature if traits.calendar_years is not None else None
        return {**found._asdict(), "key": urls.dedupe_key(n, rules), "path": path, "variant": variant, "calendar": calendar}

    null = F.lit(None).cast("string")
    f = F.udf(kernel, schemas.LINK, useArrow=True).asNondeterministic()
    return f(_col(url), null if base is None else _col(base), null if seed is None else _col(seed))


def canonical(page_url: Column | str, href: Column | str, rules: UrlRules = DEFAULT) -> Column:
    def kernel(page: str | None, link: str | None) -> dict[str, object] | None:
        try:
            return None if page is None else decisions.resolve_canonical(page, link, rules)._asdict()
        except Rejected as error:
            return {"url": None, "reason": f"page:{error.reason}", "changed": False}

    return F.udf(kernel, schemas.CANONICAL, useArrow=True)(_col(page_url), _col(href))


def canonical_href(html: Column | str) -> Column:
    return F.udf(lambda h: None if h is None else decisions.canonical_href(h), "string", useArrow=True)(_col(html))


def website_identity(website: Column | str, default_scheme: str | None = "https", extra: frozenset[str] = frozenset()) -> Column:
    """Domain, host and normal form of a website in any spelling; null for an unusable one."""

    def kernel(raw: str | None) -> dict[str, object] | None:
        try:
            return None if raw is None else hosts.identify(raw, default_scheme=default_scheme, extra=extra)._asdict()
        except Rejected:
            return None

    return F.udf(kernel, schemas.IDENTITY, useArrow=True).asNondeterministic()(_col(website))


def registered_domain(host: Column | str, extra: frozenset[str] = frozenset()) -> Column:
    """Registrable domain of a normalised host, in the JVM; null for a public suffix."""
    column = _col(host)
    labels = F.split(column, r"\.")
    size = F.size(labels)
    known = sorted(hosts.SUFFIXES | extra)

    def last(n: int) -> Column:
        return F.array_join(F.slice(labels, F.greatest(size - n + 1, F.lit(1)), F.lit(n)), ".")

    suffix = F.when((size >= 3) & last(3).isin(known), 3).when((size >= 2) & last(2).isin(known), 2).otherwise(1)
    whole = column.rlike(r"^[0-9.]+$|^\[|:") | (size == 1)
    return F.when(whole, column).when(size > suffix, F.array_join(F.slice(labels, size - suffix, suffix + 1), "."))


def path_extension(path: Column | str) -> Column:
    """Lower-case file ending of a path; empty for none."""
    name = F.substring_index(F.substring_index(_col(path), "/", -1), ";", 1)
    ending = F.lower(F.substring_index(name, ".", -1))
    return F.when(name.contains(".") & F.length(ending).between(1, 8), ending).otherwise("")


def extension_problem(path: Column | str, rules: UrlRules = DEFAULT) -> Column:
    """The file ending that rules a path out as a page; null for none."""
    ending = path_extension(path)
    bad = decisions.NOT_PAGES | (set() if rules.allow_pdf else {"pdf"}) | (set() if rules.allow_plain_text else {"txt"})
    return F.when(ending.isin(sorted(bad)), ending)


def media_type(header: Column | str) -> Column:
    return F.nullif(F.lower(F.trim(F.substring_index(_col(header), ";", 1))), F.lit(""))


def charset(header: Column | str) -> Column:
    """Charset parameter of a Content-Type header, lower case."""
    found = F.regexp_extract(F.lower(_col(header)), r";\s*charset\s*=\s*[\"']?([^\"';\s]+)", 1)
    return F.nullif(found, F.lit(""))


def content_type_problem(header: Column | str, rules: UrlRules = DEFAULT) -> Column:
    media = media_type(header)
    good = sorted(decisions.HTML_TYPES | ({"text/plain"} if rules.allow_plain_text else set()) | ({"application/pdf"} if rules.allow_pdf else set()))
    fine = F.coalesce(media.isin(good), F.lit(rules.allow_missing_content_type))
    return F.when(~fine, F.lit("content_type_not_eligible"))


def content_length_problem(value: Column | str, rules: UrlRules = DEFAULT) -> Column:
    length = F.trim(_col(value).cast("string")).try_cast("decimal(38,0)")
    return F.when(length > rules.max_content_length, F.lit("content_too_large"))


def ipv4_block_reason(address: Column | str) -> Column:
    """Why a dotted IPv4 address must not be contacted, by ranges in the JVM; null for public ones and other text."""
    column = _col(address)
    parts = F.split(column, r"\.")
    valid = column.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    number = sum((F.get(parts, F.lit(i)).try_cast("bigint") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0))
    out = F.when(column.isin(sorted(hosts.METADATA_ADDRESSES)), F.lit("metadata"))
    for network, reason in hosts.NETWORKS:
        if network.version == 4:
            out = out.when(number.between(int(network.network_address), int(network.broadcast_address)), F.lit(reason))
    return F.when(valid, out)


def host_block_reason(host: Column | str, rules: UrlRules = DEFAULT) -> Column:
    f = F.udf(lambda h: None if h is None else hosts.host_block_reason(h, rules), "string", useArrow=True)
    return f(_col(host))


def addresses_block_reason(addresses: Column | str, rules: UrlRules = DEFAULT) -> Column:
    """Why a host with this array of addresses must not be contacted."""
    f = F.udf(lambda a: hosts.addresses_block_reason(a or (), rules), "string", useArrow=True)
    return f(_col(addresses))


def emails_in(text: Column | str) -> Column:
    """Distinct e-mail addresses of a text, sorted, in the JVM."""
    pattern = contacts.MAILBOX
    found = F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(1))
    lower = F.transform(found, lambda x: F.lower(x))
    endings = "|".join(sorted(contacts.FILE_ENDINGS))

    def good(x: Column) -> Column:
        return ~x.contains("..") & (F.length(x) <= 254) & (F.length(F.substring_index(x, "@", 1)) <= 64) & ~x.rlike(rf"\.(?:{endings})$")

    return F.sort_array(F.array_distinct(F.filter(lower, good)))


def phones_in(text: Column | str) -> Column:
    def kernel(value: str | None) -> list[dict[str, str]] | None:
        return None if value is None else [p._asdict() for p in contacts.distinct_phones(contacts.phones_in(value))]

    return F.udf(kernel, f"array<{schemas.PHONE}>", useArrow=True)(_col(text))


def profile(href: Column | str) -> Column:
    def kernel(value: str | None) -> dict[str, str] | None:
        found = contacts.profile_of(value)
        return found._asdict() if found else None

    return F.udf(kernel, schemas.PROFILE, useArrow=True)(_col(href))


def content_language(text: Column | str) -> Column:
    f = F.udf(lambda t: None if t is None else language.content_language(t), "string", useArrow=True)
    return f(_col(text))


def language_code(tag: Column | str) -> Column:
    """Primary language of a tag, in the JVM; null for none."""
    tag_ = F.trim(_col(tag))
    code = F.lower(F.regexp_extract(tag_, r"^([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]{1,8})*$", 1))
    long = F.create_map(*[F.lit(x) for pair in language.THREE_LETTERS.items() for x in pair])
    code = F.coalesce(F.try_element_at(long, code), code)
    return F.when((code != "") & ~code.isin(sorted(language.NO_LANGUAGE)), code)


def count_words(text: Column | str) -> Column:
    """Tokens with a letter or digit, in the JVM."""
    return F.size(F.filter(F.split(_col(text), r"(?U)[\s\x1c-\x1f]+"), lambda t: t.rlike(r"[\p{L}\p{N}]"))).cast("bigint")


def _page_row(page: pages.Page | None) -> dict[str, object] | None:
    if page is None:
        return None
    row = page._asdict()
    row["headings"] = [h._asdict() for h in page.headings]
    row["metadata"] = {n: page.metadata.get(n) for n in pages.METADATA_FIELDS}
    row["phones"] = [p._asdict() for p in page.phones]
    row["social_links"] = [p._asdict() for p in page.social_links]
    row["addresses"] = [a._asdict() for a in page.addresses]
    row["structured_data"] = [
        {
            **b._asdict(),
            "telephones": [p._asdict() for p in b.telephones],
            "emails": list(b.emails),
            "addresses": [a._asdict() for a in b.addresses],
            "same_as": list(b.same_as),
            "social_links": [p._asdict() for p in b.social_links],
        }
        for b in page.structured_data
    ]
    row["language"] = page.language._asdict()
    row["classification"] = {**page.classification._asdict(), "signals": list(page.classification.signals)}
    row["metrics"] = page.metrics._asdict()
    return row


def page_identity(html: Column | str, url: Column | str) -> Column:
    """The business that a page belongs to, with the source of its name; null where the address is unusable."""

    def kernel(text: str | None, source_url: str | None) -> dict[str, object] | None:
        try:
            found = None if text is None or source_url is None else identity.identity_of_page(pages.parse(text, source_url), source_url)
        except Rejected:
            return None
        return {k: v for k, v in found._asdict().items() if k != "candidates"} if found else None

    return F.udf(kernel, schemas.BUSINESS_IDENTITY, useArrow=True).asNondeterministic()(_col(html), _col(url))


def parsed_page(html: Column | str, url: Column | str | None = None) -> Column:
    """Everything that is read from a document; parsed once, however many fields are used."""
    f = F.udf(lambda h, u: None if h is None else _page_row(pages.parse(h, u)), schemas.PAGE, useArrow=True).asNondeterministic()
    return f(_col(html), F.lit(None).cast("string") if url is None else _col(url))


def parsed_response(outcome: Column | str, body: Column | str, content_type: Column | str, charset_: Column | str, url: Column | str) -> Column:
    """The page of a response with a binary body; null where it is no page."""

    def kernel(o: str | None, b: bytes | None, t: str | None, c: str | None, u: str | None) -> dict[str, object] | None:
        return _page_row(pages.parse_response(o or "", bytes(b) if b else None, t, c, u))

    f = F.udf(kernel, schemas.PAGE, useArrow=True).asNondeterministic()
    return f(*(_col(c) for c in (outcome, body, content_type, charset_, url)))


def page_links(html: Column | str, url: Column | str) -> Column:
    def kernel(h: str | None, u: str | None) -> dict[str, object] | None:
        return None if h is None else pages.links_of(h, u or "")._asdict()

    return F.udf(kernel, schemas.LINKS, useArrow=True).asNondeterministic()(_col(html), _col(url))


def page_lead(html: Column | str, url: Column | str, website: Column | str | None = None) -> Column:
    """The lead and the site metadata that a page makes; null for an unusable address."""
    lead = ", ".join(f"{n} {t}" for n, t in schemas.LEAD_COLUMNS.items() if n not in ("first_seen", "last_seen"))

    def kernel(h: str | None, u: str | None, w: str | None) -> dict[str, object] | None:
        if h is None or u is None:
            return None
        page = pages.parse(h, u)
        try:
            row = identity.lead_of_page(page, u, w)
        except Rejected:
            return None
        row["phones"] = [p._asdict() for p in row["phones"]]
        row["social_profiles"] = [p._asdict() for p in row["social_profiles"]]
        row["address"] = row["address"]._asdict() if row["address"] else None
        return {"lead": row, "site": identity.site_metadata(page, u)}

    f = F.udf(kernel, f"struct<lead struct<{lead}>, site {schemas.SITE_METADATA}>", useArrow=True).asNondeterministic()
    return f(_col(html), _col(url), F.lit(None).cast("string") if website is None else _col(website))


def name_fold(text: Column | str, keep_joiner: bool = False) -> Column:
    """Form in which names and filter values are compared; plain ASCII text stays in the JVM."""
    column = _col(text)
    f = F.udf(lambda t: None if t is None else identity.fold(t, joiner="‌" if keep_joiner else " "), "string", useArrow=True)
    ascii_ = column.rlike(r"^[\x00-\x7f]*$")
    quick = F.trim(F.regexp_replace(F.lower(column), r"[\x09-\x0d\x1c-\x20]+", " "))
    return F.when(ascii_, quick).otherwise(f(F.when(~ascii_, column)))


def lead_key(domain: Column | str) -> Column:
    """Stable key of a lead."""
    return F.concat(F.lit("lead:v1:"), _col(domain))


def lead_digest(domain: Column | str) -> Column:
    return F.sha2(lead_key(domain), 256)


def digest_of(domain: str) -> str:
    """The same digest outside Spark."""
    return hashlib.sha256(f"lead:v1:{domain}".encode()).hexdigest()


def website_url(url: Column | str) -> Column:
    """Normal form of a website, any port; null for an unusable one."""
    return normal_url(url, rules=WEBSITE)
