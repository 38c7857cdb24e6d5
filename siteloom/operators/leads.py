"""Leads: building, validating, aggregating without regard to order, folding in order of arrival, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom import schemas
from siteloom.functions import columns as C

#: Profiles that a lead keeps at most.
MOST_PROFILES = 200
ADDRESS_PARTS = ("street", "city", "region", "postal_code", "country", "formatted")
#: Fields whose differing values are reported.
CONFLICT_FIELDS = ("business_name", "description", "address")


def complete(leads: DataFrame) -> DataFrame:
    """``leads`` with every column of a lead, missing ones null (collections empty), in order; others follow."""
    held = set(leads.columns)
    empty = {"emails", "phones", "social_profiles"}
    columns = []
    for name, kind in schemas.LEAD_COLUMNS.items():
        value = F.col(name).cast(kind) if name in held else F.lit(None).cast(kind)
        columns.append((F.coalesce(value, F.array().cast(kind)) if name in empty else value).alias(name))
    return leads.select(*columns, *(c for c in leads.columns if c not in schemas.LEAD_COLUMNS))


def _clean(text: Column, collapse: bool = False) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ") if collapse else text), F.lit(""))


def from_sightings(rows: DataFrame, *, extra_suffixes: frozenset[str] = frozenset()) -> DataFrame:
    """Leads in normal form from rows as they were stored: websites in any spelling, blank texts, odd contacts.

    Rows whose website can't be used are left out. E-mails are trimmed, lower case, distinct and sorted,
    malformed ones dropped; of one phone number the first is kept; an unknown page type is null.
    """
    rows = complete(rows)
    who = C.website_identity("website", extra=extra_suffixes)
    named = rows.withColumn("_who", who).filter("_who IS NOT NULL")
    stored = F.filter("emails", lambda e: e.isNotNull())
    emails = F.flatten(F.transform(stored, lambda e: C.emails_in(F.trim(e))))
    exact = F.filter(emails, lambda e: F.exists(stored, lambda raw: F.lower(F.trim(raw)) == e))
    page_type = F.lower(F.trim("page_type"))
    return named.select(
        F.col("_who.domain").alias("domain"),
        F.col("_who.website").alias("website"),
        _clean(F.col("business_name"), True).alias("business_name"),
        _clean(F.col("description")).alias("description"),
        F.sort_array(F.array_distinct(F.coalesce(exact, F.array().cast("array<string>")))).alias("emails"),
        distinct_phones(F.col("phones")).alias("phones"),
        F.when(F.exists(F.array(*(F.col(f"address.{p}") for p in ADDRESS_PARTS)), lambda x: F.length(F.trim(x)) > 0), F.col("address")).alias("address"),
        "social_profiles",
        F.when(page_type.isin(*schemas.PAGE_TYPES), page_type).alias("page_type"),
        F.nullif(F.lower(F.trim("language")), F.lit("")).alias("language"),
        F.nullif(F.trim("source_url"), F.lit("")).alias("source_url"),
        "first_seen",
        "last_seen",
        *(c for c in rows.columns if c not in schemas.LEAD_COLUMNS),
    )


def distinct_phones(phones: Column) -> Column:
    """One entry for each number, as first listed, in order of the numbers; no shuffle, no Python."""
    numbers = F.sort_array(F.array_distinct(F.transform(phones, lambda p: p["number"])))
    known = F.filter(numbers, lambda n: n.isNotNull())
    return F.transform(known, lambda n: F.get(F.filter(phones, lambda p: p["number"] == n), F.lit(0)))


def problems(leads: DataFrame) -> DataFrame:
    """``leads`` with an array of what is wrong with each; empty for valid ones."""
    checks = {
        "website is required": F.col("website").isNull() | (F.trim("website") == ""),
        "domain does not match website": F.col("domain").isNotNull() & (F.col("domain") != C.website_identity("website")["domain"]),
        "invalid email address": F.exists("emails", lambda e: F.size(C.emails_in(e)) != 1),
        "invalid phone number": F.exists("phones", lambda p: ~p["number"].rlike(r"^\+?[0-9]{5,15}$")),
        "social profile needs a platform and a url": F.exists("social_profiles", lambda s: (F.trim(s["platform"]) == "") | (F.trim(s["url"]) == "")),
        "unknown page type": F.col("page_type").isNotNull() & ~F.col("page_type").isin(*schemas.PAGE_TYPES),
        "last_seen is earlier than first_seen": F.col("last_seen") < F.col("first_seen"),
    }
    found = F.array(*(F.when(bad, F.lit(text)) for text, bad in checks.items()))
    return leads.withColumn("problems", F.filter(found, lambda x: x.isNotNull()))


def valid(leads: DataFrame, *, strict: bool = False) -> DataFrame:
    """Leads without problems; with ``strict`` a lead that has one fails the query."""
    judged = problems(leads)
    if strict:
        error = F.raise_error(F.concat(F.lit("lead "), F.coalesce("website", F.lit("?")), F.lit(": "), F.array_join("problems", ", ")))
        judged = judged.withColumn("website", F.when(F.size("problems") == 0, F.col("website")).otherwise(error))
        return judged.drop("problems")
    return judged.filter(F.size("problems") == 0).drop("problems")


def _order() -> Column:
    """Order of the pages of a site: its homepage first, then by address; the row's text settles the rest."""
    text = F.to_json(F.struct(*(F.col(c) for c in schemas.LEAD_COLUMNS)))
    return F.struct((~F.col("page_type").eqNullSafe("homepage")).alias("inner"), F.coalesce("source_url", F.lit("")).alias("at"), text.alias("text"))


def aggregate(leads: DataFrame) -> DataFrame:
    """One lead for each domain, whatever the order of the rows.

    Texts and address come from the first page that has them; contacts are united, of a phone number the
    smallest spelling and of a profile the smallest URL kept; the language is the most frequent known one.
    Contacts are made distinct before the shuffle, so a domain with most rows sends each only once.
    """
    rows = complete(leads).filter("domain IS NOT NULL").withColumn("_ord", _order())

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("_ord"))).alias(name)

    main = rows.groupBy("domain").agg(
        F.min_by(F.struct("website", "page_type", "source_url"), "_ord").alias("_primary"),
        *(first(c) for c in CONFLICT_FIELDS),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max(F.col("language") == "unknown").alias("_unknown"),
    )
    emails = rows.select("domain", F.explode("emails").alias("v")).groupBy("domain").agg(F.sort_array(F.collect_set("v")).alias("emails"))
    numbers = rows.select("domain", F.explode("phones").alias("p")).groupBy("domain", F.col("p.number").alias("number")).agg(F.min("p.raw").alias("raw"))
    phones = numbers.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("number", "raw"))).alias("phones"))
    links = rows.select("domain", F.explode("social_profiles").alias("s")).groupBy("domain", F.lower("s.url").alias("key"))
    kept = links.agg(F.min(F.struct("s.platform", "s.url")).alias("s")).groupBy("domain")
    ordered = F.slice(F.sort_array(F.collect_list(F.struct(F.col("s.platform").alias("platform"), "key", F.col("s.url").alias("url")))), 1, MOST_PROFILES)
    profiles = kept.agg(F.transform(ordered, lambda s: F.struct(s["platform"], s["url"])).cast(f"array<{schemas.PROFILE}>").alias("social_profiles"))
    known = rows.filter("language IS NOT NULL AND language NOT IN ('unknown', '')").groupBy("domain", "language")
    counted = known.agg(F.count("*").alias("n"), F.min("_ord").alias("_ord"))
    languages = counted.groupBy("domain").agg(F.max_by("language", F.struct("n")).alias("_any"), F.max("n").alias("n")).select("domain", "n")
    language = counted.join(languages, ["domain", "n"]).groupBy("domain").agg(F.min_by("language", "_ord").alias("_known"))
    joined = main
    for part in (emails, phones, profiles, language):
        joined = joined.join(part, "domain", "left")
    return complete(
        joined.select(
            "*", "_primary.*", F.coalesce("_known", F.when(F.col("_unknown"), F.lit("unknown"))).alias("language")
        ).drop("_primary", "_known", "_unknown")
    )


def aggregate_site(leads: DataFrame, domain: str) -> DataFrame:
    """The one lead of a site; a lead of another domain fails the query."""
    own = F.when(F.col("domain") == domain, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a lead of another domain: "), F.coalesce("domain", F.lit("none")))).cast("boolean"))
    return aggregate(leads.filter(own))


def checked_identities(leads: DataFrame, *, key: str = "key", digest: str = "digest", strict: bool = True) -> DataFrame:
    """Stored leads whose ``key`` and ``digest`` are those of their domain; others fail the query, or are left out unless ``strict``."""
    good = F.coalesce((F.col(key) == C.lead_key("domain")) & (F.col(digest) == C.lead_digest("domain")), F.lit(False))
    if not strict:
        return leads.filter(good)
    return leads.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("identity of another lead: "), F.coalesce(key, F.lit("none")))).cast("boolean")))


def fold(leads: DataFrame, *, sequence: str = "seq") -> DataFrame:
    """One lead for each domain, merged in order of ``sequence``: what is stored stays, open fields are filled.

    Every rule of the fold is a first value, a union or an extreme, so it is one aggregation by domain.
    """
    rows = complete(leads).filter("domain IS NOT NULL")
    order = F.col(sequence)

    def first(value: Column | str, when: Column | None = None) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.min_by(value, F.when(when if when is not None else value.isNotNull(), order))

    known = F.col("language").isNotNull() & ~F.col("language").isin("unknown", "")
    page = F.struct("page_type", "source_url")
    main = rows.groupBy("domain").agg(
        F.min_by("website", order).alias("website"),
        first("business_name").alias("business_name"),
        first("description").alias("description"),
        first("address").alias("address"),
        first(page, F.col("page_type").isNotNull() | F.col("source_url").isNotNull()).alias("_page"),
        F.coalesce(first("language", known), F.when(F.max(F.col("language") == "unknown"), F.lit("unknown"))).alias("language"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    emails = rows.select("domain", F.explode("emails").alias("v")).groupBy("domain").agg(F.sort_array(F.collect_set("v")).alias("emails"))
    numbers = rows.select("domain", order.alias("_s"), F.posexplode("phones").alias("_i", "p")).groupBy("domain", F.col("p.number").alias("number"))
    phones = numbers.agg(F.min_by("p.raw", F.struct("_s", "_i")).alias("raw")).groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("number", "raw"))).alias("phones"))
    links = rows.select("domain", order.alias("_s"), F.posexplode("social_profiles").alias("_i", "s")).groupBy("domain", F.lower("s.url").alias("_key"))
    kept = links.agg(F.min_by("s", F.struct("_s", "_i")).alias("s")).groupBy("domain")
    profiles = kept.agg(F.sort_array(F.collect_list(F.struct("s.platform", "s.url"))).cast(f"array<{schemas.PROFILE}>").alias("social_profiles"))
    joined = main
    for part in (emails, phones, profiles):
        joined = joined.join(part, "domain", "left")
    return complete(joined.select("*", "_page.*").drop("_page"))


def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored leads with what incoming ones of the same domain add, and new ones; ``changed`` tells which differ.

    One row for each domain on either side. Merging the same rows again changes nothing.
    """
    old, new = complete(stored).select(*schemas.LEAD_COLUMNS), complete(incoming).select(*schemas.LEAD_COLUMNS)
    both = old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))
    merged = fold(both)
    before = old.select("domain", F.to_json(F.struct(*schemas.LEAD_COLUMNS)).alias("_before"))
    after = merged.join(before, "domain", "left")
    now = F.to_json(F.struct(*schemas.LEAD_COLUMNS))
    return after.withColumn("changed", ~F.col("_before").eqNullSafe(now)).drop("_before")


def conflicts(leads: DataFrame, order: Column | None = None) -> DataFrame:
    """``(domain, field, kept, rejected, kept_source, rejected_source)``: every differing value once.

    The first value of a field is kept; the first page that offers another names its source. Values are
    grouped before they are compared, so no task holds the pages of a domain.
    """
    rows = complete(leads).filter("domain IS NOT NULL").withColumn("_ord", _order() if order is None else order)
    values = F.array(*(F.struct(F.lit(f).alias("field"), (F.to_json(f) if f == "address" else F.col(f)).alias("value")) for f in CONFLICT_FIELDS))
    each = rows.select("domain", "_ord", "source_url", F.explode(values).alias("v")).select("domain", "_ord", "source_url", "v.*").filter("value IS NOT NULL")
    distinct = each.groupBy("domain", "field", "value").agg(F.min("_ord").alias("_ord"), F.min_by("source_url", "_ord").alias("source"))
    first = distinct.groupBy("domain", "field").agg(F.min_by(F.struct("value", "source"), "_ord").alias("k"))
    joined = distinct.join(first, ["domain", "field"]).filter("value <> k.value")
    return joined.select("domain", "field", F.col("k.value").alias("kept"), F.col("value").alias("rejected"), F.col("k.source").alias("kept_source"), F.col("source").alias("rejected_source"))


def value_sources(leads: DataFrame) -> DataFrame:
    """``(domain, value, sources)``: the pages, in order, on which each contact of a domain was found."""
    rows = complete(leads).filter("domain IS NOT NULL AND source_url IS NOT NULL")
    keys = F.concat(
        F.transform("emails", lambda e: F.concat(F.lit("emails:"), e)),
        F.transform("phones", lambda p: F.concat(F.lit("phones:"), p["number"])),
        F.transform("social_profiles", lambda s: F.concat(F.lit("social_profiles:"), F.lower(s["url"]))),
    )
    each = rows.select("domain", "source_url", F.explode(keys).alias("value"))
    return each.groupBy("domain", "value").agg(F.sort_array(F.collect_set("source_url")).alias("sources"))


def field_sources(leads: DataFrame) -> DataFrame:
    """``(domain, field, source)``: the page that each kept text or address comes from."""
    rows = complete(leads).filter("domain IS NOT NULL").withColumn("_ord", _order())
    each = rows.select("domain", "_ord", "source_url", F.explode(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in CONFLICT_FIELDS))).alias("field"))
    return each.filter("field IS NOT NULL").groupBy("domain", "field").agg(F.min_by("source_url", "_ord").alias("source"))


def combine(leads: DataFrame) -> DataFrame:
    """Aggregated leads with their conflicts, the sources of their fields and of each contact."""
    told = conflicts(leads).groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("field", "kept", "rejected", "kept_source", "rejected_source"))).alias("conflicts"))
    of_fields = field_sources(leads).groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("field", "source"))).alias("field_sources"))
    of_values = value_sources(leads).groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("value", "sources"))).alias("value_sources"))
    joined = aggregate(leads)
    for part in (told, of_fields, of_values):
        joined = joined.join(part, "domain", "left")
    return joined


def from_pages(pages: DataFrame, *, html: str = "html", url: str = "url", seen_at: str | None = None) -> DataFrame:
    """The lead of every page, with its site metadata in ``website_metadata``; pages without a usable address have none."""
    held = pages.withColumn("_p", C.page_lead(html, url)).filter("_p IS NOT NULL")
    seen = F.col(seen_at) if seen_at else F.lit(None).cast("timestamp")
    keep = [c for c in pages.columns if c not in (html, url, seen_at)]
    return complete(held.select(*keep, "_p.lead.*", F.col("_p.site").alias("website_metadata"), seen.alias("first_seen"), seen.alias("last_seen")))


def fill_metadata(rows: DataFrame, *, key: str = "domain", sequence: str = "seq", fields: list[str] | None = None) -> DataFrame:
    """Site metadata of each key: every field has the first value that was stored, later rows only fill."""
    fields = fields or [f for f in schemas.SITE_METADATA_FIELDS if f in rows.columns]
    order = F.col(sequence)
    return rows.groupBy(key).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields))


def first_sightings(leads: DataFrame, *, by: str = "domain", sequence: str = "seq") -> DataFrame:
    """The first row of each key in order of arrival."""
    ranked = leads.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(sequence)))
    return ranked.filter("_n = 1").drop("_n")
