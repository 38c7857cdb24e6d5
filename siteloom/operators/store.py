"""Stored tables: look-ups, idempotent writes, evidence, newest and last-written rows, constraints."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom import schemas

#: Columns of stored rows that updates never touch.
PROTECTED = frozenset(("id", "created_at"))


def get(df: DataFrame, value: object, key: str = "id") -> DataFrame:
    """The row with this key; the condition reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


def listed(df: DataFrame, *, where: Column | None = None, by: str = "id", limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows in order of ``by``, a window of them."""
    return (df if where is None else df.filter(where)).orderBy(by).offset(offset).limit(limit)


def counted(df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Number of rows, in all or for each value of ``by``."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def updated(df: DataFrame, changes: DataFrame, *, key: str = "id", keep_old: bool = True) -> DataFrame:
    """``df`` with the columns of ``changes`` written by key; with ``keep_old`` a null changes nothing."""
    names = [c for c in changes.columns if c != key and c not in PROTECTED and c in df.columns]
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in names), F.lit(True).alias("_changed"))
    joined = df.join(new, key, "left")

    def value(c: str) -> Column:
        if c not in names:
            return F.col(c)
        fresh = F.coalesce(f"_new_{c}", c) if keep_old else F.col(f"_new_{c}")
        return F.when(F.coalesce("_changed", F.lit(False)), fresh).otherwise(F.col(c)).alias(c)

    return joined.select(*(value(c) for c in df.columns))


def mark_fetched(pages: DataFrame, results: DataFrame) -> DataFrame:
    """``pages`` with what was fetched: ``results`` has ``id``, ``http_status``, ``content_type``, ``fetched_at`` and ``chain``, the
    URLs from the page's own to the last. The number of redirects and the final URL come of the chain."""
    hops = F.greatest(F.size("chain") - 1, F.lit(0))
    given = results.select("id", F.lit("fetched").alias("status"), "http_status", "content_type", "fetched_at", F.element_at("chain", -1).alias("final_url"), hops.alias("redirect_count"))
    return updated(pages, given)


def mark_failed(pages: DataFrame, results: DataFrame) -> DataFrame:
    """``pages`` with what failed: ``results`` has ``id``, ``error_message``, ``fetched_at`` and ``http_status``, null where no answer came."""
    return updated(pages, results.select("id", F.lit("failed").alias("status"), "error_message", "fetched_at", "http_status"))


def mark_crawled(domains: DataFrame, crawls: DataFrame) -> DataFrame:
    """``domains`` with the time at which they were crawled last: that of ``crawls``, unless it is earlier than the stored one."""
    latest = crawls.filter("finished_at IS NOT NULL").groupBy(F.col("domain_id").alias("id")).agg(F.max("finished_at").alias("_at"))
    joined = domains.join(latest, "id", "left")
    return joined.select(*(F.greatest("last_crawled_at", "_at").alias(c) if c == "last_crawled_at" else F.col(c) for c in domains.columns))


def add_pages_crawled(crawls: DataFrame, pages: DataFrame) -> DataFrame:
    """``crawls`` with the pages that were fetched since counted in; each page of ``pages`` counts once."""
    more = pages.select("crawl_id", "id").distinct().groupBy(F.col("crawl_id").alias("id")).agg(F.count("*").alias("_more"))
    joined = crawls.join(more, "id", "left")
    total = (F.coalesce("pages_crawled", F.lit(0)) + F.coalesce("_more", F.lit(0))).cast("int")
    return joined.select(*(total.alias(c) if c == "pages_crawled" else F.col(c) for c in crawls.columns))


def deleted(df: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """``df`` without the rows named in ``gone``. For rows that refer to them, pass the referring column as key."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def get_or_create(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` and those rows of ``wanted`` whose keys it doesn't have, once each; ids are given by the caller."""
    new = wanted.dropDuplicates(keys).join(df.select(*keys), keys, "left_anti")
    return df.unionByName(new, allowMissingColumns=True)


def search(df: DataFrame, text: str | None, column: str = "name") -> DataFrame:
    """Rows whose text holds ``text`` literally, in any case; all for None."""
    return df if not text else df.filter(F.lower(column).contains(text.lower()))


def with_children(df: DataFrame, children: DataFrame, *, key: str, foreign: str, name: str, order: str = "id") -> DataFrame:
    """``df`` with an array of its children in order; empty for none. Keep the children's columns few."""
    held = children.groupBy(F.col(foreign).alias(key)).agg(F.sort_array(F.collect_list(F.struct(order, *(c for c in children.columns if c not in (order, foreign))))).alias(name))
    kind = held.schema[name].dataType
    return df.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; ties go to the larger later columns of ``order``."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))))
    return ranked.filter("_n = 1").drop("_n")


def last_written(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored rows overwritten by incoming ones of the same keys, the last of them first."""
    both = stored.withColumn("_gen", F.lit(0)).unionByName(incoming.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return newest(both, keys, ["_gen", order]).drop("_gen")


def evidence(rows: DataFrame, keys: list[str], *, order: str, confidence: str = "confidence", snippet: str = "snippet") -> DataFrame:
    """Pieces of evidence by key: how many there are, the best confidence and the first snippet."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("occurrences"),
        F.max(confidence).alias(confidence),
        F.min_by(snippet, F.when(F.col(snippet).isNotNull(), F.col(order))).alias(snippet),
    )


def add_evidence(stored: DataFrame, incoming: DataFrame, keys: list[str], *, order: str) -> DataFrame:
    """Stored evidence with incoming pieces counted in; stored snippets stay."""
    new = evidence(incoming, keys, order=order)
    both = stored.select(*keys, "occurrences", "confidence", "snippet", F.lit(0).alias("_g")).unionByName(
        new.select(*keys, "occurrences", "confidence", "snippet", F.lit(1).alias("_g"))
    )
    return both.groupBy(*keys).agg(
        F.sum("occurrences").alias("occurrences"),
        F.max("confidence").alias("confidence"),
        F.min_by("snippet", F.when(F.col("snippet").isNotNull(), F.col("_g"))).alias("snippet"),
    )


def email_rows(emails: DataFrame, email: str = "email") -> DataFrame:
    """Mailboxes in lower case with their local part, host and whether they are a role's, not a person's."""
    address = F.lower(F.trim(email))
    roles = "info contact hello office sales support admin team mail help service booking shop jobs press marketing billing webmaster".split()
    local = F.substring_index(address, "@", 1)
    return emails.withColumn(email, address).withColumn("local_part", local).withColumn("host", F.substring_index(address, "@", -1)).withColumn("is_role_based", local.isin(*roles))


def last_update(pages: DataFrame) -> DataFrame:
    """Time of the latest change to a page of each crawl."""
    return pages.groupBy("crawl_id").agg(F.max("updated_at").alias("last_updated"))


def usable_keys(keys: DataFrame, now: object) -> DataFrame:
    """Access keys that are active, not revoked and not expired at ``now``."""
    return keys.filter(F.col("active") & F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))))


#: What stored rows must fulfil, by table.
CHECKS: dict[str, dict[str, str]] = {
    "domains": {"name is set": "length(trim(name)) > 0", "name is lower case": "name = lower(name)"},
    "crawls": {
        "max_pages is positive": "max_pages > 0",
        "max_depth isn't negative": "max_depth >= 0",
        "pages_crawled isn't negative": "pages_crawled >= 0",
        "finished after started": "finished_at IS NULL OR started_at IS NULL OR finished_at >= started_at",
        "status is known": "status IN ('pending', 'running', 'completed', 'failed', 'cancelled')",
    },
    "pages": {
        "depth isn't negative": "depth >= 0",
        "http_status is one": "http_status IS NULL OR http_status BETWEEN 100 AND 599",
        "status is known": "status IN ('pending', 'fetched', 'failed', 'skipped')",
        "url_hash is the URL's": "url_hash = sha2(url, 256)",
    },
    "leads": {"seen in order": "first_seen IS NULL OR last_seen IS NULL OR first_seen <= last_seen", "website is set": "website IS NOT NULL"},
    "emails": {"address is one": "address LIKE '%_@_%'", "address is lower case": "address = lower(address)"},
    "evidence": {"confidence is a share": "confidence BETWEEN 0 AND 1", "occurrences are positive": "occurrences >= 1"},
}


def violations(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """``(key, problem)`` for every row that breaks a rule of its table; an unknown condition is no breach."""
    checks = [F.when(~F.expr(rule), F.lit(text)) for text, rule in CHECKS[table].items()]
    return df.select(key, F.explode(F.array(*checks)).alias("problem")).filter("problem IS NOT NULL").distinct()


def orphans(df: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Rows that refer to a parent which isn't there."""
    return df.filter(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def duplicates(df: DataFrame, keys: list[str], key: str = "id") -> DataFrame:
    """Keys that should be unique but belong to several ids."""
    return df.groupBy(*keys).agg(F.min(key).alias("first_id"), F.max(key).alias("last_id")).filter("first_id < last_id")


def check_version(stored: int) -> None:
    """Fail unless stored tables have this version of the schema."""
    if stored != schemas.SCHEMA_VERSION:
        raise ValueError(f"stored tables have version {stored}, this engine {schemas.SCHEMA_VERSION}")
