"""People found on pages: stored once, found by name, linked to mailboxes of their own domain, with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def created(people: DataFrame) -> DataFrame:
    """``people`` as they are stored: names trimmed, a confidence of 0 where none is given. Blank names are no person."""
    known = people.columns
    empty = {c: F.lit(None).cast("string").alias(c) for c in ("first_name", "last_name", "job_title") if c not in known}
    confidence = F.coalesce(F.col("confidence") if "confidence" in known else F.lit(None).cast("double"), F.lit(0.0))
    mailbox = F.col("email_id") if "email_id" in known else F.lit(None).cast("bigint")
    rows = people.withColumns({c: v for c, v in empty.items()}).withColumn("full_name", F.trim("full_name"))
    return rows.withColumn("confidence", confidence).withColumn("email_id", mailbox).filter("full_name <> ''")


def find_by_name(people: DataFrame, wanted: DataFrame) -> DataFrame:
    """People of ``wanted`` (``domain_id``, ``full_name``) in any case, however many have the name; in no order."""
    keys = wanted.select("domain_id", F.lower(F.trim("full_name")).alias("_name")).distinct()
    return people.withColumn("_name", F.lower("full_name")).join(keys, ["domain_id", "_name"]).drop("_name")


def with_mailbox(people: DataFrame, emails: DataFrame) -> DataFrame:
    """People with the ``address`` of their mailbox; null without one."""
    return people.join(emails.select(F.col("id").alias("email_id"), "address"), "email_id", "left")


def link_emails(people: DataFrame, links: DataFrame, emails: DataFrame, *, strict: bool = True) -> DataFrame:
    """``people`` with mailboxes attached: ``links`` has ``person_id`` and ``email_id``, null to detach.

    A mailbox must be known and of the person's domain: others fail the query, or with ``strict=False`` change nothing.
    """
    new = links.select(F.col("person_id").alias("id"), F.col("email_id").alias("_to"), F.lit(True).alias("_linked")).dropDuplicates(["id"])
    held = emails.select(F.col("id").alias("_to"), F.col("domain_id").alias("_domain"))
    joined = people.join(new, "id", "left").join(held, "_to", "left")
    fits = F.col("_to").isNull() | (F.col("_domain") == F.col("domain_id"))
    wrong = F.when(F.col("_domain").isNull(), F.lit("unknown mailbox of person ")).otherwise(F.lit("mailbox of another domain than person "))
    kept = F.col("email_id")
    refused = F.raise_error(F.concat(wrong, F.col("id").cast("string"))).cast("bigint") if strict else kept
    value = F.when(~F.coalesce("_linked", F.lit(False)), kept).when(F.coalesce(fits, F.lit(False)), F.col("_to")).otherwise(refused)
    return joined.select(*(value.alias(c) if c == "email_id" else F.col(c) for c in people.columns))


def upsert_evidence(stored: DataFrame, fresh: DataFrame, *, order: str = "seq") -> DataFrame:
    """Evidence once for each person, page and kind of source: the highest confidence, the first snippet there was.

    ``stored`` and ``fresh`` have ``person_id``, ``page_id``, ``source_type``, ``snippet`` and ``confidence``; ``fresh`` has
    its order besides, in which a snippet fills an open one.
    """
    both = stored.withColumn("_n", F.lit(None).cast("bigint")).unionByName(fresh.withColumn("_n", F.col(order).cast("bigint")).drop(order))
    snippet = F.min_by("snippet", F.when(F.col("snippet").isNotNull(), F.coalesce("_n", F.lit(-(2**62)))))
    return both.groupBy("person_id", "page_id", "source_type").agg(snippet.alias("snippet"), F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))
