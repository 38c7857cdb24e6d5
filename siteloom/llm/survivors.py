"""One surviving record for each group of duplicates (problem 1).

Fields that depend on each other form a bundle and are taken from one row together: a description and its
language, addresses of mail and numbers, a street and its postal code, a city with its region and country, and
each of the dates. Every row that has a valid value bids for a bundle with its trust; branch-and-bound chooses a row for
each bundle so that the trust in sum is the largest that the constraints between bundles allow. The constraints are
functional dependencies, found in all addresses: a postal code has one city, a city one region, a region one country;
and a business is first seen no later than last.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from siteloom.llm.names import site_of
from siteloom.llm.residue import fit, residue_score, training_sample, values_of_leads
from siteloom.session import cut_lineage, spread, table

#: Bids kept for each group and bundle at first; groups that these don't settle for certain get ``WIDER`` times as many.
BIDS, WIDER = 4, 8
#: A dependency holds for a value if this part of at least so many rows with it agree.
AGREED, SUPPORT = 0.6, 3
#: Days over which the trust in a date falls from one to nothing.
SPAN = 3650

#: Endings of file names that look like addresses, and the year in which collecting began.
FILES = "png|jpe?g|gif|svg|webp|ico|bmp|avif|css|js|mjs|json|pdf|woff2?|ttf|mp4|webm|html?|xml"
BEGAN = "2024-01-01 00:00:00"

#: What follows a text that was cut short, and characters that make it no fuller.
_CUT, _UNREAD = r"\s*(?:\.{3}|…|\[more\]|\[…\])\s*$", r"[­​-‏⁠﻿\p{M}]"


def branch_and_bound(
    bids: list[list[tuple[float, object]]], consistent: Callable[[list[object | None]], bool]
) -> tuple[float, list[object | None]] | None:
    """The choice of one bid for each bundle with the largest trust in sum; None if no choice is consistent.

    ``bids`` are sorted by trust, best first; a bundle without bids gets None. ``consistent`` takes the
    choices so far and must stay false once it is. Ties go to the earlier bids.
    """
    most = [max((t for t, _ in b), default=0.0) for b in bids]
    hope = [sum(most[k:]) for k in range(len(bids) + 1)]
    best: tuple[float, list[object | None]] | None = None

    def branch(k: int, trust: float, chosen: list[object | None]) -> None:
        nonlocal best
        if best is not None and trust + hope[k] <= best[0]:
            return
        if k == len(bids):
            best = (trust, list(chosen))
            return
        for own, payload in bids[k] or [(0.0, None)]:
            chosen.append(payload)
            if consistent(chosen):
                branch(k + 1, trust + own, chosen)
            chosen.pop()

    branch(0, 0.0, [])
    return best


def usable_addresses(emails: Column) -> Column:
    """Distinct usable addresses, trimmed and lower case; null for null. No malformed ones, hosts without a dot or file names."""
    clean = F.transform(emails, lambda x: F.lower(F.trim(x)))
    well_formed = r"^[a-z0-9_%+-]+(?:\.[a-z0-9_%+-]+)*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$"
    good = F.filter(clean, lambda x: x.rlike(well_formed) & ~x.rlike(rf"\.(?:{FILES})$"))
    return F.array_distinct(good)


def fullness(text: Column) -> Column:
    """Characters of a text without what only marks that it was cut short, or isn't seen."""
    return F.length(F.trim(F.regexp_replace(F.regexp_replace(text, _UNREAD, ""), _CUT, ""))).cast("long")


def bundles_of(leads: DataFrame) -> DataFrame:
    """The bids ``(site, bundle, trust, lead_id, at)`` of all rows for the bundles of a business.

    Invalid values make no bid: blank texts and residue, no usable address, dates before collecting began
    or after the row was stored. ``at`` is the date of a date bundle.
    """
    model = leads.sparkSession.sparkContext.broadcast(fit(training_sample(values_of_leads(leads))))
    real = ~residue_score(model, title=False)(F.col("description")) & (F.length(F.trim("description")) > 0)
    addresses = F.size(usable_addresses(F.col("emails"))).cast("long")
    began, micros = F.lit(BEGAN).cast("timestamp"), F.unix_micros

    def bid(bundle: str, valid: Column, trust: Column, at: Column | None = None) -> Column:
        at = at if at is not None else F.lit(None).cast("timestamp")
        return F.when(valid, F.struct(F.lit(bundle).alias("bundle"), trust.alias("trust"), at.alias("at")))

    bids = F.array(
        bid("description", real & (fullness(F.col("description")) > 0), fullness(F.col("description"))),
        bid("emails", addresses > 0, addresses),
        bid("first_seen", F.col("first_seen") >= began, -micros("first_seen"), F.col("first_seen")),
        bid("last_seen", F.col("last_seen") <= F.col("created_at"), micros("last_seen"), F.col("last_seen")),
    )
    rows = leads.select(site_of(F.col("website")).alias("site"), "lead_id", F.explode(F.filter(bids, lambda b: b.isNotNull())).alias("b"))
    return rows.filter("site IS NOT NULL").select("site", "lead_id", "b.*")


BUNDLES = ("description", "emails", "first_seen", "last_seen", "place", "street")


def _plain(column: str) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_replace(column, r"[^\p{L}\p{Nd}]+", " "))), F.lit(""))


def dependency(rows: DataFrame, given: str, told: str) -> DataFrame:
    """``(given, told)``: the value that nearly all rows with a value of ``given`` have in ``told``."""
    counted = rows.filter(F.col(given).isNotNull() & F.col(told).isNotNull()).groupBy(given, told).agg(F.count("*").alias("n"))
    best = counted.groupBy(given).agg(F.sum("n").alias("all"), F.max("n").alias("n"), F.max_by(told, F.struct("n", told)).alias(told))
    return best.filter((F.col("n") >= SUPPORT) & (F.col("n") >= AGREED * F.col("all"))).select(given, told)


def address_bids(addresses: DataFrame, leads: DataFrame) -> DataFrame:
    """The bids of addresses for the bundles ``place`` and ``street`` of their lead's site.

    ``link`` is the city that a place has, and that a street's postal code implies; null where nothing is implied. A
    place that contradicts a dependency makes no bid. The trust is the number of parts given.
    """
    parts = ("postal_code", "city", "region", "country")
    plain = addresses.select("address_id", "lead_id", F.trim("street").alias("street"), *(_plain(c).alias(c) for c in parts)).dropDuplicates(["address_id"])
    held = plain
    for given, told in (("postal_code", "city"), ("city", "region"), ("region", "country")):
        held = held.join(dependency(plain, given, told).withColumnRenamed(told, f"_{told}"), given, "left")
    agrees = F.lit(True)
    for told in ("region", "country"):
        agrees = agrees & (F.col(told).isNull() | F.col(f"_{told}").isNull() | (F.col(told) == F.col(f"_{told}")))
    none = F.lit(None).cast("timestamp")
    place = F.struct(F.lit("place").alias("bundle"), sum((F.col(c).isNotNull().cast("long") for c in parts[1:]), F.lit(0)).cast("long").alias("trust"), none.alias("at"), F.col("city").alias("link"))
    street = F.struct(F.lit("street").alias("bundle"), (1 + F.col("postal_code").isNotNull().cast("long")).cast("long").alias("trust"), none.alias("at"), F.col("_city").alias("link"))
    bids = F.array(F.when(F.col("city").isNotNull() & agrees, place), F.when(F.length("street") > 0, street))
    sites = leads.select("lead_id", site_of(F.col("website")).alias("site")).filter("site IS NOT NULL").distinct()
    rows = held.join(sites, "lead_id").select("site", F.col("address_id").alias("lead_id"), F.explode(F.filter(bids, lambda b: b.isNotNull())).alias("b"))
    return rows.select("site", "lead_id", "b.*")


def choose(bids: DataFrame, groups: DataFrame) -> DataFrame:
    """``(site, bundle, lead_id)`` chosen by branch-and-bound for every site of ``groups``.

    Bids are ranked before any is brought together, so a site with a third of all rows sends no more to one
    task than any other. If bids that were left out might make a better choice, more of the site's bids count.
    """
    bids = cut_lineage(bids)
    # Of bids for one bundle that imply the same only the most trusted can be chosen.
    same = F.row_number().over(Window.partitionBy("site", "bundle", F.coalesce("link", F.lit(""))).orderBy(F.col("trust").desc(), "lead_id"))
    linked = bids.filter("bundle IN ('place', 'street')").withColumn("_n", same).filter("_n = 1").drop("_n")
    bids = bids.filter("bundle NOT IN ('place', 'street')").unionByName(linked)
    found, open_, kept = None, groups.select("site"), BIDS
    while True:
        solve = _solver(kept)
        rank = F.row_number().over(_by_trust())
        # The rank filter is applied within each partition before the shuffle, too.
        top = bids.withColumn("rank", rank).filter(F.col("rank") <= kept)
        held = top.groupBy("site").agg(F.collect_list(F.struct("bundle", "rank", "trust", "lead_id", "at", "link")).alias("bids"))
        chosen = cut_lineage(held.join(open_, "site", "left_semi").select("site", solve("bids").alias("c")))
        solved = chosen.filter("c IS NOT NULL").select("site", F.explode("c").alias("c")).select("site", "c.*")
        found = solved if found is None else found.unionByName(solved)
        unsolved = chosen.filter("c IS NULL")
        if not unsolved.limit(1).count():
            return found
        open_, kept = unsolved.select("site"), kept * WIDER


def _by_trust() -> WindowSpec:
    return Window.partitionBy("site", "bundle").orderBy(F.col("trust").desc(), "lead_id")


def _solver(kept: int) -> Callable[[str], Column]:
    @F.pandas_udf("array<struct<bundle string, lead_id long>>")
    def solve(groups: pd.Series) -> pd.Series:
        return pd.Series([_solve(held, kept) for held in groups], index=groups.index)

    return solve


def _trusts(bids: list[dict]) -> list[float]:
    """Trust of each bid as a part of the best one's; of dates, by their distance from it."""
    if bids and bids[0]["at"] is not None:
        return [max(0.0, 1 - abs((b["at"] - bids[0]["at"]).total_seconds()) / (SPAN * 86400)) for b in bids]
    return [b["trust"] / bids[0]["trust"] for b in bids]


def _solve(held: list[dict], kept: int) -> list[dict] | None:
    """The best consistent choice; None if a bid that was left out might be part of a better one."""
    sorted_ = {name: sorted((b for b in held if b["bundle"] == name), key=lambda b: b["rank"]) for name in BUNDLES}
    trusts = {name: _trusts(bids) for name, bids in sorted_.items()}
    first, last = (sorted_[name][:1] for name in ("first_seen", "last_seen"))
    # The earliest and the latest date are the most trusted; where these contradict each other all others do, so each
    # stands for itself.
    dated = not (first and last and first[0]["at"] > last[0]["at"])

    def consistent(chosen: list[dict | None]) -> bool:
        of = dict(zip(BUNDLES, chosen))
        early, late, place, street = (of.get(name) for name in BUNDLES[2:])
        if dated and early and late and early["at"] > late["at"]:
            return False
        # The city that the street's postal code determines is the place's.
        return not (place and street and street["link"] is not None and street["link"] != place["link"])

    bids = [list(zip(trusts[name], sorted_[name])) for name in BUNDLES]
    # A street or place may be left out, if the one contradicts the other.
    options = [[*b, (0.0, None)] if name in ("place", "street") and b else b for name, b in zip(BUNDLES, bids)]
    trust, chosen = branch_and_bound(options, consistent)
    best = sum(b[0][0] for b in bids if b)
    for b in bids:
        # No choice with a bid beyond the kept ones is trusted more than this.
        if len(b) >= kept and trust < best - b[0][0] + b[-1][0] - 1e-12:
            return None
    return [{"bundle": name, "lead_id": c["lead_id"]} for name, c in zip(BUNDLES, chosen) if c is not None]


def repeated_sites(leads: DataFrame) -> DataFrame:
    """Sites with two or more different leads."""
    sites = leads.select(site_of(F.col("website")).alias("site"), "lead_id").filter("site IS NOT NULL")
    return sites.groupBy("site").agg(F.min("lead_id").alias("a"), F.max("lead_id").alias("b")).filter("a < b").select("site")


def survivors(leads: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """``(site, bundle, lead_id)``: the row whose values survive, for every site with several leads.

    For ``place`` and ``street`` it is the id of the address. A bundle without any valid value has no row, nor has the
    less trusted of a street and a place that contradict each other and all others. Rows without a website belong to no
    site. Repeated rows count once; ties go to the smallest id. Extra columns are ignored.
    """
    bids = bundles_of(leads).withColumn("link", F.lit(None).cast("string"))
    if addresses is not None:
        bids = bids.unionByName(address_bids(addresses, leads))
    return choose(bids, repeated_sites(leads))


def surviving_records(leads: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """One record for each site with several leads: each bundle's fields from its row."""
    chosen = cut_lineage(survivors(leads, addresses))
    phones = F.col("phones") if "phones" in leads.columns else F.lit(None).cast("string")
    values = leads.dropDuplicates(["lead_id"]).select("lead_id", "description", "language", "emails", phones.alias("phones"), "first_seen", "last_seen")
    own = chosen.filter("bundle NOT IN ('place', 'street')").join(values, "lead_id")

    def of(bundle: str, value: Column) -> Column:
        return F.first(F.when(F.col("bundle") == bundle, value), ignorenulls=True)

    records = own.groupBy("site").agg(
        of("description", F.col("description")).alias("description"),
        of("description", F.col("language")).alias("language"),
        of("emails", F.array_sort(usable_addresses(F.col("emails")))).alias("emails"),
        of("emails", F.col("phones")).alias("phones"),
        of("first_seen", F.col("first_seen")).alias("first_seen"),
        of("last_seen", F.col("last_seen")).alias("last_seen"),
    )
    if addresses is None:
        return records
    parts = {"street": ("street", "postal_code"), "place": ("city", "region", "country")}
    rows = addresses.dropDuplicates(["address_id"]).select(F.col("address_id").alias("lead_id"), *(c for names in parts.values() for c in names))
    located = chosen.filter("bundle IN ('place', 'street')").join(rows, "lead_id")
    located = located.groupBy("site").agg(*(of(bundle, F.col(c)).alias(c) for bundle, names in parts.items() for c in names))
    return records.join(located, "site", "left")


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("lead_id", "website", "description", "language", "emails", "phones", "first_seen", "last_seen", "created_at")
    return spread(table(spark, sf_dir, "page_leads").select(*columns))


#: The bundles by whose first field the rows of ``p1_found`` are named.
FIELDS = ("description", "emails", "first_seen", "last_seen")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose values survive."""
    found = survivors(_leads(spark, sf_dir), table(spark, sf_dir, "addresses")).filter(F.col("bundle").isin(*FIELDS))
    return found.select("site", F.col("bundle").alias("field_name"), "lead_id")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving records."""
    return surviving_records(_leads(spark, sf_dir), table(spark, sf_dir, "addresses"))


QUERIES = {"p1_found": p1_found, "p1_records": p1_records}
SQL: dict[str, str] = {}
