"""Admitting links to a crawl in their order: duplicates, variants, calendars, pages beyond an empty one."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import columns as C
from siteloom.functions import decisions, traps, urls
from siteloom.functions.rules import DEFAULT, Rejected, UrlRules
from siteloom.session import cut_lineage


class Capped:
    """Sets of members by group that may have so many members, and the reason to refuse another."""

    def __init__(self, reason: str, most: int) -> None:
        self.reason, self.most = reason, most
        self.members: dict[str, set[str]] = defaultdict(set)

    def refuses(self, group: str, member: str) -> bool:
        held = self.members.get(group, ())
        return member not in held and len(held) >= self.most

    def add(self, group: str, member: str) -> None:
        self.members[group].add(member)


class Gate:
    """State of one crawl: what was admitted. Only admitted links count towards the limits."""

    def __init__(self, rules: UrlRules = DEFAULT, seed: str | None = None, as_of: date | None = None) -> None:
        self.rules, self.seed, self.as_of = rules, seed, as_of
        self.seen: set[str] = set()
        self.variants = Capped("trap_query_variants", rules.max_query_variants_per_path)
        self.calendars = Capped("trap_calendar", rules.max_calendar_urls_per_pattern)
        self.empty: dict[str, int] = {}
        self.rejections: Counter[str] = Counter()
        self.admitted = 0

    def claims(self, traits: traps.Traits) -> list[tuple[Capped, str, str]]:
        """The members that a link would add to capped sets."""
        path, variant = traits.variant
        found = [(self.variants, path, variant)] if variant else []
        return found + ([(self.calendars, traits.signature, traits.url.url)] if traits.calendar_years is not None else [])

    def trap(self, traits: traps.Traits) -> tuple[str, str] | None:
        """The limit that a link would exceed, without counting it."""
        page = traits.paging
        empty = self.empty.get(page.listing, page.number + 1) if page else None
        if page and page.number >= empty:
            return "trap_pagination", f"listing is empty from page {empty} on"
        full = next(((capped, group) for capped, group, member in self.claims(traits) if capped.refuses(group, member)), None)
        return (full[0].reason, f"at most {full[0].most} of {full[1]}") if full else None

    def admit(self, raw: str, base: str | None = None) -> decisions.Decision:
        """Decide on a link, and remember it if it is admitted."""
        found = self._decide(raw, base)
        if found.allowed:
            self.admitted += 1
        else:
            self.rejections[found.reason] += 1
        return found

    def _decide(self, raw: str, base: str | None) -> decisions.Decision:
        try:
            n = urls.normalise(raw, base, self.rules)
        except Rejected as error:
            return decisions.Decision(False, raw, None, error.reason, error.detail)
        found = decisions.judge(n, raw, seed=self.seed, rules=self.rules, as_of=self.as_of)
        if not found.allowed:
            return found
        key, traits = urls.dedupe_key(n, self.rules), traps.Traits(n)
        trap = ("duplicate", "") if key in self.seen else self.trap(traits)
        if trap:
            return decisions.Decision(False, raw, n.url, *trap)
        self.seen.add(key)
        for capped, group, member in self.claims(traits):
            capped.add(group, member)
        return found

    def record_canonical(self, page_url: str, href: str | None) -> bool:
        """Whether a page declares another known page as its canonical one, so that its own content is a copy."""
        target = decisions.resolve_canonical(page_url, href, self.rules).url
        if target is None:
            return False
        own, other = urls.dedupe_key(page_url, self.rules), urls.dedupe_key(target, self.rules)
        copy = own != other and other in self.seen
        self.seen.add(other)
        return copy

    def record_empty_page(self, url: str) -> None:
        """Pages from this one of its listing on are traps."""
        page = traps.Traits(urls.normalise(url, rules=self.rules)).paging
        if page:
            self.empty[page.listing] = min(page.number, self.empty.get(page.listing, page.number))


ADMITTED = "crawl_id long, seq long, allowed boolean, raw string, url string, reason string, detail string"


def admit_in_order(
    links: DataFrame, *, rules: UrlRules = DEFAULT, as_of: date | None = None, crawl_id: str = "crawl_id", seq: str = "seq", url: str = "url", base: str | None = None, seed: str | None = None
) -> DataFrame:
    """Every link's decision, with the limits applied in order of ``seq`` within each crawl.

    Rows of a crawl are sorted by Spark and streamed through one gate, batch by batch, so what a task holds
    is the state of the crawl (bounded by its admitted links), not its rows.
    """
    empty = F.lit(None).cast("string")
    columns = [F.col(crawl_id).cast("long").alias("crawl_id"), F.col(seq).cast("long").alias("seq"), F.col(url).alias("raw")]
    columns += [(F.col(base) if base else empty).alias("base"), (F.col(seed) if seed else empty).alias("seed")]
    # The number is given, as judging a link costs far more than its bytes tell.
    spark = links.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = links.select(*columns).repartition(parts, "crawl_id").sortWithinPartitions("crawl_id", "seq")

    def pass_through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, gate = object(), Gate()
        for batch in batches:
            rows = []
            for crawl, number, raw, base_, seed_ in batch[["crawl_id", "seq", "raw", "base", "seed"]].itertuples(index=False):
                if crawl != current:
                    current, gate = crawl, Gate(rules, seed_, as_of)
                if raw is not None:
                    rows.append((crawl, number, *gate.admit(raw, base_)))
            yield pd.DataFrame(rows, columns=["crawl_id", "seq", "allowed", "raw", "url", "reason", "detail"])

    return ordered.mapInPandas(pass_through, ADMITTED)


def _beyond(rows: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """Members of each crawl's groups that come after the first ``most``: ``(crawl_id, group, member, _beyond)``."""
    first = rows.groupBy("crawl_id", group, member).agg(F.min("seq").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("crawl_id", group).orderBy("_first"))
    return first.withColumn("_rank", rank).filter(F.col("_rank") > most).select("crawl_id", group, member, F.lit(True).alias("_beyond"))


def _refused(rows: DataFrame, beyond: DataFrame, group: str, member: str, reason: str) -> DataFrame:
    marked = rows.join(beyond, ["crawl_id", group, member], "left")
    return marked.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_beyond"), reason).otherwise(F.col("reason"))).drop("_beyond")


def admit_by_windows(
    links: DataFrame,
    *,
    rules: UrlRules = DEFAULT,
    as_of: date | None = None,
    crawl_id: str = "crawl_id",
    seq: str = "seq",
    url: str = "url",
    base: str | None = None,
    seed: str | None = None,
    repeated: bool = False,
) -> DataFrame:
    """The same decisions as ``admit_in_order`` by ranks, so that a crawl of any size is spread over all tasks.

    Each link is read once, where it lies; only links of one page, the variants of one path and the URLs of one
    calendar come together. Where a link that one limit refuses would have counted for the other, or for its page,
    ranks can't tell the order's result: crawls with such links, and only those, go through the ordered pass.
    ``seq`` is unique within a crawl, or with ``repeated`` rows that have it again are the same and count once.
    """
    read = read_links(links, rules=rules, as_of=as_of, crawl_id=crawl_id, seq=seq, url=url, base=base, seed=seed)
    # Links are read where they lie, before any shuffle; what was read is then made distinct.
    return decide(cut_lineage(read.dropDuplicates(["crawl_id", "seq"]) if repeated else read), rules=rules, as_of=as_of)


def read_links(
    links: DataFrame,
    *,
    rules: UrlRules = DEFAULT,
    as_of: date | None = None,
    crawl_id: str = "crawl_id",
    seq: str = "seq",
    url: str = "url",
    base: str | None = None,
    seed: str | None = None,
) -> DataFrame:
    """What ``decide`` asks of links, each read once where it lies; those without an address are left out."""
    null = F.lit(None).cast("string")
    own = [F.col(crawl_id).cast("long").alias("crawl_id"), F.col(seq).cast("long").alias("seq"), F.col(url).alias("raw")]
    own += [(F.col(base) if base else null).alias("base"), (F.col(seed) if seed else null).alias("seed")]
    read = links.select(*own).filter("raw IS NOT NULL").withColumn("d", C.link("raw", "base", "seed", rules, as_of))
    return read.select("crawl_id", "seq", "raw", "base", "seed", "d.url", "d.reason", "d.detail", "d.key", "d.path", "d.variant", "d.calendar")


def decide(rows: DataFrame, *, rules: UrlRules = DEFAULT, as_of: date | None = None) -> DataFrame:
    """``(crawl_id, seq, raw, url, reason, allowed)`` of links that were read, by ranks; see ``admit_by_windows``."""
    fine, refused = rows.filter("reason IS NULL"), rows.filter("reason IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("crawl_id", "key").orderBy("seq"))
    ranked = fine.withColumn("_n", nth)
    first, again = ranked.filter("_n = 1").drop("_n"), ranked.filter("_n > 1").drop("_n")
    variants = _beyond(first.filter("variant <> ''"), "path", "variant", rules.max_query_variants_per_path)
    first = _refused(first, variants, "path", "variant", "trap_query_variants")
    calendars = _beyond(first.filter("reason IS NULL AND calendar IS NOT NULL"), "calendar", "url", rules.max_calendar_urls_per_pattern)
    first = cut_lineage(_refused(first, calendars, "calendar", "url", "trap_calendar"))
    # A link that a limit refuses isn't of a known page, so another link of that page is judged anew; and one that its
    # calendar refuses leaves room for another variant. Both are rare: limits are met by few crawls.
    capped = first.filter("reason IS NOT NULL")
    mixed = again.select("crawl_id", "key").join(capped.select("crawl_id", "key"), ["crawl_id", "key"], "left_semi")
    shared = capped.filter("reason = 'trap_calendar' AND variant <> ''")
    unclear = cut_lineage(mixed.select("crawl_id").unionByName(shared.select("crawl_id")).distinct())
    columns = ["crawl_id", "seq", "raw", "url", "reason"]
    decided = first.unionByName(again.withColumn("reason", F.lit("duplicate"))).unionByName(refused).select(*columns)
    if unclear.limit(1).count():
        ordered = admit_in_order(rows.join(unclear, "crawl_id", "left_semi"), rules=rules, as_of=as_of, url="raw", base="base", seed="seed")
        decided = decided.join(unclear, "crawl_id", "left_anti").unionByName(ordered.select(*columns))
    return decided.withColumn("allowed", F.col("reason").isNull())


def first_of_pages(links: DataFrame, *, rules: UrlRules = DEFAULT, crawl_id: str = "crawl_id", seq: str = "seq", url: str = "url") -> DataFrame:
    """Links that are the first of their page within a crawl; unusable ones are left out."""
    keyed = links.withColumn("dedupe_key", C.dedupe_key(url, rules)).filter("dedupe_key IS NOT NULL")
    ranked = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(crawl_id, "dedupe_key").orderBy(seq)))
    return ranked.filter("_n = 1").drop("_n")


def unseen(links: DataFrame, seen: DataFrame, *, rules: UrlRules = DEFAULT, crawl_id: str = "crawl_id", url: str = "url") -> DataFrame:
    """Links whose page isn't among those seen before; ``seen`` has ``crawl_id`` and ``dedupe_key``."""
    return links.withColumn("dedupe_key", C.dedupe_key(url, rules)).join(seen.select(crawl_id, "dedupe_key").distinct(), [crawl_id, "dedupe_key"], "left_anti")


def rejections(admitted: DataFrame) -> DataFrame:
    """How often each reason came in each crawl."""
    return admitted.filter("NOT allowed").groupBy("crawl_id", "reason").agg(F.count("*").alias("urls"))


def beyond_empty_pages(pages: DataFrame, empty: DataFrame, *, rules: UrlRules = DEFAULT, crawl_id: str = "crawl_id", url: str = "url") -> DataFrame:
    """Pages of listings from a known empty page on."""
    cut = empty.withColumn("_p", C.paging(url, rules)).filter("_p IS NOT NULL").groupBy(crawl_id, F.col("_p.listing").alias("listing")).agg(F.min("_p.number").alias("empty_from"))
    held = pages.withColumn("_p", C.paging(url, rules)).filter("_p IS NOT NULL").select(*pages.columns, F.col("_p.listing").alias("listing"), F.col("_p.number").alias("page"))
    return held.join(cut, [crawl_id, "listing"]).filter("page >= empty_from")
