"""Crawls as tables: outcomes of fetches, redirects, breadth-first replay, states, resuming and reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom import schemas
from siteloom.functions import columns as C
from siteloom.functions.rules import DEFAULT, UrlRules
from siteloom.operators.admission import decide, read_links
from siteloom.session import cut_lineage, numbered

#: Redirects that a fetch follows, and body bytes that it reads.
MOST_REDIRECTS, MOST_BYTES = 5, 5 << 20


def outcome(status: Column, location: Column, content_length: Column, content_type: Column, size: Column, most_bytes: int = MOST_BYTES) -> Column:
    """Outcome of a response; the first rule that applies decides."""
    declared = F.trim(content_length.cast("string")).try_cast("decimal(38,0)")
    return (
        F.when(status.isin(301, 302, 303, 307, 308) & location.isNotNull(), "redirect_not_followed")
        .when(status.isin(301, 302, 303, 307, 308), "redirect_error")
        .when(declared > most_bytes, "too_large")
        .when(~status.between(200, 299), "http_error")
        .when(C.content_type_problem(content_type).isNotNull(), "unsupported_content_type")
        .when(size > most_bytes, "too_large")
        .otherwise("ok")
    )


def discovery_status(status: Column) -> Column:
    """Status of a fetched robots or sitemap file by its HTTP code."""
    return (
        F.when(status == 200, "ok")
        .when(status.isin(404, 410), "not_found")
        .when(status.isin(401, 403), "forbidden")
        .when(status == 429, "rate_limited")
        .when(status.between(500, 599), "server_error")
        .otherwise("http_error")
    )


def follow_redirects(starts: DataFrame, hops: DataFrame, *, url: str = "url", location: str = "location", most: int = MOST_REDIRECTS) -> DataFrame:
    """``(url, final_url, hops, problem)``: where each start ends; ``problem`` is ``loop``, ``too_many``, ``missing_location`` or
    ``not_http``.

    One join for each hop over rows that still move; ``hops`` has a row for each redirecting URL, whose target is null
    where the answer named none. A start whose way ends in a problem stays at the last page that it reached.
    """
    edges = hops.groupBy(F.col(url).alias("at")).agg(F.min(location).alias("next"), F.lit(True).alias("_moves"))
    state = starts.select(F.col(url).alias("url"), F.col(url).alias("at"), F.array(url).alias("seen"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("problem"))
    for _ in range(most + 1):
        moved = state.join(edges, "at", "left")
        goes = F.col("next").isNotNull() & F.col("problem").isNull()
        stuck = F.coalesce("_moves", F.lit(False)) & F.col("problem").isNull()
        problem = F.when(stuck & F.col("next").isNull(), "missing_location").when(goes & F.col("next").rlike("(?i)^(?!https?:)[a-z][a-z0-9+.-]*:"), "not_http")
        problem = problem.when(goes & F.array_contains("seen", F.col("next")), "loop").when(goes & (F.col("hops") >= most), "too_many").otherwise(F.col("problem"))
        step = moved.withColumn("_p", problem)
        on = F.col("next").isNotNull() & F.col("_p").isNull()
        state = step.select(
            "url",
            F.when(on, F.col("next")).otherwise(F.col("at")).alias("at"),
            F.when(on, F.concat("seen", F.array("next"))).otherwise(F.col("seen")).alias("seen"),
            (F.col("hops") + F.when(on, 1).otherwise(0)).alias("hops"),
            F.col("_p").alias("problem"),
        )
    return state.select("url", F.col("at").alias("final_url"), "hops", "problem")


def replay(
    seeds: DataFrame,
    edges: DataFrame,
    *,
    max_depth: int | None = None,
    max_pages: int | None = None,
    rules: UrlRules = DEFAULT,
    as_of: date | None = None,
    fetched: DataFrame | None = None,
) -> DataFrame:
    """Breadth-first crawl over known links: ``(crawl_id, url, depth, parent_url, status, seq)``.

    ``seeds`` has ``crawl_id`` and ``url``; ``edges`` has ``url``, ``position`` and ``href`` of fetched pages. Links are
    admitted in the order in which a crawler meets them; those beyond ``max_pages`` are skipped but stay known. Without
    ``max_depth`` or ``max_pages`` each crawl has its own in that column of ``seeds``; null is no limit. It ends when no
    crawl has pages to follow. ``fetched`` may say what became of pages: of ``url``, ``final_url`` and ``content_type``,
    those that lead to a page known before are ``duplicate``, those that aren't HTML ``not_html``, and neither has links.

    Each level is one job whose frontier is written to the shared folder. A link is read once, at its level; what was
    admitted is kept as it was read. Links of a crawl are numbered and judged over all tasks, however many it has.
    """
    own = {"max_depth": max_depth, "max_pages": max_pages}
    limits = cut_lineage(seeds.select("crawl_id", *((F.col(c) if given is None else F.lit(given)).cast("long").alias(f"_{c}") for c, given in own.items())).distinct())
    seed = seeds.select("crawl_id", F.regexp_extract("url", r"^(?:https?://)?([^/:]+)", 1).alias("_seed")).dropDuplicates(["crawl_id"])
    level = seeds.select("crawl_id", C.normal_url("url", rules=rules, default_scheme="https").alias("url")).filter("url IS NOT NULL").distinct()
    level = level.join(seed, "crawl_id").withColumn("seq", F.lit(0).cast("long"))
    known = cut_lineage(read_links(level, rules=rules, as_of=as_of, seed="_seed"))
    pages = level.select("crawl_id", "url", F.lit(None).cast("string").alias("parent_url"), F.lit(0).alias("depth"), F.lit("pending").alias("status"), "seq")
    pages = cut_lineage(_settled(pages, fetched, known, rules) if fetched is not None else pages)
    done, depth = pages, 0
    while True:
        depth += 1
        open_ = limits.filter(F.col("_max_depth").isNull() | (F.col("_max_depth") >= depth)).select("crawl_id")
        frontier = pages.filter("status = 'pending'").join(open_, "crawl_id", "left_semi")
        if not frontier.limit(1).count():
            return done
        found = frontier.select("crawl_id", F.col("url"), "seq").join(edges, "url").select("crawl_id", F.col("url").alias("parent_url"), "href", F.col("seq").alias("_s"), F.col("position").alias("_p"))
        links = numbered(found.join(seed, "crawl_id"), ["crawl_id"], ["_s", "_p", "href"], "_n")
        last = done.groupBy("crawl_id").agg(F.max("seq").alias("_last"), F.count("*").alias("_size"))
        links = links.join(last, "crawl_id").withColumn("seq", F.col("_last") + F.col("_n"))
        fresh = cut_lineage(read_links(links, rules=rules, as_of=as_of, url="href", base="parent_url", seed="_seed"))
        # What was admitted before comes first, and so is admitted again as it stands.
        admitted = decide(known.unionByName(fresh), rules=rules, as_of=as_of).filter("allowed").select("crawl_id", "seq")
        admitted = fresh.join(admitted, ["crawl_id", "seq"], "left_semi")
        ranked = numbered(admitted.select("crawl_id", "seq", "url", F.col("base").alias("parent_url")), ["crawl_id"], ["seq"], "_r").join(last, "crawl_id").join(limits, "crawl_id")
        status = F.when(F.col("_size") + F.col("_r") > F.col("_max_pages"), "skipped").otherwise("pending")
        pages = ranked.select("crawl_id", "url", "parent_url", F.lit(depth).alias("depth"), status.alias("status"), "seq")
        known = cut_lineage(known.unionByName(admitted))
        pages = cut_lineage(_settled(pages, fetched, known, rules) if fetched is not None else pages)
        if not pages.limit(1).count():
            return done
        done = cut_lineage(done.unionByName(pages))


def _settled(pages: DataFrame, fetched: DataFrame, known: DataFrame, rules: UrlRules) -> DataFrame:
    """``pages`` with the status of those that led to another known page, or to what isn't HTML."""
    held = fetched.select(F.col("url"), F.col("final_url").alias("_final"), C.content_type_problem("content_type", rules).isNotNull().alias("_other")).dropDuplicates(["url"])
    moved = pages.join(held, "url", "left").withColumn("_key", F.when(F.col("_final") != F.col("url"), C.dedupe_key("_final", rules)))
    targets = known.select("crawl_id", F.col("key").alias("_key"), F.col("url").alias("_known")).filter("_key IS NOT NULL").dropDuplicates(["crawl_id", "_key"])
    joined = moved.join(targets, ["crawl_id", "_key"], "left")
    copy = F.col("_known").isNotNull() & (F.col("_known") != F.col("url"))
    status = F.when(F.col("status") != "pending", F.col("status")).when(copy, "duplicate").when(F.coalesce("_other", F.lit(False)), "not_html").otherwise("pending")
    return joined.select("crawl_id", "url", "parent_url", "depth", status.alias("status"), "seq")


def replay_report(pages: DataFrame, limits: DataFrame) -> DataFrame:
    """One row for each replayed crawl: its pages by status and depth, and why it stopped.

    ``limits`` has ``crawl_id``, ``max_depth`` and ``max_pages``. The reason is ``max_pages`` where pages were skipped,
    ``max_depth`` where the last level that was allowed was reached, else ``completed``.
    """
    by_depth = pages.groupBy("crawl_id", "depth").agg(F.count("*").alias("n"))
    depths = by_depth.groupBy("crawl_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("depth", "n")))).alias("pages_by_depth"), F.max("depth").alias("deepest"))
    states = ("pending", "skipped", "duplicate", "not_html")
    counts = pages.groupBy("crawl_id").agg(F.count("*").alias("pages"), *(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in states))
    reason = F.when(F.col("skipped") > 0, "max_pages").when(F.col("deepest") >= F.col("max_depth"), "max_depth").otherwise("completed")
    joined = counts.join(depths, "crawl_id").join(limits.select("crawl_id", "max_depth", "max_pages").dropDuplicates(["crawl_id"]), "crawl_id", "left")
    return joined.select("crawl_id", "pages", *states, "pages_by_depth", "deepest", reason.alias("stop_reason"))


def lifecycle(status: Column, stop_reason: Column) -> Column:
    """State of a crawl for its users."""
    return (
        F.when(status == "pending", "created")
        .when(status == "completed", "completed")
        .when(status == "failed", "failed")
        .when((status == "cancelled") | stop_reason.isNotNull(), "stopped")
        .otherwise("running")
    )


def resumable(status: Column) -> Column:
    return status.isin("pending", "running")


def rate_schedule(requests: DataFrame, *, host: str = "host", order: str = "seq", delay: float = 1.0, start: float = 0.0, deadline: float | None = None) -> DataFrame:
    """Starts of requests, evenly apart for each host; null for those after the deadline. A host's requests are numbered
    over all tasks."""
    at = F.lit(start) + (F.col("_request") - 1) * F.lit(delay)
    return numbered(requests, [host], [order], "_request").withColumn("starts_at", at if deadline is None else F.when(at < deadline, at)).drop("_request")


def pages_by_id(pages: DataFrame, key: str = "id") -> DataFrame:
    """Pages without second deliveries."""
    return pages.dropDuplicates([key])


def status_counts(pages: DataFrame) -> DataFrame:
    """Pages of each crawl by status."""
    return pages.groupBy("crawl_id", "status").agg(F.count_distinct("id").alias("pages"))


def pending(pages: DataFrame, redirected: bool = True) -> DataFrame:
    """Queued pages that were not requested, nor reached as another page's redirect target."""
    queued = pages.filter("status = 'pending'").select("crawl_id", "id", "url", "depth").distinct()
    if not redirected:
        return queued
    done = pages.filter("status IN ('fetched', 'failed') AND final_url IS NOT NULL")
    targets = done.select("crawl_id", C.normal_url("final_url").alias("url")).filter("url IS NOT NULL").distinct()
    return queued.join(targets, ["crawl_id", "url"], "left_anti")


def resume(pages: DataFrame, crawls: DataFrame) -> DataFrame:
    """``(crawl_id, id, url, depth, promoted)``: what a resumed crawl would request, skipped pages while there is room."""
    rows = pages_by_id(pages)
    counts = rows.groupBy("crawl_id").agg(F.count(F.when(F.col("status").isin("fetched", "failed", "pending"), 1)).alias("_used"))
    limits = crawls.dropDuplicates(["id"]).filter(resumable(F.col("status"))).select(F.col("id").alias("crawl_id"), "max_pages")
    room = limits.join(counts, "crawl_id").select("crawl_id", (F.col("max_pages") - F.col("_used")).alias("_room"))
    skipped = rows.filter("status = 'skipped'").withColumn("_n", F.row_number().over(Window.partitionBy("crawl_id").orderBy("id")))
    promoted = skipped.join(room, "crawl_id").filter("_n <= _room").select("crawl_id", "id", "url", "depth", F.lit(True).alias("promoted"))
    waiting = pending(rows).join(limits.select("crawl_id"), "crawl_id", "left_semi").select("crawl_id", "id", "url", "depth", F.lit(False).alias("promoted"))
    return waiting.unionByName(promoted)


def state_report(crawls: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each crawl: its state, times and pages by status."""
    rows = pages.groupBy("crawl_id", "id").agg(F.max("status").alias("status"), F.max("depth").alias("depth"), F.max("updated_at").alias("updated_at"), F.max("duration_seconds").alias("duration"))

    def n(*states: str) -> Column:
        return F.count(F.when(F.col("status").isin(*states), 1))

    counts = rows.groupBy("crawl_id").agg(
        F.count("*").alias("total_pages"),
        n("fetched", "failed").alias("visited"),
        n("fetched").alias("successful"),
        n("failed").alias("failed"),
        n("pending").alias("pending"),
        n("skipped").alias("skipped"),
        F.max(F.when(F.col("status").isin("fetched", "failed"), F.col("depth"))).alias("current_depth"),
        F.max("updated_at").alias("_pages_at"),
    )
    joined = crawls.dropDuplicates(["id"]).join(counts, F.col("id") == F.col("crawl_id"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total_pages", "visited", "successful", "failed", "pending", "skipped")]
    return joined.select(
        F.col("id").alias("crawl_id"), "status", lifecycle(F.col("status"), F.col("stop_reason")).alias("lifecycle"), "stop_reason", "seed_url", "created_at",
        "started_at", "finished_at", F.greatest("updated_at", "_pages_at").alias("last_update_at"), F.coalesce("current_depth", F.lit(0)).alias("current_depth"), *zero,
    )


def bad_transitions(log: DataFrame, *, key: str = "crawl_id", order: str = "seq", status: str = "status") -> DataFrame:
    """Changes of state that aren't allowed, in a log of states."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(order))
    allowed = F.lit(False)
    for old, new in schemas.CRAWL_CHANGES.items():
        if new:
            allowed = allowed | ((F.col("_before") == old) & F.col(status).isin(*new))
    return log.withColumn("_before", before).filter(F.col("_before").isNotNull() & (F.col("_before") != F.col(status)) & ~allowed).withColumnRenamed("_before", "before")


def set_status(crawls: DataFrame, changes: DataFrame, *, strict: bool = True) -> DataFrame:
    """Crawls with a change of state applied: ``changes`` has ``id``, ``status``, ``at`` and ``error_message``.

    A change that isn't allowed fails the query, or with ``strict=False`` leaves the crawl as it is.
    """
    new = changes.select("id", F.col("status").alias("_to"), F.col("at").alias("_at"), F.col("error_message").alias("_error"))
    joined = crawls.join(new, "id", "left")
    good = F.lit(False)
    for old, targets in schemas.CRAWL_CHANGES.items():
        if targets:
            good = good | ((F.col("status") == old) & F.col("_to").isin(*targets))
    change = F.col("_to").isNotNull() & good
    bad = F.col("_to").isNotNull() & ~good
    error = F.raise_error(F.concat(F.lit("crawl "), F.col("id").cast("string"), F.lit(": "), F.col("status"), F.lit(" -> "), F.col("_to"), F.lit(" not allowed")))
    final = F.col("_to").isin("completed", "failed", "cancelled")
    status = F.when(change, F.col("_to")).otherwise(F.col("status"))
    if strict:
        status = F.when(bad, error).otherwise(status)
    done = {
        "status": status,
        "started_at": F.when(change, F.coalesce("started_at", "_at")).otherwise(F.col("started_at")),
        "finished_at": F.when(change & final, F.col("_at")).otherwise(F.col("finished_at")),
        "error_message": F.when(change, F.coalesce("_error", "error_message")).otherwise(F.col("error_message")),
    }
    return joined.select(*(done[c].alias(c) if c in done else F.col(c) for c in crawls.columns))
