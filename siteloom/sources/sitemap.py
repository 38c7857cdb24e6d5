"""Reading sitemaps and following indexes of them, over a table of fetched files."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date
from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom import schemas
from siteloom.functions import decisions, urls
from siteloom.functions import columns as C
from siteloom.functions.rules import DEFAULT, Rejected, UrlRules
from siteloom.operators.admission import Gate
from siteloom.session import cut_lineage
from siteloom.sources.robots import parse_robots

#: Bytes and addresses of one file, and limits of a whole discovery.
MOST_BYTES, MOST_LOCS, MOST_FILES, MOST_URLS, MOST_DEPTH, DEPTH_CEILING = 5 << 20, 50_000, 1000, 100_000, 5, 20

_DTD = r"<!\s*(?:DOCTYPE|ENTITY)"


class _Unsafe(Exception):
    pass


def _refuse(*_: object) -> int:
    raise _Unsafe


def parse_sitemap(data: bytes, most_bytes: int = MOST_BYTES) -> dict[str, object]:
    """Addresses of a sitemap or an index; files with a DTD are refused, broken ones told apart. Never fails."""
    result: dict[str, object] = {"status": "ok", "kind": None, "locs": [], "empty_locs": 0, "missing_locs": 0, "truncated": False, "detail": ""}

    def failed(status: str, detail: str = "") -> dict[str, object]:
        return {**result, "status": status, "detail": detail, "kind": None, "locs": [], "empty_locs": 0, "missing_locs": 0, "truncated": False}

    if len(data) > most_bytes:
        return failed("too_large")
    if not data.strip():
        return failed("empty")
    if re.search(_DTD.encode(), data, re.IGNORECASE) or re.search(_DTD, data.decode("utf-16", "ignore")[:4096], re.IGNORECASE):
        return failed("unsafe", "doctype_or_entity")
    if b"\0" in data and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        return failed("malformed", "binary")

    path: list[str] = []
    locs: list[str] = result["locs"]
    loc: list[str] | None = None
    found = False

    def start(name: str, _: dict[str, str]) -> None:
        nonlocal loc, found
        path.append(name.rpartition("}")[2])
        if len(path) == 1:
            result["kind"] = path[0] if path[0] in ("urlset", "sitemapindex") else None
        elif path[1:] == [{"urlset": "url", "sitemapindex": "sitemap"}.get(result["kind"], "")]:
            found = False
        elif len(path) == 3 and path[1:] == [{"urlset": "url", "sitemapindex": "sitemap"}.get(result["kind"], ""), "loc"] and not found:
            loc, found = [], True

    def text(data_: str) -> None:
        if loc is not None and len(path) == 3:
            loc.append(data_)

    def end(_: str) -> None:
        nonlocal loc
        if len(path) == 3 and loc is not None:
            value = "".join(loc).strip()
            if not value:
                result["empty_locs"] += 1
            elif len(locs) >= MOST_LOCS:
                result["truncated"] = True
            else:
                locs.append(value)
            loc = None
        elif len(path) == 2 and not found and path[1] == {"urlset": "url", "sitemapindex": "sitemap"}.get(result["kind"]):
            result["missing_locs"] += 1
        path.pop()

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, text, end
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = parser.UnparsedEntityDeclHandler = parser.ExternalEntityRefHandler = _refuse
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    root = ""
    try:
        parser.Parse(data, True)
        m = re.search(rb"<([A-Za-z_][\w.:-]*)", data)
        root = m.group(1).decode().rpartition(":")[2] if m else ""
    except _Unsafe:
        return failed("unsafe", "doctype_or_entity")
    except (expat.ExpatError, ValueError, LookupError, RecursionError) as error:
        return failed("malformed", type(error).__name__)
    return result if result["kind"] else failed("unsupported", f"root:{root[:40]}")


def sitemap(body: Column | str, most_bytes: int = MOST_BYTES) -> Column:
    """The parsed file as a struct, from binary."""
    column = F.col(body) if isinstance(body, str) else body
    return F.udf(lambda b: None if b is None else parse_sitemap(bytes(b), most_bytes), schemas.SITEMAP, useArrow=True).asNondeterministic()(column)


def _read_levels(files: DataFrame, roots: DataFrame, rules: UrlRules, most_depth: int) -> Iterator[tuple[int, DataFrame]]:
    """Files by their distance from the roots, each once: ``(sitemap, s)``, where ``s`` is null for one that isn't there.

    After ``most_depth`` comes one more level, of files that are named but too deep.
    """
    parsed = cut_lineage(files.select(C.normal_url("url", rules=rules).alias("sitemap"), sitemap("body").alias("s")))
    level = cut_lineage(roots.select(C.normal_url("url", rules=rules).alias("sitemap")).filter("sitemap IS NOT NULL").distinct())
    seen = level
    for depth in range(most_depth + 2):
        held = level.join(parsed, "sitemap", "left")
        yield depth, held
        inner = held.filter("s.status = 'ok' AND s.kind = 'sitemapindex'").select(F.explode("s.locs").alias("loc")).filter(F.col("loc").rlike(r"(?i)^https?://"))
        level = cut_lineage(inner.select(C.normal_url("loc", rules=rules).alias("sitemap")).filter("sitemap IS NOT NULL").distinct().join(seen, "sitemap", "left_anti"))
        if not level.limit(1).count():
            return
        seen = cut_lineage(seen.unionByName(level))


def expand(files: DataFrame, roots: DataFrame, *, rules: UrlRules = DEFAULT, most_depth: int = MOST_DEPTH) -> DataFrame:
    """``(sitemap, url, position, depth)`` of every page address below the roots, over many sites at once.

    ``files`` has ``url`` and ``body``; ``roots`` has ``url``. One job for each depth; a file is read once, so
    cycles end. What was left out, and why, ``file_outcomes`` tells.
    """
    pages = None
    for depth, held in _read_levels(files, roots, rules, most_depth):
        if depth > most_depth:
            break
        locs = held.filter("s.status = 'ok' AND s.kind = 'urlset'").select("sitemap", F.posexplode("s.locs").alias("position", "loc"))
        found = locs.select("sitemap", C.normal_url("loc", "sitemap", rules=rules).alias("url"), "position", F.lit(depth).alias("depth")).filter("url IS NOT NULL")
        pages = found if pages is None else pages.unionByName(found)
    return pages


def file_outcomes(files: DataFrame, roots: DataFrame, *, rules: UrlRules = DEFAULT, most_depth: int = MOST_DEPTH) -> DataFrame:
    """``(sitemap, depth, outcome, kind, locs, usable, empty_locs, missing_locs, truncated)``: what became of every file that
    the roots lead to.

    The outcome is that of parsing (``ok``, ``too_large``, ``empty``, ``unsafe``, ``malformed``, ``unsupported``), ``not_fetched``
    for a file that isn't there, or ``too_deep``. ``truncated`` says that a file has more addresses than are read.
    """
    found = None
    for depth, held in _read_levels(files, roots, rules, most_depth):
        outcome = F.lit("too_deep") if depth > most_depth else F.coalesce("s.status", F.lit("not_fetched"))
        usable = F.size(F.filter("s.locs", lambda u: u.rlike(r"(?i)^https?://")))
        none = F.lit(0)
        row = held.select(
            "sitemap", F.lit(depth).alias("depth"), outcome.alias("outcome"), F.col("s.kind").alias("kind"), F.coalesce(F.size("s.locs"), none).alias("locs"), F.coalesce(usable, none).alias("usable"),
            F.coalesce("s.empty_locs", none).alias("empty_locs"), F.coalesce("s.missing_locs", none).alias("missing_locs"), F.coalesce("s.truncated", F.lit(False)).alias("truncated"),
        )
        found = row if found is None else found.unionByName(row)
    return found


class Discovery:
    """Sitemaps of one site in document order, within limits, through a function from URL to (status, body)."""

    def __init__(
        self, fetch: Callable[[str], tuple[str, bytes]], *, rules: UrlRules = DEFAULT, as_of: date | None = None,
        most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES, most_urls: int = MOST_URLS, most_depth: int = MOST_DEPTH,
    ) -> None:
        if most_files < 1 or most_urls < 1 or not 0 <= most_depth <= DEPTH_CEILING:
            raise ValueError("limits of a discovery are out of range")
        self.fetch, self.rules, self.as_of = fetch, rules, as_of
        self.most_bytes, self.most_files, self.most_urls, self.most_depth = most_bytes, most_files, most_urls, most_depth

    def _get(self, url: str) -> tuple[str, bytes]:
        try:
            return self.fetch(url)
        except Exception:  # noqa: BLE001 - whatever fails in fetching is a failed fetch
            return "connection_error", b""

    def discover(self, target: str) -> dict[str, object]:
        """Files read with their outcome, page URLs admitted, and which limits were reached. Never fails."""
        result: dict[str, object] = {
            "target": target, "error": None, "robots_status": None, "used_fallback": False, "sitemaps": [], "urls": [], "rejections": Counter(),
            "duplicate_refs": 0, "skipped_files": 0, "skipped_by_depth": 0, "url_limit": False, "file_limit": False, "depth_limit": False,
        }
        try:
            n = urls.normalise(target if "//" in target else f"https://{target}", rules=self.rules)
        except Rejected as error:
            return {**result, "error": str(error)}
        judged = decisions.judge(n, rules=self.rules, as_of=self.as_of, pages_only=False)
        if not judged.allowed:
            return {**result, "error": f"{judged.reason}: {judged.detail}"}
        origin = f"{n.scheme}://{n.host}{'' if n.port is None else f':{n.port}'}"
        gate, seen = Gate(self.rules, n.host, self.as_of), set()
        rejected: Counter[str] = result["rejections"]

        def check(raw: str) -> str | None:
            found = decisions.evaluate(raw, seed=n.host, rules=self.rules, as_of=self.as_of, pages_only=False)
            if not found.allowed:
                rejected[found.reason] += 1
            return found.url if found.allowed else None

        status, body = self._get(f"{origin}/robots.txt")
        result["robots_status"] = status
        declared = [u for u in map(check, parse_robots(body)["sitemaps"]) if u] if status == "ok" else []
        roots = list(dict.fromkeys(declared))
        result["used_fallback"] = not roots
        todo: list[tuple[str, str | None, int]] = [(u, None, 0) for u in roots or [f"{origin}/sitemap.xml"]]
        while todo:
            url, parent, depth = todo.pop(0)
            if result["url_limit"] or len(result["urls"]) >= self.most_urls:
                result["url_limit"] = True
                break
            key = urls.dedupe_key(url, self.rules)
            if key in seen:
                result["duplicate_refs"] += 1
                continue
            seen.add(key)
            if len(result["sitemaps"]) >= self.most_files:
                result["file_limit"] = True
                result["skipped_files"] += 1
                continue
            status, body = self._get(url)
            entry = {"url": url, "parent": parent, "depth": depth, "status": status, "parse_status": None, "kind": None, "locs": 0, "admitted": 0, "rejected_children": 0}
            result["sitemaps"].append(entry)
            parsed = parse_sitemap(body, self.most_bytes) if status == "ok" else None
            if parsed is None or parsed["status"] != "ok":
                entry["parse_status"] = parsed["status"] if parsed else None
                continue
            entry |= {"parse_status": "ok", "kind": parsed["kind"], "locs": len(parsed["locs"])}
            children = []
            for loc in parsed["locs"]:
                if parsed["kind"] == "urlset":
                    if len(result["urls"]) >= self.most_urls:
                        result["url_limit"] = True
                        break
                    found = gate.admit(loc, url)
                    if found.allowed:
                        result["urls"].append(found.url)
                        entry["admitted"] += 1
                    continue
                child = check(loc) if re.match(r"https?://", loc, re.IGNORECASE) else None
                if child is None:
                    rejected["invalid_url"] += not re.match(r"https?://", loc, re.IGNORECASE)
                    entry["rejected_children"] += 1
                elif depth + 1 > self.most_depth:
                    result["depth_limit"] = True
                    result["skipped_by_depth"] += 1
                else:
                    children.append((child, url, depth + 1))
            todo[:0] = children  # document order, depth first
        rejected.update(gate.rejections)
        return result
