"""Judging URLs: one decision from all stateless checks, canonical links, content that is worth parsing."""

from __future__ import annotations

from datetime import date
from html.parser import HTMLParser
from typing import NamedTuple

from siteloom.functions.hosts import check_scope, host_block_reason, registered_domain
from siteloom.functions.rules import DEFAULT, Rejected, UrlRules
from siteloom.functions.traps import paging, trap_of
from siteloom.functions.urls import Url, normalise

#: File endings that never hold a page, and media types that do.
NOT_PAGES = frozenset(
    "jpg jpeg png gif webp avif bmp ico svg tif tiff heic mp3 mp4 m4a m4v wav ogg webm avi mov wmv flv mkv mpg mpeg zip gz tgz tar rar 7z bz2 xz "
    "exe msi dmg pkg apk deb rpm iso bin jar css js mjs map json xml rss atom wasm csv woff woff2 ttf otf eot doc docx xls xlsx ppt pptx odt ods "
    "odp rtf ics vcf".split()
)
HTML_TYPES = frozenset(("text/html", "application/xhtml+xml"))


class Decision(NamedTuple):
    allowed: bool
    raw: str | None
    url: str | None
    reason: str | None = None
    detail: str = ""


def extension(path: str) -> str:
    """Lower-case file ending of a path; empty if there is none or it is too long to be one."""
    name = path.rpartition("/")[2].partition(";")[0]
    stem, dot, ending = name.rpartition(".")
    return ending.lower() if dot and 0 < len(ending) < 9 else ""


def bad_extension(path: str, rules: UrlRules = DEFAULT) -> str | None:
    """The file ending if it rules the path out as a page."""
    ending = extension(path)
    optional = {"pdf": rules.allow_pdf, "txt": rules.allow_plain_text}
    bad = not optional[ending] if ending in optional else ending in NOT_PAGES
    return ending if bad else None


def media_type(header: str | None) -> str | None:
    """Media type of a Content-Type header without parameters."""
    return (header or "").partition(";")[0].strip().lower() or None


def content_type_problem(header: str | None, rules: UrlRules = DEFAULT) -> str | None:
    media = media_type(header)
    good = set(HTML_TYPES) | ({"text/plain"} if rules.allow_plain_text else set()) | ({"application/pdf"} if rules.allow_pdf else set())
    fine = rules.allow_missing_content_type if media is None else media in good
    return None if fine else "content_type_not_eligible"


def content_length_problem(value: object, rules: UrlRules = DEFAULT) -> str | None:
    try:
        return "content_too_large" if value is not None and int(str(value).strip()) > rules.max_content_length else None
    except ValueError:
        return None


def judge(n: Url, raw: str | None = None, *, seed: str | None = None, rules: UrlRules = DEFAULT, as_of: date | None = None, pages_only: bool = True) -> Decision:
    """All stateless checks of a normalised URL in their order; the first that fails gives the reason."""

    def no(reason: str, detail: str) -> Decision:
        return Decision(False, raw or n.url, n.url, reason, detail)

    blocked = host_block_reason(n.host, rules)
    if blocked:
        return no("ssrf_blocked", blocked)
    if registered_domain(n.host, rules.extra_public_suffixes) is None:
        return no("public_suffix", n.host)
    scope = check_scope(n.host, seed or n.host, rules)
    if not scope.allowed:
        return no(scope.reason, scope.detail)
    ending = bad_extension(n.path, rules) if pages_only else None
    if ending:
        return no("non_html_extension", ending)
    trap = trap_of(n, rules, as_of)
    return no(*trap) if trap else Decision(True, raw or n.url, n.url)


def evaluate(raw: str, base: str | None = None, **how: object) -> Decision:
    """Normalise and judge a link as it was found; a redirect's target passes like any other link."""
    rules = how.get("rules", DEFAULT)
    try:
        n = normalise(raw, base, rules)
    except Rejected as error:
        return Decision(False, raw, None, error.reason, error.detail)
    return judge(n, raw, **how)


class Canonical(NamedTuple):
    url: str | None
    reason: str = ""
    changed: bool = False


def resolve_canonical(page_url: str, href: str | None, rules: UrlRules = DEFAULT) -> Canonical:
    """The canonical URL that a page declares, unless the hint is missing, invalid, unsafe or plainly wrong."""
    page = normalise(page_url, rules=rules)
    if not (href or "").strip():
        return Canonical(None, "missing")
    try:
        target = normalise(href, page.url, rules)
    except Rejected as error:
        return Canonical(None, f"invalid:{error.reason}")
    if host_block_reason(target.host, rules):
        return Canonical(None, "ssrf_blocked")
    if not rules.canonical_allow_cross_domain and target.host.removeprefix("www.") != page.host.removeprefix("www."):
        own = {registered_domain(u.host, rules.extra_public_suffixes) for u in (page, target)}
        if len(own) > 1:
            return Canonical(None, "cross_domain")
    if rules.canonical_ignore_root and target.path == "/" != page.path:
        return Canonical(None, "root_canonical")
    here, there = paging(page), paging(target)
    if here and here.number > 1 and (there is None or there.number != here.number):
        return Canonical(None, "drops_pagination")
    return Canonical(target.url, "", target.url != page.url)


class _Head(HTMLParser):
    href: str | None = None
    done = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self.done = True
        elif tag == "link" and not self.done and self.href is None:
            held = {k.lower(): v for k, v in attrs}
            if "canonical" in (held.get("rel") or "").lower().split() and (held.get("href") or "").strip():
                self.href = held["href"].strip()

    def handle_endtag(self, tag: str) -> None:
        self.done = self.done or tag == "head"


def canonical_href(html: str) -> str | None:
    """The canonical link in the head of a document (its first 256 Ki characters)."""
    head = _Head(convert_charrefs=True)
    for start in range(0, min(len(html), 1 << 18), 1 << 14):
        head.feed(html[start : start + (1 << 14)])
        if head.done or head.href is not None:
            break
    return head.href
