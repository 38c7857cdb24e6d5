"""What kind of page a page is, by points for the words of its URL, title, headings, metadata and text.

All phrases are held in one tree of words. A text is read once along it, whatever the number of phrases, and
every piece of evidence is a vote of a source for a kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import unquote, urlsplit

from siteloom.functions.language import ARABIC_FORMS


class Heading(NamedTuple):
    level: int
    text: str


class PageType(NamedTuple):
    category: str = "other"
    score: int = 0
    signals: tuple[str, ...] = ()
    ambiguous: bool = False


#: Kinds of pages, in the order in which ties go.
CATEGORIES = ("careers", "contact", "about", "portfolio", "services", "product", "article", "blog")
#: Words that tell a kind in URLs, titles, headings and metadata.
KEYWORDS = {
    "about": (
        "about", "about us", "who we are", "our story", "our team", "meet the team", "team", "company profile",
        "درباره ما", "درباره", "درباره شرکت", "معرفی شرکت", "معرفی ما", "تیم ما", "داستان ما",
    ),
    "contact": ("contact", "contacts", "contact us", "get in touch", "reach us", "تماس با ما", "تماس", "ارتباط با ما", "راه های ارتباطی", "راههای ارتباطی"),
    "services": ("services", "our services", "what we do", "what we offer", "خدمات", "خدمات ما", "سرویس ها", "سرویسها"),
    "product": ("product", "products", "shop", "store", "catalog", "catalogue", "محصول", "محصولات", "فروشگاه", "کاتالوگ"),
    "blog": ("blog", "blogs", "news", "articles", "posts", "magazine", "weblog", "وبلاگ", "بلاگ", "اخبار", "مقالات", "مطالب", "مجله"),
    "portfolio": (
        "portfolio", "our work", "case study", "case studies", "projects", "gallery", "showcase",
        "نمونه کار", "نمونه کارها", "پروژه ها", "پروژهها", "گالری", "نمونه پروژه",
    ),
    "careers": (
        "careers", "career", "jobs", "job", "job openings", "join us", "join our team", "work with us", "we are hiring", "hiring", "vacancies",
        "open positions", "فرصت شغلی", "فرصت های شغلی", "استخدام", "موقعیت های شغلی", "همکاری با ما", "فرصتهای شغلی",
    ),
}
#: Words of URLs that name a single article.
ARTICLE_WORDS = ("article", "post", "news item", "مقاله", "خبر", "پست")
#: Phrases of texts that count once they occur.
PHRASES = {
    "about": ("our mission", "who we are", "founded in", "our story", "ماموریت ما", "داستان ما"),
    "contact": ("send us a message", "send message", "your message", "ارسال پیام", "پیام شما"),
    "services": ("what we offer",),
    "product": ("buy now",),
    "article": ("min read", "minute read", "posted on", "published on", "written by", "reading time", "زمان مطالعه", "منتشر شده در", "نویسنده"),
    "portfolio": ("view project", "view case study", "مشاهده پروژه"),
    "careers": ("apply now", "job description", "we are hiring", "ارسال رزومه"),
}
#: Phrases of texts that count twice, and phrases that must occur three times.
STRONG_PHRASES = {"services": ("our services include",), "product": ("add to cart", "add to basket", "افزودن به سبد خرید")}
FREQUENT_PHRASES = {"blog": ("read more", "continue reading", "ادامه مطلب", "بیشتر بخوانید")}
FREQUENT = 3
#: Points by source, least score of a kind, score of a homepage, lead below which a kind is ambiguous.
LAST_SEGMENT, SEGMENT, DATED, TITLE, TITLE_REST, H1, HEADING, META, STRUCTURE = 4, 3, 3, 2, 1, 2, 1, 1, 2
LEAST_SCORE, HOMEPAGE_SCORE, MARGIN, MOST_BY_TEXT, TEXT_CHARS, SHORT_PAGE = 2, 10, 1, 2, 50_000, 3000
SOURCES = ("url", "title", "title_suffix", "h1", "heading", "meta", "text", "structure")
PLURALS = frozenset(("ها", "های"))
INDEXES = frozenset(("index", "default", "home", "main"))
MONTHS = frozenset(str(m) for m in range(1, 13)) | frozenset(f"{m:02}" for m in range(1, 10))

#: Marks that lengthen or vowel Arabic letters.
_MARKS = dict.fromkeys([0x640, *range(0x64B, 0x660), 0x670])
_SPELLED = {**ARABIC_FORMS, **_MARKS}
_ARABIC = re.compile("[\u0600-\u06ff]")
_WORD = re.compile(r"[^\W_]+")


def plain_words(text: str) -> list[str]:
    """Lower-case words; a Persian plural that stands apart joins its word."""
    words = _WORD.findall((text.translate(_SPELLED) if _ARABIC.search(text) else text).lower())
    if PLURALS.isdisjoint(words):
        return words
    found: list[str] = []
    for word in words:
        if word in PLURALS and found:
            found[-1] += word
        else:
            found.append(word)
    return found


class Phrase(NamedTuple):
    """What a phrase of the tree says: the kind, its points, and how often it must occur."""

    kind: str
    points: int = 1
    least: int = 1


class PhraseTree:
    """Phrases by their words."""

    def __init__(self, phrases: Iterable[tuple[str, Phrase]]) -> None:
        self.root: dict = {}
        for text, says in phrases:
            node = self.root
            for word in plain_words(text):
                node = node.setdefault(word, {})
            node[None] = (text, says)

    def found(self, words: list[str]) -> Iterator[Phrase]:
        """Phrases that occur as often as they must; occurrences of one that touch count once."""
        counts: dict[str, tuple[int, int]] = {}
        says: dict[str, Phrase] = {}
        for start in [i for i, word in enumerate(words) if word in self.root]:
            node, at = self.root, start
            while at < len(words) and (node := node.get(words[at])) is not None:
                at += 1
                if None in node:
                    text, phrase = node[None]
                    n, end = counts.get(text, (0, -1))
                    if start > end:
                        counts[text], says[text] = (n + 1, at), phrase
        return (p for text, p in says.items() if counts[text][0] >= p.least)


def _phrases(held: dict[str, tuple[str, ...]], points: int = 1, least: int = 1) -> list[tuple[str, Phrase]]:
    return [(text, Phrase(kind, points, least)) for kind, texts in held.items() for text in texts]


_NAMES = PhraseTree(_phrases(KEYWORDS))
_ARTICLES = PhraseTree(_phrases({"article": ARTICLE_WORDS}))
_TEXTS = PhraseTree([*_phrases(PHRASES), *_phrases(STRONG_PHRASES, points=2), *_phrases(FREQUENT_PHRASES, least=FREQUENT)])


class Vote(NamedTuple):
    source: str
    kind: str
    points: int


def _named(text: str) -> set[str]:
    return {p.kind for p in _NAMES.found(plain_words(text))}


def title_parts(title: str) -> list[str]:
    """Parts of a title: signs that only part, and others that do so between blanks."""
    parts, word = [""], re.split(r"(\s)", title)
    for i, piece in enumerate(word):
        alone = len(piece) == 1 and 0 < i < len(word) - 1 and word[i - 1].isspace() and word[i + 1].isspace()
        if alone and piece in "|–—·•:-/»«":
            parts.append("")
        else:
            first, *rest = re.split("[|·•»«]", piece)
            parts[-1] += first
            parts += rest
    return parts


class Path(NamedTuple):
    segments: list[str]
    has_query: bool

    @classmethod
    def of(cls, url: str | None) -> Path | None:
        """Path of a URL, decoded; None without a usable one."""
        try:
            parts = urlsplit((url or "").strip())
        except ValueError:
            return None
        decoded = [unquote(s).strip() for s in parts.path.split("/")]
        return cls([s for s in decoded if s], bool(parts.query)) if (url or "").strip() else None

    @property
    def is_homepage(self) -> bool:
        """Whether this is the root, with an optional locale and index document."""
        rest = [s.lower() for s in self.segments]
        locale = bool(rest) and re.fullmatch(r"[a-z][a-z](?:[_-][a-z\d]{2,4})?", rest[0], re.ASCII)
        rest = rest[1:] if locale else rest
        name, dot, ending = rest[0].partition(".") if rest else ("index", "", "")
        document = name in INDEXES and (not dot or 2 <= len(ending) <= 5 and ending.isascii() and ending.isalnum())
        return not self.has_query and len(rest) < 2 and document

    def votes(self) -> Iterator[Vote]:
        """Kinds that segments name: a section of a blog is the blog if it ends the path, else leads to an article."""
        *_, last = [None, *range(len(self.segments))]
        for i, segment in enumerate(self.segments):
            words, points = plain_words(segment), LAST_SEGMENT if i == last else SEGMENT
            for p in (*_NAMES.found(words), *_ARTICLES.found(words)):
                if p.kind == "blog":
                    yield Vote("url", "blog" if i == last else "article", LAST_SEGMENT)
                else:
                    yield Vote("url", p.kind, points)
        # A slash inside a decoded segment parts it as well.
        parts = "/".join(self.segments).split("/")
        if any(len(y) == 4 and y.isdecimal() and y[:2] in ("19", "20") and m in MONTHS for y, m in zip(parts, parts[1:])):
            yield Vote("url", "article" if len(self.segments) > 2 else "blog", DATED)


def _votes(path: Path | None, title: str | None, text: str, headings: list[Heading], meta: dict[str, str], reachable: bool, placed: bool) -> Iterator[Vote]:
    yield from path.votes() if path else ()
    first, *rest = title_parts(title) if title else [""]
    about = " | ".join(meta[k] for k in ("description", "keywords", "og_title", "og_description") if meta.get(k))
    top = " | ".join(h.text for h in headings if h.level == 1)
    below = " | ".join(h.text for h in headings if h.level != 1)
    for source, points, texts in (("title", TITLE, [first]), ("title_suffix", TITLE_REST, rest), ("h1", H1, [top]), ("heading", HEADING, [below]), ("meta", META, [about])):
        for kind in {k for t in texts for k in _named(t)}:
            yield Vote(source, kind, points)
    for p in _TEXTS.found(plain_words(text[:TEXT_CHARS])):
        yield Vote("text", p.kind, p.points)
    if reachable and placed and len(text) <= SHORT_PAGE:
        yield Vote("structure", "contact", STRUCTURE)


def classify(url: str | None, title: str | None, text: str, headings: list[Heading], meta: dict[str, str], reachable: bool, placed: bool) -> PageType:
    """The kind with the most points. A URL's votes for a kind count as their largest, a text's as at most two."""
    path = next((p for p in map(Path.of, (url, meta.get("canonical_url"), meta.get("og_url"))) if p), None)
    if path and path.is_homepage:
        return PageType("homepage", HOMEPAGE_SCORE, ("url",))
    points: dict[str, dict[str, int]] = {k: {} for k in CATEGORIES}
    for source, kind, n in _votes(path, title, text, headings, meta, reachable, placed):
        held = points[kind].get(source, 0)
        points[kind][source] = max(held, n) if source == "url" else min(held + n, MOST_BY_TEXT) if source == "text" else n
    totals = sorted(((-sum(p.values()), i) for i, p in enumerate(points.values())))
    (best, i), (second, _) = totals[:2]
    if -best < LEAST_SCORE:
        return PageType()
    kind = CATEGORIES[i]
    return PageType(kind, -best, tuple(s for s in SOURCES if s in points[kind]), -second >= LEAST_SCORE and second - best <= MARGIN)
