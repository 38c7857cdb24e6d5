"""Reading robots.txt: groups as data, sitemaps that it declares."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom import schemas

#: Sitemaps of one file that count.
MOST_SITEMAPS = 1000


def _is_web_address(text: str) -> bool:
    try:
        parts = urlsplit(text)
    except ValueError:
        return False
    return parts.scheme.lower() in ("http", "https") and bool(parts.netloc)


def parse_robots(content: bytes | str) -> dict[str, object]:
    """Distinct sitemaps, groups of agents with what they may and may not fetch, and how many sitemaps were invalid."""
    text = content if isinstance(content, str) else content.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    lines = (line.partition("#")[0].partition(":") for line in text.replace("\0", "").splitlines())
    fields = [(name.strip().lower(), value.strip()) for name, colon, value in lines if colon]
    groups: list[dict[str, list[str]]] = []
    sitemaps: dict[str, None] = {}
    invalid, naming = 0, False
    for name, value in fields:
        if name == "user-agent":
            if not naming:
                groups.append({"user_agents": [], "allow": [], "disallow": []})
            groups[-1]["user_agents"] += [value] if value else []
        elif name == "sitemap":
            if not _is_web_address(value):
                invalid += 1
            elif len(sitemaps) < MOST_SITEMAPS:
                sitemaps.setdefault(value)
        elif name in ("allow", "disallow") and groups:
            groups[-1][name].append(value)
        naming = name == "user-agent"
    return {"sitemaps": list(sitemaps), "groups": groups, "invalid_sitemaps": invalid, "empty": not text.strip()}


def robots(body: Column | str) -> Column:
    """The parsed file as a struct, from text or binary."""
    column = F.col(body) if isinstance(body, str) else body
    return F.udf(lambda b: None if b is None else parse_robots(b if isinstance(b, str) else bytes(b)), schemas.ROBOTS, useArrow=True)(column)
