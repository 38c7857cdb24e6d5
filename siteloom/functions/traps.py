"""Crawl traps: what of a URL can run on without end, and the limits on it.

``Traits`` holds what a URL says about paging, calendars and variants, read once. Limits are rows of a table,
each with what it measures; a URL is a trap if it exceeds one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from functools import cached_property
from typing import NamedTuple

from siteloom.functions.rules import DEFAULT, UrlRules
from siteloom.functions.urls import Url

#: Names of parameters and words of paths that page through listings and calendars.
PAGE_PARAMS = frozenset("page paged pg pagenum page_num pageno page_no pagenumber currentpage current_page pn pagenr".split())
OFFSET_PARAMS = frozenset("offset skip startindex start_index".split())
DATE_PARAMS = frozenset(
    "date start_date end_date startdate enddate eventdate event_date tribe-bar-date cal_date calendar_date ym yearmonth year_month dt day".split()
)
YEAR_PARAMS = frozenset(("year", "yr"))
CALENDAR_PARAMS = frozenset("month mo week cal calendar cal_month calmonth".split())
CALENDAR_WORDS = frozenset("archive archives calendar events event schedule timeline year cal".split())
LARGEST = 10**9
#: Centuries whose years a calendar may show, and months and days of dates in paths.
CENTURIES = ("19", "20", "21")
MONTHS, DAYS = range(1, 13), range(1, 32)


class Paging(NamedTuple):
    number: int
    listing: str


def _number(text: str) -> int | None:
    """A number of ASCII digits; those of more than nine digits are all the same."""
    digits = text.strip()
    return min(int(digits[:10]), LARGEST) if digits.isascii() and digits.isdigit() else None


def _is_year(text: str) -> bool:
    return len(text) == 4 and text.isdecimal() and text[:2] in CENTURIES


def _within(text: str, allowed: range) -> bool:
    return 0 < len(text) < 3 and text.isascii() and text.isdigit() and int(text) in allowed


def _years_inside(text: str) -> Iterator[int]:
    """Years that begin a run of digits: alone, or with a month, or month and day, after them."""
    for run in re.findall(r"\d+", text):
        if len(run) in (4, 6, 8) and _is_year(run[:4]):
            yield int(run[:4])


@dataclass(frozen=True)
class Traits:
    """What a normalised URL says about its place in listings, calendars and query variants."""

    url: Url

    @cached_property
    def segments(self) -> list[str]:
        return self.url.decoded_segments

    @cached_property
    def lower_params(self) -> list[tuple[str, str]]:
        return [(name.lower(), value) for name, value in self.url.params]

    def _page_segment(self) -> tuple[int, int, int] | None:
        """Page number in the path, with the segments that write it."""
        followed = [*self.segments[1:], ""]
        for at, (segment, after) in enumerate(zip(self.segments, followed)):
            word = segment.lower()
            if not word.startswith("page"):
                continue
            own = word.removeprefix("page").removeprefix("-" if word[4:5] == "-" else "_")
            if own and len(own) < 10 and own.isdecimal():
                return int(own), at, at + 1
            number = _number(after) if word == "page" else None
            if number is not None:
                return number, at, at + 2
        return None

    @cached_property
    def paging(self) -> Paging | None:
        """Page number and listing of ``?page=N``, ``/page/N`` and ``/page-N``; the path's goes first."""
        in_path = self._page_segment()
        numbers = (_number(v) for k, v in self.lower_params if k in PAGE_PARAMS)
        number = in_path[0] if in_path else next((n for n in numbers if n is not None), None)
        if number is None:
            return None
        _, cut, rest = in_path or (0, len(self.segments), len(self.segments))
        query = sorted(f"{k}={v}" for k, v in self.url.params if k.lower() not in PAGE_PARAMS)
        return Paging(number, f"{self.url.host}/{'/'.join(self.segments[:cut] + self.segments[rest:])}?{'&'.join(query)}")

    @cached_property
    def offset(self) -> int | None:
        """The first numeric offset parameter."""
        numbers = (_number(v) for k, v in self.lower_params if k in OFFSET_PARAMS)
        return next((n for n in numbers if n is not None), None)

    def _path_years(self) -> Iterator[int]:
        """The year of a date that ends the path, in one piece or in several, or that follows the word of a calendar."""
        pieces = "/".join(self.segments).split("/")
        for k in (1, 2, 3):
            year, *rest = "-".join(pieces[-k:]).split("-")
            if _is_year(year) and len(rest) in (1, 2) and all(map(_within, rest, (MONTHS, DAYS))):
                yield int(year)
                return
        if len(self.segments) > 1 and self.segments[-2].lower() in CALENDAR_WORDS and _is_year(self.segments[-1]):
            yield int(self.segments[-1])

    def _param_years(self) -> Iterator[int]:
        for name, value in self.lower_params:
            if name in YEAR_PARAMS and _is_year(value.strip()):
                yield int(value.strip())
            elif name in DATE_PARAMS and name not in YEAR_PARAMS:
                yield from list(_years_inside(value))[:1]

    @cached_property
    def calendar_years(self) -> list[int] | None:
        """Years that a calendar or archive listing names; None for other URLs."""
        years = [*self._path_years(), *self._param_years()]
        named = any(s.lower() in ("calendar", "ical") for s in self.segments) or any(k in CALENDAR_PARAMS for k, _ in self.lower_params)
        return years if years or named else None

    @cached_property
    def signature(self) -> str:
        """Shape of a URL with every number masked."""
        query = sorted(f"{k}={_masked(v)}" for k, v in self.lower_params)
        return f"{self.url.host}/{_masked('/'.join(self.segments))}?{'&'.join(query)}"

    @cached_property
    def variant(self) -> tuple[str, str]:
        """Path and the parameters besides paging; the latter are empty where there are none."""
        return self.url.host + self.url.path, "&".join(f"{k}={v}" for k, v in self.url.params if k.lower() not in PAGE_PARAMS)


def _masked(text: str) -> str:
    return re.sub(r"\d+", "#", text)


def paging(n: Url) -> Paging | None:
    return Traits(n).paging


def signature(n: Url) -> str:
    return Traits(n).signature


def longest_cycle(segments: list[str]) -> int:
    """How often the run of one to three segments that repeats most comes in direct succession."""
    most = 1
    for size in (1, 2, 3):
        for start in range(len(segments) - size + 1):
            run, times = segments[start : start + size], 1
            while segments[start + times * size : start + (times + 1) * size] == run:
                times += 1
            most = max(most, times)
    return most


class Limit(NamedTuple):
    """A limit: the reason it gives, what it counts, how much is too much, and the words for it."""

    reason: str
    measured: Callable[[Traits], int | None]
    most: Callable[[UrlRules], int]
    unit: str


LIMITS = (
    Limit("trap_depth", lambda t: len(t.segments), lambda r: r.max_path_depth, "segments"),
    Limit("trap_repeated_segments", lambda t: longest_cycle(t.segments), lambda r: r.max_segment_repeats - 1, "repeats"),
    Limit("trap_query_params", lambda t: len(t.url.params), lambda r: r.max_query_params, "parameters"),
    Limit("trap_pagination", lambda t: t.paging and t.paging.number, lambda r: r.max_page_number, "pages"),
    Limit("trap_pagination", lambda t: t.offset, lambda r: r.max_offset, "rows skipped"),
)


def trap_of(n: Url | Traits, rules: UrlRules = DEFAULT, as_of: date | None = None) -> tuple[str, str] | None:
    """Reason and detail of the first limit that a URL exceeds. ``as_of`` sets the years of calendars."""
    traits = n if isinstance(n, Traits) else Traits(n)
    for limit in LIMITS:
        measured, most = limit.measured(traits), limit.most(rules)
        if measured is not None and measured > most:
            return limit.reason, f"{measured} {limit.unit}, at most {most}"
    if as_of is None:
        return None
    shown = range(as_of.year - rules.calendar_years_back, as_of.year + rules.calendar_years_ahead + 1)
    beyond = next((y for y in traits.calendar_years or () if y not in shown), None)
    return None if beyond is None else ("trap_calendar", f"{beyond}, shown are {shown[0]} to {shown[-1]}")
