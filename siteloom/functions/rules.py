"""Settings that decide which URLs are crawled, and the reasons why one is not."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

#: Codes of rejected URLs.
REASONS = (
    "empty too_long invalid_url unsupported_scheme credentials_in_url invalid_host invalid_port port_not_allowed public_suffix "
    "ssrf_blocked blocked_domain out_of_scope subdomain_not_relevant non_html_extension content_type_not_eligible content_too_large "
    "trap_depth trap_repeated_segments trap_query_params trap_pagination trap_calendar trap_query_variants duplicate"
).split()


class Rejected(ValueError):
    """A URL that can't be used, with the code of the reason."""

    def __init__(self, reason: str, detail: str = "") -> None:
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason, self.detail = reason, detail


@dataclass(frozen=True)
class UrlRules:
    """All settings of normalising, scope, safety, traps, canonical links and duplicates."""

    max_url_length: int = 2048
    allowed_ports: frozenset[int] | None = frozenset({80, 443})
    strip_tracking_params: bool = True
    extra_tracking_params: frozenset[str] = frozenset()
    sort_query: bool = True
    trailing_slash: str = "strip"
    collapse_slashes: bool = True
    subdomain_mode: str = "relevant"
    extra_relevant_labels: frozenset[str] = frozenset()
    extra_blocked_labels: frozenset[str] = frozenset()
    scope_domains: frozenset[str] = frozenset()
    blocked_domains: frozenset[str] = frozenset()
    extra_public_suffixes: frozenset[str] = frozenset()
    allow_pdf: bool = False
    allow_plain_text: bool = False
    allow_missing_content_type: bool = True
    max_content_length: int = 10 << 20
    ssrf_allow_private_networks: bool = False
    block_single_label_hosts: bool = True
    max_path_depth: int = 12
    max_segment_repeats: int = 3
    max_query_params: int = 12
    max_page_number: int = 50
    max_offset: int = 2500
    max_query_variants_per_path: int = 30
    max_calendar_urls_per_pattern: int = 40
    calendar_years_back: int = 5
    calendar_years_ahead: int = 1
    canonical_allow_cross_domain: bool = False
    canonical_ignore_root: bool = True
    dedupe_ignore_scheme: bool = True
    dedupe_ignore_www: bool = True
    dedupe_strip_index_documents: bool = True

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name.startswith("max_") and getattr(self, f.name) < (2 if f.name == "max_segment_repeats" else 1):
                raise ValueError(f"{f.name} is too small")
        if min(self.calendar_years_back, self.calendar_years_ahead) < 0:
            raise ValueError("years of the calendar window can't be negative")
        if self.subdomain_mode not in ("exact", "www", "relevant", "all"):
            raise ValueError(f"subdomain_mode: {self.subdomain_mode}")
        if self.trailing_slash not in ("strip", "keep"):
            raise ValueError(f"trailing_slash: {self.trailing_slash}")

    def with_changes(self, **changes: object) -> UrlRules:
        return replace(self, **changes)

    @classmethod
    def from_environment(cls, prefix: str = "APP_URL_", environ: dict[str, str] | None = None) -> UrlRules:
        """Rules with those settings replaced that the environment names, such as ``APP_URL_MAX_PATH_DEPTH``."""
        environ = dict(os.environ) if environ is None else environ
        short = {"max_url_length": "MAX_LENGTH"}
        changes: dict[str, object] = {}
        for f in fields(cls):
            value = environ.get(prefix + short.get(f.name, f.name.upper()))
            if value is None:
                continue
            default = f.default
            if f.name == "allowed_ports":
                changes[f.name] = ports(value)
            elif isinstance(default, frozenset):
                changes[f.name] = csv_set(value)
            elif isinstance(default, bool):
                changes[f.name] = value.strip().lower() in ("1", "true", "yes", "on")
            else:
                changes[f.name] = type(default)(value)
        return cls(**changes)


def csv_set(value: str | None) -> frozenset[str]:
    """Lower-case, trimmed, non-empty entries of a comma-separated list."""
    return frozenset(x for x in (p.strip().lower() for p in (value or "").split(",")) if x)


def ports(value: str | None) -> frozenset[int] | None:
    """Ports of a comma-separated list; None (any port) for an empty list."""
    found = frozenset(int(p) for p in csv_set(value))
    if any(not 1 <= p <= 65535 for p in found):
        raise ValueError(f"not a port list: {value}")
    return found or None


DEFAULT = UrlRules()
#: Websites of businesses may use any port.
WEBSITE = UrlRules(allowed_ports=None)
