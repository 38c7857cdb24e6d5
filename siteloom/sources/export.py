"""Writing leads: one JSON or CSV file, or many files for bulk use."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from siteloom import schemas
from siteloom.operators.leads import ADDRESS_PARTS, complete

#: Version of the JSON document, mark between values of a CSV cell.
VERSION, SEPARATOR = 1, "|"
CSV_COLUMNS = (
    "business_name", "website", "domain", "description", "emails", "phones", *(f"address_{p}" for p in ADDRESS_PARTS),
    "social_profiles", "page_type", "language", "source_url", "first_seen", "last_seen",
)
JSON_KEYS = (
    "business_name website domain description emails phones address social_profiles page_type language source_url first_seen last_seen".split()
)


class ExportError(ValueError):
    """Leads that can't be written in the wanted form."""


def check_format(kind: str, excel_bom: bool = False) -> str:
    kind = (kind or "").strip().lower()
    if kind not in ("json", "csv"):
        raise ExportError(f"unknown export format {kind!r} (valid: json, csv)")
    if excel_bom and kind != "csv":
        raise ExportError("a byte order mark belongs to CSV only")
    return kind


def _plain(value: object) -> object:
    if isinstance(value, datetime):
        return (value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)).isoformat()
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _rows(leads: DataFrame, preserve_order: bool) -> Iterator[dict[str, object]]:
    """Leads as plain values, a partition at a time; two of one domain are an error."""
    held = complete(leads)
    twice = held.groupBy("domain").count().filter("count > 1").first()
    if twice:
        raise ExportError(f"two leads have the identity {twice['domain']}")
    ordered = held.select(*schemas.LEAD_COLUMNS)
    ordered = ordered if preserve_order else ordered.orderBy("domain")
    for row in ordered.toLocalIterator(prefetchPartitions=True):
        yield {k: _plain(row[k]) for k in JSON_KEYS}


def _json_parts(leads: DataFrame, preserve_order: bool) -> Iterator[str]:
    """The parts of a JSON document, a lead each, so that no more than one is held."""
    head = json.dumps({"version": VERSION, "count": leads.count(), "leads": []}, ensure_ascii=False, indent=2)
    opening, closing = head[: -len("]\n}")], "\n  ]\n}\n"
    first = True
    for lead in _rows(leads, preserve_order):
        text = json.dumps(lead, ensure_ascii=False, indent=2).replace("\n", "\n    ")
        yield f"{opening if first else ','}\n    {text}"
        first = False
    yield head + "\n" if first else closing


def _csv_parts(leads: DataFrame, preserve_order: bool) -> Iterator[str]:
    text = io.StringIO(newline="")
    writer = csv.writer(text, lineterminator="\r\n")

    def line(cells: Iterable[object]) -> str:
        writer.writerow(cells)
        made = text.getvalue()
        text.seek(0)
        text.truncate()
        return made

    yield line(CSV_COLUMNS)
    for lead in _rows(leads, preserve_order):
        yield line(_cells(lead))


def parts(leads: DataFrame, kind: str, *, excel_bom: bool = False, preserve_order: bool = False) -> Iterator[str]:
    """A document of all leads in parts, by domain unless their order is kept."""
    if check_format(kind, excel_bom) == "json":
        yield from _json_parts(leads, preserve_order)
    else:
        yield "\ufeff" if excel_bom else ""
        yield from _csv_parts(leads, preserve_order)


def to_json(leads: DataFrame, *, preserve_order: bool = False) -> str:
    """A JSON document of leads that fit into memory; ``write`` needs no more than one of them at a time."""
    return "".join(_json_parts(leads, preserve_order))


def _joined(values: list[str], name: str) -> str:
    bad = next((v for v in values if SEPARATOR in v), None)
    if bad is not None:
        raise ExportError(f"{name} value {bad!r} contains the list separator {SEPARATOR!r}")
    return SEPARATOR.join(values)


def _cells(lead: dict[str, object]) -> list[object]:
    address = lead["address"] or {}
    flat = {
        **lead, **{f"address_{p}": address.get(p) for p in ADDRESS_PARTS}, "emails": _joined(lead["emails"], "emails"),
        "phones": _joined([p["number"] for p in lead["phones"]], "phones"),
        "social_profiles": _joined([s["url"] for s in lead["social_profiles"]], "social_profiles"),
    }
    return ["" if flat[c] is None else flat[c] for c in CSV_COLUMNS]


def to_csv(leads: DataFrame, *, preserve_order: bool = False) -> str:
    """Leads as CSV with a header; lines end in CR LF, cells are quoted where they must be."""
    return "".join(_csv_parts(leads, preserve_order))


def render(leads: DataFrame, kind: str, *, excel_bom: bool = False, preserve_order: bool = False) -> str:
    return "".join(parts(leads, kind, excel_bom=excel_bom, preserve_order=preserve_order))


def write(path: str | os.PathLike, leads: DataFrame, kind: str, *, excel_bom: bool = False, preserve_order: bool = False) -> Path:
    """Write one file whole or not at all, lead by lead: a failure leaves what was there."""
    target = Path(path)
    check_format(kind, excel_bom)
    handle, temporary = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as file:
            file.writelines(parts(leads, kind, excel_bom=excel_bom, preserve_order=preserve_order))
        os.replace(temporary, target)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise
    return target


def export_rows(leads: DataFrame) -> DataFrame:
    """The cells of a CSV export as columns, for bulk output by Spark."""
    rows = complete(leads)

    def joined(values: Column) -> Column:
        bad = F.exists(values, lambda v: v.contains(SEPARATOR))
        return F.when(bad, F.raise_error(F.lit("a value contains the list separator"))).otherwise(F.array_join(values, SEPARATOR))

    flat = {f"address_{p}": F.col(f"address.{p}") for p in ADDRESS_PARTS}
    flat |= {
        "emails": joined(F.col("emails")),
        "phones": joined(F.transform("phones", lambda p: p["number"])),
        "social_profiles": joined(F.transform("social_profiles", lambda s: s["url"])),
    }
    flat |= {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX") for c in ("first_seen", "last_seen")}
    return rows.select(*(F.coalesce(flat.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS))


def write_bulk(leads: DataFrame, path: str, kind: str = "json") -> None:
    """Write leads as many files in parallel; nulls are kept in JSON."""
    if check_format(kind) == "json":
        complete(leads).select(*JSON_KEYS).write.option("ignoreNullFields", "false").json(path)
    else:
        export_rows(leads).write.option("header", "true").csv(path)


def lead_json(leads: DataFrame, column: str = "json") -> DataFrame:
    """``leads`` with each lead as a JSON object of fixed keys, nulls included; no driver, no Python."""
    held = complete(leads).withColumn(column, F.to_json(F.struct(*JSON_KEYS), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}))
    return held.select(*leads.columns, column) if column not in leads.columns else held.select(*leads.columns)


def read_json(texts: DataFrame, column: str = "json", *, strict: bool = True) -> DataFrame:
    """Leads of a column of JSON objects.

    A text that is no object, or has unknown keys or no website, is an error if ``strict``, and left out
    otherwise. Null texts are left out.
    """
    text = F.col(column)
    unknown = F.array_except(F.json_object_keys(text), F.array(*(F.lit(k) for k in JSON_KEYS)))
    lead = F.from_json(text, schemas.LEAD)
    fault = F.when(unknown.isNull() | lead.isNull(), F.lit("not a JSON object")).when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", ")))
    fault = fault.when(F.coalesce(F.trim(lead["website"]), F.lit("")) == "", F.lit("website is required"))
    held = texts.filter(text.isNotNull()).select(lead.alias("_lead"), fault.alias("_fault"))
    kept = held.filter(F.when(F.col("_fault").isNotNull(), F.raise_error(F.col("_fault")).cast("boolean")).otherwise(True)) if strict else held.filter("_fault IS NULL")
    return kept.select("_lead.*")
