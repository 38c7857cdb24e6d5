"""Command line: list, search and export leads of a stored table; the state of a crawl."""

from __future__ import annotations

import argparse
import json
import sys

from siteloom import __version__
from siteloom.operators import crawl, query
from siteloom.session import local_session
from siteloom.sources import export
from siteloom.sources.pages import stored_leads

_VALUES = ("domain", "language", "country", "city", "page_type")
_FLAGS = {"email": "has_email", "phone": "has_phone", "social-profile": "has_social_profile"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siteloom", description="Leads from web pages, on Spark.")
    top.add_argument("--version", action="version", version=__version__)
    kinds = top.add_subparsers(dest="command", required=True)
    for name in ("list", "search", "export"):
        p = kinds.add_parser(name, help=f"{name} stored leads")
        p.add_argument("table", help="folder of the lead table")
        p.add_argument("--sort-by", default="domain")
        p.add_argument("--desc", action="store_true")
        p.add_argument("--page", type=int)
        p.add_argument("--page-size", type=int)
        if name != "list":
            for value in _VALUES:
                p.add_argument(f"--{value.replace('_', '-')}", action="append")
            for flag, held in _FLAGS.items():
                p.add_argument(f"--has-{flag}", dest=held, action="store_true", default=None)
                p.add_argument(f"--no-{flag}", dest=held, action="store_false", default=None)
        if name == "export":
            p.add_argument("--format", default="json")
            p.add_argument("--output")
            p.add_argument("--excel-bom", action="store_true")
    state = kinds.add_parser("crawl-state", help="state of crawls")
    state.add_argument("crawls")
    state.add_argument("pages")
    state.add_argument("--crawl-id", type=int)
    state.add_argument("--json", action="store_true")
    return top


def _selection(args: argparse.Namespace) -> query.LeadQuery:
    held = {k: getattr(args, k, None) for k in (*_VALUES, *_FLAGS.values())}
    criteria = query.LeadFilter(**{k: v for k, v in held.items() if v is not None})
    return query.LeadQuery(criteria, args.sort_by, args.desc, args.page, args.page_size)


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: the work failed; 2: the arguments make no sense, told before any data is read."""
    args = parser().parse_args(argv)
    try:
        if args.command != "crawl-state":
            wanted = _selection(args)
            kind = export.check_format(args.format, args.excel_bom) if args.command == "export" else None
    except (query.QueryError, export.ExportError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    spark = local_session()
    try:
        if args.command == "crawl-state":
            report = crawl.state_report(spark.read.parquet(args.crawls), spark.read.parquet(args.pages))
            if args.crawl_id is not None:
                report = report.filter(report["crawl_id"] == args.crawl_id)
            for row in report.orderBy("crawl_id").toLocalIterator():
                print(json.dumps(row.asDict(), default=str) if args.json else "\n".join(f"{k}: {v}" for k, v in row.asDict().items()))
            return 0
        leads = stored_leads(spark, args.table)
        if args.command == "export":
            rows = wanted.plan(leads)
            if args.output:
                export.write(args.output, rows, kind, excel_bom=args.excel_bom, preserve_order=True)
            else:
                sys.stdout.writelines(export.parts(rows, kind, excel_bom=args.excel_bom, preserve_order=True))
            return 0
        page = wanted.run(leads)
        for line in query.listing_lines(page.rows):
            print(line)
        if wanted.paged:
            print(query.page_summary(page), file=sys.stderr)
        return 0
    except (OSError, export.ExportError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
