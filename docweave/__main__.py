"""Command line: python -m docweave (ingest | enrich | export | query | lint) WORKSPACE ..."""

from __future__ import annotations

import argparse
import os
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("docweave", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("ingest", help="files of a folder into the documents table")
    a.add_argument("workspace")
    a.add_argument("folder", nargs="+")
    a.add_argument("--include")
    a.add_argument("--exclude")
    a.add_argument("--limit", type=int)
    a.add_argument("--manifest", default="auto")
    a.add_argument("--html", choices=("default", "smart"), default="default")
    a.add_argument("--overwrite", action="store_true")
    a.add_argument("--fulltext", action="store_true")
    a = verbs.add_parser("enrich", help="run tasks of a configuration")
    a.add_argument("workspace")
    a.add_argument("config")
    a.add_argument("--enrichments")
    a.add_argument("--model")
    a.add_argument("--table")
    a.add_argument("--limit", type=int)
    a.add_argument("--where")
    a.add_argument("--sha1")
    a.add_argument("--overwrite", action="store_true")
    a.add_argument("--retry-failed", action="store_true")
    a.add_argument("--log-updates", action="store_true", help="also write the results as JSON lines below WORKSPACE/updates")
    a.add_argument("--cost-threshold", type=float, default=5.0)
    a.add_argument("--yes", action="store_true", help="go on above the threshold")
    a = verbs.add_parser("export", help="run exports of a configuration")
    a.add_argument("workspace")
    a.add_argument("config")
    a.add_argument("--exports")
    a = verbs.add_parser("query", help="show a query's rows")
    a.add_argument("workspace")
    a.add_argument("sql")
    a.add_argument("--config")
    a.add_argument("--rows", type=int, default=20, help="rows to show")
    a = verbs.add_parser("lint", help="problems of a configuration")
    a.add_argument("config")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from .sources.config import ConfigError, lint, load_config

    if args.verb == "lint":
        problems = lint(load_config(args.config))
        print("\n".join(problems) or "no problems")
        return int(bool(problems))
    from pyspark.sql import SparkSession

    from .plans import runner

    ws = runner.Workspace(SparkSession.builder.appName("docweave").getOrCreate(), args.workspace)
    try:
        if args.verb == "ingest":
            for folder in args.folder:
                print(folder, runner.ingest(ws, folder, include=args.include, exclude=args.exclude, limit=args.limit, manifest=args.manifest, html=args.html, overwrite=args.overwrite, fulltext=args.fulltext))
            return 0
        config = load_config(args.config) if args.config else None
        folder = os.path.dirname(os.path.abspath(args.config)) if args.config else "."
        if args.verb == "enrich":
            key = {"sha1": args.sha1} if args.sha1 else None
            done = runner.enrich(ws, config, args.enrichments, args.model, args.table, args.limit, args.overwrite, args.where, key, args.retry_failed, args.cost_threshold, (lambda _: True) if args.yes else None, folder=folder, log_updates=args.log_updates)
            for o in done:
                print(o)
            return int(any(o.stopped for o in done))
        if args.verb == "export":
            print(runner.export(ws, config, args.exports, folder))
        else:
            runner.query(ws, args.sql, config).show(args.rows, truncate=False)
    except (ConfigError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
