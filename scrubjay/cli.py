"""Command line: inspect, scrub, text."""

from __future__ import annotations

import argparse
import sys

from .functions.text import Options, changed, clean
from .kernels.base import Policy
from .operators import findings, report

RESEAL_BLOCKED = "resealing is disabled: signing a scrubbed copy needs an identity that vouches for it"


def parser() -> argparse.ArgumentParser:
    main_parser = argparse.ArgumentParser(prog="scrubjay", description="Remove identifying metadata from your own files, and invisible characters from text. Files with Content Credentials are refused, never stripped.")
    verbs = main_parser.add_subparsers(dest="verb", required=True)
    for name in ("inspect", "scrub"):
        p = verbs.add_parser(name)
        p.add_argument("paths", nargs="+")
        for flags, help_ in ((("-r", "--recursive"), "look into folders"), (("--json",), "machine-readable report"), (("--strip-dates",), "dates as well"), (("--strip-revisions",), "anonymise authors of changes")):
            p.add_argument(*flags, action="store_true", help=help_)
        if name == "scrub":
            where = p.add_mutually_exclusive_group()
            where.add_argument("-o", "--output", metavar="DIR")
            where.add_argument("--in-place", action="store_true")
            p.add_argument("--reseal", action="store_true", help=argparse.SUPPRESS)
    p = verbs.add_parser("text")
    p.add_argument("paths", nargs="*")
    for flag in ("--in-place", "--report", "--keep-bidi", "--ascii-punct", "--strip-bom"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--normalize", choices=["nfc", "nfd", "nfkc", "nfkd"])
    p.add_argument("--encoding", default="utf-8")
    return main_parser


def run_files(spark, args) -> int:
    from .plans import run

    if getattr(args, "reseal", False):
        print(RESEAL_BLOCKED, file=sys.stderr)
        return 2
    policy = Policy(args.strip_dates, args.strip_revisions)
    rows = run.inspect(spark, args.paths, policy, args.recursive) if args.verb == "inspect" else run.scrub(spark, args.paths, policy, args.recursive, args.in_place, args.output)
    rows = rows.cache()
    print(run.report_json(rows) if args.json else run.report_text(rows))
    return report.footer(rows).first().exit_code


def run_text(spark, args) -> int:
    from .sources.files import atomic_write, read

    options = Options(args.keep_bidi, args.ascii_punct, args.normalize, args.strip_bom)
    names = [p for p in args.paths if p != "-"]
    status, rows = 0, []
    for k, name in enumerate(names or ["<stdin>"]):
        raw = read(name) if names else sys.stdin.buffer.read()
        try:
            rows.append((k, name, raw.decode(args.encoding)))
        except UnicodeDecodeError as exc:
            print(f"scrubjay: {name}: not valid {args.encoding} ({exc}); use --encoding to override", file=sys.stderr)
            status = 1
    if not rows:
        return status
    from pyspark.sql import functions as F

    texts = spark.createDataFrame(rows, "k long, name string, text string")
    done = texts.select("k", "name", "text", clean("text", options).alias("out")).withColumn("changed", changed(F.col("text"), F.col("out"))).orderBy("k").collect()
    listed = {r.k: r for r in findings.listing(findings.findings(texts, "k", "text", options), "k").collect()} if args.report else {}
    for row in done:
        data = row.out.encode(args.encoding)
        if args.in_place and names:
            if row.changed:
                atomic_write(row.name, data, row.name)
        else:
            sys.stdout.buffer.write(data)
        if args.report:
            found = listed.get(row.k)
            print(f"{row.name}: {found.changes} change(s)" if found else f"{row.name}: nothing to change", *([f"  {line}" for line in found.lines] if found else []), sep="\n", file=sys.stderr)
    return status


def main(argv: list[str] | None = None) -> int:
    from .session import local_session

    args = parser().parse_args(argv)
    spark = local_session()
    return run_text(spark, args) if args.verb == "text" else run_files(spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
