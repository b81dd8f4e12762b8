"""Command line: rank a folder, or gate a change set."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from treeledger.plans import diff, gate, report
from treeledger.plans.rank import rank_files
from treeledger.sources import config, scan


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be a positive integer")
    return n


def diff_main(argv: list[str]) -> int:
    """``diff BASE [FOLDER]``: 0 if nothing worsened, 1 for violations, 2 for changed files that weren't measured or settings that can't be used."""
    parser = argparse.ArgumentParser(prog="treeledger diff", description=diff_main.__doc__)
    parser.add_argument("base")
    parser.add_argument("target", nargs="?", default=".")
    parser.add_argument("--config")
    parser.add_argument("--include-tests", action="store_true", default=None)
    options = parser.parse_args(argv)
    spark = SparkSession.builder.appName("treeledger").getOrCreate()
    try:
        settings = config.load(options.config, options.target)
        tests = config.resolve({"includeTests": options.include_tests}, settings)["includeTests"]
        violations, unmeasured = diff.compare(spark, options.target, options.base, config.gate_options(settings), tests)
    except (config.ConfigError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 2
    lines, issues = report.violation_lines(violations), unmeasured.orderBy("file", "message").collect()
    for line in lines:
        print(line)
    for i in issues:
        print(f"{i.file}: {i.message}", file=sys.stderr)
    return gate.exit_code(len(lines), len(issues))


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["diff"]:
        return diff_main(argv[1:])
    parser = argparse.ArgumentParser(prog="treeledger", description=__doc__)
    parser.add_argument("target", nargs="?", default=".")
    parser.add_argument("--top", type=positive, default=10)
    parser.add_argument("--include-tests", action="store_true")
    parser.add_argument("--json", action="store_true")
    options = parser.parse_args(argv)
    spark = SparkSession.builder.appName("treeledger").getOrCreate()
    rows = rank_files(scan.scan_directory(spark, options.target, options.include_tests), options.top).toJSON().collect()
    if options.json:
        print(json.dumps([json.loads(r) for r in rows], indent=2))
    else:
        for n, row in enumerate(map(json.loads, rows), 1):
            worst = row.get("worst_function") or {}
            print(f"{n}. {row['file']}  score {row['score']:.3f}  NCSS {row['ncss']}  duplicated {row['duplicated']}  worst {worst.get('name', '-')} ({worst.get('cognitive', 0)})")
    return 0


if __name__ == "__main__":
    sys.exit(main())
