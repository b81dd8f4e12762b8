"""Reports of a ranking or a gate, from the few rows that are shown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN_ISSUES, SHOWN_PARTNERS = 10, 3


def summarize(metrics: DataFrame) -> dict:
    """files, functions, code lines, worst cognitive complexity and statements of a project."""
    said = [("files", F.count("*")), ("functions", F.sum("n_functions")), ("codeLines", F.sum("code")), ("maxCognitiveComplexity", F.max("max_cognitive")), ("ncss", F.sum("ncss"))]
    row = metrics.agg(*[F.coalesce(e, F.lit(0)).alias(n) for n, e in said]).first()
    return row.asDict()


def ranking_json(ranked: DataFrame, metrics: DataFrame, issues: DataFrame, top: int) -> str:
    """The ranking as one JSON object; ``ranked`` has at most ``top`` rows."""
    summary = summarize(metrics)
    rows = [json.loads(r) for r in ranked.toJSON().collect()]
    held = [r.asDict() for r in issues.collect()]
    of = lambda kind: [f"{i['file']}: {i['message']}" for i in held if i["severity"] == kind]
    return json.dumps({"summary": summary, "totalRankedFiles": summary["files"], "truncated": summary["files"] > top, "files": rows, "errors": of("error"), "warnings": of("warning")})


def ranking_text(report: dict) -> str:
    """The same for people."""
    s = report["summary"]
    out = [f"{s['files']} files, {s['functions']} functions, {s['codeLines']} code lines, NCSS {s['ncss']}, max cognitive complexity {s['maxCognitiveComplexity']}"]
    for n, f in enumerate(report["files"], 1):
        worst = f.get("worst_function") or {}
        out.append(f"{n}. {f['file']} (score {f['score']:.3f}): NCSS {f['ncss']}, duplicated lines {f['duplicated']}, worst function {worst.get('name', 'none')} ({worst.get('cognitive', 0)})")
        partners = f.get("partners") or []
        if partners:
            more = len(partners) - SHOWN_PARTNERS
            out.append("   shares code with " + ", ".join(partners[:SHOWN_PARTNERS]) + (f" and {more} more" if more > 0 else ""))
    for kind in ("warnings", "errors"):
        found = report[kind]
        out += [f"{kind[:-1]}: {x}" for x in found[:SHOWN_ISSUES]] + ([f"... and {len(found) - SHOWN_ISSUES} more {kind}"] if len(found) > SHOWN_ISSUES else [])
    return "\n".join(out)


def violation_lines(violations: DataFrame) -> list[str]:
    """A line for each violation, all of them."""
    rows = violations.collect()
    return [f"{r.file}:{r.start_line} {r.function or ''}: {r.metric} {'worsened ' + format(r.base_value, 'g') + ' -> ' if r.base_value is not None else ''}{r.head_value:g} (allowed <= {r.allowed:g})" for r in rows]
