"""Measures of source files: parse each file once, then aggregate.

``parse`` is the only Python step. It gives a row per file with its line classes and, for languages with a
full frontend, syntax facts and leaves; a file that can't be parsed becomes an issue, not a failure.
Functions take in what lies in their subtree by an interval join within the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.frontends import comments, python
from treeledger.frontends import leaves as token_scan
from treeledger.functions.measures import halstead
from treeledger.sources.scan import resolve_language

#: Open nodes of a file beyond which it is refused.
MAX_DEPTH = 5000
FACT = "node:int,last:int,kind:string,nest:int,inner:int,bonus:int,sens:int,flat:int,ncss:int,is_fn:boolean,frame:int,name:string,start_line:int,start_col:int,end_line:int,end_col:int,parameters:int,dep_degree:int,sequence:array<int>"
LEAF = "operand:boolean,text:string,line:int,col:int"
PARSED = f"file string, language string, bytes bigint, lines array<string>, facts array<struct<{FACT}>>, leaves array<struct<{LEAF}>>, issue string"
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def _struct(ddl: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, _ARROW[t]) for n, t in (c.split(":") for c in ddl.split(","))]))


def measure_text(code: str, language: str) -> dict:
    """One file's line classes, facts and leaves."""
    out = {"lines": comments.classify(code, language), "facts": [], "leaves": [], "issue": None}
    if language == "python":
        try:
            out["facts"] = [asdict(f) for f in python.facts(code)]
            out["leaves"] = [dict(zip(("operand", "text", "line", "col"), x, strict=True)) for x in python.leaves(code)]
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            out |= {"facts": [], "leaves": [], "issue": f"{type(e).__name__}: {e}"}
    else:
        out["leaves"] = [dict(zip(("operand", "text", "line", "col"), x, strict=True)) for x in token_scan.leaves(code, language)]
    return out


def parse(files: DataFrame) -> DataFrame:
    """A row per file with all that its frontend found; from file, language, code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, language, code in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    known = resolve_language(language or "")
                    row = measure_text(code or "", known)
                except ValueError as e:
                    known, row = language, {"lines": [], "facts": [], "leaves": [], "issue": str(e)}
                rows.append(row | {"file": file, "language": known, "bytes": len((code or "").encode())})
            columns = {
                "file": pa.string(), "language": pa.string(), "bytes": pa.int64(), "lines": pa.list_(pa.string()), "facts": _struct(FACT), "leaves": _struct(LEAF), "issue": pa.string(),
            }
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in columns.items()], list(columns))

    return files.select(F.col("file").cast("string").alias("file"), "language", "code").mapInArrow(run, PARSED)


def nodes(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.explode("facts").alias("n")).select("file", "n.*")


def functions(parsed: DataFrame) -> DataFrame:
    """A row per function: cognitive, nesting and ncss by closed forms over its subtree, and Halstead measures of its leaves."""
    every = nodes(parsed)
    f = every.where("is_fn").select("file", *[F.col(c).alias(f"f_{c}") for c in ("node", "last", "inner", "bonus", "ncss", "kind", "name", "start_line", "start_col", "end_line", "end_col", "parameters", "dep_degree")])
    met = f.join(every, "file").where((F.col("node") >= F.col("f_node")) & (F.col("node") <= F.col("f_last")))
    strict = F.col("node") > F.col("f_node")
    weight = F.col("flat") + F.col("sens") * (1 + F.col("nest") + F.col("bonus") - F.col("f_inner") - F.col("f_bonus"))
    own = strict & (F.col("frame") == F.col("f_node")) & ~F.col("is_fn")
    at = ["file", "f_node", "f_kind", "f_name", "f_start_line", "f_start_col", "f_end_line", "f_end_col", "f_parameters", "f_dep_degree"]
    body = met.groupBy(*at).agg(
        F.coalesce(F.sum(F.when(strict, weight)), F.lit(0)).alias("cognitive"),
        F.coalesce(F.greatest(F.lit(0), F.max(F.when(own, F.col("inner") - F.col("f_inner")))), F.lit(0)).alias("nesting"),
        (F.sum("ncss") + F.max(F.when(~strict & (F.col("f_ncss") == 0), 1).otherwise(0))).alias("ncss"),
    )
    leaf = parsed.select("file", F.explode("leaves").alias("l")).select("file", "l.*")
    place = F.struct(F.col("line"), F.col("col"))
    held = f.join(leaf, "file").where((place >= F.struct(F.col("f_start_line").alias("line"), F.col("f_start_col").alias("col"))) & (place < F.struct(F.col("f_end_line").alias("line"), F.col("f_end_col").alias("col"))))
    counted = body.join(_counts(held, ["file", "f_node"]), ["file", "f_node"], "left").na.fill(0)
    h = halstead(*[F.col(c) for c in ("n1", "n2", "total1", "total2")])
    renamed = [F.col(c).alias(c[2:]) for c in at[1:]]
    return counted.select("file", *renamed, "cognitive", "nesting", "ncss", "n1", "n2", "total1", "total2", *[e.alias(k) for k, e in h.items()])


def sequences(parsed: DataFrame) -> DataFrame:
    """file, node, sequence: the normalised token sequence of each function."""
    return nodes(parsed).where("is_fn").select("file", "node", "sequence")


def _counts(leaf: DataFrame, keys: list[str]) -> DataFrame:
    each = leaf.groupBy(*keys, "operand", "text").agg(F.count("*").alias("n"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy(*keys).agg(F.count_if(~F.col("operand")).alias("n1"), F.count_if("operand").alias("n2"), total(~F.col("operand")).alias("total1"), total(F.col("operand")).alias("total2"))


def file_metrics(parsed: DataFrame) -> DataFrame:
    """A row per file: lines by class, functions, cognitive complexity, nesting, statements and Halstead measures."""
    of = lambda kind: F.size(F.filter("lines", lambda x: x == kind)).cast("bigint")
    sums = lambda e: F.aggregate("facts", F.lit(0).cast("bigint"), e)
    base = parsed.select(
        "file", "language", "bytes", "issue",
        F.size("lines").cast("bigint").alias("total"), of("code").alias("code"), of("comment").alias("comment"), of("blank").alias("blank"),
        sums(lambda s, n: s + n["flat"] + n["sens"] * (1 + n["nest"] + n["bonus"])).alias("cognitive"),
        sums(lambda s, n: F.greatest(s, n["inner"].cast("bigint"))).alias("nesting"),
        sums(lambda s, n: s + n["ncss"]).alias("ncss"),
        F.size(F.filter("facts", lambda n: n["is_fn"])).cast("bigint").alias("n_functions"),
    )
    leaf = parsed.select("file", F.explode("leaves").alias("l")).select("file", "l.*")
    worst = functions(parsed).groupBy("file").agg(F.max("cognitive").alias("max_cognitive"))
    h = halstead(*[F.coalesce(F.col(c), F.lit(0)) for c in ("n1", "n2", "total1", "total2")])
    whole = base.join(_counts(leaf, ["file"]), "file", "left").join(worst, "file", "left").na.fill(0, ["n1", "n2", "total1", "total2", "max_cognitive"])
    return whole.select("*", *[e.alias(k) for k, e in h.items()])


def issues(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("issue").isNotNull()).select(F.lit("error").alias("severity"), "file", F.col("issue").alias("message"))
