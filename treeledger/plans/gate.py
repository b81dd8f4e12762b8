"""The gate as one plan: both revisions are measured alike, functions matched, and only violations come out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.operators import clones
from treeledger.operators import gate as rules
from treeledger.operators import similarity
from treeledger.plans import measure


def measured(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions with id, arity and sequence, and file measures, of one revision."""
    parsed = measure.parse(files).persist()
    fns = measure.functions(parsed).join(measure.sequences(parsed), ["file", "node"])
    named = fns.withColumn("id", F.concat_ws("#", "file", F.col("node").cast("string"))).withColumnRenamed("parameters", "arity")
    return named.persist(), measure.file_metrics(parsed)


def grouped_matches(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """base_id, head_id: one-to-one matches inside each group of keys; where a group holds more than two, by similarity."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.where(F.col("name").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("id", "sequence"))).alias(name))

    both = side(base, "b").join(side(head, "h"), keys)

    def run(frames):
        for frame in frames:
            out = []
            for b, h in zip(frame["b"], frame["h"], strict=True):
                if len(b) == len(h) == 1:
                    out.append((b[0]["id"], h[0]["id"]))
                    continue
                rows = [(x["id"], y["id"], 100 * similarity.lcs_length(x["sequence"], y["sequence"]) // max(len(x["sequence"]), len(y["sequence"]), 1)) for x in b for y in h]
                out += similarity.best_matching(rows)
            yield pd.DataFrame(out, columns=["base_id", "head_id"])

    return both.select("b", "h").mapInPandas(run, "base_id string, head_id string")


def match_functions(base: DataFrame, head: DataFrame, options: rules.GateOptions) -> DataFrame:
    """base_id, head_id: by name and arity in a file, then by name, then by similarity over the change set."""
    found = grouped_matches(base, head, ["file", "name", "arity"])
    for keys in (["file", "name"],):
        more = grouped_matches(rules.unmatched(base, found, "base_id"), rules.unmatched(head, found, "head_id"), keys)
        found = found.unionByName(more)
    rest_b, rest_h = rules.unmatched(base, found, "base_id"), rules.unmatched(head, found, "head_id")
    if rest_b.count() * rest_h.count() > options.most_comparisons:
        return found
    one = lambda r: r.select("id", F.lit(0).alias("bucket"), "sequence")
    near = similarity.similar_pairs(one(rest_b), one(rest_h), options.similarity_percent).withColumn("bucket", F.lit(0))
    return found.unionByName(similarity.match_groups(near).select(F.col("a").alias("base_id"), F.col("b").alias("head_id")))


METRICS = ("cognitive", "ncss", "nesting", "dep_degree", "volume")


def evaluate(base_files: DataFrame, head_files: DataFrame, options: rules.GateOptions = rules.GateOptions(), projects: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Violations: gate, metric, file, function, start_line, base_value, head_value, allowed, ordered by file and line.

    ``projects`` are both whole revisions, in which duplication is looked for, where the files are only those of a change set.
    """
    base, base_metrics = measured(base_files)
    head, head_metrics = measured(head_files)
    matches = match_functions(base, head, options).persist()
    b = base.select(F.col("id").alias("base_id"), *[F.col(c).alias(f"base_{c}") for c in METRICS])
    h = head.select(F.col("id").alias("head_id"), "file", F.coalesce("name", F.lit("<anonymous>")).alias("function"), "start_line", *[F.col(c).alias(f"head_{c}") for c in METRICS])
    keys = ["file", "function", "start_line"]
    worse = rules.ratchet_violations(matches.join(b, "base_id").join(h, "head_id"), rules.ratchets(options.tolerance), keys).withColumn("gate", F.lit("function-regression"))
    limits = options.limits
    fresh = h.join(matches, "head_id", "left_anti")
    new = rules.limit_violations(fresh, [("cognitive complexity", "head_cognitive", limits.cognitive), ("NCSS", "head_ncss", limits.ncss), ("max nesting depth", "head_nesting", limits.nesting)], keys)
    new = new.withColumn("gate", F.lit("new-function")).withColumn("base_value", F.lit(None).cast("double"))
    removed = rules.unmatched(base, matches, "base_id").where(F.col("name").isNotNull())
    added = rules.unmatched(head, matches, "head_id")
    pair = lambda r: r.select("id", F.col("file").alias("bucket"), "sequence")
    split = similarity.similar_pairs(pair(removed), pair(added), options.split_percent).join(removed.select(F.col("id").alias("a"), "file"), "a").select("file").distinct().withColumn("split", F.lit(True))
    of = lambda m, s: m.select("file", F.col("max_cognitive").alias(f"{s}_max_cognitive"), F.col("ncss").alias(f"{s}_ncss"))
    files = of(base_metrics, "base").join(of(head_metrics, "head"), "file").join(split, "file")
    reported = worse.unionByName(new).where("metric = 'cognitive complexity'").select("file", "head_value")
    back = rules.file_backstops(files, reported, options.tolerance).select("*", F.lit("file-regression").alias("gate"), F.lit(None).cast("string").alias("function"), F.lit(1).alias("start_line"))
    more = duplication_violations(*(projects or (base_files, head_files)), options)
    columns = ["gate", "metric", "file", "function", "start_line", "base_value", "head_value", "allowed"]
    return worse.select(columns).unionByName(new.select(columns)).unionByName(back.select(columns)).unionByName(more.select(columns)).orderBy("file", "start_line", "metric")


def duplicated_lines(files: DataFrame) -> DataFrame:
    """file, lines: distinct lines of each file in blocks that another file has too."""
    regions = clones.cross_file(clones.blocks(files.withColumn("file", F.col("file").cast("string"))))
    return clones.covered_lines(regions).groupBy("file").agg(F.count("*").alias("lines"))


def duplication_violations(base_files: DataFrame, head_files: DataFrame, options: rules.GateOptions) -> DataFrame:
    """Files with more duplicated lines than in the base. Both revisions are whole projects, so copies of old code count."""
    base, head = duplicated_lines(base_files).toDF("file", "base"), duplicated_lines(head_files).toDF("file", "head")
    rows = head.join(base, "file", "left").select("file", F.coalesce("base", F.lit(0)).cast("double").alias("base_value"), F.col("head").cast("double").alias("head_value"))
    over = rows.withColumn("allowed", F.col("base_value") + float(options.tolerance.duplicate_lines)).where("head_value > allowed")
    said = {"gate": F.lit("duplication"), "metric": F.lit("duplicated lines"), "function": F.lit(None).cast("string"), "start_line": F.lit(1)}
    return over.withColumns(said)


def exit_code(violations: int, errors: int) -> int:
    """0 for a pass, 1 for violations, 2 for files that couldn't be measured."""
    return 2 if errors else int(violations > 0)
