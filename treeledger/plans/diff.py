"""The gate on a git work tree: what changed since the merge base with a revision."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.operators.gate import GateOptions
from treeledger.plans import gate, measure
from treeledger.sources import git, scan

#: Languages whose functions are measured. A changed file of another language can't pass unseen.
STRUCTURED = ("python",)


def work_tree_files(spark: SparkSession, root: str, tests: bool = False) -> DataFrame:
    """file, language, code of the source files in the work tree, tracked or new; symbolic links are left out."""
    paths = git.repository_files(spark, root).where(scan.is_scanned(F.col("file"), tests))
    return scan.scan_files(spark, root, sorted(r.file for r in paths.collect() if not os.path.islink(os.path.join(root, r.file))))


def revision_files(spark: SparkSession, root: str, revision: str, tests: bool = False) -> DataFrame:
    """The same of a revision, under the names that renamed files have now."""
    paths = spark.createDataFrame([(p,) for p in git.paths_at(root, revision)], "file string").where(scan.is_scanned(F.col("file"), tests))
    rows = [(p, git.text_at(root, revision, p)) for p in sorted(r.file for r in paths.collect())]
    files = spark.createDataFrame(rows, "base_path string, code string")
    moved = git.changed_files(spark, root, revision).where("status = 'renamed'").select("base_path", "head_path")
    return files.join(moved, "base_path", "left").select(F.coalesce("head_path", "base_path").alias("file"), scan.language_of(F.col("base_path")).alias("language"), "code")


def unmeasured(changed: DataFrame) -> DataFrame:
    """file, message of changed files that no function was measured in for want of a grammar or because of an error."""
    failed = measure.issues(measure.parse(changed)).select("file", "message")
    foreign = changed.where(~F.col("language").isin(*STRUCTURED)).select("file", F.concat(F.lit("functions are not measured in "), "language").alias("message"))
    return failed.unionByName(foreign).distinct()


def compare(spark: SparkSession, folder: str, ref: str, options: GateOptions = GateOptions(), tests: bool = False) -> tuple[DataFrame, DataFrame]:
    """Violations, and changed files that couldn't be measured, since the merge base of ``ref`` and HEAD.

    Functions are measured in changed files alone; duplication is looked for in both whole revisions. No change gives no rows.
    """
    root = git.repo_root(folder)
    base_revision = git.merge_base(root, ref)
    base, head = revision_files(spark, root, base_revision, tests), work_tree_files(spark, root, tests)  # not persisted: a later call must see files anew
    changes = git.changed_files(spark, root, base_revision).select(F.coalesce("head_path", "base_path").alias("file")).distinct()
    old, new = (side.join(changes, "file", "left_semi").select("file", "language", "code") for side in (base, head))
    issues = unmeasured(old).unionByName(unmeasured(new)).distinct()
    return gate.evaluate(old, new, options, (base, head)), issues
