"""Changes and texts of a git repository, read on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_OUTPUT = 512 * 1024 * 1024
CHANGES = "status string, base_path string, head_path string"


def run_git(folder: str, *args: str) -> str:
    said = subprocess.run(["git", *args], cwd=folder, capture_output=True, check=False)
    if said.returncode:
        raise RuntimeError(said.stderr.decode(errors="replace").strip())
    if len(said.stdout) > MOST_OUTPUT:
        raise RuntimeError("git put out too much")
    return said.stdout.decode(errors="replace")


def repo_root(folder: str) -> str:
    return run_git(folder, "rev-parse", "--show-toplevel").strip()


def merge_base(folder: str, ref: str) -> str:
    return run_git(folder, "merge-base", ref, "HEAD").strip()


# What the letters of git's name-status mean to us; others are left out.
STATUS = {"A": "added", "C": "added", "M": "modified", "T": "modified", "D": "deleted", "R": "renamed"}


def parse_name_status(said: str) -> list[tuple[str, str | None, str | None]]:
    """(status, base path, head path) of NUL-separated entries. A copy is an addition."""
    parts, out = iter(said.split("\0")), []
    for letter in parts:
        if not letter:
            continue
        first = next(parts, None)
        second = next(parts, None) if letter[0] in "RC" else None
        kind = STATUS.get(letter[0])
        if kind == "renamed":
            out.append((kind, first, second))
        elif kind == "added":
            out.append((kind, None, second or first))
        elif kind == "modified":
            out.append((kind, first, first))
        elif kind == "deleted":
            out.append((kind, first, None))
    return out


def status_kind(letter: Column) -> Column:
    """The same meaning of a letter as an expression."""
    by = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return F.try_element_at(by, F.substring(letter, 1, 1))


def changed_files(spark: SparkSession, folder: str, base: str) -> DataFrame:
    """Changes since the base, and untracked files as additions."""
    rows = parse_name_status(run_git(folder, "diff", "--name-status", "-z", "-M", base))
    new = [("added", None, p) for p in run_git(folder, "ls-files", "-o", "--exclude-standard", "-z").split("\0") if p]
    return spark.createDataFrame([*rows, *new], CHANGES)


def repository_files(spark: SparkSession, folder: str) -> DataFrame:
    """Tracked and untracked files without those deleted in the work tree."""
    rows = lambda *a: spark.createDataFrame([(p,) for p in run_git(folder, "ls-files", "-z", *a).split("\0") if p], "file string")
    return rows().union(rows("-o", "--exclude-standard")).distinct().subtract(rows("-d"))


def text_at(folder: str, revision: str, path: str) -> str:
    return run_git(folder, "show", f"{revision}:{path}")


def paths_at(folder: str, revision: str) -> list[str]:
    """Paths of the plain files of a revision, without symbolic links and submodules."""
    rows = run_git(folder, "ls-tree", "-r", "-z", "--full-tree", revision).split("\0")
    return [row.split("\t", 1)[1] for row in rows if row.startswith("100")]


def links_at(folder: str, revision: str) -> set[str]:
    """Paths that are symbolic links at a revision."""
    return {row.split("\t", 1)[1] for row in run_git(folder, "ls-tree", "-r", "-z", revision).split("\0") if row.startswith("120000")}
