"""Which paths are source files, and reading them."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that are never read, and those read only with tests.
IGNORED = (
    ".agents .claude .cursor .git .next .playwright-cli .tox .tmp .turbo .venv .yarn __fixtures__ __generated__ __pycache__ "
    "coverage dist fixtures generated node_modules target test-fixtures vendor venv"
).split()
TEST_DIRECTORIES = "__tests__ test tests spec".split()
# Languages by file extension.
EXTENSIONS = {
    "c": "c", "c++": "cpp", "cc": "cpp", "cp": "cpp", "tcc": "cpp", "cjs": "javascript", "cpp": "cpp", "cts": "typescript", "cxx": "cpp", "go": "go", "h": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp",
    "java": "java", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "mts": "typescript", "py": "python", "rb": "ruby", "rs": "rust", "ts": "typescript", "tsx": "tsx",
}
# Names of languages and what else each is called.
LANGUAGES = {
    "javascript": ("js", "mjs", "cjs"), "jsx": (), "typescript": ("ts",), "tsx": (), "python": ("py",), "go": (), "rust": ("rs",), "java": (), "ruby": ("rb",), "c": (), "cpp": ("c++", "cxx"),
}
GENERATED = r"(?i)\.(d\.ts|d\.mts|d\.cts|min\.js|pnp\.cjs)$"
TEST_NAME = r"(?i)(^test([_-].*)?|\.(spec|test)|[_-](test|spec))\.[^.]+$"
JAVA_TEST = r"Test\.java$"


def language_of(path: Column) -> Column:
    """The language of a path by its extension; null if it is none of ours. An upper-case C stands for C++."""
    extension = F.regexp_extract(path, r"\.([^./]+)$", 1)
    by = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.when(path.rlike(GENERATED), F.lit(None)).when(extension == "C", F.lit("cpp")).otherwise(F.try_element_at(by, F.lower(extension)))


def is_scanned(path: Column, tests: bool = False) -> Column:
    """Whether all directories of a path may be read and it is a source file."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    never = IGNORED + ([] if tests else TEST_DIRECTORIES)
    fine = ~F.arrays_overlap(folders, F.array(*map(F.lit, never))) & language_of(path).isNotNull()
    name = F.element_at(parts, -1)
    return fine if tests else fine & ~name.rlike(TEST_NAME) & ~name.rlike(JAVA_TEST)


def languages_df(spark: SparkSession) -> DataFrame:
    """alias, language: every name that a language goes by."""
    return spark.createDataFrame([(a, name) for name, others in LANGUAGES.items() for a in (name, *others)], "alias string, language string")


def resolve_language(name: str) -> str:
    for language, others in LANGUAGES.items():
        if name == language or name in others:
            return language
    raise ValueError(f"Unsupported language: {name}")


def resolve_target(target: str) -> str:
    return os.path.realpath(os.path.expanduser(target))


def list_paths(root: str) -> Iterable[str]:
    """Relative paths of the files under a folder, links that stay inside followed once; ignored folders aren't entered."""
    root, seen = resolve_target(root), set()
    stack = [root]
    while stack:
        folder = stack.pop()
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            real = os.path.realpath(entry.path)
            if entry.name in IGNORED or os.path.basename(real) in IGNORED or os.path.commonpath([root, real]) != root or real in seen:
                continue
            seen.add(real)
            if os.path.isdir(real):
                stack.append(entry.path)
            elif os.path.isfile(real):
                yield os.path.relpath(entry.path, root)


def scan_directory(spark: SparkSession, root: str, tests: bool = False) -> DataFrame:
    """file, language, code of the source files under a folder. Paths are chosen before any content is read."""
    root = resolve_target(root)
    paths = spark.createDataFrame([(p,) for p in list_paths(root)], "file string").where(is_scanned(F.col("file"), tests))
    chosen = [r.file for r in paths.collect()]
    return scan_files(spark, root, chosen)


def scan_files(spark: SparkSession, root: str, chosen: list[str]) -> DataFrame:
    """The same of an explicit list of relative paths."""
    if not chosen:
        return spark.createDataFrame([], "file string, language string, code string")
    read = spark.read.format("binaryFile").load([os.path.join(root, p) for p in chosen])
    file = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root) + 2, F.lit(1 << 20))
    return read.select(file.alias("file"), language_of(file).alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("code"))
