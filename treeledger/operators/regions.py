"""Statements of whole files and what is made of them in one pass: blocks, fingerprints of lines, windows.

A task reads texts as they come, and keeps no more than one file and one batch of rows. Rows that repeat a file count
as one file, whose lines are merged by their numbers, as in ``statements_of``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.text import LINE_BREAK, well_formed

#: ``SPACE_CLASS``, ``TOKEN`` and the words that fingerprints rename.
SPACE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
BREAKS, TOKENS = re.compile(LINE_BREAK), re.compile(r"\w+|[^\w\x09-\x0D\x20]")
#: Rows of a batch that a task sends on.
BATCH = 20_000


def anonymous(said: list[str]) -> str:
    """The tokens, joined by spaces; words are replaced by the place where each first occurs."""
    first = dict(zip(reversed(said), range(len(said), 0, -1), strict=True))
    names = {t: f"${i}" if t[0].isalpha() or t[0] == "_" else t for t, i in first.items()}
    return " ".join(map(names.__getitem__, said))


def fingerprint(said: list[str]) -> str:
    return f"{md5(anonymous(said).encode(), usedforsecurity=False).hexdigest()}:{len(said)}"


def runs(texts: list[str]) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """(container, its statements as (line_no, line)) of a file; more than one text where rows repeat it."""
    lines = [(no, line) for text in texts if text for no, line in enumerate(BREAKS.split(text), 1)]
    if len(texts) > 1:
        lines.sort(key=lambda r: (r[0], bool(r[1].strip(SPACE)), r[1]))
    container, run = 0, []
    for row in lines:
        if row[1].strip(SPACE):
            run.append(row)
            continue
        if run:
            yield container, run
            run = []
        container += 1
    if run:
        yield container, run


def each_file(files: DataFrame, rows_of: Callable, schema: str, whole: bool = True) -> DataFrame:
    """The rows (file, ...) that ``rows_of(file, texts)`` makes of each file of file, code; not ``whole``: of each row."""
    names = ["file", *(c.split()[0] for c in schema.split(", "))]
    out = f"file {files.schema['file'].dataType.simpleString()}, {schema}"
    texts = files.select("file", well_formed(F.col("code")).alias("code"))
    if whole:
        texts = texts.repartition("file").sortWithinPartitions("file")
    types = pa.schema([(name, _ARROW.get(kind)) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        file, held, kind = None, None, None

        def sent() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [()] * len(names)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types.types], strict=True)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is not None and whole and own == file:
                    held.append(text)
                    continue
                if held is not None:
                    made.extend(rows_of(file, held))
                    if len(made) >= BATCH:
                        yield sent()
                file, held = own, [text]
        if held is not None:
            made.extend(rows_of(file, held))
        if made:
            yield sent()

    return texts.mapInArrow(run, out)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def block_rows(least: int) -> Callable:
    def rows_of(file, texts: list[str]) -> Iterator[tuple]:
        for container, run in runs(texts):
            said = TOKENS.findall("\n".join([line for _, line in run]))
            if len(said) >= least:
                yield file, container, len(said), "b:" + fingerprint(said), run[0][0], run[-1][0]

    return rows_of


def line_rows(file, texts: list[str]) -> Iterator[tuple]:
    """(file, fingerprint, number) of the lines of a text."""
    said = (TOKENS.findall(line) for _, run in runs(texts) for _, line in run)
    return ((file, key, n) for key, n in Counter(fingerprint(s) for s in said if s).items())


def run_windows(run: list[tuple[int, str]], most: int) -> Iterator[tuple[int, int, bytes, int]]:
    """(index, len, key, distinct lines) of every run of 2 to ``most`` statements."""
    texts = [line.encode() for _, line in run]
    for i in range(len(run) - 1):
        digest, seen = md5(texts[i], usedforsecurity=False), {texts[i]}
        for j in range(i + 1, min(i + most, len(run))):
            digest.update(b"\n" + texts[j])
            seen.add(texts[j])
            yield i, j - i + 1, digest.digest(), len(seen)


def window_rows(most: int) -> Callable:
    def rows_of(file, texts: list[str]) -> Iterator[tuple]:
        for container, run in runs(texts):
            for i, n, key, distinct in run_windows(run, most):
                yield file, container, i + 1, n, key, distinct, run[i][0], run[i + n - 1][0]

    return rows_of


def window_key_rows(most: int) -> Callable:
    """A row for each key of a file's windows of two distinct lines: its number, places, length, and whether it lies in two containers."""

    def rows_of(file, texts: list[str]) -> Iterator[tuple]:
        found: dict[bytes, list] = {}
        for container, run in runs(texts):
            for i, n, key, distinct in run_windows(run, most):
                if distinct > 1:
                    if (own := found.get(key)) is None:
                        found[key] = [1, i + 1, i + 1, n, container, False]
                    else:
                        own[:] = own[0] + 1, min(own[1], i + 1), max(own[2], i + 1), n, container, own[5] or own[4] != container
        return ((file, key, n, low, high, size, apart) for key, (n, low, high, size, _, apart) in found.items())

    return rows_of
