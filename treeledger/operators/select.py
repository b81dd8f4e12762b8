"""Order-dependent steps on duplicate groups: greedy selection and gap merging."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

SHED_ROUNDS = 20


def greedy(rows: Sequence[tuple[str, str, int, int, int]], files: int = 1) -> list[int]:
    """Indexes of the regions (key, file, start, end, tokens) that are kept.

    Regions are taken by coverage, group size times tokens, then by file and start; one that overlaps a taken
    region of its file is left. Groups that end up with fewer than two regions, or in fewer than ``files``
    files, are shed and the rest is selected anew.
    """
    live = set(range(len(rows)))
    kept: list[int] = []
    for _ in range(SHED_ROUNDS):
        sizes: dict[str, int] = defaultdict(int)
        for i in live:
            sizes[rows[i][0]] += 1
        order = sorted(live, key=lambda i: (-sizes[rows[i][0]] * rows[i][4], rows[i][1], rows[i][2], i))
        taken: dict[str, list[tuple[int, int]]] = defaultdict(list)
        kept = []
        for i in order:
            _, file, start, end, _ = rows[i]
            if all(end <= a or b <= start for a, b in taken[file]):
                taken[file].append((start, end))
                kept.append(i)
        groups: dict[str, list[int]] = defaultdict(list)
        for i in kept:
            groups[rows[i][0]].append(i)
        lost = {k for k, g in groups.items() if len(g) < 2 or len({rows[i][1] for i in g}) < files}
        lost |= {rows[i][0] for i in live} - set(groups)
        if not lost & set(groups):
            break
        live = {i for i in live if rows[i][0] not in lost}
    held = Counter(rows[i][0] for i in kept)
    return sorted(i for i in kept if held[rows[i][0]] >= 2)


def merge_gaps(first: Sequence[tuple[int, int]], second: Sequence[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Pairs each region of ``second`` with the earliest unused region of ``first`` that ends at most ``gap`` before it, and joins them."""
    used: set[int] = set()
    out = []
    for start, end in sorted(second):
        for i, (a, b) in enumerate(sorted(first)):
            if i not in used and 0 <= start - b <= gap:
                used.add(i)
                out.append((a, end))
                break
    return out


def chosen(rows: list[tuple]) -> list[tuple]:
    """The greedy choice among the rows (file, key, first_line, last_line, n_tokens) of one file."""
    rows = sorted(rows, key=lambda r: (r[2], r[3], r[1]))
    return [rows[i] for i in greedy([(key, str(file), first, last + 1, n) for file, key, first, last, n in rows])]


def select_regions(candidates: DataFrame) -> DataFrame:
    """The greedy choice among the candidates of each file: file, key, first_line, last_line, n_tokens.

    Files follow one another in a task, which holds one of them; a call for each file would cost more than the choice.
    """
    rows = candidates.select("file", "key", "first_line", "last_line", "n_tokens")

    def made(out: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += chosen(held)
                    held = []
                held.append(row)
            kinds = batch.schema
            if out:
                yield made(out, kinds)
        if out := chosen(held):
            yield made(out, kinds)

    return rows.repartition("file").sortWithinPartitions("file").mapInArrow(run, rows.schema)
