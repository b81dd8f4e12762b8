"""Media columns: cropped or edited copies of images by local descriptors.

An image (binary PGM) is read into grey levels and scaled to a small pyramid. In each level all
corners that are the strongest within ``APART`` pixels are kept, each turned by its intensity centroid, and described by 128 binary
tests of smoothed grey levels. A descriptor is cut into four parts of 32 bits; the Hamming table of a part holds
each query descriptor under its own bits and under all that differ from them in one bit. So all descriptors that differ in at
most 7 bits meet, and others the more seldom the more they differ (``miss_rate``); they stay if they differ in at most ``BITS_APART``.
The matches of a pair of images are then put to a vote: each match proposes a scale, a
turn and a shift, and a pair is linked if at least ``INLIERS`` of its corners agree on one.

Pictures with equal descriptors form a class, known by its smallest id, and only classes are compared. The
tables are made of blocks of ``BLOCK`` queries; each task looks the descriptors of its images up in them. What leaves a task
is, for each query and each image, the number of its links, and of the links as many as hold together what hangs together there: no
pairs. So a large group of near-equal pictures gives as many rows as it has pictures.

The tables of this project have no images, so ``render`` draws one from each row of embeddings, and
``edited`` crops, brightens and roughens it: the query looks the edited copies of the images whose
id is divisible by 100 up among the images of all rows.

Defined cases: null images, and those that aren't PGM or are smaller than a patch, and flat images have no descriptors,
link with nothing and are classes of their own; a null id takes no part; rows that repeat an id are pictures of one id, and
what any of them links with counts for it; of equally good sources of a query the smallest id is named; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import Scratch
from treeledger.llm.near_dedup import components

SIDE, CELLS = 96, 16
LEVELS, RADIUS, TESTS, TURNS, APART = (1.0, 0.8, 0.64, 0.5), 10, 128, 32, 3
MARGIN = RADIUS + 4
BITS_APART, INLIERS, NEAR = 20, 5, 3.0
#: Queries of a block, images looked up in it at once, and pairs of matches that are compared at once.
BLOCK, IMAGES, COMPARED = 1024, 128, 1_000_000
#: Pixels of pictures of one size that are described at once.
PIXELS = 300_000
#: Pictures that are drawn at once.
DRAWN = 128
_rng = np.random.RandomState(77)
PROJECTION = _rng.normal(0, 1, (64, CELLS * CELLS))
#: The two points of each test, x and y, spread evenly over the disc: near ones would see the same edge, and unlike corners look alike.
_a, _r = _rng.uniform(0, 2 * np.pi, (TESTS, 2)), RADIUS * 0.98 * _rng.uniform(0, 1, (TESTS, 2)) ** 0.5
PATTERN = np.stack([_r[:, 0] * np.cos(_a[:, 0]), _r[:, 0] * np.sin(_a[:, 0]), _r[:, 1] * np.cos(_a[:, 1]), _r[:, 1] * np.sin(_a[:, 1])], axis=1)
_a = np.arange(TURNS) * 2 * np.pi / TURNS
_c, _s = np.cos(_a)[:, None], np.sin(_a)[:, None]
#: The pattern's points (y and x, of both sides) for each turn.
TURNED = np.stack([np.rint(f) for x, y in ((PATTERN[:, 0], PATTERN[:, 1]), (PATTERN[:, 2], PATTERN[:, 3])) for f in (_s * x + _c * y, _c * x - _s * y)]).astype(int)
DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])
HEADER = re.compile(rb"P5\s+(?:#[^\n]*\s+)*(\d{1,5})\s+(\d{1,5})\s+(\d{1,3})\s", re.S)

FOUND = "id bigint, x array<float>, y array<float>, level array<int>, turn array<int>, high array<bigint>, low array<bigint>"
KINDS = (pa.float32(), pa.float32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
KEPT = pa.schema([("id", pa.int64()), ("members", pa.int64()), *((k, pa.list_(t)) for k, t in zip(("x", "y", "level", "turn", "high", "low"), KINDS, strict=True))])


def miss_rate(bits: int) -> float:
    """The share of descriptors differing in that many bits, spread at random, that meet in no table: two or more in each part."""
    ways = np.zeros(bits + 1)
    ways[0] = 1
    for _ in range(4):
        ways = np.array([sum(ways[n - k] * comb(32, k) for k in range(2, n + 1)) for n in range(bits + 1)])
    return float(ways[bits] / comb(TESTS, bits))


def to_pgm(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + grey.astype(np.uint8).tobytes()


def from_pgm(data: bytes | None) -> np.ndarray | None:
    m = HEADER.match(data) if data else None
    if not m:
        return None
    width, height = int(m[1]), int(m[2])
    body = data[m.end() : m.end() + width * height]
    return np.frombuffer(body, np.uint8).reshape(height, width).astype(np.float32) if len(body) == width * height and width and height else None


def draw(vectors: np.ndarray) -> np.ndarray:
    """A picture of each vector (rows): cells whose grey levels are fixed mixes of its components."""
    if vectors.shape[1] != len(PROJECTION):
        vectors = np.stack([np.resize(v, len(PROJECTION)) for v in vectors]) if len(vectors) else np.zeros((0, len(PROJECTION)))
    cells = np.clip(128 + 80 * (vectors @ PROJECTION), 0, 255).reshape(-1, CELLS, CELLS)
    return smooth(cells.repeat(SIDE // CELLS, axis=1).repeat(SIDE // CELLS, axis=2)).astype(np.uint8)


def edit(grey: np.ndarray, seed: int) -> np.ndarray:
    """A cropped, brightened and roughened copy."""
    rng = np.random.RandomState(seed % 2**32)
    a, b, c, d = rng.randint(2, 11, 4)
    part = grey[a : SIDE - b, c : SIDE - d].astype(float)
    return np.clip(part * rng.uniform(0.85, 1.1) + rng.uniform(-15, 15) + rng.normal(0, 1.0, part.shape), 0, 255).astype(np.uint8)


def smooth(grey: np.ndarray, size: int = 3) -> np.ndarray:
    """Means over squares of ``size``, of each picture."""
    r = size // 2
    p = np.pad(grey.astype(np.float64), ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(1).cumsum(2)
    return (p[:, size:, size:] - p[:, :-size, size:] - p[:, size:, :-size] + p[:, :-size, :-size]) / (size * size)


def shrink(grey: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear resize of each picture."""
    if scale == 1:
        return grey
    h, w = (int(n * scale) for n in grey.shape[1:])
    y, x = (np.clip((np.arange(n) + 0.5) / scale - 0.5, 0, m - 1.001) for n, m in ((h, grey.shape[1]), (w, grey.shape[2])))
    y0, x0 = y.astype(int), x.astype(int)
    fy, fx = (y - y0)[:, None], x - x0
    rows = grey[:, y0] * (1 - fy) + grey[:, y0 + 1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x0 + 1] * fx


def greatest_around(values: np.ndarray) -> np.ndarray:
    """Of each place the greatest value within ``APART`` rows and columns; the border is left out."""
    n = 2 * APART + 1
    rows = np.lib.stride_tricks.sliding_window_view(values, n, axis=1).max(-1)
    return np.lib.stride_tricks.sliding_window_view(rows, n, axis=2).max(-1)


def corners(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Picture, y and x of the corners."""
    gy, gx = np.zeros_like(grey), np.zeros_like(grey)
    gy[:, 1:-1], gx[:, :, 1:-1] = grey[:, 2:] - grey[:, :-2], grey[:, :, 2:] - grey[:, :, :-2]
    a, b, c = smooth(gx * gx, 5), smooth(gy * gy, 5), smooth(gx * gy, 5)
    strength = a * b - c * c - 0.05 * (a + b) ** 2
    inner = strength[:, MARGIN:-MARGIN, MARGIN:-MARGIN]
    edge = MARGIN - APART
    image, y, x = np.nonzero((inner == greatest_around(strength[:, edge:-edge, edge:-edge])) & (inner > 1.0))
    return image, y + MARGIN, x + MARGIN


def describe_like(greys: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """x, y, level, turn, high and low 64 bits of the descriptors of each of some pictures of one size, in its own scale."""
    out: list[tuple[np.ndarray, ...]] = []
    for level, scale in enumerate(LEVELS):
        small = shrink(greys.astype(np.float64), scale)
        if min(small.shape[1:]) <= 2 * MARGIN + 4:
            continue
        image, row, column = corners(small)
        soft = smooth(small, 5)
        # From here on rows are corners.
        disc = soft[image[:, None], row[:, None] + DISC[:, 0], column[:, None] + DISC[:, 1]]
        disc = disc - disc.mean(1, keepdims=True)
        angle = np.arctan2(disc @ DISC[:, 0], disc @ DISC[:, 1])
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        y1, x1, y2, x2 = (TURNED[i][turn] for i in range(4))
        at = image[:, None]
        bits = soft[at, row[:, None] + y1, column[:, None] + x1] < soft[at, row[:, None] + y2, column[:, None] + x2]
        words = np.packbits(bits, axis=1).view(">i8").astype(np.int64).reshape(-1, 2)
        out.append((image, column / scale, row / scale, np.full(len(image), level), turn, words[:, 0], words[:, 1]))
    if not out:
        return [tuple(np.zeros(0) for _ in KINDS)] * len(greys)
    image, *rest = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(image, kind="stable")
    cuts = np.searchsorted(image[order], np.arange(1, len(greys)))
    return list(zip(*(np.split(c[order], cuts) for c in rest), strict=True))


def describe_images(data: list[bytes | None]) -> list[tuple[np.ndarray, ...]]:
    """The descriptors of images, in their order."""
    out: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0) for _ in KINDS)] * len(data)
    by_size: dict[tuple[int, ...], list[tuple[int, np.ndarray]]] = {}
    for i, d in enumerate(data):
        if (grey := from_pgm(d)) is not None:
            by_size.setdefault(grey.shape, []).append((i, grey))
    for alike in by_size.values():
        step = max(1, PIXELS // alike[0][1].size)
        for part in (alike[at : at + step] for at in range(0, len(alike), step)):
            for (i, _), got in zip(part, describe_like(np.stack([g for _, g in part])), strict=True):
                out[i] = got
    return out


def describe(images: DataFrame) -> DataFrame:
    """The descriptors of each image (id, image), those without any left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                got = describe_images(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([g[k] for g in got], pa.list_(kind)) for k, kind in enumerate(KINDS))], ["id", "x", "y", "level", "turn", "high", "low"])

    return images.select(F.col("id").cast("bigint").alias("id"), "image").where("id is not null and image is not null").mapInArrow(run, FOUND).where(F.size("x") > 0)


@dataclass
class Flat:
    """The descriptors of some images, one after another. ``image`` is the place of each one's image among them."""

    ids: np.ndarray
    members: np.ndarray
    image: np.ndarray
    at: np.ndarray  # a row for each descriptor: corner, x, y, level, turn
    high: np.ndarray
    low: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [w for bits in (self.high, self.low) for w in (bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF))]


def flat(found: pa.RecordBatch | pa.Table) -> Flat:
    size = found.column("x").combine_chunks() if isinstance(found, pa.Table) else found.column("x")
    n = size.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    image = np.repeat(np.arange(len(n)), n)
    corner = np.arange(len(image)) - np.repeat(np.cumsum(n) - n, n)
    x, y, level, turn, high, low = (np.asarray((c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).flatten()) for c in map(found.column, ("x", "y", "level", "turn", "high", "low")))
    return Flat(np.asarray(found.column("id")), np.asarray(found.column("members")), image, np.stack([corner, x, y, level, turn], axis=1).astype(float), high.view(np.uint64), low.view(np.uint64))


ONE_BIT = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(32, dtype=np.uint64)])


def tables(asked: Flat) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each part its bits, and those that differ from them in one bit, in order; and the descriptors that have them."""
    out = []
    for bits in asked.parts():
        near = (bits[:, None] ^ ONE_BIT).ravel()
        order = np.argsort(near, kind="stable")
        out.append((near[order].astype(np.uint32), (order // len(ONE_BIT)).astype(np.int32)))
    return out


def meet(asked: Flat, hamming: list[tuple[np.ndarray, np.ndarray]], held: Flat) -> tuple[np.ndarray, np.ndarray]:
    """The matches, as places in ``asked`` and in ``held``, by images, then corners; each once."""
    codes = []
    for (bits, owner), wanted in zip(hamming, held.parts(), strict=True):
        wanted = wanted.astype(np.uint32)
        first = np.searchsorted(bits, wanted, "left")
        n = np.searchsorted(bits, wanted, "right") - first
        h = np.repeat(np.arange(len(wanted)), n)
        q = owner[np.arange(len(h)) + np.repeat(first - (np.cumsum(n) - n), n)].astype(np.int64)
        near = np.bitwise_count(asked.high[q] ^ held.high[h]) + np.bitwise_count(asked.low[q] ^ held.low[h]) <= BITS_APART
        codes.append(q[near] * len(held.high) + h[near])
    q, h = np.divmod(np.unique(np.concatenate(codes)), max(len(held.high), 1))
    order = np.lexsort((held.image[h], asked.image[q]))
    return q[order], h[order]


def proposals(q: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each match (rows of ``Flat.at``) the turn and scale as a cosine and a sine, the scale and the shift."""
    (_, qx, qy, ql, qt), (_, x, y, level, turn) = q.T, i.T
    sizes = np.array(LEVELS)
    scale = sizes[level.astype(int)] / sizes[ql.astype(int)]
    angle = (qt - turn) * 2 * np.pi / TURNS
    cos, sin = np.cos(angle) * scale, np.sin(angle) * scale
    return cos, sin, scale, qx - (cos * x - sin * y), qy - (sin * x + cos * y)


def consensus(matches: np.ndarray) -> tuple[int, float, float, float]:
    """Corners that agree on one similarity transform, its scale and shift. Rows: query corner, image corner, qx, qy, q level, q turn, x, y, level, turn."""
    q, i = matches[:, [0, 2, 3, 4, 5]], matches[:, [1, 6, 7, 8, 9]]
    cos, sin, scale, dx, dy = proposals(q, i)
    c, s, tx, ty = (v[:, None] for v in (cos, sin, dx, dy))
    x, y = i[:, 1], i[:, 2]
    fits = np.hypot(c * x - s * y + tx - q[:, 1], s * x + c * y + ty - q[:, 2]) <= NEAR
    n = np.minimum(*((fits.astype(np.float32) @ (side[:, 0, None] == np.unique(side[:, 0])) > 0).sum(1) for side in (q, i)))
    best = int(np.argmax(n))
    return int(n[best]), float(scale[best]), float(dx[best]), float(dy[best])


def hopeful(q: np.ndarray, i: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which groups of matches have one that ``INLIERS`` or more agree with; no other can have as many corners that do."""
    out = np.zeros(len(sizes), dtype=bool)
    cos, sin, _, dx, dy = proposals(q, i)
    step = np.cumsum(sizes * sizes) // COMPARED
    for g in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(step)) + 1) if len(sizes) else ():
        of = np.repeat(g, sizes[g])
        a = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes[g]) - sizes[g], sizes[g])
        n = sizes[of]
        ends = np.cumsum(n)
        p = np.repeat(a, n)
        b = np.repeat(starts[of] - (ends - n), n) + np.arange(ends[-1])
        x, y = i[b, 1], i[b, 2]
        fits = np.hypot(cos[p] * x - sin[p] * y + dx[p] - q[b, 1], sin[p] * x + cos[p] * y + dy[p] - q[b, 2]) <= NEAR
        out[of[np.add.reduceat(fits.astype(np.int64), ends - n) >= INLIERS]] = True
    return out


def copies(asked: Flat, hamming: list[tuple[np.ndarray, np.ndarray]], held: Flat) -> list[tuple]:
    """Place in asked, place in held, matches, inliers, scale, dx, dy of the pairs of two lots of images that are linked."""
    qs, hs = meet(asked, hamming, held)
    pair = asked.image[qs] * len(held.ids) + held.image[hs]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    sizes = np.diff(starts, append=len(pair))
    starts, sizes = starts[sizes >= INLIERS], sizes[sizes >= INLIERS]
    q, i = asked.at[qs], held.at[hs]
    out = []
    for k in np.flatnonzero(hopeful(q, i, starts, sizes)):
        s = slice(starts[k], starts[k] + sizes[k])
        inliers, *where = consensus(np.concatenate([q[s, :1], i[s, :1], q[s, 1:], i[s, 1:]], axis=1))
        if inliers >= INLIERS:
            out.append((int(asked.image[qs[s.start]]), int(held.image[hs[s.start]]), int(sizes[k]), inliers, *where))
    return out


IMAGE, QUERY, LINK = 0, 1, 2
PART = "kind int, id bigint, other bigint, n bigint, matches int, inliers int, scale double, dx double, dy double"
PART_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())


def summed(asked: Flat, held: Flat, found: list[tuple]) -> list[tuple]:
    """Of the links of two lots: for each image and each query the number of its links, for a query its best one, and links enough to hold together what hangs together."""
    images: dict[int, int] = {}
    queries: dict[int, list] = {}
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out: list[tuple] = []
    for q, h, matches, *rest in found:
        images[h] = images.get(h, 0) + int(asked.members[q])
        got = queries.setdefault(q, [0, None])
        got[0] += int(held.members[h])
        best = (-rest[0], -matches, int(held.ids[h]), rest[1:])
        got[1] = best if got[1] is None else min(got[1], best)
        x, y = top(h), top(-1 - q)
        if x != y:
            root[x] = y
            out.append((LINK, int(asked.ids[q]), int(held.ids[h]), 1, None, None, None, None, None))
    out += [(IMAGE, int(held.ids[h]), None, n, None, None, None, None, None) for h, n in images.items()]
    return out + [(QUERY, int(asked.ids[q]), b[2], n, -b[1], -b[0], *b[3]) for q, (n, b) in queries.items()]


def classes(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """id, rep of each picture that has descriptors; and of each class of pictures with equal ones its rep, members and descriptors."""
    lists = ["x", "y", "level", "turn", "high", "low"]
    named = scratch.keep(found.withColumn("d1", F.xxhash64(*lists)).withColumn("d2", F.xxhash64(*lists[::-1])))
    each = scratch.keep(named.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("members")))
    # Rows that are the smallest of their class; equal rows of one id are made one.
    smallest = named.join(each, ["d1", "d2"]).where(F.col("id") == F.col("rep")).dropDuplicates(["d1", "d2"])
    return named.join(each, ["d1", "d2"]).select("id", "rep", "d1").distinct(), scratch.keep(smallest.select(F.xxhash64("rep", "d1").alias("id"), "members", *lists, "rep", "d1"))


def find_links(asked: DataFrame, held: DataFrame, scratch: Scratch) -> DataFrame:
    """What ``summed`` has, for all classes of queries and of images."""
    spark = held.sparkSession
    path = f"{scratch.root}/links"
    spark.createDataFrame([], PART).write.parquet(path)
    held = held.select(*KEPT.names)
    # The driver holds one block of queries at a time.
    for rows in batched(asked.select(*KEPT.names).toLocalIterator(), BLOCK):
        shared = spark.sparkContext.broadcast(flat(pa.Table.from_pylist([r.asDict() for r in rows], KEPT)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            hamming = tables(block)
            for batch in batches:
                for at in range(0, batch.num_rows, IMAGES):
                    some = flat(batch.slice(at, IMAGES))
                    out = summed(block, some, copies(block, hamming, some))
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(PART_KINDS)], PART.replace(",", "").split()[::2])

        held.mapInArrow(run, PART).write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(PART).parquet(path)


def find_copies(queries: DataFrame, images: DataFrame) -> DataFrame:
    """One row for each id of images and of queries: image_id, is_query, class_id, n_links, source_id, inliers, scale, dx, dy.

    ``class_id`` is the smallest id of the images that hang together by equal descriptors and by links to the same queries;
    null for a query without a link. ``n_links`` counts the pictures of the other side that one is linked with. The rest, of queries
    alone, says which image a copy was made from best, and where it lies in it.
    """
    scratch = Scratch(images.sparkSession, "media")
    asked_ids, asked = classes(describe(queries), scratch)
    held_ids, held = classes(describe(images), scratch)
    found = find_links(asked, held, scratch)
    star = found.where(F.col("kind") == LINK).select(F.col("id").alias("query"), F.col("other").alias("image"))
    low = star.groupBy("query").agg(F.min("image").alias("low"))
    links = scratch.keep(star.join(low, "query").where("low < image").select(F.col("low").alias("a"), F.col("image").alias("b")).distinct())
    # Pictures of one id belong together as well.
    key = F.xxhash64("rep", "d1")
    own = scratch.keep(held_ids.select("id", "rep", key.alias("cls")))
    same = own.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b")
    several = own.join(same.select("id", "a"), "id").where("a < cls").select("a", F.col("cls").alias("b"))
    labels = scratch.keep(components(links.union(several).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), scratch))
    label = F.coalesce("label", "cls")
    labelled = scratch.keep(own.join(labels.withColumnRenamed("id", "cls"), "cls", "left").select("id", "cls", label.alias("label")))
    smallest = labelled.groupBy("label").agg(F.min("id").alias("class_id"))
    counts = found.where(F.col("kind") == IMAGE).groupBy(F.col("id").alias("cls")).agg(F.sum("n").alias("n"))
    image_rows = labelled.join(smallest, "label").join(counts, "cls", "left").groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("n").alias("n_links"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("source_id", "bigint"), ("inliers", "int"), ("scale", "double"), ("dx", "double"), ("dy", "double"))]
    all_images = images.select(F.col("id").cast("bigint").alias("id")).where("id is not null").distinct()
    image_side = all_images.join(image_rows, "id", "left").select(F.col("id").alias("image_id"), F.lit(False).alias("is_query"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *empty)

    best = F.min_by(F.struct("other", "inliers", "scale", "dx", "dy"), F.struct(-F.col("inliers"), -F.col("matches"), "other")).alias("best")
    by_query = found.where(F.col("kind") == QUERY).groupBy(F.col("id").alias("cls")).agg(F.sum("n").alias("n"), best)
    sources = labelled.join(smallest, "label").groupBy("cls").agg(F.min("class_id").alias("class_id"), F.min("id").alias("source_id"))
    told = asked_ids.select("id", key.alias("cls")).join(by_query, "cls").join(sources.withColumnRenamed("cls", "source"), F.col("best.other") == F.col("source"))
    order = F.struct(-F.col("best.inliers"), "source_id", "best.scale", "best.dx", "best.dy")
    query_rows = told.groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("n").alias("n_links"), F.min_by(F.struct("source_id", "best.inliers", "best.scale", "best.dx", "best.dy"), order).alias("b"))
    all_queries = queries.select(F.col("id").cast("bigint").alias("id")).where("id is not null").distinct()
    query_side = all_queries.join(query_rows, "id", "left").select(F.col("id").alias("image_id"), F.lit(True).alias("is_query"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "b.*")
    return image_side.union(query_side)


def render(vectors: DataFrame, copies: bool = False, every: int = 100) -> DataFrame:
    """id, image: a picture of each vector, or the edited copies of those whose id is divisible by ``every``."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = rows.where(F.pmod("id", F.lit(every)) == 0) if copies else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DRAWN):
                part = batch.slice(at, DRAWN)
                vectors = part.column(1).to_pylist()
                alike = {w: [i for i, v in enumerate(vectors) if len(v) == w] for w in set(map(len, vectors))}
                drawn = {i: g for of in alike.values() for i, g in zip(of, draw(np.array([vectors[i] for i in of])), strict=True)}
                images = [to_pgm(edit(drawn[i], n) if copies else drawn[i]) for i, n in enumerate(part.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(images, pa.binary())], ["id", "image"])

    return rows.mapInArrow(run, "id bigint, image binary")
