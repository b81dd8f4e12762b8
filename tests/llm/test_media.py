import numpy as np
import pyarrow as pa
import pytest

from treeledger.llm import media

VECTORS = "vec_id bigint, embedding array<float>, label int"
IMAGES = "id bigint, image binary"


def unit(n, seed=4):
    x = np.random.RandomState(seed).normal(0, 1, (n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lot(greys):
    got = media.describe_images([media.to_pgm(g) for g in greys])
    columns = [pa.array([d[k] for d in got], pa.list_(kind)) for k, kind in enumerate(media.KINDS)]
    return media.flat(pa.Table.from_arrays([pa.array(range(len(got)), pa.int64()), pa.array([1] * len(got), pa.int64()), *columns], schema=media.KEPT))


def test_edited_copies_are_found_and_others_are_not(spark):
    vectors = spark.createDataFrame([(i * 10, v.tolist(), 0) for i, v in enumerate(unit(150))], VECTORS)
    rows = media.find_copies(media.render(vectors, copies=True), media.render(vectors)).collect()
    images, queries = {r.image_id: r for r in rows if not r.is_query}, {r.image_id: r for r in rows if r.is_query}
    assert sorted(images) == list(range(0, 1500, 10)) and sorted(queries) == list(range(0, 1500, 100)) and len(rows) == 165
    assert all((r.class_id, r.source_id, r.n_links) == (i, i, 1) and r.inliers >= media.INLIERS and abs(r.scale - 1) < 0.01 for i, r in queries.items())
    assert all((r.class_id, r.n_links) == (i, int(i % 100 == 0)) for i, r in images.items())


def test_shift_is_the_crop():
    grey = media.draw(np.random.RandomState(1).normal(0, 0.125, (1, 64)))[0]
    (q, h, _, n, scale, dx, dy), = media.copies(a := lot([grey]), media.tables(a), lot([grey[5:, 8:]]))
    assert (q, h) == (0, 0) and n >= media.INLIERS and scale == 1 and abs(dx - 8) <= 1 and abs(dy - 5) <= 1


def test_smaller_copies_are_found():
    greys = media.draw(unit(30))
    asked = lot([media.shrink(g[None, 4:-4, 3:].astype(float), 0.8)[0] for g in greys])
    found = {(q, h) for q, h, *_ in media.copies(asked, media.tables(asked), lot(greys))}
    assert {q for q, h in found} <= {q for q, h in found if q == h} and len(found) >= 27


def brute_matches(asked, held):
    near = np.bitwise_count(asked.high[:, None] ^ held.high) + np.bitwise_count(asked.low[:, None] ^ held.low)
    return near


@pytest.mark.parametrize("noise", [0, 4, 12])
def test_tables_hold_against_brute_force(noise):
    rng = np.random.RandomState(2)
    greys = media.draw(unit(25))
    asked, held = lot([np.clip(g + rng.normal(0, noise, g.shape), 0, 255) for g in greys[::2]]), lot(greys)
    near = brute_matches(asked, held)
    met = set(zip(*(v.tolist() for v in media.meet(asked, media.tables(asked), held)), strict=True))
    all_within = set(zip(*(v.tolist() for v in np.nonzero(near <= media.BITS_APART)), strict=True))
    assert met <= all_within and set(zip(*(v.tolist() for v in np.nonzero(near <= 7)), strict=True)) <= met
    mixed = [asked.parts()[k][:, None] ^ held.parts()[k] for k in range(4)]
    assert met == {(a, b) for a, b in all_within if any(bin(int(m[a, b])).count("1") <= 1 for m in mixed)}


def test_miss_rate():
    rng = np.random.RandomState(3)
    for bits in (7, 8, 10, 15):
        parts = np.array([rng.permutation(128)[:bits] // 32 for _ in range(4000)])
        missed = np.mean([min(np.bincount(p, minlength=4)) >= 2 for p in parts])
        assert abs(missed - media.miss_rate(bits)) < 0.03
    assert media.miss_rate(7) == 0


def test_equal_and_near_equal_pictures_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(media, "BLOCK", 3)
    rng = np.random.RandomState(6)
    drawn = media.draw(unit(12))
    rough = lambda g: np.clip(g + rng.normal(0, 2, g.shape), 0, 255)
    rows = [(i, media.to_pgm(drawn[0])) for i in (50, 20, 30)] + [(40, media.to_pgm(rough(drawn[0]))), (60, media.to_pgm(drawn[1])), (60, media.to_pgm(drawn[2])), (60, media.to_pgm(drawn[2])), (70, None)]
    rows += [(100 + i, media.to_pgm(drawn[i])) for i in range(3, 12)]
    queries = [(1, media.to_pgm(rough(drawn[0]))), (2, media.to_pgm(rough(drawn[0]))), (3, media.to_pgm(rough(drawn[1]))), (4, media.to_pgm(rough(drawn[2]))), (5, b"x"), (6, media.to_pgm(media.draw(unit(1, 9))[0]))]
    got = media.find_copies(spark.createDataFrame(queries, IMAGES), spark.createDataFrame(rows, IMAGES)).collect()
    images, asked = {r.image_id: (r.class_id, r.n_links) for r in got if not r.is_query}, {r.image_id: (r.class_id, r.n_links, r.source_id) for r in got if r.is_query}
    assert images == {i: (20, 2) for i in (20, 30, 40, 50)} | {60: (60, 2), 70: (70, 0)} | {100 + i: (100 + i, 0) for i in range(3, 12)}
    assert {i: v[:2] for i, v in asked.items()} == {1: (20, 4), 2: (20, 4), 3: (60, 1), 4: (60, 2), 5: (None, 0), 6: (None, 0)}
    assert asked[1][2] in (20, 40) and asked[3][2] == 60 and asked[5][2] is None


def test_odd_images(spark):
    rows = [(1, None), (2, b""), (3, b"JFIF"), (4, b"P5\n10 10\n255\n" + b"x" * 100), (5, b"P5\n90 90\n255\n" + b"x"), (None, media.to_pgm(np.zeros((96, 96)))), (6, media.to_pgm(np.zeros((96, 96)))), (6, None)]
    images = spark.createDataFrame([(*r, 1, "clash") for r in rows], "id bigint, image binary, n int, rep string")
    assert media.describe(images).collect() == []
    got = sorted((r.is_query, r.image_id, r.class_id, r.n_links) for r in media.find_copies(images, images).collect())
    assert got == [(False, i, i, 0) for i in range(1, 7)] + [(True, i, None, 0) for i in range(1, 7)]
    assert media.find_copies(images.limit(0), images.limit(0)).collect() == []
    vectors = spark.createDataFrame([(100, None, 0), (200, [], 0), (300, [float("nan")] * 64, 0)], VECTORS)
    assert media.render(vectors).collect() == []
    assert media.render(spark.createDataFrame([(1, [0.5] * 3, 0), (2, [0.1] * 64, 0)], VECTORS)).count() == 2


def test_copies_edited_more_are_found(spark, monkeypatch):
    monkeypatch.setattr(media, "BLOCK", 20, raising=False)
    drawn = media.draw(unit(150))

    def roughened(i):
        part = media.edit(drawn[i], i)
        return np.clip(0.8 * part + np.random.RandomState(i).normal(0, 15, part.shape), 0, 255)

    images = spark.createDataFrame([(i, media.to_pgm(g)) for i, g in enumerate(drawn)], IMAGES)
    queries = spark.createDataFrame([(i, media.to_pgm(roughened(i))) for i in range(0, 150, 5)], IMAGES)
    found = [(r.image_id, r.source_id, r.n_links) for r in media.find_copies(queries, images).collect() if r.is_query]
    assert sorted(found) == [(i, i, 1) for i in range(0, 150, 5)]
