"""The order-dependent steps against plain models."""

import random

import pytest

from treeledger.functions import hashing, text
from treeledger.operators import clones, gate, select, similarity
from treeledger.sources import git, scan


def lcs_model(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_lcs_equals_a_table():
    random.seed(1)
    for _ in range(500):
        a, b = ([random.randint(0, 4) for _ in range(random.randint(0, 30))] for _ in range(2))
        assert similarity.lcs_length(a, b) == lcs_model(a, b)


def test_matching_is_largest():
    random.seed(2)
    for _ in range(200):
        rows = [(f"a{i}", f"b{j}", random.randint(30, 99)) for i in range(5) for j in range(5) if random.random() < 0.4]
        got = similarity.best_matching(rows)
        assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})

        def most(left, used):
            if not left:
                return 0
            return max([most(left[1:], used)] + [1 + most(left[1:], used | {b}) for a, b, _ in rows if a == left[0] and b not in used])

        assert len(got) == most(sorted({a for a, _, _ in rows}), frozenset())


def test_exact_pairs_are_locked():
    assert similarity.best_matching([("a", "x", 100), ("b", "x", 90), ("a", "y", 80)]) == [("a", "x")]


def test_greedy_prefers_coverage_and_sheds_single_groups():
    rows = [("k", "f", 0, 10, 10), ("k", "f", 20, 30, 10), ("m", "f", 5, 9, 4), ("m", "f", 40, 44, 4)]
    assert select.greedy(rows) == [0, 1]
    assert select.greedy([("k", "f", 0, 10, 5), ("k", "g", 0, 10, 5)], files=2) == [0, 1]
    assert select.greedy([("k", "f", 0, 10, 5), ("k", "f", 20, 30, 5)], files=2) == []


def test_gap_merge_uses_each_once():
    assert select.merge_gaps([(0, 5), (10, 15)], [(6, 9), (16, 20), (17, 21)], 30) == [(0, 9), (10, 20)]
    assert select.merge_gaps([(0, 5)], [(6, 9), (7, 9)], 3) == [(0, 9)]
    assert select.merge_gaps([(0, 5)], [(60, 69)], 3) == []


def test_hashes_equal_a_model(spark):
    words = ["", "a", "p1v", "p70", "héllo", "😀", "x" * 200]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.xor_hash(text.F.col("w")).alias("x"), hashing.fnv_hash(text.F.col("w")).alias("f")).collect()
    for r in rows:
        raw = r.w.encode("utf-16-be")
        units = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)]
        x, f = 5381, 2166136261
        for u in units:
            x, f = ((x * 33) & 0xFFFFFFFF) ^ u, ((f ^ u) * 16777619) & 0xFFFFFFFF
        assert (r.x, r.f) == (x, f)
    got = {r.w: r.x for r in rows}
    assert got["p1v"] == got["p70"]


def test_lines_of_odd_texts(spark):
    rows = [(1, ""), (2, None), (3, "a\r\nb\rc\n"), (4, " ﻿\n x")]
    got = [(r.file, r.line, r.blank) for r in text.lines_of(spark.createDataFrame(rows, "file int, code string")).orderBy("file", "line_no").collect()]
    assert got == [(3, "a", False), (3, "b", False), (3, "c", False), (3, "", True), (4, " ﻿", True), (4, " x", False)]


@pytest.mark.parametrize(
    "path,tests,kept",
    [("src/a.ts", False, True), ("node_modules/a.ts", True, False), ("test/a.ts", False, False), ("test/a.ts", True, True), ("src/a.test.ts", False, False), ("src/contest.java", False, True), ("src/ATest.java", False, False), ("a.d.ts", False, False), ("a.C", False, True), ("README.md", False, False), ("x/vendor/y.go", False, False)],
)
def test_scanned_paths(spark, path, tests, kept):
    assert spark.range(1).select(scan.is_scanned(text.F.lit(path), tests).alias("k")).first().k is kept


def test_languages(spark):
    assert scan.resolve_language("c++") == "cpp"
    with pytest.raises(ValueError, match="Unsupported language: cobol"):
        scan.resolve_language("cobol")
    assert scan.languages_df(spark).count() == 20


def test_name_status():
    said = "M\0a.ts\0R087\0b.ts\0c.ts\0C100\0d.ts\0e.ts\0D\0f.ts\0A\0g.ts\0U\0h.ts\0"
    assert git.parse_name_status(said) == [("modified", "a.ts", "a.ts"), ("renamed", "b.ts", "c.ts"), ("added", None, "e.ts"), ("deleted", "f.ts", None), ("added", None, "g.ts")]


def test_scan_and_git(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.py").write_text("y = 1\n")
    (tmp_path / "src/link.py").symlink_to(tmp_path / "src/a.py")
    assert [(r.file, r.language, r.code) for r in scan.scan_directory(spark, str(tmp_path)).collect()] == [("src/a.py", "python", "x = 1\n")]
    run("init", "-b", "main"), run("add", "src"), run("commit", "-m", "x")
    (tmp_path / "src/a.py").write_text("x = 2\n")
    (tmp_path / "src/new.py").write_text("")
    got = {tuple(r) for r in git.changed_files(spark, str(tmp_path), "HEAD").collect()}
    assert ("modified", "src/a.py", "src/a.py") in got and ("added", None, "src/new.py") in got
    assert git.text_at(str(tmp_path), "HEAD", "src/a.py") == "x = 1\n" and git.links_at(str(tmp_path), "HEAD") == {"src/link.py"}


def test_backstop_is_silenced_by_a_reported_maximum(spark):
    files = spark.createDataFrame([("a", True, 5, 9, 10, 10), ("b", True, 5, 9, 10, 40), ("c", False, 1, 99, 1, 99)], "file string, split boolean, base_max_cognitive int, head_max_cognitive int, base_ncss int, head_ncss int")
    said = spark.createDataFrame([("a", 9)], "file string, head_value int")
    got = {(r.file, r.metric) for r in gate.file_backstops(files, said).collect()}
    assert got == {("b", "file max cognitive complexity"), ("b", "file NCSS")}


def test_anonymous_words_equal_a_model(spark):
    random.seed(3)
    said = [None, [], ["a"], ["1", "1"]] + [[random.choice(["a", "b", "_c", "é", "1", "+", "2x", "\U0001f600", "ab"]) for _ in range(random.randint(1, 40))] for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(said)), "id int, said array<string>")
    got = {r.id: r.name for r in rows.select("id", clones.anonymous(text.F.col("said")).alias("name")).collect()}
    model = lambda t: [f"${t.index(x) + 1}" if x[0].isalpha() or x[0] == "_" else x for x in t]
    assert got == {i: None if t is None else model(t) for i, t in enumerate(said)}


def test_components_of_a_long_path_and_null_ends(spark):
    path = [(i, i + 1) for i in range(1, 40)]
    random.seed(4)
    random.shuffle(path)
    edges = spark.createDataFrame([*path, (100, 100), (None, 7), (8, None), (2, 1), (2, 1)], "a long, b long")
    assert {(r.id, r.root) for r in similarity.components(edges).collect()} == {(i, 1) for i in range(1, 41)} | {(100, 100)}
    assert similarity.components(spark.createDataFrame([], "a long, b long")).count() == 0
