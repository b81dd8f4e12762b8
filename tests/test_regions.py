"""Blocks, fingerprints and windows that are made of whole files in one pass."""

import random
import time

import duckdb
import pytest

from treeledger.operators import clones, regions, select, similarity
from treeledger.plans import catalog

NAMES = ("q18_fingerprints", "q20_repeated_windows", "q21_maximal_windows", "q22_block_candidates", "q23_region_dedupe", "q24_cross_file_groups", "q27_clone_lines", "q28_partners")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Documents with empty, null and repeated rows, odd blanks and breaks, words of other scripts."""
    random.seed(4)
    words = ["x", "_a", "é1", "10", "Ωmega", "漢字", "+", " ", "b2", "\U0001d400z", "-", "1_"]
    lines = [" ".join(random.choices(words, k=random.randint(1, 30))) for _ in range(12)]
    text = lambda: "".join(random.choice([*lines, *lines, "", " \t　﻿"]) + random.choice(["\n", "\r\n", "\r"]) for _ in range(random.randint(1, 25)))
    rows = [(i, text()) for i in range(60)]
    rows[3] = (3, "\n".join([*lines, "", *lines[5:], " ", *lines[:6]]))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, ""), (103, None), (None, rows[3][1]), (104, "\n\n")]
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    con.execute(f"copy documents to '{folder}/documents.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_odd_files_equal_sql(spark, odd, name):
    folder, con = odd
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = catalog.QUERIES[name](spark, folder)
        columns = sorted(df.columns)
        got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = con.execute(catalog.SQL[name])
    at = [[c[0] for c in found.description].index(c) for c in columns]
    assert got == sorted(repr([r[i] for i in at]) for r in found.fetchall()) and got


@pytest.mark.parametrize("name", ("q24_cross_file_groups", "q27_clone_lines", "q23_region_dedupe", "q22_block_candidates", "q18_fingerprints", "q20_repeated_windows"))
def test_texts_are_read_once_and_no_token_is_an_expression(spark, odd, name):
    plan = catalog.QUERIES[name](spark, odd[0])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "lambda" not in plan and "Expand" not in plan


def test_long_texts_are_renamed_quickly():
    said = [f"w{i % 50_000}" for i in range(200_000)]
    began = time.perf_counter()
    names = regions.anonymous(said).split(" ")
    assert time.perf_counter() - began < 5 and names[:2] == ["$1", "$2"] and names[50_000:50_002] == ["$1", "$2"]


def test_quick_names_equal_the_expression(spark):
    random.seed(5)
    rows = [(i, random.choices(["a", "b_", "_", "7", "é", "+", "$1", "10a"], k=random.randint(1, 40))) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, said array<string>")
    got = {r.id: " ".join(r.name) for r in df.select("id", clones.anonymous(df.said).alias("name")).collect()}
    assert got == {i: regions.anonymous(said) for i, said in rows}


def test_selection_runs_files_in_one_task_and_equals_the_choice_of_each(spark):
    random.seed(6)
    rows = []
    for f in range(40):
        at = [(a, a + random.randint(0, 4)) for a in random.choices(range(30), k=25)]
        rows += [(f, random.choice("klmn"), a, b, b - a + 1) for a, b in at]
    df = spark.createDataFrame(rows, "file bigint, key string, first_line int, last_line int, n_tokens int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = select.select_regions(df)
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for f in range(40):
        own = sorted((r for r in rows if r[0] == f), key=lambda r: (r[2], r[3], r[1]))
        want += [own[i] for i in select.greedy([(k, str(f), a, b + 1, n) for _, k, a, b, n in own])]
    assert got == sorted(want) and found.schema.simpleString() == df.schema.simpleString()
    assert "FlatMapGroups" not in found._jdf.queryExecution().sparkPlan().toString()


def test_shared_grams_with_and_without_a_sent_list(spark, monkeypatch):
    random.seed(7)
    words = ["a", "B", "é", "c1", "_", "d-e"]
    text = lambda: " ".join(random.choices(words, k=random.randint(0, 12)))
    left, right = [[(i, text()) for i in range(30)] + [(30, None)] for _ in range(2)]
    right += right[:3]  # repeated rows count once
    grams = lambda t: {tuple(w[i : i + 5]) for w in [similarity.WORDS.findall(t.lower())] for i in range(len(w) - 4)} if t else set()
    want = {(a, b): n for a, s in left for b, t in right if (n := len(grams(s) & grams(t)))}
    frames = [spark.createDataFrame(rows, "id bigint, text string") for rows in (left, right)]
    for most in (similarity.MOST_GRAMS, 2):
        monkeypatch.setattr(similarity, "MOST_GRAMS", most)
        found = similarity.shared_ngrams(*frames)
        assert {(r.a, r.b): r.shared for r in found.collect()} == want and want
        assert "lambda" not in found._jdf.queryExecution().sparkPlan().toString()
