from treeledger.plans import gate, rank

FILES = "file string, language string, code string"
SIMPLE = "def f(a):\n    return a\n\ndef g(b):\n    return b + 1\n"
NESTED = "def f(a):\n" + "".join(f"{'    ' * (i + 1)}if a > {i}:\n" for i in range(4)) + "                    return a\n    return 0\n"


def values(rows):
    return {(r.gate, r.metric, r.function, r.head_value, r.allowed) for r in rows}


def test_matched_function_that_worsens(spark):
    base = spark.createDataFrame([("a.py", "python", SIMPLE)], FILES)
    head = spark.createDataFrame([("a.py", "python", NESTED + "\ndef g(b):\n    return b + 1\n")], FILES)
    got = values(gate.evaluate(base, head).collect())
    assert ("function-regression", "cognitive complexity", "f", 10.0, 2.0) in got
    assert ("function-regression", "max nesting depth", "f", 4.0, 1.0) in got
    assert {g[2] for g in got} == {"f"}


def test_unchanged_and_renamed_functions_pass(spark):
    base = spark.createDataFrame([("a.py", "python", SIMPLE + NESTED.replace("def f", "def deep"))], FILES)
    head = spark.createDataFrame([("a.py", "python", SIMPLE + NESTED.replace("def f", "def other"))], FILES)
    assert gate.evaluate(base, base).collect() == []
    assert gate.evaluate(base, head).collect() == []


def test_new_function_beyond_the_limits(spark):
    deep = "def n(a):\n" + "".join(f"{'    ' * (i + 1)}if a > {i}:\n" for i in range(6)) + "    " * 7 + "return a\n"
    base = spark.createDataFrame([("a.py", "python", "x = 1\n")], FILES)
    head = spark.createDataFrame([("a.py", "python", "x = 1\n" + deep)], FILES)
    assert values(gate.evaluate(base, head).collect()) == {("new-function", "cognitive complexity", "n", 21.0, 15.0), ("new-function", "max nesting depth", "n", 6.0, 4.0)}


def test_copied_block_is_new_duplication(spark):
    block = "".join(f"    total = total + {w} * {w}\n" for w in "abcdefgh")
    base = spark.createDataFrame([("a.py", "python", f"def f(total):\n{block}    return total\n"), ("b.py", "python", "x = 1\n")], FILES)
    head = spark.createDataFrame([("a.py", "python", f"def f(total):\n{block}    return total\n"), ("b.py", "python", f"def f(total):\n{block}    return total\n")], FILES)
    got = values(gate.evaluate(base, head).collect())
    assert got == {("duplication", "duplicated lines", None, 10.0, 0.0)}


def test_exit_codes():
    assert [gate.exit_code(*x) for x in ((0, 0), (2, 0), (2, 1), (0, 1))] == [0, 1, 2, 2]


def test_ranking(spark):
    files = spark.createDataFrame([("a.py", "python", SIMPLE), ("b.py", "python", NESTED), ("c.py", "python", "x = 1\n")], FILES)
    got = rank.rank_files(files, top=2).collect()
    assert [r.file for r in got] == ["b.py", "a.py"] and got[0].worst_function.cognitive == 10
