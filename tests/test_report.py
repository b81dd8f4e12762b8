import json

from treeledger.plans import measure, rank, report

FILES = "file string, language string, code string"


def test_ranking_report(spark):
    files = spark.createDataFrame([("a.py", "python", "def f(a):\n    if a:\n        return 1\n"), ("b.py", "python", "x = 1\n"), ("c.py", "python", "def (")], FILES)
    parsed = measure.parse(files)
    made = json.loads(report.ranking_json(rank.rank_files(files, 1), measure.file_metrics(parsed), measure.issues(parsed), 1))
    assert made["summary"] == {"files": 3, "functions": 1, "codeLines": 5, "maxCognitiveComplexity": 1, "ncss": 4}
    assert made["totalRankedFiles"] == 3 and made["truncated"] and [f["file"] for f in made["files"]] == ["a.py"] and len(made["errors"]) == 1
    said = report.ranking_text(made | {"errors": ["e"] * 12}).splitlines()
    assert said[1].startswith("1. a.py") and said[-1] == "... and 2 more errors"


def test_violation_lines(spark):
    rows = spark.createDataFrame([("a.py", 3, "f", "NCSS", 1.0, 9.0, 6.0), ("b.py", 1, None, "duplicated lines", None, 4.0, 0.0)], "file string, start_line int, function string, metric string, base_value double, head_value double, allowed double")
    assert report.violation_lines(rows) == ["a.py:3 f: NCSS worsened 1 -> 9 (allowed <= 6)", "b.py:1 : duplicated lines 4 (allowed <= 0)"]
