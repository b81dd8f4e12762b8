"""Every query with SQL gives DuckDB's rows, on the smallest tables."""

import os

import duckdb
import pytest

from treeledger.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def said(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(said, value)) + "]"
    return repr(value)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted("|".join(said(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalog.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted("|".join(said(r[i]) for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() >= 0


def test_entry_without_the_pipeline_package(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    (tmp_path / "treeledger").mkdir()
    for p in (root / "treeledger").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "treeledger" / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 40 and set(e.oracle_sql()) <= set(q)"
    (tmp_path / "run.py").write_text(f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}")
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    done = subprocess.run([sys.executable, "-B", "-I", str(tmp_path / "run.py")], capture_output=True, text=True, cwd=tmp_path)
    assert done.returncode == 0, done.stderr
