import subprocess

from treeledger import cli

GOOD = "def f(a):\n    return a\n"
DEEP = "def f(a):\n" + "".join(f"{'    ' * (i + 1)}if a > {i}:\n" for i in range(5)) + "    " * 6 + "return a\n"


def test_exit_codes_of_a_work_tree(spark, tmp_path, capsys):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    (tmp_path / "a.py").write_text(GOOD)
    (tmp_path / "old.py").write_text("x = 1\ny = 2\n")
    run("init", "-b", "main"), run("add", "."), run("commit", "-m", "x")
    run("mv", "old.py", "moved.py")
    (tmp_path / "a.py").write_text(DEEP)
    assert cli.main(["diff", "main", str(tmp_path)]) == 1
    said = capsys.readouterr().out
    assert "a.py:1 f: cognitive complexity worsened 0 -> 15" in said and "moved.py" not in said

    (tmp_path / "a.py").write_text(GOOD)
    (tmp_path / "broken.py").write_text("def (")
    (tmp_path / "new.ts").write_text("let x = 1\n")
    assert cli.main(["diff", "main", str(tmp_path)]) == 2
    out, said = capsys.readouterr()
    assert out == "" and "broken.py: " in said and "new.ts: functions are not measured in typescript" in said

    assert cli.main(["diff", "nowhere", str(tmp_path)]) == 2
    (tmp_path / "treeledger.json").write_text('{"gates": {}}')
    assert cli.main(["diff", "main", str(tmp_path)]) == 2 and "unknown key gates" in capsys.readouterr().err
