import datetime

from treeledger.streaming import landing


def test_measures_of_landed_files(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 30)
    rows = [("a.py", "python", "x = 1\n", at), ("b.py", "python", "def f():\n    return 1\n", at)]
    spark.createDataFrame(rows, landing.LANDED).write.parquet(str(tmp_path / "in"))
    files = landing.landed_files(spark, str(tmp_path / "in"))
    landing.measure_stream(files, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.file: (r.ncss, r.n_functions) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.py": (1, 0), "b.py": (2, 1)}


def test_hours(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 30)
    spark.createDataFrame([("a.py", "python", "x\ny", at), ("b.py", "go", "z", at)], landing.LANDED).write.parquet(str(tmp_path / "in"))
    hours = landing.lines_per_hour(landing.landed_files(spark, str(tmp_path / "in")))
    query = hours.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.language, r.files, r.lines) for r in spark.table("hours").collect()} == {("python", 1, 2), ("go", 1, 1)}
