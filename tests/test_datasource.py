"""The svmlight and LETOR data sources: byte ranges, schemas, round trips, commits."""

import math

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from rankloom.sources import datasource
from rankloom.sources.datasource import ByteRange, format_line, lines_of, parse_line

TEXT = "2 qid:10 1:0.5 2:0.1 # doc-a\n\n# only a comment\n0.5 qid:x 3:-1e-7\n1 qid:10\r\n3 qid:10 7:1e300 # ü # b"


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    datasource.register(spark)


def test_lines_of_every_cut(tmp_path, monkeypatch):
    """Each line is read once, whatever the ranges and read sizes."""
    path = tmp_path / "lines.txt"
    path.write_bytes(TEXT.encode())
    size, store = path.stat().st_size, fs.LocalFileSystem()
    for step in (1, 2, 7, 30, 1000):
        for block in (1, 5, 1 << 20):
            monkeypatch.setattr(datasource, "READ_BYTES", block)
            found = []
            for start in range(0, size, step):
                found += lines_of(store, ByteRange(str(path), start, min(start + step, size)))
            assert found == TEXT.split("\n")


def test_lines_are_read_back():
    for row in [(1.0, "q", [(1, 0.1), (9, 1e-320)], "a b"), (-0.0, None, [], ""), (math.pi, "1", [(2, math.inf)], "# x")]:
        assert parse_line(format_line(*row)) == row
    assert parse_line("   # x") is None and parse_line("") is None


def test_letor_with_inferred_schema(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    (tmp_path / "_hidden.txt").write_text("9 1:1")
    for fmt in ("letor", "svmlight"):
        df = spark.read.format(fmt).option("partitionBytes", 11).load(str(tmp_path))
        assert df.dtypes == [("label", "double"), ("qid", "string"), ("features", "map<int,double>"), ("comment", "string")]
        rows = {r["label"]: (r["qid"], r["features"], r["comment"]) for r in df.collect()}
        assert rows == {2.0: ("10", {1: 0.5, 2: 0.1}, "doc-a"), 0.5: ("x", {3: -1e-7}, ""), 1.0: ("10", {}, ""),
                        3.0: ("10", {7: 1e300}, "ü # b")}
        assert df.rdd.getNumPartitions() > 5
    assert df.select("qid").distinct().count() == 2


def test_svmlight_as_arrays(spark, tmp_path):
    path = str(tmp_path / "svm")
    rows = [(float(i), [i / 3, 0.0, -float(i)]) for i in range(50)]
    df = spark.createDataFrame(rows, "label double, features array<double>").repartition(4)
    for zero_based in ("false", "true"):
        df.write.format("svmlight").option("zeroBased", zero_based).mode("overwrite").save(path)
        options = {"numFeatures": 3, "partitionBytes": 100, "zeroBased": zero_based}
        back = spark.read.format("svmlight").options(**options).load(path)
        assert back.dtypes == [("label", "double"), ("features", "array<double>")]
        assert sorted((r["label"], r["features"]) for r in back.collect()) == rows
    assert not list((tmp_path / "svm").glob("_writing*")) and (tmp_path / "svm" / "_SUCCESS").exists()
    df.write.format("svmlight").mode("append").save(path)
    assert spark.read.format("svmlight").option("numFeatures", 4).option("zeroBased", "true").load(path).count() == 100
    with pytest.raises(Exception, match="outside"):
        spark.read.format("svmlight").option("numFeatures", 2).option("zeroBased", "true").load(path).collect()


def test_failed_writes_leave_earlier_files(spark, tmp_path):
    path = str(tmp_path / "kept")
    good = spark.createDataFrame([(1.0, {2: 0.5})], "label double, features map<int,double>")
    good.write.format("svmlight").mode("overwrite").save(path)
    bad = good.unionByName(good).repartition(2).withColumn(
        "label", F.when(F.rand() >= 0, F.raise_error(F.lit("stop"))).cast("double"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("svmlight").mode("overwrite").save(path)
    assert spark.read.format("svmlight").load(path).count() == 1
    assert not list((tmp_path / "kept").glob("_writing*"))


def test_empty_tables_and_folders(spark, tmp_path):
    path = str(tmp_path / "none")
    none = spark.createDataFrame([], "label double, qid string, features map<int,double>, comment string")
    none.write.format("letor").mode("overwrite").save(path)
    assert spark.read.format("letor").load(path).count() == 0
    with pytest.raises(Exception):
        spark.read.format("letor").load(str(tmp_path / "absent")).count()
