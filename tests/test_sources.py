"""File formats, groups, splits, lists, sinks and the document stream."""

import uuid

import pytest
from pyspark.sql import functions as F

from rankloom.sources import corpus, datasets, sinks, text_formats
from rankloom.streaming.corpus_stream import read_documents, stream_corpus


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_svmlight(spark, tmp_path):
    path = write(tmp_path, "a.txt", "2 1:0.5 3:1.0\n0 2:1e-3 # note\n\n")
    rows = sorted(map(tuple, text_formats.read_svmlight(spark, path).collect()))
    assert rows == [(0.0, [0.0, 0.001, 0.0]), (2.0, [0.5, 0.0, 1.0])]
    wider = text_formats.read_svmlight(spark, path, n_features=4).first()
    assert len(wider["features"]) == 4
    zero = write(tmp_path, "b.txt", "1 0:0.5 2:1.0\n")
    assert text_formats.read_svmlight(spark, zero).first()["features"] == [0.5, 0.0, 1.0]
    assert text_formats.read_svmlight(spark, path, zero_based=True).first()["features"][0] == 0.0


def test_letor(spark, tmp_path):
    path = write(tmp_path, "l.txt", "2 qid:10 1:0.5 2:0.1 # doc-a\n0 qid:11 2:0.3\n")
    rows = {r["qid"]: r for r in text_formats.read_letor(spark, path).collect()}
    assert (rows["10"]["label"], rows["10"]["features"], rows["10"]["comment"]) == (
        2.0, {1: 0.5, 2: 0.1}, "doc-a",
    )
    assert (rows["11"]["features"], rows["11"]["comment"]) == ({2: 0.3}, "")


def test_raw_lines(spark, tmp_path):
    line = "1 id 0.75 3 0.2 f5 f6 f7 f8 f9 f10 f11 'how' #title u last\n"
    row = text_formats.read_ltr_lines(spark, write(tmp_path, "r.txt", line)).first()
    assert row.asDict() == {
        "label": "1", "cosine_score": "0.75", "search_order": "3", "ctr": "0.2",
        "query": "how", "title": "title",
    }


@pytest.mark.parametrize("bucket", [100_000, 3])
def test_groups_from_sizes(spark, tmp_path, bucket):
    sizes = text_formats.read_group_sizes(spark, write(tmp_path, "g.txt", "2\n7\n0\n1\n"))
    assert sorted(map(tuple, sizes.collect())) == [(0, 2), (1, 7), (2, 0), (3, 1)]
    rows = spark.range(10).select(F.col("id").alias("row_index"), (F.col("id") * 2).alias("x"))
    found = datasets.assign_groups(rows, sizes, bucket=bucket).orderBy("row_index").collect()
    assert [r["query_id"] for r in found] == [0] * 2 + [1] * 7 + [3]
    assert [r["x"] for r in found] == list(range(0, 20, 2))
    back = datasets.group_sizes(datasets.assign_groups(rows, sizes)).orderBy("query_id")
    assert [r["size"] for r in back.collect()] == [2, 7, 1]


def test_numbered_lines_over_several_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}").write_text("".join(f"{i}-{j}\n" for j in range(4 + 5 * i)))
    lines = text_formats.number_lines(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [r["value"] for r in lines] == [f"{i}-{j}" for i in range(3) for j in range(4 + 5 * i)]
    assert [r["row_index"] for r in lines] == list(range(27))


def test_splits(spark):
    df = spark.range(105).withColumnRenamed("id", "doc_id")
    tail = [r["doc_id"] for r in datasets.tail_split(df).orderBy("doc_id").collect()]
    assert tail == list(range(94, 105))
    train, test = datasets.train_test_split(df, 10, 12, "doc_id")
    assert (train.count(), test.count()) == (95, 10)
    assert train.intersect(test).count() == 0
    again = datasets.train_test_split(df.repartition(7), 10, 12, "doc_id")[1]
    assert again.exceptAll(test).count() == 0
    assert datasets.train_test_split(df, 0, 12, "doc_id")[1].count() == 0
    assert datasets.train_test_split(df, 200, 12, "doc_id")[1].count() == 105
    sizes = datasets.assign_batches(df, 10, 1, "doc_id", exact=True).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in sizes) == [5] + [10] * 10


def test_lists(spark):
    lists = spark.createDataFrame(
        [(1, ["a", "b", "c"], [1.0, 0.0, 2.0]), (2, ["d"], [0.0])],
        "query_id long, docs array<string>, labels array<double>",
    )
    flat = datasets.explode_lists(lists)
    assert flat.count() == 4
    back = datasets.collect_lists(flat).drop("part", "start")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, lists.collect()))
    parts = datasets.collect_lists(flat, items=2).orderBy("query_id", "part").collect()
    assert [(r["query_id"], r["part"], r["docs"]) for r in parts] == [
        (1, 0, ["a", "b"]), (1, 1, ["c"]), (2, 0, ["d"]),
    ]
    assert datasets.validate_lists(lists).count() == 0
    broken = lists.withColumn("labels", F.slice("labels", 1, 1))
    assert [tuple(r) for r in datasets.validate_lists(broken).collect()] == [(1, 3, 1)]
    with pytest.raises(ValueError):
        datasets.validate_lists(lists.withColumn("labels", F.lit(1)))
    with pytest.raises(ValueError):
        datasets.validate_lists(lists.drop("docs"))


def test_samples(spark):
    wide = spark.createDataFrame([("q", "p", "d1", "p", None)], "question string, answer string, a string, b string, c string")
    samples = datasets.to_rerank_samples(wide, "question", "answer")
    assert samples.first().asDict() == {"query": "q", "positive": ["p"], "documents": ["d1", "p"]}
    listed = wide.select("question", "answer", F.array("a", "b", "c").alias("docs"))
    assert datasets.to_rerank_samples(listed, "question", "answer", "docs").collect() == samples.collect()
    labels = datasets.label_by_membership(samples).orderBy("pos").collect()
    assert [(r["document"], r["label"]) for r in labels] == [("d1", 0), ("p", 1)]


def test_ranked_sink(spark, tmp_path):
    row = ("1", "0.2", 0.75, "how", "title", "3", 1)
    df = spark.createDataFrame([row], "label string, ctr string, cosine_score double, query string, title string, search_order string, new_order int")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        sinks.write_ranked(df, path, fmt)
        back = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
        assert tuple(back.columns) == sinks.RANKED_COLUMNS
        assert [str(v) for v in back.first()] == [str(v) for v in row]


def length(df):
    return df.withColumn("embedding", F.array(F.length("text").cast("float")))


def test_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id long, text string")
    new = spark.createDataFrame([(3, "ccc")], "doc_id long, text string")
    built = corpus.build_corpus(docs, length)
    appended = corpus.append_corpus(built, new, length).orderBy("doc_id").collect()
    assert [r["embedding"] for r in appended] == [[1.0], [2.0], [3.0]]
    path = str(tmp_path / "corpus")
    corpus.write_corpus(built, path)
    corpus.write_corpus(corpus.build_corpus(new, length), path, mode="append")
    assert corpus.read_corpus(spark, path).count() == 3
    corpus.clear_corpus(spark, path)
    assert corpus.read_corpus(spark, path).count() == 0
    assert corpus.read_corpus(spark, path).columns == ["doc_id", "text", "embedding"]


def test_streamed_corpus_resumes(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id long, text string")
    name = f"docs-{uuid.uuid4().hex}"
    for rows, total in ((docs, 2), (docs.withColumn("doc_id", F.col("doc_id") + 10), 4)):
        rows.write.mode("append").parquet(source)
        run = stream_corpus(read_documents(spark, source, docs.schema), length, target, name)
        run.awaitTermination()
        assert corpus.read_corpus(spark, target).count() == total


def test_long_lists_go_on_in_parts(spark):
    rows = [(q, i, f"d{i}", float(i)) for q in (1, 2) for i in range(11)]
    flat = spark.createDataFrame(rows, "query_id long, pos long, doc string, label double")
    parts = datasets.collect_lists(flat, items=5)
    assert sorted(map(tuple, datasets.explode_lists(parts).collect())) == sorted(rows)
    broken = parts.withColumn("labels", F.slice("labels", 1, 4))
    assert sorted((r["query_id"], r["part"]) for r in datasets.validate_lists(broken).collect()) == [
        (1, 0), (1, 1), (2, 0), (2, 1)]


def test_features_beyond_the_width_are_an_error(spark):
    from rankloom.functions.vectors import densify

    df = spark.sql("select map(1, 1D, 5, 9D) as features")
    assert df.select(densify(F.col("features"), 5)).first()[0] == [1, 0, 0, 0, 9]
    for width in (3, 4):
        with pytest.raises(Exception, match="feature index"):
            df.select(densify(F.col("features"), width)).collect()


def test_streamed_corpus_reads_a_table_of_many_files(spark, tmp_path):
    from rankloom.catalog import QUERIES

    rows = [(1, "one two"), (1, "one two"), (2, ""), (None, "three"), (3, None), *[(i, "x " * i) for i in range(4, 30)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    for _ in range(2):  # a second run is a corpus of its own
        got = QUERIES["streamed_corpus"](spark, str(tmp_path)).collect()
        whole = [(i, x if x is None else float(len(x))) for i, x in rows]
        assert sorted(((r["doc_id"], r["chars"]) for r in got), key=repr) == sorted(whole, key=repr)
