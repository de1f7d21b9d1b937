from pyspark.sql import functions as F

from sparkloom.sources import readers, writers


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_jsonl_and_conversations(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"messages": ["x"]}\n\n{"messages": ["y", "z"]}\n')
    rows = readers.conversations(readers.jsonl(spark, str(tmp_path)))
    assert sorted(len(r.conversations) for r in rows.collect()) == [1, 2]


def test_csv_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,n\nx,1\n")
    assert readers.csv(spark, str(tmp_path / "a.csv"), ["name"]).count() == 1
    try:
        readers.csv(spark, str(tmp_path / "a.csv"), ["other"])
        raise AssertionError
    except ValueError:
        pass
    (tmp_path / "b.csv").write_bytes("a,b,c,d\né\n".encode("latin-1"))
    rows = readers.headless_csv(spark, str(tmp_path / "b.csv"), ["p", "q", "r"]).collect()
    assert {tuple(r) for r in rows} == {("a", "b", "c"), ("é", "", "")}


def test_crawl_and_texts(spark, tmp_path):
    for name, data in (("a.txt", "one two".encode()), ("b.png", b"x"), ("skip/c.md", b"y"), ("d.md", "é".encode("latin-1"))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: (r.text, r.word_count) for r in readers.texts(readers.crawl(spark, str(tmp_path), ("skip",))).collect()}
    assert rows == {"a.txt": ("one two", 2), "d.md": ("é", 1)}


def test_log_filters_pass_what_they_cannot_read(spark):
    rows = lines(spark, "2024-01-02 10:00:00 INFO gateway.run: up", "2024-01-01 10:00:00 ERROR [s1] agent: x", "no time here", "2024-01-02 10:00:00 DEBUG gateway: y")
    kept = [r.value for r in readers.log_filter(rows, since="2024-01-02 00:00:00", level="INFO").collect()]
    assert kept == ["2024-01-02 10:00:00 INFO gateway.run: up", "no time here"]
    assert readers.log_filter(rows, component="gateway").count() == 2


def test_parallel_arrays_and_notebooks(spark):
    rows = spark.createDataFrame([(1, [1, 2], ["a"])], "k int, x array<int>, y array<string>")
    assert sorted(tuple(r) for r in readers.parallel_arrays(rows, ["x", "y"]).collect()) == [(1, 1, "a"), (1, 2, None)]
    nb = lines(spark, '{"cells": [{"cell_type": "code", "source": ["a\\n", "b"]}, {"cell_type": "markdown", "source": ["c"]}]}')
    assert nb.select(readers.notebook_text(F.col("value")).alias("t")).first().t == "a\nb\nc"
    assert lines(spark, '{"a": {"b": 3}}').select(readers.dig(F.col("value"), "a.b").alias("v")).first().v == "3"


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><guid>1</guid><title>t</title></item><item><title>none</title></item><item><link>u</link></item></channel></rss>")
    assert sorted(r.id for r in readers.feed(spark, str(tmp_path / "f.xml")).collect()) == ["1", "u"]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 2 == 0) for k in range(10)], "id int, completed boolean")
    writers.jsonl_by_outcome(rows, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o" / "completed=true")).count() == 5
    writers.jsonl_batches(rows, str(tmp_path / "b"), 4, ["id"])
    assert len(list((tmp_path / "b").glob("batch=*/part-*"))) == 3
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "id int, v string, created_at string")
    new = spark.createDataFrame([(2, None, "t1"), (3, "c", "t1")], "id int, v string, created_at string")
    assert sorted(tuple(r) for r in writers.upsert(old, new, "id").collect()) == [(1, "a", "t0"), (2, "b", "t0"), (3, "c", "t1")]
    assert [r.id for r in writers.insert_new(old, new, "id").collect()] == [3]
    cards = spark.createDataFrame([("q", "a", " "), ("", "a", "x")], "front string, back string, collection string")
    assert [tuple(r) for r in writers.imported_cards(cards, "d").collect()] == [("q", "a", "d")]
