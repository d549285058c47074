from lexmill.operators.index import NO_RESULT, postings
from lexmill.streaming.search import answer_stream


def test_a_stream_of_queries_is_answered(spark, tmp_path):
    words = spark.createDataFrame([(0, "a"), (1, "b")], "word_id int, term string")
    occ = spark.createDataFrame([("x", 0, 1), ("x", 1, 1), ("x", 0, 2)], "block string, term_id int, doc_id long")
    names = spark.createDataFrame([(1, "x/1"), (2, "x/2")], "doc_id long, doc_name string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text("a b\nb c\n\n")
    asked = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "query")
    run = answer_stream(asked, words, postings(occ), names, str(tmp_path / "out"), str(tmp_path / "cp"))
    run.processAllAvailable()
    run.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["query"], r.doc_name) for r in got.collect()) == [("a b", "x/1"), ("b c", NO_RESULT)]
