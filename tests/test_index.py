import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import codecs as C
from lexmill.operators import index as I  # noqa: E741
from lexmill.sources import files


def test_known_codes(spark):
    df = spark.createDataFrame([([824, 829, 215406],)], "ids array<bigint>")
    assert df.select(F.hex(C.vb_encode(F.col("ids")))).first()[0] == "06B8850D0CB1"
    df = spark.createDataFrame([([0, 1, 13, 36],)], "ids array<bigint>")
    assert df.select(C.gamma_bits(F.col("ids"))).first()[0] == "0" + "100" + "1110101" + "111101000"
    assert df.select(F.hex(C.gamma_encode(F.col("ids")))).first()[0] == "4EBE8F"


def test_round_trips(spark):
    rng = random.Random(3)
    lists = [sorted(rng.sample(range(10 ** rng.randint(1, 7) + 50), rng.randint(0, 50))) for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<bigint>")
    coded = df.select("i", C.vb_encode(F.col("ids")).alias("v"), C.gamma_encode(F.col("ids")).alias("g")).collect()
    back = spark.createDataFrame(coded, "i int, v binary, g binary").select("i", C.vb_decode("v").alias("v"), C.gamma_decode("g").alias("g"))
    for r in back.collect():
        assert list(r.v) == lists[r.i] == list(r.g)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**27), max_size=20))
def test_decoders_invert_a_plain_encoder(numbers):
    vb = b"".join(bytes([*((n >> 7 * k) & 127 for k in range(max(n.bit_length() - 1, 0) // 7, 0, -1)), (n & 127) + 128]) for n in numbers)
    assert [x.tolist() for x in C.vb_numbers([vb, b"", vb[:-1] if numbers else b"", vb])][0] == numbers + numbers[:-1] + numbers
    assert C.vb_numbers([vb])[0].tolist() == numbers
    bits = "".join("1" * (len(f"{n + 1:b}") - 1) + "0" + f"{n + 1:b}"[1:] for n in numbers)
    full = bits.ljust(-(-len(bits) // 8) * 8, "1")
    code = bytes(int(full[i : i + 8], 2) for i in range(0, len(full), 8))
    values, of = C.gamma_numbers([b"", code, b"\xff", code])
    assert values.tolist() == numbers + numbers and of.tolist() == [1] * len(numbers) + [3] * len(numbers)


def test_conjunctive_search(spark):
    words = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "never")], "word_id int, term string")
    occ = spark.createDataFrame([("x", t, d) for t, d in [(0, 1), (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]], "block string, term_id int, doc_id long")
    names = spark.createDataFrame([(d, f"x/{d}") for d in (1, 2, 3)], "doc_id long, doc_name string")
    queries = spark.createDataFrame([("a b",), ("a b c a",), ("a",), ("a nowhere",), ("never a",), ("",), (None,)], "query string")
    got = sorted((r["query"], r.doc_name) for r in I.boolean_answers(queries, words, I.postings(occ), names).collect())
    assert got == [("", I.NO_RESULT), ("a", "x/1"), ("a", "x/2"), ("a", "x/3"), ("a b", "x/2"), ("a b", "x/3"), ("a b c a", "x/3"), ("a nowhere", I.NO_RESULT), ("never a", I.NO_RESULT)]


def test_postings_and_block_union_agree(spark):
    rows = [("p" if d % 2 else "q", d % 5, d) for d in range(200) for _ in range(1 + d % 2)]
    occ = spark.createDataFrame(rows, "block string, term_id int, doc_id long")
    one = {r.term_id: (r.cf, r.df, list(r.doc_ids)) for r in I.postings(occ).collect()}
    two = {r.term_id: (r.cf, r.df, list(r.doc_ids)) for r in I.merge_blocks(I.postings(occ, "block")).collect()}
    assert one == two
    assert one[0] == (60, 40, list(range(0, 200, 5)))


def test_corpus_folder_and_dictionaries(spark, tmp_path):
    for block, name, text in [("b", "2.txt", "beta alpha"), ("a", "1.txt", "alpha  Alpha\nbeta"), ("b", "1 x.txt", "")]:
        (tmp_path / block).mkdir(exist_ok=True)
        (tmp_path / block / name).write_text(text)
    rows = files.read_corpus(spark, str(tmp_path)).withColumn("doc_id", F.lit(0).cast("bigint"))
    docs = I.document_dictionary(rows.select("block", "doc_name", "doc_id"))
    assert [(r.doc_no, r.doc_name) for r in docs.orderBy("doc_no").collect()] == [(0, "a/1.txt"), (1, "b/1 x.txt"), (2, "b/2.txt")]
    numbered = rows.drop("doc_id").join(docs.select("doc_name", F.col("doc_no").alias("doc_id")), "doc_name")
    terms = I.term_dictionary(I.document_tokens(numbered))
    assert [r.term for r in terms.orderBy("term_id").collect()] == ["alpha", "Alpha", "beta"]


def test_index_is_written_and_read(spark, tmp_path):
    occ = spark.createDataFrame([("x", 0, 1), ("x", 1, 1)], "block string, term_id int, doc_id long")
    files.write_index(str(tmp_path / "i"), spark.createDataFrame([(1, "x/1")], "doc_id long, doc_name string"), spark.createDataFrame([(0, "a"), (1, "b")], "term_id int, term string"), I.postings(occ))
    docs, terms, posts = files.read_index(spark, str(tmp_path / "i"))
    assert (docs.count(), terms.count(), posts.count()) == (1, 2, 2)


def test_conjunctive_search_broadcasts_no_postings(spark):
    """The documents of postings are far more than the bytes of the arrays that Spark rates them by."""
    words = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "word_id int, term string")
    occ = spark.createDataFrame([("x", t, d) for t in range(3) for d in range(60) if d % (t + 1) == 0], "block string, term_id int, doc_id long")
    got = I.boolean_and(spark.createDataFrame([("a b c",), ("c",), ("a z",), ("b a b",)], "query string"), words, I.postings(occ))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r in got.collect():
        by.setdefault(r.query, []).append(r.doc_id)
    assert {q: sorted(d) for q, d in by.items()} == {"a b c": list(range(0, 60, 6)), "c": list(range(0, 60, 3)), "b a b": list(range(0, 60, 2))}
