import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators.bad_rows import strict_load

GOOD = 'q a,http://x/y,title,spark 3 10;join 4,120,3,docs,2'


def load(spark, lines, schema="line_id long, line_text string"):
    return strict_load(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], schema))


def reasons(spark, lines):
    out = {}
    for r in load(spark, lines).rejected.collect():
        out.setdefault(r.line_id, set()).add(r.reason)
    return out


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        (GOOD, set()),
        ('"q, ""a""",http://x,"t\nu",,5,0,,', set()),
        ("q,u,t, spark  3 ; join 04 ,10, 010 , a , 0000002147483647 ", set()),
        ("q,u,t,,5,0,   ,  ", set()),
        ("", {"columns"}),
        (None, {"columns"}),
        ("a,b", {"columns"}),
        (GOOD + ",x", {"columns"}),
        ('"q,u,t,,5,0,,', {"quoting"}),
        ('"q"x,u,t,,5,0,,', {"quoting"}),
        ('q"x,u,t,,5,0,,', {"quoting"}),
        ('q,u,t,,5,0, "a",1', {"quoting"}),
        ('"', {"quoting"}),
        ("q,u,t,spark,5,0,,", {"body_hits"}),
        ("q,u,t,spark 3;;join 4,5,0,,", {"body_hits"}),
        ("q,u,t,spark 3 3,5,0,,", {"body_hits"}),
        ("q,u,t,spark 6,5,0,,", {"body_hits"}),
        ("q,u,t,spark 99999999999999999999999,5,0,,", {"body_hits"}),
        ("q,u,t,spark ٣,5,0,,", {"body_hits"}),
        ("q,u,t,,5,11,,", {"pagerank"}),
        ("q,u,t,,5,,,", {"pagerank"}),
        ("q,u,t,,5,1 ,,", {"pagerank"}),
        ("q,u,t,,5,0,a,", {"stanford_anchor_count"}),
        ("q,u,t,,5,0,a,0", {"stanford_anchor_count"}),
        ("q,u,t,,5,0,a,2147483648", {"stanford_anchor_count"}),
        ("q,u,t,,5,0,,3", {"stanford_anchor_count"}),
        ("q,u,t,x,5,-1,a,b", {"body_hits", "pagerank", "stanford_anchor_count"}),
        ("\x01\x02a\x02b,u,t,,5,0,,", set()),
        ("q,u,t,spark 3 2999999999,3000000000,3,docs,2", set()),
        ("q,u,t,spark 3,9223372036854775807,3,docs,2", set()),
        ("q,u,t,spark 3,00000000000000000000000000000012,3,docs,2", set()),
        ("q,u,t,spark 3,9223372036854775808,3,docs,2", {"body_length"}),
        ("q,u,t,spark 99999999999999999998 99999999999999999999,99999999999999999999,3,docs,2", {"body_length"}),
        ("q,u,t,spark 99999999999999999999 100000000000000000000,99999999999999999999,3,docs,2", {"body_hits", "body_length"}),
        ("q,u,t,,abc,3,docs,2", {"body_length"}),
        ("q,u,t,,5,99999999999999999999,,", {"pagerank"}),
    ],
)
def test_reasons(spark, line, expected):
    assert reasons(spark, [line]).get(0, set()) == expected


def test_typed_records_and_marks_survive(spark):
    r = load(spark, ['"q ""x"", y",u\x01\x02a,t,spark 3 010;join 4,120,03,docs,2']).valid.collect()[0]
    assert (r["query"], r.url, r.body_length, r.pagerank, r.anchor_text, r.stanford_anchor_count) == ('q "x", y', "u\x01\x02a", 120, 3, "docs", 2)
    assert [(h.term, h.positions) for h in r.body_hits] == [("spark", [3, 10]), ("join", [4])]


def test_every_line_comes_out_once(spark):
    rng = random.Random(5)
    lines = [GOOD if rng.random() < 0.5 else "".join(rng.choice('a",; 1\n') for _ in range(rng.randint(0, 40))) for _ in range(300)]
    done = load(spark, lines)
    valid, bad = {r.line_id for r in done.valid.collect()}, {r.line_id for r in done.rejected.collect()}
    assert not valid & bad
    assert valid | bad == set(range(300))


def test_no_value_aborts_a_load(spark):
    """Generated lines of eight fields with numbers of any size, and stray quotes: valid and rejected part the input, and all of it can be read."""
    rng = random.Random(17)

    def number():
        if rng.random() < 0.6:
            return str(rng.randint(0, 10))
        return rng.choice(["", "0", "7", "007", "-1", "+1", "1e3", "abc", " 5 ", str(rng.randint(0, 99)), str(2**31 - 1), str(2**31), str(2**63 - 1), str(2**63), "9" * rng.randint(17, 45), "0" * 40 + "3", "٣"])

    def line():
        hits = ";".join(" ".join(["t", *sorted((number() for _ in range(rng.randint(1, 3))), key=len)]) for _ in range(rng.randint(0, 2)))
        fields = [rng.choice(["q", '"q"', '"q', 'q"']) if rng.random() < 0.2 else "q", "u", "t", hits, number(), number(), rng.choice(["", "docs"]), number()]
        return ",".join(fields)

    lines = [line() for _ in range(1500)]
    done = load(spark, lines)
    valid, bad = done.valid.collect(), {r.line_id for r in done.rejected.collect()}
    good = {r.line_id for r in valid}
    assert not good & bad and good | bad == set(range(len(lines))) and len(good) > 20
    for r in valid:
        assert r.body_length is not None and r.pagerank is not None
        assert all(p is not None and p <= r.body_length for h in r.body_hits for p in h.positions)


def test_long_line(spark):
    quotes = '"' + '""' * 200_000 + '",u,t,,5,0,,'
    hits = "q,u,t," + ";".join(f"t{i} 1" for i in range(20_000)) + ",5,0,,"
    assert reasons(spark, [quotes, hits]) == {}


def test_null_and_repeated_offsets(spark):
    rows = [(None, GOOD), (1, GOOD), (1, GOOD), (1, "bad"), (2, "bad"), (2, "bad")]
    done = strict_load(spark.createDataFrame(rows, "line_id long, line_text string"))
    assert sorted((str(r.line_id), r.reason) for r in done.rejected.collect()) == [("1", "columns"), ("2", "columns"), ("None", "offset")]
    assert [r.line_id for r in done.valid.collect()] == [1, 1]


def test_empty_table_and_clashing_columns(spark):
    empty = load(spark, [])
    assert empty.valid.count() == empty.rejected.count() == 0
    df = spark.createDataFrame([(1, GOOD), (2, "x")], "line_id long, line_text string")
    for c in ("query", "__id", "__line", "reason", "__ok", "k"):
        df = df.withColumn(c, F.lit("z"))
    done = strict_load(df)
    assert [tuple(r) for r in done.rejected.collect()] == [(2, "columns")]
    assert done.valid.first()["query"] == "q a"
