import random
from collections import defaultdict

from pyspark.sql import functions as F

from lexmill.operators.positions import POS, RUN, global_positions, running_name
from lexmill.operators.skewed_keys import compress, join_held, key_percentiles, key_summary, wrong_doc_freq


def test_positions_match_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None, f"k{i % 50}"]), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i long, w int")
    got = {(r.g, r.i): (r[POS], r[RUN], r[running_name(1)]) for r in global_positions(df.withColumn("v", F.lit(2)), ["g"], [F.col("i").desc()], weight=["w", "v"]).collect()}
    groups = defaultdict(list)
    for g, i, w in rows:
        groups[g].append((i, w))
    for g, items in groups.items():
        run = 0
        for at, (i, w) in enumerate(sorted(items, reverse=True), 1):
            run += w
            assert got[(g, i)] == (at, run, 2 * at)


def test_keep_gives_the_first_of_each_group(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 700) END AS g", "id")
    got = global_positions(df, ["g"], [F.col("id").asc()], keep=4)
    assert got.where(f"{POS} > 4").count() == 0
    assert sorted(r.id for r in got.where("g = 'hot'").collect()) == [0, 3, 6, 9]


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, i long")
    assert global_positions(df, ["g"], [F.col("i").asc()]).count() == 0


def test_key_summaries_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 1, 2, None]), rng.choice([None, *range(9)])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "key int, value int").withColumn("weight", F.lit("clash"))
    c = compress(df, "key", "value")
    held = defaultdict(list)
    for k, v in rows:
        if k is not None and v is not None:
            held[k].append(v)
    for r in key_summary(c).collect():
        vs = held[r.key]
        assert (r.n_rows, r.n_distinct, r.mode) == (len(vs), len(set(vs)), min(set(vs), key=lambda v: (-vs.count(v), v)))
    for r in key_percentiles(c, [0.0, 0.5, 1.0]).collect():
        vs = sorted(held[r.key])
        assert r.value == vs[max(-(-int(r.fraction * 2 * len(vs)) // 2), 1) - 1]


def test_doc_freq_check(spark):
    td = spark.createDataFrame([("b", 1, 0, 7), ("b", 1, 0, 7), ("b", 2, 1, 7), ("b", 1, 2, 8), ("b", None, 1, 8), ("b", 3, 1, None), ("b", 5, 0, 10)], "block string, doc_id long, pos int, term_id int")
    pd_ = spark.createDataFrame([("b", 7, 0, 1), ("c", 7, 0, 1), ("c", 7, 0, 1), ("b", 8, 0, None), ("b", 9, 0, 0), ("b", 11, 0, 4), ("b", None, 0, 4)], "block string, term_id int, byte_offset long, doc_freq long")
    assert sorted(r.term_id for r in wrong_doc_freq(td, pd_).collect()) == [8, 10, 11]
    assert wrong_doc_freq(td.limit(0), pd_.limit(0)).count() == 0


def test_a_key_with_most_rows_is_joined_as_any_other(spark):
    rows = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % 900) END AS g", "id")
    per = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    got = join_held(rows, per, ["g"], "n")
    assert got.columns == ["g", "id", "last", "n"]
    want = {r.g: (r.n, r["last"]) for r in per.collect()}
    out = got.collect()
    assert sorted(r.id for r in out) == list(range(4000)) and all(want[r.g] == (r.n, r["last"]) for r in out)
    assert join_held(rows, per.where("g = 'hot'"), ["g"], "n").count() == want["hot"][0]
    assert join_held(rows.limit(0), per.limit(0), ["g"], "n").count() == 0
