import itertools
import math
import random

from pyspark.sql import functions as F

from lexmill.functions.text import query_terms, substring_count, url_length, url_words
from lexmill.functions.windows import hits, smallest_window, window_count
from lexmill.operators import learning as L
from lexmill.operators import ranking as R
from lexmill.sources import files


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, substring_count(F.col("t"), F.lit("aa")), t="aaaa") == 2
    assert one(spark, url_length(F.col("t")), t="http://ththre.example.com/fr/825?page=2&ref=x") == 9
    assert one(spark, url_words(F.col("t")), t="http://A.b/c%20d_e&f") == ["http", "a", "b", "c", "d", "e", "f"]
    assert one(spark, query_terms(F.col("t")), t=" B a b\tA ") == ["b", "a"]


def test_windows_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice("abcx") for _ in range(rng.randint(0, 12))], list("abc")[: rng.randint(1, 3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, w array<string>, q array<string>")
    got = {r.i: (r.s, r.n) for r in df.select("i", smallest_window(hits(F.col("w"), F.col("q"))).alias("s"), window_count(F.col("w"), F.col("q")).alias("n")).collect()}
    for i, w, q in rows:
        spans = [b - a + 1 for a, b in itertools.combinations_with_replacement(range(len(w)), 2) if set(q) <= set(w[a : b + 1])]
        left, n = set(q), 0
        for x in w:
            left.discard(x)
            if not left:
                left, n = set(q), n + 1
        assert got[i] == (min(spans, default=math.inf), n)


def test_ndcg(spark):
    run = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "b", 0.5, 2), ("z", "a", 1.0, 1), ("n", "x", 1.0, 1)], "query string, url string, score double, rank long")
    rel = spark.createDataFrame([("q", "a", 0.0), ("q", "b", 1.0), ("z", "a", -3.0)], "query string, url string, rel double")
    got = {r["query"]: r.ndcg for r in R.ndcg(run, rel).collect()}
    assert abs(got["q"] - 1 / math.log2(3)) < 1e-12
    assert got["z"] == got["n"] == 1.0


FEATURES = """query: spark join
  url: http://www.a.example/spark/join
    title: spark join guide
    header: join types
    header: more
    body_hits: spark 3 10 42
    body_hits: join 4 11
    body_length: 120
    pagerank: 3
    anchor_text: spark docs
    stanford_anchor_count: 2
    anchor_text: spark docs
    stanford_anchor_count: 5
  url: http://b.example/
    title:
    body_length: 7
    pagerank: 0
query: other
  url: http://c.example/
    title: c
    body_length: 1
    pagerank: 1
"""


def test_feature_file_round_trip(spark, tmp_path):
    (tmp_path / "f.txt").write_text(FEATURES)
    got = {(r["query"], r.url): r for r in files.read_features(spark, str(tmp_path / "f.txt")).collect()}
    r = got[("spark join", "http://www.a.example/spark/join")]
    assert (r.title, r.header, r.body_hits, r.body_length, r.pagerank, r.anchors) == ("spark join guide", ["join types", "more"], {"spark": [3, 10, 42], "join": [4, 11]}, 120, 3, {"spark docs": 5})
    assert got[("spark join", "http://b.example/")].title == ""
    assert len(got) == 3


def test_run_file_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("q", 1, "u1"), ("q", 2, "u2"), ("r", 1, "u1")], "query string, rank long, url string")
    files.write_run(run, str(tmp_path / "run"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "run").glob("part*")))
    (tmp_path / "all.txt").write_text(text + "query: empty\nquery: judged\n  url: v 2.5\n")
    got = {(r["query"], r["rank"], r.url, r.rel) for r in files.read_judged(spark, str(tmp_path / "all.txt")).collect()}
    assert got == {("q", 1, "u1", None), ("q", 2, "u2", None), ("r", 1, "u1", None), ("judged", 1, "v", 2.5)}


def test_least_squares_and_ordinal_levels(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.5 + rng.normal(size=200) * 0.01
    df = spark.createDataFrame([("q", f"u{i:03d}", float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "query string, url string, x1 double, x2 double, rel double")
    m = L.least_squares(df, ["x1", "x2"])
    exact = np.linalg.lstsq(np.c_[x, np.ones(200)], y, rcond=None)[0]
    assert np.allclose([*m.weights, m.intercept], exact)
    levels = np.digitize(y, [-1, 2])
    df = spark.createDataFrame([("q", f"u{i:03d}", float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, levels))], "query string, url string, x1 double, x2 double, rel double")
    model = L.ordinal_perceptron(df, df, ["x1", "x2"], epochs=10)
    w, b = np.zeros(2), np.array([0, 0, np.inf])
    for _ in range(10):
        for row, t in zip(x, levels):
            s = float(w @ row)
            if sum(s >= v for v in b) != t:
                for at in range(2):
                    side = -1 if t <= at else 1
                    if (s - b[at]) * side <= 0:
                        b[at] -= side
                        w = w + side * row
    assert np.allclose(model.weights, w) and np.allclose(model.thresholds, b)
    got = np.array([r.level for r in model.level(df).orderBy("url").collect()])
    assert (got == [int(np.argmax(w @ row < b)) for row in x]).all()
    assert (got == levels).mean() > 0.9


def test_pairwise_svm_orders_a_separable_query(spark):
    df = spark.createDataFrame([(f"q{i // 10}", f"u{i}", float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(60)], "query string, url string, x1 double, x2 double, rel double")
    m = L.pairwise_svm(df, ["x1", "x2"])
    assert m.weights[0] > abs(m.weights[1])
    pairs = L.pair_differences(df, ["x1"])
    assert pairs.where("label > 0 AND x1 <= 0").count() == 0


def test_pairwise_svm_minimises_the_hinge_loss_of_all_pairs(spark):
    """Against plain subgradient steps over brute-force pairs: no worse a loss, and weights in the same direction."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    rel = np.clip(np.round(x @ [2.0, -1.0, 0.0] + rng.normal(size=60)), -2, 2)
    df = spark.createDataFrame([(f"q{i % 4}", f"u{i:02d}", *map(float, v), float(r)) for i, (v, r) in enumerate(zip(x, rel))], "query string, url string, a double, b double, c double, rel double")
    z = (x - x.mean(0)) / x.std(0)
    pairs = [(i, j) for i in range(60) for j in range(i + 1, 60) if i % 4 == j % 4 and rel[i] != rel[j]]
    d = np.array([z[i] - z[j] for i, j in pairs])
    y = np.array([1.0 if rel[i] > rel[j] else -1.0 for i, j in pairs])

    def loss(w):
        return np.maximum(0, 1 - y * (d @ w)).mean() + w @ w / 2 / len(d)

    w = np.zeros(3)
    best = w
    for t in range(1, 4000):
        w = w - 0.5 / t**0.5 * (-(d * y[:, None])[y * (d @ w) < 1].sum(0) / len(d) + w / len(d))
        best = w if loss(w) < loss(best) else best
    m = np.array(L.pairwise_svm(df, ["a", "b", "c"]).weights)
    assert loss(m) < loss(best) * 1.01
    assert m @ best / np.linalg.norm(m) / np.linalg.norm(best) > 0.999


def test_feature_files_of_many_splits(spark, tmp_path):
    """Records cut by any split of the file, queries and urls given again, a query without urls."""
    text = FEATURES + "query: none\n" + FEATURES.replace("spark join guide", "second") + "query: last\n  url: u\n    title: a\n  url: v\n    pagerank: 2\n  url: u\n    title: b\n"
    (tmp_path / "f.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = {(r["query"], r.url): r for r in files.read_features(spark, str(tmp_path / "f.txt")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(got) == {("spark join", "http://www.a.example/spark/join"), ("spark join", "http://b.example/"), ("other", "http://c.example/"), ("last", "u"), ("last", "v")}
    assert got[("spark join", "http://www.a.example/spark/join")].title == "second"
    assert (got[("last", "u")].title, got[("last", "v")].pagerank) == ("b", 2)


def test_idf_of_asked_terms_whatever_is_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([("a b A",), ("b c",), ("",), (None,)], "text string")
    rows = spark.createDataFrame([("A b", 1), ("A b", 2), ("zzz", 3), ("c  c", 4)], "query string, n int")
    want = None
    for terms, queries in ((100, 100), (1, 1)):
        monkeypatch.setattr(R, "MAX_TERMS", terms)
        monkeypatch.setattr(R, "MAX_QUERIES", queries)
        got = sorted((r.n, r["query"], [(t.term, round(t.weight, 9), round(t.idf, 9)) for t in r.terms]) for r in R.with_query(rows, docs).collect())
        want = want or got
        assert got == want
    assert [(t, i) for t, _, i in want[0][2]] == [("a", round(math.log(3), 9)), ("b", round(math.log(1.5), 9))]
    assert want[2][2][0][2] == round(math.log(3), 9) and want[3][2][0][1] == round((1 + math.log(2)) * math.log(3), 9)
