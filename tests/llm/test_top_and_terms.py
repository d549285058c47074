import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import distinctive as D
from lexmill.llm.term_frequency import mark_words, term_frequencies
from lexmill.llm.top_n import top_n

NAN = float("nan")


def test_top_n_matches_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "Hot", None, f"q{i % 40}"]), rng.choice([None, f"u{rng.randint(0, 60)}"]), rng.choice([None, NAN, math.inf, -0.0, 0.0, 1.0, 2.5])) for i in range(4000)]
    df = spark.createDataFrame(rows, "query string, url string, score double")
    for c in ("group", "item", "g", "i", "position", "__pid"):
        df = df.withColumn(c, F.lit(1))
    best = defaultdict(dict)
    for q, u, s in rows:
        if q is not None and u is not None and s is not None and s == s:
            best[q][u] = max(best[q].get(u, -math.inf), s)
    got = {(r.group, r["position"]): r["item"] for r in top_n(df, "query", "url", "score", 5).collect()}
    want = {(q, i): u for q, us in best.items() for i, u in enumerate(sorted(us, key=lambda u: (-us[u], u))[:5], 1)}
    assert got == want


def test_top_n_of_nothing(spark):
    assert top_n(spark.createDataFrame([], "query string, url string, score double"), "query", "url", "score", 5).count() == 0


def test_term_frequencies_split_parts_that_are_too_large(spark):
    rng = random.Random(7)
    rows = [(rng.choice([0, 0, 0, 1, 2, None, rng.randint(3, 90)]), rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 2])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "term_id int, doc_id long, pos int").withColumn("part", F.lit("clash")).withColumn("n", F.lit(1))
    want = defaultdict(set)
    for t, d, p in rows:
        if t is not None and d is not None:
            want[t].add((d, p))
    got = {r.term_id: (r.n_occurrences, r.doc_freq) for r in term_frequencies(df, capacity=150).collect()}
    assert got == {t: (len(x), len({d for d, _ in x})) for t, x in want.items()}
    assert term_frequencies(df.limit(0)).count() == 0


def test_marks(spark):
    words = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (None, "d")], "word_id int, term string")
    docs = spark.createDataFrame([(i,) for i in range(20)] + [(None,), (3,)], "doc_id long")
    freq = spark.createDataFrame([(0, 9, 3), (1, 2, 2)], "term_id int, n_occurrences long, doc_freq long")
    got = {r.word_id: r.mark for r in mark_words(words, freq, docs).collect()}
    assert got == {0: "common", 1: "rare", 2: "rare"}


def test_two_poisson_finds_the_records_a_term_is_about():
    rng = np.random.default_rng(8)
    counts = np.concatenate([rng.poisson(0.3, 900), rng.poisson(6, 100)])
    f, n = np.unique(counts[counts > 0], return_counts=True)
    p, steps, done = D.fit_two_poisson(np.append(f, [1]), np.append(n, [1]), np.array([0, len(f)]), 1000.0)
    assert (np.diff(p[: len(f)]) > -1e-12).all()
    assert p[0] < 0.1 and p[: len(f)][f == 5] > 0.9
    assert np.isfinite(p).all() and done.all() and (steps > 1).all()


def test_wide_histograms_are_fitted_alike(spark):
    rng = np.random.default_rng(3)
    rows = [(r, t, int(rng.poisson(m)) + 1) for t, m in (("a", 2), ("b", 9), ("c", 0.1)) for r in range(60)]
    df = spark.createDataFrame(rows, "rec_id long, term string, f long")
    want, got = ({(r.term, r.f): r for r in D.fitted_terms(df, 100, widest).collect()} for widest in (100, 3))
    assert want.keys() == got.keys() and len(want) > 10
    for k, r in want.items():
        assert (got[k].n, got[k].d, got[k].n_rec, got[k].steps, got[k].converged) == (r.n, r.d, r.n_rec, r.steps, r.converged)
        assert abs(got[k].posterior - r.posterior) < 1e-9


SCHEMA = "rec_id long, query string, url string, title string, header array<string>, body_hits map<string,array<int>>, body_length int, pagerank int, anchors map<string,int>"


def test_record_terms_and_the_most_distinctive(spark):
    rows = [
        (1, "q", "u", "Alpha, beta!", ["alpha b2", None], {"Gamma": [1, 2, 3], "none": []}, 9, 1, {"beta x": 4, "skip": None}),
        (1, "q", "u", "Alpha, beta!", ["alpha b2", None], {"Gamma": [1, 2, 3], "none": []}, 9, 1, {"beta x": 4, "skip": None}),
        (2, None, None, None, None, None, None, None, None),
        (3, "q", "v", "", [], {}, 0, 0, {}),
        (4, "q", "w", "alpha " * 5000, ["gamma"], {"gamma": None}, 0, 0, None),
        (None, "q", "w", "alpha", None, None, 0, 0, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("term", "f", "d", "r", "n", "posterior"):
        df = df.withColumn(c, F.lit("z"))
    f = {(r.rec_id, r.term): r.f for r in D.record_terms(df).collect()}
    assert f == {(1, "alpha"): 2, (1, "beta"): 5, (1, "b2"): 1, (1, "gamma"): 3, (1, "x"): 4, (4, "alpha"): 5000, (4, "gamma"): 1}
    scored = D.distinctive_terms(df)
    assert all(0 <= r.posterior <= 1 and r.n_rec == 4 for r in scored.collect())
    d = {"alpha": 2, "gamma": 2}
    want = {}
    for (rec, term), n in f.items():
        w = (1 + math.log(n)) * math.log(4 / d.get(term, 1))
        want[rec] = min(want.get(rec, (math.inf, "")), (-w, term))
    assert {r.rec_id: r.term for r in D.most_distinctive(scored).collect()} == {rec: t for rec, (_, t) in want.items()}
    assert D.distinctive_terms(df.limit(0)).count() == 0


def test_equal_terms_go_by_name(spark):
    df = spark.createDataFrame([(1, "q", "u", "zeta eta", None, None, 1, 1, None), (2, "q", "u", "x", None, None, 1, 1, None)], SCHEMA)
    assert {r.rec_id: r.term for r in D.most_distinctive(D.distinctive_terms(df)).collect()} == {1: "eta", 2: "x"}
