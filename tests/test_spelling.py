import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions.edits import distances, edit_list, edits_of, one_edit, osa, tables
from lexmill.operators import spelling as S
from lexmill.session import materialise


def plain(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            k = a[i - 1] != b[j - 1]
            d[i, j] = min(d[i - 1, j - 1] + k, d[i - 1, j] + 1, d[i, j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + k)
    return d[len(a), len(b)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=8), st.text("abc", max_size=8)), max_size=12))
def test_distances(pairs):
    assert distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [plain(a, b) for a, b in pairs]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_as_many_edits_as_the_distance(a, b):
    a, b = "~" + a, "~" + b
    assert len(edits_of(tables([a], [b]), [a], [b])[0]) == plain(a, b)
    assert edits_of(tables([a, b], [b, a]), [a, b], [b, a]) == [edits_of(tables([x], [y]), [x], [y])[0] for x, y in ((a, b), (b, a))]


def test_known_distances_and_nulls(spark):
    df = spark.createDataFrame([("ca", "abc"), ("ab", "ba"), ("", "x"), (None, "x"), ("größe", "groesse")], "a string, b string")
    assert [r[0] for r in df.select(osa("a", "b")).collect()] == [3, 1, 1, None, 4]
    e = df.limit(2).select(edit_list("a", "b")).collect()[1][0]
    assert [(x.op, x.a, x.b) for x in e] == [(3, "a", "b")]


def test_neighbours(spark):
    got = spark.createDataFrame([("ab",)], "t string").select(one_edit(F.col("t"), F.array(F.lit("x")))).first()[0]
    assert sorted(got) == sorted(["b", "a", "ba", "xb", "ax", "xab", "axb", "abx"])


CORPUS = ["how to find lentil soup", "how to find lentil soup", "lentil soup week", "how a table", "the table soup a", "find table"]


def brute(query, uni, bi, total, letters):
    """The best candidate by trying all: texts over the vocabulary near each word, and all neighbours of the query."""
    import itertools
    import math

    def lm(c):
        p = math.log(uni[c[0]] / total)
        for v, w in zip(c, c[1:]):
            p += math.log(0.2 * uni[w] / total + 0.8 * bi.get((v, w), 0) / uni[v])
        return p

    def near(word):
        if len(word) == 1:
            return letters
        g = lambda w: [w[i : i + 2] for i in range(len(w) - 1)]
        out = []
        for c in uni:
            num = sum(x in g(c) for x in g(word))
            if len(c) > 1 and num and num / (len(word) + len(c) - 2 - num) > 0.5:
                out.append(c)
        return out

    words = query.split()
    n = len(words)
    oov = [w not in uni for w in words]
    pair = [(words[i], words[i + 1]) not in bi if i < n - 1 else (n < 2 or (words[i - 1], words[i]) not in bi) for i in range(n)]
    flags = [oov[i] or (pair[i] and not (i and oov[i - 1]) and not (i < n - 1 and oov[i + 1])) for i in range(n)]
    at = [i for i in range(n) if flags[i]]
    sets = list(itertools.combinations(at, 2)) if len(at) > 2 else [tuple(at)]
    cands = {c for s in sets for c in itertools.product(*[near(w) if i in s else [w] for i, w in enumerate(words)])}
    q = query
    for i in range(len(q) + 1):
        rest = [q[:i] + q[i + 1 :], q[:i] + q[i + 1 : i + 2] + q[i : i + 1] + q[i + 2 :]] if i < len(q) else []
        rest += [q[:i] + c + q[i + k :] for c in letters for k in (0, 1)]
        cands |= {tuple(x.split()) for x in rest}
    best = None
    for c in cands:
        if c and all(w in uni for w in c):
            text = " ".join(c)
            d = plain(text, query)
            p = lm(c) + (math.log(0.9) if d == 0 else d * math.log(0.01) + (len(text) - d) * math.log(0.99))
            if best is None or (-round(p, 9), text) < best:
                best = (-round(p, 9), text)
    return best[1] if best else query


def test_correction_matches_brute_force(spark):
    lines = spark.createDataFrame([(x,) for x in CORPUS], "line string")
    uni, bi = {}, {}
    for x in CORPUS:
        w = x.split(" ")
        for t in w:
            uni[t] = uni.get(t, 0) + 1
        for p in zip(w, w[1:]):
            bi[p] = bi.get(p, 0) + 1
    letters = [c for c in S.ALPHABET if c in uni]
    queries = ["how to fnid lentil", "lentl soup", "tabel", "how to find lentil", "a tabl soupp", "zzz", "how too fand lentil soop", "find  table"]
    got = {r["query"]: r.corrected for r in S.correct(spark.createDataFrame([(q,) for q in queries], "query string"), lines).collect()}
    total = sum(uni.values())
    for q in queries:
        assert got[q] == brute(q, uni, bi, total, letters), q


def test_learned_channel_prefers_seen_edits(spark):
    lines = spark.createDataFrame([("cat",), ("cut",), ("cat",), ("cut",), ("u a",)], "line string")
    pairs = spark.createDataFrame([("bot", "but"), ("lot", "lut"), ("cot", "cut")], "query string, corrected string")
    got = S.correct(spark.createDataFrame([("cot",), ("",), (None,)], "query string"), lines, pairs)
    assert {r["query"]: r.corrected for r in got.collect()} == {"cot": "cut", "": "", None: None}
    assert S.accuracy(got, spark.createDataFrame([("cot", "cut")], "query string, gold string").limit(1)).first().share_right == 1.0


def test_split_and_merge(spark):
    lines = spark.createDataFrame([("control group plan",), ("control group",)], "line string")
    uni, bi = S.unigrams(lines), S.bigrams(lines)
    q = spark.createDataFrame([("controlgroup plan",), ("cont rol group",), ("plan",)], "query string")
    assert {r["query"]: r.alt for r in S.best_splits(q, uni, bi).collect()} == {"controlgroup plan": "control group plan", "cont rol group": "control group", "plan": "plan"}


def _broadcast_joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_word_candidates_broadcast_no_pairs_of_the_dictionary(spark):
    """Every pair of every word is far more than the bytes of the words that Spark rates it by."""
    words = ["banana", "bananas", "ananas", "nana", "aaaa", "aa", "aaa", "bandana", "cabana", "an", "b", "havana"]
    uni = materialise(spark.createDataFrame([(w, 1) for w in words], "term string, cnt long"), "words")
    asked = ["banana", "aaaaaa", "anana", "havanna", "b", "bandanna"]
    got = S.word_candidates(spark.createDataFrame([(w,) for w in asked], "word string"), uni)
    assert _broadcast_joins(got) == 0
    pairs = lambda w: [w[i : i + 2] for i in range(len(w) - 1)]
    close = lambda w, c: (n := sum(g in pairs(c) for g in pairs(w))) / (len(w) + len(c) - 2 - n) > 0.5
    right = {(w, c) for w in asked for c in words if len(w) > 1 and len(c) > 1 and close(w, c)} | {("b", "b")}
    assert {(r.word, r.cand) for r in got.collect()} == right


def test_candidates_broadcast_no_model_and_no_candidates(spark):
    lines = ["bond barrister court", "legal counsel court", "legal counsel bond", "a court"]
    model = S.build(spark.createDataFrame([(x,) for x in lines], "line string"))
    asked = spark.createDataFrame([("bond barristr",), ("legal cunsel",), ("legalcounsel",)], "query string")
    splits = S.best_splits(asked, model.unigrams, model.bigrams)
    assert _broadcast_joins(splits) == 0
    got = S.candidates(splits.select("alt").distinct(), model.unigrams, model.bigrams)
    assert _broadcast_joins(got) == 0
    assert {("bond barristr", "bond barrister"), ("legal cunsel", "legal counsel"), ("legal counsel", "legal counsel")} <= {(r.alt, r.cand) for r in got.collect()}


def _small_model(spark):
    lines = ["bond barrister court", "legal counsel court", "legal counsel bond", "a court"]
    return S.build(spark.createDataFrame([(x,) for x in lines], "line string"))


def test_known_candidates_broadcast_no_table(spark):
    model = _small_model(spark)
    alts = spark.createDataFrame([("bond barristr",), ("legal cunsel",)], "alt string")
    seen = materialise(S.suspicions(S.looked_up(alts, "alt", model.unigrams, model.bigrams)), "seen")
    got = S.known_candidates(seen, model)
    assert _broadcast_joins(got) == 0
    assert ("legal cunsel", "legal counsel") in {(r.alt, r.cand) for r in got.collect()}


def test_learned_scores_join_by_sorting(spark):
    model = _small_model(spark)
    alts, pairs = spark.createDataFrame([("legal cunsel",)], "alt string"), spark.createDataFrame([("legal cunsel", "legal counsel")], "query string, corrected string")
    got = S.scored_candidates(alts, model, pairs)
    assert "SortMergeJoin [alt" in got._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin [op" in x]
    assert any("BuildRight" in x for x in joins) and not any("BuildLeft" in x for x in joins)
    assert "legal counsel" in {r.cand for r in got.collect()}


def test_correction_broadcasts_no_query(spark):
    queries = spark.createDataFrame([("legal cunsel",), (None,), ("bond barristr",)], "query string")
    got = S.correct(queries, _small_model(spark))
    assert _broadcast_joins(got) == 0
    assert {r.query: r.corrected for r in got.collect()} == {"legal cunsel": "legal counsel", "bond barristr": "bond barrister", None: None}


def test_accuracy_broadcasts_no_query(spark):
    rows = [("a b", "a c"), ("d", "d")]
    got = S.accuracy(spark.createDataFrame(rows, "query string, corrected string"), spark.createDataFrame([("a b", "a c"), ("d", "e f")], "query string, gold string"))
    assert _broadcast_joins(got) == 0
    assert tuple(got.first()) == (0.5, 1, 0)
