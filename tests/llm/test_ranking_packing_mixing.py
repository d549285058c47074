import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import mixing as M
from lexmill.llm.one_ranking import SCORES, outranking, record_scores
from lexmill.llm.packing import container_use, pack, plan
from lexmill.llm.tokens import VOCABULARY, count_tokens, encoding


def flows(items, scores, q, p):
    """Net flows by all pairs."""
    n, out = len(items), defaultdict(float)
    for k in range(scores):
        z = [sum(o[k] < x[k] for o in items) / n + sum(o[k] == x[k] for o in items) / (2 * n) for x in items]
        for a in range(n):
            up = sum(min(max((z[a] - z[b] - q) / (p - q), 0), 1) for b in range(n))
            down = sum(min(max((z[b] - z[a] - q) / (p - q), 0), 1) for b in range(n))
            out[a] += (up - down) / max(n - 1, 1) / scores
    return out


@pytest.mark.parametrize(("q", "p"), [(0.0, 0.5), (0.1, 0.3), (0.0, 0.01)])
def test_outranking_matches_all_pairs(spark, q, p):
    rng = random.Random(9)
    rows = [("big" if i % 2 else f"g{i % 14}", i, float(rng.randint(0, 6)), rng.random() * 1e6, float(rng.choice([0, 0, 5]))) for i in range(150)]
    df = spark.createDataFrame(rows, "grp string, item int, a double, b double, c double").withColumn("flow", F.lit("clash")).withColumn("g", F.lit(0))
    got = {(r.group, r["item"]): (r.flow, r.position) for r in outranking(df, "grp", "item", ["a", "b", "c"], indifference=q, preference=p).collect()}
    groups = defaultdict(list)
    for g, i, *x in rows:
        groups[g].append((i, x))
    assert len(got) == len(rows)
    for g, items in groups.items():
        want = flows([x for _, x in items], 3, q, p)
        order = sorted(range(len(items)), key=lambda k: (-round(want[k], 7), items[k][0]))
        for at, k in enumerate(order, 1):
            assert abs(got[(g, items[k][0])][0] - want[k]) < 1e-6
            assert got[(g, items[k][0])][1] == at


def test_outranking_of_nulls_singles_and_nothing(spark):
    df = spark.createDataFrame([("one", 1, None, float("nan")), ("two", 1, None, 1.0), ("two", 2, 3.0, 1.0), (None, 5, 1.0, 1.0)], "grp string, item int, a double, b double")
    got = {(r.group, r["item"]): (r.flow, r.position) for r in outranking(df, "grp", "item", ["a", "b"]).collect()}
    assert got[("one", 1)] == (0.0, 1)
    assert got[("two", 2)][1] == 1 and got[("two", 1)][1] == 2
    assert outranking(df.limit(0), "grp", "item", ["a", "b"]).count() == 0


def test_record_scores_of_nulls(spark):
    schema = "rec_id long, query string, url string, body_hits map<string,array<int>>, body_length int, pagerank int, anchors map<string,int>, flow string"
    df = spark.createDataFrame([(1, "q", "u", {"a": [1, 2], "b": None}, None, 3, {"x": 2, "y": None}, ""), (1, "q", "u", {"a": [1, 2], "b": None}, None, 3, {"x": 2, "y": None}, ""), (2, "q", "v", None, 4, None, None, ""), (None, "q", "w", None, 4, 1, None, ""), (3, None, "w", None, 4, 1, None, "")], schema)
    assert sorted((r.rec_id, *[r[s] for s in SCORES]) for r in record_scores(df).collect()) == [(1, 3.0, 0.0, 2.0, 2.0), (2, 0.0, 4.0, 0.0, 0.0)]


def best_fit(lengths, capacity):
    """Best fit by decreasing length, item by item: the space left in each container."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_the_plan_is_best_fit(lengths):
    counts = Counter(lengths)
    slots, used = plan(dict(counts), 30)
    held, ranks = Counter(), defaultdict(list)
    for i, (length, rank, each, first) in enumerate(slots):
        end = min([s[1] for s in slots if s[0] == length and s[1] > rank], default=counts[length])
        for r in range(rank, end):
            held[first + (r - rank) // each] += length
            ranks[length].append(r)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert sorted(30 - x for x in held.values()) == best_fit(lengths, 30)
    assert used == len(held)


def test_no_lengths_beyond_the_capacity():
    with pytest.raises(ValueError, match="capacity"):
        plan({31: 1}, 30)


def test_packing_keeps_every_token(spark):
    rng = random.Random(10)
    texts = [None, "", "   ", "word " * 5000, *["t" + " w" * rng.randint(0, 60) for _ in range(300)], *["same text"] * 100]
    df = spark.createDataFrame([(i if i < 400 else 399, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for c in ("piece", "rest", "container_id", "n_tokens", "__text"):
        df = df.withColumn(c, F.lit("z"))
    rows = pack(df, capacity=100).collect()
    sizes, held = Counter(), Counter()
    for r in rows:
        sizes[r.doc_id] += r.n_tokens
        if r.container_id is not None:
            held[r.container_id] += r.n_tokens
    want = Counter()
    for i, t in enumerate(texts):
        want[i if i < 400 else 399] += count_tokens(t)
    assert +sizes == +want and set(sizes) == set(want)
    assert max(held.values()) <= 100
    assert sum(want.values()) / (100 * len(held)) > 0.97
    split = Counter(r.doc_id for r in rows)
    assert all(split[i] == 1 for i, t in enumerate(texts[:300]) if count_tokens(t) <= 100)
    use = container_use(pack(df, capacity=100), 100).first()
    assert (use.containers, use.tokens) == (len(held), sum(held.values()))


def test_packing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df).count() == 0
    assert container_use(pack(df)).first().unused_share is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\u3000", "\x1c", "\xa0", "a", "Zoë", "'s", "12", "--", "😀"]), max_size=30), st.integers(2, 5))
def test_tokens_are_those_of_the_whole_text(parts, long_run):
    text = "".join(parts)
    assert count_tokens(text, long_run=long_run) == len(encoding(VOCABULARY).encode_ordinary(text)) if text else count_tokens(text) == 0


@pytest.mark.parametrize("n", [2_001, 3_603, 20_000])
def test_tokens_of_runs_are_not_cut(n):
    rng = random.Random(n)
    enc = encoding(VOCABULARY)
    for text in ("".join(rng.choice("abcdefghij") for _ in range(n)), "https://x.example/" + "".join(rng.choice("ab/-_.0") for _ in range(n)), " " * n + "x", "\n" * n):
        assert count_tokens(text) == len(enc.encode_ordinary(text))


def test_tokens_of_long_runs():
    assert count_tokens(" " * 2_000_000 + "x") > 1
    assert count_tokens("a" * 300_000) > 0
    assert count_tokens(" " * 300_000) > 0
    assert count_tokens("<|endoftext|>") > 1


def test_exponent_meets_an_entropy():
    shares = {"a": 0.8, "b": 0.15, "c": 0.05}
    e = M.exponent_for_entropy(shares, 0.9)
    assert abs(M.entropy(M.tempered(shares, e)) - 0.9) < 1e-9
    assert M.tempered(shares, 0.0) == pytest.approx(shares)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(1, 9), st.integers(0, 5)), min_size=1, max_size=6), st.integers(1, 20_000))
def test_budgets_keep_the_limits_and_the_proportions(sources, total):
    tokens = {str(i): t for i, (t, _, _) in enumerate(sources)}
    aims = {str(i): a / sum(x for _, x, _ in sources) for i, (_, a, _) in enumerate(sources)}
    repeats = {str(i): r for i, (_, _, r) in enumerate(sources)}
    most = {s: tokens[s] * repeats[s] for s in tokens}
    got, exponents = M.budgets(tokens, aims, repeats, total)
    assert set(exponents) == set(got) and all(0 <= e <= 1 for e in exponents.values())
    assert all(b <= most[s] * (1 + 1e-9) + 1e-9 for s, b in got.items())
    assert sum(got.values()) == pytest.approx(min(total, sum(most.values())))
    free = [s for s in got if got[s] < most[s] * (1 - 1e-9)]
    for s in free:
        assert got[s] / aims[s] == pytest.approx(got[free[0]] / aims[free[0]])
        assert all(got[s] / aims[s] >= got[x] / aims[x] * (1 - 1e-9) for x in got)


def test_mix_reaches_the_shares(spark):
    rng = random.Random(11)
    docs = [(i, ["Big", " big ", "small", "tiny", None, "other"][i % 6 if i % 7 else 0], "w " * rng.randint(1, 30)) for i in range(900)]
    docs += [(1000, "small", None), (1001, "small", ""), (1002, None, "x"), (0, "Big", docs[0][2])]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    for c in ("share", "block", "whole", "key", "n_tokens"):
        df = df.withColumn(c, F.lit("z"))
    targets = spark.createDataFrame([("BIG", 0.3, 1), ("small", 0.4, 3), ("tiny", 0.2, 2), ("empty", 0.1, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    selection, shares = M.mix(df, targets)
    got = {r.source: r for r in shares.collect()}
    live = 0.9
    for s, aim in (("big", 0.3), ("small", 0.4), ("tiny", 0.2)):
        assert got[s].actual_share == pytest.approx(aim / live, abs=0.01)
        assert got[s].repeats <= got[s].max_repeats
    assert got["empty"].tokens_taken == 0
    rows = selection.collect()
    assert len({(r.doc_id, r.source, r.block) for r in rows if r.doc_id}) == len([r for r in rows if r.doc_id])
    again = sorted(tuple(r) for r in M.mix(df, targets)[0].collect())
    assert again == sorted(tuple(r) for r in rows)


def test_the_exponent_sets_the_weights():
    tokens, aims, repeats = {"a": 9000, "b": 900, "c": 100}, {"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 1, "b": 4, "c": 3}
    got, at = M.budgets(tokens, aims, repeats, 5000)
    assert got["c"] == 300 and 0 < at["c"] < 1 and at["a"] == 1.0  # c stops the exponent at its limit
    assert got["b"] / got["a"] == pytest.approx(1.5)
    for spread in (0.5, 0.8, 1.05):
        got, at = M.budgets(tokens, aims, repeats, spread=spread)
        w = {s: b / sum(got.values()) for s, b in got.items()}
        assert M.entropy(w) == pytest.approx(spread, abs=1e-6)
        assert all(got[s] <= tokens[s] * repeats[s] * (1 + 1e-9) for s in got)
    # With a total, the repetition limit stops the exponent before the entropy does.
    got, at = M.budgets(tokens, aims, repeats, total=6000, spread=1.09)
    assert got["c"] == pytest.approx(300) and 0 < at["a"] < M.exponent_for_entropy({"a": 0.9, "b": 0.09, "c": 0.01}, 1.09)


def test_another_entropy_gives_another_selection(spark):
    docs = [(i, "big" if i % 10 else "small", "w " * (5 + i % 7)) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    taken = {}
    for spread in (0.4, 0.69):
        selection, shares = M.mix(df, targets, spread=spread)
        rows = selection.collect()
        taken[spread] = {(r.doc_id, r.block) for r in rows}
        by = defaultdict(list)
        for r in rows:
            by[(r.source, r.block)].append(r.position)
        assert all(sorted(p) == list(range(1, len(p) + 1)) for p in by.values())
        got = {r.source: r.actual_share for r in shares.collect()}
        assert M.entropy(got) == pytest.approx(spread, abs=0.02)
    assert taken[0.4] != taken[0.69]


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    selection, shares = M.mix(df, targets)
    assert selection.count() == 0
    assert shares.first().actual_share == 0
    assert M.mix(df, targets.limit(0))[1].count() == 0


def test_a_tiny_source_does_not_shrink_the_mix(spark):
    docs = [(i, "ab"[i % 2], "w " * (200 + i % 7)) for i in range(400)] + [(1000, "tiny", "w " * 10)]
    targets = spark.createDataFrame([("a", 0.49, 1), ("b", 0.5, 1), ("tiny", 0.01, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in M.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), targets)[1].collect()}
    assert got["tiny"].repeats == 1
    assert sum(r.tokens_taken for r in got.values()) > 0.9 * sum(r.tokens_available for r in got.values())
    assert got["a"].tokens_taken / got["b"].tokens_taken == pytest.approx(0.98, abs=0.01)
