import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lexmill.llm.subjects import _Graph, subject_areas, subject_sentences

WORDS = {"law": "court judge statute appeal witness verdict clause tenant".split(), "food": "oven yeast dough pastry soup onion butter flour".split(), "sport": "match team goal striker league coach stadium final".split()}
NOTICES = ["the law library is closed on day {}", "the food court opens at {}", "back to top", "parking behind the sport hall is full"]


def corpus(n=240, seed=12):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        mine = rng.sample(sorted(WORDS), rng.choice([1, 1, 2]))
        lines = [f"some {rng.choice(WORDS[s])} and the {rng.choice(WORDS[s])} with a {rng.choice(WORDS[s])}" for s in mine for _ in range(4)]
        lines += [rng.choice(NOTICES).format(rng.randint(1, 30)) for _ in range(6)]
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines) if i % 2 else ". ".join(lines) + "."))
        truth[i] = set(mine)
    return docs, truth


def areas(spark):
    return spark.createDataFrame([(s, "") for s in WORDS] + [(None, "")], "subject string, note string")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).add(r.subject)
    return out


def test_subjects_spread_from_few_labels(spark):
    docs, truth = corpus()
    labels = [(i, s.upper() if i % 2 else f" {s} ") for i in range(40) for s in truth[i]]
    labels += [(0, None), (None, "law"), (1, "unknown"), (3, "law"), (5, "food")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for c in ("subject", "labels", "terms", "n_all", "node"):
        df = df.withColumn(c, F.lit("z"))
    counted = subject_sentences(df, spark.createDataFrame(labels, "doc_id long, subject string"), areas(spark))
    got = found(subject_areas(counted))
    held_out = range(40, len(docs))
    assert sum(got.get(i) == truth[i] for i in held_out) / len(held_out) > 0.95
    rows = counted.collect()
    assert all(r.n_sentences <= r.n_all <= 8 + 2 for r in rows)


def test_texts_on_nothing_nulls_and_long_ones(spark):
    docs, truth = corpus()
    n = len(docs)
    docs += [(n, None), (n + 1, ""), (n + 2, "\n".join(x.format(3) for x in NOTICES)), (n + 3, " ".join(["the judge in the court heard the witness."] * 20_000)), (n + 4, "…ß" * 1000), (7, docs[7][1])]
    labels = spark.createDataFrame([(i, s) for i in range(60) for s in truth[i]], "doc_id long, subject string")
    got = found(subject_areas(subject_sentences(spark.createDataFrame(docs, "doc_id long, text string"), labels, areas(spark))))
    assert all(n + i not in got for i in (0, 1, 2, 4))
    assert got[n + 3] == {"law"}
    assert got[7] == truth[7]


def test_without_documents_labels_or_subjects(spark):
    docs, truth = corpus(20)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(0, "law")], "doc_id long, subject string")
    assert subject_sentences(df.limit(0), labels, areas(spark)).count() == 0
    assert subject_sentences(df, labels.limit(0), areas(spark)).count() == 0
    assert subject_sentences(df, labels, areas(spark).limit(0)).count() == 0


def test_terms_beyond_the_broadcast_count_as_much(spark):
    docs, truth = corpus()
    docs += [(7, docs[7][1])]
    labels = spark.createDataFrame([(i, s) for i in range(60) for s in truth[i]], "doc_id long, subject string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, subject_sentences(df, labels, areas(spark)).collect()))
    for bound in (1, 100):
        assert sorted(map(tuple, subject_sentences(df, labels, areas(spark), max_cells=bound).collect())) == want


def test_trusted_seeds_are_clamped_in_the_result(spark):
    docs, truth = corpus()
    n = len(docs)
    rng = random.Random(3)
    for i in range(5):
        docs.append((n + i, "\n".join(f"some {rng.choice(WORDS[s])} and the {rng.choice(WORDS[s])} with a {rng.choice(WORDS[s])} {rng.choice(WORDS[s])}" for s in ["law"] * 6 + ["food"] * 4)))
    labels = [(i, s) for i in range(60) for s in truth[i]]
    # Whole; one label is null, one unknown, one not borne out; none.
    labels += [(n, "law"), (n + 1, "law"), (n + 1, None), (n + 2, "law"), (n + 2, "lore"), (n + 3, "law"), (n + 3, "sport")]
    given = spark.createDataFrame(labels, "doc_id long, subject string")
    for bound in (50_000, 3):
        got = found(subject_areas(subject_sentences(spark.createDataFrame(docs, "doc_id long, text string"), given, areas(spark), max_seeds=bound)))
        assert got[n] == {"law"}
        assert all(got[n + i] == {"law", "food"} for i in range(1, 5))


def test_too_many_subjects_are_an_error(spark):
    docs, _ = corpus(3)
    many = spark.createDataFrame([(f"s{i}", "") for i in range(1001)], "subject string, note string")
    labels = spark.createDataFrame([(0, "s1")], "doc_id long, subject string")
    with pytest.raises(ValueError, match="subjects"):
        subject_sentences(spark.createDataFrame(docs, "doc_id long, text string"), labels, many)


def test_salted_terms_are_never_broadcast(spark):
    """Thirty-two rows a term: by the bytes of the file that they come from, they would be."""
    links = spark.range(100).selectExpr("id AS row", "id AS place", "id % 7 AS node")
    terms = spark.range(7).selectExpr("id AS node", "1D AS w0")
    joined = _Graph.to_links(SimpleNamespace(small=False), links, terms)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100
