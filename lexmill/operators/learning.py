"""Learning to rank: feature vectors, least squares, pairwise linear SVM and the ordinal perceptron."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import query_terms, url_length
from lexmill.functions.windows import boost_by_excess
from lexmill.operators.positions import POS, global_positions
from lexmill.operators.ranking import FIELDS, bm25f_score, field_lengths, field_scores, length_averages, ranked, with_query, with_windows
from lexmill.session import materialise, shared_path

FIVE = [f"x_{f}" for f in FIELDS]
TWELVE = [*FIVE, "x_bm25f", "x_window", "x_pagerank", "x_url_length", "x_has_header", "x_has_anchors", "x_www"]
EPOCHS = 10


def ends_with_pdf(url: Column) -> Column:
    return F.when(F.lower(url).endswith(".pdf"), 1).otherwise(-1)


def features5(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(query, url, x_url ... x_anchor): the query's weights times the damped, length-normalised frequencies, by field."""
    scores = field_scores(sublinear_tf=True)
    return with_query(rows, documents).select("query", "url", *[scores[f].alias(f"x_{f}") for f in FIELDS])


def features12(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """features5 with BM25F, the body's window boost, page rank, url length per query term, and three yes-no features."""
    scores = field_scores(sublinear_tf=True)
    joined = with_windows(field_lengths(rows), documents).crossJoin(F.broadcast(length_averages(rows)))  # one row
    return joined.select(
        "query",
        "url",
        *[scores[f].alias(f"x_{f}") for f in FIELDS],
        bm25f_score(joined).alias("x_bm25f"),
        boost_by_excess(F.col("windows.body"), F.size("terms")).alias("x_window"),
        F.col("pagerank").cast("double").alias("x_pagerank"),
        (url_length(F.col("url")) / F.size(query_terms(F.col("query")))).alias("x_url_length"),
        F.when(F.size("header") > 0, 1.0).otherwise(0.0).alias("x_has_header"),
        F.when(F.size("anchors") > 0, 1.0).otherwise(0.0).alias("x_has_anchors"),
        F.when(F.contains("url", F.lit("www")), 1.0).otherwise(-1.0).alias("x_www"),
    )


def labelled(features: DataFrame, relevance: DataFrame) -> DataFrame:
    return features.join(relevance.select("query", "url", "rel"), ["query", "url"])


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation; constant columns are only centred."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    spread = lambda c: F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    return rows.crossJoin(F.broadcast(stats)).select(*[c for c in rows.columns if c not in columns], *[((F.col(c) - F.col(f"m_{c}")) / spread(c)).alias(c) for c in columns])


def pair_differences(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(query, url, other, label, columns): for two urls of a query with different relevance, the first by url less the
    second, labelled 1 if it is the more relevant and -1 if not. The result has a row for each such two by definition."""
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, (F.col("a.query") == F.col("b.query")) & (F.col("a.url") < F.col("b.url")) & (F.col("a.rel") != F.col("b.rel")))
    label = F.when(F.col("a.rel") > F.col("b.rel"), 1).otherwise(-1)
    return both.select("a.query", "a.url", F.col("b.url").alias("other"), label.alias("label"), *[(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(c) for c in columns])


@dataclass
class Linear:
    """Scores are weights times features, plus the intercept."""

    columns: list[str]
    weights: list[float]
    intercept: float = 0.0

    def score(self, features: DataFrame) -> DataFrame:
        s = F.lit(self.intercept)
        for c, w in zip(self.columns, self.weights):
            s = s + F.col(c) * F.lit(float(w))
        return features.select("query", "url", s.alias("score"))


def least_squares(rows: DataFrame, columns: list[str], label: str = "rel") -> Linear:
    """Ordinary least squares with intercept, from one pass of covariances."""
    names = [*columns, label]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"c{i}_{j}"] or 0.0
    means = np.array([got[f"m{i}"] or 0.0 for i in range(len(names))])
    w = np.linalg.lstsq(cov[:-1, :-1], cov[:-1, -1], rcond=1e-12)[0]
    return Linear(columns, w.tolist(), float(means[-1] - w @ means[:-1]))


def pairwise_svm(rows: DataFrame, columns: list[str], c: float = 1.0) -> Linear:
    """Linear support vector machine on the differences of standardised features; scores leave the intercept out."""
    pairs = materialise(pair_differences(standardised(rows, columns), columns), "pairs")
    n = pairs.count()
    if not n or pairs.select("label").distinct().count() < 2:
        return Linear(columns, [0.0] * len(columns))
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(pairs.withColumn("side", F.when(F.col("label") > 0, 1.0).otherwise(0.0)))
    model = LinearSVC(labelCol="side", regParam=1 / (c * n), standardization=False, maxIter=100).fit(vectors)
    return Linear(columns, model.coefficients.toArray().tolist())


def ordinal_labels(relevance: DataFrame) -> DataFrame:
    """(rel, level): the different relevances numbered from 0 in rising order."""
    levels = relevance.where("rel IS NOT NULL").select(F.lit(0).alias("__all"), "rel").distinct()
    return global_positions(levels, ["__all"], [F.col("rel").asc()], label="levels").select("rel", (F.col(POS) - 1).alias("level"))


@dataclass
class Ordinal:
    """Perceptron with rising thresholds; the last one is infinite."""

    columns: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, features: DataFrame) -> DataFrame:
        return Linear(self.columns, self.weights.tolist()).score(features)

    def level(self, features: DataFrame) -> DataFrame:
        """(query, url, level): the first level whose threshold lies above the score."""
        bounds = F.array(*[F.lit(float(b)) for b in self.thresholds[:-1]])
        found = F.filter(F.transform(bounds, lambda b, i: F.when(F.col("score") < b, i)), lambda i: i.isNotNull())
        return self.score(features).select("query", "url", F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(len(self.thresholds) - 1)).alias("level"))


def ordinal_step(w: np.ndarray, b: np.ndarray, x: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray]:
    """One example: thresholds on the wrong side of the score move by one, and the weights with them."""
    s = float(w @ x)
    if int(np.argmax(s < b)) == y:
        return w, b
    side = np.where(y <= np.arange(len(b) - 1), -1, 1)
    move = np.where((s - b[:-1]) * side <= 0, side, 0)
    b = b.copy()
    b[:-1] -= move
    return w + move.sum() * x, b


def _pass(w: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, look: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Examples in order. Those that the model has right change nothing, so it looks for the next wrong one among several."""
    at = 0
    while at < len(xs):
        s = xs[at : at + look] @ w
        wrong = np.flatnonzero((s[:, None] < b).argmax(1) != ys[at : at + look])
        if len(wrong):
            at += int(wrong[0])
            w, b = ordinal_step(w, b, xs[at], int(ys[at]))
            at += 1
        else:
            at += look
    return w, b


def ordinal_perceptron(rows: DataFrame, relevance: DataFrame, columns: list[str], epochs: int = EPOCHS) -> Ordinal:
    """Trains in the order of query and url. Each update depends on all before it, so training is one task; it streams
    over the rows, which are sorted and written by many, once for each epoch, and keeps the model only."""
    spark = rows.sparkSession
    levels = ordinal_labels(relevance)
    k = levels.count()
    y = rows.join(F.broadcast(levels), "rel") if k <= 10_000 else rows.join(levels, "rel")
    path = shared_path(spark, "ordered")
    # Files are numbered in the order of the sort.
    y.select("query", "url", "level", *columns).repartitionByRange("query", "url").sortWithinPartitions("query", "url").select("level", *columns).write.parquet(path)

    def train_all(batches):
        from pyarrow import dataset, fs

        for _ in batches:
            system, at = fs.FileSystem.from_uri(path)
            files = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name.endswith(".parquet"))
            w, b = np.zeros(len(columns)), np.append(np.zeros(max(k - 1, 0)), np.inf)
            for _ in range(epochs):
                for file in files:
                    for p in dataset.dataset(file, filesystem=system, format="parquet").to_batches():
                        xs = np.stack([p.column(c).to_numpy(zero_copy_only=False) for c in columns], 1).astype(float)
                        w, b = _pass(w, b, xs, p.column("level").to_numpy())
            yield pd.DataFrame({"w": [w.tolist()], "b": [b.tolist()]})

    got = spark.range(1, numPartitions=1).mapInPandas(train_all, "w array<double>, b array<double>").first()
    return Ordinal(columns, np.array(got["w"]), np.array(got["b"]))


TASKS = {1: "least squares", 2: "pairwise SVM", 3: "pairwise SVM on twelve features", 4: "ordinal perceptron"}


def train(task: int, rows: DataFrame, documents: DataFrame, relevance: DataFrame) -> Linear | Ordinal:
    if task not in TASKS:
        raise ValueError(f"tasks are {TASKS}")
    x = materialise(labelled(features12(rows, documents) if task == 3 else features5(rows, documents), relevance), "features")
    if task == 1:
        return least_squares(x, FIVE)
    if task == 4:
        return ordinal_perceptron(x, relevance, FIVE)
    return pairwise_svm(x, TWELVE if task == 3 else FIVE)


def test(task: int, model: Linear | Ordinal, rows: DataFrame, documents: DataFrame, scaled: bool = False) -> DataFrame:
    """The run of the records under a trained model. Features are used as they are, or scaled as in pairwise training."""
    columns = TWELVE if task == 3 else FIVE
    x = features12(rows, documents) if task == 3 else features5(rows, documents)
    return ranked(model.score(standardised(materialise(x, "features"), columns) if scaled else x))
