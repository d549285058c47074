"""Ranking of fielded records: term frequencies by field, the four rankers, and nDCG."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import bind, sublinear, substring_count, tokens, url_length, url_words
from lexmill.functions.windows import boost_by_excess, boost_by_ratio, hits, least_window, smallest_window, window_count
from lexmill.operators.positions import POS, global_positions
from lexmill.operators.skewed_keys import join_held
from lexmill.session import materialise

FIELDS = ["url", "title", "body", "header", "anchor"]
#: Weights and constants of the rankers (fixed values).
COSINE = {"url": 0.3, "title": 0.2, "body": 0.05, "header": 0.05, "anchor": 0.4}
BM25F = {"url": 0.4, "title": 0.2, "body": 0.05, "header": 0.05, "anchor": 0.3}
BM25F_B = {"url": 0.6, "title": 0.8, "body": 0.8, "header": 0.8, "anchor": 0.6}
WINDOWS = {"url": 0.2, "title": 0.2, "body": 0.05, "header": 0.05, "anchor": 0.5}
K1, LAMBDA, LENGTH_SMOOTH = 1.2, 1.0, 500
#: Terms of queries that are broadcast to the documents, and queries that are broadcast to the records, at most.
MAX_TERMS, MAX_QUERIES = 100_000, 50_000


def records(features: DataFrame) -> DataFrame:
    """One record for each (query, url), the one with the highest rec_id; null fields are empty, null numbers 0."""
    kept = F.struct("title", "header", "body_hits", "body_length", "pagerank", "anchors")
    rows = features.where("query IS NOT NULL AND url IS NOT NULL").groupBy("query", "url").agg(F.max_by(kept, F.coalesce("rec_id", F.lit(-1))).alias("r"))
    none = F.array().cast("array<string>")
    return rows.select(
        "query",
        "url",
        F.coalesce("r.title", F.lit("")).alias("title"),
        F.array_compact(F.coalesce("r.header", none)).alias("header"),
        F.coalesce("r.body_hits", F.create_map().cast("map<string,array<int>>")).alias("body_hits"),
        F.coalesce("r.body_length", F.lit(0)).alias("body_length"),
        F.coalesce("r.pagerank", F.lit(0)).alias("pagerank"),
        F.coalesce("r.anchors", F.create_map().cast("map<string,int>")).alias("anchors"),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def raw_tf(term: Column) -> dict[str, Column]:
    """Occurrences of a term in each field of a record: within words everywhere but in the body, whose hits are by key."""
    return {
        "url": substring_count(F.lower("url"), term),
        "title": substring_count(F.lower("title"), term),
        "body": F.greatest(F.coalesce(F.size(F.try_element_at("body_hits", term)), F.lit(0)), F.lit(0)).cast("bigint"),
        "header": _sum(F.transform("header", lambda h: substring_count(F.lower(h), term))),
        "anchor": _sum(F.transform(F.map_entries("anchors"), lambda a: F.coalesce(a["value"], F.lit(0)) * substring_count(F.lower(a["key"]), term))),
    }


def field_lengths(rows: DataFrame) -> DataFrame:
    """Adds lengths in tokens (url in parts; anchors times their counts) and how many headers and anchors there are."""
    anchors = F.map_entries("anchors")
    return rows.withColumns(
        {
            "url_length": url_length(F.col("url")),
            "title_length": F.size(tokens(F.col("title"))),
            "header_length": _sum(F.transform("header", lambda h: F.size(tokens(h)))),
            "header_count": F.size("header"),
            "anchor_length": _sum(F.transform(anchors, lambda a: F.coalesce(a["value"], F.lit(0)) * F.size(tokens(a["key"])))),
            "anchor_count": _sum(F.transform(anchors, lambda a: F.coalesce(a["value"], F.lit(0)))),
        }
    )


def length_averages(rows: DataFrame) -> DataFrame:
    """One row: mean lengths; of url, title and body by record, of headers by header, of anchors by anchor."""
    total = lambda c: F.sum(c)
    return field_lengths(rows).agg(
        F.avg("url_length").alias("av_url"),
        F.avg("title_length").alias("av_title"),
        F.avg("body_length").alias("av_body"),
        F.try_divide(total("header_length"), total("header_count")).alias("av_header"),
        F.try_divide(total("anchor_length"), total("anchor_count")).alias("av_anchor"),
    )


def idf_table(documents: DataFrame) -> DataFrame:
    """(term, idf): ln(N / documents with the term), over lower-cased tokens of all texts that are not null."""
    rows = documents.where("text IS NOT NULL")
    n = rows.agg(F.count(F.lit(1)).alias("n"))  # one row
    df = rows.select(F.explode(F.array_distinct(tokens(F.lower("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", F.log(F.col("n") / F.col("df")).alias("idf"))


def term_idf(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, idf) of the given different terms only, ln N for those that no document has. One pass over the documents:
    a token "" stands for the document itself, so its count is N. Tokens of other terms are dropped before they are
    counted where the terms are few enough to be broadcast, else after counting."""
    asked = materialise(terms.select("term"), "asked")
    wanted = asked.unionByName(documents.sparkSession.createDataFrame([("",)], "term string"))
    each = documents.where("text IS NOT NULL").select(F.explode(F.concat(F.array_distinct(tokens(F.lower("text"))), F.array(F.lit("")))).alias("term"))
    if asked.limit(MAX_TERMS + 1).count() <= MAX_TERMS:
        each = each.join(F.broadcast(wanted), "term", "left_semi")
    counted = each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(wanted, "term", "left_semi")
    counted = materialise(counted, "df")
    n = counted.where("term = ''").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n"))  # one row
    return asked.join(counted, "term", "left").crossJoin(F.broadcast(n)).select("term", F.log(F.col("n") / F.coalesce("df", F.lit(1))).alias("idf"))


def query_vectors(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(query, terms): for each query its different lower-cased terms in order, each with weight (1 + ln tf) * idf."""
    at = rows.select("query").distinct().select("query", F.posexplode(tokens(F.lower("query"))).alias("pos", "term"))
    counted = at.groupBy("query", "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("pos"))
    weighted = counted.join(term_idf(documents, at.select("term").distinct()), "term")
    each = F.struct("pos", "term", (sublinear(F.col("tf")) * F.col("idf")).alias("weight"), "idf")
    return weighted.groupBy("query").agg(F.array_sort(F.collect_list(each)).alias("terms"))


def with_query(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows with the terms of their query. Records are wide and few queries have most of them, so the queries are
    broadcast where they are few enough; else those with the most records are, and the others joined by hash."""
    vectors = materialise(query_vectors(rows, documents), "vectors")
    if vectors.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES:
        return rows.join(F.broadcast(vectors), "query")
    held = rows.groupBy("query").agg(F.count(F.lit(1)).alias("held"))
    return join_held(rows, materialise(vectors.join(held, "query"), "held"), ["query"], "held").drop("held")


def _over_terms(value) -> Column:
    return F.aggregate(F.transform("terms", lambda t: value(t)), F.lit(0.0), lambda a, x: a + x)


def _normalised(tf: Column) -> Column:
    return tf / (F.col("body_length") + LENGTH_SMOOTH)


def field_scores(weights: dict[str, float] | None = None, scale: dict[str, Column] | None = None, sublinear_tf: bool = False) -> dict[str, Column]:
    """For each field the product of the query's weights with the field's length-normalised term frequencies."""
    kept = (lambda x: sublinear(x)) if sublinear_tf else (lambda x: x)
    return {f: _over_terms(lambda t, f=f: t["weight"] * _normalised(kept(raw_tf(t["term"])[f]))) * F.lit((weights or {}).get(f, 1.0)) * (scale[f] if scale else F.lit(1.0)) for f in FIELDS}


def _total(columns: dict[str, Column]) -> Column:
    first, *rest = columns.values()
    return sum(rest, first)


def cosine_scores(rows: DataFrame, documents: DataFrame) -> DataFrame:
    return with_query(rows, documents).select("query", "url", _total(field_scores(COSINE)).alias("score"))


def bm25f_score(averages_joined: DataFrame) -> Column:
    """Score of a record that has field lengths, averages and query terms beside it. Empty header and anchor fields add nothing."""
    b = BM25F_B

    def damp(f: str, length: Column, mean: Column) -> Column:
        return 1 + b[f] * (length / mean - 1)

    norm = {
        "url": damp("url", F.col("url_length"), F.col("av_url")),
        "title": damp("title", F.col("title_length"), F.col("av_title")),
        "body": damp("body", F.col("body_length"), F.col("av_body")),
        "header": damp("header", F.col("header_length"), F.col("av_header") * F.col("header_count")),
        "anchor": damp("anchor", F.col("anchor_length"), F.col("av_anchor") * F.col("anchor_count")),
    }
    present = {"header": F.col("header_count") > 0, "anchor": F.col("anchor_count") > 0}

    def weight(t: Column) -> Column:
        tf = raw_tf(t["term"])
        parts = {f: F.lit(BM25F[f]) * F.coalesce(F.try_divide(tf[f].cast("double"), norm[f]), F.lit(0.0)) for f in FIELDS}
        return _total({f: F.when(present[f], x).otherwise(0.0) if f in present else x for f, x in parts.items()})

    matched = _over_terms(lambda t: bind(weight(t), lambda w: w / (K1 + w)) * t["idf"])
    return matched + F.when(F.col("pagerank") > 0, LAMBDA * F.log(F.col("pagerank"))).otherwise(0.0)


def bm25f_scores(rows: DataFrame, documents: DataFrame) -> DataFrame:
    means = F.broadcast(length_averages(rows))  # one row
    joined = with_query(field_lengths(rows), documents).crossJoin(means)
    return joined.select("query", "url", bm25f_score(joined).alias("score"))


def field_windows(terms: Column) -> dict[str, Column]:
    """The smallest window in each field. In the body, the hits of all keys must be covered, and there must be at least
    as many keys as terms."""
    body = F.map_values("body_hits")
    return {
        "url": smallest_window(hits(url_words(F.col("url")), terms)),
        "title": smallest_window(hits(tokens(F.lower("title")), terms)),
        "body": F.when(F.size(body) >= F.size(terms), smallest_window(body)).otherwise(F.lit(float("inf"))),
        "header": least_window(F.col("header"), terms, lambda h: tokens(F.lower(h))),
        "anchor": least_window(F.map_keys("anchors"), terms, lambda a: tokens(F.lower(a))),
    }


def top_terms(share: float = 1.0) -> Column:
    """The query's terms with the highest weight: max(1, whole part of share * n) of them, equal weights in order."""
    ranked = F.array_sort(F.transform("terms", lambda t: F.struct((-t["weight"]).alias("w"), t["pos"].alias("pos"), t["term"].alias("term"))))
    n = F.greatest(F.floor(F.size("terms") * share), F.lit(1)).cast("int")
    return F.transform(F.slice(ranked, F.lit(1), n), lambda t: t["term"])


def field_window_counts(terms: Column) -> dict[str, Column]:
    body = F.array_min(F.transform(terms, lambda t: F.greatest(F.coalesce(F.size(F.try_element_at("body_hits", t)), F.lit(0)), F.lit(0)))).cast("bigint")
    return {
        "url": window_count(url_words(F.col("url")), terms),
        "title": window_count(tokens(F.lower("title")), terms),
        "body": body,
        "header": _sum(F.transform("header", lambda h: window_count(tokens(F.lower(h)), terms))),
        "anchor": _sum(F.transform(F.map_entries("anchors"), lambda a: F.coalesce(a["value"], F.lit(0)) * window_count(tokens(F.lower(a["key"])), terms))),
    }


def _barrier(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column computed once a row, however often it is read."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_windows(rows: DataFrame, documents: DataFrame) -> DataFrame:
    joined = _barrier(with_query(rows, documents), "words", F.transform("terms", lambda t: t["term"]))
    return _barrier(joined, "windows", F.struct(*[x.alias(f) for f, x in field_windows(F.col("words")).items()]))


def smallest_window_scores(rows: DataFrame, documents: DataFrame) -> DataFrame:
    n = F.size("terms")
    scale = {f: boost_by_excess(F.col(f"windows.{f}"), n) for f in FIELDS}
    return with_windows(rows, documents).select("query", "url", _total(field_scores(WINDOWS, scale)).alias("score"))


def window_count_scores(rows: DataFrame, documents: DataFrame, share: float = 1.0) -> DataFrame:
    n = F.size("terms")
    counted = _barrier(_barrier(with_windows(rows, documents), "top", top_terms(share)), "counts", F.struct(*[x.alias(f) for f, x in field_window_counts(F.col("top")).items()]))
    scale = {f: boost_by_ratio(F.col(f"windows.{f}"), n) * (1 + F.log(1 + F.col(f"counts.{f}"))) for f in FIELDS}
    return counted.select("query", "url", _total(field_scores(WINDOWS, scale)).alias("score"))


def hit_count_scores(rows: DataFrame) -> DataFrame:
    """Number of body hits of a record."""
    return rows.select("query", "url", _sum(F.transform(F.map_values("body_hits"), lambda p: F.greatest(F.coalesce(F.size(p), F.lit(0)), F.lit(0)))).cast("double").alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """(query, url, score, rank): by score descending, equal scores by url; scores are compared at 9 decimals."""
    rounded = scores.withColumn("score", F.round("score", 9))
    return global_positions(rounded, ["query"], [F.col("score").desc(), F.col("url").asc()], label="run").withColumnRenamed(POS, "rank").select("query", "url", "score", "rank")


def ndcg(run: DataFrame, relevance: DataFrame) -> DataFrame:
    """(query, ndcg) of a run (query, url, rank) under (query, url, rel): the ideal order is that of the same urls.
    Unjudged and negative relevances count 0; a query without any relevant url gets 1."""
    judged = run.join(relevance, ["query", "url"], "left").select("query", "rank", "url", F.greatest(F.coalesce("rel", F.lit(0.0)), F.lit(0.0)).alias("rel"))
    ideal = global_positions(judged, ["query"], [F.col("rel").desc(), F.col("url").asc()], label="ideal")
    gain = lambda at: (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.lit(1.0) + at)
    summed = ideal.groupBy("query").agg(F.sum(gain(F.col("rank"))).alias("dcg"), F.sum(gain(F.col(POS))).alias("best"))
    return summed.select("query", F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(1.0).alias("ndcg"))


def mean_ndcg(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.avg("ndcg").alias("mean_ndcg"), F.count(F.lit(1)).alias("n_queries"))
