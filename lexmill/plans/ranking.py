"""Queries of the rankers over ranking_features, with run_scores as a given run."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import query_terms, sublinear, tokens, url_length, url_words
from lexmill.operators import ranking as R
from lexmill.plans.problems import table
from lexmill.session import materialise


def recs(spark: SparkSession, sf: str) -> DataFrame:
    return R.records(table(spark, sf, "ranking_features"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def judgements(rows: DataFrame) -> DataFrame:
    """Made-up relevances from the length of the body, to check arithmetic only."""
    return rows.select("query", "url", (F.col("body_length") % 5 - 1).cast("double").alias("rel"))


def rank_records(spark, sf):
    return recs(spark, sf).select("query", "url", "title", F.size("header").alias("n_header"), F.size("body_hits").alias("n_hits"), "body_length", "pagerank", F.size("anchors").alias("n_anchors"))


def rank_field_lengths(spark, sf):
    return R.field_lengths(recs(spark, sf)).select("query", "url", "url_length", "title_length", "header_length", "header_count", "anchor_length", "anchor_count")


def rank_length_averages(spark, sf):
    return R.length_averages(recs(spark, sf))


def rank_idf(spark, sf):
    return R.idf_table(docs(spark, sf)).select("term", F.round("idf", 9).alias("idf"))


def rank_query_terms(spark, sf):
    return recs(spark, sf).select("query").distinct().select("query", F.explode(query_terms(F.col("query"))).alias("term"))


def rank_query_vector(spark, sf):
    t = R.query_vectors(recs(spark, sf), docs(spark, sf)).select("query", F.explode("terms").alias("t"))
    return t.select("query", "t.term", F.round("t.weight", 9).alias("weight"))


def rank_raw_tf(spark, sf):
    long = recs(spark, sf).withColumn("term", F.explode(query_terms(F.col("query"))))
    return long.select("query", "url", "term", *[x.alias(f"tf_{f}") for f, x in R.raw_tf(F.col("term")).items()])


def rank_sublinear_tf(spark, sf):
    long = recs(spark, sf).withColumn("term", F.explode(query_terms(F.col("query"))))
    return long.select("query", "url", "term", *[F.round(sublinear(x) / (F.col("body_length") + R.LENGTH_SMOOTH), 9).alias(f"tf_{f}") for f, x in R.raw_tf(F.col("term")).items()])


def rank_url_words(spark, sf):
    return recs(spark, sf).select("query", "url", F.array_join(url_words(F.col("url")), " ").alias("words"), url_length(F.col("url")).alias("url_length"))


def rank_windows(spark, sf):
    w = R.with_windows(recs(spark, sf), docs(spark, sf))
    return w.select("query", "url", *[F.when(F.col(f"windows.{f}") < float("inf"), F.col(f"windows.{f}")).cast("bigint").alias(f"w_{f}") for f in R.FIELDS])


def rank_window_boosts(spark, sf):
    w, n = R.with_windows(recs(spark, sf), docs(spark, sf)), F.size("terms")
    return w.select("query", "url", F.round(R.boost_by_excess(F.col("windows.title"), n), 9).alias("by_excess"), F.round(R.boost_by_ratio(F.col("windows.title"), n), 9).alias("by_ratio"))


def rank_window_counts(spark, sf):
    long = recs(spark, sf).withColumn("words", query_terms(F.col("query")))
    return long.select("query", "url", *[x.alias(f"n_{f}") for f, x in R.field_window_counts(F.col("words")).items()])


def rank_top_terms(spark, sf):
    v = R.query_vectors(recs(spark, sf), docs(spark, sf))
    return v.select("query", F.explode(R.top_terms(0.55)).alias("term"))


def rank_hit_count(spark, sf):
    return R.ranked(R.hit_count_scores(recs(spark, sf)))


def rank_cosine(spark, sf):
    return R.ranked(R.cosine_scores(materialise(recs(spark, sf), "records"), docs(spark, sf)))


def rank_bm25f(spark, sf):
    return R.ranked(R.bm25f_scores(materialise(recs(spark, sf), "records"), docs(spark, sf)))


def rank_smallest_window(spark, sf):
    return R.ranked(R.smallest_window_scores(materialise(recs(spark, sf), "records"), docs(spark, sf)))


def rank_window_count(spark, sf):
    return R.ranked(R.window_count_scores(materialise(recs(spark, sf), "records"), docs(spark, sf)))


def rank_run(spark, sf):
    """The given run, each url with its best score."""
    rows = table(spark, sf, "run_scores").where("query IS NOT NULL AND url IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return R.ranked(rows.groupBy("query", "url").agg(F.max("score").alias("score")))


def rank_ndcg(spark, sf):
    rows = materialise(recs(spark, sf), "records")
    return R.ndcg(R.ranked(R.hit_count_scores(rows)), judgements(rows)).select("query", F.round("ndcg", 9).alias("ndcg"))


def rank_mean_ndcg(spark, sf):
    return R.mean_ndcg(rank_ndcg(spark, sf)).select(F.round("mean_ndcg", 6).alias("mean_ndcg"), "n_queries")


def rank_run_text(spark, sf):
    """The lines of a ranked-run file, numbered."""
    from lexmill.sources.files import run_lines

    return run_lines(rank_hit_count(spark, sf)).select("query", "rank", "line")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rank_records, rank_field_lengths, rank_length_averages, rank_idf, rank_query_terms, rank_query_vector, rank_raw_tf, rank_sublinear_tf, rank_url_words,
        rank_windows, rank_window_boosts, rank_window_counts, rank_top_terms, rank_hit_count, rank_cosine, rank_bm25f, rank_smallest_window, rank_window_count,
        rank_run, rank_ndcg, rank_mean_ndcg, rank_run_text,
    )
}

REC = """rec AS (SELECT query, url, coalesce(title, '') title, list_filter(coalesce(header, []), lambda h: h IS NOT NULL) header,
    coalesce(body_hits, MAP {}) body_hits, coalesce(body_length, 0) body_length, coalesce(pagerank, 0) pagerank, coalesce(anchors, MAP {}) anchors
    FROM ranking_features WHERE query IS NOT NULL AND url IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY coalesce(rec_id, -1) DESC) = 1)"""


def _count(text: str, term: str = "term") -> str:
    return f"((length({text}) - length(replace({text}, {term}, ''))) // length({term}))"


TERMS = "qt AS (SELECT DISTINCT query, unnest(regexp_extract_all(lower(query), '\\S+')) term FROM (SELECT DISTINCT query FROM rec))"
TF = f"""tf AS (SELECT r.query, r.url, term, body_length, pagerank, {_count('lower(r.url)')} tf_url, {_count('lower(title)')} tf_title,
    coalesce(len(body_hits[term]), 0) tf_body,
    CAST(coalesce(list_sum(list_transform(header, lambda h: {_count('lower(h)')})), 0) AS BIGINT) tf_header,
    CAST(coalesce(list_sum(list_transform(map_entries(anchors), lambda a: coalesce(a.value, 0) * {_count('lower(a.key)')})), 0) AS BIGINT) tf_anchor
    FROM rec r JOIN qt USING (query))"""
IDF = """dn AS (SELECT count(*) n FROM documents WHERE text IS NOT NULL),
    idf AS (SELECT term, ln(n / count(*)) idf FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\\S+'))) term FROM documents WHERE text IS NOT NULL), dn GROUP BY term, n)"""
QV = """qv AS (SELECT query, term, (1 + ln(tf)) * coalesce(idf, ln(n)) weight, coalesce(idf, ln(n)) idf, pos FROM (
    SELECT query, term, count(*) tf, min(pos) pos FROM (SELECT query, unnest(t) term, unnest(range(len(t))) pos FROM (SELECT query, regexp_extract_all(lower(query), '\\S+') t FROM (SELECT DISTINCT query FROM rec))) GROUP BY 1, 2) LEFT JOIN idf USING (term), dn)"""
LEN = """ln_ AS (SELECT *, len(regexp_split_to_array(trim(url, '/'), '//|/|\\.|\\?|=')) url_length, len(regexp_extract_all(title, '\\S+')) title_length,
    coalesce(list_sum(list_transform(header, lambda h: len(regexp_extract_all(h, '\\S+')))), 0)::BIGINT header_length, len(header) header_count,
    coalesce(list_sum(list_transform(map_entries(anchors), lambda a: coalesce(a.value, 0) * len(regexp_extract_all(a.key, '\\S+')))), 0)::BIGINT anchor_length,
    coalesce(list_sum(list_transform(map_entries(anchors), lambda a: coalesce(a.value, 0))), 0)::BIGINT anchor_count FROM rec)"""
AVG = """av AS (SELECT avg(url_length) av_url, avg(title_length) av_title, avg(body_length) av_body, sum(header_length) / sum(header_count) av_header, sum(anchor_length) / sum(anchor_count) av_anchor FROM ln_)"""
URL_WORDS = "regexp_extract_all(lower(regexp_replace(r.url, '%20|[:/.?~=\\-%_&]', ' ', 'g')), '\\S+')"
#: Words of each text of a field (several texts for headers and anchors), and the places of the query's terms.
TEXTS = f"""texts AS (SELECT query, url, 'url' f, 0 i, 1 times, {URL_WORDS} w FROM rec r
    UNION ALL SELECT query, url, 'title', 0, 1, regexp_extract_all(lower(title), '\\S+') FROM rec
    UNION ALL SELECT query, url, 'header', unnest(range(len(header))), 1, regexp_extract_all(lower(unnest(header)), '\\S+') FROM rec
    UNION ALL SELECT query, url, 'anchor', unnest(range(len(map_keys(anchors)))), coalesce(unnest(map_values(anchors)), 0), regexp_extract_all(lower(unnest(map_keys(anchors))), '\\S+') FROM rec),
    qn AS (SELECT query, count(*) n FROM qt GROUP BY 1),
    place AS (SELECT query, url, f, i, times, term, pos FROM (SELECT query, url, f, i, times, unnest(w) term, unnest(range(len(w))) pos FROM texts) JOIN qt USING (query, term))"""
WIN = f"""{TEXTS},
    bodyat AS (SELECT query, url, 'body' f, 0 i, 1 times, e.key term, unnest(e.value) pos FROM (SELECT query, url, unnest(map_entries(body_hits)) e FROM rec)),
    need AS (SELECT query, url, f, i, n FROM texts JOIN qn USING (query) UNION ALL SELECT query, url, 'body', 0, CASE WHEN len(map_keys(body_hits)) >= n THEN len(map_keys(body_hits)) ELSE 1000000 END FROM rec JOIN qn USING (query)),
    ev AS (SELECT * FROM place UNION ALL SELECT * FROM bodyat),
    nx AS (SELECT a.query, a.url, a.f, a.i, a.pos, b.term, min(b.pos) p FROM (SELECT DISTINCT query, url, f, i, pos FROM ev) a JOIN ev b ON a.query = b.query AND a.url = b.url AND a.f = b.f AND a.i = b.i AND b.pos >= a.pos GROUP BY ALL),
    cov AS (SELECT query, url, f, i, pos, max(p) - pos + 1 w, count(*) c FROM nx GROUP BY query, url, f, i, pos),
    win AS (SELECT query, url, f, min(w) w FROM cov JOIN need USING (query, url, f, i) WHERE c = n GROUP BY ALL),
    wide AS (SELECT r.query, r.url, {', '.join(f"max(CASE WHEN f = '{f}' THEN w END) w_{f}" for f in R.FIELDS)} FROM rec r LEFT JOIN win USING (query, url) GROUP BY ALL)"""
#: Greedy windows: each ends at the latest of the terms' first places after the last window's end.
COUNTS = f"""{TEXTS},
    greedy AS (SELECT query, url, f, i, times, 0 n, -1 e FROM texts
        UNION ALL SELECT query, url, f, i, times, n, e FROM (
            SELECT g.query, g.url, g.f, g.i, g.times, g.n + 1 n, max(p) e, count(*) c, any_value(qn.n) need FROM (
                SELECT g.query, g.url, g.f, g.i, g.times, g.n, a.term, min(a.pos) p FROM greedy g JOIN place a ON g.query = a.query AND g.url = a.url AND g.f = a.f AND g.i = a.i AND a.pos > g.e GROUP BY ALL) g
            JOIN qn ON qn.query = g.query GROUP BY g.query, g.url, g.f, g.i, g.times, g.n) WHERE c = need),
    per AS (SELECT query, url, f, sum(times * m)::BIGINT n FROM (SELECT query, url, f, i, times, max(n) m FROM greedy GROUP BY ALL) GROUP BY ALL),
    bodyn AS (SELECT query, url, min(coalesce(len(body_hits[term]), 0)) n_body FROM rec JOIN qt USING (query) GROUP BY ALL),
    counts AS (SELECT b.query, b.url, n_body, {', '.join(f"coalesce(max(CASE WHEN f = '{f}' THEN n END), 0) n_{f}" for f in R.FIELDS if f != 'body')} FROM bodyn b LEFT JOIN per USING (query, url) GROUP BY ALL)"""


def _ranked(score: str, source: str) -> str:
    return f"SELECT query, url, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, url) AS rank FROM (SELECT query, url, round({score}, 9) + 0 AS score FROM {source})"


def _dot(weights: dict[str, float], scale: dict[str, str] | None = None) -> str:
    return "sum(weight * (" + " + ".join(f"{w} * tf_{f} / (body_length + 500){' * ' + scale[f] if scale else ''}" for f, w in weights.items()) + "))"


_B = R.BM25F_B
BM = f"""bm AS (SELECT t.query, t.url, term, t.pagerank,
    0.4 * tf_url / (1 + {_B['url']} * (url_length / av_url - 1)) + 0.2 * tf_title / nullif(1 + {_B['title']} * (title_length / av_title - 1), 0)
    + 0.05 * tf_body / (1 + {_B['body']} * (l.body_length / av_body - 1))
    + CASE WHEN header_count > 0 THEN 0.05 * tf_header / (1 + {_B['header']} * (header_length / (av_header * header_count) - 1)) ELSE 0 END
    + CASE WHEN anchor_count > 0 THEN 0.3 * tf_anchor / (1 + {_B['anchor']} * (anchor_length / (av_anchor * anchor_count) - 1)) ELSE 0 END w
    FROM tf t JOIN ln_ l USING (query, url), av),
    bm_score AS (SELECT query, url, sum(w / (1.2 + w) * idf) + CASE WHEN any_value(pagerank) > 0 THEN ln(any_value(pagerank)) ELSE 0 END s FROM bm JOIN qv USING (query, term) GROUP BY 1, 2)"""
EXCESS = {f: f"(1 + CASE WHEN w_{f} IS NULL THEN 0 ELSE 1.9::DOUBLE / greatest(1 + w_{f} - n, 1) END)" for f in R.FIELDS}
RATIO = {f: f"(1 + coalesce(1.9 * n / w_{f}, 0)) * (1 + ln(1 + n_{f}))" for f in R.FIELDS}
HITS = "hits AS (SELECT query, url, coalesce(list_sum(list_transform(map_values(body_hits), lambda p: coalesce(len(p), 0))), 0)::DOUBLE s, body_length FROM rec)"
RUN = f"run AS ({_ranked('s', 'hits')})"
NDCG = f"""j AS (SELECT query, url, rank, greatest(body_length % 5 - 1, 0)::DOUBLE rel FROM run JOIN rec USING (query, url)),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, url) ideal FROM j),
    nd AS (SELECT query, round(CASE WHEN sum((2 ** rel - 1) / log2(1 + ideal)) > 0 THEN sum((2 ** rel - 1) / log2(1 + rank)) / sum((2 ** rel - 1) / log2(1 + ideal)) ELSE 1 END, 9) ndcg FROM k GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "rank_records": f"WITH {REC} SELECT query, url, title, len(header) AS n_header, len(map_keys(body_hits)) AS n_hits, body_length, pagerank, len(map_keys(anchors)) AS n_anchors FROM rec",
    "rank_field_lengths": f"WITH {REC}, {LEN} SELECT query, url, url_length, title_length, header_length, header_count, anchor_length, anchor_count FROM ln_",
    "rank_length_averages": f"WITH {REC}, {LEN}, {AVG} SELECT * FROM av",
    "rank_idf": f"WITH {IDF} SELECT term, round(idf, 9) AS idf FROM idf",
    "rank_query_terms": f"WITH {REC}, {TERMS} SELECT query, term FROM qt",
    "rank_query_vector": f"WITH {REC}, {IDF}, {QV} SELECT query, term, round(weight, 9) AS weight FROM qv",
    "rank_raw_tf": f"WITH {REC}, {TERMS}, {TF} SELECT query, url, term, tf_url, tf_title, tf_body, tf_header, tf_anchor FROM tf",
    "rank_sublinear_tf": f"WITH {REC}, {TERMS}, {TF} SELECT query, url, term, " + ", ".join(f"round(CASE WHEN tf_{f} > 0 THEN 1 + ln(tf_{f}) ELSE 0 END / (body_length + 500), 9) AS tf_{f}" for f in R.FIELDS) + " FROM tf",
    "rank_url_words": f"WITH {REC} SELECT query, url, array_to_string({URL_WORDS}, ' ') AS words, len(regexp_split_to_array(trim(url, '/'), '//|/|\\.|\\?|=')) AS url_length FROM rec r",
    "rank_windows": f"WITH {REC}, {TERMS}, {WIN} SELECT query, url, " + ", ".join(f"CAST(w_{f} AS BIGINT) AS w_{f}" for f in R.FIELDS) + " FROM wide",
    "rank_window_boosts": f"WITH {REC}, {TERMS}, {WIN} SELECT query, url, round({EXCESS['title']}, 9) AS by_excess, round(1 + coalesce(1.9 * n / w_title, 0), 9) AS by_ratio FROM wide JOIN qn USING (query)",
    "rank_window_counts": f"WITH RECURSIVE {REC}, {TERMS}, {COUNTS} SELECT query, url, " + ", ".join(f"n_{f}" for f in R.FIELDS) + " FROM counts",
    "rank_top_terms": f"WITH {REC}, {IDF}, {QV} SELECT query, term FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY weight DESC, pos) r, count(*) OVER (PARTITION BY query) c FROM qv) WHERE r <= greatest(floor(c * 0.55::DOUBLE), 1)",
    "rank_hit_count": f"WITH {REC}, {HITS} {_ranked('s', 'hits')}",
    "rank_cosine": f"WITH {REC}, {TERMS}, {TF}, {IDF}, {QV}, s AS (SELECT query, url, {_dot(R.COSINE)} s FROM tf JOIN qv USING (query, term) GROUP BY 1, 2) {_ranked('s', 's')}",
    "rank_bm25f": f"WITH {REC}, {TERMS}, {TF}, {IDF}, {QV}, {LEN}, {AVG}, {BM} {_ranked('s', 'bm_score')}",
    "rank_smallest_window": f"WITH {REC}, {TERMS}, {TF}, {IDF}, {QV}, {WIN}, s AS (SELECT query, url, {_dot(R.WINDOWS, EXCESS)} s FROM tf JOIN qv USING (query, term) JOIN wide USING (query, url) JOIN qn USING (query) GROUP BY 1, 2) {_ranked('s', 's')}",
    "rank_window_count": f"WITH RECURSIVE {REC}, {TERMS}, {TF}, {IDF}, {QV}, {WIN}, {COUNTS.replace(TEXTS + ',', '')}, s AS (SELECT query, url, {_dot(R.WINDOWS, RATIO)} s FROM tf JOIN qv USING (query, term) JOIN wide USING (query, url) JOIN counts USING (query, url) JOIN qn USING (query) GROUP BY 1, 2) {_ranked('s', 's')}",
    "rank_run": "SELECT query, url, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, url) AS rank FROM (SELECT query, url, round(max(score), 9) AS score FROM run_scores WHERE query IS NOT NULL AND url IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)",
    "rank_ndcg": f"WITH {REC}, {HITS}, {RUN}, {NDCG} SELECT query, ndcg FROM nd",
    "rank_mean_ndcg": f"WITH {REC}, {HITS}, {RUN}, {NDCG} SELECT round(avg(ndcg), 6) AS mean_ndcg, count(*) AS n_queries FROM nd",
    "rank_run_text": f"WITH {REC}, {HITS}, {RUN} SELECT query, rank, '  url: ' || url AS line FROM run UNION ALL SELECT DISTINCT query, 0, 'query: ' || query FROM run",
}
