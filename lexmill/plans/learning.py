"""Queries of learning to rank on ranking_features, with made-up relevances."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import learning as L
from lexmill.plans import ranking as P
from lexmill.session import materialise


def _data(spark, sf):
    rows = materialise(P.recs(spark, sf), "records")
    return rows, P.docs(spark, sf), P.judgements(rows)


def _rounded(df, columns, *keys):
    return df.select(*keys, *[F.round(c, 8).alias(c) for c in columns])


def ltr_features5(spark, sf):
    rows, docs, _ = _data(spark, sf)
    return _rounded(L.features5(rows, docs), L.FIVE, "query", "url")


def ltr_features12(spark, sf):
    rows, docs, _ = _data(spark, sf)
    return _rounded(L.features12(rows, docs), L.TWELVE, "query", "url")


def ltr_standardised(spark, sf):
    rows, docs, rel = _data(spark, sf)
    return _rounded(L.standardised(L.labelled(L.features5(rows, docs), rel), L.FIVE), L.FIVE, "query", "url", "rel")


def ltr_pairs(spark, sf):
    rows, docs, rel = _data(spark, sf)
    x = materialise(L.standardised(L.labelled(L.features5(rows, docs), rel), L.FIVE), "features")
    return _rounded(L.pair_differences(x, L.FIVE), L.FIVE, "query", "url", "other", "label")


def ltr_levels(spark, sf):
    return L.ordinal_labels(_data(spark, sf)[2])


def _run(task):
    def query(spark, sf):
        rows, docs, rel = _data(spark, sf)
        return L.test(task, L.train(task, rows, docs, rel), rows, docs)

    return query


def ltr_least_squares_scaled(spark, sf):
    """The run on scaled features."""
    rows, docs, rel = _data(spark, sf)
    return L.test(1, L.train(1, rows, docs, rel), rows, docs, scaled=True)


def ltr_predicted_levels(spark, sf):
    rows, docs, rel = _data(spark, sf)
    return L.train(4, rows, docs, rel).level(L.features5(rows, docs))


def ltr_pdf(spark, sf):
    return P.recs(spark, sf).select("query", "url", L.ends_with_pdf(F.col("url")).alias("pdf"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (ltr_features5, ltr_features12, ltr_standardised, ltr_pairs, ltr_levels, ltr_least_squares_scaled, ltr_predicted_levels, ltr_pdf)} | {
    "ltr_least_squares": _run(1),
    "ltr_pairwise_svm": _run(2),
    "ltr_pairwise_svm12": _run(3),
    "ltr_ordinal": _run(4),
}

_SUB = lambda f: f"CASE WHEN tf_{f} > 0 THEN 1 + ln(tf_{f}) ELSE 0 END"
X5 = f"{P.REC}, {P.TERMS}, {P.TF}, {P.IDF}, {P.QV}, x5 AS (SELECT query, url, " + ", ".join(f"sum(weight * {_SUB(f)} / (body_length + 500)) x_{f}" for f in P.R.FIELDS) + " FROM tf JOIN qv USING (query, term) GROUP BY 1, 2)"
REL = "rel AS (SELECT query, url, CAST(body_length % 5 - 1 AS DOUBLE) rel FROM rec)"
Z5 = f"{X5}, {REL}, z AS (SELECT query, url, rel, " + ", ".join(f"(x_{f} - avg(x_{f}) OVER ()) / CASE WHEN stddev_pop(x_{f}) OVER () > 0 THEN stddev_pop(x_{f}) OVER () ELSE 1 END x_{f}" for f in P.R.FIELDS) + " FROM x5 JOIN rel USING (query, url))"

_N = len(L.FIVE)
_XS = "[" + ", ".join(L.FIVE) + "]"
#: Normal equations by elimination, column by column.
LEAST = f"""{X5}, {REL}, xy AS (SELECT {_XS} x, rel, [{', '.join([*L.FIVE, 'rel'])}] v FROM x5 JOIN rel USING (query, url)),
    mean AS (SELECT [{', '.join(f'avg(v[{i + 1}])' for i in range(_N + 1))}] mu FROM xy),
    cov AS (SELECT [{', '.join('[' + ', '.join(f'avg((v[{i + 1}] - mu[{i + 1}]) * (v[{j + 1}] - mu[{j + 1}]))' for j in range(_N + 1)) + ']' for i in range(_N))}] m FROM xy, mean),
    elim AS (SELECT 1 p, m FROM cov
        UNION ALL SELECT p + 1, list_transform(m, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda v: v / m[p][p]) ELSE list_transform(r, lambda v, j: v - r[p] * m[p][j] / m[p][p]) END) FROM elim WHERE p <= {_N}),
    w AS (SELECT [{', '.join(f'm[{i + 1}][{_N + 1}]' for i in range(_N))}] w FROM elim WHERE p = {_N + 1}),
    s AS (SELECT query, url, mu[{_N + 1}] + {' + '.join(f'w[{i + 1}] * (x_{f} - mu[{i + 1}])' for i, f in enumerate(P.R.FIELDS))} s FROM x5, w, mean)"""
#: One example a step, in the order of query and url, ten times over; the last threshold is infinite.
ORDINAL = f"""{X5}, {REL}, lv AS (SELECT rel, row_number() OVER (ORDER BY rel) - 1 AS level FROM (SELECT DISTINCT rel FROM rel)),
    ex AS (SELECT row_number() OVER (ORDER BY query, url) - 1 AS rn, level y, {_XS} x FROM x5 JOIN rel USING (query, url) JOIN lv USING (rel)),
    size AS (SELECT count(*) n, (SELECT count(*) FROM lv) k FROM ex),
    steps AS (SELECT w, b FROM (WITH RECURSIVE st(one, tick, w, b) USING KEY (one) AS (
        SELECT 1, 0::BIGINT, list_transform(range({_N}), lambda i: 0::DOUBLE), list_transform(range(k - 1), lambda i: 0::DOUBLE) FROM size
        UNION SELECT 1, tick + 1, list_transform(w, lambda v, i: v + list_sum(move) * x[i]), list_transform(b, lambda v, l: v - move[l]) FROM (
            SELECT *, CASE WHEN hit = y THEN list_transform(b, lambda v: 0) ELSE list_transform(b, lambda v, l: CASE WHEN (s - v) * (CASE WHEN y < l THEN -1 ELSE 1 END) <= 0 THEN CASE WHEN y < l THEN -1 ELSE 1 END ELSE 0 END) END move FROM (
                SELECT *, coalesce(list_position(list_transform(b, lambda v: s < v), true), len(b) + 1) - 1 AS hit FROM (
                    SELECT st.tick, st.w, st.b, ex.x, ex.y, list_sum(list_transform(st.w, lambda v, i: v * ex.x[i])) s FROM st, size JOIN ex ON ex.rn = st.tick % size.n WHERE st.tick < {L.EPOCHS} * size.n))))
        SELECT * FROM st)),
    s AS (SELECT query, url, list_sum(list_transform(w, lambda v, i: v * {_XS}[i])) s, b FROM x5, steps)"""

ORACLES: dict[str, str] = {
    "ltr_least_squares": f"WITH RECURSIVE {LEAST} {P._ranked('s', 's')}",
    "ltr_least_squares_scaled": f"WITH RECURSIVE {LEAST}, sc AS (SELECT query, url, mu[{_N + 1}] - ("
    + " + ".join(f"w[{i + 1}] * mu[{i + 1}]" for i in range(_N))
    + ") + "
    + " + ".join(f"w[{i + 1}] * (x_{f} - avg(x_{f}) OVER ()) / CASE WHEN stddev_pop(x_{f}) OVER () > 0 THEN stddev_pop(x_{f}) OVER () ELSE 1 END" for i, f in enumerate(P.R.FIELDS))
    + f" s FROM x5, w, mean) {P._ranked('s', 'sc')}",
    "ltr_ordinal": f"WITH RECURSIVE {ORDINAL} {P._ranked('s', 's')}",
    "ltr_predicted_levels": f"WITH RECURSIVE {ORDINAL} SELECT query, url, (coalesce(list_position(list_transform(b, lambda v: s < v), true), len(b) + 1) - 1)::INT AS level FROM s",
    "ltr_features5": f"WITH {X5} SELECT query, url, " + ", ".join(f"round({c}, 8) AS {c}" for c in L.FIVE) + " FROM x5",
    "ltr_features12": f"""WITH {X5}, {P.WIN}, {P.LEN}, {P.AVG}, {P.BM}
        SELECT x5.query, x5.url, {', '.join(f'round({c}, 8) AS {c}' for c in L.FIVE)}, round(s, 8) AS x_bm25f, round({P.EXCESS['body']}, 8) AS x_window, CAST(pagerank AS DOUBLE) AS x_pagerank,
            round(url_length / n, 8) AS x_url_length, CASE WHEN header_count > 0 THEN 1.0::DOUBLE ELSE 0 END AS x_has_header, CASE WHEN len(map_keys(anchors)) > 0 THEN 1.0::DOUBLE ELSE 0 END AS x_has_anchors,
            CASE WHEN contains(x5.url, 'www') THEN 1.0::DOUBLE ELSE -1 END AS x_www
        FROM x5 JOIN bm_score USING (query, url) JOIN wide USING (query, url) JOIN ln_ USING (query, url) JOIN qn USING (query)""",
    "ltr_standardised": f"WITH {Z5} SELECT query, url, rel, " + ", ".join(f"round({c}, 8) AS {c}" for c in L.FIVE) + " FROM z",
    "ltr_pairs": f"WITH {Z5} SELECT a.query, a.url, b.url AS other, CASE WHEN a.rel > b.rel THEN 1 ELSE -1 END AS label, " + ", ".join(f"round(a.{c} - b.{c}, 8) AS {c}" for c in L.FIVE) + " FROM z a JOIN z b ON a.query = b.query AND a.url < b.url AND a.rel <> b.rel",
    "ltr_levels": f"WITH {P.REC}, {REL} SELECT rel, row_number() OVER (ORDER BY rel) - 1 AS level FROM (SELECT DISTINCT rel FROM rel)",
    "ltr_pdf": f"WITH {P.REC} SELECT query, url, CASE WHEN lower(url) LIKE '%.pdf' THEN 1 ELSE -1 END AS pdf FROM rec",
}
