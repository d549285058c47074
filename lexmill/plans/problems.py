"""Queries of the general data problems."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.bad_rows import strict_load
from lexmill.operators.skewed_keys import compress, key_percentiles, key_summary, wrong_doc_freq


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_load(table(spark, sf_dir, "feature_raw")).rejected


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed records, hits written as text."""
    valid = strict_load(table(spark, sf_dir, "feature_raw")).valid
    hit = lambda h: F.concat_ws(" ", h["term"], F.array_join(F.transform(h["positions"], lambda x: x.cast("string")), " "))
    return valid.withColumn("body_hits", F.array_join(F.transform("body_hits", hit), ";"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_doc_freq(table(spark, sf_dir, "term_docs"), table(spark, sf_dir, "posting_dict"))


def p6_term_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_summary(compress(table(spark, sf_dir, "term_docs"), "term_id", "doc_id")).withColumnRenamed("key", "term_id")


def p6_term_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = key_percentiles(compress(table(spark, sf_dir, "term_docs"), "term_id", "doc_id"), [0.25, 0.5, 0.75])
    return done.withColumnRenamed("key", "term_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_loaded, p6_found, p6_term_summary, p6_term_percentiles)}

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_NUMBER = "CASE WHEN regexp_full_match({0}, '[0-9]+') THEN TRY_CAST({0} AS BIGINT) END"
_LINES = f"""l AS (SELECT line_id, coalesce(line_text, '') l FROM feature_raw),
        r AS (SELECT line_id, regexp_full_match(l, '{_FIELD}(?:,{_FIELD})*') q, regexp_extract_all(l || ',', '({_FIELD}),', 1) raw FROM l),
        f AS (SELECT line_id, q, list_transform(raw, lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, ' ')) f FROM r),
        n AS (SELECT line_id, q, f, {_NUMBER.format('f[5]')} body, {_NUMBER.format('f[6]')} pr, {_NUMBER.format('f[8]')} cnt,
            list_transform(string_split(f[4], ';'), lambda e: regexp_extract_all(e, '[^ ]+')) entries,
            list_transform(list_transform(string_split(f[4], ';'), lambda e: regexp_extract_all(e, '[^ ]+')), lambda t: list_transform(t[2:], lambda x: {_NUMBER.format('x')})) hits FROM f)"""
#: Reasons for which a line of eight fields is rejected.
_CHECKS = {
    "body_hits": "f[4] <> '' AND len(list_filter(hits, lambda h: coalesce(len(h) > 0 AND len(list_filter(h, lambda x: x IS NULL)) = 0 AND list_sort(list_distinct(h)) = h AND h[-1] <= body, false))) <> len(hits)",
    "body_length": "body IS NULL",
    "pagerank": "NOT coalesce(pr BETWEEN 0 AND 10, false)",
    "stanford_anchor_count": "CASE WHEN f[7] = '' THEN f[8] <> '' ELSE NOT coalesce(cnt BETWEEN 1 AND 2147483647, false) END",
}
ORACLES: dict[str, str] = {
    "p1_found": f"""
        WITH {_LINES}
        SELECT line_id, 'quoting' AS reason FROM n WHERE NOT q
        UNION SELECT line_id, 'columns' FROM n WHERE q AND len(f) <> 8"""
    + "".join(f"\n        UNION SELECT line_id, '{reason}' FROM n WHERE q AND len(f) = 8 AND {check}" for reason, check in _CHECKS.items()),
    "p1_loaded": f"""
        WITH {_LINES}
        SELECT line_id, f[1] AS query, f[2] AS url, f[3] AS title, CASE WHEN f[4] = '' THEN '' ELSE array_to_string(list_transform(list_zip(entries, hits), lambda z: z[1][1] || ' ' || array_to_string(z[2], ' ')), ';') END AS body_hits,
            body AS body_length, CAST(pr AS INT) AS pagerank, nullif(f[7], '') AS anchor_text, CAST(cnt AS INT) AS stanford_anchor_count
        FROM n WHERE q AND len(f) = 8 AND NOT ("""
    + ") AND NOT (".join(_CHECKS.values())
    + ")",
    "p6_found": """
        WITH held AS (SELECT term_id, count(DISTINCT doc_id) n FROM term_docs WHERE term_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
        rec AS (SELECT term_id, sum(coalesce(doc_freq, 0)) n FROM (SELECT DISTINCT * FROM posting_dict WHERE term_id IS NOT NULL) GROUP BY 1)
        SELECT coalesce(h.term_id, r.term_id) AS term_id FROM held h FULL JOIN rec r ON h.term_id = r.term_id
        WHERE coalesce(h.n, 0) <> coalesce(r.n, 0)""",
    "p6_term_summary": """
        WITH c AS (SELECT term_id, doc_id, count(*) w FROM term_docs WHERE term_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2)
        SELECT term_id, CAST(sum(w) AS BIGINT) AS n_rows, count(*) AS n_distinct, arg_min(doc_id, (-w, doc_id)) AS mode FROM c GROUP BY 1""",
    "p6_term_percentiles": """
        WITH c AS (SELECT term_id, doc_id, count(*) w FROM term_docs WHERE term_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, sum(w) OVER (PARTITION BY term_id ORDER BY doc_id) AS run, sum(w) OVER (PARTITION BY term_id) AS total FROM c),
        f AS (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS fraction)
        SELECT term_id, fraction, doc_id AS value FROM r, f
        WHERE run >= greatest(ceil(fraction * total), 1) AND run - w < greatest(ceil(fraction * total), 1)""",
}
