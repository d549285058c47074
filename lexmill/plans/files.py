"""Queries through the text files that the engine reads and writes."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.plans import ranking as P
from lexmill.plans import spelling as Q
from lexmill.session import materialise, shared_path
from lexmill.sources import files


def _text(df: DataFrame, column: str, label: str) -> str:
    path = shared_path(df.sparkSession, label)
    df.select(column).write.text(path)
    return path


def file_lines(spark, sf):
    """Lines of a language-model corpus."""
    lines = files.read_lines(spark, _text(Q._lines(spark, sf).where(r"NOT line RLIKE '[\r\n]'"), "line", "lines"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("cnt"))


def file_pairs(spark, sf):
    """Edit pairs of tab-separated lines."""
    pairs = Q._pairs(spark, sf).select(F.concat_ws("\t", "query", "corrected").alias("line"))
    return files.read_edit_pairs(spark, _text(pairs, "line", "pairs"))


def file_queries(spark, sf):
    asked = P.recs(spark, sf).select("query").distinct()
    return files.read_queries(spark, _text(asked, "query", "queries"))


def file_run(spark, sf):
    """A ranked run, written and read."""
    path = shared_path(spark, "run")
    files.write_run(P.rank_hit_count(spark, sf), path)
    return files.read_judged(spark, path).select("query", "rank", "url")


def file_features(spark, sf):
    """Feature records, written and read; hits and anchors counted."""
    path = shared_path(spark, "features")
    files.write_features(materialise(P.recs(spark, sf), "records"), path)
    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)
    read = files.read_features(spark, path)
    places = total(F.transform(F.flatten(F.map_values("body_hits")), lambda x: x.cast("bigint"))).alias("places")
    return read.select("query", "url", "title", F.array_join("header", "|").alias("header"), F.size("body_hits").alias("n_hits"), places, "body_length", "pagerank", F.size("anchors").alias("n_anchors"), total(F.transform(F.map_values("anchors"), lambda x: x.cast("bigint"))).alias("anchors"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (file_lines, file_pairs, file_queries, file_run, file_features)}

_BLANK = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
ORACLES: dict[str, str] = {
    "file_lines": f"WITH {Q.SRC} SELECT line, count(*) AS cnt FROM lines WHERE NOT regexp_matches(line, '[\\r\\n]') GROUP BY 1",
    "file_pairs": f"WITH {Q.SRC} SELECT query, corrected FROM pairs",
    "file_queries": f"WITH {P.REC} SELECT DISTINCT query FROM rec",
    "file_run": f"WITH {P.REC}, {P.HITS}, {P.RUN} SELECT query, rank, url FROM run",
    "file_features": f"""WITH {P.REC} SELECT query, url, {_BLANK.format('title')} AS title, array_to_string(list_transform(header, lambda h: {_BLANK.format('h')}), '|') AS header,
        len(map_keys(body_hits))::INT AS n_hits, coalesce(list_sum(flatten(map_values(body_hits))), 0)::BIGINT AS places, body_length, pagerank, len(map_keys(anchors))::INT AS n_anchors, coalesce(list_sum(map_values(anchors)), 0)::BIGINT AS anchors FROM rec""",
}
