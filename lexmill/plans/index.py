"""Queries of the inverted index."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import codecs as C
from lexmill.operators import index as I  # noqa: E741
from lexmill.plans.problems import table
from lexmill.session import materialise, merged, shared_path
from lexmill.sources.files import read_directory, read_index, write_index


def _docs(spark, sf):
    return I.corpus(table(spark, sf, "documents"))


def _occ(spark, sf):
    return I.occurrences(table(spark, sf, "term_docs"))


def _queries(spark, sf):
    """The ranking queries, and each word with its successor in the dictionary."""
    words = table(spark, sf, "word_dict").select("word_id", "term")
    after = words.select((F.col("word_id") - 1).alias("word_id"), F.col("term").alias("next"))
    two = words.join(merged(after), "word_id").select(F.concat_ws(" ", "term", "next").alias("query"))
    return table(spark, sf, "ranking_features").select("query").unionByName(two)


def _ids(c="doc_ids"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias("doc_ids")


def idx_corpus(spark, sf):
    return _docs(spark, sf).select("block", "doc_name", "doc_id", F.length("text").cast("bigint").alias("n"))


def idx_count_files(spark, sf):
    return _docs(spark, sf).agg(F.count(F.lit(1)).alias("n_files"))


def idx_doc_dict(spark, sf):
    return I.document_dictionary(_docs(spark, sf))


def idx_doc_dict_from_one(spark, sf):
    return I.document_dictionary(_docs(spark, sf), first=1)


def idx_tokens(spark, sf):
    return I.document_tokens(_docs(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("term").alias("n_terms"))


def idx_term_dict(spark, sf):
    return I.term_dictionary(I.document_tokens(_docs(spark, sf)))


def idx_postings(spark, sf):
    return I.postings(_occ(spark, sf)).select("term_id", "segment", "cf", "df", _ids())


def idx_block_postings(spark, sf):
    return I.postings(_occ(spark, sf), "block").select("block", "term_id", "segment", "cf", "df", _ids())


def idx_merged_postings(spark, sf):
    return I.merge_blocks(I.postings(_occ(spark, sf), "block")).select("term_id", "segment", "cf", "df", _ids())


def idx_directory(spark, sf):
    return I.directory(I.postings(_occ(spark, sf)))


def idx_gaps(spark, sf):
    return I.postings(_occ(spark, sf)).select("term_id", "segment", F.array_join(F.transform(C.gaps(F.col("doc_ids")), lambda x: x.cast("string")), ",").alias("gaps"))


def idx_vb(spark, sf):
    return I.postings(_occ(spark, sf)).select("term_id", "segment", F.hex(C.vb_encode(F.col("doc_ids"))).alias("code"))


def idx_vb_decoded(spark, sf):
    written = materialise(I.postings(_occ(spark, sf)).select("term_id", "segment", C.vb_encode(F.col("doc_ids")).alias("code")), "vb")
    return written.select("term_id", "segment", C.vb_decode("code").alias("doc_ids")).select("term_id", "segment", _ids())


def idx_gamma(spark, sf):
    return I.postings(_occ(spark, sf)).select("term_id", "segment", F.hex(C.gamma_encode(F.col("doc_ids"))).alias("code"))


def idx_gamma_decoded(spark, sf):
    written = materialise(I.postings(_occ(spark, sf)).select("term_id", "segment", C.gamma_encode(F.col("doc_ids")).alias("code")), "gamma")
    return written.select("term_id", "segment", C.gamma_decode("code").alias("doc_ids")).select("term_id", "segment", _ids())


def idx_written(spark, sf):
    """The index after writing and reading it."""
    path = shared_path(spark, "index")
    words = table(spark, sf, "word_dict").select(F.col("word_id").alias("term_id"), "term")
    write_index(path, table(spark, sf, "doc_dict"), words, I.postings(_occ(spark, sf)))
    docs, terms, posts = read_index(spark, path)
    return posts.join(terms, "term_id").select("term", "segment", "cf", "df", _ids())


def idx_query_words(spark, sf):
    return I.query_words(_queries(spark, sf), table(spark, sf, "word_dict"))


def idx_rarest_word(spark, sf):
    return I.rarest_words(I.query_words(_queries(spark, sf), table(spark, sf, "word_dict")), I.directory(I.postings(_occ(spark, sf))))


def idx_boolean_and(spark, sf):
    return I.boolean_and(_queries(spark, sf), table(spark, sf, "word_dict"), I.postings(_occ(spark, sf)))


def idx_boolean_answers(spark, sf):
    return I.boolean_answers(_queries(spark, sf), table(spark, sf, "word_dict"), I.postings(_occ(spark, sf)), table(spark, sf, "doc_dict"))


def idx_ordered_answers(spark, sf):
    """The answers in order, from an index that was written and read."""
    path = shared_path(spark, "index")
    words = table(spark, sf, "word_dict").select(F.col("word_id").alias("term_id"), "term")
    write_index(path, table(spark, sf, "doc_dict"), words, I.postings(_occ(spark, sf)))
    docs, terms, posts = read_index(spark, path)
    return I.ordered_answers(I.boolean_answers(_queries(spark, sf), terms.withColumnRenamed("term_id", "word_id"), posts, docs))


def idx_written_directory(spark, sf):
    """The directory of terms after writing and reading it."""
    path = shared_path(spark, "index")
    words = table(spark, sf, "word_dict").select(F.col("word_id").alias("term_id"), "term")
    write_index(path, table(spark, sf, "doc_dict"), words, I.postings(_occ(spark, sf)))
    return read_directory(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        idx_corpus, idx_count_files, idx_doc_dict, idx_doc_dict_from_one, idx_tokens, idx_term_dict, idx_postings, idx_block_postings, idx_merged_postings, idx_directory,
        idx_gaps, idx_vb, idx_vb_decoded, idx_gamma, idx_gamma_decoded, idx_written, idx_query_words, idx_rarest_word, idx_boolean_and, idx_boolean_answers,
        idx_ordered_answers, idx_written_directory,
    )
}

DOCS = "docs AS (SELECT coalesce(lower(trim(source)), 'none') block, doc_name, doc_id, coalesce(text, '') AS text FROM documents)"
OCC = "occ AS (SELECT block, term_id, doc_id FROM term_docs WHERE term_id IS NOT NULL AND doc_id IS NOT NULL)"
PAIRS = f"{OCC}, pairs AS (SELECT term_id, doc_id, count(*) tf, doc_id // {I.SEGMENT} AS segment FROM occ GROUP BY 1, 2)"
POSTS = f"{PAIRS}, posts AS (SELECT term_id, segment, sum(tf)::BIGINT cf, count(*) df, list(doc_id ORDER BY doc_id) ids FROM pairs GROUP BY 1, 2)"
GAPS = f"{POSTS}, g AS (SELECT term_id, segment, list_transform(ids, lambda x, i: x - CASE WHEN i = 1 THEN 0 ELSE ids[i - 1] END) gaps FROM posts)"
_VB = "lambda g: " + "CASE WHEN g < 128 THEN printf('%02X', g + 128) WHEN g < 16384 THEN printf('%02X%02X', g >> 7, (g & 127) + 128) WHEN g < 2097152 THEN printf('%02X%02X%02X', g >> 14, (g >> 7) & 127, (g & 127) + 128) ELSE printf('%02X%02X%02X%02X', g >> 21, (g >> 14) & 127, (g >> 7) & 127, (g & 127) + 128) END"
BITS = f"{GAPS}, bits AS (SELECT term_id, segment, array_to_string(list_transform(gaps, lambda g: repeat('1', length(bin(g + 1)) - 1) || '0' || substr(bin(g + 1), 2)), '') b FROM g), full_ AS (SELECT *, rpad(b, CAST(8 * ceil(length(b) / 8) AS INT), '1') f FROM bits)"
WORDS = "asked AS (SELECT query FROM ranking_features UNION SELECT a.term || ' ' || b.term FROM word_dict a JOIN word_dict b ON b.word_id = a.word_id + 1), qw AS (SELECT query, q.term, word_id AS term_id FROM (SELECT query, unnest(list_distinct(regexp_extract_all(query, '\\S+'))) term FROM (SELECT DISTINCT query FROM asked WHERE query IS NOT NULL)) q LEFT JOIN word_dict w ON w.term = q.term)"
AND = f"{PAIRS}, {WORDS}, n AS (SELECT query, count(*) n FROM qw GROUP BY 1), found AS (SELECT query, doc_id FROM qw JOIN pairs USING (term_id) JOIN n USING (query) GROUP BY query, doc_id, n HAVING count(*) = n)"
_POSTED = "SELECT term_id, segment, cf, df, array_to_string(ids, ',') AS doc_ids FROM posts"

ORACLES: dict[str, str] = {
    "idx_corpus": f"WITH {DOCS} SELECT block, doc_name, doc_id, length(text) AS n FROM docs",
    "idx_count_files": "SELECT count(*) AS n_files FROM documents",
    "idx_doc_dict": f"WITH {DOCS} SELECT row_number() OVER (ORDER BY block, doc_name, doc_id) - 1 AS doc_no, block, doc_name, doc_id FROM docs",
    "idx_doc_dict_from_one": f"WITH {DOCS} SELECT row_number() OVER (ORDER BY block, doc_name, doc_id) AS doc_no, block, doc_name, doc_id FROM docs",
    "idx_tokens": f"WITH {DOCS}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) term FROM docs) SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM t GROUP BY 1",
    "idx_term_dict": f"WITH {DOCS}, t AS (SELECT doc_id, unnest(w) term, unnest(range(len(w))) pos FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') w FROM docs)) SELECT row_number() OVER (ORDER BY f.d, f.p, term) - 1 AS term_id, term FROM (SELECT term, min({{'d': doc_id, 'p': pos}}) f FROM t GROUP BY 1)",
    "idx_postings": f"WITH {POSTS} {_POSTED}",
    "idx_block_postings": f"WITH {OCC}, p AS (SELECT block, term_id, doc_id, count(*) tf FROM occ GROUP BY 1, 2, 3) SELECT block, term_id, doc_id // {I.SEGMENT} AS segment, sum(tf)::BIGINT AS cf, count(*) AS df, array_to_string(list(doc_id ORDER BY doc_id), ',') AS doc_ids FROM p GROUP BY 1, 2, 3",
    "idx_merged_postings": f"WITH {POSTS} {_POSTED}",
    "idx_directory": f"WITH {PAIRS} SELECT term_id, sum(tf)::BIGINT AS cf, count(*) AS df FROM pairs GROUP BY 1",
    "idx_gaps": f"WITH {GAPS} SELECT term_id, segment, array_to_string(gaps, ',') AS gaps FROM g",
    "idx_vb": f"WITH {GAPS} SELECT term_id, segment, array_to_string(list_transform(gaps, {_VB}), '') AS code FROM g",
    "idx_vb_decoded": f"WITH {POSTS} SELECT term_id, segment, array_to_string(ids, ',') AS doc_ids FROM posts",
    "idx_gamma": f"WITH {BITS} SELECT term_id, segment, array_to_string(list_transform(range(length(f) // 8), lambda i: printf('%02X', list_sum(list_transform(range(8), lambda j: CAST(substr(f, 8 * i + j + 1, 1) AS INT) << (7 - j)))::INT)), '') AS code FROM full_",
    "idx_gamma_decoded": f"WITH {POSTS} SELECT term_id, segment, array_to_string(ids, ',') AS doc_ids FROM posts",
    "idx_written": f"WITH {POSTS} SELECT w.term, segment, cf, df, array_to_string(ids, ',') AS doc_ids FROM posts JOIN word_dict w ON word_id = term_id",
    "idx_query_words": f"WITH {WORDS} SELECT query, term, term_id FROM qw",
    "idx_rarest_word": f"WITH {PAIRS}, {WORDS}, d AS (SELECT term_id, sum(tf)::BIGINT cf FROM pairs GROUP BY 1) SELECT query, CASE WHEN count(*) FILTER (cf IS NULL) = 0 THEN arg_min(term_id, (cf, term_id)) END AS term_id, count(*) AS n_terms, count(*) FILTER (cf IS NULL) AS missing FROM qw LEFT JOIN d USING (term_id) GROUP BY 1",
    "idx_boolean_and": f"WITH {AND} SELECT query, doc_id FROM found",
    "idx_boolean_answers": f"WITH {AND} SELECT n.query, coalesce(doc_name, 'no results found') AS doc_name FROM n LEFT JOIN (SELECT query, doc_name FROM found JOIN doc_dict USING (doc_id)) f ON f.query = n.query",
    "idx_ordered_answers": f"WITH {AND}, names AS (SELECT n.query, coalesce(doc_name, 'no results found') doc_name FROM n LEFT JOIN (SELECT query, doc_name FROM found JOIN doc_dict USING (doc_id)) f ON f.query = n.query) SELECT query, row_number() OVER (PARTITION BY query ORDER BY doc_name) AS place, doc_name FROM names",
    "idx_written_directory": f"WITH {POSTS} SELECT term_id, sum(cf)::BIGINT AS cf, sum(df)::BIGINT AS df, list(segment ORDER BY segment)[1] AS first_segment, count(*) AS n_segments FROM posts GROUP BY 1",
}
