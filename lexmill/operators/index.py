"""The inverted index: dictionaries, postings and conjunctive search.

Postings are kept in segments: one row for a term and a range of document ids, so that no row grows with the
collection and a term in most documents is spread over tasks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import tokens
from lexmill.operators.positions import POS, global_positions
from lexmill.session import materialise, merged

SEGMENT = 16_384
NO_RESULT = "no results found"


def corpus(documents: DataFrame) -> DataFrame:
    """(block, doc_name, doc_id, text) with the source, without blanks and letter case, as the block."""
    block = F.coalesce(F.lower(F.trim("source")), F.lit("none"))
    return documents.select(block.alias("block"), "doc_name", "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def document_dictionary(docs: DataFrame, first: int = 0) -> DataFrame:
    """(doc_no, block, doc_name, doc_id): numbers in the order of block and name, from 0 (or another first)."""
    rows = docs.select(F.lit(0).alias("__all"), "block", "doc_name", "doc_id")
    numbered = global_positions(rows, ["__all"], [F.col("block").asc(), F.col("doc_name").asc(), F.col("doc_id").asc()], label="docs")
    return numbered.select((F.col(POS) - 1 + first).alias("doc_no"), "block", "doc_name", "doc_id")


def document_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term): white-space tokens, case kept."""
    return docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))


def term_dictionary(token_rows: DataFrame) -> DataFrame:
    """(term_id, term): ids from 0 in the order of a term's first occurrence."""
    first = token_rows.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("f"))
    rows = first.select(F.lit(0).alias("__all"), "term", "f.doc_id", "f.pos")
    numbered = global_positions(rows, ["__all"], [F.col("doc_id").asc_nulls_first(), F.col("pos").asc(), F.col("term").asc()], label="terms")
    return numbered.select((F.col(POS) - 1).alias("term_id"), "term")


def occurrences(term_docs: DataFrame) -> DataFrame:
    return term_docs.where("term_id IS NOT NULL AND doc_id IS NOT NULL").select("block", "term_id", "doc_id")


def pairs(occ: DataFrame, *keys: str) -> DataFrame:
    """One row for each term and document, with the occurrences there."""
    return occ.groupBy(*keys, "term_id", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def postings(occ: DataFrame, *keys: str) -> DataFrame:
    """(keys, term_id, segment, cf, df, doc_ids): ascending different documents and the number of occurrences."""
    held = pairs(occ, *keys).withColumn("segment", F.floor(F.col("doc_id") / SEGMENT))
    return held.groupBy(*keys, "term_id", "segment").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"), F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def merge_blocks(by_block: DataFrame) -> DataFrame:
    """Union of the blocks' postings: documents once, counts added. Blocks of one segment hold at most SEGMENT ids."""
    merged = by_block.groupBy("term_id", "segment").agg(F.sum("cf").alias("cf"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("doc_ids")))).alias("doc_ids"))
    return merged.select("term_id", "segment", "cf", F.size("doc_ids").cast("bigint").alias("df"), "doc_ids")


def directory(posts: DataFrame) -> DataFrame:
    """(term_id, cf, df) of every term of postings."""
    return posts.groupBy("term_id").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def query_words(queries: DataFrame, words: DataFrame) -> DataFrame:
    """(query, term, term_id): different tokens of each query; no term_id for words not in the dictionary."""
    at = queries.select("query").where("query IS NOT NULL").distinct().select("query", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    return at.join(merged(words.select(F.col("word_id").alias("term_id"), "term")), "term", "left").select("query", "term", "term_id")


def rarest_words(looked_up: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, term_id, n_terms, missing): the word of a query with the fewest occurrences, the least id among equals;
    none where words are missing from the dictionary or the postings."""
    known = looked_up.join(merged(terms), "term_id", "left")
    grouped = known.groupBy("query").agg(F.min(F.struct("cf", "term_id"))["term_id"].alias("least"), F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("cf").isNull()).alias("missing"))
    return grouped.select("query", F.when(F.col("missing") == 0, F.col("least")).alias("term_id"), "n_terms", "missing")


def boolean_and(queries: DataFrame, words: DataFrame, posts: DataFrame) -> DataFrame:
    """(query, doc_id) of the documents that hold every word of a query; none if a word is unknown.

    posts are postings, as read from a stored index: only those of the queries' words are read further. Candidates are
    the documents of the rarest word, so a frequent word costs one lookup for each of them by (word, document), which
    spreads evenly.
    """
    looked_up = materialise(query_words(queries, words), "words")
    needed = materialise(posts.join(merged(looked_up.select("term_id").distinct()), "term_id", "left_semi").select("term_id", "cf", "df", "doc_ids"), "needed")
    first = rarest_words(looked_up, directory(needed)).where("missing = 0")
    held = needed.select("term_id", F.explode("doc_ids").alias("doc_id"))
    words_of = looked_up.groupBy("query").agg(F.collect_set("term_id").alias("all"))
    least = first.join(merged(words_of), "query").select("query", "term_id", "n_terms", F.array_except("all", F.array("term_id")).alias("others"))
    candidates = least.join(merged(held), "term_id")
    others = candidates.select("query", "doc_id", "n_terms", F.explode("others").alias("term_id"))
    met = others.join(merged(held), ["term_id", "doc_id"]).groupBy("query", "doc_id", "n_terms").agg(F.count(F.lit(1)).alias("n"))
    several = met.where("n = n_terms - 1").select("query", "doc_id")
    return several.unionByName(candidates.where("n_terms = 1").select("query", "doc_id"))


def boolean_answers(queries: DataFrame, words: DataFrame, posts: DataFrame, doc_dict: DataFrame) -> DataFrame:
    """(query, doc_name): names of the found documents, or one row saying that there is none."""
    found = boolean_and(queries, words, posts).join(doc_dict.select("doc_id", "doc_name"), "doc_id").select("query", "doc_name")
    asked = queries.select("query").where("query IS NOT NULL").distinct()
    return asked.join(found, "query", "left").select("query", F.coalesce("doc_name", F.lit(NO_RESULT)).alias("doc_name"))


def ordered_answers(answers: DataFrame) -> DataFrame:
    """(query, place, doc_name): the names of each query in order, places from 1."""
    numbered = global_positions(answers, ["query"], [F.col("doc_name").asc()], label="answers")
    return numbered.select("query", F.col(POS).alias("place"), "doc_name")
