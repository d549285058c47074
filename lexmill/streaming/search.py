"""Conjunctive search for a stream of queries against a static index."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import tokens
from lexmill.operators.index import NO_RESULT, boolean_and
from lexmill.session import release, written


def answer_stream(queries: DataFrame, words: DataFrame, posts: DataFrame, doc_dict: DataFrame, path: str, checkpoint: str):
    """Starts a stream that appends (query, doc_name) for each micro-batch of queries to the Parquet table at path.

    Queries are independent of each other, so the stream has no state. posts are those of a stored index, of which a
    batch reads the words of its queries; the tables a batch writes are deleted when it ends.
    """

    def answer(batch: DataFrame, number: int) -> None:
        since = written()
        asked = batch.select("query").where(F.size(tokens(F.col("query"))) > 0).distinct()
        found = boolean_and(asked, words, posts).join(doc_dict.select("doc_id", "doc_name"), "doc_id").select("query", "doc_name")
        asked.join(found, "query", "left").select("query", F.coalesce("doc_name", F.lit(NO_RESULT)).alias("doc_name")).write.mode("append").parquet(path)
        release(batch.sparkSession, since)

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
