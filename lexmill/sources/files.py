"""Text files in and out: corpora, edit pairs, feature files, runs and relevance files, and index tables."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.positions import global_positions, running_name
from lexmill.operators.skewed_keys import join_held
from lexmill.session import materialise


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of files without content, which no file source lists: each folder is listed in a task."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    blocks = [(f.getPath().toString(),) for f in at.getFileSystem(conf).listStatus(at) if f.isDirectory()]  # one row a block

    def listed(batches):
        from pyarrow import fs

        for b in batches:
            found = []
            for block in b.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(block)
                found += [f"{block.rstrip('/')}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and not f.size]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])

    tasks = min(max(len(blocks), 1), spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(blocks, "path string").repartition(tasks).mapInArrow(listed, "path string")


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(block, doc_name, text) of root/<block>/<file>; a document is a whole file, named block/file."""
    whole = spark.read.format("binaryFile").load(f"{root}/*/*").select("path", F.decode("content", "UTF-8").alias("text"))
    empty = _empty_files(spark, root).select("path", F.lit("").alias("text"))
    parts = F.split("path", "/")
    block, name = F.element_at(parts, -2), F.element_at(parts, -1)
    return whole.unionByName(empty).select(block.alias("block"), F.concat_ws("/", block, name).alias("doc_name"), "text")


def read_lines(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(line) of every file that fits the pattern: one line, one language-model document."""
    return spark.read.text(folder, pathGlobFilter=pattern).withColumnRenamed("value", "line")


def read_edit_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(query, corrected) of tab-separated lines; blank lines and lines without a tab are skipped."""
    parts = F.split("value", "\t", -1)
    return spark.read.text(path).where(F.trim("value") != "").where(F.size(parts) >= 2).select(parts[0].alias("query"), parts[1].alias("corrected"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "query")


def _keyed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(q, u, at, key, value): the `key: value` lines of files, with how many query and url lines there are up to each.

    Lines are read as such, so files of any size are split among tasks; they are put in order by file, the start of the
    split in it, and their order within that.
    """
    parts = r"^[ \t]*(\w+):[ \t]*(.*?)[ \t]*$"
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    lines = read.select(F.lit(0).alias("all"), "file", "start", "id", F.regexp_extract("value", parts, 1).alias("key"), F.regexp_extract("value", parts, 2).alias("value")).where("key <> ''")
    marked = lines.withColumns({f"is_{k}": (F.col("key") == k).cast("int") for k in ("query", "url")}).withColumn("one", F.lit(1))
    order = [F.col(c).asc() for c in ("file", "start", "id")]
    numbered = global_positions(marked, ["all"], order, weight=["is_query", "is_url", "one"], label="lines")
    return numbered.select(F.col(running_name(0)).alias("q"), F.col(running_name(1)).alias("u"), F.col(running_name(2)).alias("at"), "key", "value")


def _queries_of(lines: DataFrame) -> DataFrame:
    """(q, query, urls): the query lines, and how many url lines follow each."""
    urls = F.count_if(F.col("key") == "url").alias("urls")
    return materialise(lines.where("q > 0 AND key IN ('query', 'url')").groupBy("q").agg(F.max(F.when(F.col("key") == "query", F.col("value"))).alias("query"), urls, F.min(F.when(F.col("key") == "url", F.col("u"))).alias("first")), "queries")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Ranking-feature records of files with `key: value` lines.

    A query holds until the next, a url until the next. A url given again in its query replaces its record, a query
    given again replaces its urls; the last count of an anchor text counts. A count belongs to the anchor text before it.
    """
    lines = _keyed_lines(spark, path)
    queries = _queries_of(lines)
    last_query = queries.groupBy("query").agg(F.max("q").alias("q"))
    kept = materialise(queries.join(last_query, ["query", "q"], "left_semi").where("urls > 0").select("q", "query", "urls"), "kept")
    # A url line has the count of the last query before it, and lines after it have its own.
    of_url = lines.where("q > 0 AND u > 0 AND key <> 'query'").groupBy("q", "u").agg(F.array_sort(F.collect_list(F.struct("at", "key", "value"))).alias("lines"))
    # Lines between a query and its first url are of no url.
    records = of_url.where(F.exists("lines", lambda x: x["key"] == "url")).withColumn("url", F.element_at(F.filter("lines", lambda x: x["key"] == "url"), 1)["value"])
    latest = records.groupBy("q", "url").agg(F.max_by("lines", "u").alias("lines"))
    found = join_held(materialise(latest, "records"), kept, ["q"], "urls")
    values = lambda key: F.transform(F.filter("lines", lambda x: x["key"] == key), lambda x: x["value"])
    hits = F.transform(values("body_hits"), lambda h: F.split(F.trim(h), r"\s+"))
    hit = lambda h: F.struct(h[0].alias("key"), F.transform(F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda x: x.try_cast("int")).alias("value"))
    last = lambda entries: F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    after = F.transform("lines", lambda x, i: F.struct(x["key"].alias("k"), x["value"].alias("key"), F.try_element_at("lines", (i + 2).cast("int")).alias("next")))
    counted = F.filter(after, lambda x: (x["k"] == "anchor_text") & (x["next"]["key"] == "stanford_anchor_count") & x["next"]["value"].try_cast("int").isNotNull())
    anchors = F.transform(counted, lambda x: F.struct(x["key"].alias("key"), x["next"]["value"].try_cast("int").alias("value")))
    first = lambda key: F.try_element_at(values(key), F.lit(-1))
    return found.select(
        "query",
        "url",
        first("title").alias("title"),
        values("header").alias("header"),
        F.map_from_entries(last(F.transform(hits, hit))).alias("body_hits"),
        first("body_length").try_cast("int").alias("body_length"),
        first("pagerank").try_cast("int").alias("pagerank"),
        F.map_from_entries(last(anchors)).alias("anchors"),
    )


def feature_lines(records: DataFrame) -> DataFrame:
    """(query, url, at, line): the lines of a feature file, a query's own with a null url, a record's from 0."""
    blank = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    line = lambda key, value: F.concat(F.lit(f"    {key}: "), value)
    hits = F.transform(F.map_entries("body_hits"), lambda h: line("body_hits", F.concat_ws(" ", h["key"], F.array_join(F.transform(h["value"], lambda x: x.cast("string")), " "))))
    anchors = F.flatten(F.transform(F.map_entries("anchors"), lambda a: F.array(line("anchor_text", blank(a["key"])), line("stanford_anchor_count", a["value"].cast("string")))))
    number = lambda c: line(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    head = F.array(F.concat(F.lit("  url: "), "url"), line("title", blank(F.col("title"))))
    every = F.concat(head, F.transform("header", lambda h: line("header", blank(h))), F.coalesce(hits, F.array().cast("array<string>")), F.array(number("body_length"), number("pagerank")), F.coalesce(anchors, F.array().cast("array<string>")))
    own = records.select("query", "url", F.posexplode(every).alias("at", "line"))
    heads = records.select("query").distinct().select("query", F.lit(None).cast("string").alias("url"), F.lit(0).alias("at"), F.concat(F.lit("query: "), "query").alias("line"))
    return own.unionByName(heads)


def write_features(records: DataFrame, path: str) -> None:
    """Feature files whose lines, file after file, are those of the records (one for each query and url). White space in
    texts becomes a blank."""
    order = [F.col("query").asc(), F.col("url").asc_nulls_first(), F.col("at").asc()]
    feature_lines(records).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    """(query, rank, url, rel) of run or relevance files: urls in order under their query; rel is a number after the
    url, else null. A query without urls has no rows."""
    lines = _keyed_lines(spark, path)
    urls = lines.where("q > 0 AND key = 'url'").select("q", "u", "value")
    found = join_held(urls, _queries_of(lines).where("urls > 0"), ["q"], "urls")
    scored = r"^(.*?)[ \t]+(-?[0-9]+(?:\.[0-9]+)?)$"
    has = F.col("value").rlike(scored)
    url = F.when(has, F.regexp_extract("value", scored, 1)).otherwise(F.col("value"))
    return found.select("query", (F.col("u") - F.col("first") + 1).alias("rank"), url.alias("url"), F.when(has, F.regexp_extract("value", scored, 2).cast("double")).alias("rel"))


def run_lines(run: DataFrame) -> DataFrame:
    """(query, rank, line): the lines of a run file, a query's own line at rank 0."""
    heads = run.select("query").distinct().select("query", F.lit(0).cast("bigint").alias("rank"), F.concat(F.lit("query: "), "query").alias("line"))
    return heads.unionByName(run.select("query", F.col("rank").cast("bigint").alias("rank"), F.concat(F.lit("  url: "), "url").alias("line")))


def write_run(run: DataFrame, path: str) -> None:
    """Text files whose lines, file after file, are the run."""
    run_lines(run).repartitionByRange("query", "rank").sortWithinPartitions("query", "rank").select("line").write.mode("overwrite").text(path)


def write_index(path: str, docs: DataFrame, terms: DataFrame, postings: DataFrame) -> None:
    """Dictionaries sorted by id, postings by term and segment, and the directory of terms, as Parquet."""
    for name, df, key in (("doc_dict", docs, "doc_id"), ("word_dict", terms, "term_id"), ("postings", postings, "term_id")):
        df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")
    segments = postings.groupBy("term_id").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"), F.min("segment").alias("first_segment"), F.count(F.lit(1)).alias("n_segments"))
    segments.repartitionByRange("term_id").sortWithinPartitions("term_id").write.mode("overwrite").parquet(f"{path}/directory")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, cf, df, first_segment, n_segments): where the postings of each term begin and how many there are."""
    return spark.read.parquet(f"{path}/directory")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("doc_dict", "word_dict", "postings"))


def write_model(path: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
