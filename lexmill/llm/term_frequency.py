"""How often every distinct term occurs, and in how many records, by recursive radix partitioning.

Occurrences are written to disk parted by bits of a hash of the term. A part with more rows than the capacity is
split by the next bits; where one term holds most of a part, by bits of a hash of the record, which leaves both
counts plain sums over the pieces. Each piece that fits is aggregated by DuckDB inside
one task, reading the piece's files as a stream.
"""

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import shared_path

#: Bits of one split: as many as make parts of half the capacity, within these bounds.
FEWEST_BITS, MOST_BITS = 3, 12
HASH_BITS = 60
SCHEMA = "term_id int, n_occurrences bigint, doc_freq bigint"
ROWS = "term_id int, doc_id bigint, pos int"


@dataclass
class _Part:
    """n rows that share `used` hash bits of their terms; by_record once these no longer split them."""

    name: str
    n: int
    used: int = 0
    by_record: bool = False

    def bits(self, capacity: int) -> int:
        wanted = min(max(ceil(log2(max(2 * self.n / capacity, 1))), FEWEST_BITS), MOST_BITS)
        return wanted if self.by_record else min(wanted, HASH_BITS - self.used)


def _count(folders: pd.Series, memory_mb: int) -> pd.DataFrame:
    import os
    import shutil
    import tempfile

    import duckdb
    from pyarrow import dataset, fs

    # Scratch of this task alone, beside the executor's own shuffle and spill files.
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    spill = tempfile.mkdtemp(prefix="radix-", dir=local if local and os.path.isdir(local) else None)
    out = []
    try:
        for folder in folders:
            system, path = fs.FileSystem.from_uri(folder)
            files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.endswith(".parquet")]
            con = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": spill})
            pairs = dataset.dataset(files, filesystem=system, format="parquet").scanner(columns=["term_id", "doc_id", "pos"], batch_size=65536).to_reader()  # noqa: F841
            out.append(con.sql("SELECT term_id, sum(n)::BIGINT AS n_occurrences, count(*) AS doc_freq FROM (SELECT term_id, doc_id, count(DISTINCT pos) AS n FROM pairs GROUP BY 1, 2) GROUP BY 1").df())
            con.close()
    finally:
        shutil.rmtree(spill, ignore_errors=True)
    return pd.concat(out) if out else pd.DataFrame({"term_id": np.array([], np.int32), "n_occurrences": np.array([], np.int64), "doc_freq": np.array([], np.int64)})


def _split(rows: DataFrame, parts: list[_Part], level: int, capacity: int, at: str) -> list[_Part]:
    """Writes the rows (with `part`, one of the given) parted by their next bits, one folder each below `at`."""
    spark = rows.sparkSession
    plan = spark.createDataFrame([(p.name, p.used, (1 << p.bits(capacity)) - 1, p.by_record) for p in parts], "part string, used int, mask bigint, by_record boolean")
    known = {p.name: p for p in parts}
    bits = F.when(F.col("by_record"), F.xxhash64("doc_id", F.lit(level))).otherwise(F.expr("shiftrightunsigned(xxhash64(term_id), used)")).bitwiseAND(F.col("mask"))
    # Files of a part are spread by record, so that a part of any size is written by many tasks.
    salt = F.xxhash64("doc_id").bitwiseAND(F.lit(7))
    next_ = rows.join(F.broadcast(plan), "part").select("term_id", "doc_id", "pos", F.concat_ws(".", "part", bits.cast("string")).alias("part"))
    next_.repartition(F.col("part"), salt).write.partitionBy("part").option("compression", "zstd").parquet(at)
    made = []
    for r in spark.read.schema(ROWS + ", part string").parquet(at).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each part
        was = known[r["part"].rsplit(".", 1)[0]]
        width = was.bits(capacity)
        # Twice its even share or more: one term holds most of it, and no bits of terms will split it.
        used, one_term = was.used + (0 if was.by_record else width), r["n"] >= 2 * was.n / (1 << width)
        made.append(_Part(r["part"], r["n"], used, was.by_record or one_term or used >= HASH_BITS))
    return made


def term_frequencies(occurrences: DataFrame, capacity: int = 2_000_000, memory_mb: int = 256) -> DataFrame:
    """(term_id, n_occurrences, doc_freq) of every term: different (doc_id, pos), and different doc_id, that hold it.

    Rows without term or document do not count; an occurrence delivered again (same document, position and term)
    counts once, as do rows without position, taken together, for each document and term. Columns other than
    term_id, doc_id and pos are ignored. An empty table gives an empty result. All parts above the capacity are split
    at once, level by level; the driver sees one row for each part, about twice as many as rows / capacity.
    """
    spark = occurrences.sparkSession
    rows = occurrences.select(F.col("term_id").cast("int"), F.col("doc_id").cast("bigint"), F.coalesce(F.col("pos").cast("int"), F.lit(-1)).alias("pos")).where("term_id IS NOT NULL AND doc_id IS NOT NULL")
    root = shared_path(spark, "radix")
    parts, leaves, level = [_Part("p", rows.count())], [], 0
    rows = rows.withColumn("part", F.lit("p"))
    while parts and parts[0].n:
        at = f"{root}/{level}"
        made = _split(rows, parts, level, capacity, at)
        before = {p.name: p for p in parts}
        # Rows of one record and term can't be split further; DuckDB takes them with its own spilling.
        stuck = lambda p, b=before: (was := b[p.name.rsplit(".", 1)[0]]).by_record and p.n > 0.9 * was.n
        parts = [p for p in made if p.n > capacity and not stuck(p)]
        open_ = {p.name for p in parts}
        leaves += [f"{at}/part={p.name}" for p in made if p.name not in open_]
        if not parts:
            break
        rows, level = spark.read.schema(ROWS + ", part string").option("basePath", at).parquet(*[f"{at}/part={p.name}" for p in parts]), level + 1
    if not leaves:
        return spark.createDataFrame([], SCHEMA)
    folders = spark.createDataFrame([(x, i) for i, x in enumerate(leaves)], "folder string, i int")
    tasks = min(len(leaves), max(4 * spark.sparkContext.defaultParallelism, 1))
    counted = folders.repartitionByRange(tasks, "i").select("folder").mapInPandas(lambda it: (_count(p["folder"], memory_mb) for p in it), SCHEMA)
    return counted.groupBy("term_id").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("doc_freq").alias("doc_freq"))


def mark_words(words: DataFrame, frequencies: DataFrame, docs: DataFrame, rare: int = 2, common: float = 0.1) -> DataFrame:
    """(word_id, n_occurrences, doc_freq, mark) of every word: `rare` in at most `rare` documents (none included),
    `common` in more than the share `common` of the different documents of docs, else null. Rows of words without
    word_id are left out."""
    n_docs = docs.select("doc_id").distinct().agg(F.count("doc_id").alias("n_docs"))  # one row
    ids = words.select("word_id").where("word_id IS NOT NULL").distinct()
    counted = ids.join(frequencies, ids.word_id == frequencies.term_id, "left").crossJoin(F.broadcast(n_docs))
    df = F.coalesce("doc_freq", F.lit(0))
    mark = F.when(df <= rare, "rare").when(df > common * F.col("n_docs"), "common")
    return counted.select("word_id", F.coalesce("n_occurrences", F.lit(0)).alias("n_occurrences"), df.alias("doc_freq"), mark.alias("mark"))
