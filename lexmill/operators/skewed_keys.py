"""Per-key results where a few keys hold most of the rows.

Rows are first grouped by (key, value), which spreads a hot key over all tasks and leaves one weighted row per
value. Distinct counts and modes are then plain mergeable sums and maxima, combined before their shuffle;
percentiles come from running sums of the weights over a global sort, so no task ever holds a whole key.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.positions import RUN, global_positions
from lexmill.session import materialise, partitions


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, weight): one row per pair. Rows with a null key or value do not count; no rows, no result."""
    pairs = df.select(F.col(key).alias("key"), F.col(value).alias("value")).where("key IS NOT NULL AND value IS NOT NULL")
    return pairs.groupBy("key", "value").agg(F.count(F.lit(1)).alias("weight"))


def key_summary(compressed: DataFrame) -> DataFrame:
    """Per key: n_rows, exact n_distinct, and mode (the least of the most frequent values)."""
    best = F.max(F.struct("weight", "value"))
    tied = compressed.groupBy("key").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("weight").alias("n_rows"), best["weight"].alias("top"))
    modes = compressed.groupBy("key", "weight").agg(F.min("value").alias("mode"))
    return tied.join(modes, (tied.key == modes.key) & (tied.top == modes.weight)).select(tied.key, "n_rows", "n_distinct", "mode")


def key_distinct(compressed: DataFrame) -> DataFrame:
    """Per key the exact number of different values."""
    return compressed.groupBy("key").agg(F.count(F.lit(1)).alias("n_distinct"))


def key_percentiles(compressed: DataFrame, fractions: list[float]) -> DataFrame:
    """(key, fraction, value): the least value with at least the fraction of the key's rows at or below it."""
    run = global_positions(compressed, ["key"], [F.col("value").asc()], weight="weight", label="percentiles")
    totals = materialise(run.groupBy("key").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("held")), "totals")
    at = join_held(run, totals, ["key"], "held").withColumn("fraction", F.explode(F.array(*[F.lit(float(x)) for x in fractions])))
    reached = F.greatest(F.ceil(F.col("fraction") * F.col("total")), F.lit(1))
    crosses = (F.col(RUN) >= reached) & (F.col(RUN) - F.col("weight") < reached)
    return at.where(crosses).select("key", "fraction", "value")


def join_held(rows: DataFrame, per_key: DataFrame, keys: list[str], held: str) -> DataFrame:
    """rows with the columns of per_key, which has one row for each key and in `held` the number of rows with it.

    Keys with more than the P-th part of all rows are at most P, the number of shuffle partitions, so these are
    broadcast and their rows stay where they are; the others are joined by hash, none of them larger than an even share.
    Null keys are equal to each other. per_key is read twice and should be written before.
    """
    n = partitions(rows.sparkSession)
    whole = per_key.agg((F.coalesce(F.sum(held), F.lit(0)) / n).alias("__even"))  # one row
    rated = per_key.crossJoin(F.broadcast(whole))
    hot, cold = (rated.where(f"{held} {c} __even").drop("__even").alias("k") for c in (">", "<="))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    more = [c for c in per_key.columns if c not in keys and c != held]
    columns = [*[F.col(f"r.`{c}`") for c in rows.columns], *[F.col(f"k.{c}") for c in [*more, *([] if held in rows.columns else [held])]]]
    few = F.broadcast(hot)
    of_hot = rows.alias("r").join(few, same).select(*columns)
    of_cold = rows.alias("r").join(F.broadcast(hot.select(*keys).alias("k")), same, "left_anti").alias("r").join(cold, same).select(*columns)
    return of_hot.unionByName(of_cold)


def wrong_doc_freq(term_docs: DataFrame, posting_dict: DataFrame) -> DataFrame:
    """Terms whose recorded doc_freq differs from the number of different documents that hold them.

    Recorded rows that are equal in every column count once, a null count and a missing row as 0; rows without a
    term, and occurrences without term or document, do not count.
    """
    held = key_distinct(compress(term_docs, "term_id", "doc_id"))
    rows = posting_dict.select("block", "term_id", "byte_offset", "doc_freq").where("term_id IS NOT NULL").distinct()
    recorded = rows.groupBy("term_id").agg(F.sum(F.coalesce("doc_freq", F.lit(0))).alias("recorded"))
    both = held.join(recorded, held.key == recorded.term_id, "full_outer")
    term = F.coalesce("key", "term_id").cast("int").alias("term_id")
    return both.where("coalesce(n_distinct, 0) <> coalesce(recorded, 0)").select(term)
