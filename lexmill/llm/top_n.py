"""The N highest-scoring items of every group, however large the groups are."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.positions import POS, global_positions


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, item, score, position): the n items of each group with the highest score, equal scores by item ascending.

    An item scored repeatedly within its group counts once, with its highest score. Rows with a null group, item or
    score, or a score that is not a number, do not count; infinite scores do. Further columns are ignored; an empty
    table gives an empty result. The rows are sorted globally by (group, score, item), so a group of any size is
    spread over partitions; each partition hands on at most n rows a group.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"))
    counted = rows.where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    best = counted.groupBy("g", "i").agg(F.max("s").alias("s"))
    ranked = global_positions(best, ["g"], [F.col("s").desc(), F.col("i").asc()], keep=n, label="top")
    return ranked.select(F.col("g").alias("group"), F.col("i").alias("item"), F.col("s").alias("score"), F.col(POS).alias("position"))
