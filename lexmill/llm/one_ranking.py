"""One order from several scores on different scales, by outranking flows.

Within a group each score is turned into mid-rank percentiles. On each score, an item is preferred to another by a
degree that rises linearly from 0 at the indifference threshold to 1 at the preference threshold of their
percentile difference. An item's flow is what it is preferred by over all others less what they are preferred by
over it; the sums over all others come from prefix sums along the sorted percentiles, never from pairs.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.positions import POS, RUN, global_positions
from lexmill.operators.skewed_keys import join_held
from lexmill.session import materialise

SCORES = ["pagerank", "body_length", "anchor_count", "hit_count"]
INDIFFERENCE, PREFERENCE = 0.0, 0.5


def record_scores(features: DataFrame) -> DataFrame:
    """(rec_id, query, url and the four scores), each rec_id once; null or missing scores count as 0. Rows without
    rec_id, query or url are left out."""
    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)
    anchors = total(F.transform(F.map_values("anchors"), lambda x: F.coalesce(x, F.lit(0)).cast("bigint")))
    hits = total(F.transform(F.map_values("body_hits"), lambda x: F.greatest(F.size(x), F.lit(0)).cast("bigint")))
    rows = features.where("rec_id IS NOT NULL AND query IS NOT NULL AND url IS NOT NULL").select(
        "rec_id", "query", "url", *[F.coalesce(x, F.lit(0)).cast("double").alias(n) for n, x in zip(SCORES, [F.col("pagerank"), F.col("body_length"), anchors, hits])]
    )
    best = F.max(F.struct("query", "url", *SCORES))
    return rows.groupBy("rec_id").agg(best.alias("r")).select("rec_id", "r.*")


def _levels(rows: DataFrame, group: str, item: str, scores: list[str]) -> tuple[DataFrame, DataFrame]:
    """(g, i, n, scores) and (g, k, x, c, n): n rows of a group, c of which have value x in score k. Numbers are never null or NaN."""
    value = lambda s: F.when(F.isnan(F.col(s).cast("double")), 0.0).otherwise(F.coalesce(F.col(s).cast("double"), F.lit(0.0)))
    plain = materialise(rows.select(F.col(group).alias("g"), F.col(item).alias("i"), *[value(s).alias(f"x{j}") for j, s in enumerate(scores)]), "scores")
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("k"), F.col(f"x{j}").alias("x")) for j in range(len(scores))]))
    counted = plain.select("g", each.alias("e")).groupBy("g", "e.k", "e.x").agg(F.count(F.lit(1)).alias("c"))
    sizes = plain.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return plain, join_held(counted, materialise(sizes, "sizes"), ["g"], "n")


def _level_flows(levels: DataFrame, q: float, p: float) -> DataFrame:
    """(g, k, x, c, flow): the mean preference of every level over the others less that of the others over it.

    levels: (g, k, x, c rows, b rows below, n rows). A level's percentile is z = (2b + c) / 2n. The sum over others of
    clip((z - y) / (p - q), 0, 1) needs, for thresholds at q and p below (and above) z, how many rows lie beyond and the
    sum of their percentiles. The percentiles of the first m rows in order add up to m * m / 2n, wherever a level ends
    there, so the counts suffice. They are prefix sums: thresholds are sorted in among the levels and read the count at
    their place. At q = 0 the inner thresholds are the level itself, whose counts are known.
    """
    shifts = [("dp", -p, 1), ("up", p, 3)] + ([("dq", -q, 1), ("uq", q, 3)] if q > 0 else [])
    asks = F.array(F.struct(F.lit("").alias("ask"), F.lit(0.0).alias("by"), F.lit(2).alias("o")), *[F.struct(F.lit(a).alias("ask"), F.lit(float(s)).alias("by"), F.lit(o).alias("o")) for a, s, o in shifts])
    # Percentiles are whole numbers over 2n.
    at = F.round(F.col("b") * 2 + F.col("c") + F.col("a.by") * F.col("n") * 2, 6)
    events = levels.select("*", F.explode(asks).alias("a")).select("g", "k", "x", "c", "b", "n", "a.ask", at.alias("at"), "a.o", F.when(F.col("a.ask") == "", F.col("c")).otherwise(0).cast("bigint").alias("w"))
    order = [F.col("at").asc(), F.col("o").asc(), F.col("x").asc(), F.col("ask").asc()]
    found = global_positions(events, ["g", "k"], order, weight="w", label="flow").where("ask <> ''")
    got = found.groupBy("g", "k", "x", "c", "b", "n").agg(*[F.max(F.when(F.col("ask") == a, F.col(RUN))).alias(a) for a, _, _ in shifts])
    if not q > 0:
        got = got.withColumns({"dq": F.col("b"), "uq": F.col("b") + F.col("c")})
    square = lambda c: F.col(c).cast("double") * F.col(c)
    z = (F.col("b") * 2 + F.col("c")) / (F.col("n") * 2)
    plus = F.col("dp") + ((F.col("dq") - F.col("dp")) * (z - q) - (square("dq") - square("dp")) / (F.col("n") * 2)) / (p - q)
    minus = F.col("n") - F.col("up") + ((square("up") - square("uq")) / (F.col("n") * 2) - (F.col("up") - F.col("uq")) * (z + q)) / (p - q)
    return got.select("g", "k", "x", "c", ((plus - minus) / F.greatest(F.col("n") - 1, F.lit(1))).alias("flow"))


def outranking(rows: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None, indifference: float = INDIFFERENCE, preference: float = PREFERENCE) -> DataFrame:
    """(group, item, flow, position): the order of each group's items by net flow, equal flows by item ascending.

    Flows lie between -1 and 1 and add up to 0 over a group. Null and not-a-number scores count as 0. An item
    given more than once counts each time against others, and has one row with its mean flow. A null group is a group. Groups of any size, and values that most
    rows of a group have, are handled in pieces.
    """
    total = sum(weights or [1.0] * len(scores))
    share = F.array(*[F.lit(w / total) for w in (weights or [1.0] * len(scores))])
    plain, levels = _levels(rows, group, item, scores)
    running = global_positions(levels, ["g", "k"], [F.col("x").asc()], weight="c", label="levels")
    flows = materialise(_level_flows(running.select("g", "k", "x", "c", (F.col(RUN) - F.col("c")).alias("b"), "n"), indifference, preference), "flows")
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("k"), F.col(f"x{j}").alias("x")) for j in range(len(scores))]))
    long = plain.select("g", "i", each.alias("e")).select("g", "i", "e.k", "e.x")
    per_item = join_held(long, flows, ["g", "k", "x"], "c").groupBy("g", "i").agg(F.sum(F.round(F.col("flow") * share[F.col("k")], 12)).alias("flow"), F.count(F.lit(1)).alias("times"))
    mean = F.round(F.col("flow") / (F.col("times") / len(scores)), 9)
    ranked = global_positions(per_item.select("g", "i", mean.alias("flow")), ["g"], [F.col("flow").desc(), F.col("i").asc()], label="ranking")
    return ranked.select(F.col("g").alias("group"), F.col("i").alias("item"), "flow", F.col(POS).alias("position"))
