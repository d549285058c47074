"""Windows of text that hold all terms of a query."""

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
#: How much a window can add (fixed value).
BOOST = 1.9


def hits(words: Column, terms: Column) -> Column:
    """For each term the places, from 0, at which it stands."""
    return F.transform(terms, lambda t: F.filter(F.transform(words, lambda w, i: F.when(w == t, i)), lambda i: i.isNotNull()))


def smallest_window(places: Column) -> Column:
    """Length of the smallest window with a place of every list; infinite if a list is empty or there is none.

    One walk over all places in order, with the last place of each list as its state.
    """
    events = F.array_sort(F.flatten(F.transform(places, lambda p, i: F.transform(p, lambda x: F.struct(x.cast("int").alias("at"), i.alias("of"))))))
    start = F.struct(F.transform(places, lambda p: F.lit(-1)).alias("last"), F.lit(INF).alias("best"))

    def step(s: Column, e: Column) -> Column:
        last = F.transform(s["last"], lambda v, j: F.when(j == e["of"], e["at"]).otherwise(v))
        first = F.array_min(last)
        return F.struct(last.alias("last"), F.when(first >= 0, F.least(s["best"], (e["at"] - first + 1).cast("double"))).otherwise(s["best"]).alias("best"))

    return F.when(F.size(places) > 0, F.aggregate(events, start, step, lambda s: s["best"])).otherwise(F.lit(INF))


def least_window(texts: Column, terms: Column, words) -> Column:
    """The smallest window over several texts."""
    return F.coalesce(F.array_min(F.transform(texts, lambda t: smallest_window(hits(words(t), terms)))), F.lit(INF))


def window_count(words: Column, terms: Column) -> Column:
    """Windows holding all terms, counted from the left without overlap."""
    start = F.struct(terms.alias("left"), F.lit(0).cast("bigint").alias("n"))

    def step(s: Column, w: Column) -> Column:
        left = F.array_remove(s["left"], w)
        return F.when(F.size(left) == 0, F.struct(terms.alias("left"), (s["n"] + 1).alias("n"))).otherwise(F.struct(left.alias("left"), s["n"].alias("n")))

    return F.aggregate(words, start, step, lambda s: s["n"])


def boost_by_excess(window: Column, n_terms: Column) -> Column:
    """Windows shorter than the number of terms (hits of several keys at one place) count as that long."""
    return 1 + F.lit(BOOST) / F.greatest(1 + window - n_terms, F.lit(1.0))


def boost_by_ratio(window: Column, n_terms: Column) -> Column:
    return 1 + F.lit(BOOST) * n_terms / window
