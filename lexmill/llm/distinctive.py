"""How distinctive each term is for a record: a mixture of two Poisson distributions per term.

A term occurs in most records at a low rate and in a few, those it is about, at a high one. Both rates and the
share of the second kind are fitted by expectation-maximisation on the histogram of the term's counts (records
without the term are the histogram's zero); the posterior probability of the second kind scores each count.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.skewed_keys import join_held
from lexmill.session import materialise

#: A term's fit has converged when no parameter moves by more than this part of itself in a step; MAX_STEPS at most.
TOLERANCE, MAX_STEPS = 1e-4, 2000
#: Or when the posteriors of the records with the term move by no more than this, on average.
SETTLED = 1e-5
#: Different counts of a term that are fitted as one row.
WIDEST = 100_000
FITTED = "term string, f bigint, n bigint, d bigint, n_rec bigint, posterior double, steps int, converged boolean"


def record_terms(features: DataFrame) -> DataFrame:
    """(rec_id, term, f) with f > 0: occurrences in title and header, those in each anchor text times its count, and
    the number of positions of each lower-cased body_hits key. A rec_id counts once (rows that came twice are equal);
    rows without rec_id do not count. Null or empty fields, positions and counts add nothing."""
    rows = features.select("rec_id", "title", "header", "body_hits", "anchors").where("rec_id IS NOT NULL")
    once = rows.groupBy("rec_id").agg(F.first(F.struct("title", "header", "body_hits", "anchors")).alias("r"))
    one = F.lit(1).cast("bigint")

    def runs(text: Column) -> Column:
        return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))

    def counted(text: Column, times: Column) -> Column:
        return F.transform(runs(text), lambda t: F.struct(t.alias("term"), times.alias("n")))

    header = F.transform(F.coalesce("r.header", F.array().cast("array<string>")), lambda h: counted(h, one))
    anchors = F.transform(F.coalesce(F.map_entries("r.anchors"), F.array().cast("array<struct<key:string,value:int>>")), lambda a: counted(a["key"], F.greatest(F.coalesce(a["value"], F.lit(0)), F.lit(0)).cast("bigint")))
    hits = F.transform(
        F.coalesce(F.map_entries("r.body_hits"), F.array().cast("array<struct<key:string,value:array<int>>>")),
        lambda h: F.struct(F.lower(h["key"]).alias("term"), F.greatest(F.size(h["value"]), F.lit(0)).cast("bigint").alias("n")),
    )
    every = F.concat(counted(F.col("r.title"), one), F.flatten(header), F.flatten(anchors), hits)
    return once.select("rec_id", F.explode(every).alias("t")).groupBy("rec_id", F.col("t.term").alias("term")).agg(F.sum("t.n").alias("f")).where("f > 0")


@dataclass
class _Fit:
    """Parameters of the mixtures of several terms: rates of the low and the elite component, the share of the latter, and
    how many of the records that hold the term it had in the step before."""

    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    held: np.ndarray


def _start(d: np.ndarray, mass: np.ndarray, n_rec: float) -> _Fit:
    return _Fit(mass / n_rec * 0.5, mass / d * 1.1 + 0.1, np.clip(d / n_rec * 0.5, 1e-9, 0.5), np.full(len(d), np.inf))


def _elite(k: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Posterior probability of the elite component at count k."""
    odds = np.log(share) - np.log1p(-share) + k * (np.log(high) - np.log(low)) - (high - low)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _step(was: _Fit, held: np.ndarray, m_high: np.ndarray, d: np.ndarray, mass: np.ndarray, n_rec: float) -> tuple[_Fit, np.ndarray]:
    """The fit after a step, from the holding records and occurrences with their posteriors, and which terms have
    converged: no parameter moved by more than TOLERANCE of itself, or the posteriors, on average, by more than SETTLED
    (a component that dies out or merges with the other moves its parameters for ever)."""
    n_high = held + np.maximum(n_rec - d, 0) * _elite(0.0, was.low, was.high, was.share)
    high = np.maximum(m_high / np.maximum(n_high, 1e-12), 1e-9)
    low = np.maximum((mass - m_high) / np.maximum(n_rec - n_high, 1e-12), 1e-12)
    now = _Fit(np.minimum(low, high), np.maximum(low, high), np.clip(n_high / n_rec, 1e-12, 1 - 1e-9), held)
    moved = [np.abs(a - b) <= TOLERANCE * np.abs(b) + 1e-12 for a, b in zip((now.low, now.high, now.share), (was.low, was.high, was.share))]
    return now, (moved[0] & moved[1] & moved[2]) | (np.abs(held - was.held) <= SETTLED * d)


def fit_two_poisson(counts: np.ndarray, records: np.ndarray, starts: np.ndarray, n_rec: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the elite component for each count, and for each term the steps taken and whether they converged.

    counts and records are the histograms of all terms end to end (without zero), starts where each term begins; records
    without the term are counted from n_rec. Terms that have converged take no further steps.
    """
    sizes = np.diff(np.append(starts, len(counts)))
    d, mass = np.add.reduceat(records, starts), np.add.reduceat(records * counts, starts)
    fit, steps, done = _start(d, mass, n_rec), np.zeros(len(starts), int), np.zeros(len(starts), bool)
    open_ = np.arange(len(starts))
    for _ in range(MAX_STEPS):
        if not len(open_):
            break
        n = sizes[open_]
        begin = np.cumsum(n) - n
        rows = np.repeat(starts[open_] - begin, n) + np.arange(n.sum())
        k, w = counts[rows], records[rows]
        was = _Fit(fit.low[open_], fit.high[open_], fit.share[open_], fit.held[open_])
        p = _elite(k, *(np.repeat(x, n) for x in (was.low, was.high, was.share))) * w
        now, ended = _step(was, np.add.reduceat(p, begin), np.add.reduceat(p * k, begin), d[open_], mass[open_], n_rec)
        fit.low[open_], fit.high[open_], fit.share[open_], fit.held[open_] = now.low, now.high, now.share, now.held
        steps[open_] += 1
        done[open_[ended]] = True
        open_ = open_[~ended]
    return _elite(counts, *(np.repeat(x, sizes) for x in (fit.low, fit.high, fit.share))), steps, done


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fits alike histograms once: most terms are in few records and share theirs with many others."""
    for b in batches:
        if not len(b):
            continue
        f = [np.array([x["f"] for x in h], np.int64) for h in b["h"]]
        n = [np.array([x["n"] for x in h], np.int64) for h in b["h"]]
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(x.tobytes() + b"|" + y.tobytes(), len(seen)) for x, y in zip(f, n)])
        one = np.unique(of, return_index=True)[1]
        sizes = np.array([len(f[i]) for i in one])
        starts = np.cumsum(sizes) - sizes
        posterior, steps, done = fit_two_poisson(np.concatenate([f[i] for i in one]).astype(float), np.concatenate([n[i] for i in one]).astype(float), starts, float(b["n_rec"].iloc[0]))
        rows = np.concatenate([np.arange(starts[o], starts[o] + sizes[o]) for o in of])
        each = sizes[of]
        d = np.array([x.sum() for x in n])
        yield pd.DataFrame(
            {"term": np.repeat(b["term"].to_numpy(), each), "f": np.concatenate(f), "n": np.concatenate(n), "d": np.repeat(d, each), "n_rec": int(b["n_rec"].iloc[0]),
             "posterior": posterior[rows], "steps": np.repeat(steps[of], each).astype(np.int32), "converged": np.repeat(done[of], each)}
        )


def _fit_wide(histogram: DataFrame, n_rec: int) -> DataFrame:
    """The same for terms whose histogram is too wide for one row: every step is a sum by term over the histogram's rows."""
    kept = materialise(histogram, "wide")
    sums = kept.groupBy("term").agg(F.sum("n").cast("double").alias("d"), F.sum(F.col("n") * F.col("f")).cast("double").alias("mass"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fit = _start(b["d"].to_numpy(), b["mass"].to_numpy(), float(n_rec))
            yield b.assign(low=fit.low, high=fit.high, share=fit.share, held=fit.held, steps=0, converged=False)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            was = _Fit(b["low"].to_numpy(), b["high"].to_numpy(), b["share"].to_numpy(), b["held"].to_numpy())
            now, ended = _step(was, b["n_high"].to_numpy(), b["m_high"].to_numpy(), b["d"].to_numpy(), b["mass"].to_numpy(), float(n_rec))
            o = b["converged"].to_numpy()
            yield pd.DataFrame({"term": b["term"], "d": b["d"], "mass": b["mass"], "low": np.where(o, was.low, now.low), "high": np.where(o, was.high, now.high), "share": np.where(o, was.share, now.share), "held": now.held, "steps": (b["steps"] + ~o).astype(np.int32), "converged": o | ended})

    schema = "term string, d double, mass double, low double, high double, share double, held double, steps int, converged boolean"
    odds = "ln(share) - log1p(-share) + {0} * (ln(high) - ln(low)) - (high - low)"
    elite = "1 / (1 + exp(-least(greatest(" + odds.format("f") + ", -500D), 500D)))"
    state = materialise(sums.mapInPandas(first, schema), "fit")
    for _ in range(MAX_STEPS):
        if state.where("NOT converged").isEmpty():
            break
        # Terms with such histograms are few; their rows are many, and stay where they are.
        summed = kept.join(F.broadcast(state.select("term", "low", "high", "share")), "term").selectExpr("term", "f", f"n * {elite} AS p").groupBy("term").agg(F.sum("p").alias("n_high"), F.sum(F.col("p") * F.col("f")).alias("m_high"))
        state = materialise(state.join(summed, "term").mapInPandas(step, schema), "fit")
    return kept.join(F.broadcast(state), "term").selectExpr("term", "f", "n", "bigint(d) AS d", f"{n_rec}L AS n_rec", f"{elite} AS posterior", "steps", "converged")


def fitted_terms(terms: DataFrame, n_rec: int, widest: int = WIDEST) -> DataFrame:
    """(term, f, n records, d, n_rec, posterior, steps, converged) for every count f of every term of record_terms."""
    histogram = materialise(terms.groupBy("term", "f").agg(F.count(F.lit(1)).alias("n")), "histogram")
    wide = materialise(histogram.groupBy("term").agg(F.count(F.lit(1)).alias("width")).where(F.col("width") > widest), "wide")
    # Each such term has more than `widest` counts, so they are few.
    narrow = histogram if wide.isEmpty() else histogram.join(wide, "term", "left_anti")
    fitted = narrow.groupBy("term").agg(F.collect_list(F.struct("f", "n")).alias("h")).select("term", F.array_sort("h").alias("h"), F.lit(n_rec).cast("bigint").alias("n_rec")).mapInPandas(_fit, FITTED)
    if wide.isEmpty():
        return fitted
    return fitted.unionByName(_fit_wide(histogram.join(wide, "term", "left_semi"), n_rec))


def distinctive_terms(features: DataFrame, widest: int = WIDEST) -> DataFrame:
    """(rec_id, term, f, d, n_rec, posterior, steps, converged) for every term of every record; see record_terms for what counts.

    d is the number of records holding the term, n_rec that of all. The mixture of a term is fitted until no parameter
    moves by more than TOLERANCE of itself, at most MAX_STEPS steps; steps and converged tell. The histogram of a term has
    one row for each different count, so a term in most records is as small to fit as any other; a term with more than
    `widest` different counts is fitted by sums over rows, with the same result. An empty table gives an empty result.
    """
    terms = materialise(record_terms(features), "terms")
    n_rec = features.select("rec_id").where("rec_id IS NOT NULL").distinct().count()
    fitted = materialise(fitted_terms(terms, n_rec, widest), "fitted")
    return join_held(terms, fitted, ["term", "f"], "n").select("rec_id", "term", "f", "d", "n_rec", "posterior", "steps", "converged")


def most_distinctive(scored: DataFrame) -> DataFrame:
    """(rec_id, term): of the scored terms of a record, the one with the highest (1 + ln f) * ln(N / d), equal values by
    term ascending. The formula is a given one; the posterior has no part in it."""
    weight = (1 + F.log("f")) * F.log(F.col("n_rec") / F.col("d"))
    best = F.min(F.struct((-weight).alias("w"), "term"))
    return scored.groupBy("rec_id").agg(best["term"].alias("term"))
