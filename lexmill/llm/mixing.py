"""A selection of texts in which each source makes up a target share of all tokens."""

from math import exp, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.tokens import VOCABULARY, with_tokens
from lexmill.operators.positions import POS, RUN, global_positions
from lexmill.session import materialise

MAX_SOURCES = 10_000
#: As total: all tokens of the sources that have a target.
ALL = -1


def tempered(shares: dict[str, float], exponent: float, aims: dict[str, float] | None = None) -> dict[str, float]:
    """Weights share^(1-e) * aim^e, normalised: the natural shares at 0, the aims (equal ones by default) at 1."""
    live = {s: x for s, x in shares.items() if x > 0 and (aims is None or aims.get(s, 0) > 0)}
    logs = {s: (1 - exponent) * log(x) + exponent * log(aims[s] if aims else 1 / len(live)) for s, x in live.items()}
    top = max(logs.values(), default=0)
    total = sum(exp(x - top) for x in logs.values())
    return {s: exp(x - top) / total for s, x in logs.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * log(w) for w in weights.values() if w > 0)


def bisect(meets, low: float = 0.0, high: float = 1.0, steps: int = 80) -> float:
    """The highest exponent in the range at which `meets` holds, given that it holds below and fails above."""
    if meets(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if meets(mid) else (low, mid)
    return low


def exponent_for_entropy(shares: dict[str, float], target: float) -> float:
    """The exponent at which the tempered shares reach the target entropy (between the natural one and ln of the number of sources)."""
    return bisect(lambda e: entropy(tempered(shares, e)) <= target)


def _largest_total(weights: dict[str, float], most: dict[str, int]) -> float:
    return min((most[s] / w for s, w in weights.items() if w > 0), default=0.0)


def budgets(
    tokens: dict[str, int], aims: dict[str, float], repeats: dict[str, int], total: int | None = None, grains: dict[str, float] | None = None, spread: float | None = None
) -> tuple[dict[str, float], dict[str, float]]:
    """Tokens for each source, and the exponent at which its weight was set. Sources without tokens get none and their
    share goes to the others in proportion.

    With a target entropy (spread), the natural shares are tempered towards equal ones until they reach it, or, with a
    total, as far as every source stays within its repeats; without one the total is the largest within the repeats.

    Without it the natural shares are tempered towards the aims. With a total, the exponent is bisected to the highest
    at which all sources stay within their repeats; those that stop it are set to their limit, and the others are
    tempered further with the rest of the total, until the exponent is 1 or no source is free. What is left is the
    nearest to the aims that the limits allow. Without a total, the largest one is taken at which every source reaches
    its aim within its repeats, so the exponent is 1 at once. Grains are the tokens by which rounding to whole texts
    misses a source's budget. A source that can give less than half of the others' grains does not decide the total: it
    is used up to its repeats, as the deviation 2 * (share - most / total) + grains / total, summed over such sources
    and the others, still falls.
    """
    live = {s: aims[s] for s in aims if tokens.get(s, 0) > 0 and aims[s] > 0 and repeats.get(s, 0) > 0}
    most = {s: tokens[s] * repeats[s] for s in live}
    if not live:
        return {}, {}
    fits = lambda w, whole, near=1e-12: all(x * whole <= most[s] * (1 + near) for s, x in w.items())
    if spread is not None:
        natural = {s: tokens[s] / sum(tokens[x] for x in live) for s in live}
        e = exponent_for_entropy(natural, spread)
        if total is not None:
            e = min(e, bisect(lambda x: fits(tempered(natural, x), total)))
        weights = tempered(natural, e)
        whole = _largest_total(weights, most)
        return {s: w * (whole if total is None else min(total, whole)) for s, w in weights.items()}, dict.fromkeys(live, e)
    if total is None:
        sizing = sorted(live, key=lambda s: most[s] / live[s])
        used = 0
        while grains and len(sizing) > 1 and 2 * (used + most[sizing[0]]) < sum(grains.get(s, 0) for s in sizing[1:]):
            used += most[sizing.pop(0)]
        # The rest is mixed in proportion; the used-up sources have their all.
        each = most[sizing[0]] / live[sizing[0]]
        return {s: float(most[s]) if s not in sizing else live[s] * each for s in live}, dict.fromkeys(live, 1.0)
    done: dict[str, float] = {}
    at: dict[str, float] = {}
    while len(done) < len(live) and (rest := total - sum(done.values())) > 0:
        free = {s: live[s] for s in live if s not in done}
        natural = {s: tokens[s] / sum(tokens[x] for x in free) for s in free}
        final = tempered(natural, 1.0, free)
        # Only what would be over its limit at the aims can be at it in the end.
        over = [s for s in free if final[s] * rest > most[s] * (1 + 1e-12)]
        if not over:
            return done | {s: w * rest for s, w in final.items()}, at | dict.fromkeys(free, 1.0)
        tempered_ = lambda x, n=natural, f=free, o=over: {s: w for s, w in tempered(n, x, f).items() if s in o}
        e = bisect(lambda x, t=tempered_, r=rest: fits(t(x), r))
        stop = {s: float(most[s]) for s, w in tempered_(e).items() if w * rest >= most[s] * (1 - 1e-9)}
        done |= stop
        at |= dict.fromkeys(stop, e)
    return done, at


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY, spread: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): (doc_id, source, block, position, n_tokens), one row for each use of a text, and for each
    target source its target_share, max_repeats, tokens available and taken, actual_share, repeats of its tokens, and the
    exponent at which its weight was set (see budgets; spread is a target entropy that takes the place of the shares).

    Sources are compared without outer blanks and letter case. Texts without source, of sources without target, or
    without tokens are not selected. Each block is a random permutation of a source's texts (by hash of seed, block and
    doc_id), in which a text has its position; whole blocks are taken while they fit the source's budget, then the first
    texts of one more block up to it, rounded to the nearest text. A target that is given twice counts with its highest
    share; null shares and repeats count as 0. A text is used at most max_repeats times. No documents, or no targets,
    give an empty selection.
    """
    spark = documents.sparkSession
    name = lambda c: F.lower(F.trim(F.col(c)))
    wanted = targets.select(name("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("most")).where("source IS NOT NULL")
    rows = wanted.groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    named = documents.select("doc_id", name("source").alias("source"), "text")
    sized = materialise(with_tokens(named, ["doc_id", "source"], vocabulary=vocabulary).where("n_tokens > 0"), "tokens")
    known = F.broadcast(spark.createDataFrame([(r["source"],) for r in rows], "source string"))  # at most MAX_SOURCES rows
    usable = sized.join(known, "source")
    squares = F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens"))
    held = usable.groupBy("source").agg(F.sum("n_tokens").alias("n"), squares.alias("nn")).collect()
    tokens = {r["source"]: r["n"] for r in held}
    grains = {r["source"]: r["nn"] / r["n"] / 4 for r in held}  # a text at the end of a budget is met by its length, and missed by a quarter of it
    aims, repeats = {r["source"]: r["share"] for r in rows}, {r["source"]: r["most"] for r in rows}
    budget, exponents = budgets(tokens, aims, repeats, sum(tokens.values()) if total == ALL else total, grains, spread)
    # A source at its limit keeps whole blocks only; rounding must not add another.
    blocks = {s: min(int(b / tokens[s] + 1e-9), repeats[s]) for s, b in budget.items()}
    plan = [(s, blocks[s], max(0.0, b - blocks[s] * tokens[s]) if blocks[s] < repeats[s] else 0.0) for s, b in budget.items()]
    planned = F.broadcast(spark.createDataFrame(plan, "source string, whole int, rest double"))  # at most MAX_SOURCES rows
    last = F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1)
    uses = usable.join(planned, "source").where("whole > 0 OR rest > 0").withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    keyed = uses.select("doc_id", "source", "block", "n_tokens", "whole", "rest", F.xxhash64(F.lit(seed), F.col("block"), F.col("doc_id")).alias("key"))
    at = global_positions(keyed, ["source", "block"], [F.col("key").asc(), F.col("doc_id").asc(), F.col("n_tokens").asc()], weight="n_tokens", label="blocks")
    taken_ = at.where((F.col("block") < F.col("whole")) | (F.col(RUN) - F.col("n_tokens") / 2 <= F.col("rest")))
    selection = taken_.select("doc_id", "source", "block", F.col(POS).alias("position"), "n_tokens")
    taken = selection.groupBy("source").agg(F.sum("n_tokens").alias("tokens_taken"))
    facts = [(r["source"], float(r["share"]), int(r["most"]), int(tokens.get(r["source"], 0)), exponents.get(r["source"])) for r in rows]
    all_ = spark.createDataFrame(facts, "source string, target_share double, max_repeats int, tokens_available bigint, exponent double")
    whole = taken.agg(F.sum("tokens_taken").alias("all_taken"))  # one row
    joined = all_.join(taken, "source", "left").crossJoin(F.broadcast(whole))
    n = F.coalesce("tokens_taken", F.lit(0))
    used = F.when(F.col("tokens_available") > 0, n / F.col("tokens_available")).otherwise(0.0)
    shares = joined.select("source", "target_share", "max_repeats", "tokens_available", n.alias("tokens_taken"), F.coalesce(n / F.col("all_taken"), F.lit(0.0)).alias("actual_share"), used.alias("repeats"), "exponent")
    return selection, shares
