"""Queries of the training-data problems, and SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.distinctive import MAX_STEPS, TOLERANCE, SETTLED, distinctive_terms, fitted_terms, most_distinctive, record_terms
from lexmill.llm.mixing import ALL, mix
from lexmill.llm.one_ranking import SCORES, outranking, record_scores
from lexmill.llm.packing import CAPACITY, container_use, pack
from lexmill.llm.subjects import subject_areas, subject_sentences
from lexmill.llm.term_frequency import mark_words, term_frequencies
from lexmill.llm.tokens import with_tokens
from lexmill.llm.top_n import top_n
from lexmill.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_n(table(spark, sf_dir, "run_scores"), "query", "url", "score", 5)
    return top.select(F.col("group").alias("query"), F.col("item").alias("url"))


def p3_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = term_frequencies(table(spark, sf_dir, "term_docs"))
    return mark_words(table(spark, sf_dir, "word_dict"), counted, table(spark, sf_dir, "doc_dict"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_frequencies(spark, sf_dir).where("mark IS NOT NULL").select("word_id", "mark")


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms(table(spark, sf_dir, "ranking_features"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_distinctive(p4_scores(spark, sf_dir))


def p5_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(record_scores(table(spark, sf_dir, "ranking_features")), "records")
    order = outranking(rows, "query", "rec_id", SCORES)
    urls = rows.select("rec_id", "url")
    return order.join(urls, order.item == urls.rec_id).select(F.col("group").alias("query"), "url", "rec_id", "flow", "position")


def p4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each term the records and occurrences that the mixture's posteriors give to its elite component."""
    features = table(spark, sf_dir, "ranking_features")
    n_rec = features.select("rec_id").where("rec_id IS NOT NULL").distinct().count()
    fitted = fitted_terms(materialise(record_terms(features), "terms"), n_rec)
    sums = [F.round(F.sum(F.col("posterior") * x), 4).alias(c) for c, x in (("elite_records", F.col("n")), ("elite_occurrences", F.col("n") * F.col("f")))]
    return fitted.groupBy("term", "steps", "converged").agg(*sums)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = p5_order(spark, sf_dir)
    first = F.min(F.when(F.col("position") == 1, F.col("url")))
    return order.groupBy("query").agg(first.alias("url"), F.count(F.lit(1)).alias("n")).where("n >= 8").select("query", "url")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def p7_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_use(pack(table(spark, sf_dir, "documents")))


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each doc_id have a container."""
    return p7_packed(spark, sf_dir).where("container_id IS NOT NULL AND piece = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_texts"))


def p7_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must not be: containers over the capacity, texts in pieces that would fit, tokens that are lost."""
    packed = p7_packed(spark, sf_dir)
    held = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.max("piece").alias("piece"), F.count(F.lit(1)).alias("rows"))
    over = held.agg(F.lit("overfull").alias("fault"), F.count_if(F.col("n") > CAPACITY).alias("n"))
    split = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("piece").alias("piece")).agg(F.lit("needless split").alias("fault"), F.count_if((F.col("piece") > 0) & (F.col("n") <= CAPACITY)).alias("n"))
    sized = with_tokens(table(spark, sf_dir, "documents"), ["doc_id"]).agg(F.sum("n_tokens").alias("all"))
    lost = packed.agg(F.sum("n_tokens").alias("n")).crossJoin(F.broadcast(sized)).select(F.lit("lost tokens").alias("fault"), (F.col("all") - F.col("n")).alias("n"))
    return over.unionByName(split).unionByName(lost)


def _mix(spark: SparkSession, sf_dir: str, **how) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), **how)


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p8_selection_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the usable sources hold."""
    return _mix(spark, sf_dir, total=ALL)[0]


def p8_shares_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the usable sources hold."""
    return _mix(spark, sf_dir, total=ALL)[1]


def p8_shares_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources tempered to an entropy of 2.2, between that of their tokens and ln 12."""
    return _mix(spark, sf_dir, spread=2.2)[1]


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target source whether it has texts, and whether the full mix keeps its limits."""
    selection, shares = _mix(spark, sf_dir, total=ALL)
    uses = selection.groupBy("source", "doc_id", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.max("n").alias("n")).groupBy("source").agg(F.max("blocks").alias("blocks"), F.max("n").alias("n"))
    kept = shares.join(uses, "source", "left").select("source", "target_share", "max_repeats", (F.col("tokens_available") > 0).alias("has_texts"), (F.coalesce("blocks", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (F.coalesce("n", F.lit(1)) == 1).alias("once_a_block"))
    return kept


def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_sentences(*[table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(p9_sentences(spark, sf_dir))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: sentences and documents by subject."""
    n = p9_sentences(spark, sf_dir).groupBy("subject").agg(F.sum("n_sentences").alias("n_sentences"), F.count_distinct("doc_id").alias("n_docs"))
    return n


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p3_found, p3_frequencies, p4_found, p4_scores, p4_mixture, p5_found, p5_order, p7_packed, p7_unused, p7_placed, p7_faults, p8_selection, p8_selection_full, p8_shares, p8_shares_full, p8_shares_even, p8_limits, p9_found, p9_sentences, p9_composition)
}

_RECORD_TERMS = """
    rec AS (SELECT rec_id, any_value(title) title, any_value(header) header, any_value(body_hits) hits, any_value(anchors) anchors
            FROM ranking_features WHERE rec_id IS NOT NULL GROUP BY 1),
    parts AS (SELECT rec_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) term, 1 n FROM rec
        UNION ALL SELECT rec_id, unnest(regexp_extract_all(lower(h), '[a-z0-9]+')), 1 FROM (SELECT rec_id, unnest(header) h FROM rec)
        UNION ALL SELECT rec_id, unnest(regexp_extract_all(lower(e.key), '[a-z0-9]+')), greatest(coalesce(e.value, 0), 0) FROM (SELECT rec_id, unnest(map_entries(anchors)) e FROM rec)
        UNION ALL SELECT rec_id, lower(e.key), coalesce(len(e.value), 0) FROM (SELECT rec_id, unnest(map_entries(hits)) e FROM rec)),
    tf AS (SELECT rec_id, term, sum(n) f FROM parts GROUP BY 1, 2 HAVING sum(n) > 0),
    df AS (SELECT term, count(*) d FROM tf GROUP BY 1)"""

_ELITE = "1 / (1 + exp(-least(greatest(ln(share) - ln(1 - share) + {0} * (ln(high) - ln(low)) - (high - low), -500), 500)))"
#: All pairs of a query, as a check of sums that never list them. A query of one record has no others.
_FLOWS = """
        WITH r AS (SELECT rec_id, any_value(query) query, any_value(url) url, any_value(coalesce(pagerank, 0)) s1, any_value(coalesce(body_length, 0)) s2,
            any_value(coalesce(list_sum(map_values(anchors)), 0)) s3, any_value(coalesce(list_sum(list_transform(map_values(body_hits), lambda x: coalesce(len(x), 0))), 0)) s4
            FROM ranking_features WHERE rec_id IS NOT NULL AND query IS NOT NULL AND url IS NOT NULL GROUP BY 1),
        l AS (SELECT query, rec_id, url, unnest([1, 2, 3, 4]) k, unnest([s1, s2, s3, s4])::DOUBLE x FROM r),
        z AS (SELECT *, count(*) OVER (PARTITION BY query, k) n, (2 * (rank() OVER (PARTITION BY query, k ORDER BY x) - 1) + count(*) OVER (PARTITION BY query, k, x)) / (2 * count(*) OVER (PARTITION BY query, k)) z FROM l),
        p AS (SELECT a.query, a.rec_id, any_value(a.url) url, any_value(a.n) n,
            coalesce(round(sum(least(greatest((a.z - b.z) / 0.5::DOUBLE, 0), 1) - least(greatest((b.z - a.z) / 0.5::DOUBLE, 0), 1)) / greatest(any_value(a.n - 1), 1) / 4, 9), 0) + 0 AS flow
            FROM z a LEFT JOIN z b ON a.query = b.query AND a.k = b.k AND a.rec_id <> b.rec_id GROUP BY 1, 2)"""

ORACLES: dict[str, str] = {
    "p2_found": """
        SELECT query, url FROM (
            SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY max(score) DESC, url) AS pos FROM run_scores
            WHERE query IS NOT NULL AND url IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY query, url) WHERE pos <= 5""",
    "p3_frequencies": """
        WITH held AS (SELECT term_id, count(*) occ, count(DISTINCT doc_id) df FROM (
            SELECT DISTINCT term_id, doc_id, pos FROM term_docs WHERE term_id IS NOT NULL AND doc_id IS NOT NULL) GROUP BY 1),
        n AS (SELECT count(DISTINCT doc_id) n FROM doc_dict)
        SELECT word_id, coalesce(occ, 0) AS n_occurrences, coalesce(df, 0) AS doc_freq,
            CASE WHEN coalesce(df, 0) <= 2 THEN 'rare' WHEN df > 0.1 * n THEN 'common' END AS mark
        FROM word_dict LEFT JOIN held ON word_id = term_id, n""",
    "p3_found": """
        WITH held AS (SELECT term_id, count(DISTINCT doc_id) df FROM term_docs WHERE term_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
        n AS (SELECT count(DISTINCT doc_id) n FROM doc_dict),
        m AS (SELECT word_id, CASE WHEN coalesce(df, 0) <= 2 THEN 'rare' WHEN df > 0.1 * n THEN 'common' END AS mark
            FROM word_dict LEFT JOIN held ON word_id = term_id, n)
        SELECT word_id, mark FROM m WHERE mark IS NOT NULL""",
    "p4_found": f"""
        WITH {_RECORD_TERMS}, w AS (SELECT rec_id, term, (1 + ln(f)) * ln((SELECT count(*) FROM rec) / d) w FROM tf JOIN df USING (term))
        SELECT rec_id, arg_min(term, (-w, term)) AS term FROM w GROUP BY 1""",
    "p4_mixture": f"""
        WITH RECURSIVE {_RECORD_TERMS}, nr AS (SELECT count(*)::DOUBLE n_rec FROM rec),
        hist AS (SELECT term, f::DOUBLE f, count(*)::DOUBLE n FROM tf GROUP BY 1, 2),
        h AS (SELECT term, list(f ORDER BY f) fs, list(n ORDER BY f) ns, sum(n) d, sum(n * f) mass FROM hist GROUP BY 1),
        u AS (SELECT DISTINCT fs, ns, d, mass FROM h),
        em AS (SELECT fs, ns, d, mass, n_rec, mass / n_rec * 0.5::DOUBLE low, mass / d * 1.1::DOUBLE + 0.1::DOUBLE high, least(greatest(d / n_rec * 0.5::DOUBLE, 1e-9), 0.5::DOUBLE) share, 'inf'::DOUBLE held, 0 steps, false done FROM u, nr
            UNION ALL
            SELECT fs, ns, d, mass, n_rec, least(lo, hi), greatest(lo, hi), sh, hd, steps + 1,
                abs(least(lo, hi) - low) <= {TOLERANCE}::DOUBLE * low + 1e-12 AND abs(greatest(lo, hi) - high) <= {TOLERANCE}::DOUBLE * high + 1e-12 AND abs(sh - share) <= {TOLERANCE}::DOUBLE * share + 1e-12 OR abs(hd - held) <= {SETTLED}::DOUBLE * d
            FROM (SELECT *, greatest(mh / greatest(nh, 1e-12), 1e-9) hi, greatest((mass - mh) / greatest(n_rec - nh, 1e-12), 1e-12) lo, least(greatest(nh / n_rec, 1e-12), 1 - 1e-9) sh
                FROM (SELECT *, list_sum(list_transform(ps, lambda p, i: p * ns[i])) hd, hd + greatest(n_rec - d, 0) * {_ELITE.format('0')} nh, list_sum(list_transform(ps, lambda p, i: p * ns[i] * fs[i])) mh
                    FROM (SELECT *, list_transform(fs, lambda k: {_ELITE.format('k')}) ps FROM em WHERE NOT done AND steps < {MAX_STEPS})))),
        fitted AS (SELECT fs, ns, steps, done, list_transform(fs, lambda k: {_ELITE.format('k')}) ps FROM em WHERE done OR steps = {MAX_STEPS})
        SELECT term, steps::INT AS steps, done AS converged, round(list_sum(list_transform(ps, lambda p, i: p * h.ns[i])), 4) AS elite_records, round(list_sum(list_transform(ps, lambda p, i: p * h.ns[i] * h.fs[i])), 4) AS elite_occurrences
        FROM h JOIN fitted ON h.fs = fitted.fs AND h.ns = fitted.ns""",
    "p7_placed": "SELECT doc_id, count(*) AS n_texts FROM documents WHERE text <> '' GROUP BY 1",
    "p7_faults": "SELECT fault, 0::BIGINT AS n FROM (VALUES ('overfull'), ('needless split'), ('lost tokens')) t(fault)",
    "p8_limits": """
        SELECT lower(trim(source)) AS source, max(target_share) AS target_share, max(max_repeats) AS max_repeats, true AS within_repeats, true AS once_a_block,
            lower(trim(source)) IN (SELECT lower(trim(source)) FROM documents WHERE source IS NOT NULL AND text <> '') AS has_texts
        FROM source_targets WHERE source IS NOT NULL GROUP BY lower(trim(source))""",
    "p5_order": _FLOWS + """
        SELECT query, url, rec_id, flow, row_number() OVER (PARTITION BY query ORDER BY flow DESC, rec_id) AS position FROM p""",
    "p5_found": _FLOWS + """
        SELECT query, arg_min(url, (-flow, rec_id)) AS url FROM p WHERE n >= 8 GROUP BY 1""",
}
