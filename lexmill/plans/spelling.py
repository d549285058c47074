"""Queries of spelling correction: the model is built from the texts of all sources but the log of typed and right
queries, which gives the edit pairs."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.edits import edit_list, osa
from lexmill.operators import spelling as S
from lexmill.plans.problems import table
from lexmill.session import materialise, shared_path

LOG = "coalesce(lower(trim(source)), '') = 'spell_log'"


def _lines(spark, sf):
    return S.lines(table(spark, sf, "documents").where(f"NOT {LOG}"))


def _pairs(spark, sf):
    return S.edit_pairs(S.lines(table(spark, sf, "documents").where(LOG)))


def _model(spark, sf):
    rows = _lines(spark, sf)
    return materialise(S.unigrams(rows), "unigrams"), materialise(S.bigrams(rows), "bigrams")


def _queries(spark, sf):
    return _pairs(spark, sf).select("query").where("trim(query) <> ''").distinct()


def spell_lines(spark, sf):
    return _lines(spark, sf).groupBy("line").agg(F.count(F.lit(1)).alias("cnt"))


def spell_pairs(spark, sf):
    return _pairs(spark, sf)


def spell_unigrams(spark, sf):
    return S.unigrams(_lines(spark, sf))


def spell_bigrams(spark, sf):
    return S.bigrams(_lines(spark, sf))


def spell_total(spark, sf):
    return S.total(S.unigrams(_lines(spark, sf)))


def spell_kgrams(spark, sf):
    return S.kgrams(S.unigrams(_lines(spark, sf)))


def spell_letters(spark, sf):
    return S.valid_letters(S.unigrams(_lines(spark, sf)))


def spell_neighbours(spark, sf):
    return S.neighbours(_queries(spark, sf), S.unigrams(_lines(spark, sf)))


def spell_word_candidates(spark, sf):
    uni = materialise(S.unigrams(_lines(spark, sf)), "unigrams")
    words = _queries(spark, sf).select(F.explode(F.regexp_extract_all("query", F.lit(r"\S+"), F.lit(0))).alias("word"))
    return S.word_candidates(words, uni)


def spell_known(spark, sf):
    """Queries whose words are all known, and the share of known pairs."""
    seen = S.looked_up(_queries(spark, sf), "query", *_model(spark, sf))
    return seen.select("query", F.forall("w", lambda x: x["uni"].isNotNull()).alias("all_known"), F.round(S.coverage(F.col("w")), 9).alias("coverage"))


def spell_splits(spark, sf):
    return S.split_candidates(_queries(spark, sf), *_model(spark, sf))


def spell_best_splits(spark, sf):
    return S.best_splits(_queries(spark, sf), *_model(spark, sf))


def spell_suspicions(spark, sf):
    seen = S.suspicions(S.looked_up(_queries(spark, sf), "query", *_model(spark, sf)))
    return seen.select("query", F.array_join(F.transform("flags", lambda f: F.when(f, "1").otherwise("0")), "").alias("flags"))


def spell_model_scores(spark, sf):
    rows = _pairs(spark, sf).select(F.col("corrected").alias("cand"))
    return S.model_scores(rows, *_model(spark, sf)).select("cand", F.round("model", 6).alias("model"))


def spell_letter_counts(spark, sf):
    return S.character_counts(_pairs(spark, sf))[0]


def spell_letter_pair_counts(spark, sf):
    return S.character_counts(_pairs(spark, sf))[1]


def spell_distances(spark, sf):
    return _pairs(spark, sf).select("query", "corrected", osa("corrected", "query").alias("distance"))


def spell_edits(spark, sf):
    e = _pairs(spark, sf).select("query", "corrected", edit_list("corrected", "query").alias("e"))
    return e.select("query", "corrected", F.posexplode("e").alias("at", "e")).select("query", "corrected", "at", "e.op", "e.a", "e.b")


def spell_edit_counts(spark, sf):
    return S.edit_counts(_pairs(spark, sf))


def spell_channel(spark, sf):
    return S.channel(_pairs(spark, sf)).withColumn("p", F.round("p", 12))


def spell_word_distance(spark, sf):
    return S.word_distance(F.col("corrected"), F.col("query"), _pairs(spark, sf).distinct(), ["query", "corrected"])


def spell_candidates(spark, sf):
    uni, bi = _model(spark, sf)
    return S.candidates(S.best_splits(_queries(spark, sf), uni, bi).select("alt").distinct(), uni, bi)


def _typed(spark, sf, pairs):
    model = S.Model(*_model(spark, sf))
    splits = S.best_splits(_queries(spark, sf), model.unigrams, model.bigrams).select("alt").distinct()
    scored = S.scored_candidates(splits, model, pairs)
    return scored.select("alt", "cand", F.round("model", 6).alias("model"), F.round("channel", 6).alias("channel"))


def spell_uniform_scores(spark, sf):
    """The known candidates of each text with the ln probabilities of model and uniform channel."""
    return _typed(spark, sf, None)


def spell_learned_scores(spark, sf):
    return _typed(spark, sf, _pairs(spark, sf))


def spell_stored_model(spark, sf):
    """Correction from a model that was written and read."""
    path = shared_path(spark, "model")
    S.write(path, S.build(_lines(spark, sf)))
    return S.correct(_queries(spark, sf), S.read(spark, path))


def spell_uniform(spark, sf):
    return S.correct(_queries(spark, sf), _lines(spark, sf))


def spell_learned(spark, sf):
    return S.correct(_queries(spark, sf), _lines(spark, sf), _pairs(spark, sf))


def spell_accuracy(spark, sf):
    gold = _pairs(spark, sf).groupBy("query").agg(F.min("corrected").alias("gold"))
    return S.accuracy(spell_learned(spark, sf), gold)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        spell_lines, spell_pairs, spell_unigrams, spell_bigrams, spell_total, spell_kgrams, spell_letters, spell_neighbours, spell_word_candidates, spell_known, spell_splits,
        spell_best_splits, spell_suspicions, spell_model_scores, spell_letter_counts, spell_letter_pair_counts, spell_distances, spell_edits, spell_channel, spell_word_distance,
        spell_candidates, spell_edit_counts, spell_uniform_scores, spell_learned_scores, spell_stored_model, spell_uniform, spell_learned, spell_accuracy,
    )
}

SRC = f"""lines AS (SELECT unnest(string_split(text, chr(10))) line FROM documents WHERE text IS NOT NULL AND NOT {LOG}),
    pairs AS (SELECT string_split(line, chr(9))[1] AS query, string_split(line, chr(9))[2] AS corrected FROM (SELECT unnest(string_split(text, chr(10))) line FROM documents WHERE text IS NOT NULL AND {LOG}) WHERE contains(line, chr(9)) AND trim(line) <> ''),
    asked AS (SELECT DISTINCT query FROM pairs WHERE trim(query) <> '')"""
UNI = f"{SRC}, uni AS (SELECT term, count(*) cnt FROM (SELECT unnest(string_split(line, ' ')) term FROM lines) GROUP BY 1)"
BI = f"{UNI}, bi AS (SELECT w1, w2, count(*) cnt FROM (SELECT unnest(w[:len(w) - 1]) w1, unnest(w[2:]) w2 FROM (SELECT string_split(line, ' ') w FROM lines) WHERE len(w) > 1) GROUP BY 1, 2)"
LETTERS = f"{UNI}, letters AS (SELECT term letter FROM uni WHERE length(term) = 1 AND contains('{S.ALPHABET.replace(chr(39), chr(39) * 2)}', term))"
_GRAMS = "unnest(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


def _seen(source: str, key: str) -> str:
    """Words of the texts in source with their counts."""
    return f"""w AS (SELECT {key}, unnest(t) word, unnest(range(len(t))) pos, unnest(t[2:] || [NULL]) next FROM (SELECT {key}, regexp_extract_all({key}, '\\S+') t FROM (SELECT DISTINCT {key} FROM {source}))),
    seen AS (SELECT w.{key}, pos, word, next, u.cnt AS uc, b.cnt AS bc FROM w LEFT JOIN uni u ON u.term = word LEFT JOIN bi b ON b.w1 = word AND b.w2 = next)"""


SPLITS = f"""{BI}, qw AS (SELECT query, unnest(t) word, unnest(range(1, len(t) + 1)) pos, t FROM (SELECT query, regexp_extract_all(query, '\\S+') t FROM asked)),
    cut AS (SELECT query, t, pos, word, unnest(range(1, length(word))) k FROM qw WHERE length(word) > 6 AND word NOT IN (SELECT term FROM uni)),
    halves AS (SELECT DISTINCT query, array_to_string(list_transform(t, lambda x, i: CASE WHEN i = pos THEN substr(word, 1, k) || ' ' || substr(word, k + 1) ELSE x END), ' ') alt FROM cut JOIN bi ON w1 = substr(word, 1, k) AND w2 = substr(word, k + 1)),
    spaces AS (SELECT query, unnest(range(1, length(query) + 1)) i FROM asked), merged AS (SELECT query, substr(query, 1, i - 1) || substr(query, i + 1) alt FROM spaces WHERE substr(query, i, 1) = ' '),
    {_seen('merged', 'alt')}, sound AS (SELECT alt FROM seen GROUP BY alt HAVING bool_and(uc IS NOT NULL) AND bool_and(next IS NULL OR bc IS NOT NULL)),
    options AS (SELECT query, query alt FROM asked UNION SELECT query, alt FROM halves UNION SELECT query, alt FROM merged WHERE alt IN (SELECT alt FROM sound))"""

def _osa(source: str, name: str = "osa") -> str:
    """Tables `osa` (a, b, n, m, t) of the distances of all prefixes of the texts a and b of source, diagonal by diagonal."""
    cell = """CASE WHEN i > k OR k - i > m THEN NULL WHEN i = 0 THEN k WHEN i = k THEN i
        ELSE least(t[k - 1][i] + (x[i] <> y[k - i])::INT, t[k][i] + 1, t[k][i + 1] + 1, CASE WHEN i > 1 AND k - i > 1 AND x[i] = y[k - i - 1] AND x[i - 1] = y[k - i] THEN t[k - 3][i - 1] + (x[i] <> y[k - i])::INT END) END"""
    return f"""{name} AS (SELECT a, b, n, m, t FROM (
        WITH RECURSIVE d(a, b, x, y, n, m, k, t) USING KEY (a, b) AS (
            SELECT a, b, CASE WHEN a = '' THEN [] ELSE string_split(a, '') END, CASE WHEN b = '' THEN [] ELSE string_split(b, '') END, length(a)::INT, length(b)::INT, 1, [list_transform(range(0, length(a) + 1), lambda i: CASE WHEN i = 0 THEN 0 END::INT)]
            FROM (SELECT DISTINCT a, b FROM {source})
            UNION SELECT a, b, x, y, n, m, k + 1, list_append(t, list_transform(range(0, n + 1), lambda i: ({cell})::INT)) FROM d WHERE k <= n + m)
        SELECT * FROM d))"""


#: Edits of a text a into b from the end; the tables must be those of texts led by `~`.
_EDITS = """walk AS (SELECT a, b, string_split(a, '') x, string_split(b, '') y, n i, m j, t, 0 done, NULL::INT op, NULL::VARCHAR pa, NULL::VARCHAR pb FROM osa
        UNION ALL SELECT a, b, x, y, i - CASE kind WHEN 1 THEN 0 WHEN 3 THEN 2 ELSE 1 END, j - CASE kind WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END, t, done + (kind >= 0)::INT, CASE WHEN kind >= 0 THEN kind END,
            CASE WHEN kind IN (0, 1) THEN x[i] WHEN kind > 1 THEN x[i - 1] END, CASE WHEN kind IN (0, 1) THEN y[j] WHEN kind > 1 THEN x[i] END
        FROM (SELECT *, CASE WHEN x[i] = y[j] AND here = t[i + j - 1][i] THEN -1 WHEN x[i] <> y[j] AND here = t[i + j - 1][i] + 1 THEN 0 WHEN here = t[i + j][i + 1] + 1 THEN 1 WHEN i > 1 AND here = t[i + j][i] + 1 THEN 2 ELSE 3 END kind
            FROM (SELECT *, t[i + j + 1][i + 1] here FROM walk WHERE i > 0 AND j > 0))),
    edits AS (SELECT substr(a, 2) a, substr(b, 2) b, done - 1 AS spot, op, pa, pb FROM walk WHERE op IS NOT NULL)"""
LED = "(SELECT '~' || corrected a, '~' || query b FROM pairs)"
COUNTED = f"""letter_n AS (SELECT letter, count(*) n FROM (SELECT unnest(string_split('~' || corrected, '')) letter FROM pairs) GROUP BY 1),
    gram_n AS (SELECT gram, count(*) n FROM (SELECT {_GRAMS.format('c')} gram FROM (SELECT '~' || corrected c FROM pairs) WHERE length(c) >= 2) GROUP BY 1)"""


def _based(edits: str) -> str:
    """Edits with what their counts are divided by."""
    n = len(S.ALPHABET)
    return f"""(SELECT e.*, CASE op WHEN 0 THEN coalesce(lb.n, 0) + {n} WHEN 1 THEN coalesce(la.n, 0) + {n} ELSE coalesce(g.n, 0) + {n * n} END base
        FROM {edits} e LEFT JOIN letter_n lb ON lb.letter = pb LEFT JOIN letter_n la ON la.letter = pa LEFT JOIN gram_n g ON g.gram = pa || pb)"""


def _seen_as(name: str, source: str, key: str) -> str:
    return _seen(source, key).replace("seen AS (", f"{name} AS (").replace("w AS (SELECT", f"w_{name} AS (SELECT").replace("SELECT w.", f"SELECT w_{name}.").replace("FROM w LEFT", f"FROM w_{name} LEFT")


#: The best split of each query, the suspicious words of these texts, and what may be meant.
BEST = f"""{SPLITS}, {_seen_as('seen_o', 'options', 'alt')},
    cover AS (SELECT alt, coalesce(count(bc) FILTER (next IS NOT NULL) / nullif(count(next), 0), -1) c FROM seen_o GROUP BY 1),
    best AS (SELECT query, arg_max(alt, (c, (alt = query)::INT, alt)) alt FROM options JOIN cover USING (alt) GROUP BY 1)"""
CANDS = f"""{BEST}, alts AS (SELECT DISTINCT alt FROM best), {_seen_as('seen_a', 'alts', 'alt')},
    sus AS (SELECT *, count(*) OVER q AS n, uc IS NULL AS oov, lag(uc IS NULL) OVER o AS before, lead(uc IS NULL) OVER o AS after, lag(bc IS NULL) OVER o AS last_pair FROM seen_a WINDOW q AS (PARTITION BY alt), o AS (PARTITION BY alt ORDER BY pos)),
    flagged AS (SELECT alt, list(word ORDER BY pos) words, list(oov ORDER BY pos) oov,
        list(pos ORDER BY pos) FILTER (oov OR ((CASE WHEN n = 1 THEN true WHEN pos < n - 1 THEN bc IS NULL ELSE last_pair END) AND NOT coalesce(before, false) AND NOT coalesce(after, false))) spots FROM sus GROUP BY 1),
    slots AS (SELECT alt, words, oov, spots[1] i, NULL::BIGINT j FROM flagged WHERE coalesce(len(spots), 0) < 2
        UNION ALL SELECT f.alt, words, oov, u.i, v.j FROM flagged f, unnest(f.spots) u(i), unnest(f.spots) v(j) WHERE len(f.spots) >= 2 AND u.i < v.j),
    open_ AS (SELECT alt, words, i, j, words[i + 1] wi, words[j + 1] wj FROM slots WHERE len(list_filter(oov, lambda o, p: o AND p - 1 IS DISTINCT FROM i AND p - 1 IS DISTINCT FROM j)) = 0),
    letters AS (SELECT term letter FROM uni WHERE length(term) = 1 AND contains('{S.ALPHABET.replace(chr(39), chr(39) * 2)}', term)),
    slot_words AS (SELECT wi word FROM open_ WHERE wi IS NOT NULL UNION SELECT wj FROM open_ WHERE wj IS NOT NULL),
    sg AS (SELECT word, gram, count(*) n FROM (SELECT word, {_GRAMS.format('word')} gram FROM slot_words WHERE length(word) >= 2) GROUP BY 1, 2),
    sk AS (SELECT DISTINCT {_GRAMS.format('term')} gram, term FROM uni WHERE length(term) >= 2),
    near AS (SELECT word, term cand FROM (SELECT word, term, sum(n) num FROM sg JOIN sk USING (gram) GROUP BY 1, 2) WHERE num / nullif(length(word) + length(term) - 2 - num, 0) > 0.5
        UNION ALL SELECT word, letter FROM slot_words, letters WHERE length(word) = 1),
    replaced AS (SELECT o.alt, array_to_string(list_transform(o.words, lambda x, p: CASE WHEN p - 1 = o.i THEN ci.cand WHEN p - 1 = o.j THEN cj.cand ELSE x END), ' ') cand
        FROM open_ o LEFT JOIN near ci ON ci.word = o.wi LEFT JOIN near cj ON cj.word = o.wj WHERE (o.i IS NULL OR ci.cand IS NOT NULL) AND (o.j IS NULL OR cj.cand IS NOT NULL)),
    ap AS (SELECT alt, unnest(range(0, length(alt) + 1)) i FROM alts),
    around AS (SELECT alt, substr(alt, 1, i) || substr(alt, i + 2) AS near FROM ap WHERE i < length(alt)
        UNION SELECT alt, substr(alt, 1, i) || substr(alt, i + 2, 1) || substr(alt, i + 1, 1) || substr(alt, i + 3) FROM ap WHERE i < length(alt) - 1
        UNION SELECT alt, substr(alt, 1, i) || letter || substr(alt, i + 2) FROM ap, letters WHERE i < length(alt)
        UNION SELECT alt, substr(alt, 1, i) || letter || substr(alt, i + 1) FROM ap, letters),
    cands AS (SELECT alt, cand FROM replaced UNION SELECT alt, c FROM (SELECT alt, array_to_string(regexp_extract_all(near, '\\S+'), ' ') c FROM around) WHERE c <> '')"""
SCORED = f"""{CANDS}, {_seen_as('seen_c', 'cands', 'cand')}, tot AS (SELECT sum(cnt) total FROM uni),
    lm AS (SELECT cand, sum(CASE WHEN pos = 0 THEN ln(uc / total) ELSE 0 END + CASE WHEN next IS NOT NULL THEN ln(0.2::DOUBLE * next_uc / total + 0.8::DOUBLE * coalesce(bc, 0) / uc) ELSE 0 END) AS model
        FROM (SELECT *, lead(uc) OVER (PARTITION BY cand ORDER BY pos) next_uc FROM seen_c), tot GROUP BY 1 HAVING bool_and(uc IS NOT NULL)),
    scored AS (SELECT alt, cand, model FROM cands JOIN lm USING (cand)), {_osa("(SELECT '~' || cand a, '~' || alt b FROM scored)")}"""
#: ln probabilities of what was typed.
UNIFORM = f"typed AS (SELECT substr(b, 2) alt, substr(a, 2) cand, CASE WHEN d = 0 THEN ln({S.P_EQUAL}::DOUBLE) ELSE d * ln({S.P_EDIT}::DOUBLE) + (n - 1 - d) * ln(1 - {S.P_EDIT}::DOUBLE) END ch FROM (SELECT a, b, n, t[n + m + 1][n + 1] d FROM osa))"
LEARNED = f"""{_EDITS}, {_osa(LED, 'osa_p')}, {_EDITS.replace('walk', 'walk_p').replace('edits AS', 'edits_p AS').replace('FROM osa', 'FROM osa_p')}, {COUNTED},
    seen_edits AS (SELECT op, pa, pb, count(*) cnt FROM edits_p GROUP BY 1, 2, 3),
    kinds AS (SELECT op, pa, pb, (coalesce(cnt, 0) + 1) / base p FROM {_based('(SELECT DISTINCT op, pa, pb FROM edits)')} LEFT JOIN seen_edits USING (op, pa, pb)),
    typed AS (SELECT substr(o.b, 2) alt, substr(o.a, 2) cand, coalesce(c, ln({S.P_EQUAL}::DOUBLE)) ch FROM osa o LEFT JOIN (SELECT a, b, sum(ln(p)) c FROM edits JOIN kinds USING (op, pa, pb) GROUP BY 1, 2) e ON e.a = substr(o.a, 2) AND e.b = substr(o.b, 2))"""
CORRECTED = """final AS (SELECT alt, arg_min(cand, (-round(model + ch, 9), cand)) cand FROM scored JOIN typed USING (alt, cand) GROUP BY 1),
    corrected AS (SELECT asked.query, coalesce(nullif(cand, ''), asked.query) corrected FROM asked LEFT JOIN best ON best.query = asked.query LEFT JOIN final USING (alt))"""

ORACLES: dict[str, str] = {
    "spell_lines": f"WITH {SRC} SELECT line, count(*) AS cnt FROM lines GROUP BY 1",
    "spell_pairs": f"WITH {SRC} SELECT query, corrected FROM pairs",
    "spell_unigrams": f"WITH {UNI} SELECT term, cnt FROM uni",
    "spell_bigrams": f"WITH {BI} SELECT w1, w2, cnt FROM bi",
    "spell_total": f"WITH {UNI} SELECT sum(cnt)::BIGINT AS total FROM uni",
    "spell_kgrams": f"WITH {UNI} SELECT DISTINCT {_GRAMS.format('term')} AS gram, term FROM uni WHERE length(term) >= 2",
    "spell_letters": f"WITH {LETTERS} SELECT letter FROM letters",
    "spell_neighbours": f"""WITH {LETTERS}, q AS (SELECT query, unnest(range(0, length(query) + 1)) i FROM asked)
        SELECT query, substr(query, 1, i) || substr(query, i + 2) AS near FROM q WHERE i < length(query)
        UNION SELECT query, substr(query, 1, i) || substr(query, i + 2, 1) || substr(query, i + 1, 1) || substr(query, i + 3) FROM q WHERE i < length(query) - 1
        UNION SELECT query, substr(query, 1, i) || letter || substr(query, i + 2) FROM q, letters WHERE i < length(query)
        UNION SELECT query, substr(query, 1, i) || letter || substr(query, i + 1) FROM q, letters""",
    "spell_word_candidates": f"""WITH {LETTERS}, words AS (SELECT DISTINCT unnest(regexp_extract_all(query, '\\S+')) word FROM asked),
        g AS (SELECT word, gram, count(*) n FROM (SELECT word, {_GRAMS.format('word')} gram FROM words WHERE length(word) >= 2) GROUP BY 1, 2),
        k AS (SELECT DISTINCT {_GRAMS.format('term')} gram, term FROM uni WHERE length(term) >= 2),
        s AS (SELECT word, term, sum(n) num FROM g JOIN k USING (gram) GROUP BY 1, 2)
        SELECT word, term AS cand FROM s WHERE num / nullif(length(word) + length(term) - 2 - num, 0) > 0.5
        UNION ALL SELECT word, letter FROM words, letters WHERE length(word) = 1""",
    "spell_known": f"WITH {BI}, {_seen('asked', 'query')} SELECT query, bool_and(uc IS NOT NULL) AS all_known, round(count(bc) FILTER (next IS NOT NULL) / nullif(count(next), 0), 9) AS coverage FROM seen GROUP BY 1",
    "spell_splits": f"WITH {SPLITS} SELECT query, alt FROM options",
    "spell_suspicions": f"""WITH {BI}, {_seen('asked', 'query')}, n AS (SELECT *, count(*) OVER q AS n, uc IS NULL AS oov, lag(uc IS NULL) OVER o AS before, lead(uc IS NULL) OVER o AS after, lag(bc IS NULL) OVER o AS last_pair FROM seen WINDOW q AS (PARTITION BY query), o AS (PARTITION BY query ORDER BY pos))
        SELECT query, string_agg(CASE WHEN oov OR ((CASE WHEN n = 1 THEN true WHEN pos < n - 1 THEN bc IS NULL ELSE last_pair END) AND NOT coalesce(before, false) AND NOT coalesce(after, false)) THEN '1' ELSE '0' END, '' ORDER BY pos) AS flags FROM n GROUP BY 1""",
    "spell_model_scores": f"""WITH {BI}, {_seen('(SELECT corrected AS query FROM pairs)', 'query')}, t AS (SELECT sum(cnt) total FROM uni), p AS (SELECT *, lead(uc) OVER (PARTITION BY query ORDER BY pos) next_uc FROM seen)
        SELECT query AS cand, round(sum(CASE WHEN pos = 0 THEN ln(uc / total) ELSE 0 END + CASE WHEN next IS NOT NULL THEN ln(0.2::DOUBLE * next_uc / total + 0.8::DOUBLE * coalesce(bc, 0) / uc) ELSE 0 END), 6) AS model FROM p, t GROUP BY 1 HAVING bool_and(uc IS NOT NULL)""",
    "spell_letter_counts": f"WITH {SRC} SELECT letter, count(*) AS cnt FROM (SELECT unnest(string_split('~' || corrected, '')) letter FROM pairs) GROUP BY 1",
    "spell_letter_pair_counts": f"WITH {SRC}, t AS (SELECT '~' || corrected c FROM pairs) SELECT gram, count(*) AS cnt FROM (SELECT {_GRAMS.format('c')} gram FROM t WHERE length(c) >= 2) GROUP BY 1",
    "spell_best_splits": f"WITH {BEST} SELECT query, alt FROM best",
    "spell_candidates": f"WITH {CANDS} SELECT alt, cand FROM cands",
    "spell_distances": f"WITH {SRC}, {_osa(LED)} SELECT query, corrected, t[n + m + 1][n + 1] AS distance FROM pairs JOIN osa ON a = '~' || corrected AND b = '~' || query",
    "spell_edits": f'WITH RECURSIVE {SRC}, {_osa(LED)}, {_EDITS} SELECT query, corrected, spot AS "at", op, pa AS a, pb AS b FROM pairs JOIN edits ON a = corrected AND b = query',
    "spell_edit_counts": f"WITH RECURSIVE {SRC}, {_osa(LED)}, {_EDITS} SELECT op, pa AS a, pb AS b, count(*) AS cnt FROM pairs JOIN edits ON a = corrected AND b = query GROUP BY ALL",
    "spell_channel": f"WITH RECURSIVE {SRC}, {_osa(LED)}, {_EDITS}, {COUNTED}, counts AS (SELECT op, pa, pb, count(*) cnt FROM pairs JOIN edits ON a = corrected AND b = query GROUP BY ALL) SELECT op, pa AS a, pb AS b, round((cnt + 1) / base, 12) AS p FROM {_based('counts')}",
    "spell_word_distance": f"""WITH {SRC}, wp AS (SELECT query, corrected, unnest(list_zip(regexp_extract_all(corrected, '\\S+'), regexp_extract_all(query, '\\S+'))) z FROM (SELECT DISTINCT * FROM pairs)),
        wt AS (SELECT query, corrected, coalesce(z[1], '') a, coalesce(z[2], '') b FROM wp), {_osa('wt')}
        SELECT query, corrected, sum(t[n + m + 1][n + 1])::BIGINT AS distance FROM wt JOIN osa USING (a, b) GROUP BY 1, 2""",
    "spell_uniform": f"WITH {SCORED}, {UNIFORM}, {CORRECTED} SELECT query, corrected FROM corrected",
    "spell_uniform_scores": f"WITH {SCORED}, {UNIFORM} SELECT alt, cand, round(model, 6) AS model, round(ch, 6) AS channel FROM scored JOIN typed USING (alt, cand)",
    "spell_learned": f"WITH RECURSIVE {SCORED}, {LEARNED}, {CORRECTED} SELECT query, corrected FROM corrected",
    "spell_learned_scores": f"WITH RECURSIVE {SCORED}, {LEARNED} SELECT alt, cand, round(model, 6) AS model, round(ch, 6) AS channel FROM scored JOIN typed USING (alt, cand)",
    "spell_accuracy": f"""WITH RECURSIVE {SCORED}, {LEARNED}, {CORRECTED}, gold AS (SELECT query, min(corrected) gold FROM pairs GROUP BY 1)
        SELECT avg((corrected = gold)::INT) AS share_right, count(*) FILTER (len(regexp_extract_all(corrected, '\\S+')) <> len(regexp_extract_all(gold, '\\S+'))) AS other_word_count, count(*) FILTER (corrected = '') AS n_empty FROM corrected JOIN gold USING (query)""",
}
ORACLES["spell_stored_model"] = ORACLES["spell_uniform"]
