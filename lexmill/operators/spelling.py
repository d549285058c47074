"""Spelling correction of queries: language model, character pairs, edit channel, candidates and their scores."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.edits import edit_list, one_edit, osa
from lexmill.functions.text import char_bigrams, lm_tokens, tokens
from lexmill.session import materialise, merged, partitions
from lexmill.sources.files import read_model, write_model

#: Letters of the channel and constants of the model (fixed values).
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789&$+_' "
MIX, P_EQUAL, P_EDIT, LEAST_JACCARD, SPLIT_OVER = 0.2, 0.9, 0.01, 0.5, 6


def lines(documents: DataFrame) -> DataFrame:
    """(line) of all texts."""
    return documents.where("text IS NOT NULL").select(F.explode(F.split("text", "\n", -1)).alias("line"))


def edit_pairs(line_rows: DataFrame) -> DataFrame:
    """(query, corrected) of lines with a tab."""
    parts = F.split("line", "\t", -1)
    return line_rows.where(F.trim("line") != "").where(F.size(parts) >= 2).select(parts[0].alias("query"), parts[1].alias("corrected"))


def unigrams(line_rows: DataFrame) -> DataFrame:
    return line_rows.select(F.explode(lm_tokens(F.col("line"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


def bigrams(line_rows: DataFrame) -> DataFrame:
    words = line_rows.select(lm_tokens(F.col("line")).alias("w")).where("size(w) > 1")
    two = F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("w1"), F.slice("w", F.lit(2), F.size("w") - 1).alias("w2")))
    return words.select(two.alias("t")).select("t.w1", "t.w2").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("cnt"))


def total(uni: DataFrame) -> DataFrame:
    return uni.agg(F.sum("cnt").alias("total"))


def kgrams(uni: DataFrame) -> DataFrame:
    """(gram, term): the character pairs of every word, kept long."""
    return uni.select("term", F.explode(F.array_distinct(char_bigrams(F.col("term")))).alias("gram")).select("gram", "term")


def valid_letters(uni: DataFrame) -> DataFrame:
    """(letter): letters of the alphabet that are words themselves."""
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    return uni.where(F.array_contains(letters, F.col("term"))).select(F.col("term").alias("letter"))


def _letters(uni: DataFrame) -> DataFrame:
    """One row with the valid letters, in order; at most the alphabet."""
    return valid_letters(uni).agg(F.array_sort(F.collect_list("letter")).alias("letters"))


def neighbours(queries: DataFrame, uni: DataFrame) -> DataFrame:
    """(query, near): each query's different one-edit neighbours."""
    return queries.crossJoin(F.broadcast(_letters(uni))).select("query", F.explode(F.array_distinct(one_edit(F.col("query"), F.col("letters")))).alias("near"))


def word_candidates(words: DataFrame, uni: DataFrame) -> DataFrame:
    """(word, cand): dictionary words whose character pairs overlap enough with the word's; for one letter, the valid letters.

    Words of n and m characters must share more than (n + m - 2) / 3 pairs, so a candidate has one of the word's pairs
    that are left when the most frequent of them are taken away, one less than must be shared: its p-th pair, the rarest
    first, finds terms of at most 2 n - 3 p + 1 characters. The join is by pair and length, so it makes no other rows and
    a frequent pair is many keys; the overlap is then counted in the row, and what falls short is never shuffled.
    """
    given, n_tasks = words.select("word").distinct(), partitions(uni.sparkSession)
    grams = kgrams(uni).withColumn("m", F.length("term"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    places = given.select("word", F.explode(char_bigrams(F.col("word"))).alias("gram"))
    # A pair that no dictionary word has is the rarest.
    rated = places.join(merged(often), "gram", "left").select("word", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram").alias("r"))
    sorted_ = rated.groupBy("word").agg(F.array_sort(F.collect_list("r")).alias("all")).select("word", F.transform("all", lambda r: r["gram"]).alias("mine"), F.length("word").alias("n"))
    # A term has one pair less than characters; it can share more only where the word repeats a pair.
    single_pairs = F.size(F.array_distinct("mine")) == F.size("mine")
    ranked = sorted_.select("word", "n", "mine", F.when(single_pairs, F.floor((F.col("n") + 1) / 2) + 1).otherwise(F.lit(2)).cast("int").alias("lo"), F.explode(F.array_distinct("mine")).alias("gram"))
    hi = (2 * F.col("n") - 3 * F.array_position("mine", F.col("gram")) + 1).cast("int")
    lengths = F.when(hi >= F.col("lo"), F.sequence("lo", F.greatest(hi, "lo"))).otherwise(F.array().cast("array<int>"))
    rare = ranked.select("word", "n", "mine", "gram", F.explode(lengths).alias("m"))
    # Few bytes but much work: spread over all tasks, whatever their size.
    spread = lambda df: df.repartition(n_tasks, "gram", "m")
    num = F.size(F.filter("mine", lambda g: F.contains(F.col("term"), g)))
    # The overlap is at most the pairs of the word.
    near = spread(rare).join(merged(spread(grams)), ["gram", "m"])
    close = near.where(F.try_divide(num.cast("double"), F.col("n") + F.col("m") - 2 - num) > LEAST_JACCARD).select("word", F.col("term").alias("cand")).distinct()
    single = given.where("length(word) = 1").crossJoin(F.broadcast(valid_letters(uni))).select("word", F.col("letter").alias("cand"))
    return close.unionByName(single)


def looked_up(rows: DataFrame, key: str, uni: DataFrame, bi: DataFrame) -> DataFrame:
    """(key, n, w): the words of each text in order, each with its count and that of the pair with the next word."""
    at = rows.select(key).distinct().select(key, F.posexplode(tokens(F.col(key))).alias("pos", "word"), tokens(F.col(key)).alias("all"))
    at = at.select(key, "pos", "word", F.try_element_at("all", F.col("pos") + 2).alias("next"))
    counted = at.join(merged(uni.select(F.col("term").alias("word"), F.col("cnt").alias("uni"))), "word", "left")
    paired = counted.join(merged(bi.select(F.col("w1").alias("word"), F.col("w2").alias("next"), F.col("cnt").alias("bi"))), ["word", "next"], "left")
    return paired.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word", "uni", "bi"))).alias("w"))


def coverage(w: Column) -> Column:
    """Share of neighbouring pairs that are known; null for a single word."""
    pairs = F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))
    return F.when(F.size(w) > 1, F.size(F.filter(pairs, lambda x: x["bi"].isNotNull())) / F.size(pairs))


def log_probability(w: Column, of: Column) -> Column:
    """ln of the language model's probability of a text whose words are all known."""
    first = F.log(w[0]["uni"] / of)

    def step(i: Column) -> Column:
        a, b = F.element_at(w, i), F.element_at(w, i + 1)
        return F.log(MIX * b["uni"] / of + (1 - MIX) * F.coalesce(a["bi"], F.lit(0)) / a["uni"])

    rest = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), step)).otherwise(F.array().cast("array<double>"))
    return F.aggregate(rest, first, lambda a, x: a + x)


def split_candidates(queries: DataFrame, uni: DataFrame, bi: DataFrame) -> DataFrame:
    """(query, alt): the query; unknown long words split where the halves are a known pair; spaces removed where the
    result's words and pairs are all known."""
    words = queries.select("query", tokens(F.col("query")).alias("all"))
    at = words.select("query", "all", F.posexplode("all").alias("pos", "word")).where(F.length("word") > SPLIT_OVER)
    unknown = at.join(merged(uni.select(F.col("term").alias("word"))), "word", "left_anti")
    cut = unknown.select("query", "all", "pos", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    halves = cut.withColumns({"w1": F.substring("word", F.lit(1), F.col("k")), "w2": F.substring("word", F.col("k") + 1, F.length("word"))})
    known = halves.join(merged(bi.select("w1", "w2")), ["w1", "w2"], "left_semi")
    splits = known.select("query", F.array_join(F.transform("all", lambda x, i: F.when(i == F.col("pos"), F.concat_ws(" ", "w1", "w2")).otherwise(x)), " ").alias("alt"))
    places = queries.select("query", F.explode(F.sequence(F.lit(1), F.greatest(F.length("query"), F.lit(1)))).alias("i")).where(F.substring("query", F.col("i"), F.lit(1)) == " ")
    shorter = places.select("query", F.concat(F.substring("query", F.lit(1), F.col("i") - 1), F.substring("query", F.col("i") + 1, F.length("query"))).alias("alt"))
    seen = looked_up(shorter, "alt", uni, bi)
    sound = seen.where(F.forall("w", lambda x: x["uni"].isNotNull()) & (F.coalesce(coverage(F.col("w")), F.lit(1.0)) == 1)).select("alt")
    return queries.select("query", F.col("query").alias("alt")).unionByName(splits).unionByName(shorter.join(merged(sound), "alt", "left_semi").select("query", "alt")).distinct()


def best_splits(queries: DataFrame, uni: DataFrame, bi: DataFrame) -> DataFrame:
    """(query, alt): the split or merge with the highest coverage, the query itself among equals; a single word has the least."""
    options = split_candidates(queries, uni, bi)
    scored = options.join(merged(looked_up(options, "alt", uni, bi)), "alt").withColumn("score", F.coalesce(coverage(F.col("w")), F.lit(-1.0)))
    ranked = F.max_by(F.col("alt"), F.struct("score", (F.col("alt") == F.col("query")).alias("same"), "alt"))
    return scored.groupBy("query").agg(ranked.alias("alt"))


def suspicions(seen: DataFrame) -> DataFrame:
    """Adds flags: unknown words, and words of an unknown pair (with the last pair, both) that are not beside an unknown
    word. A single word makes a pair with itself, which looked_up does not know, so it is flagged."""
    w, n = F.col("w"), F.size("w")
    unknown = F.transform(w, lambda x: x["uni"].isNull())
    pair = F.transform(w, lambda x, i: F.when(i < n - 1, x["bi"].isNull()).otherwise(F.when(n > 1, F.element_at(w, -2)["bi"].isNull()).otherwise(F.lit(True))))
    beside = lambda i: F.coalesce(F.try_element_at(unknown, F.when(i > 0, i).cast("int")), F.lit(False)) | F.coalesce(F.try_element_at(unknown, (i + 2).cast("int")), F.lit(False))
    return seen.withColumn("flags", F.transform(unknown, lambda u, i: u | (F.element_at(pair, (i + 1).cast("int")) & ~beside(i))))


def replacements(seen: DataFrame, uni: DataFrame) -> DataFrame:
    """(alt, cand): the texts of seen (looked_up with flags) with up to two suspicious words replaced by candidates.

    With more than two suspicious words every two of them are replaced; texts that keep an unknown word could not be
    scored and are left out at once.
    """
    flagged = F.filter(F.transform("flags", lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    places = seen.select("alt", "w", flagged.alias("at"))
    slots = places.select(
        "alt",
        "w",
        F.when(F.size("at") <= 1, F.array(F.struct(F.try_element_at("at", F.lit(1)).alias("i"), F.lit(None).cast("int").alias("j"))))
        .otherwise(F.flatten(F.transform("at", lambda i: F.transform(F.filter("at", lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
        .alias("slots"),
    ).select("alt", "w", F.explode("slots").alias("s"))
    known = F.forall(F.transform("w", lambda x, p: x["uni"].isNotNull() | F.coalesce(p == F.col("s.i"), F.lit(False)) | F.coalesce(p == F.col("s.j"), F.lit(False))), lambda ok: ok)
    words = F.transform("w", lambda x: x["word"])
    open_ = slots.where(known).select("alt", words.alias("w"), "s.i", "s.j", F.col("w")[F.coalesce("s.i", F.lit(0))]["word"].alias("wi"), F.col("w")[F.coalesce("s.j", F.lit(0))]["word"].alias("wj"))
    asked = open_.where("i IS NOT NULL").select(F.col("wi").alias("word")).union(open_.where("j IS NOT NULL").select("wj"))
    near = materialise(word_candidates(asked, uni), "candidates")
    one = open_.where("i IS NULL").withColumn("ci", F.lit(None).cast("string")).unionByName(open_.where("i IS NOT NULL").join(merged(near.select(F.col("word").alias("wi"), F.col("cand").alias("ci"))), "wi"))
    two = one.where("j IS NULL").withColumn("cj", F.lit(None).cast("string")).unionByName(one.where("j IS NOT NULL").join(merged(near.select(F.col("word").alias("wj"), F.col("cand").alias("cj"))), "wj"))
    text = F.array_join(F.transform("w", lambda x, p: F.when(F.coalesce(p == F.col("i"), F.lit(False)), F.col("ci")).when(F.coalesce(p == F.col("j"), F.lit(False)), F.col("cj")).otherwise(x)), " ")
    return two.select("alt", text.alias("cand"))


def _close(alts: DataFrame, uni: DataFrame) -> DataFrame:
    """alts with `cand`: each text's one-edit neighbours, blanks made single."""
    near = alts.crossJoin(F.broadcast(_letters(uni))).select(*alts.columns, F.explode(F.array_distinct(one_edit(F.col("alt"), F.col("letters")))).alias("near"))
    return near.select(*alts.columns, F.array_join(tokens(F.col("near")), " ").alias("cand")).where("cand <> ''")


def candidates(splits: DataFrame, uni: DataFrame, bi: DataFrame) -> DataFrame:
    """(alt, cand): for each text its replacements and its neighbours, known or not."""
    seen = materialise(suspicions(looked_up(splits, "alt", uni, bi)), "suspicions")
    return replacements(seen, uni).unionByName(_close(seen.select("alt"), uni)).distinct()


def _pair_keys(words: Column) -> Column:
    """Neighbouring words with a blank between; words have none, so no two pairs look alike."""
    return F.when(F.size(words) > 1, F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda x, i: F.concat_ws(" ", x, F.element_at(words, (i + 2).cast("int"))))).otherwise(F.array().cast("array<string>"))


def known_candidates(seen: DataFrame, model: "Model") -> DataFrame:
    """(alt, cand, w): the candidates of seen whose words are all known, with the counts of words and pairs.

    A candidate differs from its text in a word or two. What they share is taken from the text's own counts; only new
    words are looked up, and for candidates that pass, new pairs. So a frequent word is no key of a join.
    """
    words, had = F.transform("w", lambda x: x["word"]), F.filter("w", lambda x: x["uni"].isNotNull())
    texts = seen.select("alt", "w", F.transform(had, lambda x: x["word"]).alias("had"), _pair_keys(words).alias("pairs"))
    differing = lambda df: df.withColumn("t", F.split("cand", " ", -1)).select("alt", "cand", F.array_except("t", "had").alias("new"))
    replaced = replacements(seen, model.unigrams).distinct().join(merged(texts.select("alt", "had")), "alt")
    lost = F.transform(F.filter("w", lambda x: x["uni"].isNull()), lambda x: x["word"])
    close = differing(_close(seen.select("alt", F.transform(had, lambda x: x["word"]).alias("had"), lost.alias("lost")), model.unigrams).where(~F.arrays_overlap(F.split("cand", " ", -1), "lost")))
    every = materialise(differing(replaced).unionByName(close).dropDuplicates(["alt", "cand"]), "different")
    n = F.size("new")
    found = every.where(n > 0).select("alt", "cand", n.alias("n"), F.explode("new").alias("term")).join(merged(model.unigrams.select("term", F.col("cnt"))), "term")
    new_words = found.groupBy("alt", "cand", "n").agg(F.map_from_entries(F.collect_list(F.struct("term", "cnt"))).alias("words")).where(F.size("words") == F.col("n"))
    none = F.create_map().cast("map<string,bigint>")
    passed = new_words.select("alt", "cand", "words").unionByName(every.where(n == 0).select("alt", "cand", none.alias("words")))
    ahead = materialise(passed.join(merged(texts), "alt").withColumn("t", F.split("cand", " ", -1)).withColumn("fresh", F.array_except(_pair_keys(F.col("t")), "pairs")).drop("had", "pairs"), "known")
    parts = F.split("pair", " ", -1)
    pairs = ahead.select("alt", "cand", F.explode("fresh").alias("pair")).select("alt", "cand", "pair", parts[0].alias("w1"), parts[1].alias("w2"))
    counted = pairs.join(merged(model.bigrams), ["w1", "w2"]).groupBy("alt", "cand").agg(F.map_from_entries(F.collect_list(F.struct("pair", "cnt"))).alias("fresh_counts"))
    both = ahead.join(merged(counted), ["alt", "cand"], "left")
    own = lambda of: F.map_from_entries(F.array_distinct(of))
    had_words = own(F.transform(had, lambda x: F.struct(x["word"], x["uni"])))
    had_pairs = own(F.transform(F.filter("w", lambda x: x["bi"].isNotNull()), lambda x: F.struct(F.concat_ws(" ", x["word"], F.element_at("w", (x["pos"] + 2).cast("int"))["word"]), x["bi"])))
    looked = both.select("alt", "cand", "t", had_words.alias("hw"), had_pairs.alias("hp"), "words", F.coalesce("fresh_counts", none).alias("fp"), _pair_keys(F.col("t")).alias("keys"))
    pair = lambda i: F.try_element_at("keys", (i + 1).cast("int"))
    count = lambda x, i: F.struct(i.alias("pos"), x.alias("word"), F.coalesce(F.try_element_at("hw", x), F.try_element_at("words", x)).alias("uni"), F.coalesce(F.try_element_at("hp", pair(i)), F.try_element_at("fp", pair(i))).alias("bi"))
    return looked.select("alt", "cand", F.transform("t", count).alias("w"))


def uniform_channel(cand: Column, alt: Column) -> Column:
    """ln probability of the typed text: every edit equally likely."""
    d = osa(cand, alt)
    return F.when(d == 0, F.log(F.lit(P_EQUAL))).otherwise(d * F.log(F.lit(P_EDIT)) + (F.length(cand) - d) * F.log(F.lit(1 - P_EDIT)))


def character_counts(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(letter, cnt) and (gram, cnt) of the corrected texts, led by `~`."""
    led = pairs.select(F.concat(F.lit("~"), "corrected").alias("t"))
    letters = led.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.substring("t", i, F.lit(1)))).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("cnt"))
    grams = led.select(F.explode(char_bigrams(F.col("t"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("cnt"))
    return letters, grams


def edit_counts(pairs: DataFrame) -> DataFrame:
    """(op, a, b, cnt) over the edits of all pairs."""
    edits = pairs.select(edit_list("corrected", "query").alias("e")).select(F.explode("e").alias("e"))
    return edits.groupBy("e.op", "e.a", "e.b").agg(F.count(F.lit(1)).alias("cnt"))


def _with_base(ops: DataFrame, letters: DataFrame, grams: DataFrame) -> DataFrame:
    """Adds what an edit's probability is divided by: the typed letter's count for substitutions, that of the letter
    before for insertions, that of the two letters for deletions and swaps; each smoothed by the alphabet."""
    one = ops.join(letters.select(F.col("letter").alias("b_"), F.col("cnt").alias("n_b")), F.col("b") == F.col("b_"), "left").join(letters.select(F.col("letter").alias("a_"), F.col("cnt").alias("n_a")), F.col("a") == F.col("a_"), "left")
    both = one.join(grams.select("gram", F.col("cnt").alias("n_ab")), F.concat("a", "b") == F.col("gram"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = len(ALPHABET)
    base = F.when(F.col("op") == 0, zero("n_b") + n).when(F.col("op") == 1, zero("n_a") + n).otherwise(zero("n_ab") + n * n)
    return both.select(*ops.columns, base.alias("base"))


def channel(pairs: DataFrame) -> DataFrame:
    """(op, a, b, p): probabilities of the edits seen, each counted once more."""
    letters, grams = character_counts(pairs)
    return _with_base(edit_counts(pairs), letters, grams).select("op", "a", "b", ((F.col("cnt") + 1) / F.col("base")).alias("p"))


def learned_channel(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(alt, cand, channel): ln probability of the typed text under the learned edits; unseen ones by the smoothing alone."""
    letters, grams = character_counts(pairs)
    edits = materialise(rows.select("alt", "cand", edit_list("cand", "alt").alias("e")), "edits")
    long = edits.select("alt", "cand", F.explode("e").alias("e")).select("alt", "cand", "e.op", "e.a", "e.b")
    kinds = _with_base(long.select("op", "a", "b").distinct(), letters, grams).join(channel(pairs), ["op", "a", "b"], "left")
    priced = kinds.select("op", "a", "b", F.log(F.coalesce("p", 1 / F.col("base"))).alias("ln_p"))
    # Different edits are few, as many as pairs of letters; Spark would take the exploded ones for the smaller side.
    summed = long.join(F.broadcast(priced), ["op", "a", "b"]).groupBy("alt", "cand").agg(F.sum("ln_p").alias("channel"))
    same = edits.where("size(e) = 0").select("alt", "cand", F.log(F.lit(P_EQUAL)).alias("channel"))
    return summed.unionByName(same)


def model_scores(rows: DataFrame, uni: DataFrame, bi: DataFrame) -> DataFrame:
    """(cand, model): ln probability of the texts whose words are all known."""
    seen = looked_up(rows.select("cand"), "cand", uni, bi).crossJoin(F.broadcast(total(uni)))
    return seen.where(F.forall("w", lambda x: x["uni"].isNotNull())).select("cand", log_probability(F.col("w"), F.col("total")).alias("model"))


@dataclass
class Model:
    """Counts of words (term, cnt) and of neighbouring words (w1, w2, cnt)."""

    unigrams: DataFrame
    bigrams: DataFrame


def build(line_rows: DataFrame) -> Model:
    """The model of all lines, written to the shared folder."""
    return Model(materialise(unigrams(line_rows), "unigrams"), materialise(bigrams(line_rows), "bigrams"))


def write(path: str, model: Model) -> None:
    write_model(path, unigrams=model.unigrams, bigrams=model.bigrams)


def read(spark: SparkSession, path: str) -> Model:
    return Model(**read_model(spark, path, "unigrams", "bigrams"))


def scored_candidates(alts: DataFrame, model: Model, pairs: DataFrame | None = None) -> DataFrame:
    """(alt, cand, model, channel): the known candidates of texts with their ln probabilities. The channel is learned
    from pairs, or uniform without them."""
    seen = materialise(suspicions(looked_up(alts, "alt", model.unigrams, model.bigrams)), "suspicions")
    known = known_candidates(seen, model).crossJoin(F.broadcast(total(model.unigrams)))
    scored = materialise(known.select("alt", "cand", log_probability(F.col("w"), F.col("total")).alias("model")), "scored")
    if pairs is None:
        return scored.withColumn("channel", uniform_channel(F.col("cand"), F.col("alt")))
    return scored.join(merged(learned_channel(scored, pairs)), ["alt", "cand"])


def correct(queries: DataFrame, model: Model | DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(query, corrected): the candidate with the highest sum of model and channel, the first by text among equals; the
    query where there is none. The model is a stored one, or built from lines."""
    model = model if isinstance(model, Model) else build(model)
    asked = queries.select("query").where("query IS NOT NULL AND trim(query) <> ''").distinct()
    splits = materialise(best_splits(asked, model.unigrams, model.bigrams), "splits")
    scored = scored_candidates(splits.select("alt").distinct(), model, pairs)
    rated = F.struct((-F.round(F.col("model") + F.col("channel"), 9)).alias("score"), "cand")
    best = scored.groupBy("alt").agg(F.min(rated)["cand"].alias("best"))
    chosen = splits.join(merged(best), "alt", "left").select("query", "best")
    return queries.select("query").distinct().join(merged(chosen), "query", "left").select("query", F.coalesce(F.nullif("best", F.lit("")), "query").alias("corrected"))


def accuracy(corrected: DataFrame, gold: DataFrame) -> DataFrame:
    """One row over (query, corrected) and gold (query, gold): share that is right, other word counts, empty results."""
    both = corrected.join(merged(gold), "query")
    words = lambda c: F.size(tokens(F.col(c)))
    return both.agg(F.avg((F.col("corrected") == F.col("gold")).cast("int")).alias("share_right"), F.count_if(words("corrected") != words("gold")).alias("other_word_count"), F.count_if(F.col("corrected") == "").alias("n_empty"))


def word_distance(a: Column, b: Column, df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, distance): distances of the words of two texts, one by one, added up."""
    long = df.select(*keys, F.explode(F.arrays_zip(tokens(a).alias("x"), tokens(b).alias("y"))).alias("t"))
    near = long.select(*keys, osa(F.coalesce("t.x", F.lit("")), F.coalesce("t.y", F.lit(""))).alias("d"))
    return near.groupBy(*keys).agg(F.sum("d").alias("distance"))
