"""Subject areas of documents, by propagating labels over the graph of similar documents.

Two documents are linked when they share terms (words, or whole sentences without their numbers), the stronger the
more these tell subjects apart. Documents of one subject are all linked to each other, so the links are kept factored
as a table of (document, sentence, term) and never listed as pairs. One step is three joins: labels of sentences go to
their terms (a sum by term), what the terms tell goes back to the sentences (a sum by sentence), and the sentences of a
document share what they tell (a sum by document). Steps go on until the documents' labels settle.

Terms are verified before labels pass: enough documents must hold them, and the labels that reach them must be
concentrated on few subjects. Seeds are the hand labels, trusted where the document's own sentences bear them out. Seeds
of which every label is trusted are clamped: their sentences only ever carry their own labels. Where a label is not borne
out, null or unknown, the true one in its place is missing, so the others do not tell all that the document is on, and
its sentences stay free. As sentences are labelled one by one, a document keeps as many subjects as its sentences have.

The table of links is bucketed by document, so sums by sentence and document are not shuffled. Terms go to the links by
broadcast where their table is small, else by a join salted by document, so a term in most documents is spread too.
"""

from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import slices
from lexmill.session import bucketed, materialise, merged, release, written

#: More subjects are an error: each is a column.
MAX_SUBJECTS = 100
MIN_DOCS = 5
#: Sentences whose labels must have reached a word before it counts as telling nothing.
REACHED = 20.0
#: Numbers in a table of terms, and labelled documents, that are broadcast; larger tables are joined, with the same result.
MAX_CELLS, MAX_SEEDS, SALTS = 4_000_000, 50_000, 32
#: Labels have settled when documents change by this much of their labels on average; and no more than so many steps.
TOLERANCE, MAX_STEPS = 0.01, 20
SMOOTHING, SENTENCE_DOCS, TRUST = 2.0, 3.0, 0.1
#: A document sends the labels of at most so many sentences in all; longer ones send each with less weight.
DOCUMENT_MASS = 20
#: In units of ln of the number of subjects, the most that a term can tell.
WORD_GAIN, SENTENCE_LIFT, LEAST_SCORE, SAFE_SCORE = 0.13, 0.4, 0.43, 1.09
SHARE = 0.25
#: Links in a bucket, about.
BUCKET = 2_000_000

SENTENCES = "row bigint, doc_id bigint, sid int, mass double, sentence bigint, first boolean, fresh int, words array<bigint>"
RESULT = "doc_id bigint, subject string, n_sentences bigint, n_all bigint"
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def _hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return known[coded.indices.to_numpy()]


def _first(value: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are the first of their kind in their document."""
    order = np.lexsort((np.arange(len(value)), value, of))
    fresh = np.ones(len(value), bool)
    fresh[order[1:]] = (value[order[1:]] != value[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
    return fresh


def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The sentences and lines of whole texts (row, doc_id, text): a hash of the sentence without digits and marks, and
    those of its words, the `fresh` words that the document had not before first. Words are even, sentences odd."""
    text = pc.fill_null(batch.column(2), "").cast(pa.large_string())
    text = pc.replace_substring_regex(text, r"https?://\S+|</?[A-Za-z][^<>]*>", "\n")
    lists = pc.split_pattern_regex(pc.utf8_lower(text), r"[.!?]+\s+|[\r\n]+")
    sentences, doc_of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    # Notes strung together by semicolons or bars are lines of their own; a sentence may hold one.
    for mark in (";", "|"):
        strung = pc.greater_equal(pc.count_substring(sentences, mark), 2)
        lists = pc.split_pattern(pc.if_else(strung, pc.replace_substring(sentences, mark, "\n"), sentences), "\n")
        sentences, doc_of = lists.flatten(), doc_of[pc.list_parent_indices(lists).to_numpy()]
    clean = pc.utf8_trim(pc.replace_substring_regex(sentences, r"[^\pL]+", " "), " ")
    full = pc.not_equal(clean, "")
    clean, doc_of = clean.filter(full), doc_of[full.to_numpy(zero_copy_only=False)]
    n = len(clean)
    words = pc.split_pattern(clean, " ")
    term = _hashes(words.flatten()) if n else np.array([], np.uint64)
    starts = words.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    sizes = np.diff(starts)
    of = np.repeat(np.arange(n), sizes)
    place = np.arange(len(term)) - np.repeat(starts[:-1], sizes)
    sent = (np.add.reduceat(term * _POWERS[place % len(_POWERS)], starts[:-1]) | np.uint64(1)) if n else term
    term = term & ~np.uint64(1)
    fresh = _first(term, doc_of[of] if n else of)
    order = np.lexsort((place, ~fresh, of))
    per_doc = np.bincount(doc_of, minlength=batch.num_rows)
    sid = np.arange(n) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    mass = 1 / np.maximum(per_doc[doc_of] / DOCUMENT_MASS, 1)
    at = pa.array(doc_of, pa.int64())
    values = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(term[order].view(np.int64)))
    counted = np.bincount(of[fresh], minlength=n).astype(np.int32)
    columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(sid.astype(np.int32)), pa.array(mass), pa.array(sent.view(np.int64)), pa.array(_first(sent, doc_of)), pa.array(counted), values]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SENTENCES.split(", ")])


def _plus(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _settle(k: int, unit: float):
    """What the sentences of a document make of their scores together; rows come by document."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows in batches that end with a document."""
        kept: list[pa.RecordBatch] = []
        for b in batches:
            rows = b.column(0).to_numpy()
            last = np.flatnonzero(rows != rows[-1])
            cut_at = last[-1] + 1 if len(last) else 0
            if cut_at or (kept and kept[-1].column(0)[-1].as_py() != rows[0]):
                yield pa.Table.from_batches([*kept, b.slice(0, cut_at)]).combine_chunks().to_batches()[0]
                kept = []
            kept.append(b.slice(cut_at))
        if kept:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    def run(batches):
        for b in whole(x for x in batches if x.num_rows):
            table = lambda at, b=b: np.stack([b.column(at + j).to_numpy(zero_copy_only=False).astype(float) for j in range(k)], 1)
            x, lift, seen = table(6), table(6 + k), b.column(4).to_numpy(zero_copy_only=False).astype(float)
            top, at = x.max(1), x.argmax(1)
            # A recurrent sentence must be of documents on that subject; where too few are known, it must tell by itself.
            known = lift[np.arange(len(x)), at] >= exp(SENTENCE_LIFT * unit)
            on = (top >= LEAST_SCORE * unit) & (np.isnan(seen) | np.where(seen >= SENTENCE_DOCS, known, top >= SAFE_SCORE * unit))
            if not on.any():
                continue
            x, rows = x[on], b.column(0).to_numpy()[on]
            starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            of = np.cumsum(np.append(False, rows[1:] != rows[:-1]))
            spread = np.add.reduceat(_softmax(x), starts)
            spread /= spread.sum(1, keepdims=True)
            given = np.nan_to_num(table(6 + 2 * k)[on][starts])
            complete = pc.fill_null(b.column(5), False).to_numpy(zero_copy_only=False)[on][starts]
            clamp = complete & ((given == 0) | (spread >= TRUST)).all(1)
            z = x + (np.log(spread + 0.02) - 30.0 * (clamp[:, None] & (given == 0)))[of]
            p = _softmax(z).round(4).astype(np.float32)
            kept = pa.array(on)
            yield pa.RecordBatch.from_arrays([*[b.column(j).filter(kept) for j in range(4)], pa.array(z.argmax(1).astype(np.int32)), *[pa.array(p[:, j]) for j in range(k)]], ["row", "doc_id", "mass", "place", "best", *[f"p{j}" for j in range(k)]])

    return run


def _grouped(df: DataFrame, keys: list[str], *sums: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(x) for x in sums])


class _Graph:
    """Links (row, place, node) of documents and their sentences to verified terms; documents (row, doc_id, mass) with
    the labels of seeds. A place is the number of a sentence in its document and how many words it has."""

    def __init__(self, documents: DataFrame, labels: DataFrame, subjects: list[str], max_seeds: int, max_cells: int):
        self.subjects, self.k, self.max_cells = subjects, len(subjects), max_cells
        self.unit = log(max(self.k, 2))
        rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        raw = materialise(rows.mapInArrow(lambda it: map(cut, slices(it, "text")), SENTENCES), "sentences")
        each = raw.selectExpr("mass", "first", "fresh", "size(words) AS n", "posexplode(concat(words, array(sentence))) AS (at, node)")
        counted = _grouped(each, ["node"], "count_if(at < fresh OR at = n AND first) AS docs", "sum(mass) AS mass")
        self.nodes = materialise(counted.where(f"docs >= {MIN_DOCS}"), "nodes")
        name = F.lower(F.trim(F.col("subject")))
        given = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), name.alias("s")).where("doc_id IS NOT NULL").withColumn("valid", F.coalesce(F.col("s").isin(subjects), F.lit(False)))
        flags = [F.max(F.when(F.col("s") == s, 1.0).otherwise(0.0)).alias(f"g{j}") for j, s in enumerate(subjects)]
        seeds = given.groupBy("doc_id").agg(*flags, F.every("valid").alias("complete"), F.some("valid").alias("any")).where("any").drop("any")
        if seeds.limit(max_seeds + 1).count() <= max_seeds:
            seeds = F.broadcast(seeds)
        else:
            seeds = merged(seeds)
        # Each sentence of a seed sends what the seed is labelled.
        g = self.columns("g")
        sent = raw.join(seeds, "doc_id").selectExpr(*[f"{c} / {_plus(g)} * mass AS s{j}" for j, c in enumerate(g)], "explode(concat(words, array(sentence))) AS node")
        self.first = self.summed(sent, False)
        self.first_base = self.base(self.first, 0)
        # Words that many labels reach, of all subjects alike, tell nothing and have no links.
        told = self.first.selectExpr("node", f"{_plus(self.columns('s', 1))} AS reached", *self.shares(self.first_base))
        self.nodes = materialise(self.nodes.join(merged(told.where(f"node & 1 = 0 AND reached >= {REACHED}D AND {self.gain(self.first_base)} < {WORD_GAIN / 2 * self.unit}D")), "node", "left_anti"), "verified")
        found = self.nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("docs"), F.lit(0)).alias("links")).first()
        self.small = found["n"] * (self.k + 3) <= max_cells
        self.n = max(raw.sparkSession.sparkContext.defaultParallelism, -(-found["links"] // BUCKET))
        links = raw.selectExpr("row", "shiftleft(bigint(sid), 32) + size(words) AS place", "explode(concat(words, array(sentence))) AS node")
        self.links = bucketed(self.to_links(links, self.nodes.select("node")), "row", self.n, "links")
        self.words = raw.agg(F.expr("coalesce(sum(mass * size(words)), 0D) AS m")).first()["m"]
        self.docs = bucketed(raw.where("sid = 0").select("row", "doc_id", "mass").join(seeds, "doc_id", "left"), "row", self.n, "docs")

    def columns(self, letter: str, more: int = 0) -> list[str]:
        return [f"{letter}{j}" for j in range(self.k + more)]

    def to_links(self, links: DataFrame, terms: DataFrame) -> DataFrame:
        """The links to these terms, with what the terms' table has."""
        if self.small:
            return links.join(F.broadcast(terms), "node")
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
        spread = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return links.withColumn("salt", salt).join(merged(spread), ["node", "salt"]).drop("salt")

    def summed(self, sent: DataFrame, of_all: bool) -> DataFrame:
        """(node, mass, s0 ... sk): the labels sent to each term; the last is what came from sentences on no subject, if all sent."""
        s = self.columns("s")
        every = self.nodes.join(_grouped(sent, ["node"], *[f"sum({c}) AS {c}" for c in s]), "node", "left").selectExpr("node", "mass", *[f"coalesce({c}, 0D) AS {c}" for c in s])
        return materialise(every.selectExpr("*", f"{f'greatest(mass - {_plus(s)}, 0D)' if of_all else '0D'} AS s{self.k}"), "sums")

    def from_all(self, told: DataFrame) -> DataFrame:
        """Sums of the labels of all sentences: words get those of their sentences, recurrent sentences those of their documents."""
        to_words = self.links.where("node & 1 = 0").join(told.drop("doc_id", "best").hint("shuffle_hash"), ["row", "place"])
        to_sentences = self.links.where("node & 1 = 1").join(self.spread(told).hint("shuffle_hash"), "row")
        sent = [df.selectExpr("node", *[f"{x}{j} * mass AS s{j}" for j in range(self.k)]) for df, x in ((to_words, "p"), (to_sentences, "q"))]
        return self.summed(sent[0].unionByName(sent[1]), True)

    def spread(self, told: DataFrame) -> DataFrame:
        """(row, mass, q0 ...): the share of each subject in a document's sentences that are on any."""
        q = self.columns("q")
        return _grouped(told, ["row", "mass"], *[f"sum(p{j}) AS {c}" for j, c in enumerate(q)]).selectExpr("row", "mass", *[f"{c} / {_plus(q)} AS {c}" for c in q])

    def base(self, sums: DataFrame, odd: int) -> np.ndarray:
        """The share of each subject, and of none, in the sums over all words, or all sentences."""
        got = sums.where(f"node & 1 = {odd}").agg(*[F.expr(f"coalesce(sum({c}), 0D) AS {c}") for c in self.columns("s", 1)]).first()
        return self.of_one(np.array(list(got), float))

    def of_one(self, total: np.ndarray) -> np.ndarray:
        return (total + 1e-6) / (total.sum() + 1e-6 * len(total))

    def base_of_words(self, told: DataFrame) -> np.ndarray:
        """The same over the words of all sentences, linked or not."""
        got = told.agg(*[F.expr(f"coalesce(sum({c} * mass * (place & 4294967295)), 0D) AS {c}") for c in self.columns("p")]).first()
        on = np.array(list(got), float)
        return self.of_one(np.append(on, max(self.words - on.sum(), 0.0)))

    def shares(self, base: np.ndarray) -> list[str]:
        """What a term's sums say of each subject, smoothed towards the base."""
        s = self.columns("s", 1)
        return [f"({c} + {SMOOTHING * x!r}D) / ({_plus(s)} + {SMOOTHING}D) AS p{j}" for j, (c, x) in enumerate(zip(s[:-1], base.tolist()))]

    def gain(self, base: np.ndarray) -> str:
        return _plus([f"p{j} * ln((p{j} + 1e-9D) / {x + 1e-9!r}D)" for j, x in enumerate(base[: self.k].tolist())])

    def telling(self, sums: DataFrame, words_base: np.ndarray) -> DataFrame:
        """(node, seen, w0 ...): for words that tell subjects apart a log ratio by subject, for recurrent sentences how much
        more often than others their documents are on a subject (where they are not, it is a notice that names it)."""
        other = self.base(sums, 1)
        words = sums.where("node & 1 = 0").selectExpr("node", *self.shares(words_base)).where(f"{self.gain(words_base)} >= {WORD_GAIN * self.unit}D")
        words = words.selectExpr("node", "0D AS seen", *[f"ln((p{j} + 1e-3D) / {x + 1e-3!r}D) AS w{j}" for j, x in enumerate(words_base[: self.k].tolist())])
        sentences = sums.where("node & 1 = 1").selectExpr("node", f"{_plus(self.columns('s', 1))} AS seen", *self.shares(other))
        return words.unionByName(sentences.selectExpr("node", "seen", *[f"p{j} / {max(x, 1e-9)!r}D AS w{j}" for j, x in enumerate(other[: self.k].tolist())]))

    def labelled(self, terms: DataFrame) -> DataFrame:
        """(row, doc_id, mass, place, best, p0 ...): the sentences on any subject with the probability of each."""
        x, lift, g, p = (self.columns(c) for c in "xlgp")
        scores = [f"sum(CASE WHEN node & 1 = 0 THEN w{j} ELSE 0D END) AS {c}" for j, c in enumerate(x)]
        lifts = [f"max(CASE WHEN node & 1 = 1 THEN w{j} END) AS {c}" for j, c in enumerate(lift)]
        # seen is null where no recurrent sentence is there.
        by = _grouped(self.to_links(self.links, terms), ["row", "place"], *scores, *lifts, "max(CASE WHEN node & 1 = 1 THEN seen END) AS seen")
        on = by.where(" OR ".join(f"{c} >= {LEAST_SCORE * self.unit}D" for c in x)).join(self.docs.hint("shuffle_hash"), "row")
        keys = ["row", "doc_id", "mass", "place"]
        settled = on.select(*keys, "seen", "complete", *x, *lift, *g).sortWithinPartitions("row").mapInArrow(_settle(self.k, self.unit), "row bigint, doc_id bigint, mass double, place bigint, best int, " + ", ".join(f"{c} float" for c in p))
        return bucketed(settled, "row", self.n, "told")

    def change(self, before: DataFrame, after: DataFrame) -> float:
        """Half the sum of differences of a document's shares, on average over the documents with any."""
        q = self.columns("q")
        b = self.spread(after).selectExpr("row", *[f"{c} AS b{c}" for c in q])
        both = self.spread(before).join(b.hint("shuffle_hash"), "row", "full_outer")
        apart = _plus([f"abs(coalesce({c}, 0D) - coalesce(b{c}, 0D))" for c in q])
        return both.agg(F.expr(f"avg({apart} / 2) AS d")).first()["d"] or 0.0


def subject_sentences(
    documents: DataFrame, labels: DataFrame, areas: DataFrame, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS, max_seeds: int = MAX_SEEDS, max_cells: int = MAX_CELLS
) -> DataFrame:
    """(doc_id, subject, n_sentences, n_all): how many of a text's n_all sentences on any subject are on each.

    Texts without such sentences, null and empty ones have no row; repeated documents are labelled each by itself.
    Labels count without outer blanks and letter case; null ones, unknown subjects and repetitions don't. Without any
    label, or subject, the result is empty; more than MAX_SUBJECTS subjects are an error. All labelled documents are
    seeds. Labels are propagated until they change by less than the tolerance; if they have not after max_steps, that is
    an error. max_seeds and max_cells bound what is broadcast, and do not change the result.
    """
    spark = documents.sparkSession
    name = F.lower(F.trim(F.col("subject")))
    subjects = sorted(r["s"] for r in areas.select(name.alias("s")).where("s IS NOT NULL AND s <> ''").distinct().limit(MAX_SUBJECTS + 1).collect())
    if len(subjects) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    if not subjects:
        return spark.createDataFrame([], RESULT)
    since = written()
    graph = _Graph(documents, labels, subjects, max_seeds, max_cells)
    told = graph.labelled(graph.telling(graph.first, graph.first_base))
    for _ in range(max_steps):
        before, told = told, graph.labelled(graph.telling(graph.from_all(told), graph.base_of_words(told)))
        if graph.change(before, told) < tolerance:
            break
    else:
        raise RuntimeError(f"labels have not settled after {max_steps} steps")
    of = F.element_at(F.array(*[F.lit(s) for s in subjects]), F.col("best") + 1).alias("subject")
    counted = told.groupBy("row", "doc_id", "best").agg(F.count(F.lit(1)).alias("n_sentences"))
    rows = counted.select("doc_id", of, "n_sentences", F.sum("n_sentences").over(Window.partitionBy("row")).alias("n_all"))
    done = materialise(rows, "subjects")
    release(spark, since, keep=1)
    return done


def subject_areas(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject): subjects of at least the share of a text's sentences that are on any subject."""
    return counted.where(F.col("n_sentences") >= share * F.col("n_all")).select("doc_id", "subject").distinct()
