"""Rows that fail to parse, parted from the sound ones with the reason."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["query", "url", "title", "body_hits", "body_length", "pagerank", "anchor_text", "stanford_anchor_count"]
REASONS = ["offset", "quoting", "columns", "body_hits", "body_length", "pagerank", "stanford_anchor_count"]
MAX_PAGERANK, MAX_COUNT = 10, 2147483647
_CUT, _ESC = "\x01", "\x02"


@dataclass
class Load:
    """valid: typed records with their offset; rejected: (offset, reason), one row per row and reason."""

    valid: DataFrame
    rejected: DataFrame


def _segments(line: Column) -> Column:
    """Pieces between double quotes: those at odd places are inside quotes. The two marks used for cutting are escaped first."""
    safe = F.replace(F.replace(line, F.lit(_ESC), F.lit(_ESC + "b")), F.lit(_CUT), F.lit(_ESC + "a"))
    return F.split(safe, '"', -1)


def _quoting_sound(s: Column) -> Column:
    """Quotes pair up, open only at the start of a field and close only at its end; an empty piece outside is a doubled quote."""
    n = F.size(s)

    def outside(x: Column, i: Column) -> Column:
        starts = (i == 0) | x.startswith(",")
        ends = (i == n - 1) | x.endswith(",")
        return (x == "") | (starts & ends)

    return (n % 2 == 1) & ~F.exists(F.transform(s, lambda x, i: (i % 2 == 0) & ~outside(x, i)), lambda bad: bad)


def _fields(s: Column) -> Column:
    """Field values of a line whose quoting is sound."""
    n = F.size(s)

    def piece(x: Column, i: Column) -> Column:
        doubled = (x == "") & (i > 0) & (i < n - 1)
        return F.when(i % 2 == 1, x).when(doubled, F.lit('"')).otherwise(F.replace(x, F.lit(","), F.lit(_CUT)))

    parts = F.split(F.array_join(F.transform(s, piece), ""), _CUT, -1)
    return F.transform(parts, lambda x: F.replace(F.replace(x, F.lit(_ESC + "a"), F.lit(_CUT)), F.lit(_ESC + "b"), F.lit(_ESC)))


def _digits(x: Column) -> Column:
    """ASCII digits without leading zeros, null for anything else."""
    return F.when(x.rlike(r"\A[0-9]+\z"), F.regexp_replace(x, "^0+(?=[0-9])", ""))


def _number(x: Column) -> Column:
    """Digits as a bigint, null for anything else and beyond its range."""
    return _digits(x).try_cast("bigint")


def _size_key(x: Column) -> Column:
    """Digits of any length as text that sorts like the number."""
    d = _digits(x)
    return F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), d)


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, "^ +| +$", "")


def _entries(hits: Column) -> Column:
    """Entries of body_hits as arrays: the term, then its numbers as text."""
    return F.transform(F.split(hits, ";", -1), lambda e: F.split(_trim(e), " +", -1))


def _hits_sound(hits: Column, length: Column) -> Column:
    """Entries of a term and strictly rising numbers up to the length; numbers are compared as text, so none is too long."""

    def entry(e: Column) -> Column:
        numbers = F.transform(F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0))), _size_key)
        rising = F.aggregate(
            numbers,
            F.struct(F.lit("").alias("last"), F.lit(True).alias("ok")),
            lambda a, x: F.struct(F.coalesce(x, F.lit("")).alias("last"), (a["ok"] & F.coalesce(x > a["last"], F.lit(False))).alias("ok")),
        )
        return (F.size(e) >= 2) & (F.element_at(e, 1) != "") & rising["ok"] & F.coalesce(rising["last"] <= _size_key(length), F.lit(False))

    return (hits == "") | F.forall(_entries(hits), entry)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column computed once a row: neither projections nor filters are merged across a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _parsed(raw: DataFrame) -> DataFrame:
    """Adds the field array (null where the quoting is wrong) and a flag for each check."""
    f = lambda name: F.col("__f")[FIELDS.index(name)]
    eight = F.coalesce(F.size("__f") == len(FIELDS), F.lit(False))
    count, rank = _number(f("stanford_anchor_count")), _number(f("pagerank"))
    count_sound = F.when(f("anchor_text") == "", f("stanford_anchor_count") == "").otherwise(F.coalesce(count.between(1, MAX_COUNT), F.lit(False)))
    cut = _once(raw, "__s", _segments(F.coalesce("__line", F.lit(""))))
    fields = F.when(_quoting_sound(F.col("__s")), F.transform(_fields(F.col("__s")), _trim))
    checks = F.struct(
        F.col("__f").isNotNull().alias("q"),
        eight.alias("eight"),
        F.when(eight, _hits_sound(f("body_hits"), f("body_length"))).alias("hits"),
        F.when(eight, _number(f("body_length")).isNotNull()).alias("length"),
        F.when(eight, F.coalesce(rank.between(0, MAX_PAGERANK), F.lit(False))).alias("rank"),
        F.when(eight, count_sound).alias("count"),
    )
    return _once(_once(cut, "__f", fields).drop("__s"), "__ok", checks)


def strict_load(raw: DataFrame, offset: str = "line_id", line: str = "line_text") -> Load:
    """Loads only conforming records, subtracts their offsets from the raw ones and diagnoses what is left.

    Only `offset` and `line` are read, so further columns may have any name. A null line is an empty line (reason
    `columns`); a row without offset can't be told apart from others and gets the reason `offset` beside its own
    reasons; rows that repeat offset and line come out once per delivery in `valid`, and once per reason in
    `rejected`. Rows with one offset but different lines are judged each by itself. A body_length that is not a number
    up to 2^63 - 1 could not be loaded and has the reason `body_length`; hits are compared with it exactly, whatever
    their digits. So what `valid` holds is what the checks let through, and no value can abort a load. An empty table
    gives two empty tables. Lines of any length are read whole; nothing recurses over them.
    """
    rows = raw.select(F.col(offset).alias("__id"), F.col(line).alias("__line"))
    keyed = rows.withColumn("__print", F.xxhash64(F.coalesce("__line", F.lit(""))))
    f = lambda name: F.col("__f")[FIELDS.index(name)]
    pairs = F.filter(_entries(f("body_hits")), lambda e: F.size(e) >= 2)
    loaded = _parsed(keyed).where("__id IS NOT NULL AND __ok.q AND __ok.eight AND __ok.hits AND __ok.length AND __ok.rank AND __ok.count")
    valid = loaded.select(
        F.col("__id").alias(offset),
        *[f(c).alias(c) for c in ("query", "url", "title")],
        F.transform(pairs, lambda e: F.struct(e[0].alias("term"), F.transform(F.slice(e, 2, F.size(e) - 1), _number).alias("positions"))).alias("body_hits"),
        _number(f("body_length")).alias("body_length"),
        _number(f("pagerank")).cast("int").alias("pagerank"),
        F.nullif(f("anchor_text"), F.lit("")).alias("anchor_text"),
        _number(f("stanford_anchor_count")).cast("int").alias("stanford_anchor_count"),
    )
    # Offsets alone are shuffled to find what was not loaded; lines follow only for the remainder.
    left = keyed.select("__id", "__print").join(loaded.select("__id", "__print"), ["__id", "__print"], "left_anti").distinct()
    same = F.col("k.__id").eqNullSafe(F.col("b.__id")) & (F.col("k.__print") == F.col("b.__print"))
    remainder = _parsed(keyed.alias("k").join(left.alias("b"), same, "left_semi"))
    reasons = F.array(
        F.when(F.col("__id").isNull(), "offset"),
        F.when(~F.col("__ok.q"), "quoting"),
        F.when(F.col("__ok.q") & ~F.col("__ok.eight"), "columns"),
        F.when(~F.col("__ok.hits"), "body_hits"),
        F.when(~F.col("__ok.length"), "body_length"),
        F.when(~F.col("__ok.rank"), "pagerank"),
        F.when(~F.col("__ok.count"), "stanford_anchor_count"),
    )
    rejected = remainder.select(F.col("__id").alias(offset), F.explode(F.array_compact(reasons)).alias("reason")).distinct()
    return Load(valid, rejected)
