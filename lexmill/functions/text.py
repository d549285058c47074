"""Text expressions: tokens, counts, urls; Arrow batches of texts in small pieces."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, also where inner lambdas read it for every element."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Runs of characters other than white space, case kept; no tokens for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def lm_tokens(line: Column) -> Column:
    """Split at single spaces; empty strings between spaces are tokens."""
    return F.split(line, " ", -1)


def query_terms(query: Column) -> Column:
    """Different lower-cased tokens, in order."""
    return F.array_distinct(tokens(F.lower(query)))


def substring_count(text: Column, part: Column) -> Column:
    """Occurrences of a non-empty part that do not overlap; not bound to whole words."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("bigint")


def url_length(url: Column) -> Column:
    """Parts of a url cut at //, /, ., ? and =; empty parts count."""
    return F.size(F.split(F.regexp_replace(url, "^/+|/+$", ""), r"//|/|\.|\?|=", -1))


def url_words(url: Column) -> Column:
    return tokens(F.lower(F.regexp_replace(url, r"%20|[:/.?~=\-%_&]", " ")))


def sublinear(tf: Column) -> Column:
    return F.when(tf > 0, 1 + F.log(tf)).otherwise(F.lit(0.0))


def char_bigrams(word: Column) -> Column:
    """Neighbouring pairs of characters; none for words of one character."""
    n = F.length(word)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of the text column (one row at least), as what is made of texts in
    Python takes many times their size."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for at, end in zip(starts, np.append(starts[1:], b.num_rows)):
            yield b.slice(at, end - at)
