"""Sizes of texts in tokens of a public tokenizer."""

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space longer than this is cut where the pattern cuts it, as the tokenizer's stack grows with the run.
LONG_RUN = 100_000


def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space of the pattern (fixed value).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_loaded: dict = {}


def count_tokens(text: str | None, vocabulary: str = VOCABULARY, long_run: int = LONG_RUN) -> int:
    """Tokens of the whole text; 0 for null and empty ones. Lone surrogates count as the replacement character.

    The pattern makes one piece of a run of white space, but for its last character where more text follows, and no
    piece goes on from text into white space. So cutting a long run off there gives the tokens of the uncut text.
    """
    if not text:
        return 0
    if vocabulary not in _loaded:
        _loaded[vocabulary] = encoding(vocabulary)
    enc = _loaded[vocabulary]
    if len(text) <= long_run:
        return len(enc.encode_ordinary(text))
    n, at = 0, 0
    for m in re.finditer(rf"[{_SPACE}]{{{long_run},}}", text):
        n += len(enc.encode_ordinary(text[at : m.start()]))
        at = m.end() if m.end() == len(text) else m.end() - 1
        n += len(enc._encode_single_piece(text[m.start() : at]))
    return n + len(enc.encode_ordinary(text[at:]))


def with_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns keep and n_tokens of the whole text; the text itself goes no further. The vocabulary is a file of
    that path on every executor; a task without it fails and names it."""
    rows = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "__text"], T.StructField("n_tokens", T.LongType())])

    def run(batches):
        for b in slices(batches, "__text"):
            sizes = [count_tokens(x, vocabulary) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, schema)
