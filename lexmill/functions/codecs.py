"""Codecs of ascending document ids: gaps, variable bytes and Elias gamma.

Encoding is a fold over the array in the JVM. Decoding has a running sum, which higher-order functions can only
express in quadratic time, so it runs over Arrow batches.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import bind


def gaps(ids: Column) -> Column:
    """The first id, then the differences."""
    return F.transform(ids, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.element_at(ids, F.greatest(i, F.lit(1)).cast("int"))))


def _vb_hex(g: Column) -> Column:
    """Big-endian groups of seven bits, the last with its high bit set."""
    n = F.greatest(F.ceil(F.length(F.bin(g)) / 7), F.lit(1)).cast("int")
    byte = lambda i: F.call_function("shiftright", g, ((i - 1) * 7).cast("int")).bitwiseAND(F.lit(127)) + F.when(i == 1, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")


def vb_encode(ids: Column) -> Column:
    return F.unhex(F.array_join(F.transform(gaps(ids), _vb_hex), ""))


def _gamma_bits(gap: Column) -> Column:
    b = F.bin(gap + 1)
    return F.concat(F.repeat(F.lit("1"), F.length(b) - 1), F.lit("0"), F.substring(b, F.lit(2), F.length(b)))


def gamma_bits(ids: Column) -> Column:
    """Codes of gap + 1: as many ones as there are bits after the first, a zero, those bits."""
    return F.array_join(F.transform(gaps(ids), _gamma_bits), "")


def pack_bits(bits: Column) -> Column:
    """Bytes of a bit string, the last filled up with ones."""

    def packed(full: Column) -> Column:
        # ASCII, so places in the string are places in its bytes.
        return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest((F.length(full) / 8).cast("int"), F.lit(1))), lambda i: F.lpad(F.conv(F.substring(full, (i - 1) * 8 + 1, F.lit(8)), 2, 16), 2, "0")), "")

    def filled(b: Column) -> Column:
        return F.rpad(b, (F.ceil(F.length(b) / 8) * 8).cast("int"), F.lit("1"))

    return bind(bind(bits, filled), lambda full: F.unhex(F.when(F.length(full) > 0, packed(full)).otherwise(F.lit(""))))


def gamma_encode(ids: Column) -> Column:
    return pack_bits(gamma_bits(ids))


def _sums(numbers: np.ndarray, of: np.ndarray, n: int) -> list[np.ndarray]:
    """Running sums of the numbers within each of n rows, to which they belong in order."""
    total = np.cumsum(numbers)
    ends = np.cumsum(np.bincount(of, minlength=n))
    before = np.append(0, total)[np.append(0, ends[:-1])]
    return np.split(total - np.repeat(before, np.diff(np.append(0, ends))), ends[:-1])


def vb_numbers(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all codes and the code each is in, from one buffer. What follows a code's last whole number is ignored."""
    b = np.frombuffer(b"".join(codes), np.uint8).astype(np.int64)
    begins = np.cumsum([0, *[len(c) for c in codes]])
    ends = np.flatnonzero(b & 128)
    if not len(ends):
        return np.array([], np.int64), np.array([], np.int64)
    of = np.searchsorted(begins, ends, side="right") - 1
    starts = np.maximum(np.append(0, ends[:-1] + 1), begins[of])
    size = ends - starts + 1
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.add.reduceat((b[at] & 127) << (7 * (np.repeat(ends, size) - at)), np.cumsum(size) - size), of


def gamma_numbers(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for gamma codes; filling at the end is an unfinished code and ignored.

    Where a code begins depends on the one before, so the end of the code that would begin at every bit is found
    first, and the codes reached from the beginnings are marked by following twice as many ends at once each time.
    """
    bits = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8))
    n = len(bits)
    begins = 8 * np.cumsum([0, *[len(c) for c in codes]])
    if not n:
        return np.array([], np.int64), np.array([], np.int64)
    zero = np.minimum.accumulate(np.where(bits == 0, np.arange(n), n)[::-1])[::-1]
    ends_of = np.repeat(begins[1:], np.diff(begins))
    follows = 2 * zero - np.arange(n) + 1
    whole = (zero < n) & (follows <= ends_of)
    jump = np.append(np.where(whole & (follows < ends_of), follows, n), n)  # n stands for the end
    reached = np.zeros(n + 1, bool)
    reached[begins[:-1][np.diff(begins) > 0]] = True
    while True:
        more = reached.copy()
        more[jump[np.flatnonzero(reached)]] = True
        if (more == reached).all():
            break
        reached, jump = more, jump[jump]
    at = np.flatnonzero(reached[:n] & whole)
    size = zero[at] - at
    first = np.cumsum(size) - size
    place = np.repeat(zero[at] + 1 - first, size) + np.arange(size.sum())
    low = np.bincount(np.repeat(np.arange(len(at)), size), weights=bits[place] * 2.0 ** (np.repeat(size, size) - 1 - (np.arange(size.sum()) - np.repeat(first, size))), minlength=len(at)).astype(np.int64) if size.sum() else np.zeros(len(at), np.int64)
    return (np.int64(1) << size) + low - 1, np.searchsorted(begins, at, side="right") - 1


def _decoded(codes: pd.Series, numbers, most: int = 1 << 18) -> pd.Series:
    """Ids of all codes, several rows of about `most` bytes together at a time; null for null."""
    ok = np.flatnonzero(codes.notna().to_numpy())
    held = [codes.iloc[i] for i in ok]
    part = np.cumsum([len(c) for c in held], dtype=np.int64) // most if held else np.array([], np.int64)
    out: list = [None] * len(codes)
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        values, of = numbers([held[r] for r in rows])
        for r, ids in zip(rows, _sums(values, of, len(rows))):
            out[ok[r]] = ids
    return pd.Series(out, index=codes.index)


@F.pandas_udf(T.ArrayType(T.LongType()))
def vb_decode(codes: pd.Series) -> pd.Series:
    return _decoded(codes, vb_numbers)


@F.pandas_udf(T.ArrayType(T.LongType()))
def gamma_decode(codes: pd.Series) -> pd.Series:
    return _decoded(codes, gamma_numbers)
