"""Edit distance with swaps of neighbours (optimal string alignment), its edits, and one-edit neighbours.

The distance tables of a whole Arrow batch of pairs are filled together, one cell of all pairs at a time.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUB, INS, DEL, SWAP = 0, 1, 2, 3
CELLS = 4_000_000
EDITS = T.ArrayType(T.StructType([T.StructField("op", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(int(sizes.max(initial=0)), 1)), np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    return out, sizes


def tables(first: list[str], second: list[str]) -> np.ndarray:
    """Distance tables [i, j, pair] of all prefixes."""
    a, _ = _codes(first)
    b, _ = _codes(second)
    n, m = a.shape[1], b.shape[1]
    d = np.zeros((n + 1, m + 1, len(first)), np.int32)
    d[:, 0, :] = np.arange(n + 1)[:, None]
    d[0, :, :] = np.arange(m + 1)[:, None]
    for i in range(1, n + 1):
        x = a[:, i - 1]
        for j in range(1, m + 1):
            k = (x != b[:, j - 1]).astype(np.int32)
            best = np.minimum(d[i - 1, j - 1] + k, np.minimum(d[i - 1, j], d[i, j - 1]) + 1)
            if i > 1 and j > 1:
                swapped = (x == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(swapped, np.minimum(best, d[i - 2, j - 2] + k), best)
            d[i, j] = best
    return d


def _chunks(first: list[str], second: list[str]):
    """Pairs of like length together, so that no table is filled for lengths it has not."""
    order = sorted(range(len(first)), key=lambda i: (len(first[i]), len(second[i])))
    at = 0
    while at < len(order):
        end = at + 1
        n, m = len(first[order[at]]) + 9, len(second[order[at]])
        while end < len(order):
            m2 = max(m, len(second[order[end]]))
            if len(first[order[end]]) > n or (end - at + 1) * (n + 1) * (m2 + 1) > CELLS:
                break
            m, end = m2, end + 1
        yield order[at:end]
        at = end


def distances(first: list[str], second: list[str]) -> np.ndarray:
    out = np.zeros(len(first), np.int32)
    for ids in _chunks(first, second):
        a, b = [first[i] for i in ids], [second[i] for i in ids]
        d = tables(a, b)
        out[ids] = d[[len(x) for x in a], [len(x) for x in b], range(len(ids))]
    return out


def edits_of(table: np.ndarray, first: list[str], second: list[str]) -> list[list[dict]]:
    """The edits that turn each first text into its second, last first; where several fit: substitution, insertion,
    deletion, swap. All pairs of a table walk back together, a step at a time."""
    a, n = _codes(first)
    b, m = _codes(second)
    i, j, k = n.copy(), m.copy(), np.arange(len(first))
    out: list[list[dict]] = [[] for _ in first]
    while len(k := k[(i[k] > 0) & (j[k] > 0)]):
        x, y = i[k], j[k]
        here, cross, same = table[x, y, k], table[x - 1, y - 1, k], a[k, x - 1] == b[k, y - 1]
        kept = same & (here == cross)
        sub = ~same & (here == cross + 1)
        ins = ~kept & ~sub & (here == table[x, y - 1, k] + 1)
        gone = ~kept & ~sub & ~ins & (x > 1) & (here == table[x - 1, y, k] + 1)
        swap = ~(kept | sub | ins | gone)
        op = np.select([sub, ins, gone, swap], [SUB, INS, DEL, SWAP], -1)
        for at in np.flatnonzero(op >= 0):
            p, q, o = k[at], x[at], int(op[at])
            left, right = (first[p][q - 1], second[p][y[at] - 1]) if o in (SUB, INS) else (first[p][q - 2], first[p][q - 1])
            out[p].append({"op": o, "a": left, "b": right})
        i[k] = x - np.where(ins, 0, np.where(swap, 2, 1))
        j[k] = y - np.where(gone, 0, np.where(swap, 2, 1))
    return out


@F.pandas_udf(T.IntegerType())
def osa(first: pd.Series, second: pd.Series) -> pd.Series:
    """Distance of two texts; null if one is null."""
    ok = first.notna() & second.notna()
    out = pd.Series([None] * len(first), index=first.index, dtype="Int32")
    out[ok] = distances(first[ok].tolist(), second[ok].tolist())
    return out


@F.pandas_udf(EDITS)
def edit_list(right: pd.Series, typed: pd.Series) -> pd.Series:
    """Edits from the right text to the typed one, both led by `~`; null if one is null."""
    ok = np.flatnonzero((right.notna() & typed.notna()).to_numpy())
    a, b = ["~" + right.iloc[i] for i in ok], ["~" + typed.iloc[i] for i in ok]
    out: list = [None] * len(right)
    for ids in _chunks(a, b):
        d = tables([a[i] for i in ids], [b[i] for i in ids])
        for i, edits in zip(ids, edits_of(d, [a[i] for i in ids], [b[i] for i in ids])):
            out[ok[i]] = edits
    return pd.Series(out, index=right.index)


def one_edit(text: Column, letters: Column) -> Column:
    """All texts one deletion, swap, replacement or insertion away, repetitions kept; letters is an array."""
    n = F.length(text)
    left = lambda i: F.substring(text, F.lit(1), i)
    right = lambda i: F.substring(text, i + 1, n)
    upto = lambda last: F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    deletes = F.transform(upto(n - 1), lambda i: F.concat(left(i), right(i + 1)))
    swaps = F.transform(upto(n - 2), lambda i: F.concat(left(i), F.substring(text, i + 2, F.lit(1)), F.substring(text, i + 1, F.lit(1)), right(i + 2)))
    replaces = F.flatten(F.transform(upto(n - 1), lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i + 1)))))
    inserts = F.flatten(F.transform(upto(n), lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i)))))
    return F.concat(deletes, swaps, replaces, inserts)
