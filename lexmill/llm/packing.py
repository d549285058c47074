"""Filling containers of fixed capacity with texts, planned on the histogram of their lengths."""

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.tokens import VOCABULARY, with_tokens
from lexmill.operators.positions import POS, RUN, global_positions
from lexmill.session import materialise

#: Tokens of a container.
CAPACITY = 2048


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit by decreasing length over counts: (length, first rank, items a container, first container) for each
    run of alike containers, in rank order within a length, and the number of containers.

    Containers with the same space left are ranges of numbers. Best fit puts the items of one length into the
    tightest container that takes one, and fills that up before the next; so a range takes space // length items
    each, and is cut where the items end. The plan's size depends on the capacity, not on the number of items.
    """
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left -> ranges (first, number)
    spaces: list[int] = []
    slots, used = [], 0

    def add(space: int, first: int, number: int) -> None:
        if number and space:
            if not open_[space]:
                insort(spaces, space)
            open_[space].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        fresh = []
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, number = open_[space].pop()
                if not open_[space]:
                    spaces.pop(at)
            else:
                space = capacity
                first, number = used, -(-left // (capacity // length))
                used += number
            each = space // length
            full = min(number, left // each)
            if full:
                slots.append((length, rank, each, first))
                fresh.append((space - each * length, first, full))
                rank, left = rank + full * each, left - full * each
            if full < number and left:
                slots.append((length, rank, left, first + full))
                fresh.append((space - left * length, first + full, 1))
                add(space, first + full + 1, number - full - 1)
                rank, left = rank + left, 0
            elif full < number:
                add(space, first + full, number - full)
        for x in fresh:
            add(*x)
    return slots, used


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, n_tokens, container_id): one row for each text, or for each piece of a text above the capacity.

    A text above the capacity gives pieces of exactly the capacity, each a container of its own, and a last piece of
    the rest. No other text is split. Null and empty texts have no tokens and get one row with a null container.
    Rows that repeat a doc_id are texts of their own. The driver sees the histogram only: at most `capacity` rows.
    """
    sized = materialise(with_tokens(documents, ["doc_id"], vocabulary=vocabulary), "tokens")
    pieces = sized.select("doc_id", "n_tokens", F.expr(f"n_tokens div {capacity}").alias("whole"), (F.col("n_tokens") % capacity).alias("rest"))
    histogram = {r["rest"]: r["n"] for r in pieces.where("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, used = plan(histogram, capacity)
    base = 1 << 40
    keys = np.array([s[0] * base + s[1] for s in slots] or [0], np.int64)
    order = np.argsort(keys)
    keys, each, first = keys[order], np.array([s[2] for s in slots] or [1])[order], np.array([s[3] for s in slots] or [0])[order]

    def place(batches):
        for b in batches:
            rest, position = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("rest", POS))
            k = rest * base + position - 1
            at = np.searchsorted(keys, k, side="right") - 1
            container = first[at] + (k - keys[at]) // each[at]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(container, pa.int64())], ["doc_id", "piece", "n_tokens", "container_id"])

    ranked = global_positions(pieces.where("rest > 0").select("doc_id", "whole", "rest"), ["rest"], [F.col("doc_id").asc(), F.col("whole").asc()], label="ranks")
    schema = "doc_id bigint, piece bigint, n_tokens bigint, container_id bigint"
    rests = ranked.select(F.col("doc_id").cast("bigint"), F.col("whole").alias("piece"), F.col("rest").alias("n_tokens"), "rest", POS).mapInArrow(place, schema)
    long = global_positions(pieces.where("whole > 0").select("doc_id", "whole", F.lit(0).alias("one")), ["one"], [F.col("doc_id").asc(), F.col("whole").asc()], weight="whole", label="long")
    wholes = long.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"), (F.col(RUN) - F.col("whole")).alias("before")).select("doc_id", "piece", F.lit(capacity).cast("bigint").alias("n_tokens"), (F.lit(used) + F.col("before") + F.col("piece")).cast("bigint").alias("container_id"))
    empty = sized.where("n_tokens = 0").select("doc_id", F.lit(0).cast("bigint").alias("piece"), "n_tokens", F.lit(None).cast("bigint").alias("container_id"))
    return rests.unionByName(wholes).unionByName(empty)


def container_use(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, their tokens, and the share of their space that stays unused."""
    held = packed.where("container_id IS NOT NULL").agg(F.count_distinct("container_id").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return held.withColumn("unused_share", F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)))
