"""Exact positions and running sums within groups of any size, without a task that holds a whole group.

The rows are range-partitioned and sorted on (group, order). Each partition numbers its own rows; a group that
spans partitions gets the number of its rows in earlier partitions added. Only the first group of a partition can
have such an offset, so the table of offsets has at most one row per partition and is broadcast.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.session import materialise, partitions

PID, FIRST, POS, RUN = "__pid", "__first", "__position", "__running"


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; two nulls are equal, and so are two NaN."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(column.type):
        differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    nulls = pc.not_equal(pc.is_null(a), pc.is_null(b))
    return pc.or_(differ, nulls).to_numpy(zero_copy_only=False)


def running_name(i: int) -> str:
    """The running sum of the i-th weight."""
    return RUN + str(i) if i else RUN


def _scan(group: list[str], weights: list[str], keep: int | None):
    def run(batches):
        pid, last, count, totals, first = TaskContext.get().partitionId(), None, 0, [0] * len(weights), True
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = [b.column(b.schema.get_field_index(g)) for g in group]
            change = np.zeros(n, bool)
            for k in keys:
                change[1:] |= _changes(k)
            change[0] = last is None or any(_changes(pa.concat_arrays([x, k.slice(0, 1)]))[0] for x, k in zip(last, keys))
            starts, segment = np.flatnonzero(change), np.cumsum(change) - 1
            at = np.arange(n)
            carried = segment < 0
            begin = np.where(carried, -count, starts[np.maximum(segment, 0)] if len(starts) else 0)
            position = at - begin + 1
            is_first = (carried & first) | ((last is None) & (segment <= 0))
            columns = list(b.columns)
            running = [] if weights else [position]
            for i, name in enumerate(weights):
                w = pc.fill_null(b.column(b.schema.get_field_index(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                sums = np.cumsum(w)
                before = np.where(carried, -totals[i], (sums - w)[starts][np.maximum(segment, 0)] if len(starts) else 0)
                running.append(sums - before)
                totals[i] = running[i][-1]
            count, last = position[-1], [k.slice(n - 1, 1) for k in keys]
            first = first and bool(is_first[-1])
            columns += [pa.array(np.full(n, pid, np.int32)), pa.array(is_first), pa.array(position.astype(np.int64)), *[pa.array(r.astype(np.int64)) for r in running]]
            out = pa.RecordBatch.from_arrays(columns, [*b.schema.names, PID, FIRST, POS, *[running_name(i) for i in range(len(running))]])
            yield out.filter(pa.array(position <= keep)) if keep else out

    return run


def global_positions(df: DataFrame, group: list[str], order: list[Column], weight: str | list[str] | None = None, keep: int | None = None, label: str = "positions") -> DataFrame:
    """df with `__position` (from 1, within group, by order) and `__running` (sum of the whole-number weight up to and
    including the row; the position where no weight is named; see running_name for further weights). With keep, only
    rows at positions up to keep remain.

    The order should end in a unique column: rows with equal group and order values stay in one partition and get
    their positions in no fixed order. Null group values form a group; null weights count 0.
    """
    n, weights = partitions(df.sparkSession), [weight] if isinstance(weight, str) else list(weight or [])
    runs = [running_name(i) for i in range(max(1, len(weights)))]
    keys = [F.col(g).asc() for g in group] + order
    schema = T.StructType([*df.schema.fields, T.StructField(PID, T.IntegerType()), T.StructField(FIRST, T.BooleanType()), T.StructField(POS, T.LongType()), *[T.StructField(r, T.LongType()) for r in runs]])
    scanned = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_scan(group, weights, keep), schema)
    kept = materialise(scanned, label)
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group]
    firsts = kept.where(FIRST).select(*group).distinct()  # at most one group a partition
    spanning = kept.alias("k").join(F.broadcast(firsts.alias("f")), same("k", "f") or F.lit(True), "left_semi")
    counts = spanning.groupBy(*group, PID).agg(*[F.max(x).alias(f"{x}_n") for x in (POS, *runs)])
    earlier = Window.partitionBy(*group).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, PID, *[F.sum(f"{x}_n").over(earlier).alias(f"{x}_n") for x in (POS, *runs)]).where(F.col(f"{POS}_n").isNotNull())
    joined = kept.alias("k").join(F.broadcast(offsets.alias("o")), [*same("k", "o"), F.col(f"k.{PID}") == F.col(f"o.{PID}")], "left")
    out = joined.select(
        *[F.col(f"k.`{c}`") for c in df.columns],
        *[(F.col(f"k.{x}") + F.coalesce(F.col(f"o.{x}_n"), F.lit(0))).alias(x) for x in (POS, *runs)],
    )
    return out.where(F.col(POS) <= keep) if keep else out
