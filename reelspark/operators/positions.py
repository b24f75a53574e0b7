"""Exact positions of rows within groups, without gathering a group in one task.

A global range-partitioned sort on group and order puts every group into neighbouring
partitions. Each partition numbers its rows per group and reports how many rows its last
group has; only that group can go on in later partitions, so the reports are at most one
row per partition. Their prefix sums turn local numbers into exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from reelspark.session import materialize, parallelism


def _changes(batch: pa.RecordBatch, group: Sequence[str]) -> np.ndarray:
    """For each row but the first, whether its group differs from the row before."""
    out = np.zeros(batch.num_rows - 1, bool)
    for name in group:
        a, b = batch.column(name).slice(0, batch.num_rows - 1), batch.column(name).slice(1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        one_null = pc.not_equal(pc.is_null(a), pc.is_null(b))
        out |= pc.or_(differs, one_null).to_numpy(zero_copy_only=False)
    return out


def _number(group: Sequence[str], limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        key, total, pending = None, 0, None

        def out(batch: pa.RecordBatch, local: np.ndarray, tail: bool) -> pa.RecordBatch:
            n = batch.num_rows
            extra = [pa.array(np.full(n, pid, np.int32)), pa.array(local), pa.array(np.full(n, tail))]
            return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "__pid", "__local", "__tail"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            first = tuple(batch.column(g)[0].as_py() for g in group)
            fresh = np.concatenate([[first != key], _changes(batch, group)])
            summed = np.cumsum(batch.column("__weight").to_numpy().astype(np.int64))
            starts = np.flatnonzero(fresh)
            base = np.full(n, -total if not fresh[0] else 0, np.int64)
            if len(starts):
                before = np.where(starts > 0, summed[starts - 1], 0)
                which = np.cumsum(fresh) - 1
                base = np.where(which >= 0, before[np.maximum(which, 0)], -total)
            local = summed - base
            if pending is not None:
                yield out(*pending, False)
            if n > 1:
                keep = np.arange(n - 1) if limit is None else np.flatnonzero(local[:-1] <= limit)
                if len(keep):
                    yield out(batch.take(pa.array(keep)), local[keep], False)
            last = batch.slice(n - 1)
            key, total = tuple(last.column(g)[0].as_py() for g in group), int(local[-1])
            pending = (last, local[-1:])
        if pending is not None:
            yield out(*pending, True)

    return run


def global_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    weight: str | None = None,
    limit: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """The rows of ``df`` with ``position`` (bigint), counted from 1 within each group.

    ``order`` should end in a unique key, else equal rows get their positions in an
    arbitrary order. With ``weight`` (a non-negative bigint column) the position is the
    running sum of the weights. With ``limit`` only rows at positions up to it are kept;
    rows beyond it are dropped before they leave their task. Nulls form a group of their
    own. An empty input gives no rows.
    """
    rows = df.withColumn("__weight", F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint"))
    keys = [F.col(g).asc_nulls_first() for g in group]
    ordered = rows.repartitionByRange(partitions or parallelism(df), *keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType(
        [
            *rows.schema.fields,
            T.StructField("__pid", T.IntegerType()),
            T.StructField("__local", T.LongType()),
            T.StructField("__tail", T.BooleanType()),
        ]
    )
    # The exchange samples for its bounds; the written copy fixes which row lies where.
    numbered = materialize(ordered.mapInArrow(_number(list(group), limit), schema))
    by_group = W.Window.partitionBy(*group).orderBy("__pid")
    tails = numbered.where("__tail").select(
        *[F.col(g).alias(f"__t{i}") for i, g in enumerate(group)],
        F.col("__pid").alias("__q"),
        F.sum("__local").over(by_group).alias("__sum"),
        F.lead("__pid").over(by_group).alias("__next"),
    )
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__t{i}"))
    within = (F.col("__pid") > F.col("__q")) & (F.col("__next").isNull() | (F.col("__pid") <= F.col("__next")))
    # One row per partition at most: safe to send to every task.
    joined = numbered.join(F.broadcast(tails), same & within, "left")
    position = F.col("__local") + F.coalesce("__sum", F.lit(0))
    out = joined.select(*[c for c in df.columns], position.cast("bigint").alias("position"))
    return out if limit is None else out.where(F.col("position") <= limit)
