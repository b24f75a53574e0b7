"""Continuous periods and gaps of time intervals per entity.

The state of an entity is a pair of parallel lists, the starts and ends of sorted
disjoint intervals. States merge linearly, so they form a mergeable aggregate: every
input partition folds its rows into states, and a tree of exchanges, as deep as the number
of partitions asks for, merges ``fan_in`` states of a key at a time.

A state is cut by the time cell its intervals start in (``cell_ms``), so no task ever
holds more than one cell of one entity, however many rows the entity has. What crosses
cell borders is settled on one slim row per cell (the running end), not on the lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reelspark.session import materialize

_STATE = "e string, cell bigint, starts array<bigint>, ends array<bigint>"
_STATE_ARROW = pa.schema(
    [("e", pa.string()), ("cell", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
)
#: Intervals that a map task folds together before it hands partial states on.
_FOLD_ROWS = 200_000


def _fold(group: np.ndarray, cell: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Intervals in any order, folded to states: sorted by (group, cell, start), disjoint and apart."""
    order = np.lexsort((start, cell, group))
    return _absorb(group[order], cell[order], start[order], end[order])


def _merge(group: np.ndarray, cell: np.ndarray, start: np.ndarray, end: np.ndarray, cell_ms: int):
    """The same for states that follow each other by (group, cell), each of them sorted.

    One number orders everything, and it ascends within every state: a stable sort finds the
    states as ascending runs and merges runs linearly, without sorting anew.
    """
    fresh = np.ones(len(group), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])
    place = (np.cumsum(fresh) - 1) * cell_ms + (start - cell * cell_ms)
    order = np.argsort(place, kind="stable")
    return _absorb(group[order], cell[order], start[order], end[order])


def _absorb(group: np.ndarray, cell: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Sorted intervals of the same (group, cell) that overlap or touch become one."""
    n = len(start)
    fresh = np.ones(n, bool)
    fresh[1:] = (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])
    key = np.cumsum(fresh) - 1
    # A running maximum that restarts with every key: compare ranks of ends, offset by key.
    levels, rank = np.unique(end, return_inverse=True)
    running = levels[np.maximum.accumulate(key * len(levels) + rank) - key * len(levels)]
    opens = fresh.copy()
    opens[1:] |= start[1:] > running[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], n) - 1
    return group[first], cell[first], start[first], running[last], fresh[first]


def _batch(names: pa.Array, group, cell, start, end, fresh) -> pa.RecordBatch:
    heads = np.flatnonzero(fresh)
    offsets = pa.array(np.append(heads, len(start)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(group[heads])),
            pa.array(cell[heads]),
            pa.ListArray.from_arrays(offsets, pa.array(start)),
            pa.ListArray.from_arrays(offsets, pa.array(end)),
        ],
        schema=_STATE_ARROW,
    )


def _partial(cell_ms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush():
            data = pa.Table.from_batches(held).combine_chunks()
            coded = data.column(0).combine_chunks().dictionary_encode()
            start = data.column(1).to_numpy()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            return _batch(coded.dictionary, *_fold(codes, start // cell_ms, start, data.column(2).to_numpy()))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= _FOLD_ROWS:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    return run


def _combine(cell_ms: int):
    """Merge neighbouring states of one key; the input is sorted by entity and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_start, open_end = None, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [open_key[0]] if open_key else []
            coded = pa.concat_arrays([pa.array(names, pa.string()), batch.column(0)]).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            held = len(open_start)
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            group = np.concatenate([np.zeros(held, np.int64), np.repeat(codes[len(names):], sizes)])
            cell = np.concatenate(
                [np.full(held, open_key[1] if open_key else 0, np.int64), np.repeat(batch.column(1).to_numpy(), sizes)]
            )
            start = np.concatenate([open_start, batch.column(2).flatten().to_numpy()])
            end = np.concatenate([open_end, batch.column(3).flatten().to_numpy()])
            tail_group, tail_cell = codes[-1], batch.column(1)[-1].as_py()
            group, cell, start, end, fresh = _merge(group, cell, start, end, cell_ms)
            tail = (group == tail_group) & (cell == tail_cell)
            if (~tail).any():
                yield _batch(coded.dictionary, group[~tail], cell[~tail], start[~tail], end[~tail], fresh[~tail])
            open_key = (batch.column(0)[-1].as_py(), tail_cell)
            open_start, open_end = start[tail], end[tail]
        if open_key:
            one = np.zeros(len(open_start), np.int64)
            fresh = np.arange(len(one)) == 0
            yield _batch(pa.array([open_key[0]], pa.string()), one, one + open_key[1], open_start, open_end, fresh)

    return run


def interval_states(df: DataFrame, entity: str, start: str, end: str, cell_ms: int = 3_600_000, fan_in: int = 32, partitions: int | None = None) -> DataFrame:
    """States (e, cell, starts, ends) of the intervals; see the module text.

    ``partitions`` is how many partitions ``df`` has; without it they are counted, which is
    free for tables as read but runs the exchanges of a derived frame.
    """
    rows = df.select(
        F.col(entity).cast("string").alias("e"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("t")
    ).where("e is not null and s is not null and t is not null and s < t")
    states = rows.mapInArrow(_partial(cell_ms), _STATE)
    left = partitions or rows.rdd.getNumPartitions()
    while left > fan_in:
        left = -(-left // fan_in)
        # The states of one key come from at most so many tasks, which are spread over ``left`` reducers.
        salted = states.withColumn("salt", F.spark_partition_id() % left).repartition("e", "cell", "salt").drop("salt")
        states = salted.sortWithinPartitions("e", "cell").mapInArrow(_combine(cell_ms), _STATE)
    return states.repartition("e", "cell").sortWithinPartitions("e", "cell").mapInArrow(_combine(cell_ms), _STATE)


def periods_and_gaps(
    df: DataFrame, entity: str, start: str, end: str, cell_ms: int = 3_600_000, fan_in: int = 32
) -> DataFrame:
    """Rows (entity, kind, start_ms, end_ms): maximal covered stretches and the gaps between them.

    ``start`` and ``end`` are whole milliseconds. Intervals that overlap, nest or merely
    touch form one period. Rows with a null entity or bound, or with start >= end, do not
    count; repeated rows change nothing; other columns are ignored; an empty input gives
    no rows.
    """
    states = materialize(interval_states(df, entity, start, end, cell_ms, fan_in))
    by_cell = W.Window.partitionBy("e").orderBy("cell")
    slim = states.select("e", "cell", F.element_at("ends", -1).alias("last"))
    slim = slim.select(
        "e",
        "cell",
        F.max("last").over(by_cell.rowsBetween(W.Window.unboundedPreceding, -1)).alias("carry"),
        F.max("last").over(W.Window.partitionBy("e")).alias("over"),
    )
    # Intervals that start within what earlier cells cover are absorbed: always a prefix.
    absorbed = F.when(F.col("carry").isNull(), F.lit(0)).otherwise(
        F.size(F.filter("starts", lambda x: x <= F.col("carry")))
    )
    cells = states.join(slim, ["e", "cell"]).withColumn("k", absorbed).where(F.col("k") < F.size("starts"))
    cells = cells.select(
        "e",
        "cell",
        "over",
        F.when(F.col("k") > 0, F.greatest("carry", F.element_at("ends", F.col("k")))).otherwise(F.col("carry")).alias("before"),
        F.slice("starts", F.col("k") + 1, F.size("starts")).alias("starts"),
        F.slice("ends", F.col("k") + 1, F.size("ends")).alias("ends"),
    )
    n = F.size("starts")
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start_ms"), b.alias("end_ms"))
    inner = cells.where(n > 1).select(
        "e",
        F.explode(
            F.concat(
                F.zip_with(F.slice("starts", 1, n - 1), F.slice("ends", 1, n - 1), lambda a, b: row("period", a, b)),
                F.zip_with(F.slice("ends", 1, n - 1), F.slice("starts", 2, n - 1), lambda a, b: row("gap", a, b)),
            )
        ).alias("r"),
    )
    ends = F.coalesce(F.lead("before").over(by_cell), F.col("over"))
    border = cells.select(
        "e",
        F.array(
            row("period", F.element_at("starts", -1), ends), row("gap", F.col("before"), F.element_at("starts", 1))
        ).alias("rs"),
    ).select("e", F.explode("rs").alias("r")).where("r.start_ms is not null")
    return inner.unionByName(border).select(F.col("e").alias(entity), "r.kind", "r.start_ms", "r.end_ms")
