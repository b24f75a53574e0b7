"""Order-dependent greedy selection within groups of any size, as a stream over sorted rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from reelspark.operators.positions import _changes
from reelspark.session import parallelism


class _Kept:
    """Positions kept so far in one group, found by the cell of their first number."""

    def __init__(self, window: float) -> None:
        # A little wider than the window, so that rounding never puts near positions two cells apart.
        self.window, self.width = window, window * 1.000001 or 1.0
        self.cells: dict[tuple, list[tuple]] = {}
        self.n = 0

    def takes(self, position: Sequence | None, cap: int | None) -> bool:
        """Whether a position stays: the cap leaves room and no kept one is near; it is kept then."""
        if cap is not None and self.n >= cap:
            return False
        if position is None or not len(position) or any(x is None or x != x or abs(x) == float("inf") for x in position):
            self.n += 1  # nothing is near what has no place
            return True
        size, cell = len(position), floor(position[0] / self.width)
        for c in (cell - 1, cell, cell + 1):
            for other in self.cells.get((size, c), ()):
                if all(abs(x - y) <= self.window for x, y in zip(position, other)):
                    return False
        self.cells.setdefault((size, cell), []).append(tuple(position))
        self.n += 1
        return True


def keep_apart(df: DataFrame, group: Sequence[str], order: Sequence[Column], position: str, window: float, cap: int | None = None) -> DataFrame:
    """The rows of ``df`` that a greedy pass keeps in each group, in no order.

    Rows come by ``order``, which should be unique within a group; each stays unless one
    that stayed lies within ``window`` (inclusive) of its ``position``, or ``cap`` rows have
    stayed. ``position`` is a number, or an array of numbers of which all must lie near and
    which only meets arrays of its length; a null or non-finite position is near nothing.

    Each group is one sorted stream: only the kept positions are held, in cells as wide as
    the window, so a row is compared with the few of its cell and the adjacent ones.
    """
    is_list = df.schema[position].dataType.typeName() == "array"
    sort = [*group, *order]
    rows = df.repartition(parallelism(df), *group).sortWithinPartitions(*sort)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, _Kept(window)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            first = tuple(batch.column(g)[0].as_py() for g in group)
            fresh = np.concatenate([[first != key], _changes(batch, group)])
            key = tuple(batch.column(g)[n - 1].as_py() for g in group)
            stays = np.zeros(n, bool)
            values = batch.column(position).to_pylist()
            for i, (new, value) in enumerate(zip(fresh.tolist(), values)):
                if new:
                    kept = _Kept(window)
                stays[i] = kept.takes(value if is_list else None if value is None else (value,), cap)
            yield batch.filter(pa.array(stays))

    return rows.mapInArrow(run, df.schema)
