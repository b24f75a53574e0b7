"""Filling containers of fixed capacity with items, certified by lower bounds.

Items are spread over partitions of bounded size and packed by best-fit decreasing. A
dual feasible function maps sizes so that the mapped sizes of any feasible container
sum to at most its capacity; the sum over all items is then a lower bound for the number
of containers. A partition that needs no more containers than its bound is certified
optimal. As long as there are more containers than the bound over all items, partitions
with gaps put the items of their unfilled containers, and the others those of their
widely unfilled ones, into a common pool, which is dealt out anew and packed again, until
the bound is met or a round saves nothing. A round never costs containers.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.session import materialize

#: Containers with more room than this part of their capacity exchange their items in any case.
WIDE = 0.02
#: Containers that a partition fills at least, where there are so many.
LEAST_FILLED = 20
#: Largest number of (distinct) capacities; each item is packed once for each.
MAX_CAPACITIES = 1_000
_PACKED = "capacity_id int, capacity bigint, doc_id bigint, part_no int, part_tokens bigint, grp bigint, bin int, bins int, bound int, room bigint, row bigint"


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None, most: int = 20) -> int:
    """The best of several dual-feasible-function bounds for sizes in 1..capacity.

    With ``counts`` the sizes are distinct and occur so often; nothing is expanded.
    """
    if not len(sizes):
        return 0
    if counts is None:
        size, n = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    else:
        order = np.argsort(sizes)
        size, n = np.asarray(sizes, np.int64)[order], np.asarray(counts, np.int64)[order]
    c = int(capacity)
    # Sums of tokens fit 64 bits; only the staircase multiplies them, so it takes whole numbers of any size.
    weight, count = np.concatenate([[0], np.cumsum(size * n)]), np.concatenate([[0], np.cumsum(n)])
    best = -(-int(weight[-1]) // c)
    # Staircase functions: sizes count in (k + 1)-ths of the capacity, rounded down to k parts.
    for k in range(1, most + 1):
        parts = (k + 1) * size
        value = np.where(parts % c == 0, size * k, parts // c * c)
        best = max(best, -(-int((value.astype(object) * n).sum()) // (k * c)))
    # Threshold functions: above c - a a whole container, below a nothing.
    a = np.concatenate([[0], size[size * 2 <= c]])
    i, j = np.searchsorted(size, a), np.searchsorted(size, c - a, side="right")
    whole, rest = count[-1] - count[j], weight[j] - weight[np.minimum(i, j)]
    return max(best, int((whole - (-rest // c)).max()))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container numbers (from 0) of sizes in descending order, by best fit.

    Open containers lie in stacks by remaining room; a bit mask over rooms finds the
    smallest room that still fits.
    """
    bins = np.empty(len(sizes), np.int32)
    stacks: dict[int, list[int]] = {}
    mask, opened = 0, 0
    for i, size in enumerate(sizes.tolist()):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            room, number = capacity, opened
            opened += 1
        left = room - size
        if left:
            stack = stacks.setdefault(left, [])
            stack.append(number)
            mask |= 1 << left
        bins[i] = number
    return bins


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["part_tokens", "doc_id", "part_no"], ascending=[False, True, True], na_position="first")
    sizes, capacity = pdf["part_tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0])
    bins = best_fit(sizes, capacity)
    used = np.bincount(bins, weights=sizes).astype(np.int64)
    out = pdf[["capacity_id", "capacity", "doc_id", "part_no", "part_tokens", "grp", "row"]].copy()
    out["bin"] = bins
    out["bins"] = np.int32(len(used))
    out["bound"] = np.int32(lower_bound(sizes, capacity))
    out["room"] = capacity - used[bins]
    return out


def _bins(packed: DataFrame) -> dict[int, int]:
    """Containers per capacity."""
    bins = packed.groupBy("capacity_id", "grp").agg(F.countDistinct("bin").alias("n")).groupBy("capacity_id").agg(F.sum("n"))
    return {r[0]: r[1] for r in bins.collect()}  # one row per capacity


def _settled(packed: DataFrame, label: str) -> DataFrame:
    number = F.concat_ws("-", F.lit(label), "grp", "bin")
    return packed.select("capacity_id", "capacity", "doc_id", "part_no", "part_tokens", number.alias("number"), (F.col("bins") == F.col("bound")).alias("certified"))


def parts(sizes: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """Rows (capacity_id, capacity, doc_id, part_no, part_tokens) to be packed.

    An item above a capacity is cut into full containers and a rest; any other is one part.
    """
    choices = F.array(*[F.struct(F.lit(i).cast("int").alias("id"), F.lit(c).cast("bigint").alias("c")) for i, c in capacities])
    each = sizes.where("doc_tokens > 0").select("doc_id", "doc_tokens", F.explode(choices).alias("k"))
    last = F.ceil(F.col("doc_tokens") / F.col("k.c")).cast("int")
    return each.select(
        F.col("k.id").alias("capacity_id"),
        F.col("k.c").alias("capacity"),
        "doc_id",
        F.explode(F.sequence(F.lit(1), last)).alias("part_no"),
        "doc_tokens",
    ).select(
        "capacity_id", "capacity", "doc_id", "part_no", F.least("capacity", F.col("doc_tokens") - (F.col("part_no") - 1).cast("bigint") * F.col("capacity")).alias("part_tokens")
    )


def pack(sizes: DataFrame, capacities: list[tuple[int, int]], group_items: int = 20_000, exchange: bool = True) -> DataFrame:
    """Rows (capacity_id, container_id, capacity, doc_id, part_no, part_tokens, certified).

    ``sizes`` has (doc_id, doc_tokens); ``capacities`` are (id, capacity) pairs. Every item
    with a size above 0 is in exactly one container per capacity, cut only if it exceeds
    the capacity; items of null, zero or negative size take no container and give no row.
    Repeated rows and null ids are items of their own. A part as large as the capacity is
    a container by itself and needs no packing. Turns of exchange go on until the number of
    containers meets the bound over all items or a turn saves none; without ``exchange``
    every partition is packed once. ``certified`` says that the container
    belongs to a partition whose number of containers equals its lower bound.
    """
    capacities = sorted({(int(i), int(c)) for i, c in capacities if i is not None and c is not None and c > 0})
    if not capacities or len(capacities) > MAX_CAPACITIES:
        raise ValueError(f"between 1 and {MAX_CAPACITIES} positive capacities are needed")
    pieces = materialize(
        parts(sizes.select("doc_id", "doc_tokens"), capacities).withColumn("row", F.monotonically_increasing_id())
    )
    whole = pieces.where("part_tokens = capacity")
    done = [whole.select("capacity_id", "capacity", "doc_id", "part_no", "part_tokens", F.concat(F.lit("f"), "row").alias("number"), F.lit(True).alias("certified"))]
    todo = pieces.where("part_tokens < capacity")
    least = bounds(todo)
    frozen = dict.fromkeys((i for i, _ in capacities), 0)  # containers that are settled, per capacity
    before: tuple[DataFrame, dict[int, int], str] | None = None  # the pool as it was packed last
    for turn in itertools.count():
        # One row per capacity. A partition gets no more items than asked for, unless they
        # would fill only a few containers, of which the last always has a gap.
        found = todo.groupBy("capacity_id", "capacity").agg(F.count(F.lit(1)), F.sum("part_tokens")).collect()
        n = {k: max(1, min(-(-items // group_items), tokens // (c * LEAST_FILLED))) for k, c, items, tokens in found}
        if not n:
            break
        deal = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, v)])
        # A fresh hash each turn deals the pooled items out differently; row numbers are unique,
        # so repeated rows and null ids spread like any other.
        grp = F.pmod(F.xxhash64("row", F.lit(turn)), F.try_element_at(deal, F.col("capacity_id")))
        packed = materialize(todo.withColumn("grp", grp.cast("bigint")).groupBy("capacity_id", "grp").applyInPandas(_pack, _PACKED))
        count = _bins(packed)
        if before is not None:
            worse = [k for k in count if count[k] > before[1][k]]
            if worse:  # that pool stays as it was
                done.append(_settled(before[0].where(F.col("capacity_id").isin(worse)), before[2]))
                packed = packed.where(~F.col("capacity_id").isin(worse))
                frozen |= {k: frozen[k] + before[1][k] for k in worse}
                count = {k: v for k, v in count.items() if k not in worse}
        # Another turn helps where there are more containers than any packing needs, and did
        # help where there was one.
        again = [k for k in count if frozen[k] + count[k] > least.get(k, 0) and (before is None or count[k] < before[1][k])]
        if not exchange or not again:
            done.append(_settled(packed, f"r{turn}"))
            break
        gap, wide = F.col("bins") > F.col("bound"), F.col("room") > F.col("capacity") * WIDE
        open_bin = F.col("capacity_id").isin(again) & (F.col("room") > 0) & (gap | wide)
        done.append(_settled(packed.where(~open_bin), f"r{turn}"))
        pool = packed.where(open_bin)
        held = _bins(pool)
        frozen |= {k: frozen[k] + count[k] - held.get(k, 0) for k in count}
        before = (pool, held, f"r{turn}")
        todo = pool.select("capacity_id", "capacity", "doc_id", "part_no", "part_tokens", "row")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        "capacity_id", F.concat_ws(":", F.col("capacity_id").cast("string"), "number").alias("container_id"), "capacity", "doc_id", "part_no", "part_tokens", "certified"
    )


def containers(packed: DataFrame) -> DataFrame:
    """One row per container with its number of parts, used and unused tokens."""
    return packed.groupBy("capacity_id", "container_id", "capacity", "certified").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("part_tokens").alias("used_tokens")
    ).withColumn("unused_tokens", F.col("capacity") - F.col("used_tokens"))


def bounds(packed: DataFrame) -> dict[int, int]:
    """The lower bound over all items per capacity, from one histogram (at most as many sizes as the capacity)."""

    def of_one(pdf: pd.DataFrame) -> pd.DataFrame:
        bound = lower_bound(pdf["part_tokens"].to_numpy(), int(pdf["capacity"].iloc[0]), pdf["n"].to_numpy())
        return pd.DataFrame({"capacity_id": pdf["capacity_id"].iloc[:1], "bound": [bound]})

    sizes = packed.groupBy("capacity_id", "capacity", "part_tokens").agg(F.count(F.lit(1)).alias("n"))
    return {r[0]: r[1] for r in sizes.groupBy("capacity_id").applyInPandas(of_one, "capacity_id int, bound bigint").collect()}
