"""Clusters of mutually similar vectors from mergeable cluster-feature trees.

1. Every partition grows a CF tree over its vectors; a leaf absorbs what lies within half
   the similarity radius. Leaves, not vectors, take part in what follows.
2. The leaf summaries are reduced in a tree to a bounded set of coarse CFs, which Ward
   agglomeration turns into routing centroids.
3. Every leaf goes to the cells of its nearest routing centroids; in each cell Ward
   agglomeration joins leaves whose members' mean cosine reaches the threshold. Leaves
   that lie in several cells tie the cells' clusters together.
4. One pass over all vectors assigns each to the cluster of its leaf and measures it
   against the cluster's centroid, which gives sizes and most typical members.

For the clusters that are asked for exactly (any two members similar, nobody outside
similar to a member) a check by exact cosines follows on the clusters found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.cftree import STRIP, CFTree, agglomerate, join_pairs, ward
from reelspark.operators.positions import global_positions
from reelspark.session import materialize

#: Members compared at once in the exact check, and coarse CFs that are agglomerated at most.
BLOCK, MOST_COARSE = 2_048, 4_096
#: Cells up to which the configured number of probes is enough.
CELLS = 128
#: How much larger than the mean a cell may be before it is split.
UNEVEN = 4


@dataclass(frozen=True)
class ClusterConfig:
    """Length of the vectors, least cosine, leaves per cell and cells per leaf."""

    dim: int
    cosine: float = 0.9
    cell_leaves: int = 800
    probes: int = 5

    @property
    def reach(self) -> float:
        """The distance of unit vectors at the least cosine."""
        return math.sqrt(2 - 2 * self.cosine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(matrix).reshape(-1), kind)
    width = matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * width), flat)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first ``keys`` columns of sorted batches, as (key, rows)."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            now = tuple(c[a] for c in columns)
            if held and now != key:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _column(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def unit_vectors(df: DataFrame, uid: str, vector: str, cfg: ClusterConfig) -> DataFrame:
    """Rows (uid, v): unit vectors, a key's repeated rows included; see similar_clusters() for what counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            right = pc.fill_null(pc.equal(pc.list_value_length(column), cfg.dim), False)
            batch = batch.filter(pc.and_(right, batch.column(0).is_valid()))
            if not batch.num_rows:
                continue
            # Nulls among the numbers become NaN.
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, cfg.dim)
            with np.errstate(all="ignore"):
                norm = np.sqrt((raw**2).sum(1))
                good = np.isfinite(raw).all(1) & (norm > 0) & np.isfinite(norm)
            unit = (raw[good] / norm[good, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), _lists(unit, pa.float32())], names=["uid", "v"])

    rows = df.select(F.col(uid).cast("string").alias("uid"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "uid string, v array<float>")


_LEAVES = "uid string, v array<float>, leaf bigint, n double, total array<double>, radius double"


def _grow(cfg: ClusterConfig):
    """Leaves of a CF tree over the first row of every key, and their summaries; the input is sorted by key."""
    names = ["uid", "v", "leaf", "n", "total", "radius"]
    kinds = [pa.string(), pa.list_(pa.float32()), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        tree, last = CFTree(cfg.dim, cfg.reach / 2), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0)
            fresh = np.ones(batch.num_rows, bool)
            fresh[0] = key[0].as_py() != last
            fresh[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            last = key[len(key) - 1].as_py()
            batch = batch.filter(pa.array(fresh))
            if not batch.num_rows:
                continue
            leaf = np.array([tree.insert(x) for x in _matrix(batch.column(1), cfg.dim)], np.int64) + base
            none = [pa.nulls(batch.num_rows, k) for k in kinds[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kinds[0]), batch.column(1).cast(kinds[1]), pa.array(leaf), *none], names=names)
        if len(tree):
            n, total, radius = tree.features()
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, kinds[0]), pa.nulls(m, kinds[1]), pa.array(np.arange(m) + base), pa.array(n), _lists(total, pa.float64()), pa.array(radius)], names=names
            )

    return run


def _coarse(cfg: ClusterConfig, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = CFTree(cfg.dim, cfg.reach / 2, budget=budget)
        for batch in batches:
            for n, total in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), cfg.dim)):
                tree.insert(total, n)
        if len(tree):
            n, total, _ = tree.features()
            yield pa.RecordBatch.from_arrays([pa.array(n), _lists(total, pa.float64())], names=["n", "total"])

    return run


def routing_centroids(leaves: DataFrame, n_leaves: int, cfg: ClusterConfig, fan_in: int = 8) -> np.ndarray:
    """Centroids of the routing cells: tree-reduced coarse CFs, agglomerated by Ward's criterion."""
    k = min(max(1, -(-n_leaves // cfg.cell_leaves)), MOST_COARSE // 4)
    if k == 1:
        return np.zeros((1, cfg.dim))
    budget = 4 * k
    # Leaves weigh alike: a crowd of equal vectors must not take all cells for itself.
    alike = leaves.select(F.lit(1.0).alias("n"), F.transform("total", lambda x: x / F.col("n")).alias("total"))
    level = alike.mapInArrow(_coarse(cfg, budget), "n double, total array<double>")
    parts = leaves.rdd.getNumPartitions()  # of a checkpoint: nothing runs for this
    while parts > 1 and parts * budget > MOST_COARSE:
        parts = -(-parts // fan_in)
        level = level.repartition(parts, F.floor(F.spark_partition_id() / fan_in)) if parts > 1 else level.coalesce(1)
        level = level.mapInArrow(_coarse(cfg, budget), "n double, total array<double>")
    rows = level.collect()  # at most MOST_COARSE coarse CFs
    return _centroids(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), k)


def _centroids(n: np.ndarray, total: np.ndarray, k: int) -> np.ndarray:
    """Centroids of the k clusters of CFs by Ward's criterion."""
    label = ward(n, total / n[:, None], k)
    return np.array([total[label == i].sum(0) / n[label == i].sum() for i in range(label.max() + 1)])


def _nearest_cells(means: np.ndarray, centroids: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of each row's nearest cells: ``probes``, and two more for every doubling of the cells beyond CELLS."""
    more = 2 * max(0, math.ceil(math.log2(len(centroids) / CELLS)))
    m = min(probes + more, len(centroids))
    score = means @ centroids.T - (centroids**2).sum(1) / 2
    cells = np.argpartition(-score, m - 1, axis=1)[:, :m] if m < len(centroids) else np.tile(np.arange(m), (len(means), 1))
    return cells.reshape(-1).astype(np.int64), np.repeat(np.arange(len(means)), m)


_CELLS = "cell bigint, leaf bigint, n double, mean array<float>, radius double"


def _route(cfg: ClusterConfig, centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy()
            means = _matrix(batch.column(2), cfg.dim) / n[:, None]
            cells, rows = _nearest_cells(means, centroids.value, cfg.probes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cells), batch.column(0).take(pa.array(rows)), pa.array(n[rows]),
                    _lists(means[rows].astype(np.float32), pa.float32()), batch.column(3).take(pa.array(rows)),
                ],
                names=["cell", "leaf", "n", "mean", "radius"],
            )

    return run


def _split(cfg: ClusterConfig, most: int):
    """Cells of more than ``most`` leaves in parts: rows as of _route() again, whose leaves visit their nearest parts.

    A cell's parts come from its own coarse CFs and Ward agglomeration; there are at most
    MOST_COARSE / 4, so very large cells are split again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 40, 0
        for _, rows in _groups(batches, 1):
            k = min(-(-len(rows) // cfg.cell_leaves), MOST_COARSE // 4)
            if len(rows) <= most or k < 2:
                cells, at = np.zeros(len(rows), np.int64), np.arange(len(rows))
            else:
                means = _matrix(_column(rows, "mean"), cfg.dim)
                tree = CFTree(cfg.dim, cfg.reach / 2, budget=4 * k)
                for x in means:
                    tree.insert(x)
                centroids = _centroids(*tree.features()[:2], k)
                cells, at = _nearest_cells(means, centroids, cfg.probes)
            for chunk in np.array_split(np.arange(len(at)), max(1, len(at) // 65_536)):
                part = rows.take(pa.array(at[chunk]))
                columns = [pa.array(base + used + cells[chunk]), *[_column(part, c) for c in ("leaf", "n", "mean", "radius")]]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "leaf", "n", "mean", "radius"])
            used += int(cells.max()) + 1

    return run


def _link(cfg: ClusterConfig):
    """Per cell: (leaf, other, kind) - 0 the leaf's local cluster, 1 another leaf that may hold similar members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 1):
            leaf = _column(rows, "leaf").to_numpy()
            n, radius = _column(rows, "n").to_numpy(), _column(rows, "radius").to_numpy()
            means = _matrix(_column(rows, "mean"), cfg.dim).astype(np.float32)
            squared, radius = (means**2).sum(1), radius.astype(np.float32)
            # Members can be similar only if the leaves' balls come that close; no such pair has a smaller product.
            reach = cfg.reach + 1e-3
            least = min(cfg.cosine - 1e-6, squared.min() - (reach + 2 * radius.max()) ** 2 / 2)
            parts, near_a, near_b = np.arange(len(leaf)), [], []
            for s in range(0, len(leaf), STRIP):
                dots = means[s : s + STRIP] @ means[s:].T
                i, j = np.nonzero(dots >= least)
                i, j, dots = i[i < j] + s, j[i < j] + s, dots[i[i < j], j[i < j]]
                joins = dots >= cfg.cosine - 1e-6
                join_pairs(parts, i[joins], j[joins])
                close = squared[i] + squared[j] - 2 * dots <= (reach + radius[i] + radius[j]) ** 2
                near_a.append(i[close])
                near_b.append(j[close])
            label = leaf[agglomerate(n, means, cfg.cosine - 1e-6, parts)]
            i, j = np.concatenate(near_a), np.concatenate(near_b)
            apart = label[i] != label[j]
            near_a, near_b = [leaf[i[apart]]], [leaf[j[apart]]]
            joined = label != leaf
            a = np.concatenate([leaf[joined], *near_a])
            b = np.concatenate([label[joined], *near_b])
            kind = np.concatenate([np.zeros(joined.sum(), np.int32), np.ones(len(a) - joined.sum(), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(kind)], names=["leaf", "other", "kind"])

    return run


def _components(edges: DataFrame) -> DataFrame:
    """Rows (leaf, cluster) of the leaves in ``edges`` (leaf, other): the least leaf reachable.

    Large-star and small-star contractions turn the edges into one star per component in a
    number of turns that grows with the logarithm of its size; a hub's edges are only
    grouped by aggregates, never gathered.
    """
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).collect()[0])
    pairs = materialize(edges.select(F.greatest("leaf", "other").alias("a"), F.least("leaf", "other").alias("b")).where("a <> b").distinct())
    before = print_of(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = materialize(small.where("a <> b").distinct())
        now = print_of(after)
        pairs = after
        # Unlike sets of pairs have the same count and two sums of hashes with odds of 1 in 2^128.
        if now == before:
            break
        before = now
    stars = pairs.select(F.col("a").alias("leaf"), F.col("b").alias("cluster"))
    return stars.unionByName(pairs.select(F.col("b").alias("leaf"), F.col("b").alias("cluster")).distinct())


def _sums(cfg: ClusterConfig):
    """(cluster, n, centroid) of rows (cluster, n, total) sorted by cluster; only its own running sum is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_n, open_total = None, 0.0, np.zeros(cfg.dim)

        def out(key, n, total):
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.float64()), _lists(total / np.asarray(n)[:, None], pa.float64())], names=["cluster", "n", "centroid"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, total = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), cfg.dim)
            begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            keys, ns, totals = key[begin], np.add.reduceat(n, begin), np.add.reduceat(total, begin, axis=0)
            if open_key is not None and keys[0] == open_key:
                ns[0] += open_n
                totals[0] += open_total
            elif open_key is not None:
                yield out([open_key], [open_n], open_total[None, :])
            if len(keys) > 1:
                yield out(keys[:-1], ns[:-1], totals[:-1])
            open_key, open_n, open_total = keys[-1], ns[-1], totals[-1]
        if open_key is not None:
            yield out([open_key], [open_n], open_total[None, :])

    return run


@dataclass
class Clusters:
    """``members`` (uid, v, leaf, cluster), ``centroids`` (cluster, n, centroid) and ``near`` leaf pairs (leaf, other).

    Only clusters of two or more members are listed; ``leaf_points`` has all vectors.
    """

    members: DataFrame
    centroids: DataFrame
    near: DataFrame
    leaf_points: DataFrame
    of_leaf: DataFrame


def similar_clusters(df: DataFrame, uid: str, vector: str, cfg: ClusterConfig) -> Clusters:
    """Clusters of mutually similar vectors; see the module text.

    Null keys, null, all-zero, wrongly long vectors and vectors with null or non-finite
    numbers do not count; lengths other than 1 are normalised; a repeated key counts once
    (by its least vector). Other columns are ignored. An empty input gives no clusters.
    """
    vectors = unit_vectors(df, uid, vector, cfg)
    grown = materialize(vectors.repartition("uid").sortWithinPartitions("uid", "v").mapInArrow(_grow(cfg), _LEAVES))
    points = grown.where("uid is not null").select("uid", "v", "leaf")
    leaves = grown.where("uid is null").select("leaf", "n", "total", "radius")
    n_leaves = leaves.count()
    centroids = df.sparkSession.sparkContext.broadcast(routing_centroids(leaves, n_leaves, cfg))
    routed = leaves.mapInArrow(_route(cfg, centroids), _CELLS)
    most = cfg.cell_leaves * cfg.probes * UNEVEN
    largest = n_leaves
    if n_leaves > cfg.cell_leaves * MOST_COARSE // 4:
        # More cells than one set of centroids gives: split the large ones until none is left, or none gets smaller.
        while True:
            routed = materialize(routed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_split(cfg, most), _CELLS))
            now = routed.groupBy("cell").count().agg(F.max("count")).collect()[0][0]
            if now <= most or now >= largest:
                break
            largest = now
    linked = materialize(routed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link(cfg), "leaf bigint, other bigint, kind int"))
    joined = _components(linked.where("kind = 0"))
    several = materialize(leaves.select("leaf", "n", "total").join(joined, "leaf", "left").select("leaf", F.coalesce("cluster", "leaf").alias("cluster"), F.col("cluster").isNull().alias("alone"), "n", "total"))
    alone = several.where("alone").select("cluster", "n", F.transform("total", lambda x: x / F.col("n")).alias("centroid"))
    summed = several.where("not alone").select("cluster", "n", "total").repartition("cluster").sortWithinPartitions("cluster")
    centre = materialize(alone.unionByName(summed.mapInArrow(_sums(cfg), "cluster bigint, n double, centroid array<double>")).where("n >= 2"))
    of_leaf = several.select("leaf", "cluster")
    members = points.join(of_leaf.join(centre.select("cluster"), "cluster", "left_semi"), "leaf")
    near = linked.where("kind = 1").select("leaf", "other").distinct()
    return Clusters(members.select("uid", "v", "leaf", "cluster"), centre, near, points, of_leaf)


def _cosine(a: str, b: str):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return dot / length


def typical_members(found: Clusters, n: int = 3, chosen: DataFrame | None = None) -> DataFrame:
    """Rows (cluster_uid, size, uid, place, cosine): the ``n`` members nearest to each centroid.

    With ``chosen``, from exact_clusters(), only its clusters are described.
    """
    measured = found.members.join(found.centroids, "cluster").select("cluster", "uid", F.round(_cosine("v", "centroid"), 9).alias("cosine"))
    if chosen is not None:
        measured = measured.join(chosen.select("cluster").distinct(), "cluster", "left_semi")
    measured = materialize(measured)
    names = measured.groupBy("cluster").agg(F.min("uid").alias("cluster_uid"), F.count(F.lit(1)).alias("size"))
    top = global_positions(measured, ["cluster"], [F.col("cosine").desc(), F.col("uid").asc()], limit=n)
    return top.join(names, "cluster").select("cluster_uid", "size", "uid", F.col("position").alias("place"), "cosine")


def _loose(cfg: ClusterConfig):
    """Per (cluster, i, j): whether two members of blocks i and j are less similar than the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches, 3):
            v, at = _matrix(_column(rows, "v"), cfg.dim), _column(rows, "block").to_numpy()
            a, b = v[at == key[1]], v[at == key[2]]
            if len(a) and len(b) and (a @ b.T).min() < cfg.cosine - 1e-7:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64())], names=["cluster"])

    return run


def _touching(cfg: ClusterConfig):
    """Per pair of leaves and blocks of them: both leaves, if any member of one reaches the threshold with one of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches, 4):
            v, first = _matrix(_column(rows, "v"), cfg.dim), _column(rows, "first").to_numpy(zero_copy_only=False)
            a, b = v[first], v[~first]
            if len(a) and len(b) and (a @ b.T).max() >= cfg.cosine - 1e-7:
                yield pa.RecordBatch.from_arrays([pa.array(list(key[:2]), pa.int64())], names=["leaf"])

    return run


def _blocks(n):
    return F.ceil(n / BLOCK).cast("bigint")


def _every(n):
    return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))


def exact_clusters(found: Clusters, cfg: ClusterConfig) -> DataFrame:
    """Rows (cluster, cluster_uid, uid): clusters in which any two members reach the cosine and nobody outside does.

    A cluster whose members all lie within half the threshold's angle of the centroid needs
    no comparison; the distinct vectors of the others are compared in blocks. What lies
    outside is compared where the balls of two leaves of different clusters come close
    enough, the distinct vectors of each pair of leaves in blocks too.
    """
    members = materialize(found.members.join(found.centroids, "cluster").select("cluster", "uid", "v", _cosine("v", "centroid").alias("c")))
    certain = math.cos(math.acos(cfg.cosine) / 2) + 1e-6
    open_ones = members.groupBy("cluster").agg(F.min("c").alias("c")).where(F.col("c") < certain).select("cluster")
    unlike = members.join(open_ones, "cluster", "left_semi").select("cluster", "v").distinct()
    unlike = materialize(unlike)
    blocks = unlike.groupBy("cluster").agg(_blocks(F.count(F.lit(1))).alias("blocks"))
    checked = unlike.join(blocks, "cluster").select("cluster", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("block"), "v", _every(F.col("blocks")).alias("with"))
    checked = checked.select("cluster", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "v")
    keys = ["cluster", "i", "j"]
    loose = checked.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_loose(cfg), "cluster bigint")

    mine = found.of_leaf.select("leaf", F.col("cluster").alias("c1"))
    theirs = found.of_leaf.select(F.col("leaf").alias("other"), F.col("cluster").alias("c2"))
    # Only clusters of several members have anything to lose.
    listed = found.centroids.select(F.col("cluster").alias("c"), F.lit(True).alias("listed"))
    apart = found.near.join(mine, "leaf").join(theirs, "other").where("c1 <> c2")
    apart = apart.join(listed.select(F.col("c").alias("c1"), F.col("listed").alias("l1")), "c1", "left").join(listed.select(F.col("c").alias("c2"), F.col("listed").alias("l2")), "c2", "left")
    apart = materialize(apart.where("l1 or l2").select("leaf", "other"))
    ends = apart.select("leaf").unionByName(apart.select(F.col("other").alias("leaf"))).distinct()
    vectors = materialize(found.leaf_points.join(ends, "leaf", "left_semi").select("leaf", "v").distinct())
    parts = vectors.groupBy("leaf").agg(_blocks(F.count(F.lit(1))).alias("blocks"))
    pairs = apart.join(parts.withColumnRenamed("blocks", "b1"), "leaf").join(parts.select(F.col("leaf").alias("other"), F.col("blocks").alias("b2")), "other")
    side = lambda at, blocks, other, first: pairs.select("leaf", "other", F.col(at).alias("at"), F.col(blocks).alias("n"), F.col(other).alias("m"), F.lit(first).alias("first"))
    sides = side("leaf", "b1", "b2", True).unionByName(side("other", "b2", "b1", False)).join(vectors.withColumnRenamed("leaf", "at"), "at")
    sides = sides.select("leaf", "other", "first", "v", F.pmod(F.xxhash64("v"), F.col("n")).alias("own"), _every(F.col("m")).alias("opposite"))
    here = lambda first: F.when(F.col("first") == first, F.col("own")).otherwise(F.col("opposite"))
    sides = sides.select("leaf", "other", here(True).alias("i"), here(False).alias("j"), "first", "v")
    keys = ["leaf", "other", "i", "j"]
    touching = sides.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_touching(cfg), "leaf bigint")
    touched = touching.distinct().join(found.of_leaf, "leaf").select("cluster")
    bad = loose.unionByName(touched).distinct()
    good = members.select("cluster", "uid").join(bad, "cluster", "left_anti")
    names = good.groupBy("cluster").agg(F.min("uid").alias("cluster_uid"))
    return good.join(names, "cluster").select("cluster", "cluster_uid", "uid")
