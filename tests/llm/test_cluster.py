import random

import numpy as np
from pyspark.sql import functions as F

from reelspark.llm.cftree import CFTree, agglomerate, ward
from reelspark.llm.cluster import ClusterConfig, exact_clusters, similar_clusters, typical_members
from tests.conftest import rows

SCHEMA = "k string, e array<float>, leaf string, cluster string"


def unit(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clouds(rng, dim, n_clusters, size, spread):
    out = []
    for c in unit(rng, n_clusters, dim):
        x = c + rng.normal(size=(size, dim)) * spread
        out.append(x / np.linalg.norm(x, axis=1, keepdims=True))
    return out


def brute(vectors, cosine):
    names = sorted(vectors)
    m = np.array([np.array(vectors[n], np.float32) for n in names], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= cosine - 1e-7
    out = set()
    for i in range(len(names)):
        group = np.flatnonzero(near[i])
        if len(group) > 1 and near[np.ix_(group, group)].all() and all((np.flatnonzero(near[j]) == group).all() if near[j].sum() == len(group) else False for j in group):
            out |= {(names[group[0]], names[j]) for j in group[1:]}
    return sorted(out)


def test_tree_features_sum_up_and_radii_bound():
    rng = np.random.default_rng(1)
    x = np.concatenate([*clouds(rng, 8, 12, 30, 0.03), unit(rng, 200, 8)])
    tree = CFTree(8, 0.22)
    leaf = np.array([tree.insert(v) for v in x])
    n, total, radius = tree.features()
    for i in range(len(n)):
        mine = x[leaf == i]
        assert len(mine) == n[i] and np.allclose(mine.sum(0), total[i])
        assert np.linalg.norm(mine - total[i] / n[i], axis=1).max() <= radius[i] + 1e-9
    small = CFTree(8, 0.22, budget=40)
    for v in x:
        small.insert(v)
    n2, total2, _ = small.features()
    assert len(n2) <= 40 and n2.sum() == len(x) and np.allclose(total2.sum(0), x.sum(0))


def test_ward_and_agglomeration():
    rng = np.random.default_rng(2)
    parts = clouds(rng, 16, 5, 20, 0.02)
    x = np.concatenate(parts)
    label = ward(np.ones(100), x, 5)
    assert all(len(set(label[i * 20 : i * 20 + 20])) == 1 for i in range(5)) and len(set(label)) == 5
    joined = agglomerate(np.ones(100), x, 0.9)
    assert len(set(joined)) == 5 and all((joined[i * 20 : i * 20 + 20] == i * 20).all() for i in range(5))
    a = np.array([[1.0, 0, 0], [np.cos(0.4), np.sin(0.4), 0], [np.cos(0.8), np.sin(0.8), 0]])
    assert len(set(agglomerate(np.ones(3), a, 0.9))) == 2


def _frame(spark, vectors, extra=()):
    data = [(k, None if v is None else [float(x) for x in v], "x", "y") for k, v in vectors.items()] + list(extra)
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def test_exact_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = {}
    for i, cloud in enumerate(clouds(rng, 24, 40, 6, 0.04) + clouds(rng, 24, 12, 3, 0.075) + clouds(rng, 24, 1, 60, 0.02)):
        vectors |= {f"c{i:02}_{j:02}": v * rng.uniform(0.5, 3) for j, v in enumerate(cloud)}
    vectors |= {f"s{i:03}": v for i, v in enumerate(unit(rng, 300, 24))}
    bad = [("z1", None, "", ""), ("z2", [0.0] * 24, "", ""), ("z3", [1.0] * 5, "", ""), ("z4", [float("nan")] + [1.0] * 23, "", ""), ("z5", [None] + [1.0] * 23, "", ""), (None, [1.0] * 24, "", ""), ("c00_00", [float(x) for x in vectors["c00_00"]], "", "")]
    cfg = ClusterConfig(24, 0.9, cell_leaves=60, probes=4)
    found = similar_clusters(_frame(spark, vectors, bad), "k", "e", cfg)
    got = rows(exact_clusters(found, cfg).where("uid <> cluster_uid"), "cluster_uid", "uid")
    assert got == brute(vectors, 0.9) and len(got) > 250
    typical = typical_members(found, 2)
    assert typical.groupBy("cluster_uid").count().where("count <> 2").isEmpty()
    big = typical.where("size = 60").orderBy("place").collect()
    assert len(big) == 2 and big[0]["cosine"] >= big[1]["cosine"]


def test_chains_and_neighbours_are_no_exact_clusters(spark):
    angle = lambda t: [np.cos(t), np.sin(t), 0.0, 0.0]
    vectors = {"a": angle(0.0), "b": angle(0.4), "c": angle(0.8), "d": [0, 0, 1.0, 0.0], "e": [0, 0, 1.0, 0.1], "f": [0, 0.0, -1.0, 0.0]}
    cfg = ClusterConfig(4, 0.9)
    assert rows(exact_clusters(similar_clusters(_frame(spark, vectors), "k", "e", cfg), cfg).where("uid <> cluster_uid"), "cluster_uid", "uid") == [("d", "e")]


def test_one_crowd_of_equal_vectors_and_an_empty_table(spark):
    vectors = {f"k{i:04}": [1.0, 2.0, 3.0] for i in range(700)} | {"o": [-1.0, 0.0, 0.5]}
    cfg = ClusterConfig(3, 0.9)
    found = similar_clusters(_frame(spark, vectors), "k", "e", cfg)
    assert exact_clusters(found, cfg).agg(F.min("cluster_uid"), F.count(F.lit(1))).collect()[0] == ("k0000", 700)
    empty = similar_clusters(_frame(spark, vectors).limit(0), "k", "e", cfg)
    assert rows(exact_clusters(empty, cfg)) == [] and rows(typical_members(empty)) == []
