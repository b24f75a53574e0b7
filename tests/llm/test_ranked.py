import random

from reelspark.llm.nearest import nearest_in_time
from reelspark.llm.rankmerge import leaders, merged_ranking
from reelspark.llm.topn import top_items
from tests.conftest import rows

TOP = "q string, v string, k string, score double, rank int, item string, position string"


def test_top_items_with_ties_repeats_nulls_and_a_hot_group(spark):
    rnd = random.Random(1)
    data = []
    for i in range(4000):
        hot = rnd.random() < 0.5
        data.append((
            "h" if hot else rnd.choice(["a", "b", None]), "V" if hot else rnd.choice(["V", "W", None]), rnd.choice([None, *[f"k{i}" for i in range(60)]]),
            rnd.choice([None, float("nan"), float("inf"), -0.0, 0.0, 0.5, 0.25, rnd.random()]), rnd.choice([None, 1, 2, 3]), "x", None,
        ))
    best = {}
    for q, v, k, s, r, *_ in data:
        if v is None or k is None or s is None or s != s or s in (float("inf"), float("-inf")):
            continue
        key = (-s + 0.0, r is None, r or 0)
        best.setdefault((q, v), {})[k] = min(key, best.get((q, v), {}).get(k, key))
    expected = []
    for (q, v), items in best.items():
        order = sorted(items, key=lambda k: (items[k], k))
        expected += [(q, v, k, i + 1) for i, k in enumerate(order[:3])]
    got = top_items(spark.createDataFrame(data, TOP).repartition(6), ["q", "v"], "k", "score", "rank", 3)
    assert rows(got, "q", "v", "k", "position") == sorted(expected, key=repr)
    assert rows(top_items(spark.createDataFrame([], TOP), ["q", "v"], "k", "score", "rank", 3)) == []


SCORES = "query_id string, source string, item_id string, rank int, score double, weight string"
WEIGHTS = "source string, weight double"


def brute(data, weights):
    lists = {}
    for q, s, i, r, x, _ in data:
        if None in (q, s, i) or not weights.get(s):
            continue
        x = None if x is None or x != x else x
        old = lists.setdefault(q, {}).setdefault(s, {}).get(i)
        new = (r is None, r or 0, x is None, x or 0.0, r, x)
        lists[q][s][i] = min(old, new) if old else new
    out = {}
    for q, sources in lists.items():
        places = {}
        for s, items in sources.items():
            both = [(e[4], e[5]) for e in items.values() if e[4] is not None and e[5] is not None]
            mr, mx = sum(r for r, _ in both) / max(len(both), 1), sum(x for _, x in both) / max(len(both), 1)
            sign = 1 if sum((r - mr) * (x - mx) for r, x in both) > 1e-12 else -1
            scored = sorted(e[5] * sign for e in items.values() if e[5] is not None)
            got = {i: float(scored.index(e[5] * sign) + 1) if e[5] is not None else float(e[4]) for i, e in items.items() if e[4] is not None or e[5] is not None}
            if got:
                places[s] = got
        ranks = {}
        for i in {i for p in places.values() for i in p}:
            entries = sorted((p.get(i, max(max(p.values()), len(p)) + 1), weights[s]) for s, p in places.items())
            total = sum(w for _, w in entries)
            seen, median = 0.0, None
            for r, w in entries:
                seen += w
                if median is None and seen * 2 >= total * (1 - 1e-9):
                    median = r
            ranks[i] = (median, round(sum(r * w for r, w in entries) / total, 9), i)
        out[q] = sorted(ranks.values())
    return out


def test_merged_ranking_equals_brute_force(spark):
    rnd = random.Random(6)
    weights = {"a": 1.0, "b": 0.5, "c": 0.25, "none": 0.0}
    data = []
    for q in ("q1", "q2", None):
        for s, direction in (("a", -1), ("b", 1), ("c", -1), ("none", 1), ("other", 1)):
            for n, i in enumerate(rnd.sample([f"i{j}" for j in range(30)], 20)):
                data.append((q, s, i, n + 1 if rnd.random() < 0.9 else None, float(direction) * (n + rnd.choice([0, 1, rnd.random() / 2])) * 100 if rnd.random() < 0.9 else rnd.choice([None, float("nan")]), "x"))
    data += rnd.sample(data, 40)
    df = spark.createDataFrame(data, SCORES)
    w = spark.createDataFrame([*weights.items(), ("a", None), (None, 1.0)], WEIGHTS)
    expected = brute(data, weights)
    # The way for queries of any size gives the same: q1 alone, and both.
    more = df.unionByName(spark.createDataFrame([("q1", "other", f"o{i}", None, 1.0, "x") for i in range(400)], SCORES))
    for table, least in ((df, 100_000), (more, 150), (df, 1)):
        got = {}
        for r in merged_ranking(table, w, least).collect():
            got.setdefault(r["query_id"], {})[r["position"]] = (r["median_rank"], r["mean_rank"], r["item_id"])
        assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == expected
        assert dict(rows(leaders(table, w, least))) == {q: v[0][2] for q, v in expected.items()}


def test_wide_scales_do_not_dominate_and_empty_inputs(spark):
    data = [("q", s, i, r, float(x), None) for s, vals in (("a", (3, 2, 1)), ("b", (3, 2, 1)), ("c", (1, 2, 10**9))) for r, (i, x) in enumerate(sorted(zip("xyz", vals), key=lambda t: -t[1]), 1)]
    df, w = spark.createDataFrame(data, SCORES), spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], WEIGHTS)
    assert rows(leaders(df, w)) == [("q", "x")]
    assert rows(merged_ranking(df.limit(0), w)) == [] and rows(leaders(df, w.limit(0))) == []
    same = spark.createDataFrame([("q", s, i, None, 1.0, None) for s in "ab" for i in "xyz"], SCORES)
    assert rows(merged_ranking(same, w), "item_id", "median_rank", "position") == [("x", 1.0, 1), ("y", 1.0, 2), ("z", 1.0, 3)]


PROBE = "probe_id string, entity string, time bigint, bucket string, target_id string"
TARGET = "target_id string, entity string, time bigint, at string"


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(7)
    probes = [(rnd.choice([None, f"p{i}"]), rnd.choice(["A", "B", None]), rnd.choice([None, rnd.randrange(-50, 3000)]), "x", "y") for i in range(600)]
    probes += rnd.sample(probes, 50)
    targets = [(rnd.choice([None, f"t{i:03}"]), rnd.choice(["A", "B", "C", None]), rnd.choice([None, rnd.randrange(0, 3000)]), "z") for i in range(300)]
    expected = []
    for p, e, t, *_ in set(probes):
        near = [(abs(t - u), k) for k, f, u, _ in targets if e is not None and t is not None and k is not None and f == e and u is not None and abs(t - u) <= 20]
        if near:
            d, k = min(near)
            expected.append((p, k, d))
    got = nearest_in_time(spark.createDataFrame(probes, PROBE), spark.createDataFrame(targets, TARGET), 20)
    assert rows(got, "probe_id", "target_id", "distance") == sorted(expected, key=repr)


def test_nearest_ties_tolerance_and_empty_sides(spark):
    p = spark.createDataFrame([("p", "A", 10, "", "")], PROBE)
    t = spark.createDataFrame([("b", "A", 6, ""), ("a", "A", 14, ""), ("c", "A", 15, "")], TARGET)
    assert rows(nearest_in_time(p, t, 4)) == [("p", "a", 4)] and rows(nearest_in_time(p, t, 3)) == []
    assert rows(nearest_in_time(p.limit(0), t, 4)) == [] and rows(nearest_in_time(p, t.limit(0), 4)) == []
    many = spark.createDataFrame([(f"p{i}", "A", 10, "", "") for i in range(500)], PROBE)
    assert nearest_in_time(many, t, 4).count() == 500
