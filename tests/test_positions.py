import random

from pyspark.sql import functions as F

from reelspark.operators.positions import global_positions
from reelspark.operators.sequence import numeric_profile, previous_value
from reelspark.operators.skew import hottest, salted_join
from tests.conftest import rows


def test_positions_equal_a_sort_whatever_the_group_size(spark):
    rnd = random.Random(1)
    data = [("big" if rnd.random() < 0.7 else rnd.choice(["a", "b", None]), rnd.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, x int, id int")
    out = global_positions(df, ["g"], [F.col("x").desc(), F.col("id").asc()], partitions=9)
    expected = []
    for g in {d[0] for d in data}:
        part = sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2]))
        expected += [(*d, i + 1) for i, d in enumerate(part)]
    assert rows(out) == sorted(expected, key=repr)
    few = global_positions(df, ["g"], [F.col("x").desc(), F.col("id").asc()], limit=3, partitions=9)
    assert rows(few) == sorted((e for e in expected if e[3] <= 3), key=repr)


def test_weights_give_running_sums_and_empty_input_no_rows(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(100)], "g string, x int, w int")
    got = {r["x"]: r["position"] for r in global_positions(df, ["g"], [F.col("x").asc()], weight="w", partitions=5).collect()}
    total = 0
    for i in range(100):
        total += i % 3
        assert got[i] == total
    assert rows(global_positions(df.limit(0), ["g"], [F.col("x").asc()])) == []


def test_previous_value_crosses_ranges(spark):
    data = [("a", i, i * 2) for i in range(0, 50, 3)] + [("b", 7, 1), (None, 1, 1), ("a", None, 9)]
    out = previous_value(spark.createDataFrame(data, "g string, i bigint, v bigint"), "g", "i", "v", width=5)
    got = {(r["g"], r["i"]): r["previous"] for r in out.collect()}
    assert got[("a", 0)] is None and all(got[("a", i)] == (i - 3) * 2 for i in range(3, 50, 3))
    assert got[("b", 7)] is None and got[(None, 1)] is None and got[("a", None)] is None


def test_numeric_profile_interpolates(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)] + [(float("nan"),), (None,)], "x double")
    r = numeric_profile(df, ["x"]).collect()[0]
    assert (r["n_values"], r["min_value"], r["mean_value"], r["max_value"], r["p50"]) == (4, 1.0, 2.5, 4.0, 2.5)
    assert abs(r["p10"] - 1.3) < 1e-12 and abs(r["p95"] - 3.85) < 1e-12


def test_salted_join_equals_a_join(spark):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 7}", i) for i in range(500)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k9", 3)], "k string, v int")
    hot = hottest(left.groupBy("k").count(), "k", "count", least=100)
    assert hot == ["hot"]
    expected = rows(left.join(right, "k").select("k", "i", "v"))
    assert rows(salted_join(left, right, ["k"], "k", hot).select("k", "i", "v")) == expected
    mapped = left.withColumn("m", F.create_map("k", "i"))
    assert rows(salted_join(mapped, right, ["k"], "k", hot).select("k", "i", "v")) == expected
