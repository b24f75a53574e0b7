import random

from reelspark.operators.intervals import periods_and_gaps
from tests.conftest import rows

SCHEMA = "v string, s bigint, t bigint"


def brute(data):
    out = []
    for v in {d[0] for d in data if d[0] is not None}:
        spans = sorted((s, t) for w, s, t in data if w == v and s is not None and t is not None and s < t)
        merged = []
        for s, t in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out += [(v, "period", s, t) for s, t in merged]
        out += [(v, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=repr)


def test_random_spans_over_many_cells_equal_brute_force(spark):
    rnd = random.Random(3)
    data = []
    for _ in range(3000):
        v, s = rnd.choice("ABCDE"), rnd.randrange(0, 6000)
        data.append((v, s, s + rnd.choice([1, 2, 5, 40, 400, 2500 if rnd.random() < 0.02 else 3])))
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    assert rows(periods_and_gaps(df, "v", "s", "t", cell_ms=100, fan_in=2)) == brute(data)


def test_sparse_spans_leave_gaps(spark):
    rnd = random.Random(5)
    data = [(rnd.choice("AB"), s := rnd.randrange(0, 100_000), s + rnd.randrange(1, 50)) for _ in range(400)]
    df = spark.createDataFrame(data, SCHEMA)
    for cell in (7, 1000, 10**9):
        assert rows(periods_and_gaps(df, "v", "s", "t", cell_ms=cell)) == brute(data)


def test_touching_nested_and_equal_spans_are_one_period(spark):
    data = [("A", 0, 10), ("A", 10, 20), ("A", 2, 3), ("A", 0, 10), ("A", 30, 31)]
    found = rows(periods_and_gaps(spark.createDataFrame(data, SCHEMA), "v", "s", "t"))
    assert found == [("A", "gap", 20, 30), ("A", "period", 0, 20), ("A", "period", 30, 31)]


def test_a_span_over_many_cells_absorbs_what_starts_inside(spark):
    data = [("A", 0, 1000), ("A", 150, 160), ("A", 990, 1010), ("A", 1500, 1501)]
    found = rows(periods_and_gaps(spark.createDataFrame(data, SCHEMA), "v", "s", "t", cell_ms=100))
    assert found == [("A", "gap", 1010, 1500), ("A", "period", 0, 1010), ("A", "period", 1500, 1501)]


def test_nulls_reversed_spans_other_columns_and_empty_input(spark):
    data = [(None, 0, 1, "x"), ("A", None, 1, "x"), ("A", 0, None, "x"), ("A", 5, 5, "x"), ("A", 9, 2, "x"), ("A", 1, 2, None)]
    df = spark.createDataFrame(data, "v string, s bigint, t bigint, cell string").withColumnRenamed("cell", "starts")
    assert rows(periods_and_gaps(df, "v", "s", "t")) == [("A", "period", 1, 2)]
    assert rows(periods_and_gaps(df.limit(0), "v", "s", "t")) == []


def test_one_entity_with_most_rows(spark):
    data = [("hot", i * 3 % 50_000, i * 3 % 50_000 + 2) for i in range(20_000)] + [("cold", 1, 2)]
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    assert rows(periods_and_gaps(df, "v", "s", "t", cell_ms=500)) == brute(data)
