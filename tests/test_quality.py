import random
from datetime import datetime
from statistics import median

from reelspark.operators.quality import ColumnCheck, absorb, column_profile, column_states, departing_loads, merge_column_states, merge_states, profile, profile_loads, value_states
from tests.conftest import rows

SCHEMA = "x double, y bigint, load_id bigint, value string"


def test_profile_equals_brute_force_and_states_merge(spark):
    rnd = random.Random(2)
    data = [(rnd.choice([None, float("nan"), -1.0, rnd.random(), round(rnd.random(), 1)]), rnd.choice([None, rnd.randrange(-2, 9)]), rnd.choice([1, 2, None]), "v") for _ in range(900)]
    df = spark.createDataFrame(data, SCHEMA)
    checks = [ColumnCheck("x"), ColumnCheck("y", strict=True)]
    whole = profile_loads([(df, "t", checks, "load_id")])
    parts = df.randomSplit([0.3, 0.7], seed=1)
    merged = profile(merge_states(*[value_states(p, "t", checks, "load_id") for p in parts]))
    assert rows(whole) == rows(merged)
    got = {(r["column_name"], r["load_id"]): r for r in whole.collect()}
    for name, i, ok in (("x", 0, lambda v: v == v and v >= 0), ("y", 1, lambda v: v > 0)):
        for load in (1, 2, None):
            values = [d[i] for d in data if d[2] == load]
            valid = [v for v in values if v is not None and ok(v)]
            r = got[name, load]
            assert (r["n_rows"], r["n_null"], r["n_valid"], r["n_distinct"]) == (len(values), values.count(None), len(valid), len(set(valid)))
            assert r["center"] == median(valid) and r["min_value"] == min(valid) and r["max_value"] == max(valid)


def test_symptoms(spark):
    good = [(float(i % 10 + 1), 1, load, "v") for load in range(1, 6) for i in range(40)]
    odd = [(None, 1, 6, "v")] * 20 + [(float("inf"), 1, 6, "v")] * 10 + [(100.0, 1, 6, "v")] * 10
    found = departing_loads(profile_loads([(spark.createDataFrame(good + odd, SCHEMA), "t", [ColumnCheck("x")], "load_id")]))
    # One distinct value among ten: a share of 0.1, below half of the usual 0.25.
    assert rows(found, "load_id", "symptom") == [(6, "center"), (6, "distinct"), (6, "invalid"), (6, "nulls")]


def test_a_load_without_values_and_an_empty_table(spark):
    df = spark.createDataFrame([(None, 1, 1, "v"), (2.0, 1, 2, "v")], SCHEMA)
    got = {r["load_id"]: r for r in profile_loads([(df, "t", [ColumnCheck("x")], "load_id")]).collect()}
    assert got[1]["center"] is None and got[1]["invalid_share"] is None and got[1]["distinct_share"] is None and got[1]["null_share"] == 1.0
    assert rows(profile_loads([(df.limit(0), "t", [ColumnCheck("x")], "load_id")])) == []


def test_only_new_rows_are_scanned_and_states_of_a_store_add_up(spark, tmp_path):
    rnd = random.Random(4)
    data = [(rnd.choice([None, -1.0, rnd.random()]), 1, rnd.choice([1, 2]), "v") for _ in range(300)]
    first, late = spark.createDataFrame(data[:200], SCHEMA), spark.createDataFrame(data[200:], SCHEMA)
    store, checks = str(tmp_path / "states"), [ColumnCheck("x")]
    profile_loads([(first, "t", checks, "load_id")], store)
    both = profile_loads([(late, "t", checks, "load_id")], store)
    assert rows(both) == rows(profile_loads([(first.unionByName(late), "t", checks, "load_id")]))
    absorb(str(tmp_path / "columns"), *[column_states(df, "t", checks, "load_id") for df in (first, late)])
    merged = column_profile(merge_column_states(spark.read.parquet(str(tmp_path / "columns"))))
    assert rows(merged.drop("n_distinct", "distinct_share", "center")) == rows(column_profile(column_states(first.unionByName(late), "t", checks, "load_id")).drop("n_distinct", "distinct_share", "center"))
    assert departing_loads(merged).isEmpty()
    exact = {r["load_id"]: r["n_distinct"] for r in both.collect()}
    assert all(abs(r["n_distinct"] - exact[r["load_id"]]) <= 0.05 * exact[r["load_id"]] + 1 for r in merged.collect())


def test_columns_of_every_type(spark):
    schema = "name string, at timestamp_ntz, seen timestamp, ok boolean, n int, tags array<string>, load_id int, table_name string"
    t = [datetime(1990, 1, 1), datetime(2020, 1, 1), None]
    data = [(["ab-1", "AB", " ", None][i % 4], t[i % 3], t[i % 3], [True, None][i % 2], [0, 5, 99][i % 3], [["a"], None][i % 2], None if i > 9 else 1, "x") for i in range(12)]
    df = spark.createDataFrame(data, schema)
    checks = [
        ColumnCheck("name", pattern="^[a-z]+-[0-9]+$"), ColumnCheck("at", since="2000-01-01"), ColumnCheck("seen", until="2000-01-01"), ColumnCheck("ok"), ColumnCheck("n", strict=True, most=50),
        ColumnCheck("tags"), ColumnCheck("table_name"),
    ]
    got = {(r["column_name"], r["load_id"]): r for r in column_profile(column_states(df, "t", checks, "load_id")).collect()}
    pick = lambda name, load=1: tuple(got[name, load][c] for c in ("n_rows", "n_null", "n_valid", "min_value", "max_value"))
    assert pick("name") == (10, 2, 3, 4.0, 4.0) and pick("at")[1:3] == (3, 3) and pick("seen")[1:3] == (3, 4)
    assert pick("ok") == (10, 5, 5, 1.0, 1.0) and pick("n") == (10, 0, 3, 5.0, 5.0) and pick("tags") == (10, 5, 5, None, None)
    assert got["table_name", None]["n_rows"] == 2 and got["name", 1]["invalid_share"] == 5 / 8
    assert rows(column_profile(column_states(df.limit(0), "t", checks, "load_id"))) == []
