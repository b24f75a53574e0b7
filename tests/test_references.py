from datetime import datetime as D

from pyspark.sql import functions as F

from reelspark.operators.references import orphan_report, reference_states
from tests.conftest import rows

CHILD = "rid string, ref string, at timestamp_ntz, status string"
PARENT = "key string, at timestamp_ntz, n int"
GONE = "k string, at timestamp_ntz"


def states(spark, child, parent, gone):
    return reference_states(
        spark.createDataFrame(child, CHILD), "rid", "ref", "at", spark.createDataFrame(parent, PARENT), "key", "at", spark.createDataFrame(gone, GONE), "k", "at"
    )


def test_all_states(spark):
    parent = [("A", D(2025, 1, 1), 1), ("B", D(2025, 3, 1), 1), ("C", D(2025, 1, 1), 1), ("E", D(2025, 1, 1), 1), ("E", D(2025, 5, 1), 2), (None, D(2025, 1, 1), 1)]
    gone = [("c ", D(2025, 2, 1)), ("E", D(2025, 2, 1)), ("F", D(2025, 2, 1)), ("C", D(2025, 1, 15)), (None, D(2025, 1, 1))]
    t = D(2025, 2, 10)
    child = [
        ("1", " a", t, "x"), ("2", "b", t, None), ("3", "C", t, "x"), ("4", "zz", t, "x"), ("5", None, t, "x"), ("6", "E", t, "x"), ("7", "f ", t, "x"),
        ("2", "b", D(2025, 6, 1), "x"), ("8", "B", D(2025, 3, 1), "x"), ("9", "B", None, "x"), (None, "zz", t, "x"),
    ]
    got = rows(states(spark, child, parent, gone), "child_key", "status")
    assert got == sorted([("2", "late"), ("3", "removed"), ("4", "missing"), ("7", "removed"), (None, "missing")], key=repr)


def test_delivery_at_the_moment_of_removal_is_no_return(spark):
    t = D(2025, 2, 1)
    assert rows(states(spark, [("1", "A", t, "x")], [("A", t, 1)], [("A", t)]), "status") == [("removed",)]


def test_empty_tables(spark):
    t = D(2025, 2, 1)
    assert rows(states(spark, [], [("A", t, 1)], [])) == []
    assert rows(states(spark, [("1", "A", t, "x")], [], []), "child_key", "status") == [("1", "missing")]


def test_hot_reference_and_report(spark):
    child = [(str(i), "gone", D(2025, 1 + i % 2, 1), "x") for i in range(300)]
    found = states(spark, child, [("A", D(2025, 1, 1), 1)], [])
    assert found.count() == 300
    report = orphan_report(found.withColumn("child_table", F.lit("c")).withColumn("period", F.date_format("child_time", "yyyy-MM")))
    assert rows(report, "period", "n_records") == [("2025-01", 150), ("2025-02", 150)]
