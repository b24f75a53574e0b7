"""References to records that do not exist, were removed, or arrived later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.keys import clean_key
from reelspark.operators.skew import hottest, salted_join
from reelspark.session import materialize


def reference_states(
    child: DataFrame,
    child_key: str,
    reference: str,
    child_time: str,
    parent: DataFrame,
    parent_key: str,
    parent_time: str,
    removed: DataFrame,
    removed_key: str,
    removed_time: str,
) -> DataFrame:
    """Rows (child_key, reference, status, child_time) of the references that do not hold.

    Distinct non-null references are anti-joined with the living parent keys; what
    remains is ``removed`` (a removal notice names the key and no later delivery) or
    ``missing`` (no row at all). A living parent whose earliest row came after the child
    makes the reference ``late``. Only keys with such a state are joined back to the
    children, hot keys over salted tasks.

    References and removal keys are compared after trimming spaces and upper-casing. A
    child counts once per (child_key, reference) with its earliest time; a null reference
    is no case, a null child key is kept as null. A child without any time is never late.
    Columns other than those named are ignored. Empty inputs give no rows.
    """
    children = (
        child.select(F.col(child_key).alias("child_key"), clean_key(F.col(reference)).alias("reference"), F.col(child_time).alias("t"))
        .where("reference is not null")
        .groupBy("child_key", "reference")
        .agg(F.min("t").alias("child_time"))
    )
    parents = (
        parent.select(F.col(parent_key).alias("reference"), F.col(parent_time).alias("t"))
        .where("reference is not null")
        .groupBy("reference")
        .agg(F.min("t").alias("first_at"), F.max("t").alias("last_at"))
    )
    notices = (
        removed.select(clean_key(F.col(removed_key)).alias("reference"), F.col(removed_time).alias("t"))
        .where("reference is not null")
        .groupBy("reference")
        .agg(F.max("t").alias("removed_at"), F.lit(True).alias("noticed"))
    )
    again = F.coalesce(F.col("last_at") > F.col("removed_at"), F.lit(False))
    living = parents.join(notices, "reference", "left").where(F.col("noticed").isNull() | again).select("reference", "first_at")
    wanted = children.groupBy("reference").agg(F.count(F.lit(1)).alias("n"), F.min("child_time").alias("earliest"))
    orphans = (
        wanted.join(living, "reference", "left_anti")
        .join(notices.select("reference", "noticed"), "reference", "left")
        .select("reference", "n", F.when(F.col("noticed"), "removed").otherwise("missing").alias("status"), F.lit(None).cast("timestamp_ntz").alias("first_at"))
    )
    late = wanted.join(living, "reference").where(F.col("first_at") > F.col("earliest")).select(
        "reference", "n", F.lit("late").alias("status"), F.col("first_at").cast("timestamp_ntz").alias("first_at")
    )
    flagged = materialize(orphans.unionByName(late))
    back = salted_join(children, flagged.drop("n"), ["reference"], "reference", hottest(flagged, "reference", "n"))
    holds = (F.col("status") != "late") | (F.col("first_at") > F.col("child_time").cast("timestamp_ntz"))
    return back.where(holds).select("child_key", "reference", "status", "child_time")


def orphan_report(states: DataFrame) -> DataFrame:
    """Counts of the states per table and period; expects child_table, status and period."""
    return states.groupBy("child_table", "period", "status").agg(F.count(F.lit(1)).alias("n_records"))
