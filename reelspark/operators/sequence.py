"""Neighbours in an order and exact quantiles, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reelspark.functions.keys import is_finite
from reelspark.operators.positions import global_positions
from reelspark.operators.skew import small_side


def previous_value(df: DataFrame, group: str, index: str, value: str, width: int = 4_096) -> DataFrame:
    """``df`` with ``previous``: the value of the row before in the same group by (index, value).

    ``index`` is a whole number. Rows are ordered within index ranges of ``width``; the
    last value of each range, one row per range, is carried to the next one. Rows with a
    null group or index get no previous value and are nobody's.
    """
    known = df.where(F.col(group).isNotNull() & F.col(index).isNotNull()).withColumn("__cell", F.floor(F.col(index) / width))
    cell = W.Window.partitionBy(group, "__cell").orderBy(index, value)
    inside = known.withColumn("__prev", F.lag(value).over(cell)).withColumn("__first", F.row_number().over(cell) == 1)
    last = known.groupBy(group, "__cell").agg(F.max(F.struct(index, value))[value].alias("__last"))
    carried = last.select(group, "__cell", F.lag("__last").over(W.Window.partitionBy(group).orderBy("__cell")).alias("__carry"))
    joined = inside.join(carried, [group, "__cell"])
    out = joined.select(*df.columns, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__prev")).alias("previous"))
    rest = df.where(F.col(group).isNull() | F.col(index).isNull())
    return out.unionByName(rest.withColumn("previous", F.lit(None).cast(df.schema[value].dataType)))


def numeric_profile(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Per column (and group): count, min, mean, p10, p50, p90, p95, max of the finite values.

    Quantiles are exact, interpolated linearly between neighbours. Equal values are counted
    first; a global sort of the distinct values gives their ranks, so neither a column nor
    a group has to fit one task.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    keys = [*group, "column_name"]
    rows = df.select(*group, F.explode(entries).alias("e")).select(*group, "e.column_name", "e.value")
    counts = rows.where(is_finite(F.col("value"))).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    running = global_positions(counts, keys, [F.col("value").asc()], weight="n")
    totals = running.groupBy(*keys).agg(
        F.sum("n").alias("n_values"), F.min("value").alias("min_value"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean_value"), F.max("value").alias("max_value")
    )
    marks = {"p10": 0.10, "p50": 0.50, "p90": 0.90, "p95": 0.95}
    renamed = totals.select(*[F.col(k).alias(f"t_{k}") for k in keys], *[c for c in totals.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys]
    placed = running.join(small_side(renamed), same)

    def at(rank: Column) -> Column:
        return F.when((F.col("position") > rank) & (F.col("position") - F.col("n") <= rank), F.col("value"))

    def quantile(p: float) -> Column:
        exact = F.lit(p) * (F.col("n_values") - 1)
        low, high = F.max(at(F.floor(exact))), F.max(at(F.ceil(exact)))
        return low + (high - low) * (F.max(exact) - F.floor(F.max(exact)))

    firsts = [F.max(c).alias(c) for c in ("n_values", "min_value", "mean_value", "max_value")]
    return placed.groupBy(*keys).agg(*firsts, *[quantile(p).alias(name) for name, p in marks.items()])
