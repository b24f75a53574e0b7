"""Column profiles per load from mergeable states, and loads that depart from the others.

Declared checks compile into one scan per table, and their states add up: a delivery's are
appended to a store, and only new rows are ever scanned. There are two kinds.

Value states hold the count of every distinct value of a column and load. Null and invalid
rates, ranges and exact distinct counts follow by summing them; exact medians come from
running sums over a global sort, so a load never sits in one task. Their size follows the
distinct values, so they are for the columns of which exact medians are wanted.

Column states hold counts, ranges and a sketch of the distinct values, one small row for
every column and load, for columns of any type: numbers against bounds, texts against a
pattern, timestamps against a period.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.functions.keys import is_finite
from reelspark.operators.positions import global_positions
from reelspark.operators.skew import small_side
from reelspark.session import materialize

KEYS = ["table_name", "column_name", "load_id"]


@dataclass(frozen=True)
class ColumnCheck:
    """A column and its valid values.

    A number is valid if it is finite, at least ``least`` (``strict``: above it) and at most
    ``most``; a text if it holds ``pattern``, or anything but spaces where there is none; a
    timestamp within ``since`` and ``until`` (ISO texts, inclusive); other values if they are
    there. Null is never valid.
    """

    column: str
    least: float | None = 0.0
    strict: bool = False
    most: float | None = None
    pattern: str | None = None
    since: str | None = None
    until: str | None = None

    def valid(self, value: Column, kind: T.DataType = T.DoubleType()) -> Column:
        if isinstance(kind, T.NumericType):
            good = is_finite(value)
            if self.least is not None:
                good = good & ((value > self.least) if self.strict else (value >= self.least))
            return good if self.most is None else good & (value <= self.most)
        if isinstance(kind, T.StringType):
            return F.coalesce(value.rlike(self.pattern) if self.pattern else F.trim(value) != "", F.lit(False))
        good = value.isNotNull()
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            for bound, above in ((self.since, True), (self.until, False)):
                if bound is not None:
                    edge = F.lit(bound).cast(kind)
                    good = good & ((value >= edge) if above else (value <= edge))
        return F.coalesce(good, F.lit(False))


def measure(value: Column, kind: T.DataType) -> Column:
    """What the range of a column is taken of: a number, the length of a text, the seconds of a timestamp, 0 or 1."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")) / F.lit(1e6)
    if isinstance(kind, T.StringType):
        return F.length(value).cast("double")
    return F.lit(None).cast("double")


@dataclass(frozen=True)
class ControlLimits:
    """How far a load's figure may lie from the median over all loads."""

    share_above: float = 0.1
    center_factor: float = 2.0
    distinct_factor: float = 0.5


def value_states(df: DataFrame, table_name: str, checks: Sequence[ColumnCheck], load: str) -> DataFrame:
    """States (table_name, column_name, load_id, value, valid, n) of one table in one scan."""
    entries = F.array(
        *[
            F.struct(F.lit(c.column).alias("column_name"), F.col(c.column).cast("double").alias("value"), c.valid(F.col(c.column).cast("double")).alias("valid"))
            for c in checks
        ]
    )
    rows = df.select(F.col(load).alias("load_id"), F.explode(entries).alias("c"))
    return rows.groupBy(
        F.lit(table_name).alias("table_name"), F.col("c.column_name").alias("column_name"), "load_id", F.col("c.value").alias("value"), F.col("c.valid").alias("valid")
    ).agg(F.count(F.lit(1)).alias("n"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One table of value states of several: counts of equal values add up."""
    merged = states[0]
    for other in states[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy(*KEYS, "value", "valid").agg(F.sum("n").alias("n"))


def column_states(df: DataFrame, table_name: str, checks: Sequence[ColumnCheck], load: str) -> DataFrame:
    """States (KEYS, n_rows, n_null, n_valid, min_value, max_value, sketch, quantiles) of columns of any type, in one scan.

    One row per column and load, whatever the number of values. Ranges are of measure() over
    the valid values, as is the sketch of their quantiles; the other sketch estimates how
    many distinct ones there are.
    """
    figures = []
    for c in checks:
        value, kind = F.col(f"`{c.column}`"), df.schema[c.column].dataType
        valid, size = c.valid(value, kind), measure(value, kind)
        figures.append(
            F.struct(
                F.lit(c.column).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count(F.when(value.isNull(), 1)).alias("n_null"), F.count(F.when(valid, 1)).alias("n_valid"),
                F.min(F.when(valid, size)).alias("min_value"), F.max(F.when(valid, size)).alias("max_value"), F.hll_sketch_agg(F.when(valid, F.xxhash64(value))).alias("sketch"), F.kll_sketch_agg_double(F.when(valid, size)).alias("quantiles"),
            )
        )
    rows = df.groupBy(F.col(load).alias("load_id")).agg(F.array(*figures).alias("cs")).select("load_id", F.explode("cs").alias("c"))
    return rows.select(F.lit(table_name).alias("table_name"), "c.column_name", "load_id", *[f"c.{name}" for name in ("n_rows", "n_null", "n_valid", "min_value", "max_value", "sketch", "quantiles")])


def merge_column_states(*states: DataFrame) -> DataFrame:
    """One table of column states of several."""
    merged = states[0]
    for other in states[1:]:
        merged = merged.unionByName(other)
    sums = [F.sum(c).alias(c) for c in ("n_rows", "n_null", "n_valid")]
    return merged.groupBy(*KEYS).agg(*sums, F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.hll_union_agg("sketch").alias("sketch"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def absorb(path: str, *states: DataFrame) -> None:
    """Append states of newly delivered rows to the store at ``path``; nothing delivered before is read."""
    for one in states:
        one.write.mode("append").parquet(path)


def column_profile(states: DataFrame) -> DataFrame:
    """One row per column and load, fit for departing_loads(): counts, shares, range, and estimates of the distinct values and the median."""
    distinct = F.hll_sketch_estimate("sketch")
    n_set = F.col("n_rows") - F.col("n_null")
    return states.select(
        *KEYS, "n_rows", "n_null", "n_valid", distinct.alias("n_distinct"), "min_value", "max_value",
        F.try_divide(F.col("n_null").cast("double"), "n_rows").alias("null_share"), F.try_divide((n_set - F.col("n_valid")).cast("double"), n_set).alias("invalid_share"),
        F.try_divide(distinct.cast("double"), "n_valid").alias("distinct_share"),
        F.when(F.col("max_value").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("center"),
    )


def medians(states: DataFrame, counts: DataFrame) -> DataFrame:
    """Exact interpolated medians of the valid values: (KEYS, center)."""
    valid = states.where("valid").select(*KEYS, "value", "n")
    running = global_positions(valid, KEYS, [F.col("value").asc()], weight="n")
    low = F.floor((F.col("n_valid") + 1) / 2)
    high = F.floor((F.col("n_valid") + 2) / 2)
    # One row per column and load, against one per distinct value.
    sizes = small_side(counts.select(*[F.col(k).alias(f"k_{k}") for k in KEYS], "n_valid"))
    on = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in KEYS]
    hit = running.join(sizes, on).select(
        *KEYS,
        F.when((F.col("position") >= low) & (F.col("position") - F.col("n") < low), F.col("value")).alias("low"),
        F.when((F.col("position") >= high) & (F.col("position") - F.col("n") < high), F.col("value")).alias("high"),
    )
    return hit.groupBy(*KEYS).agg(((F.max("low") + F.max("high")) / 2).alias("center"))


def profile(states: DataFrame) -> DataFrame:
    """One row per column and load: counts, shares, range, exact median and distinctness.

    Shares are null where their base is empty, the range and the centre where no value is
    valid. A null load is a load of its own.
    """
    n = F.col("n")
    counts = states.groupBy(*KEYS).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), n).otherwise(0)).alias("n_null"),
        F.sum(F.when(F.col("valid"), n).otherwise(0)).alias("n_valid"),
        F.count(F.when(F.col("valid"), 1)).alias("n_distinct"),
        F.min(F.when(F.col("valid"), F.col("value"))).alias("min_value"),
        F.max(F.when(F.col("valid"), F.col("value"))).alias("max_value"),
    )
    center = medians(states, counts).select(*[F.col(k).alias(f"m_{k}") for k in KEYS], "center")
    on = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in KEYS]
    n_set = F.col("n_rows") - F.col("n_null")
    return counts.join(center, on, "left").select(
        *KEYS,
        "n_rows",
        "n_null",
        "n_valid",
        "n_distinct",
        "min_value",
        "max_value",
        "center",
        F.try_divide(F.col("n_null").cast("double"), "n_rows").alias("null_share"),
        F.try_divide((n_set - F.col("n_valid")).cast("double"), n_set).alias("invalid_share"),
        F.try_divide(F.col("n_distinct").cast("double"), "n_valid").alias("distinct_share"),
    )


def departing_loads(profiles: DataFrame, limits: ControlLimits = ControlLimits()) -> DataFrame:
    """Rows (KEYS, symptom) of the loads outside the control limits around the median load.

    The history of a column has one row per load, so its medians need no large group.
    """
    column = ["table_name", "column_name"]
    figures = ["null_share", "invalid_share", "center", "distinct_share"]
    usual = profiles.groupBy(*column).agg(*[F.percentile(f, F.lit(0.5)).alias(f"usual_{f}") for f in figures])
    joined = profiles.join(usual, column)
    symptoms = F.array(
        F.when(F.col("null_share") > F.col("usual_null_share") + limits.share_above, F.lit("nulls")),
        F.when(F.col("invalid_share") > F.col("usual_invalid_share") + limits.share_above, F.lit("invalid")),
        F.when(
            (F.col("center") > F.col("usual_center") * limits.center_factor) | (F.col("center") < F.col("usual_center") / limits.center_factor),
            F.lit("center"),
        ),
        F.when(F.col("distinct_share") < F.col("usual_distinct_share") * limits.distinct_factor, F.lit("distinct")),
    )
    return joined.select(*KEYS, F.explode(F.array_compact(symptoms)).alias("symptom"))


def profile_loads(tables: Sequence[tuple[DataFrame, str, Sequence[ColumnCheck], str]], store: str | None = None) -> DataFrame:
    """Profiles of several tables, each scanned once: (rows, name, checks, load column).

    With ``store`` the rows are a new delivery: their states are added to what the folder
    holds, and the profile is of everything absorbed so far. Without, the states live in the
    shared folder for as long as they are needed.
    """
    states = [value_states(df, name, checks, load) for df, name, checks, load in tables]
    if store is None:
        return profile(materialize(merge_states(*states)))
    absorb(store, *states)
    return profile(materialize(merge_states(states[0].sparkSession.read.parquet(store))))
