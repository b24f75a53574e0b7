"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.session import materialize, parallelism

#: Rows that a side may have to be sent to all tasks.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame) -> DataFrame:
    """A summary for the small side of a join: sent to all tasks if it is small, else joined by key.

    The summary is written and counted first, so its size is known, not estimated.
    """
    known = materialize(df)
    return F.broadcast(known) if known.count() <= BROADCAST_ROWS else known


def hottest(counts: DataFrame, key: str, n: str, least: int = 100_000) -> list:
    """The keys with more than a task's share of all rows (and more than ``least``), from a table of counts per key.

    There cannot be more of them than tasks, so the list fits the driver; any other key adds
    at most a task's share to a task.
    """
    total = counts.agg(F.sum(n)).collect()[0][0] or 0
    share = max(least, total / parallelism(counts))
    return [row[0] for row in counts.where(F.col(key).isNotNull() & (F.col(n) > share)).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot_on: str, hot: list, salts: int = 64) -> DataFrame:
    """Inner join on ``keys``; rows of ``left`` whose ``hot_on`` is hot spread over ``salts`` tasks.

    The rows of ``right`` for a hot key are repeated per salt, so ``right`` should have few
    rows per key. Without hot keys this is a plain join.
    """
    if not hot:
        return left.join(right, keys)
    is_hot = F.col(hot_on).isin(hot)
    # A hash of the row, not a random number: a task that runs again must salt alike.
    # Maps cannot be hashed; the other columns tell rows apart.
    plain = [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in plain]), F.lit(salts)).cast("int")
    spread = left.withColumn("__salt", F.when(is_hot, salt).otherwise(F.lit(0)))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.withColumn("__salt", F.explode(every))
    return spread.join(repeated, [*keys, "__salt"]).drop("__salt")
