"""The N best items of every group under a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.keys import is_finite
from reelspark.operators.positions import global_positions


def top_items(df: DataFrame, group: list[str], item: str, score: str, rank: str, n: int) -> DataFrame:
    """Rows (group..., item, score, rank, position) for the ``n`` best items of each group.

    Order: score (higher first), rank (smaller first, null last), item (smaller first). An
    item counts once per group, by its best row: repeated rows shrink in a map-side
    aggregate before anything moves. The positions come from a global range-partitioned
    sort on group, score and item whose per-partition counts are prefix-summed, so a group
    of any size spreads over many tasks. Rows with a null in the last group column, a null
    item or a non-finite score do not count; other group columns may be null. Groups with
    fewer items give fewer rows; an empty input gives none; other columns are ignored.
    """
    rows = df.select(
        *[F.col(g).alias(f"g{i}") for i, g in enumerate(group)],
        F.col(item).alias("item"),
        F.struct(
            # 0 - score sorts higher scores first and makes one zero of -0.0 and 0.0.
            (F.lit(0.0) - F.col(score).cast("double")).alias("neg"),
            F.col(rank).isNull().alias("unranked"),
            F.col(rank).alias("rank"),
        ).alias("place"),
    ).where(is_finite(F.col("place.neg")) & F.col("item").isNotNull() & F.col(f"g{len(group) - 1}").isNotNull())
    keys = [f"g{i}" for i in range(len(group))]
    best = rows.groupBy(*keys, "item").agg(F.min("place").alias("p")).select(*keys, "item", "p.neg", "p.rank")
    order = [F.col("neg").asc(), F.col("rank").asc_nulls_last(), F.col("item").asc()]
    placed = global_positions(best, keys, order, limit=n)
    return placed.select(
        *[F.col(k).alias(g) for k, g in zip(keys, group)], F.col("item").alias(item), (F.lit(0.0) - F.col("neg")).alias(score), F.col("rank").alias(rank), "position"
    )
