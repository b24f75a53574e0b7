"""One ranking from several differently-scaled scores: weighted median rank.

Queries are independent and one exchange by query is all they need. Queries that hold more
than a task's share of the rows take another way to the same result: their ranks come from
exact positions of a global sort, and their joins are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reelspark.functions.keys import is_finite
from reelspark.operators.positions import global_positions
from reelspark.operators.skew import hottest, salted_join, small_side
from reelspark.session import materialize, parallelism


def _weighted(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows that count, with the weight of their source."""
    good = weights.where(is_finite(F.col("weight")) & (F.col("weight") > 0) & F.col("source").isNotNull())
    good = good.groupBy("source").agg(F.max(F.col("weight").cast("double")).alias("weight"))
    score = F.when(is_finite(F.col("score")), F.col("score").cast("double"))
    rows = scores.select("query_id", "source", "item_id", F.col("rank").cast("double").alias("rank"), score.alias("score"))
    return rows.where("query_id is not null and source is not null and item_id is not null").join(small_side(good), "source")


def _once(rows: DataFrame) -> DataFrame:
    """Repeated rows count once: the lowest rank, then the lowest score."""
    first = F.min(F.struct(F.col("rank").isNull().alias("none"), "rank", F.col("score").isNull().alias("noscore"), "score")).alias("r")
    return rows.groupBy("query_id", "source", "item_id").agg(first, F.max("weight").alias("weight")).select("query_id", "source", "item_id", "weight", "r.rank", "r.score")


def _direction(covariance):
    """1 where lower scores are better: where they grow with the delivered ranks."""
    return F.when(covariance > 0, 1.0).otherwise(-1.0)


def _ranked_in_place(rows: DataFrame) -> DataFrame:
    """Ranks of queries that fit a task; everything follows from one exchange by query."""
    by_list = W.Window.partitionBy("query_id", "source")
    sign = _direction(F.covar_samp("rank", "score").over(by_list))
    oriented = _once(rows.repartition(parallelism(rows), "query_id")).withColumn("oriented", F.col("score") * sign)
    place = F.rank().over(by_list.orderBy(F.col("oriented").asc_nulls_last())).cast("double")
    return oriented.select("query_id", "source", "item_id", F.when(F.col("score").isNotNull(), place).otherwise(F.col("rank")).alias("place"), "weight").where("place is not null")


def _ranked_apart(rows: DataFrame) -> DataFrame:
    """The same for queries of any size: distinct scores get exact positions, and items come back to them."""
    once = materialize(_once(rows))
    name = F.to_json(F.struct("query_id", "source")).alias("list")
    lists = once.groupBy("query_id", "source").agg(F.covar_samp("rank", "score").alias("c"), F.count(F.lit(1)).alias("n"))
    towards = materialize(lists.select(name, _direction(F.col("c")).alias("sign"), "n"))
    scored = salted_join(once.where("score is not null").select("*", name), towards.drop("n"), ["list"], "list", hottest(towards, "list", "n"))
    scored = materialize(scored.withColumn("oriented", F.col("score") * F.col("sign")).select("query_id", "source", "item_id", "weight", "oriented"))
    levels = scored.groupBy("query_id", "source", "oriented").agg(F.count(F.lit(1)).alias("n"))
    placed = global_positions(levels, ["query_id", "source"], [F.col("oriented").asc()], weight="n")
    level = F.to_json(F.struct("query_id", "source", "oriented")).alias("level")
    shared = materialize(placed.select(level, (F.col("position") - F.col("n") + 1).cast("double").alias("place"), "n"))
    ranked = salted_join(scored.select("*", level), shared.drop("n"), ["level"], "level", hottest(shared, "level", "n"))
    given = once.where("score is null and rank is not null").select("query_id", "source", "item_id", F.col("rank").alias("place"), "weight")
    return ranked.select("query_id", "source", "item_id", "place", "weight").unionByName(given)


def _behind():
    """A source ranks an item it lacks just behind its last place."""
    return F.greatest(F.max("place"), F.count(F.lit(1)).cast("double")) + 1


def _medians(items: DataFrame) -> DataFrame:
    """Rows (query_id, item_id, median_rank, mean_rank, n_sources) from ``sources`` of the query and what the item ``has``."""
    ranked = F.array_sort(F.transform("sources", lambda s: F.struct(F.coalesce(F.try_element_at(F.col("has"), s["source"]), s["behind"]).alias("r"), s["weight"].alias("w"))))
    rows = items.select("query_id", "item_id", ranked.alias("ranked"), F.size("has").cast("bigint").alias("n_sources"))
    rows = rows.withColumn("total", F.aggregate("ranked", F.lit(0.0), lambda a, x: a + x["w"]))
    median = F.aggregate(
        "ranked",
        F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("m")),
        lambda a, x: F.struct(
            (a["w"] + x["w"]).alias("w"),
            F.coalesce(a["m"], F.when((a["w"] + x["w"]) * 2 >= F.col("total") * (1 - 1e-9), x["r"])).alias("m"),
        ),
    )["m"]
    mean = F.aggregate("ranked", F.lit(0.0), lambda a, x: a + x["w"] * x["r"]) / F.col("total")
    return rows.select("query_id", "item_id", median.alias("median_rank"), F.round(mean, 9).alias("mean_rank"), "n_sources")


def _medians_in_place(places: DataFrame) -> DataFrame:
    by_list, by_query = W.Window.partitionBy("query_id", "source"), W.Window.partitionBy("query_id")
    rows = places.withColumn("behind", F.greatest(F.max("place").over(by_list), F.count(F.lit(1)).over(by_list).cast("double")) + 1)
    # As many entries per query and per item as there are weighted sources.
    rows = rows.withColumn("sources", F.collect_set(F.struct("source", "weight", "behind")).over(by_query))
    items = rows.groupBy("query_id", "item_id").agg(F.first("sources").alias("sources"), F.map_from_entries(F.collect_list(F.struct("source", "place"))).alias("has"))
    return _medians(items)


def _medians_apart(places: DataFrame) -> DataFrame:
    lists = places.groupBy("query_id", "source").agg(F.max("weight").alias("weight"), _behind().alias("behind"), F.count(F.lit(1)).alias("n"))
    per_query = lists.groupBy("query_id").agg(F.collect_list(F.struct("source", "weight", "behind")).alias("sources"), F.sum("n").alias("n"))
    items = places.groupBy("query_id", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "place"))).alias("has"))
    per_query = materialize(per_query)
    return _medians(salted_join(items, per_query.drop("n"), ["query_id"], "query_id", hottest(per_query, "query_id", "n")))


def _parts(scores: DataFrame, weights: DataFrame, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Median ranks of the queries that fit a task, and of those that do not, if there are any."""
    # One row per query, written so that the scores are counted once.
    hot = hottest(materialize(scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))), "query_id", "n", least)
    rows = _weighted(scores, weights)
    if not hot:
        return _medians_in_place(_ranked_in_place(rows)), None
    is_hot = F.col("query_id").isin(hot)
    return _medians_in_place(_ranked_in_place(rows.where(~is_hot))), _medians_apart(_ranked_apart(rows.where(is_hot)))


_ORDER = ("median_rank", "mean_rank", "item_id")


def merged_ranking(scores: DataFrame, weights: DataFrame, least: int = 100_000) -> DataFrame:
    """Every query's combined ranking (query_id, item_id, median_rank, mean_rank, n_sources, position).

    Every item's rank in each source comes from its score there; equal scores share the better
    rank. The direction of a list is the one in which its scores and delivered ranks agree
    (higher is better where nothing tells); the delivered rank itself counts only where the
    score is missing. An item with neither is treated as absent, and a source of the query
    that lacks an item ranks it just behind its last place. Sources without any item for a
    query do not count in it. The weighted median is the lowest rank at which the weights up
    to it reach half of all weights; then the weighted mean rank decides, then the item.

    Repeated rows count once (lowest rank, then lowest score, first); rows without query,
    source or item do not count, nor do sources whose weight is missing, non-finite or not
    positive. Other columns are ignored; empty tables give no rows. Queries of more than
    ``least`` rows and a task's share are ranked by a global sort.
    """
    small, large = _parts(scores, weights, least)
    out = small.withColumn("position", F.row_number().over(W.Window.partitionBy("query_id").orderBy(*_ORDER)).cast("bigint"))
    return out if large is None else out.unionByName(global_positions(large, ["query_id"], [F.col(c).asc() for c in _ORDER]))


def leaders(scores: DataFrame, weights: DataFrame, least: int = 100_000) -> DataFrame:
    """The item that leads each query's combined ranking, without sorting it; see merged_ranking()."""
    small, large = _parts(scores, weights, least)
    ranks = small if large is None else small.unionByName(large)
    best = ranks.groupBy("query_id").agg(F.min(F.struct(*_ORDER)).alias("b"))
    return best.select("query_id", "b.item_id")
