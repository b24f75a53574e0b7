"""Weighted reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.schemas import ContractError


@dataclass(frozen=True)
class FusionConfig:
    """Weight of each source, and the constant added to ranks."""

    weights: Mapping[str, float]
    k: float = 60.0

    def __post_init__(self) -> None:
        if not self.weights or any(not s or not 0 < w < float("inf") for s, w in self.weights.items()):
            raise ContractError("weights must be positive and finite, sources not empty")
        if not 0 < self.k < float("inf"):
            raise ContractError("k must be positive and finite")


def source_differences(rankings: DataFrame, config: FusionConfig) -> DataFrame:
    """Rows (source, problem) of sources without weight; a weighted source may be empty."""
    return rankings.select("source").distinct().where(~F.col("source").isin(list(config.weights))).select("source", F.lit("no weight").alias("problem"))


def ranking_violations(rankings: DataFrame, by: str = "query_id", item: str = "keyframe_uid") -> DataFrame:
    """Rows (query_id, source, item, problem): repeated or empty items and ranks below 1."""
    counted = rankings.groupBy(by, "source", item).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("least"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("n") > 1, F.lit("repeated item")),
            F.when(F.coalesce(F.trim(F.col(item)), F.lit("")) == "", F.lit("empty item")),
            F.when(F.coalesce(F.col("least"), F.lit(0)) < 1, F.lit("rank below 1")),
        )
    )
    return counted.select(by, "source", item, F.explode(problems).alias("problem"))


def fuse(rankings: DataFrame, config: FusionConfig, by: str = "query_id", item: str = "keyframe_uid") -> DataFrame:
    """Rows (query_id, item, score, source_scores) with score = sum of weight / (k + rank).

    ``rankings`` has (query_id, source, item, rank, score), each item once per source.
    A source without weight is an error when the plan runs; see source_differences() and
    ranking_violations() for a report. Contributions add up in
    order of the source names, so that equal inputs give equal bits. ``source_scores``
    keeps rank, score, weight and contribution of every source.
    """
    unknown = F.raise_error(F.concat(F.lit("source without weight: "), F.coalesce("source", F.lit("null")))).cast("double")
    known = F.create_map(*[F.lit(x) for s in sorted(config.weights) for x in (s, float(config.weights[s]))])
    weight = F.coalesce(F.try_element_at(known, F.col("source")), unknown)
    part = F.struct("source", "rank", "score", weight.alias("weight"), (weight / (F.lit(config.k) + F.col("rank"))).alias("contribution"))
    named = rankings.select(by, item, part.alias("part"))
    fused = named.groupBy(by, item).agg(F.array_sort(F.collect_list("part")).alias("source_scores"))
    total = F.aggregate("source_scores", F.lit(0.0), lambda a, x: a + x["contribution"])
    return fused.select(by, item, total.alias("score"), "source_scores")


def metadata_conflicts(rows: DataFrame, item: str = "keyframe_uid", *columns: str) -> DataFrame:
    """Items for which sources disagree on ``columns``."""
    names = columns or ("video_id", "original_frame_id", "timestamp_sec")
    known = rows.select(item, F.struct(*names).alias("m")).distinct()
    return known.groupBy(item).agg(F.count(F.lit(1)).alias("n_versions")).where("n_versions > 1")
