"""Temporal suppression of near candidates and aggregation to videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reelspark.operators.greedy import keep_apart
from reelspark.operators.positions import global_positions


def order_key(score: str = "score", rank: str = "rank", uid: str = "keyframe_uid") -> Column:
    """The preference among candidates: higher score, lower rank, smaller key."""
    return F.struct((F.lit(0.0) - F.col(score)).alias("neg"), F.col(rank).alias("rank"), F.col(uid).alias("uid"))


def rerank(df: DataFrame, *order: Column, by: str = "query_id", limit: int | None = None) -> DataFrame:
    """``rank`` anew from 1 in each query.

    With ``limit`` only the first rows, pruned before the exchange; without, positions of a
    global sort, so that a query may have any number of rows.
    """
    if limit is None:
        return global_positions(df, [by], list(order)).withColumn("rank", F.col("position").cast("int")).drop("position")
    return df.withColumn("rank", F.row_number().over(W.Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= limit)


def temporal_nms(candidates: DataFrame, window_sec: float, limit: int | None = None, by: str = "query_id") -> DataFrame:
    """Candidates (query_id, video_id, keyframe_uid, timestamp_sec, score, rank) without near ones.

    In order of preference a candidate stays unless one that stayed lies within
    ``window_sec`` (inclusive) in the same video; a window of 0 still removes equal times.
    Suppression never crosses videos, so each (query, video) is a stream of its own, over
    the best candidate of each distinct time: it is bounded by the frames of a video, not by
    its candidates. Candidates without a video or a finite time are dropped.
    """
    if window_sec < 0 or (limit is not None and limit < 1):
        raise ValueError("the window must not be negative, the limit at least 1")
    good = F.col("video_id").isNotNull() & (F.abs("timestamp_sec") < float("inf")) & ~F.isnan("timestamp_sec")
    best = candidates.where(good).groupBy(by, "video_id", "timestamp_sec").agg(F.min(order_key()).alias("k"))
    rows = best.select(by, "video_id", F.col("k.uid").alias("keyframe_uid"), "timestamp_sec", (F.lit(0.0) - F.col("k.neg")).alias("score"), F.col("k.rank").alias("old_rank"))
    order = [F.desc("score"), F.col("old_rank"), F.col("keyframe_uid")]
    kept = keep_apart(rows, [by, "video_id"], order, "timestamp_sec", window_sec)
    return rerank(kept, *order, by=by, limit=limit).drop("old_rank")


def aggregate_videos(candidates: DataFrame, method: str = "max", top_m: int = 3, limit: int | None = None, by: str = "query_id") -> DataFrame:
    """Videos (query_id, rank, video_id, score, best_keyframe_uid, contributing_keyframes).

    ``max`` takes the best score, ``mean_top_m`` the mean of the best ``top_m`` (or of all,
    if fewer).
    """
    if method not in ("max", "mean_top_m") or top_m < 1:
        raise ValueError("method must be max or mean_top_m, top_m at least 1")
    video = [by, "video_id"]
    totals = candidates.groupBy(*video).agg(F.min(order_key()).alias("k"), F.count(F.lit(1)).alias("contributing_keyframes"))
    if method == "max":
        scored = totals.withColumn("score", F.lit(0.0) - F.col("k.neg"))
    else:
        place = F.row_number().over(W.Window.partitionBy(*video).orderBy(order_key()))
        few = candidates.withColumn("place", place).where(F.col("place") <= top_m)
        means = few.groupBy(*video).agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("s"))
        total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["score"])
        scored = totals.join(means.select(*video, (total / F.size("s")).alias("score")), video)
    rows = scored.select(*video, "score", F.col("k.uid").alias("best_keyframe_uid"), "contributing_keyframes")
    return rerank(rows, F.desc(F.round("score", 9)), F.col("video_id"), by=by, limit=limit)
