"""Refinement of coarse candidates on video frames by an injected scorer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reelspark.functions.sampling import dense_blocks, dense_ids, even_ids, frame_window, sparse_ids
from reelspark.session import materialize

#: Takes rows (query_id, video_id, video_path, frame_id) and gives the scored ones
#: (query_id, video_id, frame_id, source, score); frames it cannot decode are missing.
FrameScorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class RefineConfig:
    """How many candidates are refined, and the two passes around them."""

    candidates: int = 10
    sparse_window_sec: float = 3.0
    sparse_fps: float = 4.0
    dense_window_sec: float = 1.0


def rank_frames(scores: DataFrame, weights: dict[str, float] | None = None, k: float = 60.0) -> DataFrame:
    """Rows (query_id, video_id, frame_id, score): a single source as it is, several fused by reciprocal rank.

    Ranks are taken within each (query, video, candidate window) a row names in
    ``window_id``; equal scores go to the smaller frame.
    """
    base = ["query_id", "video_id", "window_id"]
    if not weights or len(weights) == 1:
        return scores.select(*base, "frame_id", "score")
    place = F.row_number().over(W.Window.partitionBy(*base, "source").orderBy(F.desc("score"), "frame_id"))
    weight = F.try_element_at(F.create_map(*[F.lit(x) for s, w in sorted(weights.items()) for x in (s, float(w))]), F.col("source"))
    parts = scores.withColumn("part", F.struct("source", (weight / (k + place)).alias("c")))
    fused = parts.groupBy(*base, "frame_id").agg(F.array_sort(F.collect_list("part")).alias("ps"))
    return fused.select(*base, "frame_id", F.aggregate("ps", F.lit(0.0), lambda a, x: a + x["c"]).alias("score"))


def _score(windows: DataFrame, ids, scorer: FrameScorer, weights) -> DataFrame:
    asked = windows.select("query_id", "video_id", "video_path", F.col("keyframe_uid").alias("window_id"), F.explode(ids).alias("frame_id"))
    return _scored(asked, scorer, weights)


def _score_all(windows: DataFrame, scorer: FrameScorer, weights) -> DataFrame:
    """The same for every frame of ``w``."""
    blocks = windows.select("query_id", "video_id", "video_path", F.col("keyframe_uid").alias("window_id"), F.explode(dense_blocks(F.col("w"))).alias("block"))
    return _scored(blocks.select(*blocks.columns[:-1], F.explode(dense_ids(F.col("block"))).alias("frame_id")), scorer, weights)


def _scored(asked: DataFrame, scorer: FrameScorer, weights) -> DataFrame:
    # Overlapping windows ask for a frame once.
    scored = scorer(asked.select("query_id", "video_id", "video_path", "frame_id").distinct())
    return rank_frames(asked.drop("video_path").join(scored, ["query_id", "video_id", "frame_id"]), weights)


def refine(candidates: DataFrame, videos: DataFrame, scorer: FrameScorer, cfg: RefineConfig = RefineConfig(), weights: dict[str, float] | None = None) -> DataFrame:
    """The first candidates of every query with their best frame nearby and a status.

    ``candidates`` has (query_id, rank, keyframe_uid, video_id, original_frame_id, score),
    ``videos`` one row per video. Pass one scores frames sparsely around the candidate,
    pass two all frames around the best of those. A candidate that cannot be refined is a
    row with ``refinement_status`` = failed and the reason in ``error``.
    """
    first = candidates.where(F.col("rank") <= cfg.candidates).join(videos.select("video_id", "video_path", "fps", "frame_count", "is_readable", F.lit(True).alias("known")), "video_id", "left")
    window = frame_window(F.col("original_frame_id"), F.col("fps"), cfg.sparse_window_sec, F.col("frame_count"))
    rows = first.withColumn("w", window)
    problem = (
        F.when(F.col("known").isNull(), "no such video").when(~F.coalesce("is_readable", F.lit(False)), "unreadable video").when(F.col("w").isNull(), "frame or fps out of bounds")
    )
    # Both passes and the result refer to these few rows: written once, the plan stays small.
    rows = materialize(rows.withColumn("error", problem))
    good = rows.where("error is null")
    pair = ["query_id", "keyframe_uid"]
    best = lambda s: s.groupBy("query_id", F.col("window_id").alias("keyframe_uid")).agg(F.min(F.struct((F.lit(0.0) - F.col("score")).alias("neg"), "frame_id")).alias("b"))
    sparse = best(_score(good, sparse_ids(F.col("w"), F.col("fps"), cfg.sparse_fps), scorer, weights))
    around = good.join(sparse.select(*pair, F.col("b.frame_id").alias("sparse_frame_id"), (F.lit(0.0) - F.col("b.neg")).alias("sparse_score")), pair)
    near = materialize(around.withColumn("w", frame_window(F.col("sparse_frame_id"), F.col("fps"), cfg.dense_window_sec, F.col("frame_count"))))
    dense = best(_score_all(near, scorer, weights))
    refined = near.join(dense.select(*pair, F.col("b.frame_id").alias("refined_frame_id"), (F.lit(0.0) - F.col("b.neg")).alias("local_score")), pair)
    found = refined.select(*pair, "sparse_frame_id", "sparse_score", "refined_frame_id", "local_score")
    out = rows.join(found, pair, "left")
    failed = F.when(F.col("error").isNull() & F.col("refined_frame_id").isNull(), F.lit("no frame could be scored")).otherwise(F.col("error"))
    return out.select(*candidates.columns, "sparse_frame_id", "sparse_score", "refined_frame_id", "local_score", failed.alias("error")).withColumn(
        "refinement_status", F.when(F.col("error").isNull(), "refined").otherwise("failed")
    )


def refine_frames(candidates: DataFrame, videos: DataFrame, scorer: FrameScorer, n: int, cfg: RefineConfig = RefineConfig(), weights: dict[str, float] | None = None) -> DataFrame:
    """The ``n`` best frames around each candidate: candidates' columns, frame_id, timestamp_sec, score, error.

    As refine(), but every candidate gives up to ``n`` rows, best first by score, then frame;
    one that cannot be refined is one row with ``error``.
    """
    whole = RefineConfig(max(cfg.candidates, 1), cfg.sparse_window_sec, cfg.sparse_fps, cfg.dense_window_sec)
    done = materialize(refine(candidates.withColumn("score", F.lit(None).cast("double")), videos, scorer, whole, weights).drop("score"))
    bad = done.where("error is not null").select(*[c for c in candidates.columns], F.lit(None).cast("bigint").alias("frame_id"), F.lit(None).cast("double").alias("timestamp_sec"), F.lit(None).cast("double").alias("score"), "error")
    good = done.where("error is null").join(videos.select("video_id", "video_path", "fps", "frame_count"), "video_id")
    near = good.withColumn("w", frame_window(F.col("sparse_frame_id"), F.col("fps"), cfg.dense_window_sec, F.col("frame_count")))
    scores = _score_all(near, scorer, weights)
    place = F.row_number().over(W.Window.partitionBy("query_id", "window_id").orderBy(F.desc("score"), "frame_id"))
    best = scores.withColumn("place", place).where(F.col("place") <= n).select("query_id", F.col("window_id").alias("keyframe_uid"), "frame_id", "score")
    found = near.join(best, ["query_id", "keyframe_uid"])
    rows = found.select(*candidates.columns, "frame_id", (F.col("frame_id") / F.col("fps")).alias("timestamp_sec"), "score", F.lit(None).cast("string").alias("error"))
    return rows.unionByName(bad)


def overlay(candidates: DataFrame, refined: DataFrame) -> DataFrame:
    """All candidates in their old order; refined ones with the new frame, others as they were (``coarse_fallback``)."""
    done = refined.where("refinement_status = 'refined'").select("query_id", "keyframe_uid", "refined_frame_id", "local_score")
    rows = candidates.join(done, ["query_id", "keyframe_uid"], "left")
    return rows.select(
        *candidates.columns,
        F.coalesce("refined_frame_id", "original_frame_id").alias("frame_id"),
        "local_score",
        F.when(F.col("refined_frame_id").isNotNull(), "refined").otherwise("coarse_fallback").alias("refinement_status"),
    )


def refinement_counts(overlaid: DataFrame, refined: DataFrame) -> DataFrame:
    """Per query: refined, fallback and failed candidates."""
    failed = refined.groupBy("query_id").agg(F.count(F.when(F.col("refinement_status") == "failed", 1)).alias("n_failed"))
    rows = overlaid.groupBy("query_id").agg(
        F.count(F.when(F.col("refinement_status") == "refined", 1)).alias("n_refined"), F.count(F.when(F.col("refinement_status") != "refined", 1)).alias("n_fallback")
    )
    return rows.join(failed, "query_id", "left").withColumn("n_failed", F.coalesce("n_failed", F.lit(0).cast("bigint")))


def clip_frames(anchors: DataFrame, videos: DataFrame, seconds: float, n: int) -> DataFrame:
    """``anchors`` (with video_id, frame_id) with ``clip``: evenly spaced frames that hold the anchor."""
    rows = anchors.join(videos.select("video_id", "fps", "frame_count"), "video_id")
    window = frame_window(F.col("frame_id"), F.col("fps"), seconds, F.col("frame_count"))
    return rows.withColumn("clip", even_ids(window, n)).select(*anchors.columns, "clip")
