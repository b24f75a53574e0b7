"""Ordered events in one video: evidence, k-best monotonic sequences, near duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reelspark.operators.greedy import keep_apart
from reelspark.session import materialize


@dataclass(frozen=True)
class AlignmentConfig:
    """How many sequences are kept, which gaps are allowed, and what counts as the same sequence."""

    k_best: int = 100
    min_gap_sec: float = 0.0
    max_gap_sec: float | None = None
    gap_penalty: float = 0.0
    dedup_window_sec: float = 0.5

    def __post_init__(self) -> None:
        if self.k_best < 1 or self.min_gap_sec < 0 or self.gap_penalty < 0 or self.dedup_window_sec < 0:
            raise ValueError("k_best must be at least 1, gaps, penalty and window not negative")
        if self.max_gap_sec is not None and self.max_gap_sec < self.min_gap_sec:
            raise ValueError("the largest gap must not be below the smallest")


def _neg(column: str) -> Column:
    return F.lit(0.0) - F.col(column)


def candidate_videos(candidates: DataFrame, limit: int) -> DataFrame:
    """Rows (query_id, rank, video_id, matched_events, evidence_score, n_candidates).

    ``candidates`` has (query_id, event_index, video_id, frame_id, score, uid). Videos that
    match more events come first, then those whose best candidates per event add up to
    more, then by name. Rows without a video or with a null score are dropped.
    """
    good = candidates.where("video_id is not null and score is not null")
    per_event = good.groupBy("query_id", "video_id", "event_index").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"))
    evidence = per_event.groupBy("query_id", "video_id").agg(
        F.array_sort(F.collect_list(F.struct("event_index", "best"))).alias("b"), F.sum("n").alias("n_candidates")
    )
    total = F.round(F.aggregate("b", F.lit(0.0), lambda a, x: a + x["best"]), 9)
    rows = evidence.select("query_id", "video_id", F.size("b").alias("matched_events"), total.alias("evidence_score"), "n_candidates")
    place = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("matched_events"), F.desc("evidence_score"), "video_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= limit)


def event_rows(candidates: DataFrame) -> DataFrame:
    """The best candidate of each (query, video, event, frame): higher score, then smaller key."""
    best = candidates.groupBy("query_id", "video_id", "event_index", "frame_id").agg(
        F.min(F.struct(_neg("score").alias("neg"), F.col("uid"), F.col("timestamp_sec"))).alias("b")
    )
    return best.select(
        "query_id", "video_id", "event_index", "frame_id", F.col("b.timestamp_sec").alias("timestamp_sec"), (F.lit(0.0) - F.col("b.neg")).alias("score"), F.col("b.uid").alias("uid")
    )


def k_best_paths(rows: DataFrame, n_events: int | DataFrame, cfg: AlignmentConfig) -> DataFrame:
    """Rows (query_id, video_id, total, penalty, frame_ids, times, uids, scores) over all events of a query.

    ``n_events`` is their number, or a table (query_id, n_events) where queries differ; the
    events of a query are 0..n_events-1, and rows of other events do not count. Dynamic
    programming layer by layer: paths join the candidates of the next event in the same
    query and video, with increasing frames and an allowed gap; per candidate only the
    ``k_best`` paths stay (higher total, then smaller frames, then smaller keys), which
    Spark applies before the exchange. A video that lacks an event has no path.
    """
    if isinstance(n_events, int):
        last, rows = n_events, rows.withColumn("n_events", F.lit(n_events))
    else:
        last = n_events.agg(F.max("n_events")).collect()[0][0] or 0
        rows = rows.join(n_events.select("query_id", "n_events"), "query_id")
    layer = lambda i: rows.where((F.col("event_index") == i) & (F.col("n_events") > i))
    names = ["query_id", "video_id", "total", "penalty", "frame_ids", "times", "uids", "scores"]
    paths = layer(0).select(
        "query_id", "video_id", F.col("score").alias("total"), F.lit(0.0).alias("penalty"), F.array("frame_id").alias("frame_ids"), F.array("timestamp_sec").alias("times"), F.array("uid").alias("uids"), F.array("score").alias("scores"), "n_events"
    )
    done = paths.where("n_events = 1").select(*names)
    for i in range(1, last):
        step = layer(i).drop("event_index", "n_events")
        gap = F.col("timestamp_sec") - F.element_at("times", -1)
        allowed = (F.element_at("frame_ids", -1) < F.col("frame_id")) & (gap >= cfg.min_gap_sec)
        if cfg.max_gap_sec is not None:
            allowed = allowed & (gap <= cfg.max_gap_sec)
        cost = F.lit(cfg.gap_penalty) * F.greatest(F.lit(0.0), gap - cfg.min_gap_sec)
        longer = paths.where(F.col("n_events") > i).join(step, ["query_id", "video_id"]).where(allowed).select(
            "query_id",
            "video_id",
            (F.col("total") + F.col("score") - cost).alias("total"),
            (F.col("penalty") + cost).alias("penalty"),
            F.array_append("frame_ids", F.col("frame_id")).alias("frame_ids"),
            F.array_append("times", F.col("timestamp_sec")).alias("times"),
            F.array_append("uids", F.col("uid")).alias("uids"),
            F.array_append("scores", F.col("score")).alias("scores"),
            "n_events",
            "frame_id",
        )
        place = F.row_number().over(W.Window.partitionBy("query_id", "video_id", "frame_id").orderBy(F.desc("total"), "frame_ids", "uids"))
        paths = longer.withColumn("place", place).where(F.col("place") <= cfg.k_best).drop("place", "frame_id")
        if i % 6 == 0:
            paths = materialize(paths)
        done = paths.select(*names) if isinstance(n_events, int) else done.unionByName(paths.where(F.col("n_events") == i + 1).select(*names))
    return done


def _order() -> list[Column]:
    return [F.desc("total"), F.col("frame_ids"), F.col("uids")]


def align_events(candidates: DataFrame, n_events: int | DataFrame, cfg: AlignmentConfig = AlignmentConfig()) -> DataFrame:
    """The best distinct sequences per query and video, ranked from 1 in their video.

    Paths are pruned to ``k_best`` per last frame; of a video's paths those that lie within
    the window of a better one at all events go, and the first ``k_best`` others stay.
    """
    paths = k_best_paths(event_rows(candidates), n_events, cfg)
    kept = keep_apart(paths, ["query_id", "video_id"], _order(), "times", cfg.dedup_window_sec, cfg.k_best)
    place = F.row_number().over(W.Window.partitionBy("query_id", "video_id").orderBy(*_order()))
    return kept.withColumn("rank", place)


def rank_sequences(sequences: DataFrame, limit: int, window_sec: float = 0.5, frames: str = "frame_ids", times: str = "times") -> DataFrame:
    """All sequences of a query by total score, then video and final frames, without near duplicates.

    Scores are those of the coarse candidates, also where frames were refined: local
    scores of different windows cannot be compared. Of sequences of one video whose final
    ``times`` lie within the window at all events only the best stays.
    """
    order = [F.desc("total"), F.col(frames), F.col("uids")]
    kept = keep_apart(sequences, ["query_id", "video_id"], order, times, window_sec)
    place = F.row_number().over(W.Window.partitionBy("query_id").orderBy(order[0], F.col("video_id"), *order[1:]))
    return kept.withColumn("rank", place).where(F.col("rank") <= limit)
