"""The three tasks as plans over batches of queries: known item, question answering, ordered events."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.answers import normalize_answer
from reelspark.functions.keys import is_finite
from reelspark.operators import alignment, fusion, refine, temporal
from reelspark.operators.positions import global_positions
from reelspark.schemas import ContractError
from reelspark.session import materialize

#: Takes a branch's queries (query_id, text) and the pool size, gives its candidates.
Branch = Callable[[DataFrame, int], DataFrame]
#: Takes rows (query_id, rank, video_id, event_text, question, clip), gives them with ``raw_answer`` and ``error``.
Answerer = Callable[[DataFrame], DataFrame]
META = ("video_id", "original_frame_id", "timestamp_sec", "keyframe_path")


@dataclass(frozen=True)
class KisConfig:
    """Result size, over-fetch of each branch, fusion, suppression and video aggregation."""

    weights: dict[str, float] = field(default_factory=dict)
    top_k: int = 100
    pool: int = 5
    nms_window_sec: float | None = 2.0
    video_method: str = "max"
    top_m: int = 3


def best_rows(candidates: DataFrame) -> DataFrame:
    """Retrieved candidates with each keyframe once per query and source, unranked.

    Rows without video or with a non-finite score or time do not count; of repeated rows
    the best score stays.
    """
    good = is_finite(F.col("score")) & is_finite(F.col("timestamp_sec")) & F.col("video_id").isNotNull() & F.col("keyframe_uid").isNotNull()
    keys = ["query_id", "source", "keyframe_uid"]
    best = candidates.where(good).groupBy(*keys).agg(F.min(F.struct((F.lit(0.0) - F.col("score")).alias("neg"), *META)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in META], (F.lit(0.0) - F.col("b.neg")).alias("score"))


def ranked_lists(candidates: DataFrame) -> DataFrame:
    """The best_rows() as lists, ranked anew from 1.

    The order is by score, then keyframe; positions come from a global sort, so one query
    may hold any number of rows.
    """
    placed = global_positions(best_rows(candidates), ["query_id", "source"], [F.col("score").desc(), F.col("keyframe_uid").asc()])
    return placed.withColumn("rank", F.col("position").cast("int")).drop("position")


def select_sources(requested: Sequence[str] | None, available: Sequence[str], visual: Sequence[str]) -> list[str]:
    """The sources a search uses: all by default; unknown names, or none that sees images, are an error."""
    chosen = list(dict.fromkeys(requested)) if requested else list(available)
    unknown = [s for s in chosen if s not in available]
    if unknown:
        raise ContractError(f"unknown sources: {', '.join(unknown)}")
    if not set(chosen) & set(visual):
        raise ContractError("at least one visual source is needed")
    return chosen


def retrieve(queries: DataFrame, branches: dict[str, Branch], cfg: KisConfig) -> DataFrame:
    """The union of the branches' candidates, over-fetched by ``pool``; absent branches are not planned."""
    out = None
    for source in sorted(branches):
        rows = branches[source](queries, cfg.top_k * cfg.pool).withColumn("source", F.lit(source))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ContractError("no branch is enabled")
    return out


def _fused(lists: DataFrame, cfg: KisConfig) -> DataFrame:
    """Lists fused by reciprocal rank, with the keyframes' metadata and no rank yet."""
    fused = fusion.fuse(lists, fusion.FusionConfig(cfg.weights))
    meta = lists.groupBy("keyframe_uid").agg(F.min(F.struct(*META)).alias("m")).select("keyframe_uid", "m.*")
    return fused.withColumn("score", F.round("score", 12)).join(meta, "keyframe_uid")


def fused_candidates(lists: DataFrame, cfg: KisConfig, limit: int | None = None) -> DataFrame:
    """Lists fused by reciprocal rank, with the keyframes' metadata and a rank per query.

    With ``limit`` only the first rows of a query, which are found without sorting the rest.
    """
    return temporal.rerank(_fused(lists, cfg), F.col("score").desc(), F.col("keyframe_uid").asc(), limit=limit)


def known_item(lists: DataFrame, cfg: KisConfig) -> tuple[DataFrame, DataFrame]:
    """(keyframes, videos) per query: fusion, suppression of near keyframes, best videos.

    Suppression goes by score, then keyframe, which is the fused order, so nothing is ranked
    before it; without it the fused order is cut off as it is.
    """
    columns = ["query_id", "video_id", "keyframe_uid", "timestamp_sec", "score", "rank"]
    if cfg.nms_window_sec is None:
        kept = fused_candidates(lists, cfg, cfg.top_k).select(*columns)
    else:
        kept = temporal.temporal_nms(_fused(lists, cfg).withColumn("rank", F.lit(0)).select(*columns), cfg.nms_window_sec, cfg.top_k)
    return kept, temporal.aggregate_videos(kept, cfg.video_method, cfg.top_m)


def known_item_refined(lists: DataFrame, videos: DataFrame, scorer: refine.FrameScorer, cfg: KisConfig, refining: refine.RefineConfig = refine.RefineConfig()) -> DataFrame:
    """Keyframes with refined frames where refinement succeeds; the coarse order stays."""
    kept, _ = known_item(lists, cfg)
    frames = lists.groupBy("keyframe_uid").agg(F.min("original_frame_id").alias("original_frame_id"))
    coarse = materialize(kept.join(frames, "keyframe_uid"))
    return refine.overlay(coarse, refine.refine(coarse, videos, scorer, refining))


def ordered_events(
    candidates: DataFrame, n_events: int | DataFrame, videos_per_query: int = 100, cfg: alignment.AlignmentConfig = alignment.AlignmentConfig(), limit: int = 100
) -> DataFrame:
    """Ranked sequences per query from candidates (query_id, event_index, video_id, frame_id, timestamp_sec, score, uid).

    ``n_events`` is the number of events, or a table (query_id, n_events). Only the videos
    with the best evidence are aligned.
    """
    chosen = alignment.candidate_videos(candidates, videos_per_query).select("query_id", "video_id")
    aligned = alignment.align_events(candidates.join(chosen, ["query_id", "video_id"], "left_semi"), n_events, cfg)
    return alignment.rank_sequences(aligned, limit, cfg.dedup_window_sec)


@dataclass(frozen=True)
class EventRefineConfig:
    """How many sequences are refined, and how many frames around each event may take its place."""

    sequences: int = 20
    local_frames: int = 8
    frames: refine.RefineConfig = refine.RefineConfig()


def refined_events(sequences: DataFrame, videos: DataFrame, scorer: refine.FrameScorer, cfg: EventRefineConfig = EventRefineConfig()) -> tuple[DataFrame, DataFrame]:
    """(alternatives, failures) of the events of the first sequences of every query.

    ``sequences`` has (query_id, video_id, rank, frame_ids, uids). Alternatives are rows
    (query_id, video_id, rank, event_index, frame_id, timestamp_sec, score, uid): the best
    ``local_frames`` frames around each event. The scorer is asked under the query_id
    ``query_id\\u0001event_index``. Failures are (query_id, video_id, rank, event_index, error).
    """
    first = materialize(sequences.where(F.col("rank") <= cfg.sequences))
    events = first.select("query_id", "video_id", "rank", F.posexplode(F.arrays_zip("frame_ids", "uids")).alias("event_index", "e"))
    asked = events.select(
        F.concat_ws("\u0001", "query_id", F.col("event_index").cast("string")).alias("query_id"), "video_id", F.concat_ws("\u0001", F.col("rank").cast("string"), "video_id").alias("keyframe_uid"),
        F.lit(1).alias("rank"), F.col("e.frame_ids").alias("original_frame_id"), F.col("e.uids").alias("uid"),
    )
    done = refine.refine_frames(asked, videos, scorer, cfg.local_frames, cfg.frames)
    part = lambda c, i: F.split(c, "\u0001")[i]
    named = materialize(done).select(
        part("query_id", 0).alias("query_id"), "video_id", part("keyframe_uid", 0).cast("int").alias("rank"), part("query_id", 1).cast("int").alias("event_index"),
        F.col("frame_id"), "timestamp_sec", "score", "uid", "error",
    )
    failures = named.where("error is not null").select("query_id", "video_id", "rank", "event_index", "error")
    return named.where("error is null").drop("error"), failures


def realign(sequences: DataFrame, refined: DataFrame, n_events: int | DataFrame, cfg: alignment.AlignmentConfig, limit: int = 100) -> DataFrame:
    """Sequences on refined frames, ranked by their coarse total, without near duplicates of the final frames.

    ``sequences`` has (query_id, video_id, rank, total, frame_ids, times, uids), ``refined``
    (query_id, video_id, rank, event_index, frame_id, timestamp_sec, score, uid): the
    alternatives of each event of each sequence, which are aligned anew. One sequence may
    give several; one with an event without alternatives, or without an increasing choice
    of them, keeps its coarse frames.
    """
    base = ["query_id", "video_id", "rank"]
    name = F.concat_ws("\u0001", "query_id", F.col("rank").cast("string"))
    if isinstance(n_events, DataFrame):
        n_events = sequences.join(n_events, "query_id").select(name.alias("query_id"), "n_events").distinct()
    # A sequence with an event without alternatives has no path.
    local = alignment.align_events(refined.withColumn("query_id", name), n_events, cfg).select(
        F.split("query_id", "\u0001")[0].alias("query_id"), F.split("query_id", "\u0001")[1].cast("int").alias("rank"), "video_id",
        F.col("frame_ids").alias("final_frame_ids"), F.col("times").alias("final_times"), F.col("total").alias("local_total"),
    )
    rows = sequences.join(local, base, "left")
    rows = rows.withColumn("refinement_status", F.when(F.col("final_frame_ids").isNotNull(), "refined").otherwise("coarse_fallback"))
    rows = rows.withColumn("final_frame_ids", F.coalesce("final_frame_ids", "frame_ids")).withColumn("final_times", F.coalesce("final_times", "times")).drop("rank")
    return alignment.rank_sequences(rows, limit, cfg.dedup_window_sec, "final_frame_ids", "final_times")


def answer_questions(targets: DataFrame, videos: DataFrame, answerer: Answerer, candidates: int = 5, seconds: float = 2.0, frames: int = 8) -> tuple[DataFrame, DataFrame]:
    """(answers, failures): the first targets of every query, each with a clip, answered and normalized.

    ``targets`` has (query_id, rank, video_id, frame_id, event_text, question, score); the
    event text was searched, the question is only asked. Failures are rows with their
    stage; the remaining answers are ranked anew.
    """
    first = materialize(targets.where(F.col("rank") <= candidates))
    clipped = refine.clip_frames(first, videos, seconds, frames)
    unknown = first.join(videos.select("video_id"), "video_id", "left_anti").withColumn("stage", F.lit("clip_selection")).withColumn("error", F.lit("no such video"))
    no_clip = clipped.where("clip is null").withColumn("stage", F.lit("clip_selection")).withColumn("error", F.lit("frame or fps out of bounds"))
    answered = answerer(clipped.where("clip is not null")).withColumn("answer", normalize_answer(F.col("raw_answer")))
    names = [*targets.columns, "stage", "error"]
    silent = answered.where("error is not null or answer is null").withColumn(
        "stage", F.when(F.col("error").isNotNull(), "vlm_answer").otherwise("answer_normalization")
    ).withColumn("error", F.coalesce("error", F.lit("empty answer")))
    failures = unknown.select(*names).unionByName(no_clip.select(*names)).unionByName(silent.select(*names))
    good = answered.where("error is null and answer is not null")
    return temporal.rerank(good.drop("error"), F.col("rank"), limit=candidates), failures
