"""Diverse result lists, their validation, and their JSON form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reelspark.operators.greedy import keep_apart

TASKS = ("kis", "qna", "trake")


@dataclass(frozen=True)
class DiversityConfig:
    """Most results, most results of one video, and the window within which results are alike."""

    max_results: int = 100
    max_per_video: int = 20
    window: float = 2.0

    def __post_init__(self) -> None:
        if not 1 <= self.max_results <= 100 or self.max_per_video < 1 or not 0 <= self.window < float("inf"):
            raise ValueError("results must be 1 to 100, the cap at least 1, the window finite and not negative")


def _limit(kept: DataFrame, order: list, n: int) -> DataFrame:
    place = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id", *order))
    return kept.withColumn("rank", place).where(F.col("rank") <= n)


def diverse_frames(frames: DataFrame, cfg: DiversityConfig = DiversityConfig()) -> DataFrame:
    """Frames (query_id, video_id, frame_id, timestamp_sec, score) that differ, best first, with their rank.

    A frame stays unless its video has ``max_per_video`` kept frames or one within the
    window of seconds (inclusive). The cap counts kept frames. Each video is a stream over
    the best row of each distinct frame.
    """
    neg = (F.lit(0.0) - F.col("score")).alias("neg")
    once = frames.where("video_id is not null and score is not null").groupBy("query_id", "video_id", "frame_id").agg(F.min(F.struct(neg, "timestamp_sec")).alias("b"))
    rows = once.select("query_id", "video_id", "frame_id", F.col("b.timestamp_sec").alias("timestamp_sec"), (F.lit(0.0) - F.col("b.neg")).alias("score"))
    kept = keep_apart(rows, ["query_id", "video_id"], [F.desc("score"), F.col("frame_id"), F.col("timestamp_sec")], "timestamp_sec", cfg.window, cfg.max_per_video)
    return _limit(kept, ["frame_id"], cfg.max_results)


def diverse_sequences(sequences: DataFrame, cfg: DiversityConfig = DiversityConfig(window=15)) -> DataFrame:
    """The same for sequences (query_id, video_id, frame_ids, score); the window is in frames at every position."""
    once = sequences.where("video_id is not null and score is not null").groupBy("query_id", "video_id", "frame_ids").agg(F.max("score").alias("score"))
    kept = keep_apart(once, ["query_id", "video_id"], [F.desc("score"), F.col("frame_ids")], "frame_ids", int(cfg.window), cfg.max_per_video)
    return _limit(kept, ["frame_ids"], cfg.max_results)


def increasing(ids):
    """True if an array of numbers strictly increases."""
    steps = F.sequence(F.lit(1), F.size(ids) - 1)
    return F.when(F.size(ids) < 2, F.lit(True)).otherwise(F.forall(steps, lambda i: F.get(ids, i - 1) < F.get(ids, i)))


def violations(submission: DataFrame, videos: DataFrame, truth: DataFrame | None = None, max_results: int = 100) -> DataFrame:
    """Rows (query_id, rank, problem) of everything a submission does wrong; none if it is valid.

    ``submission`` has (query_id, task, rank, video_id, frame_ids, answer), ``videos``
    (video_id, frame_count), ``truth`` (query_id, task, n_frames). Problems of a whole query
    have a null rank. A Q&A duplicate is the same frame whatever the answer.
    """
    inventory = videos.groupBy("video_id").agg(F.max("frame_count").alias("frame_count"), F.lit(True).alias("known"))
    rows = submission.join(inventory, "video_id", "left")
    n, task, answer = F.size("frame_ids"), F.col("task"), F.col("answer")
    single, ordered = task.isin("kis", "qna"), task == "trake"
    rows = rows.withColumn("again", F.row_number().over(W.Window.partitionBy("query_id", "video_id", "frame_ids").orderBy("rank")) > 1)
    checks = [
        F.when(~task.isin(*TASKS), "unknown task"),
        F.when(F.col("known").isNull(), "unknown video"),
        F.when(F.exists("frame_ids", lambda f: f >= F.col("frame_count")), "frame outside the video"),
        F.when(F.exists("frame_ids", lambda f: f < 0) | (n == 0), "no valid frame"),
        F.when(single & (n != 1), "needs exactly one frame"),
        F.when((task != "qna") & answer.isNotNull(), "must not have an answer"),
        F.when((task == "qna") & (F.coalesce(F.trim(answer), F.lit("")) == ""), "needs an answer"),
        F.when(ordered & ~increasing(F.col("frame_ids")), "frames must increase"),
        F.when(F.col("again"), "duplicate"),
    ]
    if truth is not None:
        expected = truth.select("query_id", F.col("task").alias("due_task"), "n_frames", F.lit(True).alias("due"))
        rows = rows.join(expected, "query_id", "left")
        checks += [
            F.when(F.col("due").isNull(), "query is not in the ground truth"),
            F.when(F.col("due_task") != task, "wrong task"),
            F.when(ordered & (n != F.col("n_frames")), "wrong number of frames"),
        ]
    each = rows.select("query_id", "rank", F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    sizes = submission.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks"))
    whole = sizes.select(
        "query_id",
        F.lit(None).cast("int").alias("rank"),
        F.explode(F.array_compact(F.array(F.when(F.col("n") > max_results, "too many results"), F.when(F.col("tasks") > 1, "several tasks")))).alias("problem"),
    )
    return each.unionByName(whole)


def to_documents(submission: DataFrame) -> DataFrame:
    """One row (query_id, task, json) per query: its results in rank order, with the fields of its task."""
    task = F.col("task")
    frame = F.element_at("frame_ids", 1)
    one = (
        F.when(task == "kis", F.to_json(F.struct("video_id", frame.alias("frame_id"))))
        .when(task == "qna", F.to_json(F.struct("video_id", frame.alias("frame_id"), "answer")))
        .otherwise(F.to_json(F.struct("video_id", "frame_ids")))
    )
    lists = submission.select("query_id", "task", F.struct("rank", one.alias("j")).alias("r")).groupBy("query_id", "task").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    body = F.concat(
        F.lit('{"query_id":'), F.to_json(F.struct("query_id")).substr(F.lit(13), F.length(F.to_json(F.struct("query_id"))) - 13),
        F.lit(',"task":"'), task, F.lit('","results":['), F.array_join(F.transform("rs", lambda r: r["j"]), ","), F.lit("]}"),
    )
    return lists.select("query_id", "task", body.alias("json"))


def debug_score(columns: list[str]):
    """The score a result is submitted by: global before coarse before plain before retrieval score."""
    order = [c for c in ("global_score", "coarse_score", "score", "retrieval_score") if c in columns]
    return F.coalesce(*[F.col(c) for c in order])
