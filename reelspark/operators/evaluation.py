"""Scores of ranked results against ground truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.answers import normalize_answer, same_answer

CUTOFFS = (1, 5, 20, 50, 100)


#: Takes the given and the due answer, says whether they agree.
Matcher = Callable[[Column, Column], Column]


def normalized_match(given: Column, due: Column) -> Column:
    """Whether two raw answers have the same canonical form; blank ones agree with nothing."""
    return same_answer(normalize_answer(given), normalize_answer(due))


def candidate_scores(submission: DataFrame, truth: DataFrame, matches: Matcher = normalized_match) -> DataFrame:
    """Rows (query_id, task, rank, r_score) of the submitted results of known queries and the right task.

    ``truth`` has (query_id, task, video_id, frame_windows, answer), ``submission``
    (query_id, task, rank, video_id, frame_ids, answer); ``matches`` compares answers. The wrong
    video scores 0. One frame scores 1 inside the window (both ends count), for questions
    only with the right answer. A sequence scores the share of its frames inside their
    windows, 0 with another number of frames.
    """
    due = truth.select("query_id", "task", F.col("video_id").alias("due_video"), "frame_windows", F.col("answer").alias("due_answer"))
    rows = submission.join(due, ["query_id", "task"])
    inside = F.zip_with("frame_ids", "frame_windows", lambda f, w: F.when((f >= w["start"]) & (f <= w["end"]), 1.0).otherwise(0.0))
    hits = F.aggregate(inside, F.lit(0.0), lambda a, x: a + x)
    same_size = F.size("frame_ids") == F.size("frame_windows")
    answered = (F.col("task") != "qna") | F.coalesce(matches(F.col("answer"), F.col("due_answer")), F.lit(False))
    score = F.when((F.col("video_id") == F.col("due_video")) & same_size & answered, F.try_divide(hits, F.size("frame_windows")))
    return rows.select("query_id", "task", "rank", F.coalesce(score, F.lit(0.0)).alias("r_score"))


def query_metrics(submission: DataFrame, truth: DataFrame, matches: Matcher = normalized_match) -> DataFrame:
    """One row per query of the truth: r_at_k for every cutoff and their mean, ``final_score``.

    R@k is the best score among the first k results; a query without results scores 0. More
    than 100 results in a query are an error.
    """
    scores = candidate_scores(submission, truth, matches)
    too_many = F.when(F.max("rank") > CUTOFFS[-1], F.raise_error(F.lit("a query has more than 100 results")).cast("double"))
    best = scores.groupBy("query_id").agg(*[F.coalesce(too_many, F.max(F.when(F.col("rank") <= k, F.col("r_score")))).alias(f"b{k}") for k in CUTOFFS])
    rows = truth.select("query_id", "task").join(best, "query_id", "left")
    rows = rows.select("query_id", "task", *[F.coalesce(f"b{k}", F.lit(0.0)).alias(f"r_at_{k}") for k in CUTOFFS])
    total = F.lit(0.0)
    for k in CUTOFFS:
        total = total + F.col(f"r_at_{k}")
    return rows.withColumn("final_score", total / len(CUTOFFS))


def task_metrics(metrics: DataFrame) -> DataFrame:
    """Means over the queries of each task, missing ones included."""
    means = [F.avg(c).alias(c) for c in (*[f"r_at_{k}" for k in CUTOFFS], "final_score")]
    return metrics.groupBy("task").agg(F.count(F.lit(1)).alias("n_queries"), *means)
