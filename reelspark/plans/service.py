"""One object that holds the tables and branches of a deployment and answers requests over batches of queries."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import alignment, fusion, refine, submission
from reelspark.operators.decompose import decompose_events
from reelspark.plans import retrieval
from reelspark.schemas import ContractError
from reelspark.session import materialize

MAX_RESULTS, MAX_TEXT = 100, 4_000


class Service:
    """Branches by name, of which ``visual`` see images, over one keyframe and one video table."""

    def __init__(self, spark: SparkSession, keyframes: DataFrame, videos: DataFrame, branches: Mapping[str, retrieval.Branch], visual: Sequence[str], weights: Mapping[str, float]) -> None:
        missing = set(branches) - set(weights)
        if missing:
            raise ContractError(f"no weight for {', '.join(sorted(missing))}")
        self.spark, self.keyframes, self.videos = spark, keyframes, videos
        self.branches, self.visual, self.weights = dict(branches), list(visual), dict(weights)

    def health(self) -> dict:
        """Whether the tables can be read, and which sources there are."""
        return {"status": "ok" if not self.keyframes.isEmpty() and not self.videos.isEmpty() else "empty", "sources": sorted(self.branches)}

    def catalog(self) -> DataFrame:
        """Videos with their number of keyframes."""
        n = self.keyframes.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_keyframes"))
        return self.videos.select("video_id", "fps", "frame_count", "duration_sec").join(n, "video_id", "left")

    def _config(self, sources: list[str], top_k: int) -> retrieval.KisConfig:
        if not 1 <= top_k <= MAX_RESULTS:
            raise ContractError(f"top_k must lie in 1..{MAX_RESULTS}")
        return retrieval.KisConfig({s: self.weights[s] for s in sources}, top_k)

    def _lists(self, queries: DataFrame, sources: list[str], cfg: retrieval.KisConfig) -> DataFrame:
        bad = queries.where((F.trim(F.coalesce("text", F.lit(""))) == "") | (F.length("text") > MAX_TEXT))
        if not bad.isEmpty():
            raise ContractError(f"texts must have 1 to {MAX_TEXT} characters")
        return retrieval.ranked_lists(retrieval.retrieve(queries, {s: self.branches[s] for s in sources}, cfg))

    def known_item(self, queries: DataFrame, sources: Sequence[str] | None = None, top_k: int = MAX_RESULTS) -> tuple[DataFrame, DataFrame]:
        """(keyframes, videos) for queries (query_id, text)."""
        chosen = retrieval.select_sources(sources, sorted(self.branches), self.visual)
        cfg = self._config(chosen, top_k)
        return retrieval.known_item(self._lists(queries, chosen, cfg), cfg)

    def ordered_events(
        self, queries: DataFrame, sources: Sequence[str] | None = None, top_k: int = MAX_RESULTS, cfg: alignment.AlignmentConfig = alignment.AlignmentConfig(),
        scorer: refine.FrameScorer | None = None, refining: retrieval.EventRefineConfig = retrieval.EventRefineConfig(),
    ) -> DataFrame:
        """Sequences for queries (query_id, text) that list their events, any number each; every event is one search of one job.

        With a ``scorer`` the events of the first sequences are refined and aligned anew; it
        is asked under ``query_id\\u0001event_index``.
        """
        chosen = retrieval.select_sources(sources, sorted(self.branches), self.visual)
        kis = self._config(chosen, top_k)
        events = decompose_events(queries)
        n_events = events.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_events"))
        each = events.select(F.to_json(F.struct("query_id", "event_index")).alias("query_id"), F.col("retrieval_text").alias("text"))
        fused = retrieval.fused_candidates(self._lists(each, chosen, kis), kis, kis.top_k)
        key = F.from_json("query_id", "query_id string, event_index int")
        rows = fused.select(key["query_id"].alias("query_id"), key["event_index"].alias("event_index"), "video_id", F.col("original_frame_id").alias("frame_id"), "timestamp_sec", "score", F.col("keyframe_uid").alias("uid"))
        # What is refined must be there: as many sequences as are asked for or refined, whichever is more.
        wide = replace(cfg, k_best=max(cfg.k_best, refining.sequences)) if scorer else cfg
        found = retrieval.ordered_events(rows, n_events, cfg=wide, limit=max(top_k, refining.sequences) if scorer else top_k)
        if scorer is None:
            return found
        found = materialize(found)
        refined, _ = retrieval.refined_events(found, self.videos, scorer, refining)
        return retrieval.realign(found, refined, n_events, cfg, top_k)

    def answers(
        self, queries: DataFrame, answerer: retrieval.Answerer, sources: Sequence[str] | None = None, retrieved: int = 20, answered: int = 5,
        scorer: refine.FrameScorer | None = None, seconds: float = 2.0, frames: int = 8,
    ) -> tuple[DataFrame, DataFrame]:
        """(answers, failures) for queries (query_id, text, question): the text is searched, the question only asked.

        With a ``scorer`` the found keyframes are refined first.
        """
        chosen = retrieval.select_sources(sources, sorted(self.branches), self.visual)
        cfg = self._config(chosen, retrieved)
        lists = self._lists(queries.select("query_id", "text"), chosen, cfg)
        if scorer is None:
            kept, _ = retrieval.known_item(lists, cfg)
            numbers = self.keyframes.select("keyframe_uid", F.col("original_frame_id").alias("frame_id"))
            kept = kept.join(numbers, "keyframe_uid")
        else:
            kept = retrieval.known_item_refined(lists, self.videos, scorer, cfg)
        targets = kept.join(queries.select("query_id", F.col("text").alias("event_text"), "question"), "query_id")
        targets = targets.select("query_id", "rank", "video_id", "frame_id", "event_text", "question", "score")
        return retrieval.answer_questions(targets, self.videos, answerer, answered, seconds, frames)

    def prepare_submission(self, results: DataFrame, task: str) -> list[dict]:
        """Checked documents of (query_id, video_id, frame_id, timestamp_sec, score[, answer]); at most 100 results a query."""
        kept = submission.diverse_frames(results)
        rows = kept.select("query_id", F.lit(task).alias("task"), "rank", "video_id", F.array("frame_id").alias("frame_ids"))
        if task == "qna":
            answers = results.groupBy("query_id", "video_id", "frame_id").agg(F.max_by("answer", "score").alias("answer"))
            rows = rows.withColumn("frame_id", F.element_at("frame_ids", 1)).join(answers, ["query_id", "video_id", "frame_id"], "left").drop("frame_id")
        else:
            rows = rows.withColumn("answer", F.lit(None).cast("string"))
        wrong = submission.violations(rows, self.videos.select("video_id", "frame_count"))
        first = wrong.limit(1).collect()
        if first:
            raise ContractError(f"query {first[0]['query_id']}: {first[0]['problem']}")
        return [json.loads(r[0]) for r in submission.to_documents(rows).orderBy("query_id").select("json").collect()]

    def conflicts(self, lists: DataFrame) -> DataFrame:
        """Keyframes on whose metadata the sources disagree."""
        return fusion.metadata_conflicts(lists)
