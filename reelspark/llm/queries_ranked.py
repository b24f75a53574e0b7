"""Queries on top items, merged rankings and nearest times, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.keys import clean_key, is_finite, whole_ms
from reelspark.llm.nearest import nearest_in_time
from reelspark.llm.rankmerge import leaders, merged_ranking
from reelspark.llm.topn import top_items
from reelspark.session import table

TOP_N = 3
NEAREST_MS = 2_000


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items(table(spark, sf_dir, "candidates"), ["query_id", "video_id"], "keyframe_uid", "score", "rank", TOP_N)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best keyframes of every query and video."""
    return _top(spark, sf_dir).select("query_id", "video_id", "keyframe_uid")


def p2_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with score, delivered rank and position."""
    return _top(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading item of every query."""
    return leaders(table(spark, sf_dir, "ranked_scores"), table(spark, sf_dir, "source_weights"))


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole combined ranking of every query."""
    return merged_ranking(table(spark, sf_dir, "ranked_scores"), table(spark, sf_dir, "source_weights"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "asr_segments").select(
        F.col("segment_id").alias("probe_id"), clean_key(F.col("video_id")).alias("entity"), whole_ms(F.col("start_sec")).alias("s"), whole_ms(F.col("end_sec")).alias("t")
    )
    # Twice the milliseconds: the middle of a segment stays a whole number.
    probes = segments.where("s >= 0 and s < t").select("probe_id", "entity", (F.col("s") + F.col("t")).alias("time"))
    frames = table(spark, sf_dir, "keyframes").where(is_finite(F.col("timestamp_sec")) & (F.col("timestamp_sec") >= 0))
    targets = frames.select(F.col("keyframe_uid").alias("target_id"), F.col("video_id").alias("entity"), (whole_ms(F.col("timestamp_sec")) * 2).alias("time"))
    return nearest_in_time(probes, targets, 2 * NEAREST_MS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyframe nearest to the middle of each speech segment, within two seconds."""
    return _pairs(spark, sf_dir).select(F.col("probe_id").alias("segment_id"), F.col("target_id").alias("keyframe_uid"))


def p6_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of matched segments by distance in tenths of a second."""
    tenth = F.floor(F.col("distance") / 200).cast("bigint")
    return _pairs(spark, sf_dir).groupBy(tenth.alias("tenth_sec")).agg(F.count(F.lit(1)).alias("n_segments"))


QUERIES = {
    "p2_found": p2_found,
    "p2_positions": p2_positions,
    "p5_found": p5_found,
    "p5_ranking": p5_ranking,
    "p6_found": p6_found,
    "p6_distances": p6_distances,
}

_TOP = """
WITH best AS (
  SELECT query_id, video_id, keyframe_uid, score, rank,
         row_number() OVER (PARTITION BY query_id, video_id, keyframe_uid ORDER BY score DESC, rank NULLS LAST) AS r
  FROM candidates WHERE video_id IS NOT NULL AND keyframe_uid IS NOT NULL AND isfinite(score)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, rank NULLS LAST, keyframe_uid) AS position FROM best WHERE r = 1
)
"""

_MERGED = """
WITH once AS (
  SELECT query_id, source, item_id, rank::DOUBLE AS rank, score, weight FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, source, item_id ORDER BY rank NULLS LAST, score NULLS LAST) AS r
    FROM (SELECT query_id, source, item_id, rank, CASE WHEN isfinite(score) THEN score END AS score FROM ranked_scores)
    WHERE query_id IS NOT NULL AND source IS NOT NULL AND item_id IS NOT NULL
  ) JOIN source_weights USING (source) WHERE r = 1 AND weight > 0
), sign AS (
  SELECT query_id, source, CASE WHEN covar_samp(rank, score) > 0 THEN 1 ELSE -1 END AS sign FROM once GROUP BY ALL
), placed AS (
  SELECT *, CASE WHEN score IS NULL THEN rank ELSE rank() OVER (PARTITION BY query_id, source ORDER BY score * sign NULLS LAST)::DOUBLE END AS place
  FROM once JOIN sign USING (query_id, source)
), places AS (SELECT query_id, source, item_id, weight, place FROM placed WHERE place IS NOT NULL
), lists AS (
  SELECT query_id, source, max(weight) AS weight, greatest(max(place), count(*)::DOUBLE) + 1 AS behind FROM places GROUP BY ALL
), items AS (SELECT query_id, item_id, count(*) AS n_sources FROM places GROUP BY ALL
), full_ranks AS (
  SELECT i.query_id, i.item_id, i.n_sources, l.weight, coalesce(p.place, l.behind) AS r
  FROM items i JOIN lists l USING (query_id) LEFT JOIN places p ON p.query_id = i.query_id AND p.source = l.source AND p.item_id = i.item_id
), summed AS (
  SELECT *, sum(weight) OVER (PARTITION BY query_id, item_id ORDER BY r, weight ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY query_id, item_id) AS total
  FROM full_ranks
), ranks AS (
  SELECT query_id, item_id, max(n_sources) AS n_sources, min(r) FILTER (upto * 2 >= total * (1 - 1e-9::DOUBLE)) AS median_rank,
         round(sum(weight * r) / sum(weight), 9) AS mean_rank
  FROM summed GROUP BY ALL
), final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, item_id) AS position FROM ranks)
"""

_NEAREST = """
WITH seg AS (
  SELECT DISTINCT segment_id, upper(trim(video_id)) AS video_id,
         CAST(floor(start_sec * 1000 + 0.5) AS BIGINT) AS s, CAST(floor(end_sec * 1000 + 0.5) AS BIGINT) AS t
  FROM asr_segments WHERE video_id IS NOT NULL AND isfinite(start_sec) AND isfinite(end_sec) AND abs(start_sec) < 4e15 AND abs(end_sec) < 4e15
), kf AS (
  SELECT DISTINCT keyframe_uid, video_id, CAST(floor(timestamp_sec * 1000 + 0.5) AS BIGINT) * 2 AS kt
  FROM keyframes WHERE isfinite(timestamp_sec) AND timestamp_sec >= 0 AND keyframe_uid IS NOT NULL
), pairs AS (
  SELECT segment_id, keyframe_uid, abs(s + t - kt) AS d,
         row_number() OVER (PARTITION BY segment_id, seg.video_id, s + t ORDER BY abs(s + t - kt), keyframe_uid) AS r
  FROM seg JOIN kf ON kf.video_id = seg.video_id AND kt BETWEEN s + t - 4000 AND s + t + 4000 WHERE s >= 0 AND s < t
)
"""

ORACLES = {
    "p2_found": f"{_TOP} SELECT query_id, video_id, keyframe_uid FROM placed WHERE position <= 3",
    "p2_positions": f"{_TOP} SELECT query_id, video_id, keyframe_uid, score, rank, position FROM placed WHERE position <= 3",
    "p5_found": f"{_MERGED} SELECT query_id, item_id FROM final WHERE position = 1",
    "p5_ranking": f"{_MERGED} SELECT query_id, item_id, median_rank, mean_rank, n_sources, position FROM final",
    "p6_found": f"{_NEAREST} SELECT segment_id, keyframe_uid FROM pairs WHERE r = 1",
    "p6_distances": f"{_NEAREST} SELECT CAST(floor(d / 200) AS BIGINT) AS tenth_sec, count(*) AS n_segments FROM pairs WHERE r = 1 GROUP BY 1",
}
