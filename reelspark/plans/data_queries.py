"""Queries of the general data operators: intervals, references and load profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.keys import clean_key, whole_ms
from reelspark.operators.intervals import periods_and_gaps
from reelspark.operators.quality import ColumnCheck, column_profile, column_states, departing_loads, merge_column_states, profile_loads
from reelspark.operators.references import orphan_report, reference_states
from reelspark.session import table

KEYFRAME_CHECKS = (ColumnCheck("original_frame_id"), ColumnCheck("timestamp_sec"))
VIDEO_CHECKS = (ColumnCheck("fps", strict=True), ColumnCheck("duration_sec"))
_ID, _SINCE = r"^L[0-9]+_V[0-9]+$", "2000-01-01 00:00:00"
#: Every column of the two tables.
ALL_CHECKS = {
    "keyframes": (
        ColumnCheck("keyframe_uid", pattern=r"^L[0-9]+_V[0-9]+:[0-9]{6,}$"), ColumnCheck("video_id", pattern=_ID), ColumnCheck("keyframe_index"), ColumnCheck("keyframe_path", pattern=r"[.](jpg|jpeg|png|webp)$"),
        *KEYFRAME_CHECKS, ColumnCheck("width", strict=True), ColumnCheck("height", strict=True), ColumnCheck("file_size_bytes", strict=True), ColumnCheck("is_readable"), ColumnCheck("has_mapping"),
        ColumnCheck("image_mode"), ColumnCheck("read_error"), ColumnCheck("load_id"), ColumnCheck("ingested_at", since=_SINCE),
    ),
    "videos": (
        ColumnCheck("video_id", pattern=_ID), ColumnCheck("video_path", pattern=r"[.](mp4|mkv|webm|mov|avi)$"), ColumnCheck("group_id", pattern=r"^L[0-9]+$"), *VIDEO_CHECKS, ColumnCheck("frame_count", strict=True),
        ColumnCheck("width", strict=True), ColumnCheck("height", strict=True), ColumnCheck("video_codec"), ColumnCheck("audio_codec"), ColumnCheck("audio_sample_rate", strict=True), ColumnCheck("audio_channels", most=64),
        ColumnCheck("has_audio"), ColumnCheck("container"), ColumnCheck("file_size_bytes", strict=True), ColumnCheck("is_readable"), ColumnCheck("bitrate", strict=True), ColumnCheck("probe_error"),
        ColumnCheck("load_id"), ColumnCheck("ingested_at", since=_SINCE),
    ),
}


def valid_segments(segments: DataFrame) -> DataFrame:
    """Speech segments with a video and 0 <= start < end in whole milliseconds, keys cleaned."""
    return segments.select(
        "segment_id",
        clean_key(F.col("video_id")).alias("video_id"),
        whole_ms(F.col("start_sec")).alias("start_ms"),
        whole_ms(F.col("end_sec")).alias("end_ms"),
    ).where("video_id is not null and start_ms >= 0 and start_ms < end_ms")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous speech periods of every video and the gaps between them."""
    return periods_and_gaps(valid_segments(table(spark, sf_dir, "asr_segments")), "video_id", "start_ms", "end_ms")


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech and silence per video: numbers and lengths of periods and gaps."""
    rows = p1_found(spark, sf_dir)
    length = F.col("end_ms") - F.col("start_ms")
    is_period = F.col("kind") == "period"
    return rows.groupBy("video_id").agg(
        F.count(F.when(is_period, 1)).alias("n_periods"),
        F.count(F.when(~is_period, 1)).alias("n_gaps"),
        F.sum(F.when(is_period, length).otherwise(0)).alias("speech_ms"),
        F.sum(F.when(~is_period, length).otherwise(0)).alias("gap_ms"),
    )


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = table(spark, sf_dir, "removed_keys")
    ocr = reference_states(
        table(spark, sf_dir, "ocr_records"), "record_id", "keyframe_uid", "ingested_at",
        table(spark, sf_dir, "keyframes"), "keyframe_uid", "ingested_at",
        removed.where("entity = 'keyframe'"), "key_value", "removed_at",
    )
    asr = reference_states(
        table(spark, sf_dir, "asr_segments"), "segment_id", "video_id", "ingested_at",
        table(spark, sf_dir, "videos"), "video_id", "ingested_at",
        removed.where("entity = 'video'"), "key_value", "removed_at",
    )
    both = ocr.withColumn("child_table", F.lit("ocr_records")).unionByName(asr.withColumn("child_table", F.lit("asr_segments")))
    return both.select("child_table", "child_key", "status", F.date_format("child_time", "yyyy-MM").alias("period"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose reference is missing, removed or late."""
    return _references(spark, sf_dir)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of such records per table, month and state."""
    return orphan_report(_references(spark, sf_dir))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_loads(
        [
            (table(spark, sf_dir, "keyframes"), "keyframes", KEYFRAME_CHECKS, "load_id"),
            (table(spark, sf_dir, "videos"), "videos", VIDEO_CHECKS, "load_id"),
        ]
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of a column outside the control limits."""
    return departing_loads(_profiles(spark, sf_dir))


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the four checked columns in every load."""
    shares = ["null_share", "invalid_share", "distinct_share"]
    profiles = _profiles(spark, sf_dir)
    return profiles.select(
        "table_name", "column_name", "load_id", "n_rows", "n_null", "n_valid", "n_distinct",
        *[F.round(c, 6).alias(c) for c in ("min_value", "max_value", "center", *shares)],
    )


def p4_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, pattern and bound violations and ranges of every column in every load."""
    states = [column_states(table(spark, sf_dir, name), name, checks, "load_id") for name, checks in ALL_CHECKS.items()]
    profiles = column_profile(merge_column_states(*states))
    return profiles.select("table_name", "column_name", "load_id", "n_rows", "n_null", "n_valid", *[F.round(c, 6).alias(c) for c in ("min_value", "max_value", "null_share", "invalid_share")])


QUERIES = {
    "p1_found": p1_found,
    "p1_coverage": p1_coverage,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_profile": p4_profile,
    "p4_columns": p4_columns,
}

_SEGMENTS = """
seg AS (
  SELECT segment_id, upper(trim(video_id)) AS video_id,
         CASE WHEN isfinite(start_sec) AND abs(start_sec) <= 4e15 THEN CAST(floor(start_sec * 1000 + 0.5) AS BIGINT) END AS s,
         CASE WHEN isfinite(end_sec) AND abs(end_sec) <= 4e15 THEN CAST(floor(end_sec * 1000 + 0.5) AS BIGINT) END AS t
  FROM asr_segments
), valid AS (SELECT * FROM seg WHERE video_id IS NOT NULL AND s >= 0 AND s < t)
"""

_PERIODS = f"""
{_SEGMENTS}, runs AS (
  SELECT video_id, s, t, max(t) OVER (PARTITION BY video_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
  FROM (SELECT DISTINCT video_id, s, t FROM valid)
), marked AS (
  SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS g FROM runs
), periods AS (SELECT video_id, min(s) AS a, max(t) AS b FROM marked GROUP BY video_id, g
), found AS (
  SELECT video_id, 'period' AS kind, a AS start_ms, b AS end_ms FROM periods
  UNION ALL
  SELECT video_id, 'gap', b, n FROM (SELECT *, lead(a) OVER (PARTITION BY video_id ORDER BY a) AS n FROM periods) WHERE n IS NOT NULL
)
"""


def _orphans(child: str, key: str, ref: str, parent: str, parent_key: str, entity: str) -> str:
    return f"""
  SELECT '{child}' AS child_table, c.k AS child_key,
         CASE WHEN r.at IS NOT NULL AND (p.last_at IS NULL OR p.last_at <= r.at) THEN 'removed'
              WHEN p.first_at IS NULL THEN 'missing' WHEN p.first_at > c.at THEN 'late' END AS status,
         strftime(c.at, '%Y-%m') AS period
  FROM (SELECT {key} AS k, upper(trim({ref})) AS ref, min(ingested_at) AS at FROM {child} WHERE {ref} IS NOT NULL GROUP BY 1, 2) c
  LEFT JOIN (SELECT {parent_key} AS ref, min(ingested_at) AS first_at, max(ingested_at) AS last_at FROM {parent} GROUP BY 1) p ON p.ref = c.ref
  LEFT JOIN (SELECT upper(trim(key_value)) AS ref, max(removed_at) AS at FROM removed_keys WHERE entity = '{entity}' GROUP BY 1) r ON r.ref = c.ref
"""


_ORPHANS = f"""
WITH found AS (SELECT * FROM (
{_orphans("ocr_records", "record_id", "keyframe_uid", "keyframes", "keyframe_uid", "keyframe")}
UNION ALL
{_orphans("asr_segments", "segment_id", "video_id", "videos", "video_id", "video")}
) WHERE status IS NOT NULL)
"""

_PROFILES = """
WITH v AS (
  SELECT 'keyframes' AS table_name, 'original_frame_id' AS column_name, load_id, original_frame_id::DOUBLE AS value, 0 AS strict FROM keyframes
  UNION ALL SELECT 'keyframes', 'timestamp_sec', load_id, timestamp_sec, 0 FROM keyframes
  UNION ALL SELECT 'videos', 'fps', load_id, fps, 1 FROM videos
  UNION ALL SELECT 'videos', 'duration_sec', load_id, duration_sec, 0 FROM videos
), checked AS (
  SELECT *, coalesce(isfinite(value) AND (CASE WHEN strict = 1 THEN value > 0 ELSE value >= 0 END), FALSE) AS valid FROM v
), prof AS (
  SELECT table_name, column_name, load_id, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_null,
         count(*) FILTER (valid) AS n_valid, count(DISTINCT value) FILTER (valid) AS n_distinct,
         min(value) FILTER (valid) AS min_value, max(value) FILTER (valid) AS max_value, median(value) FILTER (valid) AS center
  FROM checked GROUP BY ALL
), shares AS (
  SELECT *, n_null / n_rows AS null_share,
         CASE WHEN n_rows > n_null THEN (n_rows - n_null - n_valid) / (n_rows - n_null) END AS invalid_share,
         CASE WHEN n_valid > 0 THEN n_distinct / n_valid END AS distinct_share
  FROM prof
)
"""



def _columns_sql() -> str:
    """The same checks and figures for every column, one SELECT each."""
    text = "keyframe_uid video_id keyframe_path image_mode read_error video_path group_id video_codec audio_codec container probe_error".split()
    parts = []
    for name, checks in ALL_CHECKS.items():
        for c in checks:
            x = c.column
            if x in text:
                good, size = f"regexp_matches({x}, '{c.pattern}')" if c.pattern else f"trim({x}) <> ''", f"length({x})::DOUBLE"
            elif x == "ingested_at":
                good, size = f"{x} >= TIMESTAMP '{c.since}'", f"epoch_us({x}) / 1e6::DOUBLE"
            elif x in ("is_readable", "has_mapping", "has_audio"):
                good, size = f"{x} IS NOT NULL", f"{x}::INTEGER::DOUBLE"
            else:
                bound = (f" AND {x} {'>' if c.strict else '>='} {c.least}" if c.least is not None else "") + (f" AND {x} <= {c.most}" if c.most is not None else "")
                good, size = f"isfinite({x}::DOUBLE){bound}", f"{x}::DOUBLE"
            parts.append(f"""SELECT '{name}' AS table_name, '{x}' AS column_name, load_id, count(*) AS n_rows, count(*) FILTER ({x} IS NULL) AS n_null, count(*) FILTER ({good}) AS n_valid,
  round(min({size}) FILTER ({good}), 6) AS min_value, round(max({size}) FILTER ({good}), 6) AS max_value FROM {name} GROUP BY load_id""")
    return f"""SELECT *, round(n_null / n_rows, 6) AS null_share, round(CASE WHEN n_rows > n_null THEN (n_rows - n_null - n_valid) / (n_rows - n_null) END, 6) AS invalid_share FROM ({" UNION ALL ".join(parts)})"""


ORACLES = {
    "p4_columns": _columns_sql(),
    "p1_found": f"WITH {_PERIODS} SELECT * FROM found",
    "p1_coverage": f"""WITH {_PERIODS}
SELECT video_id, count(*) FILTER (kind = 'period') AS n_periods, count(*) FILTER (kind = 'gap') AS n_gaps,
       CAST(sum(CASE WHEN kind = 'period' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS speech_ms,
       CAST(sum(CASE WHEN kind = 'gap' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS gap_ms
FROM found GROUP BY video_id""",
    "p3_found": f"{_ORPHANS} SELECT * FROM found",
    "p3_report": f"{_ORPHANS} SELECT child_table, period, status, count(*) AS n_records FROM found GROUP BY ALL",
    "p4_found": f"""{_PROFILES}, usual AS (
  SELECT table_name, column_name, median(null_share) AS un, median(invalid_share) AS ui, median(center) AS uc, median(distinct_share) AS ud
  FROM shares GROUP BY ALL
), j AS (SELECT * FROM shares JOIN usual USING (table_name, column_name))
SELECT table_name, column_name, load_id, 'nulls' AS symptom FROM j WHERE null_share > un + 0.1
UNION ALL SELECT table_name, column_name, load_id, 'invalid' FROM j WHERE invalid_share > ui + 0.1
UNION ALL SELECT table_name, column_name, load_id, 'center' FROM j WHERE center > uc * 2 OR center < uc / 2
UNION ALL SELECT table_name, column_name, load_id, 'distinct' FROM j WHERE distinct_share < ud * 0.5""",
    "p4_profile": f"""{_PROFILES}
SELECT table_name, column_name, load_id, n_rows, n_null, n_valid, n_distinct, round(min_value, 6) AS min_value, round(max_value, 6) AS max_value,
       round(center, 6) AS center, round(null_share, 6) AS null_share, round(invalid_share, 6) AS invalid_share, round(distinct_share, 6) AS distinct_share
FROM shares""",
}
