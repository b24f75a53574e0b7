"""Keyframe-to-frame mappings: joining, validation, and a summary per video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reelspark.functions.keys import is_finite
from reelspark.operators.sequence import previous_value

KEY = ["video_id", "keyframe_index"]


def last_mapping(mappings: DataFrame, order: str) -> DataFrame:
    """One mapping per (video, index): the one delivered last by ``order``."""
    place = F.row_number().over(W.Window.partitionBy(*KEY).orderBy(F.desc(order)))
    return mappings.withColumn("__place", place).where("__place = 1").drop("__place")


def first_keyframes(keyframes: DataFrame) -> DataFrame:
    """Rows (video_id, keyframe_uid): the first mapped keyframe of every video by time, then key."""
    good = mapped_only(keyframes).where("video_id is not null and keyframe_uid is not null")
    return good.groupBy("video_id").agg(F.min(F.struct("timestamp_sec", "keyframe_uid"))["keyframe_uid"].alias("keyframe_uid"))


def mapped_only(keyframes: DataFrame) -> DataFrame:
    """Keyframes with a frame and a finite time."""
    there = F.col("original_frame_id").isNotNull() & F.col("timestamp_sec").isNotNull()  # these reach the scan
    return keyframes.where(there & is_finite(F.col("timestamp_sec")))


def nearest_keyframes(moments: DataFrame, keyframes: DataFrame, cell_sec: float = 3_600.0) -> DataFrame:
    """``moments`` (with video_id, at_sec) with the nearest mapped keyframe of their video, at any distance.

    Adds keyframe_uid and distance_sec; equal distances go to the smaller key. Moments of a
    video without mapped keyframes, and those without a video or a finite time, give no
    row; extra columns stay. Neighbours are found within time cells, so a video of any
    length spreads over tasks; the last and first keyframe of each cell, one slim row, is
    carried to the cells around it.
    """
    cell = F.floor(F.col("at_sec") / cell_sec)
    asked = moments.where(F.col("video_id").isNotNull() & is_finite(F.col("at_sec")))
    asked = asked.select(F.struct(*moments.columns).alias("moment"), "video_id", F.col("at_sec").cast("double").alias("at_sec"), F.lit(None).cast("string").alias("uid"))
    points = mapped_only(keyframes).where("video_id is not null").groupBy("video_id", F.col("timestamp_sec").cast("double").alias("at_sec")).agg(F.min("keyframe_uid").alias("uid"))
    points = points.where("uid is not null").select(F.lit(None).cast(asked.schema["moment"].dataType).alias("moment"), "video_id", "at_sec", "uid")
    rows = asked.unionByName(points).withColumn("cell", cell)
    point = F.when(F.col("uid").isNotNull(), F.struct("at_sec", "uid"))
    # Keyframes first among equal times, so that both neighbours of a moment may be itself.
    order = ["at_sec", F.col("uid").isNull()]
    inside = W.Window.partitionBy("video_id", "cell").orderBy(*order)
    back = W.Window.partitionBy("video_id", "cell").orderBy(F.desc("at_sec"), F.col("uid").isNull())
    rows = rows.withColumn("before", F.last(point, ignorenulls=True).over(inside)).withColumn("after", F.last(point, ignorenulls=True).over(back))
    slim = rows.groupBy("video_id", "cell").agg(F.min(point).alias("low"), F.max(point).alias("high"))
    by_cell = W.Window.partitionBy("video_id").orderBy("cell")
    behind = W.Window.partitionBy("video_id").orderBy(F.desc("cell"))
    slim = slim.select(
        "video_id",
        "cell",
        F.last("high", ignorenulls=True).over(by_cell.rowsBetween(W.Window.unboundedPreceding, -1)).alias("carried"),
        F.last("low", ignorenulls=True).over(behind.rowsBetween(W.Window.unboundedPreceding, -1)).alias("coming"),
    )
    both = rows.where("moment is not null").join(slim, ["video_id", "cell"])
    near = lambda p: F.when(p.isNotNull(), F.struct(F.abs(p["at_sec"] - F.col("at_sec")).alias("d"), p["uid"].alias("uid")))
    best = F.least(near(F.coalesce("before", "carried")), near(F.coalesce("after", "coming")))
    found = both.select("moment", best.alias("best")).where("best is not null")
    return found.select("moment.*", F.col("best.uid").alias("keyframe_uid"), F.col("best.d").alias("distance_sec"))


def mapped_keyframes(keyframes: DataFrame, mappings: DataFrame, videos: DataFrame) -> DataFrame:
    """Keyframes (uid, video_id, keyframe_index) with frame, time = frame / fps, and whether they are mapped."""
    fps = videos.groupBy("video_id").agg(F.max("fps").alias("fps"))
    rows = keyframes.join(mappings.select(*KEY, "original_frame_id"), KEY, "left").join(fps, "video_id", "left")
    seconds = F.when(F.col("fps") > 0, F.col("original_frame_id") / F.col("fps"))
    return rows.select(*keyframes.columns, "original_frame_id", seconds.alias("timestamp_sec"), F.col("original_frame_id").isNotNull().alias("has_mapping"))


def out_of_bounds(mappings: DataFrame, videos: DataFrame, tolerance_sec: float = 1.0) -> DataFrame:
    """Rows (video_id, keyframe_index, original_frame_id, reason) of frames a known video cannot have.

    ``bounds``: negative, or not below a known frame count. ``duration``: later than the
    duration allows; of the keys without a bounds error at most the first per video.
    """
    known = mappings.join(videos.select("video_id", "fps", "frame_count", "duration_sec"), "video_id")
    outside = (F.col("original_frame_id") < 0) | F.coalesce(F.col("original_frame_id") >= F.col("frame_count"), F.lit(False))
    bounds = known.where(outside).select(*KEY, "original_frame_id", F.lit("bounds").alias("reason"))
    late = known.where((F.col("fps") > 0) & (F.col("original_frame_id") / F.col("fps") > F.col("duration_sec") + tolerance_sec))
    late = late.join(bounds.select(*KEY).distinct(), KEY, "left_anti")
    first = late.groupBy("video_id").agg(F.min(F.struct("keyframe_index", "original_frame_id")).alias("f"))
    duration = first.select("video_id", "f.keyframe_index", "f.original_frame_id", F.lit("duration").alias("reason"))
    return bounds.unionByName(duration)


def non_monotonic_videos(mappings: DataFrame) -> DataFrame:
    """Videos in which the frame decreases while the keyframe index grows; equal frames are no decrease."""
    return previous_value(mappings, "video_id", "keyframe_index", "original_frame_id").where(F.col("original_frame_id") < F.col("previous")).select("video_id").distinct()


def duplicate_frames(mappings: DataFrame) -> DataFrame:
    """Rows (video_id, original_frame_id, n) of frames that several mappings point to."""
    return mappings.groupBy("video_id", "original_frame_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate_mapping(keyframes: DataFrame, videos: DataFrame, mappings: DataFrame, tolerance_sec: float = 1.0) -> DataFrame:
    """Rows (metric, n): the eight counters of a mapping check.

    ``videos`` has one row per video_id. Keyframes without an index count as unmapped.
    """
    keys = mappings.select(*KEY).distinct()
    frames = keyframes.select(*KEY)
    indexed = frames.where("keyframe_index is not null").distinct()
    matched = frames.join(keys, KEY, "left_semi")

    def count(df: DataFrame, metric: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "n")

    parts = [
        count(matched, "matched"),
        count(frames.join(keys, KEY, "left_anti"), "missing_mapping"),
        count(mappings.select(*KEY).join(indexed, KEY, "left_anti"), "missing_image"),
        count(mappings.select("video_id").join(videos, "video_id", "left_anti"), "unknown_video"),
        count(out_of_bounds(mappings, videos, tolerance_sec), "invalid_frame"),
        count(mappings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "duplicate_index"),
        count(duplicate_frames(mappings), "duplicate_frame"),
        count(non_monotonic_videos(mappings), "non_monotonic"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Which counter raises which issue. Missing images raise none.
ISSUES = (
    ("duplicate_index", "HIGH", "duplicate_mapping_keyframe_index"),
    ("unknown_video", "HIGH", "mapping_unknown_video"),
    ("missing_mapping", "HIGH", "keyframe_mapping_missing"),
    ("invalid_frame", "HIGH", "mapping_frame_out_of_bounds"),
    ("duplicate_frame", "MEDIUM", "duplicate_original_frame_mapping"),
    ("non_monotonic", "HIGH", "non_monotonic_mapping"),
)


def mapping_issues(counts: DataFrame) -> DataFrame:
    """Rows (severity, code, n) of the issues that validate_mapping()'s counters raise."""
    rules = F.create_map(*[F.lit(x) if isinstance(x, str) else x for m, s, c in ISSUES for x in (m, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code")))])
    rule = F.try_element_at(rules, F.col("metric"))
    return counts.where("n > 0").select(rule["severity"].alias("severity"), rule["code"].alias("code"), "n").where("code is not null")


def mapping_summary(keyframes: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per video: keyframes, mappings, matched and missing keyframes, and whether frames are monotonic."""
    k = keyframes.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_keyframes"), F.count(F.when(F.col("has_mapping"), 1)).alias("n_matched"))
    m = mappings.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_mappings"))
    bad = non_monotonic_videos(mappings).withColumn("bad", F.lit(True))
    rows = k.join(m, "video_id", "full").join(bad, "video_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.select(
        "video_id",
        zero("n_keyframes").alias("n_keyframes"),
        zero("n_mappings").alias("n_mappings"),
        zero("n_matched").alias("n_matched"),
        (zero("n_keyframes") - zero("n_matched")).alias("n_missing"),
        F.col("bad").isNull().alias("monotonic"),
    )
