"""Audit reports over manifests: distributions, gaps, roll-ups, set differences, JSON fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reelspark.functions.keys import is_finite
from reelspark.operators.sequence import numeric_profile, previous_value

# Issue severities in the order in which they are listed.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def value_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column_name, value, n); nulls, empty strings and "N/A" are left out."""
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(F.explode(entries).alias("e")).select("e.*").where("value is not null and value <> '' and value <> 'N/A'")
    return rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def keyframe_gaps(keyframes: DataFrame, videos: DataFrame) -> DataFrame:
    """Rows (video_id, keyframe_index, gap_sec): time from the mapped keyframe before, by index."""
    fps = videos.where("fps > 0").groupBy("video_id").agg(F.max("fps").alias("fps"))
    mapped = keyframes.where("original_frame_id is not null").select("video_id", "keyframe_index", "original_frame_id").distinct()
    gaps = previous_value(mapped, "video_id", "keyframe_index", "original_frame_id").where("previous is not null")
    return gaps.join(fps, "video_id").select("video_id", "keyframe_index", ((F.col("original_frame_id") - F.col("previous")) / F.col("fps")).alias("gap_sec"))


def group_durations(videos: DataFrame) -> DataFrame:
    """Videos and hours per group, and in all (``is_total``); the total also holds videos without a group."""
    good = F.when(is_finite(F.col("duration_sec")), F.col("duration_sec"))
    both = videos.rollup("group_id").agg(
        F.grouping("group_id").cast("boolean").alias("is_total"), F.count(F.lit(1)).alias("n_videos"), F.round(F.sum(good) / 3600, 6).alias("hours")
    )
    return both.where(F.col("is_total") | F.col("group_id").isNotNull()).select("group_id", "is_total", "n_videos", "hours")


def video_checks(videos: DataFrame, tolerance_sec: float = 1.0) -> DataFrame:
    """Rows (video_id, problem): unreadable, invalid geometry, or a duration that frames and fps contradict."""
    ok = lambda c: F.coalesce(is_finite(F.col(c)) & (F.col(c) > 0), F.lit(False))
    readable = F.coalesce("is_readable", F.lit(False))
    timed = ok("fps") & ok("duration_sec") & ok("frame_count")
    problems = F.array_compact(
        F.array(
            F.when(~readable, F.lit("unreadable")),
            F.when(readable & ~(ok("fps") & ok("duration_sec") & ok("width") & ok("height")), F.lit("invalid geometry")),
            F.when(timed & (F.abs(F.try_divide(F.col("frame_count").cast("double"), "fps") - F.col("duration_sec")) > tolerance_sec), F.lit("duration mismatch")),
        )
    )
    return videos.select("video_id", F.explode(problems).alias("problem"))


def id_differences(sets: dict[str, DataFrame], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows (difference, id): ids of the one set that the other lacks; each frame has one column ``id``."""
    out = None
    for a, b in pairs:
        left = sets[a].where("id is not null").distinct()
        one = left.join(sets[b], "id", "left_anti").select(F.lit(f"{a} - {b}").alias("difference"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def json_profile(df: DataFrame, column: str) -> DataFrame:
    """Rows (field, type, n_present, presence_rate, n_empty): the top-level fields of JSON objects by type.

    Texts that are no JSON object are not in the base of the rate, which is of the field over
    all its types. Types are those of the values themselves: a number in quotes is a string.
    A value is empty if it is null, "", [] or {}.
    """
    objects = df.where(F.json_object_keys(column).isNotNull()).select(F.from_json(F.col(column), "map<string,variant>").alias("m"))
    n = objects.agg(F.count(F.lit(1))).collect()[0][0]
    entries = objects.select(F.explode("m").alias("field", "v"))
    told = F.schema_of_variant(F.col("v"))
    kind = (
        F.when(told.isNull() | (told == "VOID"), "null")
        .when(told.startswith("OBJECT"), "object")
        .when(told.startswith("ARRAY"), "array")
        .when(told == "BOOLEAN", "boolean")
        .when(told == "STRING", "string")
        .otherwise("number")
    )
    text = F.to_json("v")
    empty = text.isNull() | text.isin("null", '""', "[]", "{}")
    counts = entries.groupBy("field", kind.alias("type")).agg(F.count(F.lit(1)).alias("n_present"), F.count(F.when(empty, 1)).alias("n_empty"))
    whole = F.sum("n_present").over(W.Window.partitionBy("field"))
    return counts.select("field", "type", "n_present", (whole / F.lit(float(n or 1))).alias("presence_rate"), "n_empty")


def frames_in_windows(videos: DataFrame, seconds: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Per half-width of a window in seconds: the profile of the frames it holds at the videos' rates."""
    rows = videos.select(*[(F.col("fps") * 2 * s).alias(f"plus_minus_{s}_sec") for s in seconds])
    return numeric_profile(rows, rows.columns).withColumnRenamed("column_name", "window")


def storage_by_component(files: DataFrame) -> DataFrame:
    """Rows (component, n_files, total_bytes, n_empty, largest) from (component, path, length)."""
    return files.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("total_bytes"), F.count(F.when(F.col("length") == 0, 1)).alias("n_empty"), F.max("length").alias("largest")
    )


def largest_files(files: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest files of (path, length)."""
    return files.orderBy(F.desc("length"), "path").limit(n)


def stratified_sample(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows per group in the order of a seeded hash of the key; the same rows every time."""
    place = F.row_number().over(W.Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key))
    return df.withColumn("sample_rank", place).where(F.col("sample_rank") <= n)


def ordered_issues(issues: DataFrame) -> DataFrame:
    """Distinct issues by severity, code and message."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")), F.lit(0))
    once = issues.dropDuplicates(["severity", "code", "message"])
    return once.withColumn("__rank", F.when(rank == 0, 99).otherwise(rank)).orderBy("__rank", "code", "message").drop("__rank")


def archive_inventory(archives: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Expected archives (filename, download_url) with their manifest state and what lies on disk."""
    disk = files.select("filename", F.col("length").alias("disk_bytes"))
    rows = archives.join(manifest.select("filename", "download_url", "state", "size_bytes"), ["filename", "download_url"], "left").join(disk, "filename", "left")
    return rows.withColumn("on_disk", F.col("disk_bytes").isNotNull()).withColumn("size_matches", F.col("size_bytes").eqNullSafe(F.col("disk_bytes")))
