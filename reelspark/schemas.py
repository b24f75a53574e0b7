"""Explicit schemas of the tables that plans exchange, and checks of their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_ATOMS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType()}


def _parts(text: str) -> list[str]:
    """The pieces between commas that stand outside angle brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def _type(text: str) -> T.DataType:
    kind, _, inner = text.partition("<")
    inner = inner.removesuffix(">")
    if kind == "array":
        return T.ArrayType(_type(inner))
    if kind == "map":
        key, value = _parts(inner)
        return T.MapType(_type(key), _type(value))
    if kind == "struct":
        return T.StructType([T.StructField(n, _type(t)) for n, t in (p.split(":", 1) for p in _parts(inner))])
    return _ATOMS[kind]


def _fields(text: str) -> T.StructType:
    """A schema from "name type, ..." without the help of a running session."""
    return T.StructType([T.StructField(n, _type(t)) for n, t in (p.split(" ", 1) for p in _parts(text))])


VIDEO = _fields(
    "video_id string, video_path string, group_id string, fps double, frame_count bigint, duration_sec double, width bigint, height bigint, "
    "video_codec string, audio_codec string, audio_sample_rate bigint, audio_channels bigint, has_audio boolean, container string, "
    "file_size_bytes bigint, is_readable boolean, bitrate bigint, probe_error string"
)
KEYFRAME = _fields(
    "keyframe_uid string, video_id string, keyframe_index bigint, keyframe_path string, original_frame_id bigint, timestamp_sec double, "
    "width bigint, height bigint, file_size_bytes bigint, is_readable boolean, has_mapping boolean, image_mode string, read_error string"
)
MAPPING = _fields("video_id string, keyframe_index bigint, original_frame_id bigint, source_path string")
EMBEDDING = _fields("keyframe_uid string, embedding array<float>")
CANDIDATE = _fields(
    "query_id string, source string, keyframe_uid string, video_id string, original_frame_id bigint, timestamp_sec double, keyframe_path string, score double, rank int"
)
OCR = _fields("record_id string, keyframe_uid string, text string, bbox array<double>, confidence double")
ASR = _fields("segment_id string, video_id string, start_sec double, end_sec double, text string")
METADATA = _fields("video_id string, fields map<string,string>")
EVENT_QUERY = _fields("query_id string, event_index int, text string, context string, retrieval_text string")
GROUND_TRUTH = _fields("query_id string, task string, video_id string, frame_windows array<struct<start:bigint,end:bigint>>, answer string")
SUBMISSION = _fields("query_id string, task string, rank int, video_id string, frame_ids array<bigint>, answer string")
ARCHIVE = _fields("filename string, download_url string, category string, state string, size_bytes bigint, sha256 string, updated_at string, error string")
ISSUE = _fields("severity string, code string, message string, affected_ids array<string>")
EXPERIMENT = _fields(
    "experiment_id string, task string, dataset_snapshot string, encoder string, sources array<string>, model_revisions map<string,string>, "
    "config map<string,string>, metrics map<string,double>, latency_ms map<string,double>, git_commit string, notes string, created_at string"
)


class ContractError(ValueError):
    """Input that breaks the contract of an operator."""


def require(df: DataFrame, schema: T.StructType, label: str) -> DataFrame:
    """``df`` with the columns of ``schema`` in order, cast; missing columns are an error."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ContractError(f"{label} lacks the columns {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """``df`` itself, unless a key occurs more than once."""
    if not duplicate_keys(df, *keys).isEmpty():
        raise ContractError(f"{label}: {', '.join(keys)} must be unique")
    return df


def require_matches(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """``left`` itself, unless one of its keys is missing from ``right``."""
    if not left.join(right.select(key), key, "left_anti").isEmpty():
        raise ContractError(f"{label}: some {key} have no match")
    return left
