"""Queries of readers, writers and model steps: files are written from the tables, read back and compared in SQL."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark import schemas
from reelspark.functions import models
from reelspark.functions import vector as V
from reelspark.functions.text import metadata_document
from reelspark.operators import evaluation
from reelspark.plans import reference_queries as R
from reelspark.plans import branches
from reelspark.plans.reference_sql import SHOWN_METRICS, terms_sql
from reelspark.session import checkpoint_dir, materialize, table
from reelspark.sources import sinks, tables


def _folder(spark: SparkSession) -> str:
    """A folder of its own among the session's shared files."""
    return f"{checkpoint_dir(spark).rstrip('/')}/files/{uuid.uuid4().hex}"


def _json_lines(spark, d, name, *columns):
    path = _folder(spark)
    table(spark, d, name).select(F.to_json(F.struct(*columns)).alias("value")).write.text(path)
    return tables.read_jsonl(spark, path)


def ocr_artifact_check(spark, d):
    """Screen texts as JSON lines: valid ones, and what is wrong with the others."""
    rows = tables.ocr_artifacts(_json_lines(spark, d, "ocr_records", "record_id", "keyframe_uid", "text", "bbox", "confidence"))
    return rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("bbox")).alias("n_numbers"))


def asr_artifact_check(spark, d):
    """Speech segments as JSON lines: valid ones, and what is wrong with the others."""
    rows = tables.asr_artifacts(_json_lines(spark, d, "asr_segments", "segment_id", "video_id", "start_sec", "end_sec", "text"))
    return rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def line_numbers(spark, d):
    """Lines of JSON files and the sum of their numbers."""
    rows = _json_lines(spark, d, "documents", "doc_id", "text")
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("s"))
    return sizes.agg(F.sum("n").cast("bigint").alias("n_lines"), F.max(F.col("s") - F.col("n") * (F.col("n") + 1) / 2).cast("bigint").alias("off"))


_FIELDS = ("group", "codec", "box")


def _metadata(spark, d):
    path = _folder(spark)
    fields = F.create_map(F.lit("group"), F.col("group_id"), F.lit("codec"), F.col("video_codec"), F.lit("box"), F.col("container"), F.lit("path"), F.col("video_path"))
    rows = table(spark, d, "videos").select(F.to_json(F.struct("video_id", F.map_filter(fields, lambda k, v: v.isNotNull()).alias("fields"))).alias("value"))
    rows.write.text(path)
    return tables.metadata_artifacts(tables.read_jsonl(spark, path), _FIELDS)


def metadata_records(spark, d):
    """Metadata as JSON lines, read with three of their fields, as searchable texts."""
    return _metadata(spark, d).where("problem is null").select("video_id", metadata_document(F.col("fields")).alias("document"))


def mapping_files(spark, d):
    """Mappings as CSV and JSON-lines files of different names, read together."""
    path = _folder(spark)
    rows = table(spark, d, "keyframes").select("video_id", "keyframe_index", "original_frame_id", F.concat(F.lit('a "note", with '), F.col("keyframe_path")).alias("note"))
    half = F.pmod(F.col("keyframe_index"), F.lit(2))
    rows.where(half == 0).select(F.lower("video_id").alias("Video_Name"), F.col("keyframe_index").alias("keyframe_id"), "note", F.col("original_frame_id").alias("frame_idx")).write.option("header", True).option("escape", '"').csv(f"{path}/csv")
    others = rows.where(half != 0).select(F.to_json(F.struct(F.col("video_id").alias("videoid"), F.col("keyframe_index").alias("image_index"), F.col("original_frame_id").alias("frame"))).alias("value"))
    others.write.text(f"{path}/lines")
    _rename(spark, f"{path}/lines", ".txt", ".jsonl")
    found = tables.mapping_files(spark, path).where("problem is null")
    return found.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.sum("keyframe_index").alias("indices"), F.sum("original_frame_id").alias("frames"))


def _rename(spark: SparkSession, path: str, old: str, new: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):  # as many files as there were partitions
        name = status.getPath().getName()
        if name.endswith(old):
            fs.rename(status.getPath(), hadoop(f"{path}/{name.removesuffix(old)}{new}"))


def manifest_round_trip(spark, d):
    """Both manifests written and read again under their schemas."""
    path = _folder(spark)
    issues = spark.createDataFrame([], schemas.ISSUE)
    sinks.write_manifest(table(spark, d, "keyframes"), schemas.KEYFRAME, f"{path}/keyframes", issues)
    sinks.write_manifest(table(spark, d, "videos").dropDuplicates(["video_id"]), schemas.VIDEO, f"{path}/videos", issues)
    frames = tables.read_keyframes(spark, f"{path}/keyframes").agg(F.lit("keyframes").alias("manifest"), F.count(F.lit(1)).alias("n"), F.sum("original_frame_id").alias("frames"))
    videos = tables.read_videos(spark, f"{path}/videos").agg(F.lit("videos").alias("manifest"), F.count(F.lit(1)).alias("n"), F.count("video_id").alias("frames"))
    return frames.unionByName(videos)


def vector_store(spark, d):
    """Vectors appended in two runs, the second of which only adds what is missing, and the index over them."""
    path = _folder(spark)
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("embedding") == 48) & (V.norm(F.col("embedding")) > 0)
    vectors = table(spark, d, "keyframe_vectors").where(good).groupBy("keyframe_uid").agg(F.min("embedding").alias("embedding"))
    encoder = lambda keys: keys.select("keyframe_uid").join(vectors, "keyframe_uid")
    keys = vectors.select("keyframe_uid")
    first = sinks.write_vectors(keys.where(F.pmod(F.xxhash64("keyframe_uid"), F.lit(3)) == 0), encoder, f"{path}/store", "c1")
    second = sinks.write_vectors(keys, encoder, f"{path}/store", "c1", 4)
    third = sinks.write_vectors(keys, encoder, f"{path}/store", "c1")
    sinks.write_index(spark.read.parquet(f"{path}/store"), f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    return index.agg(
        F.count(F.lit(1)).alias("n"), F.lit(first + second).cast("bigint").alias("n_written"), F.lit(third).cast("bigint").alias("n_again"), F.round(F.min(V.norm(F.col("embedding"))), 5).alias("shortest")
    )


def submission_round_trip(spark, d):
    """The submission of all queries as one file, read again."""
    path = os.path.join(_folder(spark).removeprefix("file:"), "submission.json")
    rows = materialize(R._submission(spark, d).where("task <> 'trake'"))  # read for its videos, checked, sorted and written
    known = rows.select("video_id").distinct().withColumn("frame_count", F.lit(None).cast("bigint"))
    sinks.write_submission(spark, rows, known, path)
    return tables.read_submission(spark, path).select("query_id", "task", F.col("rank").cast("int").alias("rank"), "video_id", F.element_at("frame_ids", 1).alias("frame_id"), "answer")


def archive_manifest(spark, d):
    """Archives of the videos, delivered again with each load: the last state of each, after updates."""
    rows = table(spark, d, "videos").where("load_id is not null and video_id is not null")
    state = F.when(F.coalesce("is_readable", F.lit(False)), "verified").otherwise("failed")
    url = F.concat(F.lit("https://h.example/"), F.col("video_id"))
    archive = rows.groupBy("video_id", "load_id").agg(F.max(state).alias("state")).select(
        F.concat(F.lit("Videos_"), "video_id", F.lit(".zip")).alias("filename"), url.alias("download_url"), F.lit("videos").alias("category"), "state", F.lit(None).cast("bigint").alias("size_bytes"),
        F.lit(None).cast("string").alias("sha256"), F.lpad(F.col("load_id").cast("string"), 6, "0").alias("updated_at"), F.lit(None).cast("string").alias("error"),
    )
    path = _folder(spark)
    archive.where("updated_at < '000002'").select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    manifest = tables.read_archive_manifest(spark, path)
    return sinks.upsert_archives(manifest, archive).groupBy("state", "updated_at").agg(F.count(F.lit(1)).alias("n"))


def experiment_log(spark, d):
    """The metrics of every query as an experiment record, logged and read again."""
    path = _folder(spark)
    scores = evaluation.query_metrics(R._submission(spark, d), R._truth(spark, d))
    text, none = F.lit("x"), F.create_map().cast("map<string,string>")
    record = scores.select(
        F.col("query_id").alias("experiment_id"), "task", text.alias("dataset_snapshot"), text.alias("encoder"), F.array(text).alias("sources"), none.alias("model_revisions"), none.alias("config"),
        F.create_map(F.lit("final"), F.round("final_score", 9), F.lit("r_at_1"), F.col("r_at_1")).alias("metrics"), F.create_map().cast("map<string,double>").alias("latency_ms"), text.alias("git_commit"), text.alias("notes"), text.alias("created_at"),
    )
    half = F.pmod(F.xxhash64("experiment_id"), F.lit(2))
    sinks.append_experiment(record.where(half == 0), path)
    sinks.append_experiment(record.where(half != 0), path)
    log = spark.read.schema(schemas.EXPERIMENT).json(path)
    return log.select(F.col("experiment_id").alias("query_id"), "task", F.round(F.col("metrics")["final"], 9).alias("final_score"), F.col("metrics")["r_at_1"].alias("r_at_1"))


def _lengths():
    """An encoder for tests: the number of characters, and one."""
    return lambda texts: np.array([[len(t), 1.0] for t in texts])


def encoded_texts(spark, d):
    """Texts encoded in Python workers, at length 1."""
    rows = models.encode_texts(table(spark, d, "documents").select("doc_id", "text"), _lengths)
    return rows.select("doc_id", F.round(F.element_at("vector", 2).cast("double"), 4).alias("second"))


def _answerer():
    def run(images, event, question):
        if not event.strip():
            raise ValueError("no text")
        return f"{len(images)} {question}"

    return run


def model_answers(spark, d):
    """Answers of an injected answerer; a failure is a row of its own."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("event_text"), F.coalesce("lang", F.lit("none")).alias("question"), F.array(F.lit("a"), F.lit("b")).alias("images"))
    return models.answer(rows, _answerer).groupBy("raw_answer", "error").agg(F.count(F.lit(1)).alias("n"))


def _queries(spark, d):
    return R._queries(spark, d)


def _candidates(branch, spark, d):
    found = branch(_queries(spark, d), 10)
    return found.select("query_id", "rank", "keyframe_uid", "evidence_id", F.round("score", 6).alias("score"))


def asr_candidates(spark, d):
    """The ten best keyframes by speech for every twentieth document."""
    rows = table(spark, d, "asr_segments").groupBy("segment_id").agg(F.min("text").alias("text"), F.min(F.upper(F.trim("video_id"))).alias("video_id"), F.min("start_sec").alias("start_sec"), F.min("end_sec").alias("end_sec"))
    return _candidates(branches.asr_branch(rows, R._one_keyframe(spark, d)), spark, d)


def metadata_candidates(spark, d):
    """The ten best keyframes by the metadata of their videos for every twentieth document."""
    return _candidates(branches.metadata_branch(_metadata(spark, d).where("problem is null"), R._one_keyframe(spark, d)), spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        ocr_artifact_check, asr_artifact_check, line_numbers, metadata_records, mapping_files, manifest_round_trip, vector_store, submission_round_trip, archive_manifest, experiment_log, encoded_texts,
        model_answers, asr_candidates, metadata_candidates,
    )
}

_META = """SELECT DISTINCT video_id, concat_ws(' ', CASE WHEN trim(container) <> '' THEN 'box: ' || trim(container) END, CASE WHEN trim(video_codec) <> '' THEN 'codec: ' || trim(video_codec) END,
  CASE WHEN trim(group_id) <> '' THEN 'group: ' || trim(group_id) END) AS document FROM videos WHERE trim(coalesce(video_id, '')) <> ''"""
_KEYS = "kf AS (SELECT DISTINCT keyframe_uid, video_id, timestamp_sec AS t FROM keyframes WHERE original_frame_id IS NOT NULL AND isfinite(timestamp_sec))"
_BEST = """k AS (
  SELECT query_id, key, doc_id, score, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, doc_id) AS b FROM scores JOIN docs USING (doc_id) WHERE key IS NOT NULL
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM k WHERE b = 1)
SELECT query_id, rank, key AS keyframe_uid, doc_id AS evidence_id, round(score, 6) AS score FROM r WHERE rank <= 10"""
ORACLES = {
    "ocr_artifact_check": """WITH r AS (SELECT *, trim(coalesce(keyframe_uid, '')) AS k, count(*) OVER (PARTITION BY record_id) AS times FROM ocr_records)
SELECT CASE WHEN k = '' THEN 'no keyframe_uid' WHEN trim(coalesce(text, '')) = '' THEN 'no text' WHEN confidence IS NOT NULL AND (isnan(confidence) OR confidence < 0) THEN 'invalid confidence'
            WHEN times > 1 THEN 'repeated record_id' END AS problem, count(*) AS n, CAST(sum(len(bbox)) AS BIGINT) AS n_numbers FROM r GROUP BY 1""",
    "asr_artifact_check": """WITH r AS (SELECT *, count(*) OVER (PARTITION BY segment_id) AS times FROM asr_segments)
SELECT CASE WHEN trim(coalesce(video_id, '')) = '' THEN 'no video_id' WHEN trim(coalesce(text, '')) = '' THEN 'no text'
            WHEN NOT coalesce(isfinite(start_sec) AND isfinite(end_sec) AND start_sec >= 0 AND start_sec <= end_sec, FALSE) THEN 'invalid times' WHEN times > 1 THEN 'repeated segment_id' END AS problem, count(*) AS n
FROM r GROUP BY 1""",
    "line_numbers": "SELECT count(*) AS n_lines, 0::BIGINT AS off FROM documents",
    "metadata_records": f"SELECT * FROM ({_META}) WHERE document <> ''",
    "mapping_files": """SELECT video_id, count(*) AS n, CAST(sum(keyframe_index) AS BIGINT) AS indices, CAST(sum(original_frame_id) AS BIGINT) AS frames FROM keyframes
WHERE video_id IS NOT NULL AND keyframe_index IS NOT NULL AND original_frame_id IS NOT NULL GROUP BY 1""",
    "manifest_round_trip": """SELECT 'keyframes' AS manifest, count(*) AS n, CAST(sum(original_frame_id) AS BIGINT) AS frames FROM keyframes
UNION ALL SELECT 'videos', count(*), count(video_id) FROM (SELECT DISTINCT video_id FROM videos)""",
    "vector_store": """WITH g AS (SELECT DISTINCT keyframe_uid FROM keyframe_vectors WHERE len(embedding) = 48 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0)
SELECT count(*) AS n, count(*) AS n_written, 0::BIGINT AS n_again, 1.0::DOUBLE AS shortest FROM g""",
    "submission_round_trip": f"""WITH {SHOWN_METRICS["diverse"]} SELECT query_id, {SHOWN_METRICS["task"]} AS task, rank, video_id, frame_id,
  CASE WHEN {SHOWN_METRICS["task"]} = 'qna' THEN trim(['Năm', '5 people', ' five! ', 'six'][1 + frame_id % 4]) END AS answer FROM diverse WHERE {SHOWN_METRICS["task"]} <> 'trake'""",
    "archive_manifest": """WITH a AS (SELECT video_id, load_id, max(CASE WHEN coalesce(is_readable, FALSE) THEN 'verified' ELSE 'failed' END) AS state FROM videos WHERE load_id IS NOT NULL AND video_id IS NOT NULL GROUP BY ALL
), l AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY load_id DESC) AS r FROM a)
SELECT state, lpad(load_id::VARCHAR, 6, '0') AS updated_at, count(*) AS n FROM l WHERE r = 1 GROUP BY ALL""",
    "experiment_log": f"""WITH {SHOWN_METRICS["metrics"]} SELECT query_id, task, round(final_score, 9) AS final_score, r_at_1 FROM metrics""",
    "encoded_texts": "SELECT doc_id, round((1 / sqrt(length(text)::DOUBLE * length(text) + 1))::FLOAT::DOUBLE, 4) AS second FROM documents WHERE trim(text, ' ') <> ''",
    "model_answers": """SELECT CASE WHEN b THEN NULL ELSE '2 ' || q END AS raw_answer, CASE WHEN b THEN 'no text' END AS error, count(*) AS n
FROM (SELECT regexp_full_match(coalesce(text, ''), '[\\s\\p{Z}\\x{0085}\\x{001c}-\\x{001f}]*') AS b, coalesce(lang, 'none') AS q FROM documents) GROUP BY ALL""",
    "asr_candidates": f"""WITH {_KEYS}, seg AS (SELECT segment_id AS doc_id, min(text) AS text, min(upper(trim(video_id))) AS video_id, min(start_sec) + (min(end_sec) - min(start_sec)) / 2 AS mid FROM asr_segments GROUP BY 1
), near AS (SELECT doc_id, keyframe_uid AS key, row_number() OVER (PARTITION BY doc_id ORDER BY abs(t - mid), keyframe_uid) AS r FROM seg JOIN kf USING (video_id) WHERE isfinite(mid)
), {terms_sql("SELECT seg.doc_id, text, key FROM seg LEFT JOIN (SELECT * FROM near WHERE r = 1) n USING (doc_id)")}, {_BEST}""",
    "metadata_candidates": f"""WITH {_KEYS}, first_ AS (SELECT video_id, arg_min(keyframe_uid, (t, keyframe_uid)) AS key FROM kf GROUP BY 1
), {terms_sql(f"SELECT m.video_id AS doc_id, document AS text, key FROM ({_META}) m LEFT JOIN first_ USING (video_id) WHERE document <> ''")}, {_BEST}""",
}
