"""Queries of the retrieval, ranking and audit operators over the media tables, with their SQL.

Scores are rounded where they are sums or quotients, and ranks follow the rounded scores,
so that another engine's last bits cannot swap rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import vector as V
from reelspark.functions.answers import normalize_answer
from reelspark.functions.keys import is_finite
from reelspark.functions.sampling import dense_count, even_ids, frame_window, sparse_ids
from reelspark.functions.text import artifact_id, infer_group_id, infer_index, infer_video_id, keyframe_uid, metadata_document, parse_fraction, tokens
from reelspark.operators import alignment, audit, bm25, evaluation, fusion, mapping, refine, search, submission, temporal
from reelspark.operators.decompose import decompose_events
from reelspark.operators.sequence import numeric_profile
from reelspark.plans import retrieval
from reelspark.plans.branches import middle
from reelspark.plans.reference_sql import SQL
from reelspark.session import table
from reelspark.sources.tables import source_sheet

WEIGHTS = {"asr": 0.7, "btc_clip": 1.0, "fgclip2": 1.0, "ocr": 0.7, "pecore": 1.0}
CONFIG = retrieval.KisConfig(weights=WEIGHTS)
#: Sources that stand for the first, second and third of three ordered events.
EVENTS = ("btc_clip", "fgclip2", "pecore")
EVENT_POOL = 100
ALIGN = alignment.AlignmentConfig()
#: The same with a penalty and a largest gap.
GAPPED = alignment.AlignmentConfig(k_best=5, max_gap_sec=600.0, gap_penalty=0.0001)
REFINED = 10


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.ranked_lists(table(spark, d, "candidates"))


def ranked_lists(spark, d):
    """Every query's list of every source, ranked anew."""
    return _lists(spark, d).select("query_id", "source", "keyframe_uid", "score", "rank")


def rrf_fusion(spark, d):
    """Five sources fused by weighted reciprocal rank."""
    fused = fusion.fuse(_lists(spark, d), fusion.FusionConfig(WEIGHTS))
    return fused.select("query_id", "keyframe_uid", F.round("score", 9).alias("score"), F.size("source_scores").alias("n_sources"))


def rrf_breakdown(spark, d):
    """What each source contributes to each fused score."""
    parts = fusion.fuse(_lists(spark, d), fusion.FusionConfig(WEIGHTS)).select("query_id", "keyframe_uid", F.explode("source_scores").alias("s"))
    return parts.select("query_id", "keyframe_uid", "s.source", "s.rank", "s.weight", F.round("s.contribution", 9).alias("contribution"))


def metadata_conflicts(spark, d):
    """Keyframes whose delivered metadata disagree between sources."""
    return fusion.metadata_conflicts(table(spark, d, "candidates"), "keyframe_uid")


def temporal_nms(spark, d):
    """Near keyframes of a video suppressed over all sources' candidates."""
    best = _lists(spark, d).groupBy("query_id", "video_id", "keyframe_uid", "timestamp_sec").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    return temporal.temporal_nms(best, 2.0).select("query_id", "video_id", "keyframe_uid", "timestamp_sec", "score", "rank")


def _by_source(spark, d):
    """The lists under a name of their own, so that each is aggregated by itself."""
    return _lists(spark, d).withColumn("list_id", F.concat_ws(":", "query_id", "source"))


def video_agg_max(spark, d):
    """Videos of every source's lists by their best keyframe."""
    return temporal.aggregate_videos(_by_source(spark, d), by="list_id").select("list_id", "rank", "video_id", "score", "best_keyframe_uid", "contributing_keyframes")


def video_agg_mean_top_m(spark, d):
    """The same by the mean of the three best."""
    rows = temporal.aggregate_videos(_by_source(spark, d), "mean_top_m", 3, by="list_id")
    return rows.select("list_id", "rank", "video_id", F.round("score", 9).alias("score"), "best_keyframe_uid", "contributing_keyframes")


def kis_videos(spark, d):
    """Known item search to the end: fusion, suppression, first 100 keyframes, best videos."""
    return retrieval.known_item(_lists(spark, d), CONFIG)[1].select("query_id", "rank", "video_id", F.round("score", 9).alias("score"), "contributing_keyframes")


def kis_keyframes(spark, d):
    """The first 100 keyframes of the same search."""
    return retrieval.known_item(_lists(spark, d), CONFIG)[0].select("query_id", "rank", "keyframe_uid", F.round("score", 9).alias("score"))


def cosine_topk(spark, d):
    """The ten nearest vectors of every twentieth vector."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    asked = rows.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    found = search.exact_topk(rows, asked, 10)
    return found.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def l2_normalize(spark, d):
    """Vectors at length 1: first number and length."""
    unit = table(spark, d, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(V.norm(F.col("u")), 6).alias("length"))


def vector_validation(spark, d):
    """The report on the keyframe vectors."""
    report = V.vector_report(table(spark, d, "keyframe_vectors"), "embedding", 48)
    return report.withColumn("min_norm", F.round("min_norm", 6)).withColumn("max_norm", F.round("max_norm", 6))


def _queries(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 20 = 0")
    return docs.select(F.col("doc_id").alias("query_id"), "text")


def _screen_texts(spark, d):
    return table(spark, d, "ocr_records").groupBy("record_id").agg(F.min("text").alias("text"), F.min(F.upper(F.trim("keyframe_uid"))).alias("key")).withColumnRenamed("record_id", "doc_id")


def bm25_topk(spark, d):
    """The ten best screen texts for every twentieth document."""
    found = bm25.bm25_topk(_screen_texts(spark, d).select("doc_id", "text"), _queries(spark, d), 10)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_best_per_key(spark, d):
    """The ten best keyframes by their best screen text."""
    docs = _screen_texts(spark, d)
    return bm25.best_documents(docs.select("doc_id", "text"), _queries(spark, d), docs.select("doc_id", "key"), 10).select("query_id", "key", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_df(spark, d):
    """In how many documents each term occurs."""
    return bm25.document_frequencies(table(spark, d, "ocr_records").select(F.col("record_id").alias("doc_id"), "text").distinct())


def token_counts(spark, d):
    """Tokens of every document."""
    words = tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"))


def representative_keyframe(spark, d):
    """The first mapped keyframe of every video by time."""
    return mapping.first_keyframes(table(spark, d, "keyframes"))


def metadata_documents(spark, d):
    """Videos as searchable texts of their fields in key order."""
    fields = F.create_map(F.lit("group"), F.col("group_id"), F.lit("codec"), F.col("video_codec"), F.lit("box"), F.col("container"))
    rows = table(spark, d, "videos").where("video_id is not null").groupBy("video_id").agg(F.min("group_id").alias("group_id"), F.min("video_codec").alias("video_codec"), F.min("container").alias("container"))
    return rows.select("video_id", metadata_document(fields).alias("document"))


def _events(spark, d):
    lists = _lists(spark, d).where(F.col("source").isin(list(EVENTS)) & (F.col("rank") <= EVENT_POOL) & F.col("original_frame_id").isNotNull())
    index = F.array_position(F.array(*[F.lit(e) for e in EVENTS]), F.col("source")).cast("int") - 1
    return lists.select("query_id", index.alias("event_index"), "video_id", F.col("original_frame_id").alias("frame_id"), "timestamp_sec", "score", F.col("keyframe_uid").alias("uid"))


def candidate_video_evidence(spark, d):
    """The hundred videos of a query that match most of its events."""
    return alignment.candidate_videos(_events(spark, d), 100).select("query_id", "rank", "video_id", "matched_events", F.round("evidence_score", 6).alias("evidence_score"), "n_candidates")


def _paths(spark, d, cfg):
    paths = alignment.k_best_paths(alignment.event_rows(_events(spark, d)), 3, cfg)
    return paths.select("query_id", "video_id", "frame_ids", "uids", F.round("total", 8).alias("total"), F.round("penalty", 8).alias("penalty"))


def trake_paths(spark, d):
    """The hundred best increasing frame sequences over three events per query and video, before near ones go."""
    return _paths(spark, d, ALIGN)


def trake_paths_gapped(spark, d):
    """The five best with a penalty on gaps, none of which may exceed ten minutes."""
    return _paths(spark, d, GAPPED)


def trake_sequences(spark, d):
    """Ordered event search to the end: distinct sequences, 100 a query."""
    rows = retrieval.ordered_events(_events(spark, d), 3, 100, ALIGN, 100)
    return rows.select("query_id", "video_id", "frame_ids", F.round("total", 8).alias("total"))


def _frames(spark, d):
    rows = retrieval.best_rows(table(spark, d, "candidates"))  # ranks are not asked for
    return rows.where("original_frame_id is not null").select("query_id", "video_id", F.col("original_frame_id").alias("frame_id"), "timestamp_sec", "score")


def frame_diversity(spark, d):
    """At most 100 frames a query and 20 a video, none within two seconds of another."""
    return submission.diverse_frames(_frames(spark, d)).select("query_id", "rank", "video_id", "frame_id", "score")


def sequence_diversity(spark, d):
    """Sequences at least 15 frames apart somewhere, at most 20 a video."""
    paths = alignment.k_best_paths(alignment.event_rows(_events(spark, d)), 3, ALIGN).select("query_id", "video_id", "frame_ids", F.round("total", 8).alias("score"))
    return submission.diverse_sequences(paths).select("query_id", "rank", "video_id", "frame_ids", "score")


def _task():
    number = F.pmod(F.substring("query_id", 2, 8).cast("int"), F.lit(3))
    return F.when(number == 0, "qna").when(number == 1, "trake").otherwise("kis")


#: Ways to write answers; all but the last mean five.
_GIVEN = ("Năm", "5 people", " five! ", "six")


def _submission(spark, d):
    """The diverse frames as results of three tasks: frames, frames with answers, and three frames in a row."""
    chosen = submission.diverse_frames(_frames(spark, d)).withColumn("task", _task())
    answer = F.when(F.col("task") == "qna", F.array(*[F.lit(a) for a in _GIVEN])[F.pmod("frame_id", F.lit(4)).cast("int")])
    frames = F.when(F.col("task") == "trake", F.array(F.col("frame_id"), F.col("frame_id") + 30, F.col("frame_id") + 900)).otherwise(F.array("frame_id"))
    return chosen.select("query_id", "task", "rank", "video_id", frames.alias("frame_ids"), answer.alias("answer"))


def _truth(spark, d):
    """Ground truth made of the lists: around one candidate of every query."""
    lists = _lists(spark, d).where("original_frame_id is not null")
    middle = lists.groupBy("query_id").agg(F.max(F.struct(F.pmod("original_frame_id", F.lit(97)).alias("h"), "keyframe_uid", "video_id", "original_frame_id")).alias("m"))
    window = F.struct((F.col("m.original_frame_id") - 400).alias("start"), (F.col("m.original_frame_id") + 400).alias("end"))
    rows = middle.withColumn("task", _task())
    windows = F.when(F.col("task") == "trake", F.array(window, window, window)).otherwise(F.array(window))
    return rows.select("query_id", "task", "m.video_id", windows.alias("frame_windows"), F.when(F.col("task") == "qna", F.lit("Five people")).alias("answer"))


def rank_metrics(spark, d):
    """R@1 to R@100 and the final score of every query of the three tasks."""
    return evaluation.query_metrics(_submission(spark, d), _truth(spark, d)).withColumn("final_score", F.round("final_score", 9))


def qna_metrics(spark, d):
    """The scores of the question answers, which are compared in canonical form."""
    return rank_metrics(spark, d).where("task = 'qna'")


def trake_metrics(spark, d):
    """The scores of the ordered events: shares of frames within their windows."""
    return rank_metrics(spark, d).where("task = 'trake'")


def task_metrics(spark, d):
    """Their means per task."""
    rows = evaluation.task_metrics(evaluation.query_metrics(_submission(spark, d), _truth(spark, d)))
    return rows.select("task", "n_queries", *[F.round(c, 9).alias(c) for c in rows.columns[2:]])


def _fused_frames(spark, d, limit=None):
    fused = retrieval.fused_candidates(_lists(spark, d), CONFIG, limit).where("original_frame_id is not null")
    return fused.select("query_id", "rank", "keyframe_uid", "video_id", "original_frame_id", "score")


def _wrong_submission(spark, d):
    """All fused keyframes as results, of which every thirteenth breaks a rule of its own."""
    rows = _fused_frames(spark, d).withColumn("f", F.col("original_frame_id")).withColumn("k", F.pmod("rank", F.lit(13))).withColumn("base", F.when(_task() == "qna", "qna").otherwise("kis"))
    k = F.col("k")
    task = F.when(k == 0, "other").when(k == 5, "kis").when(k == 6, "kis").when(k == 7, "qna").when(k.isin(8, 10), "trake").otherwise(F.col("base"))
    frames = (
        F.when(k == 2, F.array(F.col("f") + 10**9)).when(k == 3, F.array(F.lit(-1).cast("bigint"))).when(k == 4, F.filter(F.array("f"), lambda x: F.lit(False)))
        .when(k == 5, F.array("f", F.col("f") + 1)).when(k == 8, F.array("f", F.col("f") - 2)).when(k == 9, F.array(F.lit(7).cast("bigint"))).when(k == 10, F.array("f", F.col("f") + 1))
        .otherwise(F.array("f"))
    )
    answer = F.when(k == 6, "x").when(k == 7, " ").when(task == "qna", "five")
    video = F.when(k == 1, "NOPE").when(k == 9, "L01_V001").otherwise(F.col("video_id"))
    return rows.select("query_id", task.alias("task"), "rank", video.alias("video_id"), frames.alias("frame_ids"), answer.alias("answer"))


def submission_violations(spark, d):
    """What is wrong with a submission in which every rule is broken somewhere."""
    number = F.substring("query_id", 2, 8).cast("int")
    due = table(spark, d, "candidates").select("query_id").distinct().where(F.pmod(number, F.lit(5)) != 4)
    truth = due.select("query_id", F.when(F.pmod(number, F.lit(3)) == 0, "qna").otherwise("kis").alias("task"), F.lit(3).alias("n_frames"))
    found = submission.violations(_wrong_submission(spark, d), table(spark, d, "videos").select("video_id", "frame_count"), truth)
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def submission_documents(spark, d):
    """Length and artifact name of every query's submission."""
    docs = submission.to_documents(_submission(spark, d))
    return docs.select("query_id", "task", F.length("json").alias("n_chars"), artifact_id(F.col("query_id")).alias("artifact"))


def _mappings(spark, d):
    rows = table(spark, d, "keyframes").where("original_frame_id is not null and keyframe_index is not null and video_id is not null")
    return rows.select("video_id", "keyframe_index", "original_frame_id").distinct()


def _videos(spark, d):
    rows = table(spark, d, "videos").where("video_id is not null")
    fields = ["fps", "frame_count", "duration_sec", "width", "height", "is_readable", "group_id", "video_path"]
    # Of redelivered rows the latest counts.
    last = rows.groupBy("video_id").agg(F.max(F.struct("ingested_at", "load_id", *fields)).alias("v"))
    return last.select("video_id", *[F.col(f"v.{c}").alias(c) for c in fields])


def _one_keyframe(spark, d):
    """Keyframes, each once."""
    fields = ["video_id", "original_frame_id", "timestamp_sec", "keyframe_path"]
    rows = table(spark, d, "keyframes").where("keyframe_uid is not null").groupBy("keyframe_uid").agg(F.max(F.struct(*fields)).alias("k"))
    return rows.select("keyframe_uid", *[F.col(f"k.{c}").alias(c) for c in fields])


def _frames_table(spark, d):
    rows = table(spark, d, "keyframes").where("video_id is not null and keyframe_index is not null")
    return rows.groupBy("video_id", "keyframe_index").agg(F.max("has_mapping").alias("has_mapping"))


def mapping_validation(spark, d):
    """The eight counters of the mapping check."""
    return mapping.validate_mapping(_frames_table(spark, d), _videos(spark, d), _mappings(spark, d))


def mapping_duplicates(spark, d):
    """Frames that several keyframes of a video point to."""
    return mapping.duplicate_frames(_mappings(spark, d))


def mapping_non_monotonic(spark, d):
    """Videos whose frames decrease somewhere."""
    return mapping.non_monotonic_videos(_mappings(spark, d))


def mapping_summary(spark, d):
    """Keyframes, mappings and their match per video."""
    return mapping.mapping_summary(_frames_table(spark, d), _mappings(spark, d))


def mapped_keyframes(spark, d):
    """Keyframes joined with mapping and frame rate: mapped share and last time per video."""
    once = _mappings(spark, d).groupBy("video_id", "keyframe_index").agg(F.max("original_frame_id").alias("original_frame_id"))
    rows = mapping.mapped_keyframes(_frames_table(spark, d).drop("has_mapping"), once, _videos(spark, d))
    good = F.when(~F.isnan("timestamp_sec"), F.col("timestamp_sec"))
    return rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("has_mapping"), 1)).alias("n_mapped"), F.round(F.max(good), 6).alias("last_sec"))


def keyframe_gaps(spark, d):
    """Number, smallest and largest gap between mapped keyframes per video."""
    gaps = audit.keyframe_gaps(table(spark, d, "keyframes"), _videos(spark, d))
    return gaps.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("gap_sec"), 6).alias("min_gap"), F.round(F.max("gap_sec"), 6).alias("max_gap"))


def numeric_profiles(spark, d):
    """Counts, means and exact quantiles of the videos' numbers."""
    rows = numeric_profile(table(spark, d, "videos"), ["fps", "frame_count", "duration_sec", "bitrate"])
    return rows.select("column_name", "n_values", *[F.round(c, 7).alias(c) for c in ("min_value", "mean_value", "max_value", "p10", "p50", "p90", "p95")])


def value_distribution(spark, d):
    """How often each codec, container and group occurs."""
    return audit.value_distribution(table(spark, d, "videos"), ["video_codec", "audio_codec", "container", "group_id", "audio_sample_rate"])


def group_durations(spark, d):
    """Videos and hours per group and in all."""
    return audit.group_durations(_videos(spark, d))


def video_checks(spark, d):
    """Unreadable videos, invalid geometry, contradicting durations."""
    return audit.video_checks(_videos(spark, d))


def id_differences(spark, d):
    """How many videos one kind of table names that another lacks: K keyframes, V videos, M mappings, O screen texts, I documents."""
    frames = table(spark, d, "keyframes")
    ids = {
        "K": frames.select(F.col("video_id").alias("id")),
        "V": table(spark, d, "videos").select(F.col("video_id").alias("id")),
        "M": frames.where("original_frame_id is not null").select(F.col("video_id").alias("id")),
        "O": table(spark, d, "ocr_records").select(infer_video_id(F.col("keyframe_uid")).alias("id")),
        "I": table(spark, d, "documents").select(F.col("video_id").alias("id")),
    }
    pairs = [("K", "V"), ("V", "K"), ("M", "V"), ("V", "M"), ("O", "K"), ("K", "O"), ("I", "V"), ("V", "I")]
    return audit.id_differences(ids, pairs).groupBy("difference").agg(F.count(F.lit(1)).alias("n"))


def frames_in_windows(spark, d):
    """How many frames one to three seconds on either side hold."""
    rows = audit.frames_in_windows(_videos(spark, d))
    return rows.select("window", "n_values", *[F.round(c, 6).alias(c) for c in ("min_value", "mean_value", "max_value", "p50", "p95")])


def json_profile(spark, d):
    """Fields of the videos as JSON objects, of the events' JSON, and of texts that are no objects."""
    fields = F.struct(
        "video_id", F.struct("width", "height").alias("size"), F.array_compact(F.array("video_codec", "audio_codec")).alias("codecs"), "has_audio", "frame_count",
        F.when(F.pmod("frame_count", F.lit(5)) == 0, F.col("frame_count").cast("string")).alias("count"), F.coalesce("group_id", F.lit("")).alias("group_id"),
    )
    videos = table(spark, d, "videos").select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("props"))
    lists = table(spark, d, "videos").select(F.to_json(F.array("width", "height")).alias("props"))
    rows = audit.json_profile(videos.unionByName(lists).unionByName(table(spark, d, "events").select("props")), "props")
    return rows.withColumn("presence_rate", F.round("presence_rate", 6))


def storage_by_component(spark, d):
    """Files and bytes of keyframes and videos."""
    files = table(spark, d, "keyframes").select(F.lit("keyframes").alias("component"), F.col("keyframe_path").alias("path"), F.col("file_size_bytes").alias("length"))
    more = table(spark, d, "videos").select(F.lit("videos").alias("component"), F.col("video_path").alias("path"), F.col("file_size_bytes").alias("length"))
    return audit.storage_by_component(files.unionByName(more))


def largest_files(spark, d):
    """The twenty largest video files."""
    rows = table(spark, d, "videos").where("file_size_bytes is not null").groupBy("video_path").agg(F.max("file_size_bytes").alias("length"))
    return audit.largest_files(rows.withColumnRenamed("video_path", "path"))


def source_sheet_check(spark, d):
    """A sheet of the video files checked as a source sheet: kept and rejected rows."""
    rows = table(spark, d, "videos")
    url = F.when(F.pmod("frame_count", F.lit(7)) == 0, F.concat(F.lit("ftp://host/"), "video_id")).otherwise(F.concat(F.lit("https://host.example/"), F.col("video_id")))
    sheet = rows.select(F.concat(F.lit("Videos_"), "video_id", F.lit(".zip")).alias(" filenames "), url.alias("Download link"))
    return source_sheet(sheet).groupBy("category", "rejected").agg(F.count(F.lit(1)).alias("n"))


def path_fields(spark, d):
    """Ids, groups and indices told from paths, and the key they make."""
    path = F.col("keyframe_path")
    video, index = infer_video_id(F.replace(path, F.lit("/"), F.lit(" "))), infer_index(F.regexp_extract("keyframe_path", r"([^/]+)\.[^./]+$", 1))
    rows = table(spark, d, "keyframes").where("keyframe_path is not null").select("keyframe_path").distinct()
    return rows.select("keyframe_path", video.alias("video_id"), infer_group_id(path).alias("group_id"), index.alias("keyframe_index"), keyframe_uid(video, index).alias("keyframe_uid"))


def frame_windows(spark, d):
    """Sparse, dense and even frames around the middle of every video."""
    rows = _videos(spark, d).where("frame_count is not null and fps is not null").withColumn("center", F.expr("frame_count div 2"))
    w = frame_window(F.col("center"), F.col("fps"), 1.0, F.col("frame_count"))
    out = rows.withColumn("w", w)
    return out.select("video_id", sparse_ids(F.col("w"), F.col("fps"), 4.0).alias("sparse"), dense_count(F.col("w")).alias("n_dense"), even_ids(F.col("w"), 8).alias("even"))


def fractions(spark, d):
    """Frame rates written as fractions and parsed again."""
    rows = _videos(spark, d)
    whole = F.round(F.col("fps") * 1000).cast("bigint").cast("string")
    text = F.when(is_finite(F.col("fps")), F.concat(whole, F.lit("/1000")))
    return rows.select("video_id", F.round(parse_fraction(text), 6).alias("fps"))


_ANSWERS = (" Five people! ", "Năm", "5 people", "Có.", "KHÔNG", "màu Xanh Dương", "It is blue.", "năm người chơi", "Nguyen Van A", "007", "the color is dark red", "không phải", "  ")


def answer_forms(spark, d):
    """Canonical forms of short answers."""
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(_ANSWERS)], "id int, raw string")
    return rows.select("id", normalize_answer(F.col("raw")).alias("answer"))


_EVENT_TEXTS = (
    "Find: (1) a man opens a door (2) he sits down; (3) he leaves.", "1. first\n2) second\n- third", "a -> b -> c", "a → b", "one; two ; three",
    "someone (1) only in brackets", "prose with one (2) number", "  spaced   out  ",
)


def event_lists(spark, d):
    """Queries split into ordered events."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(_EVENT_TEXTS)], "query_id int, text string")
    return decompose_events(rows).select("query_id", "event_index", "text")


def _scorer(asked: DataFrame) -> DataFrame:
    """A stand-in for a model: a fixed function of the frame number."""
    score = F.pmod(F.col("frame_id") * 7919, F.lit(1009)) / F.lit(1009.0)
    return asked.select("query_id", "video_id", "frame_id", F.lit("model").alias("source"), score.alias("score"))


def refined_frames(spark, d):
    """The first ten fused keyframes of every query with the best frame nearby, or why there is none."""
    rows = refine.refine(_fused_frames(spark, d, REFINED), _videos(spark, d), _scorer, refine.RefineConfig(candidates=REFINED))
    return rows.select("query_id", "keyframe_uid", "sparse_frame_id", "refined_frame_id", F.round("local_score", 6).alias("local_score"), "refinement_status", "error")


def refinement_overlay(spark, d):
    """Coarse lists with refined frames in place, the coarse order kept."""
    lists = _fused_frames(spark, d, 100)
    done = refine.refine(lists, _videos(spark, d), _scorer, refine.RefineConfig(candidates=REFINED))
    over = refine.overlay(lists, done)
    return refine.refinement_counts(over, done)


def asr_best_keyframe(spark, d):
    """The mapped keyframe nearest to the middle of every speech segment, however far."""
    rows = table(spark, d, "asr_segments").select("segment_id", F.upper(F.trim("video_id")).alias("video_id"), middle(F.col("start_sec"), F.col("end_sec")).alias("at_sec")).distinct()
    near = mapping.nearest_keyframes(rows, table(spark, d, "keyframes"))
    return near.select("segment_id", "video_id", "keyframe_uid", F.round("distance_sec", 6).alias("distance_sec"))


QUERIES = {
    f.__name__: f
    for f in (
        ranked_lists, rrf_fusion, rrf_breakdown, metadata_conflicts, temporal_nms, video_agg_max, video_agg_mean_top_m, kis_videos, kis_keyframes,
        cosine_topk, l2_normalize, vector_validation, bm25_topk, bm25_best_per_key, bm25_df, token_counts, representative_keyframe, metadata_documents,
        candidate_video_evidence, trake_paths, trake_paths_gapped, trake_sequences, frame_diversity, sequence_diversity, rank_metrics, qna_metrics, trake_metrics, task_metrics, submission_violations,
        submission_documents, mapping_validation, mapping_duplicates, mapping_non_monotonic, mapping_summary, mapped_keyframes, keyframe_gaps,
        numeric_profiles, value_distribution, group_durations, video_checks, id_differences, frames_in_windows, json_profile, storage_by_component, largest_files,
        source_sheet_check, path_fields, frame_windows, fractions, answer_forms, event_lists, refined_frames, refinement_overlay, asr_best_keyframe,
    )
}
ORACLES = SQL
