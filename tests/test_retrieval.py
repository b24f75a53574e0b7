import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.functions.answers import normalize_answer
from reelspark.operators import alignment, bm25, evaluation, fusion, refine, search, submission, temporal
from reelspark.operators.decompose import decompose_events
from reelspark.operators.greedy import keep_apart
from reelspark.plans import branches, reference_queries, retrieval
from reelspark.schemas import ContractError
from tests.conftest import rows

LISTS = "query_id string, source string, keyframe_uid string, video_id string, original_frame_id bigint, timestamp_sec double, keyframe_path string, score double, rank int"
CAND = "query_id string, video_id string, keyframe_uid string, timestamp_sec double, score double, rank int"


def test_weighted_reciprocal_rank_fusion(spark):
    df = spark.createDataFrame([("q", "a", "A", 1, 0.95), ("q", "a", "B", 2, 0.8), ("q", "b", "B", 1, 0.2), ("q", "b", "C", 2, 0.1)], "query_id string, source string, keyframe_uid string, rank int, score double")
    cfg = fusion.FusionConfig({"a": 1.0, "b": 2.0})
    got = fusion.fuse(df, cfg).orderBy(F.desc("score")).collect()
    assert [r["keyframe_uid"] for r in got] == ["B", "C", "A"] and got[0]["score"] == 1 / 62 + 2 / 61
    assert rows(fusion.source_differences(df, fusion.FusionConfig({"a": 1.0}))) == [("b", "no weight")]
    with pytest.raises(Exception, match="source without weight: b"):
        fusion.fuse(df, fusion.FusionConfig({"a": 1.0})).collect()
    bad = df.unionByName(df.limit(1)).unionByName(spark.createDataFrame([("q", "a", " ", 0, 0.1)], df.schema))
    assert rows(fusion.ranking_violations(bad), "keyframe_uid", "problem") == [(" ", "empty item"), (" ", "rank below 1"), ("A", "repeated item")]
    with pytest.raises(ContractError):
        fusion.FusionConfig({"a": 0.0})


def test_suppression_and_video_aggregation(spark):
    data = [("q", "V1", "V1:10", 1.0, 0.95, 1), ("q", "V1", "V1:15", 1.5, 0.9, 2), ("q", "V2", "V2:10", 1.0, 0.85, 3), ("q", "V1", "V1:50", 5.0, 0.7, 4), ("q", None, "x", 1.0, 1.0, 5), ("q", "V1", "n", float("nan"), 1.0, 6)]
    kept = temporal.temporal_nms(spark.createDataFrame(data, CAND), 2.0)
    assert [r["keyframe_uid"] for r in kept.orderBy("rank").collect()] == ["V1:10", "V2:10", "V1:50"]
    videos = temporal.aggregate_videos(kept, "mean_top_m", 2).orderBy("rank").collect()
    assert [(r["video_id"], round(r["score"], 9)) for r in videos] == [("V2", 0.85), ("V1", 0.825)]


def test_suppression_equals_a_greedy_loop_and_is_inclusive(spark):
    rnd = random.Random(4)
    data = [("q", rnd.choice("AB"), f"k{i}", rnd.randrange(60) / 2, rnd.randrange(20) / 10, i) for i in range(150)]
    kept = []
    for c in sorted(data, key=lambda c: (-c[4], c[5], c[2])):
        if not any(k[1] == c[1] and abs(k[3] - c[3]) <= 1.5 for k in kept):
            kept.append(c)
    got = temporal.temporal_nms(spark.createDataFrame(data, CAND), 1.5).orderBy("rank")
    assert [r["keyframe_uid"] for r in got.collect()] == [k[2] for k in kept]
    assert temporal.temporal_nms(spark.createDataFrame(data, CAND), 0.0).groupBy("video_id", "timestamp_sec").count().where("count > 1").isEmpty()


def test_exact_topk_over_blocks_keeps_ties(spark):
    rnd = random.Random(9)
    vectors = [(i, [rnd.uniform(-1, 1) for _ in range(5)]) for i in range(300)] + [(900, [0.0] * 5), (901, None)]
    vectors[7] = (7, vectors[3][1])
    df = spark.createDataFrame(vectors, "item_id bigint, vector array<float>").repartition(5)
    asked = df.where("item_id < 20").withColumnRenamed("item_id", "query_id")
    got = {}
    for r in search.exact_topk(df, asked, 6, block=32).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["item_id"]
    import numpy as np

    m = {i: np.array(v, np.float32).astype(float) for i, v in vectors if v and any(v)}
    for q in range(20):
        cos = {i: round(float(m[q] @ v / np.linalg.norm(m[q]) / np.linalg.norm(v)), 9) for i, v in m.items()}
        best = sorted(cos, key=lambda i: (-cos[i], i))[:6]
        assert [got[q][k + 1] for k in range(6)] == best


def test_bm25_counts_repeated_query_terms_and_empty_documents(spark):
    docs = spark.createDataFrame([("a", "Emergency exit sign"), ("b", "Welcome home"), ("c", None), ("d", "exit exit Straße")], "doc_id string, text string")
    asked = spark.createDataFrame([("1", "exit"), ("2", "exit exit"), ("3", "STRASSE")], "query_id string, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in bm25.bm25_scores(docs, asked).collect()}
    assert set(got) == {("1", "a"), ("1", "d"), ("2", "a"), ("2", "d"), ("3", "d")}
    assert got["2", "a"] == pytest.approx(2 * got["1", "a"], abs=1e-8)
    import math

    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    assert got["1", "a"] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / 2)), abs=1e-8)


def test_alignment_beats_independent_maxima(spark):
    data = [("q", 0, "V", 30, 3.0, 0.99, "a"), ("q", 0, "V", 10, 1.0, 0.8, "b"), ("q", 1, "V", 20, 2.0, 0.99, "c"), ("q", 1, "V", 40, 4.0, 0.7, "d")]
    df = spark.createDataFrame(data, "query_id string, event_index int, video_id string, frame_id bigint, timestamp_sec double, score double, uid string")
    best = alignment.align_events(df, 2).where("rank = 1").collect()[0]
    assert best["frame_ids"] == [10, 20]
    assert alignment.align_events(df, 3).isEmpty()
    assert rows(alignment.candidate_videos(df, 5), "matched_events", "n_candidates") == [(2, 4)]


def test_k_best_equals_enumeration(spark):
    rnd = random.Random(8)
    data = [("q", e, v, f, f / 10, rnd.randrange(100) / 100, f"{v}{e}{f}") for v in "AB" for e in range(3) for f in rnd.sample(range(40), 6)]
    df = spark.createDataFrame(data, "query_id string, event_index int, video_id string, frame_id bigint, timestamp_sec double, score double, uid string")
    cfg = alignment.AlignmentConfig(k_best=4, min_gap_sec=0.2, max_gap_sec=3.0, gap_penalty=0.05, dedup_window_sec=0.25)
    expected = []
    for v in "AB":
        layers = [[d for d in data if d[2] == v and d[1] == e] for e in range(3)]
        states = [[(d[5], [d])] for d in layers[0]]
        for e in (1, 2):
            nxt = []
            for cur in layers[e]:
                found = []
                for paths in states:
                    for total, path in paths:
                        gap = cur[4] - path[-1][4]
                        if path[-1][3] < cur[3] and 0.2 <= gap <= 3.0:
                            found.append((total + cur[5] - 0.05 * max(0.0, gap - 0.2), path + [cur]))
                found.sort(key=lambda s: (-s[0], [p[3] for p in s[1]], [p[6] for p in s[1]]))
                nxt.append(found[:4])
            states = nxt
        flat = sorted((s for paths in states for s in paths), key=lambda s: (-s[0], [p[3] for p in s[1]], [p[6] for p in s[1]]))
        kept = []
        for s in flat:
            if not any(all(abs(a[4] - b[4]) <= 0.25 for a, b in zip(s[1], k[1])) for k in kept):
                kept.append(s)
        expected += [(v, [p[3] for p in s[1]]) for s in kept[:4]]
    got = [(r["video_id"], r["frame_ids"]) for r in alignment.align_events(df, 3, cfg).orderBy("video_id", "rank").collect()]
    assert got == expected


def test_event_lists(spark):
    texts = ["Find: (1) one (2) two", "1. one\n2) two\n- three", "a → b", "x (2) y", "some (1) a (2) b", "one; two", " \n ", None]
    got = rows(decompose_events(spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")), "query_id", "event_index", "text")
    assert got == [
        (0, 0, "one"), (0, 1, "two"), (1, 0, "one"), (1, 1, "two"), (1, 2, "three"), (2, 0, "a"), (2, 1, "b"), (3, 0, "x (2) y"), (4, 0, "some (1) a (2) b"), (5, 0, "one"), (5, 1, "two"),
    ]


def test_retrieval_text_names_event_and_context(spark):
    df = decompose_events(spark.createDataFrame([("q", "a -> b")], "query_id string, text string"))
    assert [r["retrieval_text"] for r in df.orderBy("event_index").collect()] == ["Focus event 1: a\nSequence context: a -> b", "Focus event 2: b\nSequence context: a -> b"]


def test_answer_forms(spark):
    forms = {" Five people! ": "5", "Năm": "5", "5 people": "5", "Có.": "yes", "KHÔNG": "no", "màu Xanh Dương": "blue", "It is blue.": "blue", "năm người chơi": "5", "Nguyen Van A": "nguyen van a", "Ｆｉｖｅ": "5", "00": "0", " ,. ": None}
    df = spark.createDataFrame([(k,) for k in forms], "raw string")
    assert {r["raw"]: r["a"] for r in df.select("raw", normalize_answer(F.col("raw")).alias("a")).collect()} == forms


def test_evaluation(spark):
    truth = spark.createDataFrame(
        [("k", "kis", "V", [(10, 20)], None), ("t", "trake", "V", [(0, 1), (2, 3), (4, 5), (6, 7)], None), ("a", "qna", "V", [(0, 9)], "5"), ("m", "kis", "V", [(0, 1)], None)],
        "query_id string, task string, video_id string, frame_windows array<struct<start:bigint,end:bigint>>, answer string",
    )
    sub = [("k", "kis", 1, "W", [15], None), ("k", "kis", 2, "V", [21], None), ("k", "kis", 3, "V", [20], None), ("t", "trake", 1, "V", [0, 2, 4, 9], None), ("a", "qna", 1, "V", [3], "6"), ("a", "qna", 2, "V", [3], "5")]
    df = spark.createDataFrame(sub, "query_id string, task string, rank int, video_id string, frame_ids array<bigint>, answer string")
    got = {r["query_id"]: r for r in evaluation.query_metrics(df, truth).collect()}
    assert (got["k"]["r_at_1"], got["k"]["r_at_5"], round(got["k"]["final_score"], 9)) == (0.0, 1.0, 0.8)
    assert got["t"]["r_at_1"] == 0.75 and got["a"]["r_at_1"] == 0.0 and got["a"]["r_at_5"] == 1.0 and got["m"]["final_score"] == 0.0
    assert rows(evaluation.task_metrics(evaluation.query_metrics(df, truth)), "task", "n_queries") == [("kis", 2), ("qna", 1), ("trake", 1)]
    many = spark.createDataFrame([("k", "kis", 101, "V", [1], None)], df.schema)
    with pytest.raises(Exception, match="more than 100"):
        evaluation.query_metrics(many, truth).collect()


def test_submission_rules(spark):
    frames = spark.createDataFrame([("q", "V", 10, 1.0, 0.9), ("q", "V", 11, 1.1, 0.8), ("q", "V", 90, 9.0, 0.7), ("q", "W", 5, 0.5, 0.6), ("q", "V", 200, 20.0, 0.1)], "query_id string, video_id string, frame_id bigint, timestamp_sec double, score double")
    got = submission.diverse_frames(frames, submission.DiversityConfig(10, 2, 2.0)).orderBy("rank").collect()
    assert [r["frame_id"] for r in got] == [10, 90, 5]
    seqs = spark.createDataFrame([("q", "V", [1, 50], 0.9), ("q", "V", [10, 60], 0.8), ("q", "V", [30, 90], 0.7)], "query_id string, video_id string, frame_ids array<bigint>, score double")
    assert [r["frame_ids"] for r in submission.diverse_sequences(seqs).orderBy("rank").collect()] == [[1, 50], [30, 90]]
    schema = "query_id string, task string, rank int, video_id string, frame_ids array<bigint>, answer string"
    videos = spark.createDataFrame([("V", 100)], "video_id string, frame_count bigint")
    bad = [("a", "kis", 1, "V", [100], None), ("a", "kis", 2, "X", [1], "no"), ("b", "trake", 1, "V", [5, 5], None), ("c", "qna", 1, "V", [1], " "), ("c", "qna", 2, "V", [1], "x"), ("d", "kis", 1, "V", [3], None)]
    got = rows(submission.violations(spark.createDataFrame(bad, schema), videos), "query_id", "problem")
    assert got == [("a", "frame outside the video"), ("a", "must not have an answer"), ("a", "unknown video"), ("b", "frames must increase"), ("c", "duplicate"), ("c", "needs an answer")]
    doc = submission.to_documents(spark.createDataFrame([("d", "qna", 1, "V", [3], 'say "x"')], schema)).collect()[0]["json"]
    import json

    assert json.loads(doc) == {"query_id": "d", "task": "qna", "results": [{"video_id": "V", "frame_id": 3, "answer": 'say "x"'}]}


def _peak(asked):
    return asked.select("query_id", "video_id", "frame_id", F.lit("m").alias("source"), (F.lit(0.0) - F.abs(F.col("frame_id") - 14)).alias("score"))


def test_refinement_goes_sparse_then_dense(spark):
    videos = spark.createDataFrame([("V", "v.mp4", 10.0, 31, 3.1, True), ("U", "u.mp4", 10.0, 31, 3.1, False)], "video_id string, video_path string, fps double, frame_count bigint, duration_sec double, is_readable boolean")
    coarse = spark.createDataFrame([("q", 1, "V:1", "V", 10, 0.9), ("q", 2, "U:1", "U", 10, 0.8), ("q", 3, "X:1", "X", 10, 0.7), ("q", 4, "V:9", "V", 99, 0.6)], "query_id string, rank int, keyframe_uid string, video_id string, original_frame_id bigint, score double")
    cfg = refine.RefineConfig(4, 1.0, 2.0, 0.6)
    done = refine.refine(coarse, videos, _peak, cfg)
    got = {r["keyframe_uid"]: (r["sparse_frame_id"], r["refined_frame_id"], r["error"]) for r in done.collect()}
    assert got == {"V:1": (15, 14, None), "U:1": (None, None, "unreadable video"), "X:1": (None, None, "no such video"), "V:9": (None, None, "frame or fps out of bounds")}
    over = refine.overlay(coarse, done)
    assert rows(over, "rank", "frame_id", "refinement_status") == [(1, 14, "refined"), (2, 10, "coarse_fallback"), (3, 10, "coarse_fallback"), (4, 99, "coarse_fallback")]
    clips = refine.clip_frames(spark.createDataFrame([("V", 20)], "video_id string, frame_id bigint"), videos, 1.0, 5).collect()[0]["clip"]
    assert clips == [10, 15, 20, 25, 30]


def test_known_item_search_and_question_answering(spark):
    data = [("q", s, f"V:{i}", "V", i * 10, float(i), "p", 1.0 - i / 10, 99) for s in ("a", "b") for i in range(6)] + [("q", "a", "W:1", "W", 1, 1.0, "p", 0.5, None), ("q", "a", "N", None, 1, 1.0, "p", 9.0, 1)]
    lists = retrieval.ranked_lists(spark.createDataFrame(data, LISTS))
    assert lists.where("source = 'b'").agg(F.max("rank")).collect()[0][0] == 6
    kept, videos = retrieval.known_item(lists, retrieval.KisConfig({"a": 1.0, "b": 1.0}, top_k=10))
    assert [r["keyframe_uid"] for r in kept.orderBy("rank").collect()] == ["V:0", "V:3", "W:1"]
    assert [r["video_id"] for r in videos.orderBy("rank").collect()] == ["V", "W"]
    plain, _ = retrieval.known_item(lists, retrieval.KisConfig({"a": 1.0, "b": 1.0}, top_k=2, nms_window_sec=None))
    assert plain.count() == 2
    manifest = spark.createDataFrame([("V", 10.0, 500)], "video_id string, fps double, frame_count bigint")
    targets = kept.select("query_id", "rank", "video_id", F.lit(20).cast("bigint").alias("frame_id"), F.lit("e").alias("event_text"), F.lit("how many?").alias("question"), "score")
    answerer = lambda df: df.withColumn("raw_answer", F.when(F.col("rank") == 1, "Năm")).withColumn("error", F.lit(None).cast("string"))
    good, failed = retrieval.answer_questions(targets, manifest, answerer)
    assert rows(good, "rank", "answer") == [(1, "5")]
    assert rows(failed, "rank", "stage", "error") == [(2, "answer_normalization", "empty answer"), (3, "clip_selection", "no such video")]
    with pytest.raises(ContractError):
        retrieval.select_sources(["ocr"], ["ocr", "clip"], ["clip"])


SEQUENCE = "query_id string, video_id string, rank int, total double, frame_ids array<bigint>, times array<double>, uids array<string>"
CHOICE = "query_id string, video_id string, rank int, event_index int, frame_id bigint, timestamp_sec double, score double, uid string"


def test_realign_falls_back_when_an_event_fails(spark):
    seqs = spark.createDataFrame([("q", "V", 1, 1.9, [10, 20], [1.0, 2.0], ["a", "b"]), ("q", "V", 2, 1.5, [30, 40], [3.0, 4.0], ["c", "d"])], SEQUENCE)
    alt = [("q", "V", 1, e, f, f / 10, s, f"{e}{f}") for e, f, s in ((0, 11, 0.5), (1, 22, 0.6), (1, 9, 0.99))] + [("q", "V", 2, 0, 31, 3.1, 0.9, "x")]
    df = spark.createDataFrame(alt, CHOICE)
    for n in (2, spark.createDataFrame([("q", 2)], "query_id string, n_events int")):
        got = rows(retrieval.realign(seqs, df, n, alignment.AlignmentConfig()), "rank", "final_frame_ids", "refinement_status")
        assert got == [(1, [11, 22], "refined"), (2, [30, 40], "coarse_fallback")]


def test_near_final_sequences_count_once(spark):
    seqs = spark.createDataFrame([("q", "V", 1, 1.9, [10, 20], [1.0, 2.0], ["a", "b"]), ("q", "V", 2, 1.5, [14, 24], [1.4, 2.4], ["c", "d"]), ("q", "W", 3, 1.4, [14, 24], [1.4, 2.4], ["e", "f"])], SEQUENCE)
    got = rows(retrieval.realign(seqs, spark.createDataFrame([], CHOICE), 2, alignment.AlignmentConfig()), "rank", "video_id", "final_frame_ids")
    assert got == [(1, "V", [10, 20]), (2, "W", [14, 24])]


def test_queries_of_one_batch_may_list_different_numbers_of_events(spark):
    data = [(q, e, "V", f, f / 10, s, f"{q}{e}{f}") for q, n in (("a", 1), ("b", 2), ("c", 9)) for e in range(n) for f, s in ((10 * e + 1, 0.5), (10 * e + 2, 0.25))]
    df = spark.createDataFrame(data + [("b", 2, "V", 50, 5.0, 1.0, "x")], "query_id string, event_index int, video_id string, frame_id bigint, timestamp_sec double, score double, uid string")
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9), ("d", 3)], "query_id string, n_events int")
    first = {r["query_id"]: r["frame_ids"] for r in retrieval.ordered_events(df, counts).where("rank = 1").collect()}
    assert first == {"a": [1], "b": [1, 11], "c": [10 * e + 1 for e in range(9)]}


def test_events_are_refined_and_aligned_anew(spark):
    videos = spark.createDataFrame([("V", "p", 10.0, 200, True), ("W", "p", 10.0, 200, False)], "video_id string, video_path string, fps double, frame_count bigint, is_readable boolean")
    seqs = spark.createDataFrame([("q", "V", 1, 1.9, [50, 60], [5.0, 6.0], ["a", "b"]), ("q", "W", 2, 1.5, [30, 40], [3.0, 4.0], ["c", "d"])], SEQUENCE)
    peak = F.when(F.substring_index("query_id", "\u0001", -1) == "0", 47).otherwise(66)
    scorer = lambda asked: asked.select("query_id", "video_id", "frame_id", F.lit("m").alias("source"), (1 / (1 + F.abs(F.col("frame_id") - peak))).alias("score"))
    found, failed = retrieval.refined_events(seqs, videos, scorer, retrieval.EventRefineConfig(local_frames=3))
    assert {r[0] for r in found.groupBy("rank", "event_index").count().select("count").collect()} == {3}
    assert rows(failed, "rank", "event_index", "error") == [(2, 0, "unreadable video"), (2, 1, "unreadable video")]
    got = rows(retrieval.realign(seqs, found, 2, alignment.AlignmentConfig(dedup_window_sec=0.05)), "rank", "video_id", "final_frame_ids", "refinement_status")
    assert ("V", [47, 66], "refined") in [r[1:] for r in got] and max(got)[1:] == ("W", [30, 40], "coarse_fallback")


def test_greedy_selection_equals_brute_force_and_takes_large_groups(spark):
    rnd = random.Random(8)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([None, float("nan"), round(rnd.random() * 40, 1)]), rnd.random(), i) for i in range(1500)]
    df = spark.createDataFrame(data, "g string, x double, s double, i bigint")
    for window, cap in ((0.7, None), (0.0, 30), (1.3, 9)):
        expected = []
        for g in ("a", "b", None):
            kept = []
            for r in sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[3])):
                if (cap is None or len(kept) < cap) and not any(r[1] is not None and k[1] is not None and abs(r[1] - k[1]) <= window for k in kept):
                    kept.append(r)
            expected += [r[3] for r in kept]
        got = keep_apart(df, ["g"], [F.desc("s"), F.col("i")], "x", window, cap)
        assert sorted(r["i"] for r in got.collect()) == sorted(expected)
    many = spark.range(100_000).select(F.lit("q").alias("query_id"), F.lit("V").alias("video_id"), F.concat(F.lit("k"), "id").alias("keyframe_uid"), (F.col("id") * 3.0).alias("timestamp_sec"), (F.col("id") % 997 + 0.0).alias("score"), F.lit(1).alias("rank"))
    began = time.perf_counter()
    assert temporal.temporal_nms(many, 2.0).count() == 100_000 and time.perf_counter() - began < 60


def test_no_frame_rate_is_too_high(spark, tmp_path):
    from reelspark.plans import reference_queries

    now = "timestamp'2026-01-01 00:00:00'"
    video = "video_id string, group_id string, video_path string, fps double, frame_count bigint, duration_sec double, width int, height int, is_readable boolean"
    rates = {"A": (25.0, 1000), "B": (9000.0, 100_000), "C": (float("nan"), 1000), "D": (9000000.0, 50_000)}
    videos = [(v, "g", f"/{v}", fps, n, 1.0, 1, 1, True) for v, (fps, n) in rates.items()]
    spark.createDataFrame(videos, video).selectExpr("*", f"{now} as ingested_at", "1L as load_id").write.parquet(f"{tmp_path}/videos.parquet")
    lists = [("q1", "btc_clip", f"{v}:1", v, 500, 1.0, 0.9 - i / 10, i + 1, "p") for i, v in enumerate(rates)]
    columns = "query_id string, source string, keyframe_uid string, video_id string, original_frame_id bigint, timestamp_sec double, score double, rank int, keyframe_path string"
    spark.createDataFrame(lists, columns).selectExpr("*", f"{now} as retrieved_at").write.parquet(f"{tmp_path}/candidates.parquet")
    n_dense = {r["video_id"]: (r["n_dense"], r["even"]) for r in reference_queries.frame_windows(spark, str(tmp_path)).collect()}
    assert {v: n for v, (n, _) in n_dense.items()} == {"A": 51, "B": 18_001, "C": None, "D": 50_000}
    assert n_dense["D"][1] == [0, 7143, 14285, 21428, 25000, 35714, 42856, 49999]
    got = {r["keyframe_uid"]: r for r in reference_queries.refined_frames(spark, str(tmp_path)).collect()}
    score = lambda f: f * 7919 % 1009
    for v in "BD":
        fps, n = rates[v]
        first, last = max(0, 500 - round(3 * fps)), min(n - 1, 500 + round(3 * fps))
        sparse = min({*range(first, last + 1, round(fps / 4)), first, 500, last}, key=lambda f: (-score(f), f))
        dense = range(max(0, sparse - round(fps)), min(n - 1, sparse + round(fps)) + 1)
        r = got[f"{v}:1"]
        assert (r["refinement_status"], r["error"], r["sparse_frame_id"]) == ("refined", None, sparse)
        assert r["refined_frame_id"] == min(dense, key=lambda f: (-score(f), f))
    assert got["C:1"]["error"] == "frame or fps out of bounds"
    counts = reference_queries.refinement_overlay(spark, str(tmp_path)).collect()[0]
    assert (counts["n_refined"], counts["n_fallback"], counts["n_failed"]) == (3, 1, 1)


def _texts(spark, n, words, seed):
    random = np.random.default_rng(seed)
    rows = [(i if i else None, " ".join(f"w{int(x)}" for x in np.sort(random.zipf(1.6, random.integers(0, words)) % 30)), f"k{int(random.integers(0, n // 4))}" if i % 7 else None) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string")


def _scores_stay_in_a_task(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "FlatMapCoGroupsInArrow" in plan and "units" not in plan


def test_best_documents_are_those_of_all_scores(spark, monkeypatch):
    docs, asked = _texts(spark, 400, 6, 1), _texts(spark, 40, 30, 2).select(F.col("doc_id").alias("query_id"), "text")
    keys = docs.select("doc_id", "key").unionByName(docs.where("doc_id % 5 = 0").select("doc_id", F.lit("k3").alias("key")))
    want = rows(bm25.best_per_key(bm25.bm25_scores(docs, asked), keys, 10))
    assert len(want) > 300
    for block, turn in ((400_000, 500_000), (100, 50), (1, 10**9)):
        monkeypatch.setattr(bm25, "BLOCK_TERMS", block)
        monkeypatch.setattr(bm25, "QUERY_TERMS", turn)
        assert rows(bm25.best_documents(docs, asked, keys, 10)) == want
    assert rows(bm25.best_documents(docs.where("doc_id < 0"), asked, keys, 10)) == []
    frames = spark.createDataFrame([("f1", "V", 5, 1.0, "p")], "keyframe_uid string, video_id string, original_frame_id bigint, timestamp_sec double, keyframe_path string")
    speech = spark.createDataFrame([("s", "V", 0.0, 1.0, "w1 w2")], "segment_id string, video_id string, start_sec double, end_sec double, text string")
    found = branches.asr_branch(speech, frames)(asked.where("query_id < 9"), 3)
    assert _scores_stay_in_a_task(found) and found.count() > 3


def test_best_keys_of_all_queries_keep_their_scores_in_a_task(spark):
    assert _scores_stay_in_a_task(reference_queries.bm25_best_per_key(spark, "/root/testdata/sf0.001"))


def test_best_texts_of_all_queries_keep_their_scores_in_a_task(spark):
    docs, asked = _texts(spark, 300, 5, 3), _texts(spark, 30, 30, 4).select(F.col("doc_id").alias("query_id"), "text")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    found = bm25.bm25_topk(docs, asked, 10)
    assert _scores_stay_in_a_task(found)
    assert rows(found) == rows(bm25.bm25_scores(docs, asked).withColumn("rank", place).where("rank <= 10"))
