import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import models
from reelspark.plans.branches import asr_branch, auxiliary_branches, metadata_branch, ocr_branch, text_branch, vector_branch
from reelspark.plans.service import Service
from reelspark.schemas import ContractError
from tests.conftest import rows


def _load_texts():
    return lambda texts: [[1.0, 0.0] if "door" in t[:28] else [0.0, 4.0] for t in texts]


@pytest.fixture(scope="module")
def service(spark):
    keys = [("V:0", "V", 0, 0.0), ("V:1", "V", 10, 1.0), ("V:2", "V", 40, 4.0), ("W:0", "W", 10, 1.0), ("W:9", "W", None, None)]
    keyframes = spark.createDataFrame(keys, "keyframe_uid string, video_id string, original_frame_id bigint, timestamp_sec double").withColumn("keyframe_path", F.lit("p"))
    videos = spark.createDataFrame([("V", 10.0, 100, 10.0), ("W", 10.0, 100, 10.0)], "video_id string, fps double, frame_count bigint, duration_sec double")
    vectors = spark.createDataFrame([("V:0", [1.0, 0.0]), ("V:1", [0.0, 2.0]), ("V:2", [0.1, 3.0]), ("W:0", [0.0, 1.0]), ("W:9", [0.0, 1.0])], "keyframe_uid string, embedding array<float>")
    docs = spark.createDataFrame([("d1", "the door is open"), ("d2", "welcome home")], "doc_id string, text string")
    where = spark.createDataFrame([("d1", "V:0"), ("d2", "W:0")], "doc_id string, key string")
    encoder = lambda q: models.encode_texts(q, _load_texts)
    branches = {"clip": vector_branch(vectors, keyframes, encoder), "ocr": text_branch(docs, where, keyframes)}
    return Service(spark, keyframes, videos, branches, ["clip"], {"clip": 1.0, "ocr": 0.7})


def test_known_item(spark, service):
    kept, videos = service.known_item(spark.createDataFrame([("q", "open door"), ("r", "home")], "query_id string, text string"), top_k=10)
    first = {r["query_id"]: r["keyframe_uid"] for r in kept.where("rank = 1").collect()}
    assert first == {"q": "V:0", "r": "W:0"}
    assert videos.where("rank = 1").count() == 2
    assert service.health() == {"status": "ok", "sources": ["clip", "ocr"]} and service.catalog().count() == 2
    with pytest.raises(ContractError):
        service.known_item(spark.createDataFrame([("q", " ")], "query_id string, text string"))
    with pytest.raises(ContractError):
        service.known_item(spark.createDataFrame([("q", "x")], "query_id string, text string"), sources=["ocr"])


def _tables(spark, service):
    ocr = spark.createDataFrame([("o1", "V:0", "emergency exit sign"), ("o2", "W:9", "exit exit"), ("o3", "W:0", "welcome home")], "record_id string, keyframe_uid string, text string")
    asr = spark.createDataFrame([("s1", "V", 0.7, 1.1, "the door is open"), ("s2", "V", 90.0, 100.0, "door door"), ("s3", "V", 2.4, 2.6, "open")], "segment_id string, video_id string, start_sec double, end_sec double, text string")
    meta = spark.createDataFrame([("V", {"title": "High jump final", "tags": "bar"}), ("W", {"title": "door"})], "video_id string, fields map<string,string>")
    return ocr, asr, meta


def test_text_branches_give_keyframes_and_evidence(spark, service):
    ocr, asr, meta = _tables(spark, service)
    ask = lambda branch, text: rows(branch(spark.createDataFrame([("q", text)], "query_id string, text string"), 5), "rank", "keyframe_uid", "evidence_id", "evidence_text")
    # The record of an unmapped keyframe does not take a place.
    assert ask(ocr_branch(ocr, service.keyframes), "exit") == [(1, "V:0", "o1", "emergency exit sign")]
    assert ask(asr_branch(asr, service.keyframes), "door") == [(1, "V:2", "s2", "door door"), (2, "V:1", "s1", "the door is open")]
    # In the middle of two keyframes the smaller key counts.
    assert ask(asr_branch(asr, service.keyframes), "open")[0][1:3] == ("V:1", "s3")
    assert ask(metadata_branch(meta, service.keyframes), "high door") == [(1, "W:0", "W", "title: door"), (2, "V:0", "V", "tags: bar title: High jump final")]
    with pytest.raises(Exception, match="no such keyframe: X"):
        ask(ocr_branch(spark.createDataFrame([("o", "X", "exit")], ocr.schema), service.keyframes), "exit")


def test_branches_from_a_configuration(spark, service, tmp_path):
    (tmp_path / "meta.jsonl").write_text('{"video_id":"W","fields":{"title":"a door"}}\n')
    (tmp_path / "ocr.jsonl").write_text('{"record_id":"o1","keyframe_uid":"V:0","text":"exit"}\n{"keyframe_uid":"V:1","text":""}\n')
    config = {"metadata": {"enabled": True, "records_path": "meta.jsonl", "fields": ["title"]}, "asr": {"enabled": False}}
    branches, about = auxiliary_branches(spark, config, str(tmp_path), service.keyframes)
    assert list(branches) == ["metadata"] and about["metadata"]["record_count"] == 1 and about["ocr"] == {"enabled": False}
    found = branches["metadata"](spark.createDataFrame([("q", "door")], "query_id string, text string"), 3)
    assert rows(found, "keyframe_uid", "evidence_id") == [("W:0", "W")]
    for bad in ({"ocr": {"enabled": True}}, {"asr": 5}, {"metadata": {"enabled": True, "records_path": "meta.jsonl", "fields": "title"}}):
        with pytest.raises(ContractError):
            auxiliary_branches(spark, bad, str(tmp_path), service.keyframes)
    with pytest.raises(Exception, match="no text in line 2"):
        auxiliary_branches(spark, {"ocr": {"enabled": True, "records_path": "ocr.jsonl"}}, str(tmp_path), service.keyframes)


def test_five_branches_answers_and_refined_events(spark, service):
    ocr, asr, meta = _tables(spark, service)
    known = ocr.where("keyframe_uid <> 'W:9'")
    more = service.branches | {"screen": ocr_branch(known, service.keyframes), "asr": asr_branch(asr, service.keyframes), "metadata": metadata_branch(meta, service.keyframes)}
    videos = service.videos.withColumn("video_path", F.lit("p")).withColumn("is_readable", F.lit(True))
    five = Service(spark, service.keyframes, videos, more, ["clip"], {"clip": 1.0, "ocr": 0.7, "screen": 0.7, "asr": 0.7, "metadata": 0.5})
    kept, _ = five.known_item(spark.createDataFrame([("q", "open door")], "query_id string, text string"))
    assert kept.where("rank = 1").collect()[0]["keyframe_uid"] in ("V:0", "V:1")
    scorer = lambda asked: asked.select("query_id", "video_id", "frame_id", F.lit("m").alias("source"), (1 / (1 + F.abs(F.col("frame_id") - 3))).alias("score"))
    answerer = lambda df: df.withColumn("raw_answer", F.lit("Five people!")).withColumn("error", F.when(F.col("video_id") == "W", "no frames"))
    asked = spark.createDataFrame([("q", "open door", "how many")], "query_id string, text string, question string")
    for s in (None, scorer):
        good, failed = five.answers(asked, answerer, scorer=s)
        assert {r["answer"] for r in good.collect()} == {"5"} and {r["stage"] for r in failed.collect()} <= {"vlm_answer"}
    found = five.ordered_events(spark.createDataFrame([("q", "(1) a door opens (2) people come home"), ("r", "a door")], "query_id string, text string"), scorer=scorer)
    assert {r["query_id"]: len(r["final_frame_ids"]) for r in found.collect()} == {"q": 2, "r": 1}


def test_ordered_events(spark, service):
    found = service.ordered_events(spark.createDataFrame([("q", "(1) a door opens (2) people come home")], "query_id string, text string"))
    assert rows(found.where("rank = 1"), "video_id", "frame_ids") == [("V", [0, 10])]


def test_submissions(spark, service):
    results = spark.createDataFrame([("q", "V", 10, 1.0, 0.9, "5"), ("q", "V", 11, 1.1, 0.8, "6"), ("q", "W", 3, 0.3, 0.7, "7")], "query_id string, video_id string, frame_id bigint, timestamp_sec double, score double, answer string")
    assert service.prepare_submission(results, "qna")[0]["results"] == [{"video_id": "V", "frame_id": 10, "answer": "5"}, {"video_id": "W", "frame_id": 3, "answer": "7"}]
    with pytest.raises(ContractError):
        service.prepare_submission(results.withColumn("frame_id", F.lit(100).cast("bigint")), "kis")


def test_models_in_workers(spark):
    images = spark.createDataFrame([("q", "V", i, bytes([i, 1])) for i in range(5)], "query_id string, video_id string, frame_id bigint, image binary")
    coded = models.encode_images(images, lambda: lambda pictures: np.array([[p[0], p[1]] for p in pictures], float))
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    best = models.score_images(coded, asked, "m").orderBy(F.desc("score")).first()
    assert best["frame_id"] == 4
    with pytest.raises(Exception, match="one finite vector"):
        models.encode_images(images, lambda: lambda pictures: [[float("nan"), 1.0]] * len(pictures)).collect()

    def load():
        def run(pictures, event, question):
            if not pictures:
                raise ValueError("no frames")
            return f"{len(pictures)} {question}"

        return run

    asked = spark.createDataFrame([(1, ["a", "b"], "e", "how many"), (2, [], "e", "x")], "n int, images array<string>, event_text string, question string")
    assert rows(models.answer(asked, load), "n", "raw_answer", "error") == [(1, "2 how many", None), (2, None, "no frames")]
