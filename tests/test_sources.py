import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark import schemas
from reelspark.functions import sampling, text, vector
from reelspark.operators import audit, mapping
from reelspark.sources import media, sinks, tables, transfer
from reelspark.sources.jsonstream import members
from reelspark.streaming import incremental
from tests.conftest import rows


def test_source_sheet(spark, tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_text(" Filenames , DOWNLOAD LINK\nVideos_L1_a.zip,https://h.example/a\nKeyframes_L1.zip,nope\n,https://h.example/b\nVideos_L1_a.zip,https://h.example/a\n", encoding="utf-8")
    got = rows(tables.read_source_sheet(spark, str(sheet)), "filename", "category", "rejected")
    assert got == [("", "unknown", "empty field"), ("Keyframes_L1.zip", "keyframes", "invalid address"), ("Videos_L1_a.zip", "videos", "repeated"), ("Videos_L1_a.zip", "videos", None)]
    with pytest.raises(schemas.ContractError):
        tables.source_sheet(spark.createDataFrame([("a",)], "x string"))
    assert [n for n, _ in tables.default_archives("https://h.example", "b1", ["L1", "L2_a"])][:4] == ["Keyframes_L1.zip", "Keyframes_L2_a.zip", "Videos_L1_a.zip", "Videos_L2_a.zip"]


def test_text_artifacts(spark, tmp_path):
    (tmp_path / "ocr.jsonl").write_text('{"keyframe_uid":"V:1","text":"exit","bbox":[[0,0],[1,1]],"confidence":0.5}\n\n{"record_id":"x","keyframe_uid":"","text":"a"}\n{"record_id":"y","keyframe_uid":"V:2","text":"b","bbox":[1,2,3]}\n', encoding="utf-8")
    got = rows(tables.ocr_artifacts(tables.read_jsonl(spark, str(tmp_path / "ocr.jsonl"))), "record_id", "bbox", "problem")
    assert got == [("V:1:1", [0.0, 0.0, 1.0, 1.0], None), ("x", None, "no keyframe_uid"), ("y", None, "invalid bbox")]
    (tmp_path / "asr.jsonl").write_text('{"segment_id":"a","video_id":"V","start_sec":0.7,"end_sec":1.1,"text":"t"}\n{"segment_id":"b","video_id":"V","start_sec":2,"end_sec":1,"text":"t"}\n', encoding="utf-8")
    assert rows(tables.asr_artifacts(tables.read_jsonl(spark, str(tmp_path / "asr.jsonl"))), "segment_id", "problem") == [("a", None), ("b", "invalid times")]
    lines = [
        {"video_id": "V", "fields": {"title": "High jump final", "tags": ["athletics", " ", "bar"], "skip": "x"}},
        {"video_id": "W", "fields": {"title": "  ", "tags": []}}, {"video_id": "V", "fields": {"title": "again"}}, {"video_id": "U", "title": "flat"}, {"fields": {"title": "x"}}, 5,
    ]
    (tmp_path / "meta.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n", encoding="utf-8")
    read = tables.read_jsonl(spark, str(tmp_path / "meta.jsonl"))
    meta = tables.metadata_artifacts(read, ["title", "tags"])
    assert rows(meta.where("problem is null").select(text.metadata_document(F.col("fields")).alias("d"))) == [("tags: athletics bar title: High jump final",)]
    assert rows(meta.where("problem is not null"), "line", "problem") == [(3, "repeated video_id"), (4, "fields are no object"), (5, "no video_id"), (6, "no JSON object"), (7, "no JSON object")]
    with pytest.raises(schemas.ContractError):
        tables.metadata_artifacts(read, ["title", "author"])
    with pytest.raises(schemas.ContractError):
        tables.metadata_artifacts(read, [" "])


def test_mapping_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text('\ufeffVideo_ID,keyframe_index,frame_idx,frame_id,note\nl21_v001,0,9,90,"a, b"\nL21_V001,1,x,,c\nclip,2,3,4,"two\nlines"\nL21_V001,5,,6.5,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("videoid,keyframe_id,frame\nL21_V009,4,5\nL21_V009,a7,5\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("n,frame_idx\n0,5\n", encoding="utf-8")
    (tmp_path / "deep" / "L21_V002.json").write_text(json.dumps({"0": 0, "1": "25"}), encoding="utf-8")
    (tmp_path / "more.json").write_text(json.dumps({"data": {"items": [{"video_id": "l21_v003", "keyframe_index": 2, "frame_id": 7}, {"video_id": "x"}]}}), encoding="utf-8")
    nested: object = [{"video": "L21_V005", "index": 1, "frame": 2}]
    for _ in range(200):
        nested = {"frames": nested}
    (tmp_path / "nested.json").write_text(json.dumps(nested), encoding="utf-8")
    (tmp_path / "one.json").write_text(json.dumps({"video": "L21_V006", "image_index": "3", "frame_index": 4}), encoding="utf-8")
    (tmp_path / "list.jsonl").write_text('{"video":"L21_V004","keyframe":1,"frame":9}\n', encoding="utf-8")
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    (tmp_path / "other.json").write_text('{"x": {"video": "L21_V007", "index": 1, "frame": 2}, "y": true}', encoding="utf-8")
    (tmp_path / "note.txt").write_text("x", encoding="utf-8")
    found = tables.mapping_files(spark, str(tmp_path))
    assert rows(found.where("problem is null"), "video_id", "keyframe_index", "original_frame_id") == [
        ("CLIP", 2, 4), ("L21_V001", 0, 90), ("L21_V002", 0, 0), ("L21_V002", 1, 25), ("L21_V003", 2, 7), ("L21_V004", 1, 9), ("L21_V005", 1, 2), ("L21_V006", 3, 4), ("L21_V009", 4, 5),
    ]
    wrong = found.where("problem is not null").select(F.element_at(F.split("source_path", "/"), -1).alias("f"), "line", F.substring_index("problem", ":", 1).alias("p"))
    assert rows(wrong) == [
        ("a.csv", 3, "malformed"), ("a.csv", 5, "malformed"), ("b.csv", 3, "malformed"), ("bad.json", None, "malformed"), ("c.csv", 2, "malformed"), ("note.txt", None, "unsupported"), ("other.json", None, "unsupported"),
    ]


def test_mapping_validation(spark):
    videos = spark.createDataFrame([("V", 25.0, 5, 0.2), ("W", 10.0, None, 1.0)], "video_id string, fps double, frame_count bigint, duration_sec double")
    maps = spark.createDataFrame([("V", 0, 5), ("V", 1, 4), ("W", 0, 50), ("W", 1, 60), ("W", 2, 60), ("X", 0, 1)], "video_id string, keyframe_index bigint, original_frame_id bigint")
    keys = spark.createDataFrame([("V", 0, True), ("V", 1, True), ("V", 2, False), ("W", None, False)], "video_id string, keyframe_index bigint, has_mapping boolean")
    got = dict(rows(mapping.validate_mapping(keys, videos, maps)))
    assert got == {"matched": 2, "missing_mapping": 2, "missing_image": 4, "unknown_video": 1, "invalid_frame": 2, "duplicate_index": 0, "duplicate_frame": 1, "non_monotonic": 1}
    assert rows(mapping.mapping_issues(mapping.validate_mapping(keys, videos, maps)), "code")[0] == ("duplicate_original_frame_mapping",)
    assert rows(mapping.mapping_summary(keys, maps), "video_id", "n_missing", "monotonic") == [("V", 1, False), ("W", 1, True), ("X", 0, True)]
    last = mapping.last_mapping(maps.withColumn("n", F.lit(1)).unionByName(spark.createDataFrame([("V", 0, 2, 2)], "video_id string, keyframe_index bigint, original_frame_id bigint, n int")), "n")
    assert last.where("video_id = 'V' and keyframe_index = 0").collect()[0]["original_frame_id"] == 2


def _png(width, height):
    return b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)


def test_media_scans(spark, tmp_path):
    folder = tmp_path / "L21_V001"
    folder.mkdir()
    (folder / "000.png").write_bytes(_png(8, 4))
    (folder / "001.jpg").write_bytes(b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HH", 6, 9) + b"\x03")
    (folder / "002.jpg").write_bytes(b"no image")
    got = rows(media.scan_images(spark, str(tmp_path)), "keyframe_uid", "width", "height", "image_mode", "is_readable")
    assert got == [("L21_V001:000000", 8, 4, "RGB", True), ("L21_V001:000001", 9, 6, "RGB", True), ("L21_V001:000002", None, None, None, False)]
    (tmp_path / "L21_V001.mp4").write_bytes(b"x")
    (tmp_path / "L21_V002.mp4").write_bytes(b"x")
    probe = {"streams": [{"codec_type": "video", "codec_name": "h264", "avg_frame_rate": "30000/1001", "width": 2, "height": 1}, {"codec_type": "audio", "codec_name": "aac", "sample_rate": "48000"}], "format": {"duration": "10.0", "format_name": "mov"}}

    def prober(path):
        if "V002" in path:
            raise RuntimeError("broken")
        return json.dumps(probe)

    got = rows(media.scan_videos(spark, str(tmp_path), prober), "video_id", "frame_count", "has_audio", "is_readable", "probe_error")
    assert got == [("L21_V001", 300, True, True, None), ("L21_V002", None, False, False, "broken")]

    def decoder(path, ids):
        return ((i, i / 10, bytes([i])) for i in ids if i != 3)

    asked = spark.createDataFrame([("V", "p", i) for i in (5, 3, 1, 5)], "video_id string, video_path string, frame_id bigint")
    assert rows(media.decode_frames(asked, decoder), "frame_id", "timestamp_sec", "error") == [(1, 0.1, None), (3, None, "frame was not decoded"), (5, 0.5, None)]


def test_vector_files_and_stores(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.array([[1, 0], [0, 2], [0, 3]], np.float16))
    matrix = media.read_npy(spark, str(tmp_path / "m.npy"), rows_per_partition=2)
    (tmp_path / "order.json").write_text(json.dumps({"mapping_verified": True, "keyframe_uids": ["a", "b", "c"]}))
    named = media.with_order(spark, matrix, str(tmp_path / "order.json"))
    assert rows(named) == [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [0.0, 3.0])]
    (tmp_path / "order.json").write_text(json.dumps({"keyframe_uids": ["a", "b", "c"]}))
    with pytest.raises(ValueError):
        media.with_order(spark, matrix, str(tmp_path / "order.json"))
    keys, store = named.select("keyframe_uid"), str(tmp_path / "store")
    encoder = lambda df: df.join(named, "keyframe_uid")
    assert sinks.write_vectors(keys.where("keyframe_uid <> 'c'"), encoder, store, "h1") == 2
    assert sinks.write_vectors(keys, encoder, store, "h1") == 1 and sinks.write_vectors(keys, encoder, store, "h1") == 0
    with pytest.raises(schemas.ContractError):
        sinks.write_vectors(keys, encoder, store, "h2")
    sinks.write_index(named, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).where("keyframe_uid = 'b'").collect()[0]["embedding"] == [0.0, 1.0]
    bad = spark.createDataFrame([([1.0, float("nan")],), ([0.0, 0.0],), ([3.0, 4.0],), (None,)], "embedding array<float>")
    r = vector.vector_report(bad, "embedding", 2).collect()[0]
    assert (r["n_vectors"], r["n_nan"], r["n_zero"], r["n_null"], r["max_norm"], r["normalized"]) == (4, 1, 1, 1, 5.0, False)
    with pytest.raises(Exception, match="length 0"):
        bad.select(vector.l2_normalize(F.col("embedding"))).collect()
    assert media.file_checksums(spark, str(tmp_path / "order.json")).count() == 1


def test_archives_and_transfer(spark, tmp_path):
    good = tmp_path / "a.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("L1/x.txt", "hello")
    (tmp_path / "b.zip").write_bytes(b"junk")
    assert rows(media.scan_archives(spark, str(tmp_path)), "valid", "members") == [(False, 0), (True, 1)]
    assert transfer.extract(str(good), str(tmp_path / "out")) == (1, 0) and transfer.extract(str(good), str(tmp_path / "out")) == (0, 1)
    evil = tmp_path / "evil.zip"
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../x.txt", "no")
    with pytest.raises(ValueError):
        transfer.extract(str(evil), str(tmp_path / "out"))
    names = spark.createDataFrame([("a/b",), ("../a",), ("/a",), ("C:/x",), ("a\\..\\b",)], "p string")
    assert [r[0] for r in names.select(text.safe_member_path(F.col("p"))).collect()] == [True, False, False, False, False]

    class Answer(io.BytesIO):
        status = 206

    calls = []

    def opener(request, timeout):
        calls.append(request.get_header("Range"))
        if len(calls) == 1:
            raise OSError("down")
        return Answer(b"world")

    (tmp_path / "f.part").write_bytes(b"hello ")
    assert transfer.download("https://h.example/f", str(tmp_path / "f"), opener=opener, sleep=lambda s: None) == 11 and calls == ["bytes=6-", "bytes=6-"]
    assert transfer.clean(str(tmp_path), ["out"])[0][1] == 5 and (tmp_path / "out").exists()
    transfer.clean(str(tmp_path), ["out"], confirm=True)
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError):
        transfer.cleanup_plan(str(tmp_path), ["../x"])
    with pytest.raises(FileNotFoundError):
        transfer.media_path("../etc", str(tmp_path))


def test_submission_files_and_logs(spark, tmp_path):
    schema = "query_id string, task string, rank int, video_id string, frame_ids array<bigint>, answer string"
    videos = spark.createDataFrame([("V", 100)], "video_id string, frame_count bigint")
    one, two = (spark.createDataFrame([(q, "kis", r, "V", [r * 10], None) for r in (1, 2)], schema) for q in ("a", "b"))
    path = str(tmp_path / "s.json")
    sinks.write_submission(spark, one, videos, path)
    with pytest.raises(FileExistsError):
        sinks.write_submission(spark, two, videos, path)
    sinks.write_submission(spark, two, videos, path, append=True)
    with pytest.raises(schemas.ContractError):
        sinks.write_submission(spark, two, videos, path, append=True)
    assert rows(tables.read_submission(spark, path)) == rows(one.unionByName(two))
    (tmp_path / "bad.json").write_text('{"schema_version":"1.0","queries":[{"query_id":"a","task":"kis","results":[],"x":1}]}')
    with pytest.raises(Exception, match="unknown or missing"):
        tables.read_submission(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "gt.json").write_text('{"schema_version":"1.0","queries":[{"query_id":"a","task":"kis","video_id":"V","frame_windows":[{"start":1,"end":2}]}]}')
    assert tables.read_ground_truth(spark, str(tmp_path / "gt.json")).count() == 1
    record = spark.createDataFrame([("e1", "kis", "d", "c", ["a"], {}, {}, {"r": 0.5}, {}, "g", "n", "t")], schemas.EXPERIMENT)
    sinks.append_experiment(record, str(tmp_path / "log"))
    with pytest.raises(schemas.ContractError):
        sinks.append_experiment(record, str(tmp_path / "log"))
    (tmp_path / "m.jsonl").write_text('{"filename":"a","download_url":"u","state":"new"}\n{"filename":"a","download_url":"u","state":"done"}\n')
    manifest = tables.read_archive_manifest(spark, str(tmp_path / "m.jsonl"))
    assert rows(manifest, "state") == [("done",)]
    assert rows(sinks.upsert_archives(manifest, manifest.withColumn("state", F.lit("gone"))), "state") == [("gone",)]
    with pytest.raises(schemas.ContractError):
        sinks.write_manifest(manifest, schemas.ARCHIVE, str(tmp_path / "x"), spark.createDataFrame([("HIGH", "c", "m", [])], schemas.ISSUE))
    sinks.write_manifest(manifest, schemas.ARCHIVE, str(tmp_path / "x"))
    docs = sinks.result_documents(spark.createDataFrame([("q", "find it")], "query_id string, text string"), spark.createDataFrame([("q", 1, "V")], "query_id string, rank int, video_id string"), "kis")
    assert json.loads(docs.collect()[0]["json"])["candidates"] == [{"rank": 1, "video_id": "V"}]
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert tables.load_config(str(tmp_path / "c.json")) == {"a": 1}
    assert "| a | 1 |" in sinks.markdown("T", {"x": spark.createDataFrame([("a", 1)], "k string, n int")})


def test_submission_is_read_as_a_stream(spark, tmp_path):
    given = iter(['{"queries": [ {"a":"}]\\\\\\"["}, 5', '7 ,{"b"', ":[{}]}]", ', "schema_version":"1.0"}\n'])
    found = members(given, "queries", {"schema_version": "1.0"})
    assert next(found) == '{"a":"}]\\\\\\"["}' and next(given) == '7 ,{"b"'  # given before the rest is asked for
    assert list(members(iter(['{"queries":[1,', '2]', "}"]), "queries", {})) == ["1", "2"] and list(members(iter(["{ }"]), "queries", {})) == []
    for bad in ('{"queries":[{}]', '{"queries":[{}', '{"queries":[{}]}x', '{"queries":[{},]}', '{"queries":[{}],"schema_version":"2.0"}'):
        with pytest.raises(ValueError):
            list(members(iter(bad), "queries", {"schema_version": "1.0"}))
    queries = [{"query_id": f"q{i}", "task": "qna", "results": [{"video_id": "V", "frame_id": r, "answer": 'a } "{ \\'} for r in range(20)]} for i in range(500)]
    for indent in (None, 1):
        path = tmp_path / f"s{indent}.json"
        path.write_text(json.dumps({"queries": queries, "schema_version": "1.0"}, indent=indent))
        got = tables.read_submission(spark, str(path))
        assert got.count() == 10_000 and got.where("answer = 'a } \"{ \\\\' and rank = frame_ids[0] + 1").count() == 10_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert tables.read_submission(spark, str(path)).select("query_id", "rank").distinct().count() == 10_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for end in (-1, -2, -500):
        (tmp_path / "cut.json").write_text(path.read_text()[:end])
        with pytest.raises(Exception, match="not valid JSON"):
            tables.read_submission(spark, str(tmp_path / "cut.json")).collect()
    (tmp_path / "old.json").write_text('{"queries":[],"schema_version":"0.9"}')
    with pytest.raises(Exception, match="unsupported schema_version"):
        tables.read_submission(spark, str(tmp_path / "old.json")).collect()


def test_sampling(spark):
    df = spark.createDataFrame([(10, 10.0, 12), (0, 10.0, None), (12, 10.0, 12), (5, 0.0, 12)], "c bigint, fps double, n bigint")
    w = sampling.frame_window(F.col("c"), F.col("fps"), 1.0, F.col("n"))
    got = df.withColumn("w", w).select("c", sampling.sparse_ids(F.col("w"), F.col("fps"), 2.0).alias("s"), sampling.dense_ids(F.col("w")).alias("d"), sampling.even_ids(F.col("w"), 3).alias("e")).collect()
    assert got[0]["s"] == [0, 5, 10, 11] and got[0]["d"] == list(range(12)) and got[0]["e"] == [0, 6, 10]
    assert got[1]["d"] == list(range(11)) and got[2]["d"] is None and got[3]["s"] is None


def test_audit(spark):
    videos = spark.createDataFrame([("A", "G1", 10.0, 100, 10.0, 2, 2, True), ("B", None, 10.0, 100, 50.0, 2, 2, True), ("C", "G1", None, None, float("nan"), 2, 2, False)], "video_id string, group_id string, fps double, frame_count bigint, duration_sec double, width int, height int, is_readable boolean")
    assert rows(audit.video_checks(videos)) == [("B", "duration mismatch"), ("C", "unreadable")]
    assert rows(audit.group_durations(videos), "is_total", "n_videos") == [(False, 2), (True, 3)]
    profile = audit.json_profile(spark.createDataFrame([('{"a":1,"b":""}',), ('{"a":null}',), ("[1]",), ("x",), (None,)], "j string"), "j")
    assert rows(profile, "field", "type", "n_present", "presence_rate", "n_empty") == [("a", "null", 1, 1.0, 1), ("a", "number", 1, 1.0, 0), ("b", "string", 1, 0.5, 1)]
    ids = {n: spark.createDataFrame([(x,) for x in v], "id string") for n, v in (("k", "ab"), ("v", "bc"))}
    assert rows(audit.id_differences(ids, [("k", "v"), ("v", "k")])) == [("k - v", "a"), ("v - k", "c")]
    sample = audit.stratified_sample(videos, "group_id", "video_id", 1)
    assert sample.count() == 2 and rows(sample) == rows(audit.stratified_sample(videos, "group_id", "video_id", 1))
    issues = spark.createDataFrame([("LOW", "b", "m", []), ("HIGH", "z", "m", []), ("HIGH", "a", "m", []), ("HIGH", "a", "m", [])], schemas.ISSUE)
    assert [r["code"] for r in audit.ordered_issues(issues).collect()] == ["a", "z", "b"]


def test_streams(spark, tmp_path):
    keys = spark.createDataFrame([("a",), ("b",), ("a",)], "keyframe_uid string")
    keys.write.parquet(str(tmp_path / "in"))
    encoder = lambda df: df.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    for _ in range(2):
        stream = spark.readStream.schema(keys.schema).parquet(str(tmp_path / "in"))
        incremental.encode_stream(stream, encoder, str(tmp_path / "store"), "h", str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    segments = "video_id string, start_ms bigint, end_ms bigint"
    for n, data in enumerate([[("V", 0, 5), ("V", 8, 9)], [("V", 4, 8), ("W", 1, 2)]]):
        spark.createDataFrame(data, segments).coalesce(1).write.mode("append").parquet(str(tmp_path / "seg"))
        stream = spark.readStream.schema(spark.createDataFrame([], segments).schema).parquet(str(tmp_path / "seg"))
        incremental.periods_stream(stream, str(tmp_path / "periods"), str(tmp_path / "cp2")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "periods/v1"))) == [("V", 0, 9), ("W", 1, 2)]


def test_archives_prompts_hashes_and_cache(spark, tmp_path):
    sheet = tables.source_sheet(spark.createDataFrame([(n, a) for n, a in tables.default_archives("https://h.example/", "b1")], "`Filenames` string, `Download link` string"))
    assert [tables.select_archives(sheet, s).count() for s in ("all", "support", "keyframes", "videos", "objects")] == [32, 4, 14, 14, 1]
    with pytest.raises(schemas.ContractError):
        tables.select_archives(sheet, "music")
    asked = spark.createDataFrame([(" a man ", "who?")], "e string, q string")
    assert asked.select(text.answer_prompt(F.col("e"), F.col("q"))).collect()[0][0].endswith("Event description: a man\nQuestion: who?")
    with pytest.raises(Exception, match="are needed"):
        asked.select(text.answer_prompt(F.col("e"), F.lit(" "))).collect()
    assert text.config_hash({"b": 1, "a": [1, 2]}) == text.config_hash({"a": [1, 2], "b": 1}) != text.config_hash({"a": [2, 1], "b": 1})
    boxes = spark.createDataFrame([("[[[0,0],[1,1]],[[2,2]]]",), ("[1,2,3]",), ('[1,2,3,"x"]',), ("5",), (None,), ("[1,2,NaN,4]",)], "b string")
    assert [r[0] for r in boxes.select(text.flatten_bbox(F.col("b"))).collect()] == [[0, 0, 1, 1, 2, 2], None, None, None, None, None]
    cache = sinks.ResultCache(str(tmp_path / "cache"))
    assert cache.get("k") is None and cache.get_or("k", lambda: {"a": None}) == {"a": None} and cache.get_or("k", lambda: 1 / 0) == {"a": None}
    next((tmp_path / "cache").glob("*.json")).write_text('{"key": "other", "value": 1}')
    with pytest.raises(schemas.ContractError):
        cache.get("k")
    assert cache.clear("k") and not cache.clear("k")
    for bad in (lambda: cache.put("k", object()), lambda: cache.get(" ")):
        with pytest.raises(schemas.ContractError):
            bad()
    log = spark.createDataFrame([("a.zip", "x/1.jpg", 5)], "archive string, member string, size bigint")
    for part in (log, log.limit(0), log):
        sinks.append_extractions(part, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
