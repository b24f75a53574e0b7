"""Images, videos, vector files and archives: scanned in tasks, with injected probes where a codec is needed."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import subprocess
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reelspark.functions.text import infer_group_id, infer_index, infer_video_id, keyframe_uid, parse_fraction

IMAGE_SUFFIXES = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"
VIDEO_SUFFIXES = "*.{mp4,mkv,avi,mov,webm,MP4,MKV,AVI,MOV,WEBM}"


def image_header(content: bytes) -> tuple[int, int, str]:
    """(width, height, mode) of a PNG or JPEG; ValueError for anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR" and len(content) >= 26:
        width, height = struct.unpack(">II", content[16:24])
        return width, height, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(content[25], "?")
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content):
            if content[at] != 0xFF:
                raise ValueError("broken JPEG segment")
            marker = content[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(content[at + 9] if at + 9 < len(content) else 3, "?")
            at += 1 if marker == 0xFF else 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    raise ValueError("no PNG or JPEG header")


def scan_images(spark: SparkSession, root: str, probe: Callable[[bytes], tuple[int, int, str]] = image_header) -> DataFrame:
    """Keyframe rows (without mapping) of the image files below ``root``; unreadable ones carry the error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_SUFFIXES).load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, length, content in zip(pdf["path"], pdf["length"], pdf["content"]):
                try:
                    rows.append((path, length, *probe(content), True, None))
                except Exception as error:  # noqa: BLE001 - a bad file is a row, not a failure
                    rows.append((path, length, None, None, None, False, str(error)))
            yield pd.DataFrame(rows, columns=["path", "length", "width", "height", "mode", "ok", "error"])

    probed = files.select("path", "length", "content").mapInPandas(run, "path string, length bigint, width bigint, height bigint, mode string, ok boolean, error string")
    stem = F.regexp_extract("path", r"([^/\\]+)\.[^./\\]+$", 1)
    video, index = infer_video_id(F.col("path")), infer_index(stem)
    uid = F.when(video.isNotNull() & index.isNotNull(), keyframe_uid(video, index)).otherwise(stem)
    return probed.select(
        uid.alias("keyframe_uid"), video.alias("video_id"), index.alias("keyframe_index"), F.col("path").alias("keyframe_path"),
        "width", "height", F.col("length").alias("file_size_bytes"), F.col("ok").alias("is_readable"), F.col("mode").alias("image_mode"), F.col("error").alias("read_error"),
    )


def ffprobe(path: str) -> str:
    """The JSON that ffprobe prints for a file."""
    command = ["ffprobe", "-v", "error", "-print_format", "json", "-show_format", "-show_streams", path.removeprefix("file:")]
    done = subprocess.run(command, capture_output=True, text=True, timeout=120, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or "ffprobe failed")
    return done.stdout


_PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,width:bigint,height:bigint,avg_frame_rate:string,r_frame_rate:string,nb_frames:string,duration:string,sample_rate:string,channels:bigint>>,format:struct<format_name:string,duration:string,bit_rate:string>>"


def scan_videos(spark: SparkSession, root: str, prober: Callable[[str], str] = ffprobe) -> DataFrame:
    """Video rows of the files below ``root``; the prober gives ffprobe's JSON, its errors become rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", VIDEO_SUFFIXES).load(root).select("path", "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, length in zip(pdf["path"], pdf["length"]):
                try:
                    rows.append((path, length, prober(path), None))
                except Exception as error:  # noqa: BLE001
                    rows.append((path, length, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "length", "probe", "error"])

    raw = files.mapInPandas(run, "path string, length bigint, probe string, error string").withColumn("p", F.from_json("probe", _PROBE))
    first = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), 0)
    rows = raw.withColumn("v", first("video")).withColumn("a", first("audio"))
    video = F.coalesce(infer_video_id(F.col("path")), F.regexp_extract("path", r"([^/\\]+)\.[^./\\]+$", 1))
    fps = F.coalesce(parse_fraction(F.col("v.avg_frame_rate")), parse_fraction(F.col("v.r_frame_rate")))
    duration = F.coalesce(F.col("p.format.duration").try_cast("double"), F.col("v.duration").try_cast("double"))
    frames = F.coalesce(F.col("v.nb_frames").try_cast("bigint"), F.when((fps > 0) & duration.isNotNull(), F.rint(fps * duration).cast("bigint")))
    error = F.coalesce("error", F.when(F.col("v").isNull(), "no video stream"))
    return rows.select(
        video.alias("video_id"), F.col("path").alias("video_path"), infer_group_id(video).alias("group_id"), fps.alias("fps"), frames.alias("frame_count"),
        duration.alias("duration_sec"), F.col("v.width").alias("width"), F.col("v.height").alias("height"), F.col("v.codec_name").alias("video_codec"),
        F.col("a.codec_name").alias("audio_codec"), F.col("a.sample_rate").try_cast("bigint").alias("audio_sample_rate"), F.col("a.channels").alias("audio_channels"),
        F.col("a").isNotNull().alias("has_audio"), F.col("p.format.format_name").alias("container"), F.col("length").alias("file_size_bytes"),
        error.isNull().alias("is_readable"), F.col("p.format.bit_rate").try_cast("bigint").alias("bitrate"), error.alias("probe_error"),
    )


def decode_frames(requests: DataFrame, decoder: Callable[[str, list[int]], Iterator[tuple[int, float, bytes]]]) -> DataFrame:
    """Rows (video_id, frame_id, timestamp_sec, image, error) of requested (video_id, video_path, frame_id).

    All requests of a stretch of a video meet in one task in frame order, so the decoder
    seeks once and reads on; long videos are spread over several tasks.
    """
    stretch = F.floor(F.col("frame_id") / 4_096)
    asked = requests.select("video_id", "video_path", "frame_id").distinct().withColumn("stretch", stretch)
    ordered = asked.repartition("video_id", "stretch").sortWithinPartitions("video_id", "stretch", "frame_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for (video, path, _), part in pdf.groupby(["video_id", "video_path", "stretch"], sort=False):
                ids = [int(x) for x in part["frame_id"]]
                try:
                    found = {f: (t, image) for f, t, image in decoder(path, ids)}
                    rows += [(video, f, *found[f], None) if f in found else (video, f, None, None, "frame was not decoded") for f in ids]
                except Exception as error:  # noqa: BLE001
                    rows += [(video, f, None, None, str(error)) for f in ids]
            yield pd.DataFrame(rows, columns=["video_id", "frame_id", "timestamp_sec", "image", "error"])

    return ordered.mapInPandas(run, "video_id string, frame_id bigint, timestamp_sec double, image binary, error string")


class _Rows(InputPartition):
    def __init__(self, path: str, start: int, stop: int) -> None:
        self.path, self.start, self.stop = path, start, stop


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.rows = int(options.get("rowsPerPartition", 8_192))

    def partitions(self) -> list[InputPartition]:
        import numpy as np

        out = []
        for path in self.paths:
            n = np.load(path, mmap_mode="r").shape[0]
            out += [_Rows(path, s, min(n, s + self.rows)) for s in range(0, n, self.rows)]
        return out

    def read(self, partition: InputPartition):
        import numpy as np

        matrix = np.load(partition.path, mmap_mode="r")
        for i in range(partition.start, partition.stop):
            yield (partition.path, i, [float(x) for x in matrix[i]])


class NpySource(DataSource):
    """Rows (path, row, vector) of two-dimensional .npy files, memory-mapped in ranges of rows."""

    @classmethod
    def name(cls) -> str:
        return "npy_vectors"

    def schema(self) -> str:
        return "path string, row bigint, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


def read_npy(spark: SparkSession, *paths: str, rows_per_partition: int = 8_192) -> DataFrame:
    """The rows of .npy matrices through the Python data source."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy_vectors").option("paths", ",".join(paths)).option("rowsPerPartition", rows_per_partition).load()


def with_order(spark: SparkSession, vectors: DataFrame, manifest_path: str) -> DataFrame:
    """Rows (keyframe_uid, embedding): matrix rows named by an order manifest, which must be verified and complete."""
    with open(manifest_path, encoding="utf-8") as file:
        manifest = json.load(file)
    uids = manifest.get("keyframe_uids")
    if manifest.get("mapping_verified") is not True or not isinstance(uids, list):
        raise ValueError("the order manifest must hold keyframe_uids and mapping_verified: true")
    if len(set(uids)) != len(uids):
        raise ValueError("the order manifest repeats a keyframe_uid")
    if vectors.count() != len(uids):
        raise ValueError("the order manifest and the matrix differ in length")
    order = spark.createDataFrame([(i, u) for i, u in enumerate(uids)], "row bigint, keyframe_uid string")
    return vectors.join(order, "row").select("keyframe_uid", F.col("vector").alias("embedding"))


def file_checksums(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, length, sha256) of all files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def inspect_zip(content: bytes) -> tuple[bool, int, int, str | None]:
    """(valid, members, uncompressed bytes, error) of an archive; every member's checksum is read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            broken = archive.testzip()
            infos = archive.infolist()
            return broken is None, len(infos), sum(i.file_size for i in infos), broken and f"checksum of {broken}"
    except zipfile.BadZipFile as error:
        return False, 0, 0, str(error)


def scan_archives(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, length, sha256, valid, members, uncompressed_bytes, error) of the ZIP files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{zip,ZIP}").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, n, hashlib.sha256(c).hexdigest(), *inspect_zip(c)) for p, n, c in zip(pdf["path"], pdf["length"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["path", "length", "sha256", "valid", "members", "uncompressed_bytes", "error"])

    return files.select("path", "length", "content").mapInPandas(run, "path string, length bigint, sha256 string, valid boolean, members bigint, uncompressed_bytes bigint, error string")
