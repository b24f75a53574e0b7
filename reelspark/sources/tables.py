"""Reading manifests, text artifacts, mappings, submissions and source sheets."""

from __future__ import annotations

import csv
import io
import json
import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from reelspark import schemas
from reelspark.functions.text import flatten_bbox, infer_video_id, safe_float, safe_int
from reelspark.operators.skew import small_side
from reelspark.session import parallelism
from reelspark.sources.jsonstream import members


def read_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """The keyframe manifest; missing columns are an error."""
    return schemas.require(spark.read.parquet(path), schemas.KEYFRAME, "keyframe manifest")


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """The video manifest; a repeated video_id is an error."""
    return schemas.require_unique(schemas.require(spark.read.parquet(path), schemas.VIDEO, "video manifest"), "video manifest", "video_id")


# How file names tell the category of an archive.
ARCHIVE_PATTERNS = (
    ("keyframes", r"^keyframes_.+\.zip$"),
    ("videos", r"^videos_.+\.zip$"),
    ("clip_features", r"^clip-features-.*\.zip$"),
    ("map_keyframes", r"^map-keyframes-.*\.zip$"),
    ("media_info", r"^media-info-.*\.zip$"),
    ("objects", r"^objects-.*\.zip$"),
)


def archive_category(filename: Column) -> Column:
    """The category a file name tells, else ``unknown``."""
    name = F.lower(F.trim(filename))
    out = F.when(F.lit(False), "")
    for category, pattern in ARCHIVE_PATTERNS:
        out = out.when(name.rlike(pattern), category)
    return out.otherwise("unknown")


def valid_url(url: Column) -> Column:
    """True for http and https addresses with a host."""
    clean = F.trim(url)
    return F.coalesce(F.lower(F.try_parse_url(clean, F.lit("PROTOCOL"))).isin("http", "https") & (F.try_parse_url(clean, F.lit("HOST")) != ""), F.lit(False))


def source_sheet(rows: DataFrame, filename_column: str = "Filenames", url_column: str = "Download link") -> DataFrame:
    """Rows (filename, download_url, category, rejected) of a sheet of archives.

    Headers are found whatever their case and padding; a missing one is an error. Wholly
    empty rows are left out. ``rejected`` says why a row does not count (an empty field, an
    invalid address, a repetition of the same pair) and is null for the others.
    """
    names = {c.lstrip("﻿").strip().casefold(): c for c in rows.columns}
    found = [names.get(c.casefold()) for c in (filename_column, url_column)]
    if None in found:
        raise schemas.ContractError(f"the sheet needs the columns {filename_column!r} and {url_column!r}")
    clean = [F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in found]
    order = F.monotonically_increasing_id()
    sheet = rows.select(clean[0].alias("filename"), clean[1].alias("download_url"), order.alias("__n")).where("filename <> '' or download_url <> ''")
    again = F.row_number().over(W.Window.partitionBy("filename", "download_url").orderBy("__n")) > 1
    why = F.when((F.col("filename") == "") | (F.col("download_url") == ""), "empty field").when(~valid_url(F.col("download_url")), "invalid address").when(again, "repeated")
    return sheet.withColumn("rejected", why).select("filename", "download_url", archive_category(F.col("filename")).alias("category"), "rejected")


def read_source_sheet(spark: SparkSession, path: str) -> DataFrame:
    """source_sheet() of a CSV file with a header."""
    return source_sheet(spark.read.csv(path, header=True, encoding="UTF-8"))


#: Categories of archives that hold neither keyframes nor videos.
SUPPORT = ("clip_features", "map_keyframes", "media_info", "objects")


def select_archives(sheet: DataFrame, selection: str) -> DataFrame:
    """The archives (with ``category``) of a selection: ``all``, ``support``, or a category by name."""
    known = [c for c, _ in ARCHIVE_PATTERNS]
    if selection == "all":
        return sheet
    if selection != "support" and selection not in known:
        raise schemas.ContractError(f"a selection is all, support or one of {', '.join(known)}")
    return sheet.where(F.col("category").isin(*(SUPPORT if selection == "support" else (selection,))))


# The archives that are expected where no sheet can be had.
ARCHIVE_GROUPS = ("L21", "L22", "L23", "L24", "L25", "L26_a", "L26_b", "L26_c", "L26_d", "L26_e", "L27", "L28", "L29", "L30")
SUPPORT_ARCHIVES = ("clip-features-32-%s.zip", "map-keyframes-%s.zip", "media-info-%s.zip", "objects-%s.zip")


def default_archives(base_url: str, batch: str, groups: Sequence[str] = ARCHIVE_GROUPS) -> list[tuple[str, str]]:
    """(filename, address) of the archives that are expected where no sheet can be had.

    The host and the name of the batch, which the supporting archives bear, are the caller's.
    """
    names = [f"Keyframes_{g}.zip" for g in groups] + [f"Videos_{g if '_' in g else g + '_a'}.zip" for g in groups] + [n % batch for n in SUPPORT_ARCHIVES]
    return [(n, f"{base_url.rstrip('/')}/{n}") for n in names]


# --- text artifacts -------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, line, value) of the non-blank lines of text files, which are read in splits.

    A first pass counts the lines of each split, one row per split; their running sums turn
    places within a split into line numbers.
    """
    place = F.monotonically_increasing_id().alias("__at")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), place, "value")
    splits = lines.groupBy("path", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__first"))
    before = W.Window.partitionBy("path").orderBy("__block").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = small_side(splits.select("path", "__block", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")))
    number = (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("line")
    return lines.join(starts, ["path", "__block"]).select("path", number, "value").where(F.trim("value") != "")


def _checked(df: DataFrame, problems: list[Column]) -> DataFrame:
    return df.withColumn("problem", F.coalesce(*problems))


def ocr_artifacts(lines: DataFrame) -> DataFrame:
    """OCR records of JSON lines with ``problem`` (null if valid): keys, text, box and confidence are checked."""
    raw = F.from_json("value", "record_id string, keyframe_uid string, text string, bbox string, confidence string")
    rows = lines.select("path", "line", raw.alias("r"))
    out = rows.select(
        "path",
        "line",
        F.coalesce(F.trim("r.record_id"), F.concat_ws(":", "r.keyframe_uid", F.col("line").cast("string"))).alias("record_id"),
        F.trim("r.keyframe_uid").alias("keyframe_uid"),
        F.col("r.text").alias("text"),
        flatten_bbox(F.col("r.bbox")).alias("bbox"),
        safe_float(F.col("r.confidence")).alias("confidence"),
        F.col("r.bbox").isNotNull().alias("has_box"),
        F.col("r.confidence").isNotNull().alias("has_confidence"),
    )
    again = F.count(F.lit(1)).over(W.Window.partitionBy("record_id")) > 1
    checked = _checked(
        out,
        [
            F.when(F.coalesce("keyframe_uid", F.lit("")) == "", "no keyframe_uid"),
            F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text"),
            F.when(F.col("has_box") & F.col("bbox").isNull(), "invalid bbox"),
            F.when(F.col("has_confidence") & (F.col("confidence").isNull() | (F.col("confidence") < 0)), "invalid confidence"),
            F.when(again, "repeated record_id"),
        ],
    )
    return checked.drop("has_box", "has_confidence")


def asr_artifacts(lines: DataFrame) -> DataFrame:
    """Speech segments of JSON lines with ``problem``: 0 <= start <= end, a video and a text."""
    raw = F.from_json("value", "segment_id string, video_id string, start_sec string, end_sec string, text string")
    rows = lines.select("path", "line", raw.alias("r")).select(
        "path",
        "line",
        F.coalesce(F.trim("r.segment_id"), F.concat_ws(":", "r.video_id", F.col("line").cast("string"))).alias("segment_id"),
        F.trim("r.video_id").alias("video_id"),
        safe_float(F.col("r.start_sec")).alias("start_sec"),
        safe_float(F.col("r.end_sec")).alias("end_sec"),
        F.col("r.text").alias("text"),
    )
    ordered = F.coalesce((F.col("start_sec") >= 0) & (F.col("start_sec") <= F.col("end_sec")), F.lit(False))
    again = F.count(F.lit(1)).over(W.Window.partitionBy("segment_id")) > 1
    return _checked(
        rows,
        [
            F.when(F.coalesce("video_id", F.lit("")) == "", "no video_id"),
            F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text"),
            F.when(~ordered, "invalid times"),
            F.when(again, "repeated segment_id"),
        ],
    )


def metadata_text(value: Column) -> Column:
    """A metadata value as text: lists joined by spaces without blanks, others trimmed; null where nothing is left."""
    joined = F.array_join(F.filter(F.transform(F.from_json(value, "array<string>"), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), " ")
    text = F.when(value.startswith("["), joined).otherwise(F.trim(value))
    return F.when(text != "", text)


def metadata_artifacts(lines: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Rows (path, line, video_id, fields, problem) of JSON lines {video_id, fields: {...}}.

    ``fields`` keeps the allowed ones that hold text. ``problem`` tells a line that is no
    JSON object, one without a video_id or without an object of fields, and a repeated
    video_id; it is null for valid lines, of which those without any allowed field give no
    row. No allowed field, or one that no line has, is an error.
    """
    names = sorted({f.strip() for f in allowed if f.strip()})
    if not names:
        raise schemas.ContractError("metadata needs the names of its fields")
    raw = F.from_json("value", "map<string,string>").alias("m")
    rows = lines.select("path", "line", raw, F.json_object_keys("value").isNotNull().alias("is_object"))
    given = F.try_element_at("m", F.lit("fields"))
    inner = F.from_json(given, "map<string,string>")
    fields = F.map_filter(F.transform_values(F.map_filter(inner, lambda k, v: k.isin(names)), lambda k, v: metadata_text(v)), lambda k, v: v.isNotNull())
    rows = rows.select("path", "line", "is_object", F.trim(F.try_element_at("m", F.lit("video_id"))).alias("video_id"), F.json_object_keys(given).isNotNull().alias("has_fields"), fields.alias("fields"))
    again = F.row_number().over(W.Window.partitionBy("video_id").orderBy("path", "line")) > 1
    checked = _checked(
        rows,
        [
            F.when(~F.coalesce("is_object", F.lit(False)), "no JSON object"),
            F.when(F.coalesce("video_id", F.lit("")) == "", "no video_id"),
            F.when(again, "repeated video_id"),
            F.when(~F.coalesce("has_fields", F.lit(False)), "fields are no object"),
        ],
    ).drop("is_object", "has_fields")
    present = {r[0] for r in checked.where("problem is null").select(F.explode(F.map_keys("fields"))).distinct().collect()}  # at most the allowed names
    absent = [f for f in names if f not in present]
    if absent:
        raise schemas.ContractError(f"metadata lacks the fields {', '.join(absent)}")
    return checked.where(F.col("problem").isNotNull() | (F.size("fields") > 0))


# --- mappings -------------------------------------------------------------------------

# Names under which mapping files give video, keyframe index and frame, in
# order of precedence, and those under which JSON files nest their rows.
VIDEO_NAMES = ("video_id", "video", "video_name", "videoid")
INDEX_NAMES = ("keyframe_index", "keyframe_id", "keyframe", "index", "image_index")
FRAME_NAMES = ("original_frame_id", "frame_id", "frame_index", "frame_idx", "frame")
NESTED_NAMES = ("keyframes", "mappings", "data", "items", "frames")


def _first(fields: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_element_at(fields, F.lit(n)) for n in names])


def _mapping_rows(rows: DataFrame) -> DataFrame:
    """Typed mapping rows of (path, line, fields map with lower-case keys); what cannot be typed has a ``problem``.

    The video is the id its value holds, else the value itself, in upper case.
    """
    given = _first(F.col("fields"), VIDEO_NAMES)
    video = F.upper(F.coalesce(infer_video_id(given), F.trim(given)))
    index, frame = safe_int(_first(F.col("fields"), INDEX_NAMES)), safe_int(_first(F.col("fields"), FRAME_NAMES))
    out = rows.select(F.when(video != "", video).alias("video_id"), index.alias("keyframe_index"), frame.alias("original_frame_id"), F.col("path").alias("source_path"), "line")
    return out.withColumn("problem", F.when(F.col("video_id").isNull() | F.col("keyframe_index").isNull() | F.col("original_frame_id").isNull(), "malformed"))


def _csv_rows(text: str):
    """(row, fields) of a CSV file with a header, quotes and line breaks within them; rows count from 2."""
    reader = csv.DictReader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
    for n, row in enumerate(reader, start=2):
        yield n, {k.casefold(): v for k, v in row.items() if isinstance(k, str) and isinstance(v, str)}


def _json_rows(value, path: str):
    """The mapping rows of a JSON value, as field dictionaries, or None if it holds none.

    A list of rows, a row, an object that nests such under one of NESTED_NAMES, or, in a
    file named by its video, an object of indices and frames. Nesting may be of any depth.
    """
    stack = [value]
    while stack:
        here = stack.pop()
        if isinstance(here, list):
            rows = [row for row in map(_json_row, here) if row is not None]
            if rows:
                return rows
        elif isinstance(here, dict):
            row = _json_row(here)
            if row is not None:
                return [row]
            inner = [here[n] for n in NESTED_NAMES if n in here]
            if not inner:
                video = re.search(r"(?i)L\d+_V\d+", os.path.splitext(os.path.basename(path))[0])
                whole = [_whole(x) is not None for pair in here.items() for x in pair]
                if video and here and all(whole):
                    return [{"video_id": video[0], "keyframe_index": str(k), "original_frame_id": str(v)} for k, v in here.items()]
            stack += reversed(inner)
    return None


def _whole(value) -> int | None:
    if isinstance(value, bool):
        return None
    try:
        return int(str(value))
    except ValueError:
        return None


def _json_row(value) -> dict[str, str] | None:
    """An object that names a video, an index and a frame which are whole numbers."""
    if not isinstance(value, dict):
        return None
    folded = {str(k).casefold(): v for k, v in value.items()}
    first = [next((folded[n] for n in names if n in folded), None) for names in (VIDEO_NAMES, INDEX_NAMES, FRAME_NAMES)]
    if None in first or not str(first[0]).strip() or _whole(first[1]) is None or _whole(first[2]) is None:
        return None
    return {"video_id": str(first[0]), "keyframe_index": str(_whole(first[1])), "original_frame_id": str(_whole(first[2]))}


def mapping_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (video_id, keyframe_index, original_frame_id, source_path, line, problem) of all files below ``path``.

    CSV files have a header each. JSON and JSON-lines files hold lists of rows, nested ones,
    or one object of indices and frames; see _json_rows(). A row that lacks a name or a
    whole number is ``malformed``, and so is a file that cannot be parsed (with what is
    wrong); a JSON file without mappings, or any other kind of file, is ``unsupported``.
    Formats differ by file and JSON may nest at will, so files are parsed one by one in
    Arrow batches; a file is a unit of work.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                kind = os.path.splitext(p)[1].lower()
                try:
                    if kind == ".csv":
                        rows += [(p, n, f, None) for n, f in _csv_rows(content.decode("utf-8"))]
                    elif kind in (".json", ".jsonl"):
                        text = content.decode("utf-8")
                        value = [json.loads(x) for x in text.splitlines() if x] if kind == ".jsonl" else json.loads(text)
                        inside = _json_rows(value, p)
                        rows += [(p, None, f, None) for f in inside] if inside else [(p, None, None, "unsupported")]
                    else:
                        rows.append((p, None, None, "unsupported"))
                except (ValueError, csv.Error, RecursionError) as error:
                    rows.append((p, None, None, f"malformed: {error}"))
            yield pd.DataFrame(rows, columns=["path", "line", "fields", "failed"]).astype({"line": "Int64"})

    parsed = found.mapInPandas(parse, "path string, line bigint, fields map<string,string>, failed string")
    good = _mapping_rows(parsed.where("failed is null"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    bad = parsed.where("failed is not null").select(none("string", "video_id"), none("bigint", "keyframe_index"), none("bigint", "original_frame_id"), F.col("path").alias("source_path"), "line", F.col("failed").alias("problem"))
    return good.unionByName(bad)


# --- ground truth, submissions, experiments, manifests ---------------------------------


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth of a JSON file {schema_version: "1.0", queries: [...]}; another version is an error."""
    schema = "schema_version string, queries array<struct<query_id:string,task:string,video_id:string,frame_windows:array<struct<start:bigint,end:bigint>>,answer:string>>"
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("f"))
    version = F.when(F.col("f.schema_version") == "1.0", F.col("f.queries")).otherwise(F.raise_error(F.lit("unsupported schema_version")).cast("array<struct<query_id:string,task:string,video_id:string,frame_windows:array<struct<start:bigint,end:bigint>>,answer:string>>"))
    return files.select(F.explode(version).alias("q")).select("q.*")


def _list_of(spark: SparkSession, path: str, of: str) -> DataFrame:
    """Rows (q): the members of the list ``of`` of a versioned JSON file, as they are written.

    The file is read in pieces that end at a brace, put in order and cut into members as a
    stream, so no row and no task holds the file; the members are dealt out to all tasks.
    """
    at = F.col("_metadata")
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select("value", at["file_path"].alias("file"), at["file_block_start"].alias("block"), at["file_size"].alias("size"), F.octet_length("value").alias("bytes"), F.monotonically_increasing_id().alias("n"))
    # One task a file: where a string or a member ends depends on all that stands before it.
    ordered = pieces.repartition(parallelism(pieces), "file").sortWithinPartitions("file", "block", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks(first: pa.RecordBatch, file: str, left: list[pa.RecordBatch]) -> Iterator[str]:
            batch, seen = first, 0
            while batch is not None:
                # A batch is cut where the next file begins.
                own = pc.sum(pc.equal(batch.column("file"), file)).as_py()
                here, rest = batch.slice(0, own), batch.slice(own)
                seen += pc.sum(here.column("bytes")).as_py() + own if own else 0
                if own:
                    # The brace after the last piece is there only if the file ends with one.
                    cut = max(0, seen - here.column("size")[0].as_py())
                    text = "}".join(here.column("value").to_pylist()) + "}"
                    yield text[:-cut] if cut else text
                if rest.num_rows:
                    left.append(rest)
                    return
                batch = next(batches, None)

        left: list[pa.RecordBatch] = []
        first = next(batches, None)
        while first is not None:
            if first.num_rows:
                rows: list[str] = []
                held = 0
                for q in members(chunks(first, first.column("file")[0].as_py(), left), of, {"schema_version": "1.0"}):
                    rows.append(q)
                    held += len(q)
                    if held > 1_000_000:
                        yield pa.RecordBatch.from_pydict({"q": pa.array(rows, pa.string())})
                        rows, held = [], 0
                yield pa.RecordBatch.from_pydict({"q": pa.array(rows, pa.string())})
            first = left.pop() if left else next(batches, None)

    found = ordered.mapInArrow(run, "q string")
    return found.repartition(parallelism(found), "q")


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """A submission file as rows (query_id, task, rank, video_id, frame_ids, answer); unknown fields are an error, and so is a file that is cut short."""
    queries = _list_of(spark, path, "queries")
    fail = lambda text: F.raise_error(F.lit(text)).cast("string")
    exact = F.array_sort(F.json_object_keys("q")) == F.array(F.lit("query_id"), F.lit("results"), F.lit("task"))
    checked = queries.select(F.when(~exact, fail("a query has unknown or missing fields")).otherwise(F.col("q")).alias("q"))
    parsed = checked.select(F.from_json("q", "query_id string, task string, results array<string>").alias("q"))
    rows = parsed.select("q.query_id", "q.task", F.posexplode("q.results").alias("pos", "r"))
    wanted = F.when(F.col("task") == "kis", F.array(F.lit("frame_id"), F.lit("video_id"))).when(F.col("task") == "qna", F.array(F.lit("answer"), F.lit("frame_id"), F.lit("video_id"))).otherwise(F.array(F.lit("frame_ids"), F.lit("video_id")))
    rows = rows.withColumn("r", F.when(F.array_sort(F.json_object_keys("r")) == wanted, F.col("r")).otherwise(fail("a result has unknown or missing fields")))
    one = F.from_json("r", "video_id string, frame_id bigint, frame_ids array<bigint>, answer string")
    rows = rows.withColumn("x", one)
    return rows.select("query_id", "task", (F.col("pos") + 1).alias("rank"), F.trim("x.video_id").alias("video_id"), F.coalesce("x.frame_ids", F.array("x.frame_id")).alias("frame_ids"), F.trim("x.answer").alias("answer"))


def latest_by_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the one that is last by ``order``."""
    place = F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def read_archive_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The archive manifest of a JSON-lines file; of equal (filename, download_url) the last line counts."""
    rows = read_jsonl(spark, path).select("line", F.from_json("value", schemas.ARCHIVE).alias("r")).select("line", "r.*")
    return latest_by_key(rows, ["filename", "download_url"], "line").drop("line")


def load_config(path: str) -> dict:
    """A configuration file as a dictionary: JSON, or YAML where a YAML library is installed."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if os.path.splitext(path)[1].lower() in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML files need a YAML library; JSON files do not") from error
        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise schemas.ContractError("a configuration must be an object")
    return value
