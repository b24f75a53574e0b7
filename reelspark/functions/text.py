"""Text expressions: tokens, identifiers in paths, metadata documents, safe parsing."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of the folded text; null gives no tokens."""
    folded = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}_]+"), 0)


def _or_null(value: Column) -> Column:
    return F.when(value != "", value)


def infer_video_id(path: Column) -> Column:
    """The first ``L<digits>_V<digits>`` of a path in upper case, else null."""
    return _or_null(F.upper(F.regexp_extract(path, r"(?i)L\d+_V\d+", 0)))


def infer_group_id(text: Column) -> Column:
    """The first ``L<digits>`` in upper case, else null."""
    return _or_null(F.upper(F.regexp_extract(text, r"(?i)L\d+", 0)))


def infer_index(stem: Column) -> Column:
    """The last run of digits as a number, else null."""
    return F.regexp_extract(stem, r"(\d+)(?!.*\d)", 1).try_cast("bigint")


def keyframe_uid(video_id: Column, index: Column) -> Column:
    """``video:000000``; an index of more than six digits keeps them all."""
    digits = index.cast("string")
    return F.concat_ws(":", video_id, F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))


def first_key(fields: Column, names: list[str]) -> Column:
    """The value of the first of ``names`` that a map holds, whatever its letter case."""
    folded = F.map_from_entries(F.transform(F.map_entries(fields), lambda e: F.struct(F.lower(F.trim(e["key"])), e["value"])))
    return F.coalesce(*[F.try_element_at(folded, F.lit(n.lower())) for n in names])


def metadata_document(fields: Column) -> Column:
    """``key: value`` pairs joined in key order, without empty values."""
    entries = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: v.isNotNull() & (F.trim(v) != ""))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.trim(e["value"]))), " ")


# Fixed value: how an event and its context are put to an encoder; events count from 1.
RETRIEVAL_FORM = "Focus event %d: %s\nSequence context: %s"


def retrieval_text(index: Column, text: Column, context: Column) -> Column:
    """What an ordered event (index from 0) is searched by: its own text and the list it stands in."""
    return F.format_string(RETRIEVAL_FORM, index + 1, text, context)


def parse_fraction(text: Column) -> Column:
    """``30000/1001`` or a plain number as double; null where it is neither or divides by 0."""
    parts = F.split(F.trim(text), "/")
    whole, below = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) == 1, whole).when(F.size(parts) == 2, F.try_divide(whole, below))


def safe_int(text: Column) -> Column:
    """A whole number, or null; ``true`` and fractions are none."""
    return F.trim(text.cast("string")).try_cast("bigint")


def safe_float(text: Column) -> Column:
    """A finite number, or null."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def artifact_id(text: Column) -> Column:
    """The short stable name of a result: the first 16 hexadecimal digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def safe_member_path(path: Column) -> Column:
    """True for archive members that stay inside the folder they are extracted to."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~clean.startswith("/") & ~clean.rlike(r"^[A-Za-z]:") & ~F.array_contains(F.split(clean, "/"), "..") & (F.trim(clean) != "")


def flatten_bbox(text: Column) -> Column:
    """A bounding box in JSON, nested at will, as doubles; null unless it has 4 or more, evenly many finite numbers."""
    inner = F.regexp_replace(text, r"[\[\]\s]+", "")
    numbers = F.transform(F.split(inner, ","), lambda x: x.try_cast("double"))
    good = text.startswith("[") & (F.size(numbers) >= 4) & (F.size(numbers) % 2 == 0)
    return F.when(good & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), numbers)


# Fixed value: how a visual answerer is asked.
ANSWER_FORM = (
    "Answer the question using only the chronologically ordered video frames. Return one short answer only, without explanation.\n"
    "Event description: %s\nQuestion: %s"
)


def answer_prompt(event: Column, question: Column) -> Column:
    """What an answerer is asked about an event; a blank event or question is an error when the plan runs."""
    blank = (F.coalesce(F.trim(event), F.lit("")) == "") | (F.coalesce(F.trim(question), F.lit("")) == "")
    return F.when(blank, F.raise_error(F.lit("an event and a question are needed")).cast("string")).otherwise(F.format_string(ANSWER_FORM, F.trim(event), F.trim(question)))


def config_hash(value: object) -> str:
    """The SHA-256 of a configuration as JSON with sorted keys and no spaces: equal settings, equal hash."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode("utf-8")).hexdigest()
