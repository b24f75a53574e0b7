"""Splitting a query that lists ordered events into one row per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.text import retrieval_text

_SPACE = r"(?U)\s+"


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def _item(text: Column) -> Column:
    return F.regexp_replace(_tidy(text), r"^[ ,.;]+|[ ,.;]+$", "")


def _parenthesised(query: Column) -> Column:
    """Items of "(1) ... (2) ...": consecutive from 1, at the start or behind a colon or dash."""
    numbers = F.transform(F.regexp_extract_all(query, F.lit(r"(?<![\p{L}\p{N}_])\((\d+)\)"), 1), lambda n: n.try_cast("bigint"))
    pieces = F.split(query, r"(?<![\p{L}\p{N}_])\(\d+\)\s*")
    items = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), _item)
    lead = F.rtrim(F.regexp_replace(F.element_at(pieces, 1), r"(?U)\s+$", ""))
    # A number too long for 64 bits is null, and then nothing is counted.
    counted = F.coalesce(numbers == F.sequence(F.lit(1).cast("bigint"), F.size(numbers).cast("bigint")), F.lit(False))
    good = (F.size(numbers) >= 2) & counted & ((lead == "") | lead.rlike("[:–—-]$")) & F.forall(items, lambda x: x != "")
    return F.when(good, items)


def _listed(query: Column) -> Column:
    """Items of numbered or bulleted lines."""
    lines = F.split(query, r"\r\n|[\n\r\u000b\u000c\u0085  ]")
    marked = F.filter(lines, lambda x: x.rlike(r"^(?U)\s*(?:\d+[.)]|[-*•])\s+\S"))
    return F.transform(marked, lambda x: _item(F.regexp_replace(x, r"^(?U)\s*(?:\d+[.)]|[-*•])\s+", "")))


def _split_by(text: Column, pattern: str) -> Column:
    items = F.transform(F.split(text, pattern), _item)
    return F.when((F.size(items) >= 2) & F.forall(items, lambda x: x != ""), items)


def event_parts(query: Column) -> Column:
    """The events of a query in order: a numbered list in brackets, list lines, arrows, semicolons, or the whole.

    Null or blank gives null.
    """
    context = _tidy(query)
    lines = _listed(query)
    parts = F.coalesce(
        _parenthesised(query), F.when(F.size(lines) >= 2, lines), _split_by(context, r"\s*(?:→|->|=>)\s*"), _split_by(context, ";"), F.array(context)
    )
    return F.when(context != "", parts)


def decompose_events(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """Rows (query_id, event_index, text, context, retrieval_text), indices from 0."""
    context = _tidy(F.col(text))
    rows = queries.select(F.col(query_id).alias("query_id"), context.alias("context"), F.posexplode(event_parts(F.col(text))).alias("event_index", "text"))
    return rows.select("query_id", "event_index", "text", "context", retrieval_text(F.col("event_index"), F.col("text"), F.col("context")).alias("retrieval_text"))
