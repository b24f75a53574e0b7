"""Canonical short answers and their comparison."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of short answers and what they stand for, in English and Vietnamese
# with and without diacritics. Yes and no are looked up before numbers.
YES = ("yes", "yeah", "yep", "true", "correct", "có", "co", "đúng", "dung", "phải", "phai")
NO = ("no", "nope", "false", "không", "khong", "ko", "không phải", "khong phai")
NUMBERS = {
    "0": ("zero", "không", "khong"),
    "1": ("one", "một", "mot"),
    "2": ("two", "hai"),
    "3": ("three", "ba"),
    "4": ("four", "bốn", "bon"),
    "5": ("five", "năm", "nam"),
    "6": ("six", "sáu", "sau"),
    "7": ("seven", "bảy", "bay"),
    "8": ("eight", "tám", "tam"),
    "9": ("nine", "chín", "chin"),
    "10": ("ten", "mười", "muoi"),
}
COUNTED = ("person", "people", "persons", "player", "players", "người", "nguoi", "người chơi", "nguoi choi")
COLORS = {
    "red": ("red", "dark red", "light red", "đỏ", "do", "màu đỏ", "mau do"),
    "blue": ("blue", "light blue", "dark blue", "xanh dương", "xanh duong", "màu xanh dương", "mau xanh duong"),
    "green": ("green", "light green", "dark green", "xanh lá", "xanh la", "màu xanh lá", "mau xanh la"),
    "yellow": ("yellow", "vàng", "vang", "màu vàng", "mau vang"),
    "black": ("black", "đen", "den"),
    "white": ("white", "trắng", "trang"),
    "gray": ("gray", "grey", "xám", "xam"),
    "brown": ("brown", "nâu", "nau"),
    "orange": ("orange", "cam"),
    "purple": ("purple", "tím", "tim"),
    "pink": ("pink", "hồng", "hong"),
}
COLOR_LEAD = r"^(?:(?:the )?colou?r(?: is)?|màu(?: sắc)?(?: là)?|mau(?: sac)?(?: la)?|it is|it's|nó là|no la)\s+"
#: What is cut off both ends of an answer.
EDGES = r"""[ \t\n\r.,;:!?\\"'`()\[\]{}<>]+"""


def _lookup(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[F.lit(x) for value, words in table.items() for word in words for x in (word, value)])


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC and full case folding, which Spark has no expression for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def normalize_folded(folded: Column) -> Column:
    """The canonical form of an answer that is already NFKC and case-folded; blank gives null.

    Yes and no, then a number (alone or before a counted noun), then a colour, also behind
    a lead such as "it is"; anything else stays as it is, trimmed and with single spaces.
    """
    edged = F.regexp_replace(folded, f"^{EDGES}|{EDGES}$", "")
    value = F.trim(F.regexp_replace(edged, r"(?U)\s+", " "))
    first, rest = F.substring_index(value, " ", 1), F.expr("1")
    rest = F.when(F.instr(value, " ") > 0, F.regexp_replace(value, r"^\S+ ", ""))
    number = F.when(first.rlike(r"^[0-9]+$"), F.coalesce(F.nullif(F.regexp_replace(first, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(
        F.try_element_at(_lookup(NUMBERS), first)
    )
    count = F.when(rest.isNull() | rest.isin(*COUNTED), number)
    color = _lookup(COLORS)
    return F.when(value == "", None).otherwise(
        F.when(value.isin(*YES), "yes")
        .when(value.isin(*NO), "no")
        .otherwise(F.coalesce(count, F.try_element_at(color, value), F.try_element_at(color, F.regexp_replace(value, COLOR_LEAD, "")), value))
    )


def normalize_answer(answer: Column) -> Column:
    """The canonical form of a raw answer; null where it is null or blank."""
    return normalize_folded(compatible(answer))


def same_answer(left: Column, right: Column) -> Column:
    """Whether two normalized answers agree; an answer that could not be normalized never does."""
    return F.coalesce(left == right, F.lit(False))
