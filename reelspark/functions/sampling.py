"""Frame numbers around an anchor frame; all rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_window(center: Column, fps: Column, seconds: float, frame_count: Column) -> Column:
    """struct(first, center, last), null where the centre or fps is invalid or out of bounds.

    An unknown frame count (null) leaves the end open.
    """
    radius = F.rint(F.lit(float(seconds)) * fps).cast("bigint")
    last = F.when(frame_count.isNull(), center + radius).otherwise(F.least(frame_count - 1, center + radius))
    good = (center >= 0) & (fps > 0) & (fps < float("inf")) & F.coalesce((frame_count >= 1) & (center < frame_count), F.lit(True))
    return F.when(good, F.struct(F.greatest(F.lit(0).cast("bigint"), center - radius).alias("first"), center.alias("center"), last.alias("last")))


def sparse_ids(window: Column, fps: Column, sample_fps: float) -> Column:
    """Every so-many-th frame of the window with its ends and centre, sorted and distinct."""
    stride = F.greatest(F.lit(1).cast("bigint"), F.rint(fps / F.lit(float(sample_fps))).cast("bigint"))
    marks = F.array(window["first"], window["center"], window["last"])
    return F.when(window.isNotNull(), F.array_sort(F.array_distinct(F.concat(F.sequence(window["first"], window["last"], stride), marks))))


def dense_ids(window: Column) -> Column:
    """Every frame of the window."""
    return F.when(window.isNotNull(), F.sequence(window["first"], window["last"]))


def dense_count(window: Column) -> Column:
    """How many frames that are."""
    return F.when(window.isNotNull(), (window["last"] - window["first"] + 1).cast("int"))


def dense_blocks(window: Column, size: int = 4096) -> Column:
    """The window cut into windows of at most ``size`` frames: a high frame rate makes no long list in a row."""
    starts = F.sequence(window["first"], window["last"], F.lit(size).cast("bigint"))
    block = lambda a: F.struct(a.alias("first"), F.least(window["last"], a + (size - 1)).alias("last"))
    return F.when(window.isNotNull(), F.transform(starts, block))


def even_ids(window: Column, n: int) -> Column:
    """``n`` evenly spaced frames, the closest to the centre moved onto it; all frames if there are no more."""
    # Of the other frames the first few fill up: no more than these can be needed.
    all_ids = F.sequence(window["first"], F.least(window["last"], window["first"] + (2 * n - 1)))
    span = (window["last"] - window["first"]).cast("double")
    if n == 1:
        few = F.array(window["center"])
    else:
        spaced = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(window["first"] + i * span / F.lit(n - 1)).cast("bigint"))
        closest = F.array_min(F.transform(spaced, lambda x, i: F.struct(F.abs(x - window["center"]).alias("d"), i.alias("i"))))["i"]
        moved = F.array_distinct(F.transform(spaced, lambda x, i: F.when(i == closest, window["center"]).otherwise(x)))
        filling = F.slice(F.array_except(all_ids, moved), F.lit(1), F.greatest(F.lit(0), F.lit(n) - F.size(moved)))
        few = F.array_sort(F.concat(moved, filling))
    return F.when(window.isNotNull(), F.when(F.size(all_ids) <= n, all_ids).otherwise(few))
