"""Injected models as DataFrame steps: loaded once per Python worker, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VECTOR = T.ArrayType(T.FloatType())


def _checked(vectors, n: int) -> np.ndarray:
    out = np.asarray(vectors, np.float32)
    if out.ndim != 2 or len(out) != n or not np.isfinite(out).all():
        raise ValueError("an encoder must give one finite vector per input")
    length = np.linalg.norm(out, axis=1, keepdims=True)
    if (length == 0).any():
        raise ValueError("an encoder gave a vector of length 0")
    return out / length


def _encode(df: DataFrame, column: str, load: Callable[[], Callable[[list], Sequence]], out: str, batch_size: int) -> DataFrame:
    kept = [c for c in df.columns if c != column]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, _VECTOR)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            values = list(pdf[column])
            vectors: list = []
            for s in range(0, len(values), batch_size):
                part = values[s : s + batch_size]
                vectors += list(_checked(model(part), len(part)))
            yield pdf[kept].assign(**{out: vectors})

    return df.select(*kept, column).mapInPandas(run, schema)


def encode_texts(df: DataFrame, load: Callable[[], Callable[[list[str]], Sequence]], text: str = "text", out: str = "vector", batch_size: int = 256) -> DataFrame:
    """``df`` with the unit vector of each text in place of it; ``load`` makes the encoder in the worker."""
    return _encode(df.where(F.trim(text) != ""), text, load, out, batch_size)


def encode_images(df: DataFrame, load: Callable[[], Callable[[list[bytes]], Sequence]], image: str = "image", out: str = "vector", batch_size: int = 8) -> DataFrame:
    """The same for images as bytes; rows without an image are dropped."""
    return _encode(df.where(F.col(image).isNotNull()), image, load, out, batch_size)


def answer(df: DataFrame, load: Callable[[], Callable[[list, str, str], str]], images: str = "images") -> DataFrame:
    """Rows with ``raw_answer`` or ``error``: a visual answerer over (images, event_text, question), a failure per row."""
    kept = [c for c in df.columns if c != images]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("raw_answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            texts, errors = [], []
            for pictures, event, question in zip(pdf[images], pdf["event_text"], pdf["question"]):
                try:
                    texts.append(str(model(list(pictures), event, question)))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - a failed answer is a row
                    texts.append(None)
                    errors.append(str(error))
            yield pdf[kept].assign(raw_answer=texts, error=errors)

    return df.select(*kept, images).mapInPandas(run, schema)


def score_images(frames: DataFrame, queries: DataFrame, source: str) -> DataFrame:
    """Rows (query_id, video_id, frame_id, source, score) of encoded frames (query_id, video_id, frame_id, vector) against (query_id, vector)."""
    from reelspark.functions.vector import dot

    rows = frames.join(queries.select("query_id", F.col("vector").alias("__q")), "query_id")
    return rows.select("query_id", "video_id", "frame_id", F.lit(source).alias("source"), dot(F.col("vector"), F.col("__q")).alias("score"))
