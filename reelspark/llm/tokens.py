"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary file; any of the three file kinds below. The file itself is never copied here.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the usual pre-tokenization pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file above this size is refused: it goes to every Python worker.
MAX_VOCABULARY_BYTES = 64 * 2**20

_loaded: dict = {}


def _load(name: str, content: bytes):
    """A function list[str] -> list[int] of token counts; loaded once per Python worker."""
    key = (name, len(content))
    if key not in _loaded:
        if name.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
            coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[key] = lambda texts: [len(coder.encode_ordinary(t)) for t in texts]
        elif name.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_buffer(content)
            tok.encode_special_tokens = True
            _loaded[key] = lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            _loaded[key] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    return _loaded[key]


def with_token_counts(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, out: str = "tokens") -> DataFrame:
    """``df`` without its text and with ``out`` (bigint): the tokens of each whole text.

    Null and empty texts have 0 tokens; strings that look like special tokens are ordinary
    text. The vocabulary is read on the driver and sent to the workers; its size is checked.
    """
    size = os.path.getsize(tokenizer)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer} has {size} bytes, more than {MAX_VOCABULARY_BYTES}")
    name = os.path.basename(tokenizer)
    with open(tokenizer, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())
    kept = [c for c in df.columns if c != text]
    rows = df.select(*kept, F.col(text).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _load(name, content.value)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("__text").to_pylist()]
            counts = pa.array(counter(texts), pa.int64())
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, counts], names=[*kept, out])

    schema = T.StructType([*rows.drop("__text").schema.fields, T.StructField(out, T.LongType())])
    return rows.mapInArrow(count, schema)
