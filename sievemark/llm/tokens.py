"""Token counts under a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = os.environ.get("SIEVEMARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file; loaded once per worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(df: DataFrame, text: str, path: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """Replaces the text column by its number of tokens (0 for null and empty texts).

    Whole texts are counted, one after the other: beside the batch only one text's tokens are held. The rank
    file must be at ``path`` on every worker (ship it with SparkContext.addFile where it isn't).
    """
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = np.fromiter((len(enc.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in b.column(text)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n)], names=[*keep, name])

    return df.select(*keep, text).mapInArrow(count, schema)


def token_slice(text: str, ranges: list[tuple[int, int]], path: str = VOCABULARY) -> list[str]:
    """The text of each range of tokens. A cut inside a character moves to its first byte, so
    that neighbouring slices join to the whole text."""
    enc = encoding(path)
    parts = enc.decode_tokens_bytes(enc.encode_ordinary(text))
    data = b"".join(parts)
    ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)

    def place(k: int) -> int:
        i = int(ends[min(k, len(ends) - 1)])
        while 0 < i < len(data) and data[i] & 0xC0 == 0x80:
            i -= 1
        return i

    return [data[place(a) : place(b)].decode() for a, b in ranges]
