"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary file is by default; every operator takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabulary cuts text into words before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_made: dict[bytes, object] = {}


def encoding(data: bytes, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file's bytes, made once per worker."""
    import tiktoken

    key = hashlib.sha256(data + pattern.encode()).digest()
    if key not in _made:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _made[key] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _made[key]


def with_token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The kept columns and `n_tokens` (bigint) of each row; null and empty texts have 0. The vocabulary (a file of
    fixed size) goes to the executors once."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    types = dict(docs.dtypes)
    names = [f"c{i}" for i in range(len(keep))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(shared.value, pattern)
        for batch in batches:
            sizes = [len(coder.encode_ordinary(x)) if x else 0 for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sizes, pa.int64())], names=[*names, "n_tokens"])

    schema = "".join(f"{n} {types[c]}, " for n, c in zip(names, keep, strict=True)) + "n_tokens bigint"
    counted = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], F.col(f"`{text_col}`").alias("text")).mapInArrow(count, schema)
    return counted.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_tokens")
