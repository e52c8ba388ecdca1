"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Default place of the ranks; a parameter everywhere.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges of these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN):
    """The tokenizer of a rank file; loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, path: str = RANKS) -> DataFrame:
    """``texts`` with ``text`` replaced by ``tokens``, its size in tokens (0 for null and empty texts)."""
    from pyspark.sql import types as T

    names = [c for c in texts.columns if c != "text"]
    schema = T.StructType([*[texts.schema[c] for c in names], T.StructField("tokens", T.LongType())])

    def run(batches):
        enc = encoding(path)
        for b in batches:
            size = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size, pa.int64())], names=[*names, "tokens"])

    return texts.select(*names, "text").mapInArrow(run, schema)
