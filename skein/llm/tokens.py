"""Sizes of texts in tokens of a public byte-pair vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.workspace import ship

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of this vocabulary (fixed value).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, ranks_path: str = DEFAULT_RANKS) -> Column:
    """Tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(ranks_path).encode_ordinary
        for s in texts:
            yield s.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return counted(text)


def sized(documents: DataFrame, *keep: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``item``, a number of the row."""
    ship(documents.sparkSession)
    return documents.select(
        *keep, token_count(F.col("text"), ranks_path).alias("n_tokens"), F.monotonically_increasing_id().alias("item")
    )
