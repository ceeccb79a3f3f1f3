"""Token ids of texts: by a public byte-pair vocabulary file, or byte by byte where none is given."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of byte-level ids: padding, end of text and unknown come before the 256 bytes.
BYTE_OFFSET, END = 3, 1
#: Fixed value: how byte-pair vocabularies of this kind cut a text before merging.
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids by a file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_ids(text: Column, width: int | None = None) -> Column:
    """UTF-8 bytes plus an offset, and the end; stays inside generated code. Null counts as empty."""
    code = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    n = F.length(code) / 2
    body = F.transform(F.filter(F.sequence(F.lit(0), n.cast("int")), lambda k: k < n), lambda k: F.conv(F.substr(code, k * 2 + 1, F.lit(2)), 16, 10).cast("int") + BYTE_OFFSET)
    out = F.concat(body, F.array(F.lit(END)))
    return out if width is None else F.slice(out, 1, width)


def token_ids(text: Column, path: str | None = None, width: int | None = None) -> Column:
    """Ids by the vocabulary at ``path`` in Arrow batches, cut to width; byte ids where path is null."""
    if path is None:
        return byte_ids(text, width)

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        encode = encoder(path)
        return s.map(lambda x: encode(x or "")[:width])

    return run(text)
