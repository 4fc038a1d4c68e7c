"""Token counts of texts under a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this vocabulary cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    """The encoding of the ranks in the file ``path``, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A run of blanks from this length on is cut before the encoder's own expression, which would go back over all of it.
_LONG_BLANK = re.compile(r"\s{2000}")


def count(text: str | None, path: str = VOCABULARY) -> int:
    """The number of tokens of ``text``; special-token strings are ordinary text. Null and empty texts have none."""
    if not text:
        return 0
    encoder = encoding(path)
    if _LONG_BLANK.search(text):
        import regex

        return sum(len(encoder._encode_single_piece(piece)) for piece in regex.findall(PATTERN, text))
    return len(encoder.encode_ordinary(text))


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """count() as a column."""

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([count(t if isinstance(t, str) else None, path) for t in texts], dtype="int32")

    return counted(text)
