"""Vocabulary files of public byte-level BPE tokenizers, read on the driver and sent to the workers.

The path is a parameter; the file is never copied into the repository. Tokenizers are never trained.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark import Broadcast
from pyspark.sql import SparkSession

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def send(spark: SparkSession, path: str = DEFAULT_PATH) -> Broadcast:
    """Broadcast the file's bytes (under 1 MB, of fixed size)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=4)
def ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to id; one id is one merge rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


@lru_cache(maxsize=4)
def encoding(raw: bytes):
    """A tiktoken encoder without special tokens, made once in each worker."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(raw), special_tokens={})


@lru_cache(maxsize=4)
def token_lengths(raw: bytes):
    """Bytes of each token by id, as a NumPy array."""
    import numpy as np

    table = ranks(raw)
    out = np.zeros(max(table.values()) + 1, np.int32)
    for token, rank in table.items():
        out[rank] = len(token)
    return out


def utf8_safe(text: str) -> str:
    """Lone surrogates can't be encoded; they become U+FFFD. Other texts are returned as they are."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text
