"""Document fingerprints by winnowing.

White space is dropped and case folded; each run of ``gram`` characters has a rolling polynomial hash
modulo 2^31 - 1; of each window of ``window`` consecutive hashes the least is chosen, the rightmost of
equal ones, and kept with its position. Two texts that share a passage of at least gram + window - 1
characters that count share at least one fingerprint inside it. Hashes of all runs are built by doubling
(from halves), and so are the minima of windows: a few vector operations for each character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.textblocks import blocks

#: Any passage of 67 characters that count always leaves a fingerprint of its own.
GRAM, WINDOW = 32, 36
PRIME, BASE = (1 << 31) - 1, 1_000_003
SPACES = (9, 10, 11, 12, 13, 32)
LAST = (1 << 32) - 1
_NONE = np.iinfo(np.int64).max


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    x[x == PRIME] = 0
    return x


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` values, from runs of halves: H(a + b, i) = H(a, i) * BASE^b + H(b, i + a)."""
    whole, length, half, size = None, 0, codes % PRIME, 1
    while True:
        if gram & size:
            if whole is None:
                whole, length = half, size
            else:
                n = len(codes) - length - size + 1
                whole = _mod(whole[: max(n, 0)] * pow(BASE, size, PRIME) + half[length : length + max(n, 0)])
                length += size
        if 2 * size > gram:
            return whole
        n = max(len(half) - size, 0)
        half = _mod(half[:n] * pow(BASE, size, PRIME) + half[size : size + n])
        size *= 2


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """Least of values[i : i + window]; past the end there is nothing."""
    low, size = np.append(values, np.full(window, _NONE)), 1
    while 2 * size <= window:
        low[:-size] = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(values)], low[window - size : window - size + len(values)])


def winnow(codes: np.ndarray, ends: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, hash) of the fingerprints of texts laid end to end; ends: of each text, in code points."""
    starts = np.append(0, ends[:-1])
    place = np.flatnonzero(~np.isin(codes, SPACES))
    doc = np.searchsorted(ends, place, "right")
    last = np.searchsorted(place, ends)  # kept characters up to the end of each text
    hashes = gram_hashes(codes[place].astype(np.int64) + 1, gram) if len(place) >= gram else np.zeros(0, np.int64)
    n = len(hashes)
    at = np.arange(n)
    left = last[doc[:n]] - at  # kept characters from here to the end of the text
    packed = (hashes << 32) | (LAST - (place[:n] - starts[doc[:n]]))
    packed[left < gram] = _NONE
    low = window_minima(packed, window)
    first = np.append(True, doc[1:n] != doc[: n - 1]) if n else np.zeros(0, bool)
    whole = left >= gram + window - 1
    short = first & ~whole & (left >= gram)  # fewer hashes than a window: all of them are one
    for k in np.flatnonzero(short).tolist():
        low[k] = packed[k : k + left[k] - gram + 1].min()
    use = np.flatnonzero(whole | short)
    new = np.append(True, (low[use][1:] != low[use][:-1]) | (doc[use][1:] != doc[use][:-1])) if len(use) else np.zeros(0, bool)
    chosen = low[use[new]]
    return doc[use[new]], LAST - (chosen & LAST), chosen >> 32


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, position, hash``: the chosen hashes of each row of docs, position in characters of the text from 0.

    Texts with fewer than ``gram`` characters that count, empty and null ones have no rows; a text with
    fewer hashes than a window is one window. Rows with null or repeated ids each give their own rows.
    Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(1), lower=True):
                codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                doc, position, hashes = winnow(codes, chars[offsets[1:]], gram, window)
                ids = batch.column(0).slice(first, last - first).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(position.astype(np.int32)), pa.array(hashes)], names=["doc_id", "position", "hash"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, position int, hash long")


def sql(gram: int = GRAM, window: int = WINDOW) -> str:
    """The same for DuckDB over documents with distinct ids; gram: a power of 2."""
    steps, size, last = [], 1, "kept"
    while size < gram:
        steps.append(f"h{2 * size} AS (SELECT doc_id, pos, i, (h * {pow(BASE, size, PRIME)} + lead(h, {size}) OVER (PARTITION BY doc_id ORDER BY i)) % {PRIME} AS h FROM {last})")
        size, last = 2 * size, f"h{2 * size}"
    spaces = ", ".join(f"chr({c})" for c in SPACES)
    return f"""
WITH chars AS (SELECT doc_id, string_split(lower(text), '') AS c FROM documents),
spread AS (SELECT doc_id, unnest(c) AS c, unnest(range(len(c))) AS pos FROM chars),
kept AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, (unicode(c) + 1)::BIGINT AS h FROM spread WHERE c NOT IN ({spaces})),
{", ".join(steps)},
grams AS (SELECT doc_id, i, h * 4294967296 + ({LAST} - pos) AS v, count(*) OVER (PARTITION BY doc_id) AS n FROM {last} WHERE h IS NOT NULL),
windows AS (SELECT doc_id, i, n, min(v) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS v FROM grams)
SELECT DISTINCT doc_id, ({LAST} - v % 4294967296)::INTEGER AS position, (v // 4294967296)::BIGINT AS hash FROM windows WHERE i <= greatest(n - {window - 1}, 1)
"""
