"""Arrow batches to flat NumPy arrays of word hashes; shared by the text operators.

A batch of strings is handled as one byte buffer with document offsets, so that there is no Python
loop over documents or words. Batches are cut into blocks of about ``BLOCK_BYTES`` to bound memory;
a document is never cut, so that a block holds one whole document at least.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW = np.ones(1, np.uint64)

#: Bytes that belong to words: letters and all bytes of multi-byte characters (input is lower case).
LETTERS = np.zeros(256, bool)
LETTERS[ord("a") : ord("z") + 1] = True
LETTERS[128:] = True
#: Everything but white space.
VISIBLE = np.ones(256, bool)
VISIBLE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        a = np.full(max(n, 2 * len(_POW)), _BASE, np.uint64)
        a[0] = 1
        _POW = np.multiply.accumulate(a)
    return _POW


def text_array(column: pa.Array | pa.ChunkedArray, lower: bool) -> pa.Array:
    """A column as a large_string array, null as the empty text, in lower case if asked."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def blocks(column: pa.Array, lower: bool, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets from 0) of each block."""
    column = text_array(column, lower)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        at = offsets[first : last + 1]
        yield first, last, data[at[0] : at[-1]], at - at[0]
        first = last


#: Kinds of characters: runs of letters and runs of digits are words, and so is each character of a script without spaces.
BREAK, LETTER, DIGIT, SINGLE = range(4)
#: Han, kana, Thai, Lao, Myanmar, Khmer: written without spaces.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    of = {"L": LETTER, "M": LETTER, "N": DIGIT}
    kinds = np.array([of.get(unicodedata.category(chr(c))[0], BREAK) for c in range(0x110000)], np.uint8)
    for low, high in _UNSPACED:
        part = kinds[low : high + 1]
        part[part == LETTER] = SINGLE
    return kinds


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    kinds = _kinds()
    out = kinds[:256][data]
    if not (data >= 0x80).any():
        return out
    lead = np.flatnonzero(data >= 0xC0)
    more = 1 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int64) & (0x3F >> more)
    for k in range(1, 4):
        long = more >= k
        code[long] = (code[long] << 6) | (data[lead[long] + k] & 0x3F)
    found = kinds[code]
    out[lead] = found
    for k in range(1, 4):
        long = more >= k
        out[lead[long] + k] = found[long]
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of a block, and the number of words before each document (n + 1 values)."""
    inside = table[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[begins] = inside[begins]
    return _run_hashes(data, offsets, inside, start)[:2]


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, of runs of letters, runs of digits and single characters of scripts without spaces.

    The third array says of each word whether it is such a character and the next word follows it directly
    and is one too. Words of plain letters have the hashes of ``word_hashes``.
    """
    kind = byte_kinds(data)
    inside = kind != BREAK
    start = inside.copy()
    start[1:] &= (kind[1:] != kind[:-1]) | ((kind[1:] == SINGLE) & ((data[1:] & 0xC0) != 0x80))
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[begins] = inside[begins]
    words, bounds, at = _run_hashes(data, offsets, inside, start)
    joined = np.zeros(len(at), bool)
    single = kind[at] == SINGLE
    if single.any():
        breaks = np.cumsum(~inside)
        joined[:-1] = single[:-1] & single[1:] & (breaks[at[:-1]] == breaks[at[1:]])
        joined[bounds[1:][bounds[1:] > 0] - 1] = False
    return words, bounds, joined


def _run_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words that begin at ``start``, their bounds by document, and where they begin."""
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), at
    word = np.cumsum(start) - 1
    place = np.arange(len(data)) - at[np.maximum(word, 0)]
    place[~inside] = 0
    value = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    value[~inside] = 0
    return mix64(np.add.reduceat(value, at)), np.searchsorted(at, offsets), at


def ngram_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words inside documents, with bounds as ``word_hashes`` gives them."""
    if n == 1:
        return words, bounds
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    if not out_bounds[-1]:
        return np.zeros(0, np.uint64), out_bounds
    at = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], count)
    h = words[at]
    for k in range(1, n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
    return h, out_bounds


def distinct_per_document(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (value, document) pairs in document order, with bounds and how often each occurs."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(v)))
    return v[at], np.searchsorted(d[at], np.arange(len(bounds))), counts
