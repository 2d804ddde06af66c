"""Token counts by offset-mapped attribution.

A whole document is encoded once, so that its counts add up to what a model sees. Each token's span
(byte offsets, from the token lengths) is joined to the sections by binary search in the sorted section
starts, and tokens that cross a boundary are allocated by an explicit rule:

* ``start``: to the section of the token's first byte;
* ``end``: to the section of its last byte;
* ``majority``: to the section with most of its bytes, the earliest of equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import vocabulary
from quillframe.llm.textblocks import blocks

RULES = ("start", "end", "majority")
SCHEMA = "doc_id long, section int, n_tokens int, n_crossing int, n_chars int"
_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int32()) for c in ("section", "n_tokens", "n_crossing", "n_chars"))])


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses a boundary. bounds: the sorted starts of the sections."""
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = first != last
    if rule == "start":
        return first, crossing
    if rule == "end":
        return last, crossing
    out = first.copy()
    for k in np.flatnonzero(crossing).tolist():
        edges = np.concatenate([[starts[k]], bounds[first[k] + 1 : last[k] + 1], [ends[k]]])
        out[k] = first[k] + int(np.argmax(np.diff(edges)))
    return out, crossing


def count_tokens(
    docs: DataFrame, path: str = vocabulary.DEFAULT_PATH, rule: str = "start", fields: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, section, n_tokens, n_crossing, n_chars``: one row for each section of each row of docs.

    Without ``fields`` the sections are the lines of the text, each with the newline that ends it. With
    ``fields`` the document is those columns in order, a newline after each but the last, and section k
    is field k (null fields are empty). n_crossing counts the section's tokens that reach into another.
    An empty text is one empty section; a null text has no rows; a text of newlines has a section for
    each. Null and repeated ids give their own rows. Narrow: no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    raw = vocabulary.send(docs.sparkSession, path)
    if fields:
        columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
        text = F.concat_ws("\n", *columns)
        size = F.array(*(F.octet_length(c) + F.lit(int(k < len(columns) - 1)) for k, c in enumerate(columns)))
    else:
        text, size = F.col(text_col).cast("string"), F.lit(None).cast("array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = vocabulary.encoding(raw.value).encode_ordinary, vocabulary.token_lengths(raw.value)
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            texts = batch.column(1)
            for first, last, data, offsets in blocks(texts, lower=False):
                ids = [encode(t) for t in texts.slice(first, last - first).to_pylist()]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate([np.zeros(0, np.int32), *(np.array(i, np.int32) for i in ids)])
                ends = np.cumsum(lengths[flat])
                starts = ends - lengths[flat]
                if fields:
                    parts = np.array(batch.column(2).slice(first, last - first).to_pylist(), np.int64).reshape(last - first, -1)
                    bounds = (np.cumsum(parts, axis=1) - parts + offsets[:-1, None]).ravel()
                    doc = np.repeat(np.arange(last - first), parts.shape[1])
                else:
                    after = np.flatnonzero(data == 10) + 1
                    after = after[~np.isin(after, offsets)]
                    bounds = np.concatenate([offsets[:-1], after])
                    doc = np.concatenate([np.arange(last - first), np.searchsorted(offsets, after, "right") - 1])
                    order = np.lexsort((bounds, doc))
                    bounds, doc = bounds[order], doc[order]
                del sizes
                at, crossing = attribute(starts, ends, bounds, rule)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                begin = np.searchsorted(doc, np.arange(last - first))
                out = [
                    batch.column(0).slice(first, last - first).take(pa.array(doc)),
                    pa.array((np.arange(len(doc)) - begin[doc]).astype(np.int32)),
                    pa.array(np.bincount(at, minlength=len(bounds)).astype(np.int32)),
                    pa.array(np.bincount(at[crossing], minlength=len(bounds)).astype(np.int32)),
                    pa.array((chars[np.append(bounds[1:], len(data))] - chars[bounds]).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(out, schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), size.alias("sizes")).mapInArrow(run, SCHEMA)
