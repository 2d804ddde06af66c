"""Benchmark decontamination: edit-distance search by CGK embedding and bit-sampling LSH.

Texts are sequences of words (case folded): runs of letters, runs of digits, and each character of a
script without spaces. The CGK random walk maps a sequence to a longer one: at each step it writes the word
that it stands on and moves on or stays, as a random function of step and word says. Sequences at a small
edit distance fall into step again, so that their embeddings are at a small Hamming distance. The
embeddings of item-sized windows of the documents and of the items are sampled at a few steps for each of
several tables; a window that agrees with an item on all the steps of one table is a candidate, which
exact edit distance then decides. Whether two sequences fall into step again is luck of the walk, and the more
edits the less likely: there are several independent walks, each with its tables, and as many of both as
reach the recall at the largest number of edits, whatever the item's length.

Windows of real texts are far too many to walk them all, so those are passed over that can't hold any item,
without loss: an item that may have k edits is cut into k + 1 parts, of which one at least is unedited in
any match, at most k words from where the item's start says; and all but k of its words are there. Where
no part of an item is, or too few of its words are, no window of its size begins.

Items are few and sent to all workers in slices of bounded size; more items mean more slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.textblocks import blocks, mix64, text_words

#: Edits an item may have, as a share of its words; items of fewer words are left out unless min_words says otherwise.
EDIT_RATE, MIN_WORDS = 0.2, 5
#: Independent walks, tables of each, and steps sampled for a table: over 0.99 of the items at their most edits are found.
WALKS, TABLES, SAMPLED = 8, 16, 2
#: Words of a part that are looked up; candidates (and words of their windows) that are handled at once.
PART_WORDS, AT_ONCE = 8, 1 << 20
#: Items of a slice, and characters of their texts.
SLICE_ITEMS, SLICE_CHARS = 20_000, 8 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Parts:
    """The parts of one length of all items: keys in order, with the item and the part's place in it."""

    length: int
    keys: np.ndarray
    items: np.ndarray
    places: np.ndarray
    bits: int
    seen: np.ndarray  # bitmap of the first bits of the keys


@dataclass(frozen=True)
class Tables:
    """The sampled embeddings of all items of one number of words: keys of all tables in order, with their items."""

    size: int
    steps: np.ndarray  # walk, table, sample
    keys: np.ndarray
    items: np.ndarray


@dataclass(frozen=True)
class Items:
    ids: np.ndarray
    words: list[np.ndarray]
    edits: np.ndarray  # the most that each may have
    parts: list[Parts]
    tables: dict[int, Tables]  # by number of words


def run_hashes(words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the run of so many words from each word on), the last ones cut off."""
    h = words
    for length in range(1, longest + 1):
        if length > 1:
            h = mix64(h[:-1] * _STEP + words[length - 1 :]) if len(h) else h
        yield length, h


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int) -> np.ndarray:
    """What the walks from ``starts`` write: step, walk, start. Past its end a walk writes 0."""
    movers = mix64(np.arange(1, WALKS * steps + 1, dtype=np.uint64).reshape(steps, WALKS) * _STEP) | np.uint64(1)
    padded = np.append(words, np.zeros(1, np.uint64))
    at, out = np.tile(starts, (WALKS, 1)), np.empty((steps, WALKS, len(starts)), np.uint64)
    for j in range(steps):
        here = padded[np.where(at < ends, at, len(words))]
        out[j] = here
        at += ((here * movers[j][:, None]) >> np.uint64(63)).astype(at.dtype)
    return out


def sampled_steps(size: int) -> np.ndarray:
    """walk x table x sample of the steps on which the tables for items of ``size`` words agree."""
    rng = np.random.default_rng(size)
    places = np.argsort(rng.random((WALKS, TABLES, walk_length(size))), axis=2)[:, :, :SAMPLED]
    return np.sort(places, axis=2)


def walk_length(size: int) -> int:
    """Steps of a walk that hardly ever comes to the end of ``size`` words; it stays on a word for two steps on the average."""
    return max(SAMPLED, 2 * size - size // 2)


def table_keys(words: np.ndarray, starts: np.ndarray, size: int, ends: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A key for each table (of all walks) and start: the table's number and what was written at its steps."""
    written = embed(words, starts, np.minimum(starts + size, ends), walk_length(size))
    walk = np.arange(WALKS)[:, None]
    keys = np.broadcast_to(mix64(np.arange(1, WALKS * TABLES + 1, dtype=np.uint64) * _STEP).reshape(WALKS, TABLES, 1), (WALKS, TABLES, len(starts)))
    for k in range(SAMPLED):
        keys = mix64(keys * _STEP + written[steps[:, :, k], walk])
    return keys.reshape(WALKS * TABLES, len(starts))


def make_tables(words: list[np.ndarray]) -> dict[int, Tables]:
    by_size: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_size.setdefault(len(w), []).append(k)
    tables = {}
    for size, members in by_size.items():
        steps, at = sampled_steps(size), np.arange(len(members)) * size
        keys = table_keys(np.concatenate([words[k] for k in members]), at, size, at + size, steps)
        order = np.argsort(keys, axis=None, kind="stable")
        tables[size] = Tables(size, steps, keys.ravel()[order], np.tile(np.array(members, np.int32), len(keys))[order])
    return tables


def prepare(rows: list[tuple[int, str]], rate: float = EDIT_RATE, min_words: int = MIN_WORDS) -> Items:
    """Items as hashed words, with the parts of which one is unedited in any match, and the tables of their embeddings."""
    if not 0 <= rate < 1:
        raise ValueError("rate must be a share of the words, under 1")
    ids, words = [], []
    for _, _, data, offsets in blocks(pa.array([t for _, t in rows], pa.string()), lower=True):
        h, b, _ = text_words(data, offsets)
        words += [h[x:y] for x, y in zip(b, b[1:])]
    kept = [k for k, w in enumerate(words) if len(w) >= max(min_words, 1)]
    ids, words = np.array([rows[k][0] for k in kept], np.int64), [words[k] for k in kept]
    edits = np.array([int(rate * len(w)) for w in words], np.int64)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, w in enumerate(words):
        cuts = [j * len(w) // (int(edits[k]) + 1) for j in range(int(edits[k]) + 2)]
        hashes = dict(run_hashes(w, min(PART_WORDS, max(y - x for x, y in zip(cuts, cuts[1:])))))
        for x, y in zip(cuts, cuts[1:]):
            length = min(PART_WORDS, y - x)
            found.setdefault(length, []).append((int(hashes[length][x]), k, x))
    parts = []
    for length, made in sorted(found.items()):
        keys = np.array([h for h, _, _ in made], np.uint64)
        order, bits = np.argsort(keys, kind="stable"), max(10, (8 * len(keys)).bit_length())
        seen = np.zeros(1 << bits, bool)
        seen[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
        parts.append(Parts(length, keys[order], np.array([k for _, k, _ in made])[order], np.array([x for _, _, x in made])[order], bits, seen))
    return Items(ids, words, edits, parts, make_tables(words))


def best_edits(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Edit distance of the item to the nearest part of each row of ``texts`` (rows padded with 0)."""
    n, width = len(item), texts.shape[1]
    ramp = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((len(texts), width + 1), np.int32)
    for i in range(n):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (texts != item[i]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row.min(axis=1)


def candidates(words: np.ndarray, bounds: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, where in words the item starts if nothing moved it, item): each unedited part, some at a time."""
    wanted = {p.length: p for p in items.parts}
    ends = np.repeat(bounds[1:], np.diff(bounds))
    for length, h in run_hashes(words, max(wanted, default=0)):
        if length not in wanted or not len(h):
            continue
        p = wanted[length]
        at = np.flatnonzero(p.seen[(h >> np.uint64(64 - p.bits)).astype(np.int64)])
        at = at[at + length <= ends[at]]
        low, high = np.searchsorted(p.keys, h[at]), np.searchsorted(p.keys, h[at], "right")
        at, low, n = at[high > low], low[high > low], (high - low)[high > low]
        total = np.cumsum(n)
        for chunk in np.split(np.arange(len(at)), np.flatnonzero(np.diff(total // AT_ONCE)) + 1):
            if not len(chunk):
                continue
            m = n[chunk]
            slot = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[chunk], m)
            place = np.repeat(at[chunk], m)
            pair = np.unique(np.stack([np.searchsorted(bounds, place, "right") - 1, place - p.places[slot], p.items[slot]], axis=1), axis=0)
            yield pair[:, 0], pair[:, 1], pair[:, 2]


def places(words: np.ndarray, bounds: np.ndarray, items: Items) -> dict[int, np.ndarray]:
    """Where windows begin that may hold an item, by the item's number of words: (start, document) rows, none lost."""
    found: dict[int, list[np.ndarray]] = {}
    for doc, starts, item in candidates(words, bounds, items):
        order = np.argsort(item, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
            own, allowed = items.words[k := int(item[group[0]])], int(items.edits[k])
            sorted_own = np.sort(own)
            for part in np.array_split(group, -(-len(group) * (len(own) + 2 * allowed) // AT_ONCE)):
                texts = _window(words, bounds, doc[part], starts[part], len(own), allowed)
                # all but the edited words of the item are in the window
                likely = (sorted_own[np.minimum(np.searchsorted(sorted_own, texts), len(own) - 1)] == texts).sum(axis=1) >= len(own) - allowed
                found.setdefault(len(own), []).append(np.stack([starts[part], doc[part]], axis=1)[likely])
    return {size: np.unique(np.concatenate(x), axis=0) for size, x in found.items()}


def _window(words: np.ndarray, bounds: np.ndarray, doc: np.ndarray, starts: np.ndarray, size: int, more: int) -> np.ndarray:
    """The words from ``more`` before each start to ``more`` behind the window's end; 0 outside of the document."""
    columns = starts[:, None] + np.arange(-more, size + more)[None, :]
    inside = (columns >= bounds[doc][:, None]) & (columns < bounds[doc + 1][:, None])
    return np.where(inside, words[np.clip(columns, 0, len(words) - 1)], np.uint64(0))


def embedded(words: np.ndarray, bounds: np.ndarray, starts: np.ndarray, doc: np.ndarray, tables: Tables) -> np.ndarray:
    """(row of starts, item) pairs that agree in some table."""
    pairs = [np.zeros((0, 2), np.int64)]
    for part in np.array_split(np.arange(len(starts)), -(-len(starts) * tables.size * 2 * WALKS // AT_ONCE) or 1):
        # a window may begin before its document does, if an item's first words are missing there
        keys = table_keys(words, np.maximum(starts[part], bounds[doc[part]]), tables.size, bounds[doc[part] + 1], tables.steps)
        low, high = np.searchsorted(tables.keys, keys), np.searchsorted(tables.keys, keys, "right")
        at = np.flatnonzero((high > low).ravel())
        low, n = low.ravel()[at], (high - low).ravel()[at]
        slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        pairs.append(np.unique(np.stack([part[np.repeat(at % len(part), n)], tables.items[slot]], axis=1), axis=0))
    return np.concatenate(pairs)


def matches(data: np.ndarray, offsets: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(document, item, edits, first word of the window): the best of each pair, the first of equal ones."""
    words, bounds, _ = text_words(data, offsets)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for size, at in places(words, bounds, items).items():
        starts, doc = at[:, 0], at[:, 1]
        pairs = embedded(words, bounds, starts, doc, items.tables[size])
        order = np.argsort(pairs[:, 1], kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(pairs[order, 1])) + 1):
            if not len(group):
                continue
            item, allowed = items.words[k := int(pairs[group[0], 1])], int(items.edits[k])
            for part in np.array_split(pairs[group, 0], -(-len(group) * (size + 2 * allowed) // AT_ONCE)):
                for j, edits in zip(part.tolist(), best_edits(item, _window(words, bounds, doc[part], starts[part], size, allowed)).tolist()):
                    if edits <= allowed:
                        pair, value = (int(doc[j]), k), (edits, max(int(starts[j] - bounds[doc[j]]), 0))
                        best[pair] = min(best.get(pair, value), value)
    return [(d, k, e, s) for (d, k), (e, s) in sorted(best.items())]


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_items: int, rate: float, min_words: int):
    """Prepared items in slices, each broadcast; null ids and texts are left out."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    sc, held, size = benchmark.sparkSession.sparkContext, [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len(r["t"])
        if len(held) == slice_items or size >= SLICE_CHARS:
            yield sc.broadcast(prepare(held, rate, min_words))
            held, size = [], 0
    yield sc.broadcast(prepare(held, rate, min_words))


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, slice_items: int = SLICE_ITEMS, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id, edits, n_words, start_word``: a row for each item found in a row of docs.

    An item is found where some part of the text is within ``rate`` times its number of words (n_words) in
    word edits. Null and empty texts have no rows, and neither have items that are null, empty or under
    ``min_words`` words. With 1 none is left out: those of under five words have to occur as they are, at the
    default rate. Rows with null or repeated ids give their own rows; so do items with one id.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, n_words int, start_word int"
    out = None
    for sent in _slices(benchmark, "item_id", "text", slice_items, rate, min_words):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for first, last, data, offsets in blocks(batch.column(1), lower=True):
                    found = matches(data, offsets, items)
                    ids = batch.column(0).slice(first, last - first).take(pa.array([d for d, *_ in found], pa.int64()))
                    rest = [[int(items.ids[k]) for _, k, _, _ in found], [e for _, _, e, _ in found], [len(items.words[k]) for _, k, _, _ in found], [s for *_, s in found]]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(rest[0], pa.int64()), *(pa.array(x, pa.int32()) for x in rest[1:])], names=["doc_id", "item_id", "edits", "n_words", "start_word"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _finder(sent):
    @F.pandas_udf("boolean")
    def found(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text), bool)
        for first, _, data, offsets in blocks(pa.array(text, pa.string(), from_pandas=True), lower=True):
            out[[first + d for d, *_ in matches(data, offsets, sent.value)]] = True
        return pd.Series(out, index=text.index)

    return found


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, slice_items: int = SLICE_ITEMS, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs in which no item is found, all columns as they are.

    Null and empty texts stay, repeated rows and ids are judged each by its own text, texts at exactly the allowed
    edits go; without items everything stays.
    """
    for sent in _slices(benchmark, "item_id", "text", slice_items, rate, min_words):
        docs = docs.where(~_finder(sent)(F.col(text_col).cast("string")))
    return docs
