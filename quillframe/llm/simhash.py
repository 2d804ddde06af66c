"""SimHash near-duplicates with pigeonring filtering.

A document's signature has 128 bits: each bit is the majority, over its distinct words, of that bit of
the words' hashes. Runs of letters and runs of digits are words; in scripts without spaces, neighbouring
characters in twos are. A text without any word has a hash of itself as its signature. Two signatures are
near if they differ in at most ``DISTANCE`` bits. Candidates share the bits at the positions sampled for one
of several tables; the number of bits grows with the logarithm of the number of signatures, and the number of
tables is what gives the target recall for pairs at the full distance, whatever the number of bits, so that
nearer pairs are found all but always. Candidate pairs then have to pass the pigeonring test (some chain of
consecutive segments of the ring whose differences, added up along the chain, stay within the proportional
budget at every step) before the full Hamming distance is taken.

Every pair in a bucket is looked at: there is no limit on its size. Only the edges of a spanning forest
are kept of a bucket, so that output grows with documents, not with pairs; groups are the connected
components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import shared
from quillframe.llm.components import components
from quillframe.llm.textblocks import LETTERS, blocks, distinct_per_document, mix64, text_words, word_hashes  # noqa: F401 (tests take words from here)

BITS, SEGMENTS, CHAIN = 128, 16, 4
DISTANCE, RECALL, SEED = 20, 0.9, 20240229
#: Buckets up to this size leave all their edges; pairs that are handled at once, and rows that are matched together.
SMALL, AT_ONCE, ROWS = 64, 1 << 14, 1 << 17


def signatures_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 signatures of a block of lower-case texts, and the number of distinct words of each."""
    words, bounds, joined = text_words(data, offsets)
    two = np.flatnonzero(joined)
    words[two] = mix64(words[two] * np.uint64(0x9E3779B97F4A7C15) + words[two + 1])
    words, bounds, _ = distinct_per_document(words, bounds)
    n = np.diff(bounds)
    ones = np.zeros((len(n), BITS), np.int32)
    rows = np.flatnonzero(n)
    step = 1 << 16
    for a in range(0, len(words), step):
        h = mix64(words[a : a + step])
        bits = np.unpackbits(np.stack([h, mix64(h ^ np.uint64(SEED))], axis=1).view(np.uint8), axis=1)
        here = rows[(bounds[rows] < a + step) & (bounds[rows + 1] > a)]
        ones[here] += np.add.reduceat(bits, np.maximum(bounds[here] - a, 0), axis=0, dtype=np.int32)
    sig = np.packbits(2 * ones > n[:, None], axis=1).view(np.uint64)
    for k in np.flatnonzero((n == 0) & (np.diff(offsets) > 0)).tolist():
        sig[k] = np.frombuffer(xxhash.xxh3_128_digest(data[offsets[k] : offsets[k + 1]].tobytes()), np.uint64)
    return sig, n


def near(one: np.ndarray, other: np.ndarray, distance: int) -> np.ndarray:
    """Whether pairs of signatures, row by row (or one against rows), are within the distance: chains first."""
    differ = one ^ other
    passed = np.zeros(len(differ), bool)
    passed[within(np.ascontiguousarray(differ[:, 0]), np.ascontiguousarray(differ[:, 1]), distance)] = True
    return passed


def _bytes_of(value: int) -> np.uint64:
    return np.uint64(value * 0x0101010101010101)


_1, _2, _4, _8, _56, _ODD, _TWOS, _FOURS, _TOP = *(np.uint64(k) for k in (1, 2, 4, 8, 56)), _bytes_of(0x55), _bytes_of(0x33), _bytes_of(0x0F), _bytes_of(0x80)


def _segment_counts(x: np.ndarray) -> np.ndarray:
    """The number of ones in each byte."""
    y = x >> _1
    y &= _ODD
    y = np.subtract(x, y, out=y)
    x = y >> _2
    x &= _TWOS
    y &= _TWOS
    y += x
    y += np.right_shift(y, _4, out=x)
    y &= _FOURS
    return y


def within(high: np.ndarray, low: np.ndarray, distance: int, chain: int = CHAIN) -> np.ndarray:
    """Indexes of the differences (two words of bits) of at most ``distance`` ones, by the pigeonring principle.

    The bytes of the two words are a ring of SEGMENTS segments. If they hold at most ``distance`` ones, some
    start has all of the sums over its first 1, 2, ... ``chain`` segments within 1, 2, ... ``chain`` times
    distance / SEGMENTS: nothing within the distance is lost. All starts go on by one segment at a time, eight
    in a word; pairs without a start left are dropped on the way. The full distance is taken of those with a
    whole chain.
    """
    at = None
    ahead = [_segment_counts(high), _segment_counts(low)]
    sums, over = [x.copy() for x in ahead], [0, 0]
    for k in range(1, chain + 1):
        if k > 1:
            ahead = [(ahead[j] >> _8) | (ahead[1 - j] << _56) for j in (0, 1)]
            for j in (0, 1):
                sums[j] += ahead[j]
        allowed = _bytes_of(127 - min(k * distance // SEGMENTS, 127 - 8 * k))  # the highest bit of a byte is set by a sum beyond
        over = [o | (s + allowed) for o, s in zip(over, sums)]
        if k > 1:  # most pairs have some segment of few differences, few have two in a row
            left = np.flatnonzero((over[0] & over[1] & _TOP) != _TOP)
            at = left if at is None else at[left]
            sums, ahead, over = ([x[left] for x in both] for both in (sums, ahead, over))
    return at[np.bitwise_count(high[at]) + np.bitwise_count(low[at]) <= distance]


def tables_for(n: int, distance: int = DISTANCE, recall: float = RECALL) -> list[np.ndarray]:
    """The sampled bit positions of each table for n signatures."""
    width = max(8, math.ceil(0.8 * math.log2(max(n, 2))))  # pairs of a bucket and tables then grow alike, both about as n^0.2
    agree = math.comb(BITS - distance, width) / math.comb(BITS, width)  # positions are drawn without replacement
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree))
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.choice(BITS, width, replace=False)) for _ in range(tables)]


def bucket_edges(sig: np.ndarray, ids: np.ndarray, keys: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between near signatures with one key, keys sorted: all of small buckets, a spanning forest of large ones."""
    n, left, right = len(keys), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    high, low = (np.ascontiguousarray(sig[:, k]) for k in (0, 1))
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():  # buckets of one size have their pairs at the same places
        one, other = np.triu_indices(size, 1)
        of_size = starts[sizes == size]
        for part in np.array_split(of_size, -(-len(of_size) * len(one) // AT_ONCE)):
            u, v = ((part[:, None] + places).ravel() for places in (one, other))
            hit = within(high[u] ^ high[v], low[u] ^ low[v], distance)
            left.append(ids[u[hit]])
            right.append(ids[v[hit]])
    for s, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        u, v = _forest(high[s : s + size], low[s : s + size], distance)
        left.append(ids[s + u])
        right.append(ids[s + v])
    return np.concatenate(left), np.concatenate(right)


def _forest(high: np.ndarray, low: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the near pairs of one bucket; every pair is looked at, some rows at a time."""
    n = len(high)
    label, kept = np.arange(n), []
    rows = max(1, AT_ONCE // n)
    for a in range(0, n - 1, rows):
        b = min(a + rows, n)
        hit = within((high[a:b, None] ^ high[None, a:]).ravel(), (low[a:b, None] ^ low[None, a:]).ravel(), distance)
        u, v = a + hit // (n - a), a + hit % (n - a)
        while len(u):
            one, other = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
            apart = one < other
            u, v, one, other = u[apart], v[apart], one[apart], other[apart]
            # the greater label of an edge hangs under the lesser: each hangs once a turn, so no circle comes about
            other, first = np.unique(other, return_index=True)
            kept.append((u[first], v[first]))
            under = np.arange(n)
            under[other] = one[first]
            while (deeper := under[under] != under).any():
                under[deeper] = under[under[deeper]]
            label = under[label]
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*kept) if kept else ((), ())))
    return u, v


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, high, low, n_words`` for each row; high and low are null for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(1), lower=True):
                sig, n = signatures_of(data, offsets)
                parts = [pa.array(np.ascontiguousarray(sig[:, k]).view(np.int64), mask=np.diff(offsets) == 0) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *parts, pa.array(n.astype(np.int32))], names=["doc_id", "high", "low", "n_words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, high long, low long, n_words int")


def near_edges(distinct: DataFrame, distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """(rep, high, low) of distinct signatures to edges (u, v) of reps that connect all near ones found."""
    tables = tables_for(distinct.count(), distance, recall)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, high, low = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            bits = np.unpackbits(np.stack([high, low], axis=1).view(np.uint8), axis=1)
            for t, places in enumerate(tables):
                key = bits[:, places].astype(np.int64) @ (1 << np.arange(len(places), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key * len(tables) + t), batch.column(0), batch.column(1), batch.column(2)], names=["key", "rep", "high", "low"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def edges(key, rep, high, low):
            u, v = bucket_edges(np.stack([high, low], axis=1).view(np.uint64), rep, key, distance)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)))
            n += len(batch)
            if n < ROWS or held[0][0][0] == held[-1][0][-1]:
                continue  # few rows, or one bucket so far
            parts = tuple(map(np.concatenate, zip(*held)))
            cut = int(np.searchsorted(parts[0], parts[0][-1]))
            yield edges(*(x[:cut] for x in parts))
            held, n = [tuple(x[cut:] for x in parts)], len(parts[0]) - cut
        if held:
            yield edges(*map(np.concatenate, zip(*held)))

    rows = distinct.select("rep", "high", "low").mapInArrow(probe, "key long, rep long, high long, low long")
    return rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(match, "u long, v long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, group_id, kept``: one row for each distinct (id, signature); group_id is the least id of its group, which is kept.

    Rows with a null id, and null and empty texts, are no copies of anything: the
    former are left out, the latter are groups of their own. Equal signatures are one group.
    """
    sigs = shared.table(signatures(docs, id_col, text_col).where("doc_id is not null").select("doc_id", "high", "low"), "signatures")
    distinct = shared.table(sigs.where("high is not null").groupBy("high", "low").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(near_edges(distinct, distance, recall))
    groups = distinct.join(found, distinct.rep == found.node, "left").select("high", "low", F.coalesce("component", "rep").alias("group_id"))
    out = sigs.join(groups, ["high", "low"], "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id")).distinct()
    return out.withColumn("kept", F.col("doc_id") == F.col("group_id"))


def keep_one(docs: DataFrame, distance: int = DISTANCE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each group the document with the least id stays, all columns as they are.

    An id that occurs in several rows is one document: its first row by text stays. Rows with a null id stay.
    """
    found = shared.table(near_duplicates(docs, distance, recall, id_col, text_col), "groups")
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    ids = docs.select(F.col(id_col).cast("long").alias("_gone")).where("_gone is not null").groupBy("_gone").count().where("count > 1").select("_gone")
    repeated = shared.table(ids, "repeated")
    # texts move to the ids by one plan at every size: a broadcast would hold only for small corpora
    away = gone.unionByName(repeated).hint("merge")

    def match(other: DataFrame):
        return docs[id_col].cast("long") == other["_gone"]

    once = docs.join(away, match(away), "left_anti")
    if not repeated.limit(1).count():
        return once
    again = docs.join(repeated, match(repeated), "left_semi").join(gone, match(gone), "left_anti")
    first = again.groupBy(F.col(id_col).alias("_id")).agg(F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.struct(F.col(text_col))).alias("_row"))
    return once.unionByName(first.select("_row.*"))
