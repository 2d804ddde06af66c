"""Katz backoff language model over the tokens of a public vocabulary, of order 3.

    P(w | u v) = d(r) r / c(u v)          where r = c(u v w) > 0
               = alpha(u v) P(w | v)      otherwise, and so on down to P(w)

d are Good-Turing discounts from the counts of counts of the whole corpus (for r up to ``CUT``), alpha
makes each context add up to one exactly, and P(w) spreads what Good-Turing leaves over the tokens never
seen. Every count covers all documents.

Layout: the trigrams of a context (u, v), its total and its weight all lie in one partition, which
depends on v, and on u only for tokens v so frequent that one partition would hold more than its share;
so the bigrams that backing off needs are copied to few partitions. Each task adds up its counts before
they move, as sorted arrays by partition. The tables hold a row for each partition and kind, with sorted
keys and values as binary, so that a task evaluates by binary search; a task is one partition. To score,
the n-grams of a block of documents go to their partitions as distinct keys with the list of documents,
are evaluated there recursively, and come back as sums for each document. What a context has in the tables
is bounded by the vocabulary, but what is asked of it isn't: contexts that would take more than their share
of a partition's questions (two sentence starts, a comma and its conjunction) are copied to more partitions, among
which the blocks that ask are spread.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import shared, vocabulary
from quillframe.llm.textblocks import mix64

CUT = 5
#: Bits of a token in a packed key; tokens of a block; tokens that a partition should hold.
SHIFT, BLOCK_TOKENS, PARTITION_TOKENS = 21, 1_500_000, 8_000_000
#: Distinct n-grams that a task holds before it passes their counts on.
HELD = 6_000_000
_MASK = (1 << SHIFT) - 1
ROWS = "q int, kind string, keys binary, vals binary"
TOKENS = "ref long, doc_id long, n_tokens int, ids binary"
_ROWS = pa.schema([("q", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("vals", pa.binary())])


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=0))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, "<i8"))


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else np.zeros(0, np.int64)


def discounts(n: np.ndarray, cut: int = CUT) -> np.ndarray:
    """d[r] for r up to ``cut`` (d[0] unused) from n[r], the number of n-grams that occur r times.

    Good-Turing as Katz renormalises it. Where the counts of counts give no discount between 0 and 1 for
    every r that occurs, the absolute discount n1 / (n1 + 2 n2), or 1/2 without those, is used for all r up to ``cut``.
    """
    r = np.arange(1, cut + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = (cut + 1) * n[cut + 1] / n[1]
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
    if not ((d > 0) & (d < 1)).all():
        share = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = (r - share) / r
    return np.append(1.0, d)


def counts_of_counts(counts: np.ndarray, cut: int = CUT) -> np.ndarray:
    return np.bincount(np.minimum(counts, cut + 2), minlength=cut + 3)[: cut + 2]


def context_model(context: np.ndarray, counts: np.ndarray, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each n-gram, the contexts, their backoff weights); rows sorted by context.

    lower: the probability of each n-gram's last token one order down. Where all counts of a context are
    too large for a discount, its total counts one more, so that something is left for other tokens;
    where its tokens are all that there are, they share everything.
    """
    at = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0), context, np.zeros(0)
    each = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(context))))
    total = np.add.reduceat(counts, at).astype(np.float64)
    mass = np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0) * counts
    undiscounted = np.add.reduceat(mass, at) >= total * (1 - 1e-12)
    p = mass / (total + undiscounted)[each]
    left, below = 1 - np.add.reduceat(p, at), 1 - np.add.reduceat(lower, at)
    full = below < 1e-9
    p = np.where(full[each], p / np.add.reduceat(p, at)[each], p)
    return p, context[at], np.where(full, 0.0, left / np.where(full, 1.0, below))


def unigrams(counts: np.ndarray) -> np.ndarray:
    """P(w) of all tokens of the vocabulary."""
    total = counts.sum()
    if not total:
        return np.full(len(counts), 1 / len(counts))
    d = discounts(counts_of_counts(counts[counts > 0]))
    p = np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0) * counts / total
    unseen = counts == 0
    if not unseen.any():
        return p / p.sum()
    if p.sum() >= 1 - 1e-12:
        p = counts / (total + 1)
    p[unseen] = (1 - p.sum()) / unseen.sum()
    return p


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass(frozen=True)
class Layout:
    """Where contexts lie."""

    partitions: int
    splits: np.ndarray  # of each token, BOS last: over how many partitions its contexts are spread
    hot: np.ndarray = field(default_factory=_none)  # contexts with copies, in order
    copies: np.ndarray = field(default_factory=_none)  # how many each has

    def sub(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (mix64(u.astype(np.uint64) + np.uint64(1)) % self.splits[v].astype(np.uint64)).astype(np.int64)

    def place(self, v: np.ndarray, sub: np.ndarray) -> np.ndarray:
        return (mix64(v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sub.astype(np.uint64)) % np.uint64(self.partitions)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        u, v = keys >> (2 * SHIFT), (keys >> SHIFT) & _MASK
        return self.place(v, self.sub(u, v))

    def of_copy(self, context: np.ndarray, copy: np.ndarray) -> np.ndarray:
        """Neighbouring partitions, from one that the context has by its hash."""
        return ((mix64(context.astype(np.uint64)) % np.uint64(self.partitions)).astype(np.int64) + copy) % self.partitions

    def where_hot(self, contexts: np.ndarray) -> np.ndarray:
        """The index among the hot ones, -1 for the others."""
        if not len(self.hot):
            return np.full(len(contexts), -1)
        at = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
        return np.where(self.hot[at] == contexts, at, -1)

    def to_ask(self, keys: np.ndarray, asker: int) -> np.ndarray:
        """Where a block asks for n-grams."""
        q, at = self.of(keys), self.where_hot(keys >> SHIFT)
        hot = np.flatnonzero(at >= 0)
        q[hot] = self.of_copy(keys[hot] >> SHIFT, asker % self.copies[at[hot]])
        return q


@dataclass(frozen=True)
class KatzModel:
    tables: DataFrame  # ROWS
    start: Broadcast  # P(w) of all tokens
    layout: Layout


def _encoding(raw: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ref = vocabulary.encoding(raw.value).encode_ordinary, TaskContext.get().partitionId() << 40
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                ids = [None if t is None else np.array(tokens(vocabulary.utf8_safe(t)), "<u4") for t in part.column(1).to_pylist()]
                refs = np.arange(ref, ref + len(part))
                ref += len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(refs), part.column(0), pa.array([None if i is None else len(i) for i in ids], pa.int32()), pa.array([None if i is None else _pack(i) for i in ids], pa.binary())],
                    names=["ref", "doc_id", "n_tokens", "ids"],
                )

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, raw: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """(ref, doc_id, n_tokens, ids): ref tells rows apart; ids as 4 bytes each, null for a null text."""
    return _texts(docs, id_col, text_col).mapInArrow(_encoding(raw), TOKENS)


def encoded(docs: DataFrame, raw: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """What ``encode`` gives, in the shared folder."""
    return shared.made(_texts(docs, id_col, text_col), _encoding(raw), TOKENS, "tokens")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(refs, ids) of blocks of whole documents; columns of the batches: ref, ids."""
    refs, ids, n = [], [], 0
    for batch in batches:
        for ref, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if b is None:
                continue
            refs.append(ref)
            ids.append(_unpack(b, "<u4"))
            n += len(ids[-1])
            if n >= size:
                yield np.array(refs), ids
                refs, ids, n = [], [], 0
    if refs:
        yield np.array(refs), ids


def trigram_keys(ids: list[np.ndarray], bos: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (u, v, w) of every token w, two BOS before each document, and the document of each."""
    sizes = np.array([len(i) for i in ids], np.int64)
    w = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
    doc = np.repeat(np.arange(len(ids)), sizes)
    place = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    v = np.where(place >= 1, np.roll(w, 1), bos)
    u = np.where(place >= 2, np.roll(w, 2), bos)
    return (u << (2 * SHIFT)) | (v << SHIFT) | w, doc


def _rows(found: list[tuple[int, str, bytes, bytes]]) -> pa.RecordBatch:
    q, kind, keys, values = zip(*found) if found else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(kind, pa.string()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], schema=_ROWS)


def _in_partitions(rows: DataFrame, partitions: int) -> DataFrame:
    """Each partition q as one task."""
    return rows.repartitionById(partitions, F.col("q"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, bytes, bytes]]:
    for batch in batches:
        for k in range(len(batch)):
            yield tuple(batch.column(c)[k].as_py() for c in range(4))


def _by_partition(q: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(partition, its part of each column), the order inside kept."""
    order = np.argsort(q, kind="stable")
    q, columns = q[order], tuple(c[order] for c in columns)
    for a, b in zip(at := np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64), np.append(at[1:], len(q))):
        yield int(q[a]), *(c[a:b] for c in columns)


def fit(tokens: DataFrame, vocabulary_size: int, partition_tokens: int = PARTITION_TOKENS) -> KatzModel:
    """The model of all of ``tokens`` (ref, doc_id, n_tokens, ids), in tables in the shared folder."""
    spark, bos = tokens.sparkSession, vocabulary_size

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bos + 1, np.int64)
        for refs, ids in _blocks(batches, BLOCK_TOKENS):
            total[:bos] += np.bincount(np.concatenate(ids).astype(np.int64), minlength=bos)
            total[bos] += len(refs)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["w", "n"])

    counts = np.zeros(bos + 1, np.int64)
    for r in tokens.select("ref", "ids").mapInArrow(one, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[r["w"]] = r["n"]
    total = int(counts[:bos].sum())
    start = spark.sparkContext.broadcast(unigrams(counts[:bos]))
    partitions = max(1, math.ceil(total / partition_tokens))
    layout = Layout(partitions, np.maximum(1, np.ceil(4 * counts * partitions / max(total, 1))).astype(np.int64))

    def passed_on(keys: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _rows([(q, "3", pack_sorted(k), _pack(n)) for q, k, n in _by_partition(layout.of(keys), keys, sums)])
        keys, sums = add_up(keys & ((1 << (2 * SHIFT)) - 1), sums)
        yield _rows([(q, "2", pack_sorted(k), _pack(n)) for q, k, n in _by_partition(layout.place(keys >> SHIFT, np.zeros(len(keys), np.int64)), keys, sums)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, ids in _blocks(batches, BLOCK_TOKENS):
            own, n = np.unique(trigram_keys(ids, bos)[0], return_counts=True)
            keys, sums = add_up(np.concatenate([keys, own]), np.concatenate([sums, n]))
            if len(keys) > HELD:
                yield from passed_on(keys, sums)
                keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from passed_on(keys, sums)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {"2": [], "3": []}
        q = None
        for q, kind, k, v in _cells(batches):
            own = held[kind]
            own.append((unpack_sorted(k), _unpack(v, "<i8")))
            if len(own) > 1 and sum(len(x) for x, _ in own[1:]) > HELD:
                own[:] = [add_up(*map(np.concatenate, zip(*own)))]
        found = []
        for kind, own in held.items():
            if own:
                keys, sums = add_up(*map(np.concatenate, zip(*own)))
                found.append((q, kind, pack_sorted(keys), _pack(sums)))
        yield _rows(found)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([counts_of_counts(_unpack(values, "<i8")).tolist()], pa.list_(pa.int64()))], names=["kind", "n"])

    merged = shared.made(_in_partitions(tokens.select("ref", "ids").mapInArrow(count, ROWS), partitions), merge, ROWS, "ngrams")
    size = CUT + 2
    sums = merged.select("kind", "vals").mapInArrow(tally, "kind string, n array<long>").groupBy("kind").agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(size))).collect()
    d = {k: discounts(np.zeros(size, np.int64)) for k in ("2", "3")} | {r["kind"]: discounts(np.array([r[f"n{k}"] for k in range(size)])) for r in sums}

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, n = unpack_sorted(k), _unpack(n, "<i8")
                v = keys >> SHIFT
                p, contexts, alpha = context_model(v, n, start.value[keys & _MASK], d["2"])
                with np.errstate(divide="ignore"):
                    tables = [("p2", keys, v, np.log(p)), ("a2", contexts, contexts, np.log(alpha))]
                for name, own, token, values in tables:
                    order = np.argsort(-layout.splits[token], kind="stable")
                    splits = layout.splits[token][order]
                    for sub in range(int(splits[0]) if len(splits) else 0):
                        here = np.sort(order[: np.searchsorted(-splits, -sub)])  # those with more than sub splits
                        yield _rows([(q, name, pack_sorted(a), _pack(b)) for q, a, b in _by_partition(layout.place(token[here], np.full(len(here), sub)), own[here], values[here])])

    two = shared.made(merged.where("kind = '2'").select("keys", "vals"), bigrams, ROWS, "katz2")

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = list(_cells(batches))
        part = Part(cells, start.value)
        for q, t, k, n in cells:
            if t == "3":
                keys, n = unpack_sorted(k), _unpack(n, "<i8")
                p, contexts, alpha = context_model(keys >> SHIFT, n, np.exp(part.two(keys & ((1 << (2 * SHIFT)) - 1))), d["3"])
                with np.errstate(divide="ignore"):
                    yield _rows([(q, "p3", pack_sorted(keys), _pack(np.log(p))), (q, "a3", pack_sorted(contexts), _pack(np.log(alpha)))])

    three = shared.made(_in_partitions(merged.where("kind = '3'").unionByName(two), partitions), trigrams, ROWS, "katz3")
    layout = hot_contexts(merged, layout, max(1, partition_tokens // 4))
    tables = two.unionByName(three)
    return KatzModel(tables.unionByName(copies(tables, layout)) if len(layout.hot) else tables, start, layout)


def hot_contexts(merged: DataFrame, layout: Layout, share: int) -> Layout:
    """The layout with the contexts that occur more than ``share`` times; their number is at most tokens / share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                contexts, n = add_up(unpack_sorted(k) >> SHIFT, _unpack(n, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(contexts[n > share]), pa.array(n[n > share])], names=["context", "n"])

    found = sorted((r["context"], r["n"]) for r in merged.where("kind = '3'").select("keys", "vals").mapInArrow(run, "context long, n long").collect())
    contexts, n = (np.array(x, np.int64) for x in zip(*found)) if found else (_none(), _none())
    return Layout(layout.partitions, layout.splits, contexts, np.minimum(-(-n // share), layout.partitions))


def copies(tables: DataFrame, layout: Layout) -> DataFrame:
    """Rows of the tables for the copies of hot contexts: their trigrams and weights, and the bigrams and weights of their last token."""
    last = np.unique(layout.hot & _MASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, kind, k, v in _cells(batches):
            keys, values = unpack_sorted(k), _unpack(v, "<f8")
            owner = keys >> SHIFT if kind[0] == "p" else keys
            here = np.isin(owner, layout.hot if kind[1] == "3" else last)
            if kind[1] == "2":  # of the copies that bigrams have anyway, the first
                here &= layout.place(owner, np.zeros(len(owner), np.int64)) == home
            keys, values, owner = keys[here], values[here], owner[here]
            for of in np.unique(owner).tolist():
                own = owner == of
                packed = pack_sorted(keys[own]), _pack(values[own])
                contexts = np.flatnonzero(layout.hot == of) if kind[1] == "3" else np.flatnonzero((layout.hot & _MASK) == of)
                for c in contexts.tolist():
                    q = layout.of_copy(np.full(layout.copies[c], layout.hot[c]), np.arange(layout.copies[c]))
                    yield _rows([(int(x), kind, *packed) for x in q])

    return tables.mapInArrow(run, ROWS)


class Part:
    """One partition of the tables, evaluated recursively for arrays of packed n-grams; natural logarithms."""

    def __init__(self, table: pa.Table | list[tuple], start: np.ndarray) -> None:
        self.start = np.log(start)
        self.maps: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        cells = table if isinstance(table, list) else list(zip(*(table.column(c).to_pylist() for c in ("q", "kind", "keys", "vals"))))
        for name in ("p2", "a2", "p3", "a3"):
            rows = [(unpack_sorted(k), _unpack(v, "<f8")) for _, t, k, v in cells if t == name]
            keys, values = map(np.concatenate, zip(*rows)) if rows else (np.zeros(0, np.int64), np.zeros(0))
            order = np.argsort(keys, kind="stable")
            self.maps[name] = keys[order], values[order]

    def find(self, name: str, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, whether there is one)."""
        keys, values = self.maps[name]
        if not len(keys):
            return np.zeros(len(asked)), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        there = keys[at] == asked
        return np.where(there, values[at], 0.0), there

    def two(self, keys: np.ndarray) -> np.ndarray:
        value, there = self.find("p2", keys)
        rest = ~there
        value[rest] = self.find("a2", keys[rest] >> SHIFT)[0] + self.start[keys[rest] & _MASK]
        return value

    def three(self, keys: np.ndarray) -> np.ndarray:
        value, there = self.find("p3", keys)
        rest = ~there
        value[rest] = self.find("a3", keys[rest] >> SHIFT)[0] + self.two(keys[rest] & ((1 << (2 * SHIFT)) - 1))
        return value


def score_tokens(tokens: DataFrame, model: KatzModel) -> DataFrame:
    """(ref, logprob) of each row of ``tokens`` that has tokens."""
    layout, start, bos = model.layout, model.start, len(model.start.value)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = TaskContext.get().partitionId()
        for refs, ids in _blocks(batches, BLOCK_TOKENS):
            keys, doc = trigram_keys(ids, bos)
            del ids
            order = np.argsort(keys, kind="stable")
            keys, doc = keys[order], doc[order].astype(np.int32)
            del order
            found = []
            for q, k, d in _by_partition(layout.to_ask(keys, asker).astype(np.int32), keys, doc):
                at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                n = np.diff(np.append(at, len(k)))
                own, index = np.unique(d, return_inverse=True)
                parts = [pack_sorted(k[at]), _pack(n.astype("<u4")), _pack(index.astype("<u2" if len(own) <= 1 << 16 else "<u4")), pack_sorted(refs[own])]
                found.append((q, "ask", np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts), b""))
            asker += 1
            yield _rows(found)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, part = [], None
        for cell in _cells(batches):  # the tables come first
            if cell[1] != "ask":
                tables.append(cell)
                continue
            if part is None:
                part, tables = Part(tables, start.value), []
            b = cell[2]
            cuts = 32 + np.append(0, np.cumsum(np.frombuffer(b[:32], "<i8")))
            k, n, index, own = (b[x:y] for x, y in zip(cuts, cuts[1:]))
            own = unpack_sorted(own)
            values = np.repeat(part.three(unpack_sorted(k)), _unpack(n, "<u4"))
            sums = np.bincount(_unpack(index, "<u2" if len(own) <= 1 << 16 else "<u4"), weights=values, minlength=len(own))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sums)], names=["ref", "logprob"])

    asked = tokens.select("ref", "ids").mapInArrow(ask, ROWS).unionByName(model.tables)
    rows = _in_partitions(asked, layout.partitions).sortWithinPartitions(F.col("kind") == "ask")
    return rows.mapInArrow(answer, "ref long, logprob double").groupBy("ref").agg(F.sum("logprob").alias("logprob"))


def score(docs: DataFrame, train: DataFrame | None = None, path: str = vocabulary.DEFAULT_PATH, id_col: str = "doc_id", text_col: str = "text", partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """``doc_id, n_tokens, logprob, perplexity`` of each row of docs, under the model of ``train`` (docs themselves if none).

    logprob is the sum over tokens of ln P, rounded to 6 decimals; perplexity exp(-logprob / n_tokens). A
    null text has nulls; an empty one no tokens, a logprob of 0 and a null perplexity. Null and repeated
    ids: row for row. Without any training text every token is as likely as any other.
    """
    raw = vocabulary.send(docs.sparkSession, path)
    size = len(vocabulary.token_lengths(raw.value))
    tokens = encoded(docs, raw, id_col, text_col)
    model = fit(tokens if train is None else encoded(train, raw, id_col, text_col), size, partition_tokens)
    sums = score_tokens(tokens, model)
    out = tokens.select("ref", "doc_id", "n_tokens").join(sums, "ref", "left")
    logprob = F.when(F.col("n_tokens").isNotNull(), F.round(F.coalesce("logprob", F.lit(0.0)), 6))
    return out.select("doc_id", "n_tokens", logprob.alias("logprob"), F.when(F.col("n_tokens") > 0, F.exp(-F.col("logprob") / F.col("n_tokens"))).alias("perplexity"))
