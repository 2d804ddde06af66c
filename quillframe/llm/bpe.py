"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of each word. A sequence of tokens is what exact merging
gives if and only if each adjacent pair is compatible, that is, merging the bytes of the pair alone
gives that pair back. All adjacent pairs of all new words of a batch are therefore looked up together
in a table of verdicts (NumPy, by packed pair); pairs seen for the first time are decided once by
merging them. Only words with an incompatible pair undergo exact merging.

All three work on many words at once: the longest match walks a trie kept in a hash table, a byte of all
words at a time; exact merging looks the ranks of pairs up in another and merges the pair of lowest rank in
every word at each turn. Decoding gathers bytes by token and compares them with the text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import vocabulary

SCHEMA = "doc_id long, token_ids array<int>, n_tokens int, round_trip boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("round_trip", pa.bool_())])
_SPLIT = regex.compile(vocabulary.PATTERN)
#: Texts without white space next to white space can be cut at spaces and newlines before the pattern is applied.
_UNSAFE = re.compile(r"\s\s")
#: Bytes that a worker's memo of words may take; it starts again beyond, which changes time only. Longer words than MEMO_CHARS stay out of it.
MEMO_BYTES, MEMO_CHARS = 96 << 20, 64
#: Bytes of the longest words that are merged together; longer ones are merged one by one.
TOGETHER = 48
#: Bytes of texts that are handled at once.
AT_ONCE = 1 << 21
_NONE = np.int64(1) << 40


class _Map:
    """int64 keys of at least 0 to int32 values: open addressing in two arrays, looked up many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.mask = (1 << max(4, (3 * len(keys)).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[rest[put]], values[rest[put]]
            left = np.ones(len(rest), bool)
            left[put] = False
            rest, slot = rest[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(40)) ^ (h >> np.uint64(20))).astype(np.int64) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            there = self.keys[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, ``size`` of them, one behind the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


class SpeculativeBpe:
    """Encoder and decoder for one byte-level vocabulary. ``stats`` counts words accepted and merged."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.place = np.cumsum(self.length) - self.length
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self._make_trie()
        self._make_pairs()
        self.pairs = np.zeros(0, np.int64)
        self.verdicts = np.zeros(0, bool)
        self._forget()
        self.stats = {"accepted": 0, "merged": 0}

    def _make_trie(self) -> None:
        """Nodes 0 to 255 are the first bytes."""
        nodes: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        edges, targets = [], []
        for token in self.ranks:
            for k in range(2, len(token) + 1):
                if token[:k] not in nodes:
                    nodes[token[:k]] = len(nodes)
                    edges.append(nodes[token[: k - 1]] << 8 | token[k - 1])
                    targets.append(nodes[token[:k]])
        self.trie = _Map(np.array(edges, np.int64), np.array(targets, np.int32))
        self.token_at = np.fromiter((self.ranks.get(prefix, -1) for prefix in nodes), np.int64, len(nodes))

    def _make_pairs(self) -> None:
        """Pairs of tokens that merge, to what they merge to."""
        ranks, keys, values = self.ranks, [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.merges = _Map(np.array(keys, np.int64), np.array(values, np.int32))

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.exact: dict[str, int] = {}  # of parts as they are, where ``memo`` has parts behind a space
        self.size, self.filled, self.held = 0, 0, 0
        self.tokens, self.starts, self.counts = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def greedy(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from the left in each word data[first:end], all at once: (tokens, their number in each word)."""
        word, at = np.arange(len(first)), first.copy()
        owners, found = [], []
        while len(word):
            node = data[at].astype(np.int64)
            best, step = self.byte_rank[node], np.ones(len(word), np.int64)
            go_on, depth = np.flatnonzero(at + 1 < end[word]), 1
            node = node[go_on]
            while len(go_on):
                node = self.trie.get(node << 8 | data[at[go_on] + depth]).astype(np.int64)
                depth += 1
                alive = node >= 0
                go_on, node = go_on[alive], node[alive]
                token = self.token_at[node]
                is_token = token >= 0
                best[go_on[is_token]], step[go_on[is_token]] = token[is_token], depth
                alive = at[go_on] + depth < end[word[go_on]]
                go_on, node = go_on[alive], node[alive]
            owners.append(word)
            found.append(best)
            at = at + step
            left = at < end[word]
            word, at = word[left], at[left]
        owner = np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.argsort(owner, kind="stable")  # turns are in order
        return np.concatenate([np.zeros(0, np.int64), *found])[order], np.bincount(owner, minlength=len(first))

    def merge_all(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of each word data[first:end]: (tokens, their number in each word)."""
        size = end - first
        counts, parts = np.zeros(len(first), np.int64), [np.zeros(0, np.int64)] * len(first)
        for k in np.flatnonzero(size > TOGETHER).tolist():
            parts[k] = np.array(self.merge(data[first[k] : end[k]].tobytes()), np.int64)
            counts[k] = len(parts[k])
        owners, found = [np.repeat(np.arange(len(first)), counts)], [np.concatenate([np.zeros(0, np.int64), *parts])]
        short = np.flatnonzero(size <= TOGETHER)
        short = short[np.argsort(size[short], kind="stable")]
        for group in np.array_split(short, max(1, len(short) // 4096)):  # of about one length
            if len(group):
                rows, tokens = self._merge_together(data, first[group], size[group])
                owners.append(group[rows])
                found.append(tokens)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(found)[order], np.bincount(owner, minlength=len(first))

    def _merge_together(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, token) of words of at most TOGETHER bytes; each turn merges the pair of lowest rank in every row, the leftmost of equal ones."""
        width = int(size.max())
        column = np.arange(width)
        inside = column[None, :] < size[:, None]
        ids = np.full((len(first), width + 2), -1, np.int64)
        ids[:, :width] = np.where(inside, self.byte_rank[data[np.minimum(first[:, None] + column[None, :], len(data) - 1)]], -1)
        rank = np.full((len(first), width + 1), _NONE)
        rank[:, :width] = self._ranks(ids[:, :width], ids[:, 1 : width + 1])
        done, row = np.full((len(first), width), -1, np.int64), np.arange(len(first))
        while len(row):
            low = rank.argmin(axis=1)
            lowest = rank[np.arange(len(row)), low]
            finished = lowest >= _NONE
            if finished.any():
                done[row[finished]] = ids[finished, :width]
                row, ids, rank, low, lowest = (x[~finished] for x in (row, ids, rank, low, lowest))
                if not len(row):
                    break
            k = np.arange(len(row))
            behind = np.arange(ids.shape[1] - 1)[None, :] > low[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(behind[:, : rank.shape[1] - 1], rank[:, 1:], rank[:, :-1])
            ids[k, low] = lowest
            rank[k, low] = self._ranks(lowest, ids[k, low + 1])
            before = np.maximum(low - 1, 0)
            rank[k, before] = np.where(low > 0, self._ranks(ids[k, before], ids[k, before + 1]), rank[k, before])
        at = np.nonzero(done >= 0)
        return at[0], done[at]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What the pairs merge to, _NONE where they don't (-1 is no token)."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        out = np.full(len(left), _NONE)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        found = self.merges.get(left[at] << 32 | right[at])
        out[at] = np.where(found >= 0, found, _NONE)
        return out.reshape(shape)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the adjacent pair of lowest rank first, the leftmost of equal ones; O(n log n)."""
        ranks, n = self.ranks, len(word)
        if word in ranks:
            return [ranks[word]]
        if n <= 128:  # min() and index() of a short list are faster than a heap
            get, none = ranks.get, 1 << 30
            cut = list(range(n + 1))
            rank = [get(word[i : i + 2], none) for i in range(n - 1)]
            while rank and (low := min(rank)) < none:
                i = rank.index(low)
                del cut[i + 1], rank[i]
                if i < len(rank):
                    rank[i] = get(word[cut[i] : cut[i + 2]], none)
                if i:
                    rank[i - 1] = get(word[cut[i - 1] : cut[i + 1]], none)
            return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(word[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def compatible(self, packed: np.ndarray) -> np.ndarray:
        """Verdict of each packed pair (left * 2^32 + right)."""
        if not len(packed):
            return np.zeros(0, bool)
        asked, back = np.unique(packed, return_inverse=True)
        at = np.searchsorted(self.pairs, asked)
        known = np.zeros(len(asked), bool)
        if len(self.pairs):
            known = self.pairs[np.minimum(at, len(self.pairs) - 1)] == asked
        new = asked[~known]
        if len(new):
            left, right = new >> 32, new & 0xFFFFFFFF
            tokens = np.stack([left, right], axis=1).ravel()
            size = self.length[left] + self.length[right]
            end = np.cumsum(size)
            merged, counts = self.merge_all(self._bytes(tokens), end - size, end)
            at = np.cumsum(counts) - counts
            second = merged[np.minimum(at + 1, len(merged) - 1)]
            decided = (counts == 2) & (merged[at] == left) & (second == right)
            pairs = np.concatenate([self.pairs, new])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.verdicts = pairs[order], np.concatenate([self.verdicts, decided])[order]
        return self.verdicts[np.searchsorted(self.pairs, asked)][back]

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.blob[_spread(self.place[ids], self.length[ids])]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, their number in each word) of words that are not empty."""
        data, size = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        flat, counts = self.greedy(data, end - size, end)
        owner = np.repeat(np.arange(len(words)), counts)
        adjacent = np.flatnonzero(owner[1:] == owner[:-1])
        bad = adjacent[~self.compatible((flat[adjacent] << 32) | flat[adjacent + 1])]
        failing = np.unique(owner[bad])
        self.stats["merged"] += len(failing)
        self.stats["accepted"] += len(words) - len(failing)
        if not len(failing):
            return flat, counts
        merged, n = self.merge_all(data, end[failing] - size[failing], end[failing])
        wrong = np.zeros(len(words), bool)
        wrong[failing] = True
        kept = flat[~wrong[owner]]
        first = np.where(wrong, 0, np.cumsum(np.where(wrong, 0, counts)) - counts)
        counts[failing] = n
        first[failing] = len(kept) + np.cumsum(n) - n
        return np.concatenate([kept, merged])[_spread(first, counts)], counts

    def _chunks(self, text: str) -> tuple[list[str], list[str]]:
        """Parts of a text that the pattern splits alike alone and in place: (some as they are, then those behind a space, if they don't begin a line)."""
        if _UNSAFE.search(text):
            return _SPLIT.findall(text), []
        parts = text.replace("\n", " \n").split(" ")
        if len(parts) > 1 and not parts[0]:
            return [], parts[1:]
        return parts[:1], parts[1:]

    def _remember(self, memo: dict[str, int], chunks: list[str], keys: list[str]) -> None:
        """Encode chunks that aren't known and keep them under their keys."""
        words = [[c] if c.isascii() and c[c[:1] == " " :].isalpha() else _SPLIT.findall(c) for c in chunks]
        flat = list(dict.fromkeys(chain.from_iterable(words)))
        tokens, counts = self.encode_words([w.encode() for w in flat]) if flat else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        number = dict(zip(flat, range(len(flat))))
        index = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64)
        owner = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, words), np.int64, len(words)))
        place = np.cumsum(counts) - counts
        tokens, counts = tokens[_spread(place[index], counts[index])], np.bincount(owner, weights=counts[index], minlength=len(chunks)).astype(np.int64)
        self.tokens = _room(self.tokens, self.filled + len(tokens))
        self.starts, self.counts = _room(self.starts, self.size + len(keys)), _room(self.counts, self.size + len(keys))
        self.tokens[self.filled : self.filled + len(tokens)] = tokens
        self.starts[self.size : self.size + len(keys)] = self.filled + np.cumsum(counts) - counts
        self.counts[self.size : self.size + len(keys)] = counts
        memo.update(zip(keys, range(self.size, self.size + len(keys))))
        self.size += len(keys)
        self.filled += len(tokens)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, int32, their number in each text)."""
        if self.held > MEMO_BYTES:
            self._forget()
        chunked = [self._chunks(t) for t in texts]
        long: list[tuple[dict[str, int], list[str]]] = []
        for memo, side in ((self.exact, 0), (self.memo, 1)):
            new = set(chain.from_iterable(c[side] for c in chunked)).difference(memo)
            if new:
                ordered = sorted(new, key=lambda k: len(k) > MEMO_CHARS)
                long.append((memo, [k for k in ordered if len(k) > MEMO_CHARS]))
                self._remember(memo, ordered if side == 0 else [k if k[:1] == "\n" else " " + k for k in ordered], ordered)
                self.held += sum(map(len, ordered)) + 160 * len(ordered)
        sizes = [[len(c[0]), len(c[1])] for c in chunked]
        index = np.fromiter(chain.from_iterable(chain(map(self.exact.__getitem__, c[0]), map(self.memo.__getitem__, c[1])) for c in chunked), np.int64)
        owner = np.repeat(np.arange(len(texts)), np.array(sizes, np.int64).reshape(-1, 2).sum(axis=1))
        counts = self.counts[index]
        flat = self.tokens[_spread(self.starts[index], counts)]
        for memo, keys in long:  # their tokens stay until the memo starts again
            for k in keys:
                del memo[k]
            self.held += 3 * sum(map(len, keys))
        return flat, np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, int32."""
        flat, counts = self.encode_flat(texts)
        return np.split(flat, np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return self._bytes(np.asarray(ids, np.int64)).tobytes()

    def round_trips(self, flat: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Whether the decoded ids of each text are its bytes."""
        ends = np.cumsum(counts)
        size = np.add.reduceat(np.append(self.length[flat], 0), np.minimum(ends - counts, len(flat))) * (counts > 0)
        ok = size == np.fromiter(map(len, texts), np.int64, len(texts))
        if not ok.all():  # compared one by one, as the bytes don't stand in one place
            return np.array([self.decode(flat[e - n : e]) == t for e, n, t in zip(ends.tolist(), counts.tolist(), texts)])
        want, begin = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
        at = 0
        for a in range(0, len(flat), AT_ONCE):
            got = self._bytes(flat[a : a + AT_ONCE])
            differ = np.flatnonzero(got != want[at : at + len(got)]) + at
            ok[np.searchsorted(begin, differ, "right") - 1] = False
            at += len(got)
        return ok


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` or a longer copy with room for n values."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


_ENCODERS: dict[bytes, SpeculativeBpe] = {}


def encoder(raw: bytes) -> SpeculativeBpe:
    """One encoder for each vocabulary in a worker, with what it learned of words and pairs."""
    if raw not in _ENCODERS:
        _ENCODERS[raw] = SpeculativeBpe(vocabulary.ranks(raw))
    return _ENCODERS[raw]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with texts of about AT_ONCE bytes together; one at least."""
    size = np.cumsum(np.append(0, np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))))
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(size, size[first] + AT_ONCE, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def encode_decode(docs: DataFrame, path: str = vocabulary.DEFAULT_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, token_ids, n_tokens, round_trip`` for each row of docs.

    round_trip says whether decoding the ids gives the text's UTF-8 bytes. A null text has null ids and
    counts; an empty text has no tokens and a true round trip. Null and repeated ids are kept as they
    are, one row out for each row in; other columns are ignored, whatever their names. A narrow
    operation: no shuffle, and whole texts however long.
    """
    raw = vocabulary.send(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(raw.value)
        for batch in batches:
            for part in _slices(batch):
                texts = part.column(1).to_pylist()
                clean = [vocabulary.utf8_safe(t or "") for t in texts]
                flat, sizes = bpe.encode_flat(clean)
                none = np.array([t is None for t in texts])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(none, False))
                ok = bpe.round_trips(flat, sizes, [c.encode() for c in clean])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(sizes.astype(np.int32), mask=none), pa.array(ok, mask=none)], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
