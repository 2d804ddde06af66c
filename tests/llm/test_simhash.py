import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import simhash as S
from quillframe.llm.components import components


def union(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7), (None, 3)]
    want = union((a, b) for a, b in pairs if a is not None and a != b)
    got = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_chains_lose_nothing_within_the_distance():
    rng = np.random.default_rng(1)
    for distance in (0, 3, 20):
        one = rng.integers(0, 1 << 63, (2000, 2)).astype(np.uint64)
        bits = np.unpackbits(one.view(np.uint8), axis=1)
        for k in range(2000):
            bits[k, rng.choice(128, rng.integers(0, distance + 6), replace=False)] ^= 1
        other = np.packbits(bits, axis=1).view(np.uint64)
        exact = np.bitwise_count(one ^ other).sum(axis=1) <= distance
        assert (S.near(one, other, distance) == exact).all() and exact.any() and not exact.all()


@pytest.mark.parametrize("n", [1000, 100_000, 1_000_000, 10_000_000])
def test_tables_reach_the_recall_at_the_full_distance(n):
    tables = S.tables_for(n)
    rng = np.random.default_rng(8)
    apart = np.argsort(rng.random((8000, S.BITS)), axis=1)[:, : S.DISTANCE]
    differ = np.zeros((8000, S.BITS), bool)
    np.put_along_axis(differ, apart, True, axis=1)
    found = np.any([~differ[:, places].any(axis=1) for places in tables], axis=0).mean()
    w = len(tables[0])
    assert found >= S.RECALL - 0.015
    assert (1 - math.comb(S.BITS - S.DISTANCE, w) / math.comb(S.BITS, w)) ** len(tables) <= 1 - S.RECALL + 1e-9


def test_small_and_large_buckets_connect_alike():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, (3, 2)).astype(np.uint64)
    bits = np.unpackbits(centre.view(np.uint8), axis=1)[rng.integers(0, 3, 300)]
    for row in bits:
        row[rng.choice(128, 8, replace=False)] ^= 1
    sig, ids = np.packbits(bits, axis=1).view(np.uint64), np.arange(300)
    brute = union((a, b) for a in range(300) for b in range(a) if S.near(sig[a][None], sig[b][None], 20)[0])
    for keys in (np.zeros(300, np.int64),):
        assert union(zip(*(x.tolist() for x in S.bucket_edges(sig, ids, keys, 20)))) == brute
    split = np.sort(np.arange(300) % 6)
    got = set(map(tuple, np.stack(S.bucket_edges(sig, ids, split, 20), axis=1).tolist()))
    assert got == {(b, a) for a in range(300) for b in range(a) if split[a] == split[b] and S.near(sig[a][None], sig[b][None], 20)[0]}


def test_signature_equals_a_loop(spark):
    import pyarrow as pa

    texts = ["the cat sat on the mat", "", "Word word WORD other", "x " * 200_000 + "last one here", None]
    for limit in (1, 1 << 20):
        found = []
        for _, _, data, offsets in S.blocks(pa.array(texts), True, limit):
            sig, n = S.signatures_of(data, offsets)
            words, b = S.word_hashes(data, offsets, S.LETTERS)
            for k in range(len(n)):
                own = sorted(set(words[b[k] : b[k + 1]].tolist()))
                assert len(own) == n[k]
                h = S.mix64(np.array(own, np.uint64))
                votes = [0] * 128
                for two in np.stack([h, S.mix64(h ^ np.uint64(S.SEED))], axis=1):
                    for j, bit in enumerate(np.unpackbits(two.view(np.uint8))):
                        votes[j] += 1 if bit else -1
                assert np.unpackbits(sig[k].view(np.uint8)).tolist() == [int(v > 0) for v in votes]
                found.append(n[k])
        assert found == [5, 0, 2, 4, 0]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


def test_recall_against_brute_force(spark, documents):
    sig = S.signatures(documents).where("high is not null").groupBy("high", "low").agg(F.min("doc_id").alias("rep")).toPandas()
    x, ids = sig[["high", "low"]].to_numpy().view(np.uint64), sig.rep.to_numpy()
    x = np.ascontiguousarray(x)
    pairs = []
    for k in range(len(x)):
        d = np.bitwise_count(x[k] ^ x[k + 1 :]).sum(axis=1)
        pairs += [(ids[k], ids[k + 1 + j]) for j in np.flatnonzero(d <= S.DISTANCE)]
    want = union(pairs)
    edges = [(r.u, r.v) for r in S.near_edges(spark.createDataFrame(sig)).distinct().collect()]
    assert set(edges) | {(b, a) for a, b in edges} <= {q for a, b in pairs for q in ((a, b), (b, a))}
    got = union(edges)
    together = sum(got.get(a) == got.get(b) and a in got for a, b in pairs)
    assert len(pairs) > 100 and together / len(pairs) >= 0.97
    assert want


def test_planted_copies(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows, group = [], {}
    for g in range(120):
        base = [rng.choice(words) for _ in range(rng.randrange(80, 400))]
        for c in range(rng.choice([1, 1, 2, 3])):
            copy = [rng.choice(words) if c and rng.random() < 0.04 else w for w in base]
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    out = {r.doc_id: (r.group_id, r.kept) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    members = defaultdict(set)
    for i, g in group.items():
        members[g].add(out[i][0])
    assert len(out) == len(rows) and sum(len(m) > 1 for m in members.values()) <= 3
    assert len({x for m in members.values() for x in m}) >= 120  # no two groups fall together


def test_odd_rows(spark):
    same = "some words that are said again and again in the same order"
    rows = [(1, None), (2, ""), (3, ""), (None, same), (None, same), (4, same), (5, same.upper()), (5, same), (6, same + "!"), (7, "wholly different matter " * 50_000), (8, "... 123")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x")).withColumn("group_id", F.lit(1.5)).withColumn("high", F.lit(0))
    out = sorted((r.doc_id, r.group_id, r.kept) for r in S.near_duplicates(docs).collect())
    assert out == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 4, False), (7, 7, True), (8, 8, True)]
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 7, 8] and kept.where("doc_id is null").count() == 2
    assert sorted(r.doc_id for r in S.keep_one(docs.where("doc_id = 5").unionByName(docs.where("doc_id = 7"))).collect()) == [5, 7]
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.keep_one(docs.limit(0)).count() == 0


def test_numbers_symbols_and_unspaced_scripts(spark):
    rng = random.Random(6)
    han = "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(600))
    near = "".join(chr(rng.randrange(0x4E00, 0x5200)) if k % 60 == 7 else c for k, c in enumerate(han))
    other = "".join(rng.sample(han, len(han)))  # the same characters in another order
    numbers = ["; ".join(str(rng.randrange(10**6)) for _ in range(50)) for _ in range(2)]
    texts = ["invoice 1001 total 55", "invoice 2002 total 99", numbers[0], numbers[1], numbers[0], "!!! ???", "!!! ???", "***", han, near, other, "\u3002\u3001", "\u3002\u3001", "\U0001f600"]
    out = {r.doc_id: r.group_id for r in S.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11, 12: 11, 13: 13}
