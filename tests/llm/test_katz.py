import math
import os
import random
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import katz as K
from quillframe.llm import vocabulary

RAW = open(vocabulary.DEFAULT_PATH, "rb").read()
SIZE = len(vocabulary.token_lengths(RAW))


class Plain:
    """Katz backoff of order 3 by its definition, with dictionaries."""

    def __init__(self, sequences, size):
        self.size, bos = size, size
        self.c = [Counter(), Counter(), Counter()]
        for s in sequences:
            p = [bos, bos, *s]
            for k in range(2, len(p)):
                self.c[0][(p[k],)] += 1
                self.c[1][(p[k - 1], p[k])] += 1
                self.c[2][(p[k - 2], p[k - 1], p[k])] += 1
        self.follow = [defaultdict(list) for _ in range(3)]
        for o in (0, 1, 2):
            for g in self.c[o]:
                self.follow[o][g[:-1]].append(g)
        self.d = []
        for o in (0, 1, 2):
            n = Counter(self.c[o].values())
            self.d.append(K.discounts(np.array([n.get(r, 0) for r in range(K.CUT + 2)])))
        self.memo = {}

    def discounted(self, o, g):
        r = self.c[o][g]
        return (self.d[o][r] if r <= K.CUT else 1.0) * r

    def context(self, o, h):
        if (o, h) not in self.memo:
            seen = self.follow[o][h]
            total = sum(self.c[o][g] for g in seen)
            mass = sum(self.discounted(o, g) for g in seen)
            total += mass >= total * (1 - 1e-12)
            lower = sum(self.p(o - 1, g[1:]) for g in seen) if o else len(seen) / self.size
            left = 1 - mass / total
            self.memo[o, h] = (total, left / (1 - lower)) if o else (total, left / max(self.size - len(seen), 1))
        return self.memo[o, h]

    def p(self, o, g):
        if g in self.c[o]:
            return self.discounted(o, g) / self.context(o, g[:-1])[0]
        if o == 0:
            return self.context(0, ())[1]
        weight = self.context(o, g[:-1])[1] if self.follow[o][g[:-1]] else 1.0
        return weight * self.p(o - 1, g[1:])

    def logprob(self, s):
        p = [self.size, self.size, *s]
        return sum(math.log(self.p(2, tuple(p[k - 2 : k + 1]))) for k in range(2, len(p)))


def sample(spark, n, seed):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 3000").orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(n)
    return docs.select("doc_id", "text")


@pytest.mark.parametrize("partition_tokens", [3_000, 10**9])
def test_scores_equal_the_definition(spark, partition_tokens):
    train, other = sample(spark, 60, 1).cache(), sample(spark, 25, 2)
    e = vocabulary.encoding(RAW)
    plain = Plain([e.encode_ordinary(r.text) for r in train.collect()], SIZE)
    for docs, fitted in ((train, None), (other, train)):
        got = K.score(docs, fitted, partition_tokens=partition_tokens).collect()
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert len(got) == len(texts)
        for r in got:
            ids = e.encode_ordinary(texts[r.doc_id])
            assert r.n_tokens == len(ids) and abs(r.logprob - plain.logprob(ids)) < 1e-4
            assert abs(math.log(r.perplexity) + r.logprob / len(ids)) < 1e-6


def test_every_context_adds_up_to_one(spark):
    raw = vocabulary.send(spark)
    tokens = K.shared.table(K.encode(sample(spark, 40, 3), raw, "doc_id", "text"), "tokens")
    model = K.fit(tokens, SIZE, 5_000)
    assert abs(model.start.value.sum() - 1) < 1e-9
    table = model.tables.toArrow()
    rng = random.Random(1)
    for q in set(table.column("q").to_pylist()):
        own = table.filter(K.pa.compute.equal(table.column("q"), q))
        part = K.Part(own, model.start.value)
        w = np.arange(SIZE)
        for context in rng.sample(part.maps["a3"][0].tolist(), min(5, len(part.maps["a3"][0]))) + [5 << K.SHIFT | v for v in part.maps["a2"][0].tolist()[:2]]:
            assert abs(np.exp(part.three((context << K.SHIFT) | w)).sum() - 1) < 1e-6


def test_frequent_tokens_are_spread():
    counts = np.array([1000, 10, 10, 1])
    layout = K.Layout(50, np.maximum(1, np.ceil(2 * counts * 50 / counts.sum())).astype(np.int64))
    u = np.arange(2000)
    q = layout.of((u << (2 * K.SHIFT)) | (0 << K.SHIFT) | 1)
    assert len(set(q.tolist())) > 25 and len(set(layout.of((u << (2 * K.SHIFT)) | (3 << K.SHIFT) | 1).tolist())) == 1


def test_contexts_without_discount_and_full_ones():
    p, c, a = K.context_model(np.array([1, 1, 2, 2]), np.array([50, 70, 1, 9]), np.array([0.2, 0.3, 0.5, 0.5]), K.discounts(np.array([0, 9, 4, 2, 1, 1, 1])))
    assert abs(p[0] + p[1] + a[0] * 0.5 - 1) < 1e-12 and a[0] > 0
    assert abs(p[2] + p[3] - 1) < 1e-12 and a[1] == 0 and c.tolist() == [1, 2]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "null id"), (3, "same text"), (3, "same text"), (4, "very long text " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("logprob", F.lit("x")).withColumn("ref", F.lit(1))
    got = K.score(docs).collect()
    assert len(got) == 6
    assert [(r.n_tokens, r.logprob, r.perplexity) for r in got if r.doc_id == 1] == [(None, None, None)]
    assert [(r.n_tokens, r.logprob, r.perplexity) for r in got if r.doc_id == 2] == [(0, 0.0, None)]
    assert len({r.logprob for r in got if r.doc_id == 3}) == 1
    assert K.score(docs.limit(0)).count() == 0
    empty = K.score(docs.where("doc_id = 3"), docs.limit(0)).collect()
    assert all(abs(r.perplexity - SIZE) < 1e-3 for r in empty)


def test_hot_contexts_are_copied_and_their_questions_spread(spark):
    raw = vocabulary.send(spark)
    tokens = K.shared.table(K.encode(sample(spark, 300, 4), raw, "doc_id", "text"), "tokens")
    model = K.fit(tokens, SIZE, 2_000)
    layout = model.layout
    assert len(layout.hot) > 3 and layout.copies.max() > 1
    assert layout.where_hot(np.append(layout.hot, 5 << K.SHIFT | 7)).tolist() == [*range(len(layout.hot)), -1]
    for context, n in zip(layout.hot.tolist(), layout.copies.tolist()):
        assert len({int(layout.to_ask(np.array([context << K.SHIFT | 3]), k)[0]) for k in range(50)}) == n
    want = {r.ref: r.logprob for r in K.score_tokens(tokens, K.fit(tokens, SIZE, 10**9)).collect()}
    got = {r.ref: r.logprob for r in K.score_tokens(tokens, model).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_tables_are_written_by_the_workers(spark, monkeypatch):
    """Hadoop would start three processes for each task, each of which counts as its executor's memory again."""
    made, made_in = [], K.shared.made

    def kept(*args):
        made.append(made_in(*args))
        return made[-1]

    monkeypatch.setattr(K.shared, "made", kept)
    monkeypatch.setattr(K.shared, "table", lambda *args: pytest.fail("written by Hadoop"))
    docs = sample(spark, 60, 5)
    got = K.score(docs, partition_tokens=3_000)
    assert got.count() == docs.count() and len(made) == 4
    for df in made:
        folders = {os.path.dirname(urlsplit(f).path) for f in df.inputFiles()}
        assert len(folders) == 1 and all(f.startswith("part-") and f.endswith(".parquet") for f in os.listdir(folders.pop()))


def test_made_tables_hold_what_ended_once(spark):
    def run(batches):
        for batch in batches:
            yield batch.slice(0, 0)
            for k in range(len(batch)):
                yield batch.slice(k, 1)

    def half(batches):
        yield next(batches)
        raise ValueError("half of it")

    rows = spark.range(0, 1000, 1, 7).withColumn("b", F.col("id").cast("string").cast("binary"))
    got = K.shared.made(rows, run, "id long, b binary", "whole")
    assert got.dtypes == rows.dtypes
    assert sorted((r.id, bytes(r.b)) for r in got.collect()) == [(k, str(k).encode()) for k in range(1000)]
    assert K.shared.made(rows.limit(0), run, "id long, b binary", "none").count() == 0
    before = set(os.listdir(folder := urlsplit(K.shared.folder(spark)).path))
    with pytest.raises(Exception, match="half of it"):
        K.shared.made(rows, half, "id long, b binary", "half")
    assert not [f for x in set(os.listdir(folder)) - before for f in os.listdir(os.path.join(folder, x)) if f[0] not in "_."]
    path = os.path.join(urlsplit(got.inputFiles()[0]).path.rpartition("/")[0], "_left-by-a-lost-task.parquet")
    with open(path, "wb") as f:
        f.write(b"PAR1")
    assert spark.read.parquet(os.path.dirname(path)).count() == 1000
