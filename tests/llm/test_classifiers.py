import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillframe.llm import classifiers as C
from quillframe.llm.textblocks import LETTERS, blocks, word_hashes

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_words_equal_a_loop():
    texts = ["the cat  sat", "", None, "ünïcode wörds, here9there", "the cat", "\n\n"]
    got = []
    for _, _, data, offsets in blocks(pa.array(texts), True, limit=10):
        h, b = word_hashes(data, offsets, LETTERS)
        got += [h[x:y].tolist() for x, y in zip(b, b[1:])]
    assert [len(x) for x in got] == [3, 0, 0, 4, 2, 0]
    assert got[0][:2] == got[4] and len({h for x in got for h in x}) == 7


def held_out(docs, labels, rows):
    """Labels of one half, and the labelled rows of the other."""
    half = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)) == 0
    return labels.where(half), labels.where(~half).withColumnRenamed("quality", "q").withColumnRenamed("toxic", "t")


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    train, test = held_out(docs, labels, None)
    r = C.quality_scores(docs, train).join(test, "doc_id").groupBy("q").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {x.q: x.kept for x in r}
    assert kept[1] > 0.99 and kept[0] < 0.1


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    train, test = held_out(docs, labels, None)
    got = C.toxicity_grades(docs, train).join(test, "doc_id").collect()
    bad, clean = [x for x in got if x.t], [x for x in got if not x.t]
    assert np.mean([x.rejected for x in bad]) > 0.85 and np.mean([x.rejected for x in clean]) < 0.01
    assert np.mean([x.severity for x in bad]) > 10 * np.mean([x.severity for x in clean])
    assert all(0 <= x.grade <= C.GRADES and 0 <= x.severity <= C.GRADES for x in got)


def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(1)
    slots, grade = [], []
    for _ in range(600):
        k = int(rng.integers(0, 4))
        slots.append(np.unique(np.concatenate([rng.integers(100, 4000, 30), 10 + rng.permutation(10)[: 2 * k]])))
        grade.append(k)
    m = C.fit_ordinal(slots, np.array(grade))
    assert (np.diff(m.thresholds) >= 0).all() and len(m.thresholds) == 3
    p = m.at_least(np.concatenate(slots), np.concatenate([[0], np.cumsum([len(s) for s in slots])]))
    assert (np.diff(p, axis=1) <= 1e-12).all()
    assert np.corrcoef(p.sum(axis=1), grade)[0, 1] > 0.9


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    slots = [np.unique(rng.integers(0, 50, 8)) for _ in range(60)]
    y = np.array([int(s.min() < 5) for s in slots])
    counts = [rng.integers(1, 9, len(s)) for s in slots]
    m = C.ftrl(slots, counts, y, epochs=2, alpha=0.3, l2=0.1)
    z, n = {}, {}

    def weight(k):
        zk = z.get(k, 0.0)
        return 0.0 if abs(zk) <= 0.02 else -(zk - np.sign(zk) * 0.02) / ((1 + n.get(k, 0.0) ** 0.5) / 0.3 + 0.1)

    for _ in range(2):
        for s, c, t in zip(slots, counts, y):
            norm = sum((1 + np.log(v)) ** 2 for v in c) ** 0.5
            x = {**{int(k): (1 + np.log(v)) / norm for k, v in zip(s, c)}, "bias": 1.0}
            w = {k: weight(k) for k in x}
            e = 1 / (1 + np.exp(-sum(w[k] * x[k] for k in x))) - t
            for k in x:
                g = e * x[k]
                z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / 0.3 * w[k]
                n[k] = n.get(k, 0.0) + g * g
    assert np.allclose(m.weights[:50], [weight(k) for k in range(50)], atol=1e-6) and abs(m.bias - weight("bias")) < 1e-9


def test_odd_rows(spark, tables):
    _, labels = tables
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "null id"), (3, "same"), (3, "same"), (4, "long " * 100_000)], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("x")).withColumn("p", F.lit(1)).withColumn("label", F.lit(1))
    q = C.quality_scores(docs, labels).collect()
    assert len(q) == 6 and [x.score for x in q if x.doc_id == 1] == [None] and not [x.kept for x in q if x.doc_id == 1][0]
    t = C.toxicity_grades(docs, labels).collect()
    assert len(t) == 6 and [(x.severity, x.grade, x.rejected) for x in t if x.doc_id == 1] == [(None, None, False)]
    assert C.keep_clean(docs, labels).columns == docs.columns and C.keep_clean(docs, labels).where("doc_id = 1").count() == 1
    assert C.keep_good(docs, labels).where("doc_id = 1").count() == 0
    empty = docs.limit(0)
    assert C.quality_scores(empty, labels).count() == 0 and C.toxicity_grades(empty, labels.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(x.kept for x in C.quality_scores(docs.where("text is not null"), none).collect())
    assert not any(x.rejected for x in C.toxicity_grades(docs, none).collect())


def test_grades_that_are_given_are_used():
    assert C.severity_grades([np.array([1])] * 4, np.array([0, 1, 2, 4])).tolist() == [0, 1, 2, 4]


def test_labels_over_one_are_grades_however_few_values_there_are(spark):
    slots = [np.array([1])] * 3
    assert C.severity_grades(slots, np.array([0, 2, 2])).tolist() == [0, 2, 2]
    assert C.severity_grades(slots, np.array([1, 3, 3])).tolist() == [1, 3, 3]
    assert C.severity_grades(slots, np.array([0, -1, 0]), graded=True).tolist() == [0, 0, 0]
    words = ["calm water", "rude words here", "vile awful words", "calm sky"]
    docs = spark.createDataFrame([(k, f"{words[k % 4]} {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, [0, 1, 3, 0][k % 4]) for k in range(200)], "doc_id long, toxic int")
    got = C.toxicity_grades(docs, labels).collect()
    assert all(r.grade == [0, 1, 3, 0][r.doc_id % 4] and r.rejected == (r.grade > 0) for r in got)


def test_ordinal_fit_equals_a_plain_loop():
    rng = np.random.default_rng(6)
    grade = rng.integers(0, 4, 80)
    slots = [np.unique(np.concatenate([rng.integers(20, 60, 6), rng.permutation(8)[: 2 * g]])) for g in grade.tolist()]
    alpha, beta, l1, least, steps = 0.5, 1.0, 0.3, 0.2, 240
    m = C.fit_ordinal(slots, grade, steps=steps, alpha=alpha, beta=beta, l1=l1, least_odds=least)
    bad = [g > 0 for g in grade.tolist()]
    told = set()
    for f in {f for s in slots for f in s.tolist()}:
        pos, neg = sum(b and f in s for s, b in zip(slots, bad)), sum(not b and f in s for s, b in zip(slots, bad))
        odds = np.log((pos + 0.5) / (sum(bad) - pos + 0.5)) - np.log((neg + 0.5) / (len(bad) - sum(bad) - neg + 0.5))
        told |= {f} if abs(odds) >= least else set()
    shares = [np.mean(grade >= k) for k in (1, 2, 3)]
    theta, z, n, pulled = [float(-np.log(p / (1 - p)) + 1e-3 * k) for k, p in enumerate(shares)], {}, {}, [1.0] * 3
    theta = [max(theta[: k + 1]) for k in range(3)]

    def weight(f):
        zf = z.get(f, 0.0)
        return 0.0 if abs(zf) <= l1 else -(zf - np.sign(zf) * l1) / ((beta + n.get(f, 0.0) ** 0.5) / alpha)

    for _ in range(-(-steps // len(slots))):
        for s, y in zip(slots, grade.tolist()):
            own = [f for f in s.tolist() if f in told]
            total, w = sum(map(weight, own)), {f: weight(f) for f in own}
            p = [1 / (1 + np.exp(-(total - t))) for t in theta]
            pull = [0.0] * 3
            if y > 0:
                pull[y - 1] = p[y - 1] - 1
            if y < 3:
                pull[y] = p[y]
            g = sum(pull)
            for f in own:
                sigma = ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / alpha
                z[f], n[f] = z.get(f, 0.0) + g - sigma * w[f], n.get(f, 0.0) + g * g
            pulled = [a + b * b for a, b in zip(pulled, pull)]
            theta = [t + 0.3 * a / b**0.5 for t, a, b in zip(theta, pull, pulled)]
            theta = [max(theta[: k + 1]) for k in range(3)]
    assert np.allclose(m.thresholds, theta, atol=1e-8)
    assert np.allclose([m.weights[f] for f in range(60)], [weight(f) if f in told else 0.0 for f in range(60)], atol=1e-5) and np.abs(m.weights).max() > 0.1
