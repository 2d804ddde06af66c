import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillframe.llm import decontamination as D
from quillframe.llm import winnowing as W

SF = "/root/testdata/sf0.001"


def brute(text, gram, window):
    """Winnowing by its definition."""
    kept = [(k, c) for k, c in enumerate(text) if ord(c) not in W.SPACES]
    hashes = []
    for i in range(len(kept) - gram + 1):
        h = 0
        for _, c in kept[i : i + gram]:
            h = (h * W.BASE + ord(c) + 1) % W.PRIME
        hashes.append((h, kept[i][0]))
    out = set()
    for i in range(max(len(hashes) - window + 1, min(len(hashes), 1))):
        out.add(min(hashes[i : i + window], key=lambda x: (x[0], -x[1])))
    return {(p, h) for h, p in out}


@pytest.mark.parametrize("gram,window", [(1, 1), (3, 4), (5, 7), (8, 8), (32, 100)])
def test_winnowing_equals_its_definition(gram, window):
    rng = random.Random(gram)
    texts = ["", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " \n ", "ünï çö日本" * 40] + ["".join(rng.choice("ab c\n") for _ in range(rng.randrange(0, 400))) for _ in range(20)]
    codes = np.array([ord(c) for t in texts for c in t], np.uint32)
    doc, pos, h = W.winnow(codes, np.cumsum([len(t) for t in texts]), gram, window)
    for k, t in enumerate(texts):
        rows = list(zip(pos[doc == k].tolist(), h[doc == k].tolist()))
        assert len(rows) == len(set(rows)) and set(rows) == brute(t, gram, window)


def test_fingerprints_equal_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as from '{SF}/documents.parquet'")
    want = sorted(con.sql(W.sql()).fetchall())
    assert sorted(map(tuple, W.fingerprints(docs).select("doc_id", "position", "hash").collect())) == want and len(want) > 1000


def test_shared_passage_is_found(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(220))
    rows = [(k, "".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(900))) + passage.upper() + "zz" * k) for k in range(5)]
    out = W.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("hash").agg(F.count_distinct("doc_id").alias("n")).where("n = 5")
    assert out.count() >= 1


def test_every_shared_passage_of_the_guarantee_is_found():
    rng = random.Random(12)
    size = W.GRAM + W.WINDOW - 1
    assert size <= 67
    for _ in range(200):
        passage = "".join(rng.choice("abcdefgh") for _ in range(size))
        texts = ["".join(rng.choice("ijklmnop") for _ in range(rng.randrange(200))) + passage + "".join(rng.choice("qrstuv") for _ in range(rng.randrange(200))) for _ in range(2)]
        doc, _, h = W.winnow(np.array([ord(c) for t in texts for c in t], np.uint32), np.cumsum([len(t) for t in texts]))
        assert set(h[doc == 0].tolist()) & set(h[doc == 1].tolist())


def test_fingerprints_of_odd_rows(spark):
    long = "some long text without end " * 40_000
    rows = [(1, None), (2, ""), (3, "too short"), (None, long[:500]), (4, long), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("x")).withColumn("position", F.lit("y"))
    got = W.fingerprints(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in got} == {None, 4} and {r["count"] % 2 for r in got if r.doc_id == 4} == {0}
    assert W.fingerprints(docs.limit(0)).count() == 0


def edit(rng, words, rate, pool):
    out = list(words)
    for _ in range(int(rate * len(words))):
        k, what = rng.randrange(len(out)), rng.random()
        if what < 0.4:
            out[k] = rng.choice(pool)
        elif what < 0.7:
            del out[k]
        else:
            out.insert(k, rng.choice(pool))
    return out


def distance_to_part(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_recall_against_brute_force(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmnop"
    pool = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    pool += ["the", "of", "and"] * 150
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(12, 60)))) for k in range(60)]
    docs = []
    for k in range(150):
        words = [rng.choice(pool) for _ in range(rng.randrange(20, 200))]
        if k % 2:
            at = rng.randrange(len(words))
            words[at:at] = edit(rng, rng.choice(items)[1].split(), rng.choice([0, 0.05, 0.1, 0.15]), pool)
        docs.append((k, " ".join(words).capitalize()))
    out = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slice_items=25)
    got = {(r.doc_id, r.item_id): r.edits for r in out.collect()}
    want = {}
    for i, t in docs:
        for j, x in items:
            d = distance_to_part(x.split(), t.lower().split())
            if d <= int(D.EDIT_RATE * len(x.split())):
                want[i, j] = d
    assert set(got) <= set(want) and len(want) > 60
    assert len(got) / len(want) >= 0.95
    assert all(got[p] == want[p] for p in got if want[p] == 0)


@pytest.mark.parametrize("length", [5, 7, 12, 20, 40, 60, 100, 150, 200])
def test_every_item_at_its_most_edits_is_found(length):
    rng = random.Random(length)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    items = [[rng.choice(pool) for _ in range(length)] for _ in range(40)]
    texts = []
    for item in items:
        while True:
            copy = list(item)
            for k in rng.sample(range(length), int(D.EDIT_RATE * length)):
                copy[k] = rng.choice([rng.choice(pool), "", copy[k] + " " + rng.choice(pool)])
            copy = " ".join(copy).split()
            if distance_to_part(item, copy) == int(D.EDIT_RATE * length):
                break
        texts.append(" ".join([rng.choice(pool) for _ in range(rng.randrange(30))] + copy + [rng.choice(pool) for _ in range(rng.randrange(30))]))
    made = D.prepare([(k, " ".join(x)) for k, x in enumerate(items)])
    found = {(first + d, k): e for first, _, data, offsets in D.blocks(pa.array(texts), True) for d, k, e, _ in D.matches(data, offsets, made)}
    assert [found.get((k, k), 99) <= int(D.EDIT_RATE * length) for k in range(len(items))] == [True] * len(items)


def test_decontamination_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from it all"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "with no id but many words to match here"), (4, "too short"), (5, item)], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    rows = [(1, None), (2, ""), (3, "x. " + item.upper() + "! y"), (None, item), (4, "nothing of this kind " * 30_000), (6, "too short"), (7, item.replace("fox", "cat")), (7, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(0.5)).withColumn("edits", F.lit("e"))
    got = sorted((r.doc_id or 0, r.item_id, r.edits) for r in D.contaminated(docs, items).collect())
    assert got == sorted([(0, 1, 0), (0, 5, 0), (3, 1, 0), (3, 5, 0), (7, 1, 0), (7, 5, 0), (7, 1, 1), (7, 5, 1)])
    kept = D.keep_uncontaminated(docs, items, slice_items=2)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6]
    assert D.contaminated(docs.limit(0), items).count() == 0 and D.contaminated(docs, items.limit(0)).count() == 0
    assert D.keep_uncontaminated(docs, items.limit(0)).count() == len(rows)


def test_short_numeric_and_unspaced_items_are_found(spark):
    rows = ["What is 12 * 30 + 7?", "Name the capital", "Who?", "\u5fd8\u308c\u7269\u3092\u3057\u305f\u3089\u3001\u3069\u3046\u3057\u307e\u3059\u304b\u3002", "\u0e40\u0e21\u0e37\u0e2d\u0e07\u0e2b\u0e25\u0e27\u0e07"]
    items = spark.createDataFrame(list(enumerate(rows)), "item_id long, text string")
    texts = [f"before {x} after" if x.isascii() else f"\u524d{x}\u5f8c" for x in rows]
    texts += ["What is 99 * 88 + 6?", "name that capital", "before " + rows[3].replace("\u7269", "\u672c")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in D.contaminated(docs, items, min_words=1).collect()}
    assert got == {(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (7, 3, 1)}
    assert {r.doc_id for r in D.keep_uncontaminated(docs, items, min_words=1).collect()} == {5, 6}


def test_the_walks_of_near_sequences_agree_and_of_others_do_not():
    rng = np.random.default_rng(5)
    words = [rng.integers(1, 1 << 63, 60).astype(np.uint64) for _ in range(80)]
    tables = D.make_tables(words)[60]
    found = 0
    for k, w in enumerate(words):
        copy = np.delete(w, rng.choice(60, 6, replace=False))
        copy[rng.choice(len(copy), 6, replace=False)] = rng.integers(1, 1 << 63, 6).astype(np.uint64)
        pairs = D.embedded(copy, np.array([0, len(copy)]), np.array([0]), np.array([0]), tables)
        assert {j for _, j in pairs.tolist()} <= {k}  # nothing of other items
        found += len(pairs) > 0
    assert found >= 78
    assert len(D.embedded(rng.integers(1, 1 << 63, 60).astype(np.uint64), np.array([0, 60]), np.array([0]), np.array([0]), tables)) == 0


def test_the_rate_holds_for_the_search_and_numbers_tell_items_apart(spark):
    item = [f"w{chr(97 + k)}x" for k in range(20)]
    copy = [("other" + chr(97 + k) if k % 3 == 1 else w) for k, w in enumerate(item)]  # seven substitutions
    items = spark.createDataFrame([(1, " ".join(item)), (2, "Tom has 12 apples and buys 7 more")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(copy)), (2, "Tom has 900 apples and buys 41 more"), (3, "Tom has 12 apples and buys 7 more")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.edits) for r in D.contaminated(docs, items).collect()] == [(3, 2, 0)]
    assert {(r.doc_id, r.item_id, r.edits) for r in D.contaminated(docs, items, rate=0.4).collect()} == {(1, 1, 7), (2, 2, 2), (3, 2, 0)}
