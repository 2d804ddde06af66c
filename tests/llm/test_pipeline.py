import numpy as np

import corpus_pipeline as P
from quillframe.llm import classifiers as C
from quillframe.llm import decontamination as D
from quillframe.llm import simhash as S
from quillframe.llm import vocabulary
from tests.llm.test_passages import distance_to_part
from tests.llm.test_simhash import union

SF = "/root/testdata/sf0.01"


def letters(text):
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    every = {r.doc_id: r.text for r in docs.collect()}

    clean = P.toxicity(spark, docs, SF).cache()
    rejected = {r.doc_id for r in C.toxicity_grades(docs, labels).collect() if r.rejected}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(every) - rejected and rejected

    good = P.quality(spark, clean, SF).cache()
    kept = {r.doc_id for r in C.quality_scores(clean, labels).collect() if r.kept}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept and len(kept) < clean.count()

    one = P.near_duplicates(spark, good, SF).cache()
    sig = S.signatures(good).where("high is not null").toPandas()
    x, ids = np.ascontiguousarray(sig[["high", "low"]].to_numpy().view(np.uint64)), sig.doc_id.tolist()
    pairs = [(ids[a], ids[b]) for a in range(len(ids)) for b in (np.flatnonzero(np.bitwise_count(x[a] ^ x[a + 1 :]).sum(axis=1) <= S.DISTANCE) + a + 1).tolist()]
    root = union(pairs)
    want = {i for i in kept if root.get(i, i) == i}
    got = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns and want <= got and len(got - want) <= 0.1 * (len(kept) - len(want))

    free = P.benchmark_decontamination(spark, one, SF).cache()
    items = [letters(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in free.collect()}
    shingles = {tuple(x[k : k + 4]) for x in items for k in range(len(x) - 3)}
    hit = set()
    for i in sorted(got):
        words = letters(every[i])
        if any(tuple(words[k : k + 4]) in shingles for k in range(len(words) - 3)):  # an item within 20 % of edits shares four words in a row
            if any(distance_to_part(x, words) <= int(D.EDIT_RATE * len(x)) for x in items if set(zip(x, x[1:], x[2:], x[3:])) & {tuple(words[k : k + 4]) for k in range(len(words) - 3)}):
                hit.add(i)
    assert free.columns == docs.columns and got - left <= hit and hit and len(got - left) >= 0.9 * len(hit)

    e = vocabulary.encoding(open(vocabulary.DEFAULT_PATH, "rb").read())
    out = P.bpe_encoding(spark, free, SF).collect()
    assert {r.doc_id: r.token_ids for r in out} == {i: e.encode_ordinary(every[i]) for i in left}


def test_run_is_its_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.exceptAll(docs).count() == 0 and docs.exceptAll(out).count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_through_all_stages(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.where("lang = 'en' and length(text) between 400 and 3000").orderBy("doc_id").limit(40)
    clean = P.quality(spark, P.toxicity(spark, good, SF), SF).orderBy("doc_id").limit(3).collect()
    text = clean[0].text
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(-1, None), (-2, ""), (None, text), (-3, text), (-3, text), (-4, text + "."), (-5, clean[1].text + " " + item + " " + clean[1].text), (-6, (clean[2].text + " ") * 300)]
    odd = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in rows], docs.schema).withColumn("n_tokens", F.lit("x")).withColumn("score", F.lit(1)).withColumn("_gone", F.lit(0))
    got, out = {}, odd
    for name, stage in P.STAGES:
        out = stage(spark, out, SF)
        if name != "bpe_encoding":
            assert out.columns == odd.columns
            got[name] = sorted((r.doc_id or 0) for r in out.collect())
    assert got["toxicity"] == sorted(i or 0 for i, _ in rows)
    assert set(got["quality"]) >= {-3, -4, -5, 0} and -1 not in got["quality"] and got["quality"].count(-3) == 2
    assert got["near_duplicates"].count(-4) == 1 and -3 not in got["near_duplicates"] and got["near_duplicates"].count(0) == 1  # the least id stays
    assert -5 in got["near_duplicates"] and -5 not in got["benchmark_decontamination"]
    assert sorted(r.doc_id or 0 for r in out.collect()) == got["benchmark_decontamination"]
