import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.llm import bpe, token_counts, token_output, vocabulary

RAW = open(vocabulary.DEFAULT_PATH, "rb").read()
ODD = [
    (1, None), (2, ""), (3, "a  b"), (4, "a\n\nb \n c"), (None, "null id"), (5, "the same"), (5, "the same"), (6, "x" * 30_000), (7, "日本語 ½ ² text\x1c\x85 end "),
    (8, "\n"), (9, "\n\n\n"), (10, " lead\nand trail \n"), (11, "it's we'll don't"), (12, "<|endoftext|>"), (13, "word " * 20_000),
]


def frame(spark, rows=ODD):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("section", F.lit(None).cast("double")).withColumn("frame", F.lit(1))


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r\x1c\x85\xa0\u2003\u3000abtheing'.,!19½éß語 ")), max_size=40))
def test_encoder_equals_exact_bpe(text):
    ids = bpe.encoder(RAW).encode_batch([text])[0]
    assert ids.tolist() == vocabulary.encoding(RAW).encode_ordinary(text)
    assert bpe.encoder(RAW).decode(ids) == text.encode()


def test_exact_merging_short_and_long_words_agree():
    b, rng = bpe.SpeculativeBpe(vocabulary.ranks(RAW)), random.Random(3)
    for n in (1, 2, 50, 128, 129, 700):
        word = "".join(rng.choice("abcdetionghs") for _ in range(n)).encode()
        assert b.merge(word) == vocabulary.encoding(RAW).encode_single_piece(word) if hasattr(vocabulary.encoding(RAW), "encode_single_piece") else vocabulary.encoding(RAW)._encode_single_piece(word)


def test_speculation_accepts_and_repairs():
    b = bpe.SpeculativeBpe(vocabulary.ranks(RAW))
    b.encode_batch([t for t in ["thntionheou rerenand the of and tionsh erthe"]])
    assert b.stats["accepted"] and b.stats["merged"]


def test_bpe_rows(spark):
    out = bpe.encode_decode(frame(spark)).collect()
    assert len(out) == len(ODD)
    e = vocabulary.encoding(RAW)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.token_ids or []) for r in out) == sorted((i is None, i or 0, e.encode_ordinary(t or "")) for i, t in ODD)
    assert all(r.round_trip == (None if r.doc_id == 1 else True) for r in out)
    assert [r.n_tokens for r in out if r.doc_id == 1] == [None]
    assert bpe.encode_decode(frame(spark, [])).count() == 0


def test_bpe_on_documents(spark):
    e = vocabulary.encoding(RAW)
    for r in bpe.encode_decode(documents(spark)).join(documents(spark), "doc_id").collect():
        assert r.round_trip and r.token_ids == e.encode_ordinary(r.text)


def by_hand(text, rule):
    """Counts from tiktoken's own offsets and a loop over lines."""
    e = vocabulary.encoding(RAW)
    lines = text.splitlines(keepends=True) if "\n" in text else [text]
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    owner = [k for k, x in enumerate(lines) for _ in x.encode()]
    out, at = [0] * len(lines), 0
    for t in e.encode_ordinary(text):
        n = len(e.decode_single_token_bytes(t))
        span = owner[at : at + n]
        at += n
        out[{"start": span[0], "end": span[-1], "majority": max(sorted(set(span)), key=lambda s: (span.count(s), -s))}[rule]] += 1
    return [(k, c, len(x)) for k, (c, x) in enumerate(zip(out, lines))]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    rows = [r for r in ODD if r[0] != 5]
    got = token_counts.count_tokens(frame(spark, rows), rule=rule).collect()
    want = sorted((i or 0, *x) for i, t in rows if t is not None for x in by_hand(t, rule))
    assert sorted((r.doc_id or 0, r.section, r.n_tokens, r.n_chars) for r in got) == want
    assert token_counts.count_tokens(frame(spark, []), rule=rule).count() == 0


def test_token_counts_of_fields_and_totals(spark):
    df = spark.createDataFrame([(1, "ab c", None, "de\n"), (2, "", "", "")], "doc_id long, a string, b string, c string")
    got = token_counts.count_tokens(df, fields=["a", "b", "c"]).collect()
    whole = len(vocabulary.encoding(RAW).encode_ordinary("ab c\n\nde\n"))
    assert sum(r.n_tokens for r in got if r.doc_id == 1) == whole and {r.section for r in got if r.doc_id == 2} == {0, 1, 2}
    totals = token_counts.count_tokens(documents(spark)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    other = bpe.encode_decode(documents(spark)).select("doc_id", F.col("n_tokens").cast("long").alias("n"))
    assert totals.exceptAll(other).count() == 0 and totals.count() == other.count()


def test_token_output_round_trip(spark, tmp_path):
    docs = documents(spark)
    out = token_output.token_output(docs)
    rows = out.collect()
    (dictionary,) = [bytes(r.frame) for r in rows if r.kind == "dictionary"]
    assert len(dictionary) > 1000
    e, texts = vocabulary.encoding(RAW), {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: token_output.decode_frame(bytes(r.frame), dictionary, "<u2").tolist() for r in rows if r.kind == "document"}
    assert found == {i: e.encode_ordinary(t) for i, t in texts.items()}
    plain = sum(len(token_output.zstandard.ZstdCompressor(level=3).compress(np.array(x, "<u2").tobytes())) for x in found.values())
    assert sum(r.n_bytes for r in rows if r.kind == "document") < plain
    folder = "file://" + str(tmp_path / "shards")
    token_output.write_shards(out, folder)
    for i in random.Random(1).sample(sorted(texts), 3):
        (ids,) = token_output.read_document(spark, folder, i)
        assert ids.tolist() == found[i]


def test_token_output_odd_rows(spark):
    rows = token_output.token_output(frame(spark)).collect()
    d = [bytes(r.frame) for r in rows if r.kind == "dictionary"][0]
    e = vocabulary.encoding(RAW)
    got = sorted((r.doc_id or 0, token_output.decode_frame(bytes(r.frame), d, "<u2").tolist()) for r in rows if r.kind == "document" and r.frame is not None)
    assert got == sorted((i or 0, e.encode_ordinary(t)) for i, t in ODD if t is not None)
    assert [(r.n_tokens, r.offset) for r in rows if r.doc_id == 1] == [(None, None)]
    for shard in {r.shard for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.shard == shard and r.frame is not None), key=lambda r: r.offset):
            assert r.offset == at
            at += r.n_bytes
    assert token_output.token_output(frame(spark, [])).count() == 1


def test_dictionary_is_merged_in_a_tree(spark):
    tokens = spark.createDataFrame([(k, bytearray(np.array([(k * j) % 97 for j in range(400)], "<u2").tobytes())) for k in range(300)], "doc_id long, ids binary").repartition(9)
    assert len(token_output.train(tokens, "<u2", 2048, fan_in=3)) > 256
    assert os.path.isdir("/opt/tokenizers")


def test_last_documents_reach_the_dictionary(spark):
    rng = random.Random(4)
    first, last = [rng.randbytes(16) for _ in range(400)], [rng.randbytes(16) for _ in range(100)]
    rows = [(k, b"".join(rng.choice(last if k >= 1800 else first) for _ in range(60))) for k in range(2400)]
    learnt = token_output.learn([x for _, x in rows])
    assert all(x in learnt for x in last)
    tokens = spark.createDataFrame([(k, bytearray(x)) for k, x in rows], "doc_id long, ids binary").repartitionByRange(8, "doc_id")
    trained = token_output.train(tokens, "<u2", 16384)
    assert sum(x in trained for x in last) >= 90 and any(x in trained for x in first)


def test_unspaced_texts_leave_nothing_behind():
    b, e, rng = bpe.SpeculativeBpe(vocabulary.ranks(RAW)), vocabulary.encoding(RAW), random.Random(4)
    for _ in range(5):
        texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(10_000)), "x" * 4000 + "  y", "", "".join(rng.choice("abcdetionghs") for _ in range(3000))]
        assert [x.tolist() for x in b.encode_batch(texts)] == [e.encode_ordinary(t) for t in texts]
    assert all(len(k) <= bpe.MEMO_CHARS for memo in (b.memo, b.exact) for k in memo)
    b.held = bpe.MEMO_BYTES + 1
    assert b.encode_batch(["again and again"])[0].tolist() == e.encode_ordinary("again and again") and b.held < 10_000


def test_words_merged_together_and_alone_agree():
    b, rng = bpe.SpeculativeBpe(vocabulary.ranks(RAW)), random.Random(8)
    words = ["".join(rng.choice("abcdetionghs é日") for _ in range(rng.randrange(1, 70))).encode() for _ in range(3000)]
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    tokens, n = b.merge_all(data, end - np.array([len(w) for w in words]), end)
    assert [x.tolist() for x in np.split(tokens, np.cumsum(n)[:-1])] == [b.merge(w) for w in words]
    flat, n = b.greedy(data, end - np.array([len(w) for w in words]), end)
    for w, got in zip(words, np.split(flat, np.cumsum(n)[:-1])):
        want = []
        while sum(len(b.bytes_of[t]) for t in want) < len(w):
            rest = w[sum(len(b.bytes_of[t]) for t in want) :]
            want.append(next(b.ranks[rest[:k]] for k in range(len(rest), 0, -1) if rest[:k] in b.ranks))
        assert got.tolist() == want


def test_round_trips_tell_changed_texts():
    b = bpe.SpeculativeBpe(vocabulary.ranks(RAW))
    texts = ["one two", "", "three", "four five six", ""]
    flat, n = b.encode_flat(texts)
    given = [t.encode() for t in texts]
    assert b.round_trips(flat, n, given).tolist() == [True] * 5
    given[2] = b"thref"
    assert b.round_trips(flat, n, given).tolist() == [True, True, False, True, True]
    given[3] += b"!"
    assert b.round_trips(flat, n, given).tolist() == [True, True, False, False, True]
    assert b.round_trips(*b.encode_flat([]), []).tolist() == []


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_crossing_tokens_and_repeated_rows(spark, rule):
    e = vocabulary.encoding(RAW)
    rows = [(1, "a\n\nb\n\n\nc"), (2, "one line"), (2, "one line"), (2, "two\nlines"), (3, "\n\n\n\n"), (None, "x\n\ny")]
    want = []
    for i, text in rows:
        owner, at, crossing = [text[:k].count("\n") for k in range(len(text))], 0, {}
        counts = by_hand(text, rule)
        for t in e.encode_ordinary(text):
            span = owner[at : at + len(e.decode_single_token_bytes(t))]
            at += len(span)
            k = {"start": span[0], "end": span[-1], "majority": max(sorted(set(span)), key=lambda s: (span.count(s), -s))}[rule]
            crossing[k] = crossing.get(k, 0) + (len(set(span)) > 1)
        want += [(i or 0, k, n, crossing.get(k, 0), c) for k, n, c in counts]
    got = [(r.doc_id or 0, r.section, r.n_tokens, r.n_crossing, r.n_chars) for r in token_counts.count_tokens(frame(spark, rows), rule=rule).collect()]
    assert sorted(got) == sorted(want) and sum(r[3] for r in got) > 0


def test_training_errors_on_enough_samples_are_errors(monkeypatch):
    def fails(*a, **k):
        raise token_output.zstandard.ZstdError("no memory")

    monkeypatch.setattr(token_output.zstandard, "train_dictionary", fails)
    assert token_output.learn([b"few"] * 5) == b""
    with pytest.raises(token_output.zstandard.ZstdError):
        token_output.learn([b"x" * 10_000] * 200, 65536)


def test_ids_and_contents_are_written_by_the_workers(spark, monkeypatch):
    monkeypatch.setattr(token_output.shared, "table", lambda *args: pytest.fail("written by Hadoop"))
    assert token_output.token_output(frame(spark)).count() > 1
