"""Token-id output: documents as separately compressed zstandard frames that share a trained dictionary.

Pass 1 encodes each document and writes its ids (little-endian, two bytes where the vocabulary allows)
to a table in the shared folder. Pass 2 trains the dictionary on all of it: every task trains on all of
its documents, and the contents of those dictionaries are the samples of the next level, in a tree of
tasks of bounded fan-in, up to the one that is used. Pass 3 compresses each document on its own and keeps the
running offset in its shard, so that one short document is read by one range read and one frame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import shared, vocabulary

SCHEMA = "kind string, doc_id long, n_tokens int, shard int, offset long, n_bytes int, dict_hash string, frame binary"
_ARROW = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_bytes", pa.int32()), ("dict_hash", pa.string()), ("frame", pa.large_binary())])
#: Bytes of the cover segments, of a level's samples and of the entropy tables that head a dictionary; bytes that a task trains on at once.
SEGMENT, CHUNK, HEADER, TRAIN_BYTES = 200, 2048, 256, 8 << 20
FAN_IN, DICT_BYTES, LEVEL = 64, 65536, 3


def id_type(raw: bytes) -> str:
    """NumPy type of serialized ids."""
    return "<u2" if max(vocabulary.ranks(raw).values()) < 1 << 16 else "<u4"


def learn(samples: list[bytes], dict_bytes: int = DICT_BYTES) -> bytes:
    """A dictionary from samples by zstandard's cover selection; b"" if they are too few to train on.

    All samples train: by default the last quarter of them would only test the others. Training on little may
    fail; with ten times the dictionary's size in a hundred samples an error is one.
    """
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(dict_bytes, samples, k=SEGMENT, d=8, dict_id=1, split_point=1.0).as_bytes()
    except (zstandard.ZstdError, ValueError):
        if len(samples) >= 100 and sum(map(len, samples)) >= 10 * dict_bytes:
            raise
        return b""


def cut(content: bytes) -> list[bytes]:
    """Dictionary content as samples for the next level."""
    return [content[k : k + CHUNK] for k in range(0, len(content), CHUNK)]


def _encode(docs: DataFrame, raw, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = vocabulary.encoding(raw.value).encode_ordinary, id_type(raw.value)
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                ids = [None if t is None else np.array(encode(vocabulary.utf8_safe(t)), kind).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return shared.made(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, ids binary", "tokens")


def train(tokens: DataFrame, kind: str, dict_bytes: int = DICT_BYTES, fan_in: int = FAN_IN) -> bytes:
    """The dictionary for ``tokens`` (doc_id, ids), from all of its rows; b"" if there is too little to train on.

    A part too small to train on passes its ids on as they are.
    """

    def content(samples: list[bytes]) -> bytes:
        return learn(samples, dict_bytes)[HEADER:] or b"".join(samples)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents, held, size, part = [], [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for x in batch.column(1).drop_null().to_pylist():
                held.append(x)
                size += len(x)
                if size > TRAIN_BYTES:
                    contents.append(content(held))
                    held, size = [], 0
        contents.append(content(held))
        found = contents[0] if len(contents) == 1 else content([c for x in contents for c in cut(x)])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([found], pa.binary())], names=["part", "content"])

    def merge(table: pa.Table) -> pa.Table:
        found = content([c for x in table.sort_by("content").column("content").to_pylist() for c in cut(x)])
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "content": pa.array([found], pa.binary())})

    level = shared.made(tokens.select("doc_id", "ids"), local, "part long, content binary", "contents")
    while level.count() > fan_in:
        level = level.select(F.expr(f"part div {fan_in}").alias("part"), "content").groupBy("part").applyInArrow(merge, "part long, content binary")
        level = shared.table(level, "contents")
    rows = sorted(level.collect(), key=lambda r: r["part"])
    return learn([c for r in rows for c in cut(bytes(r["content"]))], dict_bytes)


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()[:16]


def compress(tokens: DataFrame, kind: str, dictionary: bytes, level: int = LEVEL) -> DataFrame:
    """One row for each row of tokens, in shards that are the tasks of this pass."""
    sent, name, width = tokens.sparkSession.sparkContext.broadcast(dictionary), dictionary_hash(dictionary), np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_dict = {"dict_data": zstandard.ZstdCompressionDict(sent.value)} if sent.value else {}
        if with_dict:
            with_dict["dict_data"].precompute_compress(level=level)
        press, shard, at = zstandard.ZstdCompressor(level=level, **with_dict).compress, TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(1).to_pylist()
            frames = [None if x is None else press(x) for x in ids]
            sizes = np.array([0 if f is None else len(f) for f in frames], np.int64)
            none = np.array([f is None for f in frames], bool)
            offsets = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            n = len(frames)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["document"] * n), batch.column(0), pa.array([None if x is None else len(x) // width for x in ids], pa.int32()), pa.array([shard] * n, pa.int32()),
                    pa.array(offsets, mask=none), pa.array(sizes.astype(np.int32), mask=none), pa.array([name] * n), pa.array(frames, pa.large_binary()),
                ],
                schema=_ARROW,
            )

    return tokens.select("doc_id", "ids").mapInArrow(run, SCHEMA)


def token_output(docs: DataFrame, path: str = vocabulary.DEFAULT_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of kind ``dictionary`` with the dictionary as its frame, and one of kind ``document`` for each row of docs.

    A null text has a null frame and takes no place in its shard; an empty text is the frame of no bytes.
    Null and repeated ids are kept, row for row. With too little text to train on (an empty table, a few
    short documents) the dictionary is empty and frames are compressed without one.
    """
    spark = docs.sparkSession
    raw = vocabulary.send(spark, path)
    kind = id_type(raw.value)
    tokens = _encode(docs, raw, id_col, text_col)
    dictionary = train(tokens, kind)
    row = [("dictionary", None, None, -1, 0, len(dictionary), dictionary_hash(dictionary), bytearray(dictionary))]
    return spark.createDataFrame(row, SCHEMA).unionByName(compress(tokens, kind, dictionary))


def decode_frame(frame: bytes, dictionary: bytes, kind: str) -> np.ndarray:
    """The ids of one document."""
    with_dict = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return np.frombuffer(zstandard.ZstdDecompressor(**with_dict).decompress(frame), kind)


def write_shards(output: DataFrame, folder: str) -> None:
    """Write ``output`` as dictionary.bin, shard-N.bin and the table index (frames left out).

    folder: a URI or path that all executors reach. A shard is written by one task under a name of its
    attempt and renamed when whole, so that a repeated task leaves one file.
    """
    from pyarrow import fs

    def run(table: pa.Table) -> pa.Table:
        files, base = fs.FileSystem.from_uri(folder)
        table = table.sort_by("offset")
        shard, attempt = table.column("shard")[0].as_py(), TaskContext.get().taskAttemptId()
        name = "dictionary.bin" if shard < 0 else f"shard-{shard:06d}.bin"
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/{name}.{attempt}") as out:
            for frame in table.column("frame").drop_null().to_pylist():
                out.write(frame)
        files.move(f"{base}/{name}.{attempt}", f"{base}/{name}")
        return pa.table({"shard": pa.array([shard], pa.int32())})

    output = shared.table(output, "output")
    output.groupBy("shard").applyInArrow(run, "shard int").count()
    output.where("kind = 'document'").drop("kind", "frame").write.mode("overwrite").parquet(f"{folder}/index")


def read_document(spark: SparkSession, folder: str, doc_id: int, kind: str = "<u2") -> list[np.ndarray]:
    """The ids of the documents with this id: a lookup in the index and one range read for each."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{base}/dictionary.bin") as f:
        dictionary = f.read()
    found = []
    for r in spark.read.parquet(f"{folder}/index").where(F.col("doc_id") == doc_id).where("offset is not null").collect():
        if r["dict_hash"] != dictionary_hash(dictionary):
            raise ValueError("the dictionary isn't the one that the frames were made with")
        with files.open_input_file(f"{base}/shard-{r['shard']:06d}.bin") as f:
            found.append(decode_frame(f.read_at(r["n_bytes"], r["offset"]), dictionary, kind))
    return found
