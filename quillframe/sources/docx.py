"""Packages as a data source: spark.read.format("docx") and df.write.format("docx").

Reading gives (doc_id, source, part_ord, part_name, data, error), a partition for each bounded group of
files; doc_id is the path below the folder that was given, without the ending, so that files of one name in
several folders stay apart. Writing takes the first, third, fourth and fifth of those, a package at a time,
each under a name of its task attempt, and renames the ones of committed tasks. Paths are folders, files or
patterns, plain ones or URIs of any file system that pyarrow knows (file, hdfs, s3, gs, abfs), and must be
reachable from all executors.
"""

from __future__ import annotations

import fnmatch
import io
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quillframe.operators.packages import CONTENT_TYPES

SCHEMA = "doc_id string, source string, part_ord int, part_name string, data binary, error string"
_ARROW = pa.schema([("doc_id", pa.string()), ("source", pa.string()), ("part_ord", pa.int32()), ("part_name", pa.string()), ("data", pa.binary()), ("error", pa.string())])
GROUP_BYTES = 64 << 20
#: Bytes of parts after which a reading task sends on what it has read.
BATCH_BYTES = 2 << 20


def read_parts(data: bytes, wanted: set[str] | None = None) -> tuple[list[tuple[int, str, bytes]], str | None]:
    """(part_ord, part_name, data) in the order of the archive, and what is wrong with it."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [i for i in z.infolist() if not i.is_dir()]
            if CONTENT_TYPES not in {i.filename for i in names}:
                return [], f"no {CONTENT_TYPES}"
            return [(k, i.filename, z.read(i)) for k, i in enumerate(names) if wanted is None or i.filename in wanted], None
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, EOFError) as e:
        return [], f"{type(e).__name__}: {e}"


def package_bytes(parts: list[tuple[str, bytes]]) -> bytes:
    """An archive of the parts in this order; the same bytes for the same parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def found_files(path: str) -> list[tuple[str, str, int]]:
    """(doc_id, path in its file system, bytes) of the packages under a folder, of a pattern, or of one file; one listing."""
    files, base = _file_system(path)
    base = base.rstrip("/") or "/"
    wild = next((k for k, c in enumerate(base) if c in "*?["), None)
    root = base if wild is None else base[: base.rfind("/", 0, wild)] or "/"
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(os.path.basename(root).removesuffix(".docx"), root, info.size or 0)]
    if info.type == fs.FileType.NotFound:
        return []
    every = files.get_file_info(fs.FileSelector(root, recursive=True))
    fits = (lambda p: p.endswith(".docx")) if wild is None else (lambda p: _matches(p, base))
    return sorted((i.path[len(root) :].lstrip("/").removesuffix(".docx"), i.path, i.size or 0) for i in every if i.type == fs.FileType.File and fits(i.path))


def _matches(path: str, pattern: str) -> bool:
    """Step by step, so that * stays in its folder; ** is any number of folders."""
    def fit(p: list[str], q: list[str]) -> bool:
        if not q:
            return not p
        if q[0] == "**":
            return any(fit(p[k:], q[1:]) for k in range(len(p) + 1))
        return bool(p) and fnmatch.fnmatchcase(p[0], q[0]) and fit(p[1:], q[1:])

    return fit(path.strip("/").split("/"), pattern.strip("/").split("/"))


@dataclass
class _Files(InputPartition):
    files: tuple[tuple[str, str], ...]

    def __init__(self, files: tuple[tuple[str, str], ...]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.wanted = set(options["parts"].split(",")) if options.get("parts") else None
        self.fail = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"

    def partitions(self) -> list[InputPartition]:
        groups, size = [[]], 0
        for name, p, n in found_files(self.path):
            if groups[-1] and size + n > GROUP_BYTES:
                groups.append([])
                size = 0
            groups[-1].append((name, p))
            size += n
        return [_Files(tuple(g)) for g in groups]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self._rows(partition):
            if held and size > BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4] or b"")
        yield _batch(held)

    def _rows(self, partition: _Files) -> Iterator[tuple]:
        files, _ = _file_system(self.path)
        for name, path in partition.files:
            with files.open_input_stream(path, compression=None) as f:
                parts, error = read_parts(f.read(), self.wanted)
            if error and self.fail:
                raise ValueError(f"{path}: {error}")
            if error:
                yield name, path, None, None, None, error
            for k, part, data in parts:
                yield name, path, k, part, data, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]


class _Writer(DataSourceArrowWriter):
    """Rows have to come by doc_id, as ``write_packages`` sorts them: one package is held at a time."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        files, base = _file_system(self.path)
        attempt, done = TaskContext.get().taskAttemptId(), []
        files.create_dir(base, recursive=True)
        # rows become Python objects one at a time, however large a batch is
        rows = (tuple(c[k].as_py() for c in b.select(["doc_id", "part_ord", "part_name", "data"]).columns) for b in batches for k in range(len(b)))
        for name, own in groupby(rows, key=lambda r: str(r[0])):
            parts = sorted(r[1:] for r in own)
            final = f"{base.rstrip('/')}/{name}.docx"
            if "/" in name:
                files.create_dir(final.rsplit("/", 1)[0], recursive=True)
            with files.open_output_stream(f"{final}.{attempt}.tmp", compression=None) as f:
                f.write(package_bytes([(n, d) for _, n, d in parts]))
            done.append((f"{final}.{attempt}.tmp", final))
        return _Written(tuple(done))

    def commit(self, messages) -> None:
        files, _ = _file_system(self.path)
        for m in messages:
            for tmp, final in m.files if m else ():
                files.move(tmp, final)

    def abort(self, messages) -> None:
        files, _ = _file_system(self.path)
        for m in messages:
            for tmp, _ in m.files if m else ():
                if files.get_file_info(tmp).type != fs.FileType.NotFound:
                    files.delete_file(tmp)


class DocxSource(DataSource):
    """Options: path (a folder, searched in depth, or a pattern), parts (names, by comma), mode (PERMISSIVE or FAILFAST)."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxSource)


def write_packages(parts: DataFrame, path: str) -> None:
    """Each package is whole in one task, and one package is held at a time: one shuffle on doc_id, sorted."""
    register(parts.sparkSession)
    parts.select(F.col("doc_id").cast("string").alias("doc_id"), "part_ord", "part_name", F.col("data").cast("binary").alias("data")).repartition("doc_id").sortWithinPartitions("doc_id", "part_ord").write.format("docx").mode("append").save(path)


def archives_of(parts: DataFrame) -> DataFrame:
    """doc_id, content: the packages as binary rows; one shuffle on doc_id, then a batch of rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                (row,) = batch.slice(k, 1).to_pylist()
                content = package_bytes([(p["part_name"], p["data"]) for p in row["parts"]])
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.string()), pa.array([content], pa.binary())], names=["doc_id", "content"])

    one = F.struct("part_ord", "part_name", F.col("data").cast("binary").alias("data"))
    packed = parts.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(one)).alias("parts"))
    return packed.mapInArrow(run, "doc_id string, content binary")


def path_below(folder: str) -> Column:
    """The doc_id of a row of the binaryFile source: its path below ``folder``, without the ending."""
    root = folder.split("://", 1)[-1].removeprefix("file:").strip("/")
    return F.regexp_extract("path", rf"^[^/]*:?/*(?:\Q{root}\E/)?(.*?)(?:\.docx)?$", 1)


def parts_of(files: DataFrame) -> DataFrame:
    """files: doc_id, content (binary), as from the binaryFile source, batch or stream: to parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                doc, content = (c[k].as_py() for c in batch.columns)
                parts, error = read_parts(content or b"")
                rows = [(k, n, d, None) for k, n, d in parts] or [(None, None, None, error)]
                ords, n, d, e = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.string()), pa.array(ords, pa.int32()), pa.array(n, pa.string()), pa.array(d, pa.binary()), pa.array(e, pa.string())], names=["doc_id", "part_ord", "part_name", "data", "error"])

    return files.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, "doc_id string, part_ord int, part_name string, data binary, error string")
