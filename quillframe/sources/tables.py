"""Tables in the folder that all executors share (spark.checkpoint.dir), which cut lineage.

The setting is read from the session. Only where it is unset, as in tests on one machine, a temporary
folder is made and set. Tables are deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a worker holds before it writes them as a row group.
GROUP_BYTES = 8 << 20


def folder(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended
        pass


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if its files make fewer: work in Python on a small file would be one task.

    A large table has more partitions than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder, deleted when the driver ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _local(path: str) -> str | None:
    """The path of a ``file:`` URI or of a path without scheme, None for other file systems."""
    at = urlsplit(path)
    return unquote(at.path) if at.scheme == "file" else path if not at.scheme else None


def _writing(run: Callable, folder: str) -> Callable:
    """run, whose rows go into a file of the task; returned is the file's name, which tells what was written to its end."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        name = f"_{uuid.uuid4().hex}.parquet"  # with an underscore it is no part of the table
        path, writer, held, size = os.path.join(folder, name), None, [], 0
        try:
            for batch in run(batches):
                if not len(batch):
                    continue
                if writer is None:
                    writer = pq.ParquetWriter(path, batch.schema, compression="zstd", use_dictionary=False)
                held.append(batch)
                size += batch.nbytes
                if size >= GROUP_BYTES:
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                writer.write_table(pa.Table.from_batches(held))
            if writer is not None:
                writer.close()
        except BaseException:
            if writer is not None:
                writer.close()
                os.remove(path)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([name] if writer is not None else [], pa.string())], names=["file"])

    return write


def made(df: DataFrame, run: Callable, schema: str, name: str) -> DataFrame:
    """As ``table(df.mapInArrow(run, schema), name)``, with the files written by the workers where the folder is on a ``file:`` system.

    There Hadoop starts a ``chmod`` for the directory, the file and the checksums of every task; the
    process that becomes it shares all memory of its executor, which until then counts twice. Files count
    once the driver has renamed them, so that those of failed or repeated tasks never do.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    folder = _local(path)
    if folder is None:
        return table(df.mapInArrow(run, schema), name)
    os.makedirs(folder)
    for r in df.mapInArrow(_writing(run, folder), "file string").collect():  # one for each task
        os.rename(os.path.join(folder, r["file"]), os.path.join(folder, "part-" + r["file"][1:]))
    return spark.read.schema(schema).parquet(path)
