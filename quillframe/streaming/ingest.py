"""Packages that arrive in a folder, appended as parts to a table; each file once, by the stream's checkpoint."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillframe.sources.docx import parts_of, path_below


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_trigger: int = 1000) -> StreamingQuery:
    """Start a run over all files that are new; packages that can't be read are rows with an error. All paths are shared ones."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    named = files.select(path_below(folder).alias("doc_id"), "content")
    return parts_of(named).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
