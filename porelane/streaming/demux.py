"""Streaming: files that arrive in a folder go through a kit, read by read and without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.kit import demux
from ..sources.fastq import parsed

_FILES = "path string, modificationTime timestamp, length long, content binary"


def read_folder(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """A stream of reads from the files that appear in a folder."""
    return parsed(spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", max_files).load(path))


def demux_folder(spark: SparkSession, path: str, kit: str, out: str, checkpoint: str, **how) -> StreamingQuery:
    """Labelled slices appended to Parquet by label, exactly once; takes what is there and stops."""
    trimmed = demux(read_folder(spark, path), kit, **how).trimmed
    return trimmed.writeStream.format("parquet").partitionBy("label").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
