"""Text tables of matches, patterns and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import cuts_from_text, cuts_text
from ..schema import FIELDS, MATCH

_TEXT = "read_id string, " + ", ".join(f"{f.name} {'string' if f.name == 'cuts' else f.dataType.simpleString()}" for f in MATCH.fields)


def as_text(annotations: DataFrame) -> DataFrame:
    """The 15 text columns of matches."""
    return annotations.select("read_id", *(cuts_text(F.col(n)).alias(n) if n == "cuts" else F.col(n) for n in FIELDS))


def write_annotations(annotations: DataFrame, path: str) -> None:
    """Tab-separated with a header; a read's rows stay together and in order within a file."""
    annotations.sortWithinPartitions("read_id", "anno_idx").transform(as_text).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Matches of a text table; anno_idx follows the order of rows in a file, columns are bound by the header."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=_TEXT, enforceSchema=False)
    return raw.withColumn("cuts", cuts_from_text(F.col("cuts"))).withColumn("anno_idx", F.monotonically_increasing_id())


def write_patterns(patterns: DataFrame, path: str) -> None:
    """read_id and pattern, no header."""
    patterns.select(F.concat_ws("\t", "read_id", "pattern").alias("value")).write.mode("overwrite").text(path)


def write_lines(ids: DataFrame, path: str) -> None:
    ids.select(F.col(ids.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_counters(counters: DataFrame, path: str) -> None:
    """step, metric, count with a header."""
    counters.coalesce(1).write.mode("append").csv(path, sep="\t", header=True)
