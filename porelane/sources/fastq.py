"""FASTQ and FASTA sources and the FASTQ sink.

`fastq` is a Python data source for paths that every executor sees (`.gz` too), one partition a
file.  `read_stored` reads the same files through Spark's own reader, from any store.
Columns: read_id, desc, seq, qual (null for FASTA), file, ord.
"""

from __future__ import annotations

import glob
import gzip
import io
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "read_id string, desc string, seq string, qual string, file string, ord long"
_ARROW = pa.schema([("read_id", pa.string()), ("desc", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("file", pa.string()), ("ord", pa.int64())])


def split_header(header: str) -> tuple[str, str]:
    """Id and description: cut at the first white space, which is dropped."""
    got = re.match(r"(\S*)\s*(.*)", header, re.S)
    return got[1], got[2]


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str | None]]:
    """(header, sequence, quality) of FASTQ or FASTA text. Four-line FASTQ: quality may begin with @."""
    head = next(lines, None)
    while head is not None:
        head = head.rstrip("\r\n")
        if not head:
            head = next(lines, None)
        elif head[0] == "@":
            seq, plus, qual = (next(lines, "").rstrip("\r\n") for _ in range(3))
            if plus[:1] != "+" or len(qual) != len(seq):
                raise ValueError(f"broken FASTQ record: {head}")
            yield head[1:], seq, qual
            head = next(lines, None)
        elif head[0] == ">":
            name, parts = head[1:], []
            while (head := next(lines, None)) is not None and head[:1] != ">":
                parts.append(head.strip())
            yield name, "".join(parts), None
        else:
            raise ValueError(f"neither FASTQ nor FASTA: {head[:40]!r}")


def batches(lines: Iterator[str], name: str, size: int = 2000) -> Iterator[pa.RecordBatch]:
    out = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    for i, (head, seq, qual) in enumerate(records(lines)):
        out.append((*split_header(head), seq, qual, name, i))
        if len(out) == size:
            yield batch()
            out = []
    if out:
        yield batch()


def files_of(path: str | list[str]) -> list[str]:
    """Files of a list (or a comma-separated one) of paths, patterns and folders; none at all is an error."""
    out = []
    for p in filter(None, (x.strip() for x in path.split(","))) if isinstance(path, str) else path:
        p = p.removeprefix("file://")
        found = sorted(glob.glob(p))
        if not found:
            raise FileNotFoundError(p)
        for f in found:
            out += sorted(x for n in os.listdir(f) if os.path.isfile(x := os.path.join(f, n)) and n[0] not in "._") if os.path.isdir(f) else [f]
    if not out:
        raise ValueError("no read files")
    return out


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str | list[str]):
        self.files = files_of(path)

    def partitions(self):
        return [_File(f) for f in self.files]

    def read(self, partition):
        path = partition.value
        with gzip.open(path, "rt", encoding="latin-1") if path.endswith(".gz") else open(path, encoding="latin-1") as f:
            yield from batches(f, path)


class _Done(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    """Tasks write temporary files; commit renames what succeeded, so a retried task leaves nothing behind."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.gzip = options.get("gzip", "false").lower() == "true"
        self.temp, self.overwrite = os.path.join(self.path, f"_temporary-{uuid.uuid4().hex}"), overwrite

    def write(self, rows):
        attempt = os.path.join(self.temp, uuid.uuid4().hex)
        os.makedirs(attempt, exist_ok=True)
        done, name, out = [], None, None
        for row in rows:  # sorted by file within the task: one open file at a time
            if row["file"] != name:
                if out:
                    out.close()
                name = row["file"]
                part = os.path.join(attempt, str(len(done)))
                out = gzip.open(part, "at", encoding="latin-1") if self.gzip else open(part, "a", encoding="latin-1")
                done.append((part, name))
            out.write(row["record"] + "\n")
        if out:
            out.close()
        return _Done(done)

    def commit(self, messages):
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "*.trimmed*.fastq*")):
                os.remove(old)
        for message in messages:
            for part, name in message.files if message else ():
                os.replace(part, os.path.join(self.path, name + (".gz" if self.gzip else "")))
        shutil.rmtree(self.temp, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.temp, ignore_errors=True)


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(json.loads(self.options["paths"]) if "paths" in self.options else self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), overwrite)


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    spark.dataSource.register(FastqSource)
    if isinstance(paths, str):
        return spark.read.format("fastq").load(paths)
    return spark.read.format("fastq").option("paths", json.dumps(paths)).load()


def parsed(files: DataFrame) -> DataFrame:
    """Reads of a table or stream of files (path, content)."""

    def run(got):
        for batch in got:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                yield from batches(iter(io.StringIO(data.decode("latin-1"))), path)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """Reads of files in any store that Spark reads; a file must fit in one row (2 GB)."""
    return parsed(spark.read.format("binaryFile").load(path))


def write_fastq(trimmed: DataFrame, path: str, compressed: bool = False, files_per_label: int = 1, mode: str = "overwrite") -> None:
    """<path>/<label>.trimmed.fastq[.gz]; a frequent label can be spread over several files, numbered from 0.

    In file names "_" stands for the characters of a label that would leave the folder or hide the file.
    """
    from ..operators.trim import fastq_text

    trimmed.sparkSession.dataSource.register(FastqSource)
    os.makedirs(path.removeprefix("file://"), exist_ok=True)
    part = F.pmod(F.xxhash64("id"), F.lit(files_per_label))
    safe = F.regexp_replace("label", r"^\.|[/\\\x00-\x1f]", "_")
    name = F.concat(safe, F.lit(".trimmed") if files_per_label == 1 else F.concat(F.lit(".trimmed."), part.cast("string")), F.lit(".fastq"))
    rows = fastq_text(trimmed.withColumn("label", name)).withColumnRenamed("label", "file")
    rows.repartition("file").sortWithinPartitions("file").write.format("fastq").option("path", path).option("gzip", str(compressed).lower()).mode(mode).save()
