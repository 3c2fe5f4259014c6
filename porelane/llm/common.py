"""Shared plumbing: input tables, scratch tables in the shared folder, byte blobs, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MOST_BUCKETS = 50_000  # Spark refuses more than 100,000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir; a folder of our own only where that is unset and the run is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that driver and executors share")
        root = getattr(spark.sparkContext, "_porelane_scratch", "")
        if not root:
            root = spark.sparkContext._porelane_scratch = "file://" + tempfile.mkdtemp(prefix="porelane-")
    return root.rstrip("/")


@contextmanager
def freeing_shuffles(spark: SparkSession):
    """Shuffle files of what is written meanwhile go when it is written: the table stands in their place."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a scratch table in the shared folder and return the reread table: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/porelane/{name}-{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._porelane_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._porelane_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, name: str, column: str, buckets: int, **options) -> DataFrame:
    """Like written, dealt into buckets by the column: a join on it doesn't shuffle this side again.

    Spark writes buckets only through the catalog; the entry goes at once (the table is external,
    so the files stay, and the returned plan has them resolved).
    """
    spark = df.sparkSession
    unique = f"{name}-{uuid.uuid4().hex}"
    path, entry = f"{scratch_root(spark)}/porelane/{unique}", f"porelane_{unique.replace('-', '_')}"
    with freeing_shuffles(spark):
        df.write.bucketBy(buckets, column).option("path", path).options(**options).saveAsTable(entry)
    out = spark.table(entry)
    assert out.schema is not None  # analysed before the entry goes
    spark.sql(f"DROP TABLE {entry}")
    out._porelane_path = path
    return out


def free(name: str, columns: list[str]) -> str:
    """The name, or with underscores before it where columns have it (Spark doesn't tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in the whole table; sizes partitions, never results."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unblob(value, dtype) -> np.ndarray:
    return np.frombuffer(value.as_buffer() if hasattr(value, "as_buffer") else value, dtype)


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def in_batches(made: dict[str, list], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    """Record batches of a few rows each: rows that hold blobs are large."""
    n = len(next(iter(made.values())))
    for a in range(0, n, size):
        yield rows(schema, **{k: v[a : a + size] for k, v in made.items()})


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by bucket and the n+1 bounds of each bucket in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected long edges: node, component (its smallest node).

    Each round maps every node to its smallest neighbour (or itself) and contracts the
    edges by that map, which keeps connectivity; it ends when no edge is left.  Hubs are
    aggregated before the shuffle and joined as a skewed side, never gathered.
    Nodes without an edge to another node are not returned.
    """
    edges = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels, old = None, []
    while not edges.isEmpty():
        low = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to"))
        low = written(low, "hook")
        step = low.where("node <> to")
        if labels is None:
            new = low.select("node", F.col("to").alias("component"))
        else:
            new = labels.join(step.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        new = written(new, "labels")
        ea = edges.join(step, F.col("a") == F.col("node"), "left").select(F.coalesce("to", "a").alias("a"), "b")
        eb = ea.join(step, F.col("b") == F.col("node"), "left").select("a", F.coalesce("to", "b").alias("b"))
        nxt = written(eb.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        dropped(edges, low, *([labels] if labels is not None else []))
        labels, edges = new, nxt
    dropped(edges)
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    # a label of an earlier round can itself have been mapped on since; the contraction keeps both in one chain
    return labels


def with_least(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """df with the least value of all rows of each row's key, which isn't null; no key's rows meet in one task.

    Keys with more than a thousandth of all rows are broadcast, fewer than a thousand of them at any
    size; the others are joined by key.
    """
    df = written(df, "grouped")
    least = written(df.groupBy(key).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("__rows")), "least")
    total = least.agg(F.sum("__rows")).first()[0] or 0
    hot = least.where(F.col("__rows") * 1000 > total).drop("__rows")
    rest = df.join(F.broadcast(hot.select(key)), key, "left_anti").join(least.where(F.col("__rows") * 1000 <= total).drop("__rows"), key)
    return df.join(F.broadcast(hot), key).unionByName(rest)


def spark_hash(values: np.ndarray) -> np.ndarray:
    """Spark's hash of a long column (Murmur3, seed 42), by which tables are bucketed."""
    m = np.uint64(0xFFFFFFFF)

    def turn(x, r):
        return ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & m

    h, v = np.full(len(values), 42, np.uint64), values.astype(np.uint64)
    for half in (v & m, v >> np.uint64(32)):
        k = turn(half * np.uint64(0xCC9E2D51) & m, 15) * np.uint64(0x1B873593) & m
        h = (turn(h ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & m
    h ^= np.uint64(8)
    h = (h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B) & m
    h = (h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35) & m
    return (h ^ (h >> np.uint64(16))).astype(np.uint32).view(np.int32)


def value_of_task(task: int, buckets: int) -> int:
    """A value for each task number, different ones for all tasks; Spark puts the first `buckets` into a bucket each."""
    bucket, nth = task % buckets, task // buckets
    at = bucket
    while True:
        some = at + np.arange(4096, dtype=np.int64) * buckets
        hit = np.flatnonzero(spark_hash(some).astype(np.int64) % buckets == bucket)
        if len(hit) > nth:
            return int(some[hit[nth]])
        nth -= len(hit)
        at = int(some[-1]) + buckets


def chunk_table(docs: DataFrame, name: str, text: str = "text", max_bytes: int = 2_000_000) -> DataFrame:
    """docs as a scratch table of chunks: part, seq, docs (whole rows, about max_bytes of text, as one Arrow stream).

    It is bucketed by part (one part a task; one part a bucket up to MOST_BUCKETS of them), so what is
    joined to it by part is shuffled and the texts are not; the JVM handles compressed bytes only.
    """
    from .words import slices

    spark = docs.sparkSession
    n = min(MOST_BUCKETS, max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, size = value_of_task(TaskContext.get().partitionId(), n), 0, [], 0

        def chunk():
            got = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, got.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(got)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "seq", "docs"])

        for batch in batches:
            for piece in slices(batch, text, max_bytes):
                more = pc.sum(pc.binary_length(piece.column(text))).as_py() or 0
                if held and size + more > max_bytes:
                    yield chunk()
                    seq, held, size = seq + 1, [], 0
                held.append(piece)
                size += more
        if held:
            yield chunk()
        trimmed_memory()

    return bucketed(docs.mapInArrow(run, "part long, seq int, docs binary"), name, "part", n, compression="none", **{"parquet.block.size": 16 << 20})


def chunk_docs(batch: pa.RecordBatch):
    """(row, documents of that chunk as a record batch) of every row of a batch with the column docs."""
    for r in range(batch.num_rows):
        with pa.ipc.open_stream(batch.column("docs")[r].as_buffer()) as stream:
            yield r, stream.read_all().combine_chunks().to_batches()[0]


SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("seq", pa.int32()), ("val", pa.binary()), ("num", pa.binary())])


def send_values(part: int, seq: int, values: np.ndarray, num: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk's sorted distinct 64-bit values (or rows that begin with one), each with a number, dealt out by their highest bits."""
    first = values if values.ndim == 1 else values[:, 0]
    cut = np.searchsorted((first >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
    s = [slice(a, b) for a, b in zip(cut, cut[1:])]
    full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
    if full:
        yield from in_batches({"bucket": full, "part": [part] * len(full), "seq": [seq] * len(full), "val": [blob(values[s[b]]) for b in full], "num": [blob(num[s[b]]) for b in full]}, SENT)


SENT_SQL = "bucket int, part long, seq int, val binary, num binary"


def with_answers(chunks: DataFrame, answered: DataFrame, name: str = "answers", values: tuple[str, ...] = ("ans",)) -> DataFrame:
    """chunks with the answers (seq, bucket, values) to each chunk's questions as one more column.

    The join is on part, which chunks are bucketed by; each row keeps its own answers only.
    """
    listed = answered.groupBy("part").agg(F.collect_list(F.struct("seq", "bucket", *values)).alias("__all"))  # one small row a part
    own = F.filter("__all", lambda a: a["seq"] == F.col("seq"))
    return chunks.join(listed, "part", "left").select(*chunks.columns, own.alias(name))


def answers_for(batch: pa.RecordBatch, r: int, dtype, name: str = "answers", read=None, value: str = "ans") -> np.ndarray:
    """The answers to row r's questions, in their order. read: of one answer's bytes."""
    mine = sorted((x["bucket"], x[value]) for x in batch.column(name)[r].as_py() or [])
    return np.concatenate([np.zeros(0, dtype), *((read or unblob)(x, dtype) for _, x in mine)])


def trimmed_memory() -> None:
    """Give freed memory of this worker back to the system: idle workers otherwise keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to give back
