"""Operator 2: media columns stored as content-defined chunks.

A payload becomes 8-bit mono PCM WAV bytes (44-byte header, then one sample a byte: lossless).
A rolling gear hash cuts the stored form where its low bits are zero, chunk digests are
deduplicated by an aggregate and joined back, and each document's ordered chunk list is
joined to the chunk store, concatenated, verified against the digest taken at writing, parsed
and measured.  Lists and chunk store are tables in the shared folder: what is measured is read
back from there.  Chunks are stored compressed, with a dictionary trained on a bounded sample
(`sample` texts of smallest hash, 32,768 characters of each); it changes what is stored, never a result.  The list of a
document of one chunk is complete after the join, so only longer ones are brought together.

Hot groups: copies of a text share one list; the store keeps one row a digest (partial
aggregation drops copies in each map task); a chunk of very many lists is joined with a salt;
the final join on the text's key has one row on one side, so adaptive execution splits a hot
key.  A text's chunks meet in one row, which is no larger than the text.

A text is known by its SHA-256.

Edge cases: null text is empty (64 zero bytes); repeated rows are returned each; an empty
table gives no rows; extra columns are ignored.  A failed check raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BUCKETS, bucketed, rows, trimmed_memory, written
from .words import mix64

BLOCK = 64  # payloads are padded to a multiple of this; also the gear hash's window
_GEAR = mix64(np.arange(1000, 1256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def payload(data: bytes) -> bytes:
    """The bytes, padded with 0 to a positive multiple of 64."""
    return data + bytes((-len(data)) % BLOCK or (0 if data else BLOCK))


def to_wav(samples: bytes, rate: int = 8000) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def from_wav(media: bytes) -> bytes:
    kind, _, wave = struct.unpack_from("<4sI4s", media)
    _, code, channels, _, _, _, bits = struct.unpack_from("<IHHIIHH", media, 16)
    n = struct.unpack_from("<I", media, 40)[0]
    if (kind, wave, code, channels, bits, media[36:40]) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or len(media) != 44 + n:
        raise ValueError("not a stored payload")
    return media[44:]


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 * h[i-1] + G[data[i]] modulo 2**64: each value depends on the last 64 bytes."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16, 32):
        if len(h) <= step:
            break
        h[step:] += h[:-step] << np.uint64(step)  # the right side is evaluated before it is added
    return h


def cuts(data: bytes, low: int = 2048, bits: int = 12, high: int = 32768) -> list[int]:
    """Ends of the chunks: where the hash's low bits are 0, at least low and at most high bytes apart."""
    n, out, at = len(data), [], 0
    if n > low:
        h = gear(np.frombuffer(data, np.uint8))
        where = np.flatnonzero(h & np.uint64((1 << bits) - 1) == 0) + 1
        while n - at > low:
            k = np.searchsorted(where, at + low)
            end = int(where[k]) if k < len(where) else n
            at = min(end, at + high, n)
            out.append(at)
    if at < n:
        out.append(n)
    return out


CHUNKS = pa.schema([("key", pa.binary()), ("n_bytes", pa.int64()), ("whole", pa.binary()), ("n_chunks", pa.int32()), ("ord", pa.int32()), ("digest", pa.binary()), ("packed", pa.binary())])
CHUNKS_SQL = "key binary, n_bytes long, whole binary, n_chunks int, ord int, digest binary, packed binary"


def dictionary(docs: DataFrame, sample: int, size: int = 65_536) -> bytes | None:
    """A compression dictionary from at most `sample` texts; None where there is too little text."""
    import zstandard

    hashed = docs.where("length(text) > 0").select("text", F.xxhash64("text").alias("h"))
    # hashes alone first, so that no more than the sample's texts go to the driver
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not least:
        return None
    some = [r["text"].encode() for r in hashed.where(F.col("h") <= least[-1]).groupBy("h").agg(F.first(F.substring("text", 1, 32_768)).alias("text")).orderBy("h").collect()]
    if sum(map(len, some)) < 20 * size:
        return None
    return zstandard.train_dictionary(size, some).as_bytes()


def codec(words: bytes | None) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}


def chunked(docs: DataFrame, store: bool, words: bytes | None = None) -> DataFrame:
    """One row a chunk, with its bytes (store) or only as an entry of its document's list."""

    def cut(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=6, write_content_size=True, **codec(words))
        for batch in batches:
            out = {n: [] for n in CHUNKS.names}
            seen, size = set(), 0
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                data = (text.as_py() or "").encode()
                media = to_wav(payload(data))
                at, whole = 0, None if store else hashlib.sha256(media).digest()
                ends = cuts(media)
                for i, end in enumerate(ends):
                    piece = media[at:end]
                    at = end
                    digest = hashlib.sha256(piece).digest()
                    if store and digest in seen:
                        continue
                    packed = None
                    if store:
                        seen.add(digest)
                        packed = pack.compress(piece)
                        size += len(packed)
                    for k, v in zip(CHUNKS.names, (key, len(data), whole, len(ends), i, digest, packed)):
                        out[k].append(v)
                if size > 1 << 23:
                    yield rows(CHUNKS, **out)
                    out, size = {n: [] for n in CHUNKS.names}, 0
            yield rows(CHUNKS, **out)
            del out, seen
            trimmed_memory()

    return docs.mapInArrow(cut, CHUNKS_SQL)


FEATURES = pa.schema([("key", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_chunks", pa.int64())])
FEATURES_SQL = "key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def feature(samples: np.ndarray) -> str:
    """Exact integers of the samples: sum, sum of squares, crossings of 128, distinct values, most common value."""
    x = samples.astype(np.int64)
    count = np.bincount(samples, minlength=256)
    return f"sum={x.sum()};squares={(x * x).sum()};crossings={np.count_nonzero(np.diff(samples >= 128))};distinct={np.count_nonzero(count)};mode={count.argmax()}"


def reread(found: DataFrame, words: bytes | None) -> DataFrame:
    """Rows (key, n_bytes, whole, list of (ord, digest, packed)): the media put together, verified and measured."""

    def read(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor(**codec(words))
        for batch in batches:
            out = {n: [] for n in FEATURES.names}
            for r in range(batch.num_rows):
                key, n_bytes, whole, parts = (batch.column(c)[r].as_py() for c in ("key", "n_bytes", "whole", "list"))
                pieces = []
                for part in sorted(parts, key=lambda x: x["ord"]):
                    piece = unpack.decompress(part["packed"])
                    if hashlib.sha256(piece).digest() != part["digest"]:
                        raise ValueError(f"chunk {part['ord']} of media {whole.hex()} differs from its digest")
                    pieces.append(piece)
                stored = b"".join(pieces)
                if hashlib.sha256(stored).digest() != whole:
                    raise ValueError(f"the chunk list doesn't give the media {whole.hex()}")
                samples = from_wav(stored)
                values = (key, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(stored), whole.hex(), feature(np.frombuffer(samples, np.uint8)), len(parts))
                for k, v in zip(FEATURES.names, values):
                    out[k].append(v)
            yield rows(FEATURES, **out)
            trimmed_memory()

    return found.select("key", "n_bytes", "whole", "list").mapInArrow(read, FEATURES_SQL)


def stored(docs: DataFrame, sample: int = 1000) -> tuple[DataFrame, DataFrame, bytes | None]:
    """Chunk lists (key, n_bytes, whole, n_chunks, ord, digest), chunk store (digest, packed) and the packing's dictionary.

    docs: key, text.  Both are tables in the shared folder; lists are kept once for each distinct text.
    """
    spark = docs.sparkSession
    words = dictionary(docs, sample)
    listed = chunked(docs, False).groupBy("key", "n_chunks", "ord").agg(F.first("n_bytes").alias("n_bytes"), F.first("whole").alias("whole"), F.first("digest").alias("digest"))
    listed = written(listed, "lists")
    store = chunked(docs, True, words).select("digest", "packed").groupBy("digest").agg(F.first("packed").alias("packed"))
    buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    store = bucketed(store, "store", "digest", buckets, compression="none")
    return listed, store, words


def assembled(listed: DataFrame, store: DataFrame, hot: int) -> DataFrame:
    """key, n_bytes, whole, list of (ord, digest, packed): every list with its chunks.

    A chunk in more than `hot` lists is joined apart, its lists dealt out by a salt.
    """
    often = written(listed.groupBy("digest").count().where(F.col("count") > hot), "hot")
    found = [(listed, store, ["digest"])]
    n = often.count()
    if n:
        often = F.broadcast(often) if n <= 100_000 else often  # checked: 40 bytes a row; a shuffled join beyond it
        salts = F.ceil(F.col("count") / hot)
        apart = listed.join(often, "digest").withColumn("salt", F.pmod(F.xxhash64("key"), salts)).drop("count")
        dealt = store.join(often, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("count")
        found = [(listed.join(often, "digest", "left_anti"), store, ["digest"]), (apart, dealt, ["digest", "salt"])]
    part = F.struct("ord", "digest", "packed")
    columns = "key", "n_bytes", "whole"
    one = [a.where("n_chunks = 1").join(b, on).select(*columns, F.array(part).alias("list")) for a, b, on in found]
    more = [a.where("n_chunks > 1").join(b, on).select(*columns, "n_chunks", part.alias("part")) for a, b, on in found]
    whole = reduce(DataFrame.unionByName, more).groupBy("key").agg(F.first("n_bytes").alias("n_bytes"), F.first("whole").alias("whole"), F.first("n_chunks").alias("n_chunks"), F.collect_list("part").alias("list"))
    whole = whole.where(F.when(F.size("list") == F.col("n_chunks"), True).otherwise(F.raise_error(F.lit("a chunk is not in the store")).cast("boolean")))
    return reduce(DataFrame.unionByName, [*one, whole.select(*columns, "list")])


def media(docs: DataFrame, sample: int = 1000, hot: int = 20_000) -> DataFrame:
    """Store every text as chunked media, read it back from the chunk store and measure it."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("key"))
    listed, store, words = stored(keyed.select("key", "text"), sample)
    features = reread(assembled(listed, store, hot), words)
    return keyed.select("doc_id", "key").join(features, "key").drop("key")
