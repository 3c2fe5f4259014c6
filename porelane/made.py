"""The reads of synth.py, made in Arrow batches of the stage that uses them.

Catalyst's md5 and translate cost more than annotation does, and whole reads would travel to Python;
here only keys travel.  `Made` is a frame of keys and the step that makes reads of its batches;
operators that work in Arrow batches put that step before their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kits, synth

_W = np.uint32
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [_W(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [_W(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: two bases, or two characters of quality, for each byte of a digest
_HEX = np.array([[b >> 4, b & 15] for b in range(256)], np.uint8)
_PAIRS = np.frombuffer(b"ACGT", np.uint8)[_HEX & 3].copy().view(np.uint16).ravel()
_QUALITY = (_HEX + ord("5")).copy().view(np.uint16).ravel()
_RC = np.zeros(256, np.uint8)
_RC[list(b"ACGT")] = list(b"TGCA")


def md5s(texts: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """(n, 16) MD5 digests of the rows of (n, size) bytes, at most 55 of them each."""
    n, size = texts.shape
    if size > 55:
        raise ValueError("longer than a block")
    out = np.empty((n, 4), "<u4")
    for at in range(0, n, chunk):
        some = texts[at : at + chunk]
        block = np.zeros((len(some), 64), np.uint8)
        block[:, :size] = some
        block[:, size] = 128
        block[:, 56:58] = 8 * size & 255, 8 * size >> 8
        words = np.ascontiguousarray(block.view("<u4").T)
        a, b, c, d = (np.full(len(some), x) for x in _START)
        f, g = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            turn = i // 16
            if turn == 0:  # d ^ (b & (c ^ d))
                np.bitwise_xor(c, d, f)
                np.bitwise_and(f, b, f)
                np.bitwise_xor(f, d, f)
            elif turn == 1:  # c ^ (d & (b ^ c))
                np.bitwise_xor(b, c, f)
                np.bitwise_and(f, d, f)
                np.bitwise_xor(f, c, f)
            elif turn == 2:
                np.bitwise_xor(b, c, f)
                np.bitwise_xor(f, d, f)
            else:
                np.invert(d, f)
                np.bitwise_or(f, b, f)
                np.bitwise_xor(f, c, f)
            np.add(f, a, f)
            np.add(f, words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16], f)
            np.add(f, _SINES[i], f)
            by = _TURNS[turn][i % 4]
            np.left_shift(f, _W(by), g)
            np.right_shift(f, _W(32 - by), f)
            np.bitwise_or(f, g, f)
            np.add(f, b, a)  # the new b takes the place of the old a
            a, b, c, d = d, a, b, c
        out[at : at + chunk] = np.stack([x + s for x, s in zip((a, b, c, d), _START)], 1)
    return out.view(np.uint8)


def _drawn(keys: np.ndarray, salts: str, pairs: np.ndarray) -> np.ndarray:
    """(n, 32 * salts) characters from the digests of each key with each salt behind it."""
    n, size = keys.shape
    text = np.empty((n, size + 1), np.uint8)
    text[:, :size] = keys
    out = np.empty((n, 16 * len(salts)), np.uint16)
    for i, salt in enumerate(salts):
        text[:, size] = ord(salt)
        out[:, 16 * i : 16 * i + 16] = pairs[md5s(text)]
    return out.view(np.uint8)


def _rows(column: pa.Array):
    """Numbers of the rows of each length of a column of texts, and their bytes; null rows leave."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, np.diff(offsets))
    for n in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == n)
        yield at, data[offsets[at][:, None] + np.arange(n)[None, :]]


def texts_of(size: np.ndarray, parts, null: np.ndarray) -> pa.Array:
    """A column of texts of these sizes; parts: (row numbers, (n, width) bytes of which a row's first ones count)."""
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of over 2 GB of reads: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    data = np.empty(int(offsets[-1]), np.uint8)
    for at, rows in parts:
        for n in np.unique(size[at]).tolist():
            if n:
                some = np.flatnonzero(size[at] == n)
                sliding_window_view(data, n, writeable=True)[offsets[at[some]]] = rows[some, :n]
    valid = pa.py_buffer(np.packbits(~null, bitorder="little")) if null.any() else None
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data), valid)


def _adapters() -> np.ndarray:
    return np.stack([np.frombuffer(f"{synth.LEFT}{kits.barcode(x)}{synth.RIGHT}".encode(), np.uint8) for x in kits.label_range("RBK01", "RBK96")])


def _sequences(batch: pa.RecordBatch, adapters: np.ndarray) -> tuple[np.ndarray, list]:
    """Lengths and bytes of the reads without noise, by scenario."""
    size, parts = np.zeros(batch.num_rows, np.int64), []
    scenario, first, second = (batch.column(c).fill_null(0).to_numpy() for c in ("scenario", "__first", "__second"))
    for at, keys in _rows(batch.column("__key")):
        whole = _drawn(keys, "abcdefghijklmnopqrst", _PAIRS)
        for s in np.unique(scenario[at]).tolist():
            mine = scenario[at] == s
            rows, body = at[mine], whole[mine]
            one, two = adapters[first[rows]], adapters[second[rows]]
            if s == 0:
                got = [body]
            elif s == 1:
                got = [one, body]
            elif s == 2:
                got = [one[:, 10:], body]
            elif s == 3:
                got = [one, body[:, :10], two, body]
            elif s == 4:
                got = [one, body[:, :320], two, body[:, 320:]]
            else:
                got = [one, body, _RC[two[:, ::-1]]]
            parts.append((rows, np.concatenate(got, 1)))
            size[rows] = parts[-1][1].shape[1]
    return size, parts


def _qualities(column: pa.Array, size: np.ndarray, null: np.ndarray) -> pa.Array:
    most = int(size.max(initial=0))
    return texts_of(size, ((at, np.tile(_drawn(keys, "q", _QUALITY), -(-most // 32))) for at, keys in _rows(column)), null)


def _noised(size: np.ndarray, parts: list, noise: np.ndarray) -> np.ndarray:
    """Lengths, and parts in place, after each read's edits. noise: how many, then place, base and kind of each."""
    size = size.copy()
    for p, (at, rows) in enumerate(parts):
        got = []
        for r, drawn in zip(rows, noise[at].tolist()):
            text = bytearray(r)
            for i in range(drawn[0]):
                place, base, kind = drawn[3 * i + 1 : 3 * i + 4]
                place %= len(text)
                text[place + (kind > 1) : place + 1] = b"" if kind == 1 else b"ACGT"[base : base + 1]
            got.append(text)
        size[at] = [len(t) for t in got]
        wide = int(size[at].max(initial=0))
        parts[p] = at, np.frombuffer(b"".join(t.ljust(wide) for t in got), np.uint8).reshape(len(at), wide)
    return size


@dataclass
class Made:
    """keys: the frame whose batches step turns into rows of schema."""

    keys: DataFrame
    schema: T.StructType
    step: Callable[[pa.RecordBatch], pa.RecordBatch]

    def frame(self) -> DataFrame:
        return self.then(self.schema, lambda batches: batches)

    def then(self, schema, run) -> DataFrame:
        """mapInArrow of these reads, in one stage with making them."""
        step = self.step
        return self.keys.mapInArrow(lambda batches: run(step(b) for b in batches), schema)


def stage(reads: DataFrame | Made, schema, run) -> DataFrame:
    return reads.then(schema, run) if isinstance(reads, Made) else reads.mapInArrow(run, schema)


def _made(orders: DataFrame, columns: tuple[str, ...], edits: int | None) -> Made:
    k = F.col("o_orderkey")
    read_id, s = F.concat(F.lit("read"), k.cast("string")), k % 6
    known = {
        "read_id": read_id,
        "desc": F.concat(F.lit("order "), k.cast("string")),
        "scenario": s.cast("int"),
        "label": F.when(s > 0, synth.label_at(k % 96)),
    }
    hidden = {"scenario": known["scenario"], "__key": k.cast("string"), "__first": (k % 96).cast("int"), "__second": ((k * 7 + 5) % 96).cast("int")}
    if edits is not None:
        hidden |= {"__id": read_id, "__noise": F.array(*synth.noise(read_id, edits))}
    keys = orders.select(*(c.alias(n) for n, c in ({n: c for n, c in known.items() if n in columns} | hidden).items()))
    types = {"scenario": T.IntegerType()}
    schema = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in columns])
    adapters = _adapters()

    def step(batch):
        null = batch.column("__key").is_null().to_numpy(zero_copy_only=False)
        size, parts = _sequences(batch, adapters)
        if edits is not None:
            drawn = batch.column("__noise").flatten().fill_null(0).to_numpy().reshape(batch.num_rows, -1)
            size = _noised(size, parts, drawn)
        out = []
        for n in columns:
            if n == "seq":
                out.append(texts_of(size, parts, null))
            elif n == "qual":
                out.append(_qualities(batch.column("__key" if edits is None else "__id"), size, null))
            else:
                out.append(batch.column(n))
        return pa.RecordBatch.from_arrays(out, names=list(columns))

    return Made(keys, schema, step)


ALL = "read_id", "desc", "scenario", "label", "seq", "qual"


def planted_reads(orders: DataFrame, *columns: str) -> Made:
    """These columns of synth.planted_reads (all by default)."""
    return _made(orders, columns or ALL, None)


def noisy_reads(orders: DataFrame, *columns: str, edits: int = 6) -> Made:
    """These columns of synth.noisy_reads (all by default)."""
    return _made(orders, columns or ALL, edits)
