"""Vectorised word handling on Arrow string buffers.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  A batch of texts is
handled as one byte array with offsets, so no Python string is built per word.

Hashes have 64 bits: a word is folded in lanes of eight bytes and a run of words by doubling,
each step a multiplication, a shift that mixes high bits into low ones, and another
multiplication; words of more than LONG bytes take xxh3.  Two given values share a hash with
probability 2**-64; among n distinct values some n * n / 2**65 pairs do, 2.7 of 10**10 values.
Operators whose results may not depend on that use 128 bits or compare the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
#: separators for models: white space, control characters and ASCII punctuation
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche mix of unsigned 64-bit values (bijective)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_K1, _K2 = U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93)
BLOCK = 1 << 17  # words hashed at a time
LONG = 256  # bytes


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair (a, b); for one a, different b have different hashes."""
    x = a * _K1
    x += b
    x ^= x >> U(32)
    x *= _K2
    x ^= x >> U(29)
    return x


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return data, offsets - lo


class Words:
    """Words of a batch of texts: byte spans, hashes, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, separators: np.ndarray = _WS):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        ink = ~separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first, last = ink.copy(), ink
        first[1:] &= ~ink[:-1] | edge[1:-1]
        last = ink.copy()
        last[:-1] &= ~ink[1:] | edge[1:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: words of text i: bounds[i] <= w < bounds[i + 1]
        self.bounds = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """Of every word; BLOCK words at a time, so memory doesn't grow with the batch."""
        out = np.empty(len(self.start), U)
        for w in range(0, len(out), BLOCK):
            start, end = self.start[w : w + BLOCK], self.end[w : w + BLOCK]
            first = int(start[0])
            raw = self.data[first : int(end[-1])]
            lanes = np.concatenate([raw, np.zeros(16 - len(raw) % 8, np.uint8)]).view("<u8")
            out[w : w + BLOCK] = self._block(lanes, start - first, end - start)
        for w in np.flatnonzero(self.end - self.start > LONG):
            out[w] = xxhash.xxh3_64_intdigest(self.data[self.start[w] : self.end[w]].tobytes())
        return out

    @staticmethod
    def _block(lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        h, live = mix64(size.astype(U)), np.arange(len(start))
        for k in range(0, LONG, 8):
            at, left = start[live] + k, size[live] - k
            shift = (at.astype(U) & U(7)) << U(3)
            x = lanes[at >> 3] >> shift
            # shifted in two steps: a shift by 64 bits isn't defined
            x |= (lanes[(at >> 3) + 1] << (U(63) - shift)) << U(1)
            x &= U(0xFFFFFFFFFFFFFFFF) >> ((U(8) - np.minimum(left, 8).astype(U)) << U(3))
            h[live] = join(h[live], x)
            live = live[left > 8]
            if not len(live):
                break
        return mix64(h)


def runs(word: np.ndarray, bounds: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, and n+1 bounds of each text's runs.

    Run r of text i starts at its text's word r - run_bounds[i].
    """
    counts = np.maximum(np.diff(bounds) - (k - 1), 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if not out[-1]:
        return np.zeros(0, U), out
    # part: runs of a power of two words; whole: of as many as the bits of k so far say
    part, width, whole, done = word ^ U(seed), 1, None, 0
    while width <= k:
        if k & width:
            n = len(word) - done - width + 1
            whole = part[:n] if whole is None else join(whole[:n], part[done : done + n])
            done += width
        if width * 2 <= k:
            part = join(part[:-width], part[width:])
        width *= 2
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], counts)
    return mix64(whole[at] + U(k)), out


def shingles(word: np.ndarray, bounds: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words: the whole sequence as one."""
    run, at = runs(word, bounds, k)
    out = []
    for i in range(len(bounds) - 1):
        a, b = at[i], at[i + 1]
        m = bounds[i + 1] - bounds[i]
        if b > a:
            out.append(np.unique(run[a:b]))
        elif m:
            out.append(runs(word[bounds[i] : bounds[i + 1]], np.array([0, m]), int(m))[0])
        else:
            out.append(run[:0])
    return out


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 20):
    """The batch in row slices of about max_bytes of text each (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.concatenate([[0], np.cumsum(size)[:-1]]) // max_bytes if len(size) else size
    cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield batch.slice(a, b - a)
