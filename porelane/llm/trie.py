"""An n-gram trie of Elias-Fano levels in a memory-mapped file, queried in batches."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np

U = np.uint64
BLOCK = 32  # bytes of high bits between two sampled ranks
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
#: ones in a byte; place of the k-th one, or zero, in a byte
_ONES = _BITS.sum(1).astype(np.uint16)
_PLACE = np.argsort(_BITS == 0, axis=1, kind="stable"), np.argsort(_BITS, axis=1, kind="stable")


class EliasFano:
    """A non-decreasing sequence: low bits in byte planes, high bits in unary, sampled ranks.

    All three stay views of a mapped file: planes (one byte of the low part each), bits
    (packed: for each high value its elements as ones, then a zero; whole blocks) and ranks
    (ones before each block).
    """

    def __init__(self, n: int, low: int, planes: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.n, self.low, self.planes, self.ranks = n, low, planes, ranks
        self.blocks = bits.reshape(-1, BLOCK)
        self.zeros = np.arange(len(ranks)) * (8 * BLOCK) - ranks.astype(np.int64)  # 8 bytes for 256 bits
        self.highs = len(self.blocks) * 8 * BLOCK - int(ranks[-1]) - int(_ONES[self.blocks[-1]].sum()) if len(ranks) else 0

    @staticmethod
    def parts(values: np.ndarray) -> dict:
        n = len(values)
        top = int(values[-1]) if n else 0
        low = 8 * max(0, (max(1, top // max(1, n)).bit_length() - 1 + 4) // 8)  # whole bytes nearest to log2(universe / n)
        high = (values >> U(low)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 1
        bits = np.ones(size + -size % (8 * BLOCK), np.uint8)
        bits[:size] = 0
        bits[high + np.arange(n)] = 1
        bits = np.packbits(bits)
        ones = _ONES[bits].reshape(-1, BLOCK).sum(1)
        planes = np.stack([(values >> U(8 * k)).astype(np.uint8) for k in range(low // 8)]) if low else np.zeros((0, n), np.uint8)
        return {"n": n, "low": low, "planes": planes, "bits": bits, "ranks": (np.cumsum(ones) - ones).astype("<u8")}

    def select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Position of the k-th one or zero among the high bits."""
        out = np.empty(len(k), np.int64)
        ranks = self.zeros if zero else self.ranks.astype(np.int64)
        for a in range(0, len(k), 1 << 15):
            some = k[a : a + (1 << 15)]
            block = np.searchsorted(ranks, some, side="right") - 1
            left = some - ranks[block]
            raw = self.blocks[block]
            upto = np.cumsum(8 - _ONES[raw] if zero else _ONES[raw], axis=1, dtype=np.int16)
            byte = (upto <= left[:, None]).sum(1)
            row = np.arange(len(some))
            left = left - np.where(byte > 0, upto[row, byte - 1], 0)
            out[a : a + (1 << 15)] = block * (8 * BLOCK) + byte * 8 + _PLACE[zero][raw[row, byte], left]
        return out

    def lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), U)
        for k in range(len(self.planes)):
            out |= self.planes[k][at].astype(U) << U(8 * k)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        return (self.select(at, False) - at).astype(U) << U(self.low) | self.lows(at)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element >= x, n if there is none; whether it is x."""
        high = (x >> U(self.low)).astype(np.int64)
        a, b = np.full(len(x), self.n), np.full(len(x), self.n)
        some = np.flatnonzero(high < self.highs)
        b[some] = self.select(high[some], True) - high[some]
        a[some] = 0
        some = some[high[some] > 0]
        a[some] = self.select(high[some] - 1, True) - high[some] + 1
        end = b.copy()
        want = x & U((1 << self.low) - 1)
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self.lows(mid) < want[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        hit = a < end
        hit[hit] = self.lows(a[hit]) == want[hit]
        return a, hit


LEAST = -14.0  # log10 of the least probability that a code stands for


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 (0: unseen), evenly spaced in the root of the logarithm: finest for likely words."""
    x = np.minimum(-np.log10(np.maximum(p, 10.0**LEAST)), -LEAST)
    return (255 - np.rint(np.sqrt(np.maximum(x, 0) / -LEAST) * 254)).astype(np.uint8)


#: probability of each code
MEANS = np.concatenate([[0.0], 10 ** (LEAST * ((255 - np.arange(1, 256)) / 254) ** 2)])


def heads(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Of sorted rows, for each number of columns where a new prefix of that many begins."""
    out, new = [], np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
        out.append(np.flatnonzero(new))
    return out


class Trie:
    """A level for each word of the n-grams: first words, then the successors of each node.

    Beside a level stand monotone pointers from each node of the level above to its range.
    A level holds word + base(parent), where the base is the last value of the range before,
    so it is one monotone sequence; a successor is searched relative to its context.  Each
    n-gram has a quantised smoothed probability.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = json.loads(f.readline())
            at = f.tell()
        mapped = np.memmap(path, np.uint8, "r")
        made = []
        for spec in head["levels"]:
            size = spec["low"] // 8 * spec["n"]
            planes = mapped[at : at + size].reshape(spec["low"] // 8, spec["n"])
            at += size
            bits = mapped[at : at + spec["bits"]]
            at += spec["bits"]
            ranks = mapped[at : at + spec["bits"] // BLOCK * 8].view("<u8")
            at += len(ranks) * 8
            made.append(EliasFano(spec["n"], spec["low"], planes, bits, ranks))
        self.words, self.pointers = made[::2], made[1::2]
        self.codes = mapped[at : at + self.words[-1].n]

    @staticmethod
    def write(path: str, columns: list[np.ndarray], probability: np.ndarray) -> None:
        """Sorted distinct n-grams (a column a word, ids from 1) with their probabilities."""
        levels, above = [], None
        for column, head in zip(columns, heads(columns)):
            word = column[head].astype(U)
            if above is not None:
                first = np.searchsorted(head, above)  # each parent's first child
                end = np.append(first[1:], len(head))
                last = word[end - 1] if len(head) else word
                base = np.concatenate([np.zeros(1, U), np.cumsum(last, dtype=U)])[: len(first)]
                word = word + np.repeat(base, end - first)
                levels.append(EliasFano.parts(np.append(first, len(head)).astype(U)))
            levels.append(EliasFano.parts(word))
            above = head
        with open(path, "wb") as f:
            f.write(json.dumps({"levels": [{"n": x["n"], "low": x["low"], "bits": len(x["bits"])} for x in levels]}).encode() + b"\n")
            for x in levels:
                for name in ("planes", "bits", "ranks"):
                    f.write(x[name].tobytes())
            f.write(quantised(probability).tobytes())

    def lookup(self, columns: list[np.ndarray]) -> np.ndarray:
        """Code of each of these sorted n-grams; 0 where the trie has none."""
        out = np.zeros(len(columns[0]), np.uint8)
        if not self.words[-1].n or not len(out):
            return out
        node = known = above = None
        for n, (column, head) in enumerate(zip(columns, heads(columns))):
            want, level = column[head].astype(U), self.words[n]
            if not n:
                node, known = level.successor(want)
            else:
                parent = np.searchsorted(above, head, side="right") - 1
                alive = np.flatnonzero(known)
                begin, end = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
                begin[alive], end[alive] = (self.pointers[n - 1].access(node[alive] + k).astype(np.int64) for k in (0, 1))
                base = np.zeros(len(known), U)
                later = alive[begin[alive] > 0]
                base[later] = level.access(begin[later] - 1)
                live = np.flatnonzero(known[parent])
                node, known = np.zeros(len(head), np.int64), np.zeros(len(head), bool)
                at, hit = level.successor(base[parent[live]] + want[live])
                of = parent[live]
                node[live], known[live] = at, hit & (at >= begin[of]) & (at < end[of])
            above = head
        # the last level has a node an n-gram; equal n-grams share it
        at = np.searchsorted(above, np.arange(len(out)), side="right") - 1
        hit = known[at]
        out[hit] = self.codes[node[at[hit]]]
        return out


def with_trie(columns: list[np.ndarray], probability: np.ndarray, use):
    """use(trie) of these n-grams, mapped from a file of this task that goes away afterwards."""
    handle, path = tempfile.mkstemp(prefix="trie-")
    os.close(handle)
    try:
        Trie.write(path, columns, probability)
        return use(Trie(path))
    finally:
        os.unlink(path)
