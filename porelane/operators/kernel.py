"""Approximate matching of flanks and barcodes for batches of reads, in numpy.

Costs are unit edit costs; where a pattern hangs over an end of the read, each run of h
overhanging characters costs floor(alpha * h).  Bit-vector columns (Myers 1999, Hyyro 2003)
give the last row of every alignment, for all reads of a batch in lockstep; alignments are
traced back only in a window before each hit.  `last_row_dp` is the plain dynamic program
that tests hold the bit vectors against.

Pinned choices: a hit ends at each local minimum of the last row that is within the cutoff,
on a plateau the rightmost column; traceback prefers diagonal, then a skipped pattern
character, then a skipped text character; hits come in order of group, strand (Fwd first),
end.  Matching folds case; IUPAC codes match if they share a base; X matches nothing.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, replace

import numpy as np
from numpy.lib.stride_tricks import as_strided, sliding_window_view

U = np.uint64
_BASES = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}
CODE = np.zeros(256, np.uint8)
for _c, _v in _BASES.items():
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _v
#: complement of a base set: A-T and C-G swapped
COMPLEMENT = np.array([(v & 1) << 3 | (v & 2) << 1 | (v & 4) >> 1 | (v & 8) >> 3 for v in range(16)], np.uint8)
MATCH, SUB, DEL, INS = 0, 1, 2, 3  # DEL: pattern character without text; INS: text character without pattern


def encode(seq: bytes | str) -> np.ndarray:
    return CODE[np.frombuffer(seq.encode() if isinstance(seq, str) else seq, np.uint8)]


def border(m: int, alpha: float) -> np.ndarray:
    """Cost of i overhanging characters, i = 0..m."""
    return np.floor(np.float32(alpha) * np.arange(m + 1, dtype=np.float32)).astype(np.int32)


def bit_tables(patterns: np.ndarray) -> np.ndarray:
    """(words, 16, patterns): for each text code the pattern positions that it matches."""
    count, m = patterns.shape
    out = np.zeros((-(-m // 64), 16, count), U)
    for code in range(16):
        hit = (patterns & code) > 0
        for i in range(m):
            out[i // 64, code] |= hit[:, i].astype(U) << U(i % 64)
    return out


def last_row(tables: np.ndarray, m: int, text: np.ndarray, left: np.ndarray, lengths: np.ndarray | None = None):
    """Costs (columns + 1, texts, patterns) of aligning each whole pattern to end at each column.

    text: codes, time-major (columns, texts).  left: costs of the first column's rows.
    With lengths, also the vertical deltas (positive, negative) at each text's last column.
    """
    words, _, count = tables.shape
    t, x = text.shape
    step = np.diff(left) > 0
    pv = [np.full((x, count), int(sum(1 << i for i in range(min(64, m - 64 * w)) if step[64 * w + i])), U) for w in range(words)]
    mv = [np.zeros((x, count), U) for _ in range(words)]
    cost = np.empty((t + 1, x, count), np.int16)
    score = np.full((x, count), left[-1], np.int16)
    cost[0] = score
    final = [[p.copy() for p in pv], [v.copy() for v in mv]] if lengths is not None else None
    top, one = U((m - 1) % 64), U(1)
    for j in range(t):
        carry, ph_in, mh_in = None, None, None
        for w in range(words):
            eq = tables[w][text[j]]
            p, n = pv[w], mv[w]
            xv = eq | n
            total = (eq & p) + p
            if words > 1:
                over = total < p
                if carry is not None:
                    total += carry
                    over |= (total == 0) & (carry > 0)
                carry = over.astype(U)
            xh = (total ^ p) | eq
            ph, mh = n | ~(xh | p), p & xh
            if w == words - 1:
                score = score + ((ph >> top) & one).astype(np.int16) - ((mh >> top) & one).astype(np.int16)
            ph_out, mh_out = ph >> U(63), mh >> U(63)
            ph, mh = ph << one, mh << one
            if ph_in is not None:
                ph |= ph_in
                mh |= mh_in
            ph_in, mh_in = ph_out, mh_out
            pv[w], mv[w] = mh | ~(xv | ph), ph & xv
        cost[j + 1] = score
        if final is not None and (done := np.flatnonzero(lengths == j + 1)).size:
            for w in range(words):
                final[0][w][done], final[1][w][done] = pv[w][done], mv[w][done]
    return cost, final


def distances(patterns: np.ndarray, text: np.ndarray, lengths: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Edit distances (texts, patterns) of whole texts and whole patterns of up to 64 characters."""
    count, m = patterns.shape
    kind = np.dtype(np.uint32 if m <= 32 else np.uint64)
    pad, signed, zero = kind.itemsize * 8 - m, np.dtype(f"i{kind.itemsize}"), np.zeros((), f"i{kind.itemsize}")
    table = np.stack([_packed(p, kind) for p in patterns], 1)
    first, all_rows = kind.type(1 << pad), kind.type((1 << kind.itemsize * 8) - (1 << pad))
    out = np.empty((text.shape[1], count), np.int32)
    for a in range(0, text.shape[1], chunk):
        size = lengths[a : a + chunk]
        x = len(size)
        pv, mv = np.full((x, count), all_rows), np.zeros((x, count), kind)
        eq, xv, ph, mh = (np.empty((x, count), kind) for _ in range(4))
        rises, falls = np.empty((x, count), bool), np.empty((x, count), bool)
        cost = np.full((x, count), m, np.int32)
        for j in range(int(size.max(initial=0))):
            table.take(text[j, a : a + x], 0, eq, "clip")
            np.bitwise_or(eq, mv, xv)
            np.bitwise_and(eq, pv, ph)
            np.add(ph, pv, ph)
            np.bitwise_xor(ph, pv, ph)
            np.bitwise_or(ph, eq, ph)
            np.bitwise_and(pv, ph, mh)
            np.bitwise_or(ph, pv, ph)
            np.invert(ph, ph)
            np.bitwise_or(ph, mv, ph)
            np.less(ph.view(signed), zero, rises)
            np.less(mh.view(signed), zero, falls)
            change = rises.view(np.int8) - falls.view(np.int8)
            cost += change if j < size.min() else np.where((j < size)[:, None], change, 0)
            np.add(ph, ph, ph)
            np.add(mh, mh, mh)
            np.bitwise_or(ph, first, ph)
            np.bitwise_and(ph, xv, mv)
            np.bitwise_or(xv, ph, xv)
            np.invert(xv, xv)
            np.bitwise_or(xv, mh, pv)
        out[a : a + x] = cost
    return out


def last_row_dp(pattern: np.ndarray, text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The same costs for one pattern and one text by the plain recurrence."""
    column = left.astype(np.int64)
    out = [column[-1]]
    for c in text:
        new = np.empty_like(column)
        new[0] = 0
        for i in range(1, len(column)):
            new[i] = min(column[i - 1] + (pattern[i - 1] & c == 0), column[i] + 1, new[i - 1] + 1)
        column = new
        out.append(column[-1])
    return np.array(out)


@dataclass
class Words:
    """A pattern for `scan`, and its longest run of N before its end: rows that only pass on costs, one
    column later each."""

    pattern: np.ndarray
    head: int  # rows above the run
    low: int  # rows above the run's end


def _packed(pattern: np.ndarray, kind) -> np.ndarray:
    """(16,) words with the pattern at the top; the bits below it match everything and stay at cost 0."""
    bits = np.dtype(kind).itemsize * 8
    pad = bits - len(pattern)
    return np.array([(1 << pad) - 1 | sum(1 << pad + i for i, p in enumerate(pattern.tolist()) if p & code) for code in range(16)], kind)


def words_of(pattern: np.ndarray) -> Words:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], pattern == 15, [0]])))
    runs = [(low - head, head, low) for head, low in zip(edge[::2].tolist(), edge[1::2].tolist()) if low < len(pattern)]
    return Words(pattern, *max(runs, default=(0, 0, 0))[1:])


def _planes(bits: np.ndarray) -> np.ndarray:
    """(t, words): bits (t, texts) of 64 texts a word."""
    t, x = bits.shape
    out = np.zeros((t, -(-x // 64) * 8), np.uint8)
    out[:, : -(-x // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return out.view("<u8")


def _singles(planes: np.ndarray, x: int) -> np.ndarray:
    return np.unpackbits(planes.view(np.uint8), axis=1, count=x, bitorder="little").view(np.int8)


def scan(words: Words, m: int, text: np.ndarray, left: np.ndarray, lengths: np.ndarray, passing: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Costs (columns + 1, texts) of one pattern, and the vertical deltas (texts, m) at each text's last column.

    Cell by cell along antidiagonals, 64 texts a word (Hyyro 2003).  Rows of the run of N are left out
    if `passing` (N matches all of the texts): rows below it are as many columns ahead.
    """
    t, x = text.shape
    step = np.diff(left) > 0
    head, low = (words.head, words.low) if passing else (0, 0)
    delay = low - head
    own = np.concatenate([np.arange(head), np.arange(low, m)])
    rows = len(own)
    ahead = np.where(own < head, 0, delay) - np.arange(rows)  # row i is at column d + ahead[i] in step d
    first, steps = min(0, head - delay), t + max(head, rows - delay) - 1
    bit = [_planes(text & np.uint8(1 << b)) for b in range(4)]
    w = bit[0].shape[1]
    kinds = np.unique(words.pattern)
    table = np.zeros((len(kinds), t, w), U)
    for i, code in enumerate(kinds.tolist()):
        for b in range(4):
            if code >> b & 1:
                table[i] |= bit[b]
    table = table.reshape(-1, w)
    at = np.searchsorted(kinds, words.pattern[own]) * t + ahead
    alive = np.zeros((t + 2, w), U)  # a column before and one after all texts
    alive[1:-1] = _planes(np.arange(t)[:, None] < lengths[None, :])
    least, furthest, last = int(lengths.min(initial=t)), int(ahead.max()), int(ahead.min())
    # planes: vertical rises and horizontal rises, vertical falls and horizontal falls. What a row hands down is in the next row's place
    views = []
    for _ in range(2):
        held = np.zeros((4, rows + 1, w), U)
        held[0, :rows][step[own]] = ~U(0)
        # a horizontal plane one row down, then the vertical plane before it
        crossed = lambda plane: as_strided(held[plane, 1:], (2, rows, w), (-(rows + 2) * w * 8, w * 8, 8))  # noqa: B023, E731
        handed = as_strided(held[1, head:], (2, 2, w), (2 * (rows + 1) * w * 8, (rows - head) * w * 8, 8))
        views.append((held, held[:2, :rows], held[2:, :rows], crossed(1), crossed(3), handed))
    (held, up, down, _, _, _), (after, _, _, up_next, down_next, handed) = views
    zero, two, now = np.empty((rows, w), U), np.empty((2, rows, w), U), np.empty(rows, np.intp)
    got = np.empty((steps - first, 2, 2, w), U)  # rises and falls of the head's and of the last row
    for d in range(first, steps):
        if head - delay <= d <= head:
            if d < head:  # the run of N hands down the first column's rows
                held[1, head], held[3, head] = 0, ~U(0) if step[2 * head - d - 1] else 0
            elif not head:
                held[1, 0] = held[3, 0] = 0
        np.add(at, d, now)
        table.take(now, 0, zero, "clip")
        np.bitwise_or(zero, down[0], zero)
        np.bitwise_or(zero, down[1], zero)
        np.bitwise_and(zero, up, down_next)
        np.bitwise_or(zero, up, two)
        np.bitwise_xor(two, down, two)
        np.invert(two, up_next)
        got[d - first] = handed
        if d + last < 0 or d + furthest >= least:  # outside of some text: vertical deltas stay
            here = alive.take(ahead + (d + 1), 0, mode="clip")
            for plane in (0, 2):
                old, new = held[plane, :rows], after[plane, :rows]
                np.bitwise_xor(new, old, new)
                np.bitwise_and(new, here, new)
                np.bitwise_xor(new, old, new)
        views.reverse()
        (held, up, down, _, _, _), (after, _, _, up_next, down_next, handed) = views
    rows_of = (_singles(held[0, :rows], x) - _singles(held[2, :rows], x)).T.astype(np.int32)
    deltas = [rows_of[:, :head], rows_of[:, head:]]
    if delay:
        # D[head + d][n] = D[head][n - d]: vertical deltas of the run are those of the head's last row, backwards, and before them the first column's rows
        col = lengths[:, None] - 1 - np.arange(delay)[None, :]
        word, place = np.arange(x)[:, None] // 64, (np.arange(x)[:, None] % 64).astype(U)
        one = lambda sign: (got[np.maximum(col, 0) + max(head - 1, 0) - first, sign, 0, word] >> place & U(1)).astype(np.int32) * (head > 0)
        deltas.insert(1, np.where(col >= 0, one(1) - one(0), step[np.clip(head - 1 - col, 0, m - 1)]))
    lasts = got[np.arange(t) - ahead[-1] - first, :, 1]
    cost = np.empty((t + 1, x), np.int16)
    cost[0] = left[-1]
    cost[1:] = _singles(np.ascontiguousarray(lasts[:, 0]), x) - _singles(np.ascontiguousarray(lasts[:, 1]), x)
    for j in range(t):
        cost[j + 1] += cost[j]
    return cost, np.concatenate(deltas, 1)


def last_column(delta: np.ndarray, at_end: np.ndarray) -> np.ndarray:
    """Costs (texts, m + 1) of all rows in each text's last column, from the vertical deltas. One pattern."""
    down = np.concatenate([np.zeros((len(at_end), 1), np.int32), np.cumsum(delta, 1)], 1)
    return at_end[:, None] - down[:, -1:] + down


def local_minima(cost: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of every hit. cost: (columns + 1, texts); columns after a text's length don't count."""
    column, text = np.divmod(np.flatnonzero(cost <= k), cost.shape[1])
    column, text = (v[column <= lengths[text]] for v in (column, text))
    end = column == lengths[text]
    rises = end | (cost[np.minimum(column + 1, len(cost) - 1), text] > cost[column, text])
    column, text = column[rises], text[rises]
    # the last change before each column: falling, or none at all
    at = column.copy()
    live = np.arange(len(at))
    while live.size:
        live = live[at[live] > 0]
        live = live[cost[at[live] - 1, text[live]] == cost[at[live], text[live]]]
        at[live] -= 1
    falls = (at == 0) | (cost[np.maximum(at - 1, 0), text] > cost[at, text])
    column, text = column[falls], text[falls]
    order = np.lexsort((column, text))
    return text[order], column[order]


@dataclass
class Paths:
    """Alignment paths, one column of the arrays each, from the path's start; steps: how many are valid."""

    i: np.ndarray
    j: np.ndarray
    op: np.ndarray
    steps: np.ndarray


def trace(pattern: np.ndarray, text: np.ndarray, end: np.ndarray, left: np.ndarray, row: np.ndarray | None = None) -> Paths:
    """Best alignments that end at text column `end` (and pattern row `row`, m by default).

    pattern: (n, m) codes; text: (n, w) codes; left: (n, m + 1) costs of the first column.
    """
    n, m = pattern.shape
    w = text.shape[1]
    d = np.empty((m + 1, n, w + 1), np.int16)
    d[0] = 0
    ramp = np.arange(w + 1, dtype=np.int16)
    for i in range(1, m + 1):
        sub = (pattern[:, i - 1, None] & text) == 0
        best = np.empty((n, w + 1), np.int16)
        best[:, 0] = left[:, i]
        np.minimum(d[i - 1][:, :-1] + sub, d[i - 1][:, 1:] + 1, out=best[:, 1:])
        d[i] = np.minimum.accumulate(best - ramp, axis=1) + ramp
    at = np.arange(n)
    i, j = (np.full(n, m) if row is None else row.copy()), end.copy()
    size = m + w + 1
    out_i, out_j, out_op = (np.zeros((size, n), np.int16) for _ in range(3))
    steps = np.zeros(n, np.int64)
    for s in range(size):
        live = (i > 0) & ((j > 0) | (left[at, i] >= i))
        # in the first column a pattern prefix is skipped at unit cost, or hangs over and ends the path
        live &= ~((j == 0) & (left[at, i] < i))
        if not live.any():
            break
        i1, j1 = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        sub = (pattern[at, i1] & text[at, np.minimum(j1, w - 1)]) == 0 if w else np.ones(n, bool)
        here = d[i, at, j]
        diagonal = (j > 0) & (d[i1, at, j1] + sub == here)
        skip = ~diagonal & (d[i1, at, j] + 1 == here)
        op = np.where(diagonal, np.where(sub, SUB, MATCH), np.where(skip, DEL, INS))
        i = np.where(live & (diagonal | skip), i1, i)
        j = np.where(live & ~skip, j1, j)
        out_i[s], out_j[s], out_op[s] = i, j, op
        steps[live] = s + 1
    # turn around: valid steps first, from the start of the path
    order = np.maximum(steps[None, :] - 1 - np.arange(size)[:, None], 0)
    take = lambda x: np.take_along_axis(x, order, 0)
    return Paths(take(out_i), take(out_j), take(out_op), steps)


def subsequence_scores(op: np.ndarray, steps: np.ndarray, decay: float = 0.5) -> np.ndarray:
    """Gap-weighted subsequence kernel of length 3 (Lodhi et al. 2002) over alignment columns; only matches count."""
    one = two = total = np.zeros(op.shape[1])
    for s in range(int(steps.max(initial=0))):
        live = s < steps
        hit = (op[s] == MATCH) & live
        total = total + hit * decay * two
        two = np.where(live, decay * two + hit * decay * one, two)
        one = np.where(live, decay * one + hit * decay, one)
    return total


@functools.cache
def perfect_score(length: int) -> float:
    return float(subsequence_scores(np.zeros((max(0, length), 1), np.int16), np.array([max(0, length)]))[0])


@dataclass
class Group:
    """Queries that share flanks: see plans/groups.py."""

    kind: str
    flank: str
    prefix: str
    suffix: str
    bar_region: tuple[int, int]  # end inclusive
    pad_region: tuple[int, int]  # end exclusive, not clamped
    labels: list[str]
    seqs: list[str]
    cutoff: int
    perfect: float = 0.0
    tables: dict = field(default_factory=dict, repr=False)

    def prepared(self) -> Group:
        if not self.tables:
            self.perfect = perfect_score(self.pad_region[1] - self.pad_region[0])
            flank = encode(self.flank)[None, :]
            bars = np.stack([encode(s) for s in self.seqs])
            back = COMPLEMENT[bars[:, ::-1]]
            self.tables = {"flank": (flank, bit_tables(flank)), "words": words_of(flank[0]), "Fwd": (bars, bit_tables(bars)), "Rc": (back, bit_tables(back))}
        return self


def search_flank(group: Group, text: np.ndarray, lengths: np.ndarray, alpha: float):
    """Hits of a group's flank in a block of reads (text: time-major codes).

    read, end, cost, row, and the window (codes, start) that the alignment lies in.
    """
    m = group.tables["flank"][0].shape[1]
    left = border(m, alpha)
    # rows of N are passed in one step, but no row matches X
    cost, delta = scan(group.tables["words"], m, text, left, lengths, np.count_nonzero(text) == lengths.sum())
    at_end = cost[lengths, np.arange(len(lengths))].astype(np.int32)
    whole = last_column(delta, at_end) + left[::-1][None, :]
    row = m - np.argmin(whole[:, ::-1], 1)  # the most pattern among equals
    cost[lengths, np.arange(len(lengths))] = whole.min(1)
    read, end = local_minima(cost, lengths, group.cutoff)
    row = np.where(end == lengths[read], row[read], m)
    return read, end, cost[end, read].astype(np.int64), row, left


def gathered(text: np.ndarray, read: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, widest) codes of text[start:end] of each read, 0 after the end."""
    width = int((end - start).max(initial=0))
    at = start[:, None] + np.arange(width)[None, :]
    return np.where(at < end[:, None], text[np.minimum(at, max(0, len(text) - 1)), read[:, None]], 0).astype(np.uint8) if width else np.zeros((len(read), 0), np.uint8)


def without_gaps(pattern: np.ndarray, text: np.ndarray, read: np.ndarray, end: np.ndarray, cost: np.ndarray, row: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Hits that an alignment without gaps explains: tracing back prefers the diagonal, so it would find that one."""
    m = len(pattern)
    at = end[:, None] - m + np.arange(m)[None, :]
    other = ((text[np.maximum(at, 0), read[:, None]] & pattern) == 0) & (at >= 0)
    over = np.maximum(m - end, 0)
    return (row == m) & (other.sum(1) + left[over] == cost) & ((over == 0) | (left[over] < over))


def both_strands(group: Group, both: np.ndarray, lengths: np.ndarray, alpha: float):
    """flank_hits of the forward strand, then of the other one. Both are searched at once."""
    x = len(lengths)
    read, *hits, left = search_flank(group, both, np.concatenate([lengths, lengths]), alpha)
    for strand in range(2):
        mine = read // x == strand
        yield flank_hits(group, both[:, strand * x : strand * x + x], lengths, STRANDS[strand], read[mine] - strand * x, *(h[mine] for h in hits), left)


def flank_hits(group: Group, text: np.ndarray, lengths: np.ndarray, strand: str, read: np.ndarray, end: np.ndarray, cost: np.ndarray, row: np.ndarray, left: np.ndarray, chunk: int = 512) -> dict[str, np.ndarray]:
    """Hits on one strand with forward coordinates: read, start, end, cost, and the barcode window lo, hi (lo < 0: no room)."""
    pattern, m = group.tables["flank"][0], group.tables["flank"][0].shape[1]
    out = {"read": read, "cost": cost, "start": np.zeros_like(end), "end": end.copy(), "lo": np.full(len(end), -1), "hi": np.full(len(end), -1)}
    low, high = group.bar_region
    straight = without_gaps(pattern[0], text, read, end, cost, row, left)
    room = np.minimum(high, m - 1) - np.maximum(low, m - end) >= 1
    out["start"] = np.maximum(0, end - m)
    out["lo"] = np.where(straight & room, end - m + np.maximum(low, m - end), -1)
    out["hi"] = np.where(straight & room, end - m + min(high, m - 1), -1)
    # the others are traced back, in windows as wide as their costs allow
    bent = np.flatnonzero(~straight)
    bent = bent[np.argsort(cost[bent], kind="stable")]
    for a in range(0, len(bent), chunk):
        s = bent[a : a + chunk]
        begin = np.maximum(0, end[s] - (m + cost[s] + 1))
        window = gathered(text, read[s], begin, end[s])
        lefts = np.where((begin == 0)[:, None], left[None, :], np.arange(m + 1)[None, :])
        path = trace(np.repeat(pattern, len(begin), 0), window, end[s] - begin, lefts, row[s])
        step = np.arange(len(path.i))[:, None]
        valid = step < path.steps[None, :]
        out["start"][s] = np.where(path.steps > 0, path.j[0], 0) + begin
        inside = valid & (path.i >= low) & (path.i <= high)
        enough = inside.sum(0) >= 2
        first, last = inside.argmax(0), len(inside) - 1 - inside[::-1].argmax(0)
        n = np.arange(len(begin))
        lo, hi = path.j[first, n] + begin, path.j[last, n] + begin
        out["lo"][s], out["hi"][s] = np.where(enough, lo, -1), np.where(enough, hi, -1)
    size = lengths[read]
    if strand == "Rc":
        start = out["start"].copy()
        out["start"], out["end"] = size - out["end"], size - start
        room = out["lo"] >= 0
        lo, hi = out["lo"].copy(), out["hi"].copy()
        out["lo"], out["hi"] = np.where(room, np.maximum(0, size - 1 - hi), -1), np.where(room, np.maximum(0, size - 1 - lo), -1)
    return out


def best_ends(cost: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of each (text, pattern) and the rightmost column of the first plateau that has it."""
    t = len(cost) - 1
    col = np.arange(t + 1)[:, None, None]
    cost = np.where(col <= lengths[None, :, None], cost, np.int16(32000))
    least = cost.min(0)
    is_least = cost == least[None]
    first = is_least.argmax(0)
    leaves = ~is_least & (col > first[None])
    last = np.where(leaves.any(0), leaves.argmax(0) - 1, t)
    return least, np.minimum(last, lengths[:, None])


#: as many windows are remembered for a group and strand
REMEMBERED = 1 << 15


def by_window(seen: dict, window: np.ndarray, size: np.ndarray, judge) -> list:
    """What judge (windows, sizes -> a list) says of each window; each distinct one is judged once."""
    if len(seen) > REMEMBERED:
        seen.clear()
    keys = [w[:n].tobytes() for w, n in zip(window, size.tolist())]
    new = {}
    for i, key in enumerate(keys):
        if key not in seen and key not in new:
            new[key] = i
    if new:
        at = np.fromiter(new.values(), np.int64, len(new))
        seen.update(zip(new, judge(window[at], size[at])))
    return [seen[key] for key in keys]


FOUND = ("valid", "label", "cost", "read_lo", "read_hi", "bar_lo", "bar_hi")


def barcode_hits(group: Group, strand: str, forward: np.ndarray, lengths: np.ndarray, hits: dict, padding: int, min_score: float, min_diff: float, seen: dict, chunk: int = 4096):
    """The best barcode of each hit: valid, label index, cost, read coordinates, window coordinates."""
    out = np.zeros((len(hits["read"]), len(FOUND)), np.int64)
    for a in range(0, len(out), chunk):
        s = slice(a, a + chunk)
        read = hits["read"][s]
        begin = np.maximum(0, hits["lo"][s] - padding)
        stop = np.minimum(hits["hi"][s] + padding, lengths[read])
        window = gathered(forward, read, begin, stop)
        out[s] = by_window(seen, window, stop - begin, lambda w, n: best_barcodes(group, strand, w, n, min_score, min_diff))
        out[s, 3:] += np.where(out[s, 6:] > 0, begin[:, None], 0)  # no barcode: zeros
    return dict(zip(FOUND, out.T))


def best_barcodes(group: Group, strand: str, windows: np.ndarray, sizes: np.ndarray, min_score: float, min_diff: float, chunk: int = 128) -> list[list[int]]:
    """The fields FOUND of each window, in coordinates of the window."""
    bars, tables = group.tables[strand]
    m, n = bars.shape[1], len(windows)
    out = {k: np.zeros(n, np.int64) for k in FOUND}
    rel = group.bar_region[0] - group.pad_region[0], group.bar_region[1] - group.pad_region[0]
    strict = int(np.float32(m) * np.float32(0.4))
    unit = np.arange(m + 1)
    #: the most that an alignment without this many of its matches can score: the others in one run
    most = np.array([perfect_score(m - e) for e in range(m + 1)]) / (group.perfect or 1)
    for a in range(0, n, chunk):
        s = slice(a, a + chunk)
        size = sizes[s]
        window = windows[s, : int(size.max(initial=0))]
        cost, _ = last_row(tables, m, np.ascontiguousarray(window.T), unit)
        least, ends = best_ends(cost, size)
        ok = least <= strict
        ok |= (ok.sum(1) <= 1)[:, None]  # the fallback pass admits every cost
        score = np.where(ok, -1.0, -2.0)  # -2: no candidate, -1: not scored
        paths = {}

        def scored(hit, bar):
            for b in range(0, len(hit), 4096):
                h, k = hit[b : b + 4096], bar[b : b + 4096]
                path = trace(bars[k], window[h], ends[h, k], np.broadcast_to(unit, (len(h), m + 1)))
                got = subsequence_scores(path.op, path.steps)
                score[h, k] = got / group.perfect if group.perfect > 0 else 0.0
                for x, (hh, kk) in enumerate(zip(h.tolist(), k.tolist())):
                    paths[hh, kk] = path, x

        first = np.where(ok, least, 32000).argmin(1)
        scored(np.arange(len(size)), first)
        top = score[np.arange(len(size)), first]
        # of e edits, those that insert lose no match; there are at most size - m more of them than
        # deletions, so (e - (size - m)) / 2 edits lose one each, at least
        lost = np.clip(-(-(least - (size - m)[:, None]) // 2), 0, m)
        more = ok & (score == -1.0) & (most[lost] > (top - min_diff)[:, None] - 1e-9)
        scored(*np.nonzero(more))
        best = score.argmax(1)
        rows = np.arange(len(size))
        high = score[rows, best]
        score[rows, best] = -3.0
        second = score.max(1)
        valid = (high >= min_score) & ((second < 0) | (high - second >= min_diff))
        for r in rows:
            path, x = paths[r, best[r]]
            i, j, op = path.i[: path.steps[x], x], path.j[: path.steps[x], x], path.op[: path.steps[x], x]
            inside = np.flatnonzero((i >= rel[0]) & (i < rel[1]))
            if not len(inside):
                valid[r] = False
                continue
            p, q = inside[0], inside[-1]
            k = a + r
            out["cost"][k] = np.count_nonzero(op[p : q + 1] != MATCH)
            out["read_lo"][k], out["read_hi"][k] = j[p], j[q] + 1
            out["bar_lo"][k], out["bar_hi"][k] = i[p], i[q] + 1
        out["valid"][s], out["label"][s] = valid, best
    return np.stack([out[k] for k in FOUND], 1).tolist()


def least_with_overhang(tables: np.ndarray, m: int, text: np.ndarray, lengths: np.ndarray, alpha: float) -> np.ndarray:
    """Least cost (texts, patterns) of each pattern anywhere in each text, overhang at either end allowed."""
    left = border(m, alpha)
    cost, final = last_row(tables, m, text, left, lengths)
    inside = np.arange(len(cost))[:, None, None] <= lengths[None, :, None]
    least = np.where(inside, cost, np.int16(32000)).min(0).astype(np.int32)
    here = cost[lengths, np.arange(len(lengths))].astype(np.int32)
    for i in range(m - 1, -1, -1):  # rows above the last one in each text's last column
        p, n = final[0][i // 64], final[1][i // 64]
        here -= ((p >> U(i % 64)) & U(1)).astype(np.int32) - ((n >> U(i % 64)) & U(1)).astype(np.int32)
        least = np.minimum(least, here + left[m - i])
    return least


def residual_counts(seqs: list[bytes], group: Group, bars: list[str], flank_edits: int, barcode_edits: int, alpha: float, chunk: int = 128) -> list[int]:
    """How many flank hits of each read hold a bare barcode on the same strand."""
    return residuals(*joined(seqs), residual_group(group, bars, flank_edits), barcode_edits, alpha, chunk).tolist()


def residual_group(group: Group, bars: list[str], flank_edits: int) -> Group:
    """The group with a cutoff of its own, and bare barcodes for both strands."""
    group = replace(group, cutoff=flank_edits, tables={}).prepared()
    bare = np.stack([encode(b) for b in bars])
    group.tables |= {("bare", "Fwd"): bit_tables(bare), ("bare", "Rc"): bit_tables(COMPLEMENT[bare[:, ::-1]]), "bare_size": bare.shape[1]}
    return group


def residuals(codes: np.ndarray, offsets: np.ndarray, group: Group, barcode_edits: int, alpha: float, chunk: int = 128) -> np.ndarray:
    """residual_counts of reads in one array; each distinct window is compared once."""
    m = group.tables["bare_size"]
    out = np.zeros(len(offsets) - 1, np.int64)

    def held_by(strand):
        def judge(windows, sizes):
            got = []
            for b in range(0, len(windows), chunk):
                window, size = windows[b : b + chunk], sizes[b : b + chunk]
                least = least_with_overhang(group.tables["bare", strand], m, np.ascontiguousarray(window.T), size, alpha)
                got += (least <= barcode_edits).any(1).tolist()
            return got

        return judge

    for some, size, both in blocks(codes, offsets):
        forward = both[:, : len(some)]
        for strand, hits in zip(STRANDS, both_strands(group, both, size, alpha)):
            seen = group.tables.setdefault(("held", strand, barcode_edits, alpha), {})
            for b in range(0, len(hits["read"]), 4096):
                read, start, end = (hits[k][b : b + 4096] for k in ("read", "start", "end"))
                window = gathered(forward, read, start, end)
                if window.shape[1]:
                    np.add.at(out, some[read], by_window(seen, window, end - start, held_by(strand)))
    return out


def rel_dist(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(pos < 0, 1, np.where(pos <= n // 2, np.where(pos == 0, 1, pos), np.where(pos == n, -1, pos - n)))


def joined(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all reads in one array, and where each begins."""
    return encode(b"".join(seqs)), np.concatenate([[0], np.cumsum([len(s) for s in seqs], dtype=np.int64)])


def blocks(codes: np.ndarray, offsets: np.ndarray, block: int = 1 << 21):
    """Reads of like length together: their numbers, lengths, and time-major codes, of both strands side by side. Empty reads leave."""
    lengths = np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    pad = np.zeros(int(lengths.max(initial=0)), np.uint8)
    ahead, behind = np.concatenate([codes, pad]), np.concatenate([pad, COMPLEMENT[codes]])
    a = 0
    while a < len(order):
        some = order[a : a + max(1, block // int(lengths[order[a]]))]
        fits = np.arange(1, len(some) + 1) * lengths[some] <= block
        some = some[: max(1, int(fits.argmin()) if not fits.all() else len(some))]
        a += len(some)
        size = lengths[some]
        t, least = int(size[-1]), int(size[0])
        # rows of t codes from a read's start, or up to its end; what lies outside of the read is cleared
        forward = sliding_window_view(ahead, t)[offsets[some]]
        back = sliding_window_view(behind, t)[offsets[some] + size + len(pad) - t][:, ::-1]
        outside = np.arange(least, t)[None, :] >= size[:, None]
        forward[:, least:][outside] = 0
        back[:, least:][outside] = 0
        both = np.empty((t, 2 * len(some)), np.uint8)
        both[:, : len(some)], both[:, len(some) :] = forward.T, back.T
        yield some, size, both


STRANDS = ("Fwd", "Rc")


def annotate_columns(codes: np.ndarray, offsets: np.ndarray, groups: list[Group], alpha: float, min_score: float, min_diff: float, padding: int = 10, block: int = 1 << 21, seen: dict | None = None) -> dict[str, np.ndarray]:
    """Unfiltered matches as columns, in order of read, group, strand and end; overlaps are not yet collapsed.

    read: the read's number; group and strand: numbers; label: the label's number in its group, -1 for a flank.
    seen: remembers windows from one call to the next, of the same parameters.
    """
    parts, seen = [], {} if seen is None else seen
    for some, size, both in blocks(codes, offsets, block):
        forward = both[:, : len(some)]
        for g, group in enumerate(groups):
            group.prepared()
            for strand, hits in enumerate(both_strands(group, both, size, alpha)):
                room = hits["lo"] >= 0
                hits = {k: v[room] for k, v in hits.items()}
                if not len(hits["read"]):
                    continue
                bars = barcode_hits(group, STRANDS[strand], forward, size, hits, padding, min_score, min_diff, seen.setdefault((g, strand), {}))
                valid, start, end, n = bars["valid"] > 0, hits["start"], hits["end"], size[hits["read"]]
                pick = lambda a, b: np.where(valid, a, b)
                row = {"read": some[hits["read"]], "group": np.full(len(n), g), "read_len": n, "rel_dist_to_end": rel_dist(start, n), "read_start_bar": pick(bars["read_lo"], start), "read_end_bar": pick(bars["read_hi"], end), "read_start_flank": start, "read_end_flank": end, "bar_start": pick(bars["bar_lo"], 0), "bar_end": pick(bars["bar_hi"], 0), "flank_cost": hits["cost"], "barcode_cost": pick(bars["cost"], len(group.seqs[0])), "label": pick(bars["label"], -1), "strand": np.full(len(n), strand)}
                parts.append(np.stack([row[k] for k in COLUMNS]))
    out = np.concatenate(parts, 1) if parts else np.zeros((len(COLUMNS), 0), np.int64)
    return dict(zip(COLUMNS, out[:, np.argsort(out[0], kind="stable")]))


COLUMNS = ("read", "group", "read_len", "rel_dist_to_end", "read_start_bar", "read_end_bar", "read_start_flank", "read_end_flank", "bar_start", "bar_end", "flank_cost", "barcode_cost", "label", "strand")


def annotate_reads(seqs: list[bytes], groups: list[Group], alpha: float, min_score: float, min_diff: float, padding: int = 10, block: int = 1 << 21) -> list[list[dict]]:
    """annotate_columns as match records of every read."""
    out: list[list[dict]] = [[] for _ in seqs]
    got = annotate_columns(*joined(seqs), groups, alpha, min_score, min_diff, padding, block)
    for values in zip(*(got[k].tolist() for k in COLUMNS)):
        row = dict(zip(COLUMNS, values))
        read, group, label = row.pop("read"), groups[row.pop("group")], row["label"]
        out[read].append(row | {"strand": STRANDS[row["strand"]], "match_type": group.kind if label >= 0 else group.kind[0] + "flank", "label": group.labels[label] if label >= 0 else "flank", "cuts": None})
    return out
