"""Operator 6: SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A merge-type model's vocabulary is read from its file.  A text becomes "_" + text with "_"
for spaces, cut before each run of "_" that follows another character: no piece of the
vocabulary goes over such a cut.  Each unit's merges come off an agenda, best score first and
leftmost among equals; a candidate is skipped if its keyed hash - of the seed, the document,
the unit's place in it and the candidate's rank and place - falls below the dropout.  So every
occurrence of a word draws on its own, and again the same for the same seed; results do not
depend on partitioning.  Dropout 0 gives the library's own ids.

What is kept between occurrences are runs of a word's agenda under a given set of skips, none
to begin with: an occurrence tries its draws on the run's candidates, and takes the run's ids
if it skips none of them, or else goes on to the run with its first skip.  Beyond DEPTH skips an
occurrence's agenda is run for itself.  That saves work and changes no result.

Characters outside the vocabulary become byte pieces; so does a literal "_" (U+2581), which
is why decoding restores every text exactly.

Edge cases: null or empty text has no pieces and decodes to the empty text; repeated rows are
encoded alike; an empty table gives no rows; extra columns are ignored.  A null doc_id
draws like number 0.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import rows
from .words import Words, mix64, string_buffers

MARK = "▁"
UNIT = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MASK = (1 << 64) - 1
NO = np.int64(1 << 60)
STORE = 1_000_000  # runs that a worker keeps as arrays, about 100 bytes each, before it forgets them
WIDE = 64  # longer units take the heap
CACHE = 400_000  # units whose hashes a worker remembers before it forgets them
DEPTH = 2  # skips of a run that is kept
ODD = np.uint64(0x9E3779B97F4A7C15)


def skipped(key: np.ndarray, entry: np.ndarray, threshold: int) -> np.ndarray:
    """Whether each key skips its entry of an agenda, as in Pieces.unit."""
    return ((key ^ entry * ODD) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32) < np.uint64(threshold)


class Pieces:
    """Vocabulary of a merge-type model with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        special = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.id = {model.id_to_piece(i): i for i in range(n) if i not in special}
        # rank of a piece: best score first
        order = sorted(self.id.values(), key=lambda i: (-model.get_score(i), i))
        scores, rank, at = [model.get_score(i) for i in order], {}, -1
        for k, i in enumerate(order):
            at += k == 0 or scores[k] != scores[k - 1]
            rank[i] = at
        #: (left, right) -> (rank, merged)
        self.merge = {}
        for piece, i in self.id.items():
            for k in range(1, len(piece)):
                a, b = self.id.get(piece[:k]), self.id.get(piece[k:])
                if a is not None and b is not None:
                    self.merge[a << 20 | b] = rank[i] << 20, i
        keys = sorted(self.merge)
        self.pair = np.array(keys, np.int64)
        self.pair_rank = np.array([self.merge[k][0] for k in keys], np.int64)
        self.pair_made = np.array([self.merge[k][1] for k in keys], np.int32)
        #: open addressing: slot -> index of the pair, -1 where free
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.slot = np.uint64(64 - bits), np.full((1 << bits) + 1, -1, np.int32)
        todo, at = np.arange(len(keys)), self._home(self.pair)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) % (1 << bits)
        self.symbol = np.full(0x110000, -1, np.int32)
        for piece, i in self.id.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        #: single-byte characters outside the vocabulary
        self.single = {chr(b) for b in range(128)} - set(self.id) - {" "}
        self.known = {c for c in self.id if len(c) == 1 and c != MARK} | {" "}
        self.bytes = [b""] * n
        for piece, i in self.id.items():
            self.bytes[i] = piece.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])

    def unit(self, unit: str, key: int, threshold: int) -> list[int]:
        """Ids of one unit; merges whose hash under the key is below the threshold are skipped."""
        ids = []
        for c in unit:
            i = self.id.get(c)
            if i is None:
                ids += [self.byte[b] for b in c.encode()]
            else:
                ids.append(i)
        n = len(ids)
        if n == 1:
            return ids
        merge, after, before = self.merge, list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is rank and place; places have 40 bits here, so a unit may be of any length
        agenda = [m[0] << 20 | i for i in range(n - 1) if (m := merge.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(agenda)
        while agenda:
            e = heapq.heappop(agenda)
            i, rank = e & 0xFFFFFFFFFF, e >> 40 << 20
            if ids[i] < 0 or (j := after[i]) >= n:
                continue
            m = merge.get(ids[i] << 20 | ids[j])
            if m is None or m[0] != rank:
                continue
            if threshold and ((key ^ (rank + i) * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & MASK) >> 32 < threshold:
                continue
            ids[i], ids[j] = m[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get(ids[i] << 20 | ids[k]):
                    heapq.heappush(agenda, m[0] << 20 | i)
            if (h := before[i]) >= 0 and (m := merge.get(ids[h] << 20 | ids[i])):
                heapq.heappush(agenda, m[0] << 20 | h)
        return [i for i in ids if i >= 0]

    def many(self, units: list[str], keys, threshold: int, runs: list | None = None) -> list[list[int]]:
        """unit() of many units in lockstep: in each round every unit takes the first entry of its agenda.

        With a list `runs`, keys are sets of rounds (bits) whose candidate is skipped, no other
        one is, and each unit's candidates are put into the list; units of at most WIDE characters.
        """
        out: list = [None] * len(units)
        if runs is not None:
            runs += [[] for _ in units]
        flat = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        size = np.array([len(u) for u in units])
        start = np.cumsum(size) - size
        symbol = self.symbol[flat]
        odd = np.add.reduceat(symbol < 0, start) > 0
        for n in np.flatnonzero(odd | (size > WIDE)):
            out[n] = self.unit(units[n], keys[n], threshold)
        left = np.flatnonzero(~odd & (size <= WIDE))
        left = left[np.argsort(size[left], kind="stable")]
        key = np.array(keys, np.uint64)
        for a in range(0, len(left), 4096):
            some = left[a : a + 4096]
            self._lockstep(some, symbol, start, size, key, threshold, out, runs)
        return out

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair of symbols among the merges, -1 where there is none or a symbol is missing (-1)."""
        key = a.astype(np.int64) << 20 | b
        at = self._home(key)
        found = np.where((a >= 0) & (b >= 0), self.slot[at], -1)
        flat = found.reshape(-1)
        wrong = np.flatnonzero(((found >= 0) & (self.pair[found] != key)).reshape(-1))
        key, at = key.reshape(-1), at.reshape(-1)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % (len(self.slot) - 1)
            flat[wrong] = self.slot[at[wrong]]
            wrong = wrong[(flat[wrong] >= 0) & (self.pair[flat[wrong]] != key[wrong])]
        return found

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each merge, NO where there is none."""
        at = self._pairs(a, b)
        return np.where(at >= 0, self.pair_rank[at], NO)

    def _lockstep(self, some, symbol, start, size, key, threshold, out, runs=None) -> None:
        width = int(size[some].max()) + 1  # one empty column at the end
        col = np.arange(width)[None, :]
        inside = col < size[some][:, None]
        ids = np.where(inside, symbol[np.minimum(start[some][:, None] + col, len(symbol) - 1)], -1)
        place = np.broadcast_to(col, ids.shape).copy()
        rank = np.full(ids.shape, NO)
        rank[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        key = key[some]
        nth, passed = 0, []
        while len(some):
            i = rank.argmin(1)
            row = np.arange(len(some))
            least = rank[row, i]
            done = least == NO
            if done.any():
                for r in np.flatnonzero(done):
                    got = ids[r]
                    out[some[r]] = got[got >= 0].tolist()
                live = ~done
                some, ids, place, rank, key, i, least = some[live], ids[live], place[live], rank[live], key[live], i[live], least[live]
                row = np.arange(len(some))
            if runs is not None:
                passed.append((some, least >> 14 | place[row, i]))
                skip = (key >> np.uint64(nth) & np.uint64(1)).astype(bool) if nth < 64 else np.zeros(len(some), bool)
                nth += 1
            elif threshold:
                skip = skipped(key, (least | place[row, i]).astype(np.uint64), threshold)
            if runs is not None or threshold:
                rank[row[skip], i[skip]] = NO
                row, i = row[~skip], i[~skip]
            if not len(row):
                continue
            made = self.pair_made[self._pairs(ids[row, i], ids[row, i + 1])]
            ids[row, i] = made
            # take out the symbol at i + 1
            source = np.minimum(col + (col > i[:, None]), width - 1)
            for x in (ids, place, rank):
                x[row] = np.take_along_axis(x[row], source, 1)
            rank[row, i] = self._ranks(made, ids[row, i + 1])
            some_left = i > 0
            r, j = row[some_left], i[some_left] - 1
            rank[r, j] = self._ranks(ids[r, j], made[some_left])
        if passed:
            who, what = (np.concatenate(x) for x in zip(*passed))
            order = np.argsort(who, kind="stable")
            each, at = np.unique(who[order], return_index=True)
            what = what[order].tolist()
            for n, a, b in zip(each.tolist(), at.tolist(), [*at[1:].tolist(), len(what)]):
                runs[n] = what[a:b]

    def decode(self, ids) -> str:
        """The text of these ids; without the space that encoding puts first."""
        out = b"".join(map(self.bytes.__getitem__, ids))
        return out[1:].decode()


@lru_cache(1024)
def cutter(characters: frozenset):
    return re.compile("([" + "".join(map(re.escape, sorted(characters))) + "])")


@lru_cache(2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """variants: only so many draws in all, instead of one an occurrence."""

    def __init__(self, path: str, dropout: float, seed: int, variants: int | None = None):
        self.pieces, self.threshold, self.seed, self.variants = vocabulary(path), int(dropout * (1 << 32)), seed, variants
        self.mark = [self.pieces.byte[b] for b in MARK.encode()]
        self.named: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """The store: sorted keys of runs, their rows, each row's ids in flat and its candidates (rank << 6 | place) in path."""
        self.keys, self.key_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bound, self.path_bound = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat, self.path = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def units(self, text: str) -> list[str]:
        """Units, where the empty one stands for a literal mark. Characters outside the vocabulary stand alone: nothing merges with them."""
        out = []
        foreign = frozenset(text) - self.pieces.known
        for i, part in enumerate(cutter(foreign).split(text) if foreign else (text,)):
            if i % 2:
                out.append("" if part == MARK else part)
            elif "  " in part or part[-1:] == " " or not part:
                out += UNIT.findall((MARK if not i else "") + part.replace(" ", MARK))
            else:
                first, *rest = part.split(" ")
                if first or not i:
                    out.append(MARK + first if not i and first else first or MARK)
                out += [MARK + w for w in rest]
        return out

    def draws(self, doc_ids: list, size: np.ndarray, lead: np.ndarray | int = 0) -> np.ndarray:
        """The key of every unit's draws, for documents of so many units, the first of which is number `lead`."""
        base = np.array([xxhash.xxh64_intdigest(str(d or 0), seed=self.seed) for d in doc_ids], np.uint64)
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lead, size)
        key = mix64(nth.astype(np.uint64) + np.repeat(base, size))
        return key if self.variants is None else mix64(key % np.uint64(self.variants) + np.uint64(xxhash.xxh64_intdigest("", seed=self.seed)))

    def alone(self, units: list[str], keys: list[int]) -> list[list[int]]:
        """Each unit's agenda run for itself."""
        return self.pieces.many(units, keys, self.threshold) if units else []

    def segmented(self, word: np.ndarray, key: np.ndarray, wide: np.ndarray, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all occurrences in a row, and their n+1 bounds.

        word: a hash of each one's unit; key: of its draws; wide: run for themselves, as are all
        units over WIDE; texts: indices of occurrences -> their units.
        """
        if len(self.keys) > STORE:
            self.forget()
        row, skips = np.full(len(word), -1), np.zeros(len(word), np.uint64)
        live = np.flatnonzero(~wide)
        for depth in range(DEPTH + 1):
            if not len(live):
                break
            name = mix64(word[live] + skips[live] * ODD)
            each, at, back, n = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
            found = self.rows_of(each)
            # a run with skips that a single occurrence asks for isn't kept: that one is run for itself
            new = np.flatnonzero((found < 0) & ((n > 1) | (depth == 0)))
            if len(new):
                found[new] = self.add_rows(each[new], texts(live[at[new]]), skips[live[at[new]]])
            mine = found[back]
            live, mine = live[mine >= 0], mine[mine >= 0]
            if not len(live):
                break
            if not self.threshold:
                row[live] = mine
                live = live[:0]
                break
            # candidates after the last skip; frexp gives the bit length of a power of two
            done = np.where(skips[live] > 0, np.frexp(skips[live].astype(np.float64))[1], 0)
            lo, n = self.path_bound[mine] + done, np.diff(self.path_bound)[mine] - done
            total = np.cumsum(n)
            nth = np.arange(total[-1]) - np.repeat(total - n, n)
            entry = self.path[np.repeat(lo, n) + nth].astype(np.uint64)
            hit = np.flatnonzero(skipped(np.repeat(key[live], n), entry >> np.uint64(6) << np.uint64(20) | entry & np.uint64(63), self.threshold))
            who, first = np.unique(np.repeat(np.arange(len(live)), n)[hit], return_index=True)
            go = np.zeros(len(live), bool)
            go[who] = True
            row[live[~go]] = mine[~go]
            step = (nth[hit[first]] + done[who]).astype(np.uint64)
            live = live[who]
            near = step < 48  # a set of skips is told by 48 bits: exact in a float; later ones are run for themselves
            live, step = live[near], step[near]
            skips[live] |= np.uint64(1) << step
        rest = np.flatnonzero(row < 0)
        own = self.alone(texts(rest), key[rest].tolist()) if len(rest) else []
        size = np.where(row >= 0, np.diff(self.bound)[row] if len(self.bound) > 1 else 0, 0)
        size[rest] = [len(x) for x in own]
        bounds = np.concatenate([[0], np.cumsum(size)])
        start = np.where(row >= 0, self.bound[row], 0)
        start[rest] = len(self.flat) + np.cumsum(size[rest]) - size[rest]
        flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(own), np.int32, int(size[rest].sum()))])
        return flat[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])], bounds

    def encode_all(self, doc_ids: list, texts: list[str]) -> list[list[int]]:
        """Ids of every text; units of 256 texts are segmented together."""
        out = []
        for a in range(0, len(texts), 256):
            each = [self.units(t) if t else [] for t in texts[a : a + 256]]
            size = np.array([len(x) for x in each])
            units = list(chain.from_iterable(each))
            if len(self.named) > CACHE:
                self.named = {}
            for u in set(units) - self.named.keys():
                self.named[u] = xxhash.xxh64_intdigest(u)
            word = np.array([self.named[u] for u in units], np.uint64)
            wide = np.array([len(u) > WIDE for u in units], bool)
            ids, bounds = self.segmented(word, self.draws(doc_ids[a : a + 256], size), wide, lambda at: [units[n] for n in at.tolist()])
            at = bounds[np.concatenate([[0], np.cumsum(size)])]
            out += [ids[x:y].tolist() for x, y in zip(at, at[1:])]
        return out

    def encode_column(self, doc_ids: list, column) -> list[np.ndarray]:
        """Ids of every text of a string column: the same as encode_all, in arrays.

        Texts of single spaces and known characters (line ends and other single-byte characters
        outside the vocabulary may stand between words) are handled as arrays of word hashes;
        the others go through encode_all.  A word is known by a 64-bit hash.
        """
        texts = column.to_pylist()
        out: list = [np.zeros(0, np.int32)] * len(texts)
        own = self.pieces.single
        plain = [bool(t) and " " not in (t[0], t[-1]) and "  " not in t and (not (f := frozenset(t) - self.pieces.known) or (all(c in own for c in f) and not any(f" {c}" in t or f"{c} " in t for c in f))) for t in texts]
        slow = [i for i, (t, p) in enumerate(zip(texts, plain)) if t and not p]
        for i, ids in zip(slow, self.encode_all([doc_ids[i] for i in slow], [texts[i] for i in slow])):
            out[i] = np.array(ids, np.int32)
        fast = [i for i, p in enumerate(plain) if p]
        if not fast:
            return out
        data, offsets = string_buffers(column.take(pa.array(fast)))
        apart = np.zeros(256, bool)
        apart[[32, *map(ord, own)]] = True
        words = Words(data, offsets, False, apart)
        lone = np.flatnonzero(apart[data] & (data != 32))
        # units in order: words, and single characters outside the vocabulary
        place = np.concatenate([words.start, lone])
        order = np.argsort(place, kind="stable")
        place = place[order]
        before = np.where(place > 0, data[np.maximum(place - 1, 0)], 32)
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        marked = (before == 32) | first[place]
        end = np.concatenate([words.end, lone + 1])[order]
        key = np.concatenate([words.hashes(), mix64(data[lone].astype(np.uint64))])[order]
        bounds = np.searchsorted(place, offsets)
        # a text that begins with a lone character has the first mark as a unit of its own
        lead = apart[data[offsets[:-1]]].astype(np.int64)
        key = mix64(key + np.where(marked, np.uint64(0), np.uint64(0xD6E8FEB86659FD93)))
        raw = data.tobytes()

        def units(at: np.ndarray) -> list[str]:
            return [(MARK if m else "") + raw[x:y].decode() for x, y, m in zip(place[at].tolist(), end[at].tolist(), marked[at].tolist())]

        # bytes, of which a unit has as many as characters at least
        ids, total = self.segmented(key, self.draws([doc_ids[i] for i in fast], np.diff(bounds), lead), end - place >= WIDE, units)
        for n, i in enumerate(fast):
            out[i] = ids[total[bounds[n]] : total[bounds[n + 1]]]
        return out

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """Row of each sorted key in the store, -1 where it is new."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_row[at], -1)

    def add_rows(self, keys: np.ndarray, units: list[str], skips: np.ndarray) -> np.ndarray:
        """Runs of units under sets of skips, put into the store; a literal mark (the empty unit) is its bytes."""
        runs: list = []
        found = self.pieces.many([u or "\n" for u in units], skips, self.threshold, runs)
        found = [x if u else self.mark for x, u in zip(found, units)]
        rows = len(self.bound) - 1 + np.arange(len(found))
        size, steps = (np.array([len(x) for x in y], np.int64) for y in (found, runs))
        self.bound, self.path_bound = (np.concatenate([x, x[-1] + np.cumsum(n)]) for x, n in ((self.bound, size), (self.path_bound, steps)))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))])
        self.path = np.concatenate([self.path, np.fromiter(chain.from_iterable(runs), np.uint32, int(steps.sum()))])
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.key_row = all_keys[order], np.concatenate([self.key_row, rows])[order]
        return rows

    def encode(self, doc_id: int | None, text: str) -> list[int]:
        return self.encode_all([doc_id], [text])[0]


@lru_cache(1)
def encoder_of(path: str, dropout: float, seed: int, variants: int | None) -> Encoder:
    """One a worker: what a task has segmented serves the next one."""
    return Encoder(path, dropout, seed, variants)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encoded(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 7, variants: int | None = None) -> DataFrame:
    """doc_id, ids of every text."""

    def run(batches):
        encoder = encoder_of(model, dropout, seed, variants)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids = part.column("doc_id").to_pylist()
                yield rows(ENCODED, doc_id=ids, ids=encoder.encode_column(ids, part.column("text")))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


DECODED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """doc_id, text of every list of ids."""

    def run(batches):
        pieces = vocabulary(model)
        for batch in batches:
            yield rows(DECODED, doc_id=batch.column("doc_id"), text=[pieces.decode(x.as_py() or []) for x in batch.column("ids")])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


TRIP = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())])


def round_trip(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 7, variants: int | None = None) -> DataFrame:
    """Encode and decode every text: number of pieces, digest of the ids, digest of the decoded text, and whether it is the text."""

    def run(batches):
        encoder = encoder_of(model, dropout, seed, variants)
        # rows, not texts: a slice of a batch bounds the arrays
        for part in (b.slice(a, 512) for b in batches for a in range(0, b.num_rows, 512)):
            out = {n: [] for n in TRIP.names}
            docs_, texts = part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
            for doc, text, ids in zip(docs_, texts, encoder.encode_column(docs_, part.column("text"))):
                back = encoder.pieces.decode(ids.tolist())
                if back != text:
                    # two units of this worker's store share a hash: the text is encoded by itself
                    ids = np.array(Encoder(model, dropout, seed, variants).encode(doc, text), np.int32)
                    back = encoder.pieces.decode(ids.tolist())
                for k, v in zip(TRIP.names, (doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text)):
                    out[k].append(v)
            yield rows(TRIP, **out)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
