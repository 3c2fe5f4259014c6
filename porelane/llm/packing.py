"""Operator 9: best-fit packing improved by swap-based local search.

Pieces of one length are interchangeable, so packing works on the histogram of lengths,
which has at most `capacity` entries however many documents there are.  Bins with the same
contents form one class with a multiplicity; best fit decreasing and the local search move
whole classes.  The solved classes become slots (length, rank interval) -> (sequence,
offset), and every piece finds its slot from its exact rank among the pieces of its length.
Ranks are salted: counts per (length, salt) are summed into offsets, so no task holds all
pieces of one length.

Edge cases: null or empty text is the one end id; repeated rows are packed each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows, written
from .words import Words, slices, string_buffers

RUN = 4096

# The word pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(path: str):
    """text -> ids as the tokenizers library gives them for this file, without special tokens added.

    The vocabulary's ranks go to tiktoken, which yields the same ids about four times as
    fast; a text that holds an added token's string goes through tokenizers itself, and so does
    one with a run of more than RUN bytes of white space or of anything else: tiktoken's
    pattern tracks back over white space until it fails, and its merges take quadratic time.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the byte alphabet of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for U+0100 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = [x["content"] for x in spec["added_tokens"]]
    ranks = {bytes(byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in added}
    fast = tiktoken.Encoding("porelane", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)

    def encode(text: str, plain: bool | None = None) -> np.ndarray:
        """plain: that the text has no long run, where that is known."""
        if plain is None:
            plain = bool(without_long_runs(pa.array([text]))[0])
        if not plain or any(x in text for x in added):
            return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text).astype("<u4", copy=False)

    return encode


def without_long_runs(column) -> np.ndarray:
    """Which texts have no more than RUN bytes in a row between the ends of words, white space or not."""
    data, offsets = string_buffers(column)
    words = Words(data, offsets, False)
    edge = np.sort(np.concatenate([words.start, words.end, offsets]))
    out = np.ones(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, edge[:-1][np.diff(edge) > RUN], side="right") - 1] = False
    return out


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Every document's ids and end_id, cut into pieces of at most capacity; a shorter piece comes first."""

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in (part for batch in batches for part in slices(batch)):
            out = {n: [] for n in PIECES.names}
            for doc, text, plain in zip(batch.column(0).to_pylist(), batch.column(1), without_long_runs(batch.column(1)).tolist()):
                ids = np.append(encode(text.as_py() or "", plain), np.array([end_id], "<u4"))
                n = len(ids)
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for k, v in zip(PIECES.names, (doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        out[k].append(v)
            yield rows(PIECES, **out)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Classes of equal bins: contents (sorted lengths, largest first) -> number of bins."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.by_free, self.frees = capacity, Counter(), {}, []

    def free(self, contents: tuple) -> int:
        return self.capacity - sum(contents)

    def add(self, contents: tuple, n: int) -> None:
        if not n:
            return
        self.count[contents] += n
        same = self.by_free.setdefault(f := self.free(contents), {})
        if not same:
            insort(self.frees, f)
        same[contents] = True
        if not self.count[contents]:
            del self.count[contents], same[contents]
            if not same:
                self.frees.remove(f)

    def total(self) -> int:
        return sum(self.count.values())


def best_fit(lengths: Counter, capacity: int) -> Bins:
    """Best fit decreasing over a histogram."""
    bins = Bins(capacity)
    for size in sorted(lengths, reverse=True):
        left = lengths[size]
        while left:
            at = bisect_left(bins.frees, size)
            if at == len(bins.frees):
                per = capacity // size
                bins.add((size,) * per, left // per)
                if left % per:
                    bins.add((size,) * (left % per), 1)
                break
            free = bins.frees[at]
            contents = next(iter(bins.by_free[free]))
            per = free // size
            if left < per:
                per, take = left, 1
            else:
                take = min(bins.count[contents], left // per)
            bins.add(contents, -take)
            bins.add(tuple(sorted(contents + (size,) * per, reverse=True)), take)
            left -= take * per
    return bins


def without(contents: tuple, out: tuple, new: tuple) -> tuple:
    left = list(contents)
    for x in out:
        left.remove(x)
    return tuple(sorted(left + list(new), reverse=True))


def sums(contents: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lengths, and distinct sums of two of the documents."""
    x, n = np.unique(np.array(contents, np.int64), return_counts=True)
    i, j = np.triu_indices(len(x), 1)
    return x, np.unique(np.concatenate([x[i] + x[j], 2 * x[n > 1]]))


def parts(contents: tuple, total: int) -> tuple:
    """No, one or two of the documents with this sum."""
    if not total or total in contents:
        return (total,) * (total > 0)
    return next((x, total - x) for x in contents if total - x in contents and (2 * x != total or contents.count(x) > 1))


class Receivers:
    """A row for each class that isn't full: free space, and what may come back, by least size."""

    NEVER = 1 << 24

    def __init__(self, capacity: int):
        self.capacity, self.row, self.contents, self.spare, self.now = capacity, {}, [], [], 0
        self.free, self.born = np.zeros(0, np.int64), np.zeros(0, np.int64)  # no free space: no class in this row
        self.least = np.zeros((0, 2, capacity + 1), np.int32)

    def put(self, contents: tuple) -> None:
        if not self.spare:
            n = max(64, len(self.free))
            self.spare = list(range(len(self.free) + n - 1, len(self.free) - 1, -1))
            self.contents += [None] * n
            self.free, self.born = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.free, self.born))
            self.least = np.concatenate([self.least, np.zeros((n, 2, self.capacity + 1), np.int32)])
        self.row[contents] = k = self.spare.pop()
        self.contents[k], self.free[k] = contents, self.capacity - sum(contents)
        one, two = sums(contents)
        size = np.full((2, self.capacity + 1), self.NEVER, np.int32)
        size[:, 0] = 0
        size[:, one], size[1, two] = one, two
        # least[k, w, x]: least sum of at most 1 + w documents that is x or more
        self.least[k] = np.minimum.accumulate(size[:, ::-1], 1)[:, ::-1]
        self.touch(contents)

    def touch(self, contents: tuple) -> None:
        self.now += 1
        self.born[self.row[contents]] = self.now

    def drop(self, contents: tuple) -> None:
        k = self.row.pop(contents)
        self.free[k] = 0
        self.spare.append(k)

    def best(self, source: tuple, twice: bool, since: int) -> tuple | None:
        """The exchange with a class touched after `since` that raises the sum of squared fills most: target, out of source, out of target."""
        mine = np.flatnonzero((self.free > 0) & (self.born > since))
        if not twice:
            mine = mine[mine != self.row[source]]
        if not len(mine):
            return None
        free, fill, found = self.free[mine], sum(source), (0, None)
        # one document against at most two, two against at most one; a pair's best shift is its largest
        for w, out in zip((1, 0), sums(source)):
            # about a million cells at once
            for a in range(0, len(out), step := max(1, (1 << 20) // len(mine))):
                o = out[a : a + step, None]
                back = self.least[mine, w, np.maximum(o - free, 0)]
                shift = o - back
                gain = np.where(shift > 0, shift * (self.capacity - free - fill + shift), 0)
                at = int(gain.argmax())
                if (top := int(gain.flat[at])) > found[0]:
                    i, j = divmod(at, len(mine))
                    found = top, (self.contents[mine[j]], int(o[i, 0]), int(back[i, j]))
        if found[1] is None:
            return None
        target, out, back = found[1]
        return target, parts(source, out), parts(target, back)


def local_search(bins: Bins) -> Bins:
    """Exchange documents between underfull bins until no exchange raises the sum of squared fills.

    One document, or two, go to another bin for none, one or two (one) of its documents.  The
    emptiest class that hasn't been tried gives; of all classes, the one receives with which
    the sum rises most.  A class without an exchange is tried again with the classes that
    came later, so the search ends where no two bins have an exchange, or at the least possible
    number of bins.  Every step raises the sum, so it does end.
    """
    items = sum(sum(c) * n for c, n in bins.count.items())
    least = -(-items // bins.capacity)
    total, receivers, tried = bins.total(), Receivers(bins.capacity), {}
    todo: list = []

    def change(contents: tuple, n: int) -> None:
        before = bins.count.get(contents, 0)
        bins.add(contents, n)
        if sum(contents) == bins.capacity:
            return
        if not before:
            receivers.put(contents)
            heappush(todo, (sum(contents), contents))
        elif before + n == 0:
            receivers.drop(contents)
            tried.pop(contents, None)
        elif before == 1:
            receivers.touch(contents)  # two of a class may exchange between them

    for contents in [c for f in bins.frees if f for c in bins.by_free[f]]:
        receivers.put(contents)
        todo.append((sum(contents), contents))
    heapify(todo)
    while total > least:
        if not todo:
            todo += [(sum(c), c) for c in receivers.row if tried[c] < receivers.now]
            heapify(todo)
            if not todo:
                break
        source = todo[0][1]
        if source not in receivers.row or tried.get(source, -1) == receivers.now:
            heappop(todo)
            continue
        found = receivers.best(source, bins.count[source] > 1, tried.get(source, -1))
        if found is None:
            tried[source] = receivers.now
            heappop(todo)
            continue
        target, out, back = found
        n = bins.count[source] // 2 if target == source else min(bins.count[source], bins.count[target])
        change(source, -n)
        change(target, -n)
        if left := without(source, out, back):
            change(left, n)
        else:
            total -= n
        change(without(target, back, out), n)
    return bins


def slots(bins: Bins) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> first rank of each run of slots, its first sequence, its offset."""
    made, sequence, used = {}, 0, Counter()
    for contents in sorted(bins.count, reverse=True):
        n, offset = bins.count[contents], 0
        for size in contents:
            made.setdefault(size, []).append((used[size], sequence, offset))
            used[size] += n
            offset += size
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in made.items()}


def ranked(items: DataFrame, lengths: Counter, per_salt: int) -> DataFrame:
    """Adds rank: 0, 1, ... among the rows of one length, without bringing them together.

    A length of n rows is dealt over 1 + n / per_salt salts; ranks within a salt are shifted by
    the counts of the salts before it.
    """
    spark = items.sparkSession
    # F.broadcast: at most one row a length
    salts = F.broadcast(spark.createDataFrame([(k, 1 + n // per_salt) for k, n in lengths.items()], "length long, salts long"))
    salted = items.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "salts")).drop("salts")
    counts = salted.groupBy("length", "salt").count()
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    few = sum(1 + n // per_salt for n in lengths.values()) <= 200_000  # checked: 24 bytes a row; a shuffled join beyond it
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    out = salted.withColumn("own", F.row_number().over(own) - 1).join(F.broadcast(before) if few else before, ["length", "salt"])
    return out.withColumn("rank", F.col("own") + F.col("before")).drop("salt", "own", "before")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, per_salt: int = 500_000) -> DataFrame:
    """All documents packed into few sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    items = written(pieces(docs, tokenizer, capacity, end_id), "pieces")
    lengths = Counter({r["length"]: r["count"] for r in items.groupBy("length").count().collect()})  # at most capacity rows
    if not lengths:
        return items.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    places = slots(local_search(best_fit(lengths, capacity)))
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for length in np.unique(size):
                mine = np.flatnonzero(size == length)
                first, start, at = places[int(length)]
                k = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = start[k] + rank[mine] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in PIECES.names), pa.array(sequence), pa.array(offset)], schema=schema)

    # small tables are dealt out, too: a salt has at most about a 512th of the rows
    per_salt = max(1, min(per_salt, sum(lengths.values()) // 512))
    return ranked(items, lengths, per_salt).select(*PIECES.names, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
