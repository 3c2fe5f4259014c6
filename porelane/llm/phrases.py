"""Operator 5: substring deduplication by repeated-phrase automata.

A window of 35 words is removed if its word sequence starts anywhere else, too.

1. Seeds.  Of the 18 runs of 18 words in a window, the one of smallest hash is the window's
   seed (a content-defined choice, the same in every copy).  Seeds that occur twice in the
   table are found by counting distinct hashes of chunks in hash buckets.
2. Confirmation.  Only windows with a recurring seed are hashed whole, in 128 bits, and counted
   the same way: what occurs twice is a recurring passage.
3. Automata.  The documents are sharded into chunks of bounded size.  Each shard's confirmed
   passages are cut into phrases of one window and compiled into an Aho-Corasick automaton
   over word numbers (equal words have one number, told by their bytes).  Every document of
   the shard is streamed through it whole, and the words of each hit go.

A chunk sends a value at most once, so a passage that a third of all documents share is one
value a chunk.  The texts are written once as a bucketed table and are not shuffled again.
Seeds have 64 bits; a false equality among them only lets a window through to step 2.

Edge cases: null and empty texts have no words; texts shorter than a window keep all words;
repeated rows are each other's copies, so both lose what is long enough; an empty table
gives no rows; extra columns are carried through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SENT_SQL, answers_for, blob, chunk_docs, chunk_table, send_values, text_bytes, trimmed_memory, unblob, with_answers, written
from .words import Words, runs, string_buffers

U = np.uint64
PER_BUCKET = 500_000
SECOND = 0x2545F4914F6CDD1D  # seed of a window's second hash


def sliding(x: np.ndarray, k: int, best) -> np.ndarray:
    """best over x[i : i + k] for every i where that fits."""
    width = 1
    out = x
    while width * 2 <= k:
        out = best(out[: len(out) - width], out[width:])
        width *= 2
    n = len(x) - k + 1
    return best(out[:n], out[k - width : k - width + n]) if n > 0 else x[:0]


class Windows:
    """Window hashes and window seeds of a chunk of documents."""

    def __init__(self, docs: pa.RecordBatch, text: str, window: int):
        self.words = Words(*string_buffers(docs.column(text)), False)
        self.hash = self.words.hashes()
        self.seed_len = window // 2 + 1
        self.span = window - self.seed_len + 1
        self.window = window

    def seeds(self) -> np.ndarray:
        """Of every window the smallest hash of its runs, in the order of run_bounds(window)."""
        run, at = runs(self.hash, self.words.bounds, self.seed_len)
        low = sliding(run, self.span, np.minimum)  # across documents too; those are left out here
        n = np.maximum(np.diff(at) - (self.span - 1), 0)
        first = np.cumsum(n) - n
        return low[np.arange(n.sum()) + np.repeat(at[:-1] - first, n)] if n.sum() else low[:0]

    def whole(self) -> np.ndarray:
        """A row of two hashes for every window."""
        return np.stack([runs(self.hash, self.words.bounds, self.window, seed)[0] for seed in (0, SECOND)], 1)


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First index of each distinct value (rows of one or two hashes), in order; where each went; how often each is there."""
    if values.ndim == 1 or values.shape[1] == 1:
        return np.unique(values.reshape(-1), return_index=True, return_inverse=True, return_counts=True)[1:]
    _, first, inverse, n = np.unique(values[:, 0], return_index=True, return_inverse=True, return_counts=True)
    if (values[first[inverse], 1] == values[:, 1]).all():
        return first, inverse, n
    order = np.lexsort((values[:, 1], values[:, 0]))
    head = np.concatenate([[True], (values[order[1:]] != values[order[:-1]]).any(1)])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(head) - 1
    return order[head], inverse, np.bincount(inverse)


def repeated(sent: DataFrame, hashes: int) -> DataFrame:
    """part, seq, bucket, ans: a byte a value (of so many hashes), 1 if the value occurs twice or more in all."""

    def count(group: pa.Table) -> pa.Table:
        trimmed_memory()
        values = [unblob(x, U).reshape(-1, hashes) for x in group.column("val")]
        _, inverse, _ = grouped(np.concatenate(values))
        total = np.bincount(inverse, np.concatenate([unblob(x, np.uint8) for x in group.column("num")]))
        many = (total >= 2).astype(np.uint8)[inverse]
        at = np.cumsum([0] + [len(v) for v in values])
        return pa.table({"part": group.column("part"), "seq": group.column("seq"), "bucket": group.column("bucket"), "ans": pa.array([blob(many[a:b]) for a, b in zip(at, at[1:])], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(count, "part long, seq int, bucket int, ans binary")


def send_seeds(chunks: DataFrame, text: str, window: int, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r, docs in chunk_docs(batch):
                # a seed with one place in the chunk counts once, however many windows share it
                made = Windows(docs, text, window)
                all_runs, at = runs(made.hash, made.words.bounds, made.seed_len)
                seeds = np.unique(made.seeds())
                hit = np.searchsorted(seeds, all_runs)
                hit = hit[(hit < len(seeds)) & (seeds[np.minimum(hit, len(seeds) - 1)] == all_runs)] if len(seeds) else hit[:0]
                places = np.minimum(np.bincount(hit, minlength=len(seeds)), 2).astype(np.uint8)
                yield from send_values(batch.column("part")[r].as_py(), batch.column("seq")[r].as_py(), seeds, places, buckets)
                trimmed_memory()

    return chunks.mapInArrow(run, SENT_SQL)


def send_windows(chunks: DataFrame, text: str, window: int, buckets: int) -> DataFrame:
    """chunks with answers about their seeds: hashes of the windows with a recurring seed."""

    def run(batches):
        for batch in batches:
            for r, docs in chunk_docs(batch):
                made = Windows(docs, text, window)
                _, inverse = np.unique(made.seeds(), return_inverse=True)
                live = answers_for(batch, r, np.uint8)[inverse] > 0
                values = made.whole()[live]
                first, _, n = grouped(values)
                # 2 stands for more
                yield from send_values(batch.column("part")[r].as_py(), batch.column("seq")[r].as_py(), values[first], np.minimum(n, 2).astype(np.uint8), buckets)
                trimmed_memory()

    return chunks.mapInArrow(run, SENT_SQL)


def automaton(phrases: list[tuple]):
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases:
        out.add_word(phrase)
    out.make_automaton()
    return out


def phrases_of(start: np.ndarray, window: int) -> np.ndarray:
    """Starts of windows that cover the same words as all windows at the sorted starts."""
    if not len(start):
        return start
    head = np.concatenate([[True], np.diff(start) > 1])
    group = np.cumsum(head) - 1
    first = start[head][group]
    last = np.concatenate([head[1:], [True]])
    return start[((start - first) % window == 0) | last]


def covered(made: Windows, texts: list[list[bytes]], recurring: np.ndarray) -> np.ndarray:
    """Which words of the chunk are in an occurrence of a confirmed passage.

    texts: the words of each document; recurring: which windows hold a confirmed passage.
    """
    window, bounds = made.window, made.words.bounds
    n = np.maximum(np.diff(bounds) - (window - 1), 0)
    at = np.cumsum(n) - n
    start = (np.arange(n.sum()) + np.repeat(bounds[:-1] - at, n))[recurring]
    depth = np.zeros(len(made.hash) + 1, np.int64)
    if not len(start):
        return depth[:-1] > 0
    known: dict[bytes, int] = {}
    numbers = [tuple([known.setdefault(w, len(known)) for w in words]) for words in texts]
    flat = [x for words in numbers for x in words]
    shard = automaton({tuple(flat[s : s + window]) for s in phrases_of(start, window).tolist()})
    for a, words in zip(bounds.tolist(), numbers):
        ends = np.fromiter((e for e, _ in shard.iter(words)), np.int64) if len(words) >= window else np.zeros(0, np.int64)
        depth[a + ends + 1 - window] += 1
        np.subtract.at(depth, a + ends + 1, 1)
    return np.cumsum(depth[:-1]) > 0


def substring_dedup(docs: DataFrame, text: str = "text", window: int = 35, prefix: str = "") -> DataFrame:
    """Every row of docs with n_words, n_removed, kept (the words that stay, joined by one space).

    The prefix goes before these names; columns of docs that have them already are replaced.
    """
    added = [f"{prefix}{n}" for n in ("n_words", "n_removed", "kept")]
    docs = docs.drop(*added)
    volume = text_bytes(docs, text)
    seed_buckets, window_buckets = 1 + volume // 6 // 9 // PER_BUCKET, 1 + volume // 6 // 3 // PER_BUCKET
    chunks = chunk_table(docs, "texts", text)
    seeds = written(repeated(send_seeds(chunks, text, window, seed_buckets), 1), "seeds")
    windows = written(repeated(send_windows(with_answers(chunks, seeds), text, window, window_buckets), 2), "windows")
    both = with_answers(with_answers(chunks, seeds, "seed_answers"), windows)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(added, (T.LongType(), T.LongType(), T.StringType())))])

    def run(batches):
        for batch in batches:
            for r, got in chunk_docs(batch):
                made = Windows(got, text, window)
                _, inverse = np.unique(made.seeds(), return_inverse=True)
                live = answers_for(batch, r, np.uint8, "seed_answers")[inverse] > 0
                recurring = np.zeros(len(live), bool)
                recurring[live] = answers_for(batch, r, np.uint8)[grouped(made.whole()[live])[1]] > 0
                words, kept, total, removed = made.words, [], np.diff(made.words.bounds), []
                raw = words.data.tobytes()
                texts = [raw[a:b].split() for a, b in zip(words.offsets, words.offsets[1:])]
                gone = covered(made, texts, recurring)
                for list_, a, b in zip(texts, words.bounds, words.bounds[1:]):
                    off = gone[a:b]
                    n = int(off.sum())
                    removed.append(n)
                    kept.append(b" ".join(list_ if not n else [w for w, o in zip(list_, off.tolist()) if not o]))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*got.schema.names, *added])
                trimmed_memory()

    return both.mapInArrow(run, schema)


def digest(deduped: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
