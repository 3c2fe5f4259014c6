"""Operator 10: n-gram language-model scoring with an Elias-Fano trie.

p1(w) = (c(w) + 1) / (N + V + 1), one unseen word counted in, and for each longer context h,
with h' one word shorter, p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m); an unseen h leaves
p(w | h').  Orders go up to 2 or 3, as `prior` has entries, which are the m; probabilities sum
to 1 before quantisation.  A text's score is the log10 probability of its words and its end.

1. Every chunk of documents sends its distinct words with their training counts; word-hash
   buckets sum them, give every training word an id, and answer with id and count.
2. For each order, chunks send their distinct n-grams with training counts, the count of the
   context and the lower order's code.  A bucket of contexts sums them, builds the trie of its
   smoothed probabilities (see trie.py), maps it and answers a code for each n-gram, and its
   count, which is the next order's context count.  A context whose count is above a bucket's
   share is dealt over as many buckets as it fills.  N-grams whose context or lower-order
   n-gram no training text holds need no question.
3. Chunks sum the log probabilities of each document.

The model is as large as the corpus makes it and never on one machine: a bucket holds its
share of the trie, in a file that only its own task maps.  Texts are written once as a
bucketed table and are not shuffled again; shuffle files go before the next order's.  Words
are known by 64-bit hashes: of 2**32 distinct words, the most there may be, one pair in two
corpora would share counts.

Edge cases: null and empty texts are one end token; a null doc_id is never learned from;
without training rows N = V = 0 and every token is unseen; repeated rows are learned from
and scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_SQL, answers_for, blob, chunk_docs, chunk_table, in_batches, rows, send_values, text_bytes, trimmed_memory, unblob, with_answers, written
from .trie import MEANS, quantised, with_trie
from .words import Words, mix64, string_buffers

U = np.uint64
END = np.uint64(0x5851F42D4C957F2D)  # the end token's hash
START, FIRST = 1, 2  # ids: 0 unseen, 1 the start of a text, training words from 2
PER_BUCKET = 1_000_000
PRIOR = (100.0,)  # m of order 2; a second entry adds order 3


def squeezed(values: np.ndarray, sorted_: bool = False) -> bytes:
    import zstandard

    if sorted_ and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    values = np.ascontiguousarray(values).reshape(-1)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T  # bytes of one weight together
    return zstandard.ZstdCompressor(level=1).compress(blob(planes))


def expanded(value, dtype, sorted_: bool = False) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    out = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
    return np.cumsum(out, dtype=dtype) if sorted_ else out


def in_training(doc_id, of: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % of != fold


class Tokens:
    """Word hashes of a chunk with an end after each text."""

    def __init__(self, docs: pa.RecordBatch, of: int, fold: int):
        words = Words(*string_buffers(docs.column("text")), True)
        self.size = np.diff(words.bounds) + 1
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.hash = np.insert(words.hashes(), words.bounds[1:], END)
        train = np.array([in_training(d, of, fold) for d in docs.column("doc_id").to_pylist()], bool)
        self.train = np.repeat(train, self.size)
        del words
        self.words, self.inverse = np.unique(self.hash, return_inverse=True)
        del self.hash

    def known(self, answers: np.ndarray, n_tokens: int, n_types: int) -> None:
        """With the answers (id, count) to the words: id, count and first-order probability of each token."""
        known = answers.reshape(-1, 2)
        self.total = int(known[np.searchsorted(self.words, END), 1]) if len(self.words) else 0
        self.id, self.count = known[self.inverse, 0].astype(U), known[self.inverse, 1]
        self.p = (self.count + 1) / (n_tokens + n_types + 1)
        self.order, self.context, self.n_context = 1, None, None

    def deeper(self, share: int, buckets: int, counts: np.ndarray | None = None) -> None:
        """To the next order. counts: of each token's n-gram of this order; first-order counts are known."""
        counts = self.count if counts is None else counts
        first = self.at[:-1]
        # the word before, and as context count that of the n-gram which ends there
        before, n_before = np.roll(self.id, self.order), np.roll(counts, 1)
        for k in range(self.order):
            before[np.minimum(first + k, len(before) - 1)[self.size > k]] = START
        n_before[first] = self.total  # as many starts as ends
        if self.context is None:
            self.context = before
        else:
            self.context = before << U(32) | self.context & U(0xFFFFFFFF)
        asked = np.flatnonzero((n_before > 0) & (counts > 0))
        self.n_context, self.asked, self.order = n_before, asked, self.order + 1
        context, back = np.unique(self.context[asked], return_inverse=True)
        _, at, self.of = np.unique(back.astype(U) << U(32) | self.id[asked], return_index=True, return_inverse=True)
        self.num = np.bincount(self.of, self.train[asked], len(at)).astype(np.uint32)
        some = asked[at]
        self.gram = self.context[some], self.id[some], n_before[some], quantised(self.p[some])
        salts = (1 + self.gram[2] // share).astype(U)
        bucket = ((mix64(self.gram[0]) + mix64(self.gram[1]) % salts) % U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        self.in_order = np.argsort(bucket, kind="stable")
        self.cut = np.searchsorted(bucket[self.in_order], np.arange(buckets + 1))

    def each(self, answers: np.ndarray) -> np.ndarray:
        """Of each token, the answer to its n-gram; 0 where none was asked."""
        out, gram = np.zeros(len(self.id), answers.dtype), np.empty(len(answers), answers.dtype)
        gram[self.in_order] = answers
        out[self.asked] = gram[self.of]
        return out

    def smoothed(self, codes: np.ndarray, m: float) -> None:
        """Probabilities of this order from each token's code."""
        low = m * self.p / (np.maximum(self.n_context, 0) + m)
        self.p = np.where(self.n_context > 0, np.where(codes > 0, MEANS[codes], low), self.p)


def send_words(chunks: DataFrame, of: int, fold: int, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r, docs in chunk_docs(batch):
                t = Tokens(docs, of, fold)
                num = np.bincount(t.inverse, t.train, len(t.words)).astype(np.uint32)
                yield from send_values(batch.column("part")[r].as_py(), batch.column("seq")[r].as_py(), t.words, num, buckets)
                trimmed_memory()

    return chunks.mapInArrow(run, SENT_SQL)


def vocabulary(sent: DataFrame, buckets: int) -> DataFrame:
    """Answers (id, count) to each chunk's words; n_tokens and n_types of the bucket are on one of its rows."""

    def count(group: pa.Table) -> pa.Table:
        trimmed_memory()
        values = [unblob(x, U) for x in group.column("val")]
        each, inverse = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unblob(x, np.uint32) for x in group.column("num")]), len(each)).astype(np.int64)
        seen = total > 0
        ids = np.where(seen, (np.cumsum(seen) - 1) * buckets + group.column("bucket")[0].as_py() + FIRST, 0)
        if ids.max(initial=0) >= 1 << 32:
            raise ValueError("more than 2**32 distinct words")
        ans = np.stack([ids, total], 1)[inverse]
        at = np.cumsum([0] + [len(v) for v in values])
        zero = np.zeros(len(values), np.int64)
        n, v = zero.copy(), zero.copy()
        n[0], v[0] = total.sum(), seen.sum()
        return pa.table({"part": group.column("part"), "seq": group.column("seq"), "bucket": group.column("bucket"), "ans": pa.array([squeezed(ans[a:b]) for a, b in zip(at, at[1:])], pa.binary()), "n_tokens": pa.array(n), "n_types": pa.array(v)})

    return sent.groupBy("bucket").applyInArrow(count, "part long, seq int, bucket int, ans binary, n_tokens long, n_types long")


GRAMS = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("seq", pa.int32()), ("context", pa.binary()), ("runs", pa.binary()), ("of", pa.binary()), ("word", pa.binary()), ("num", pa.binary()), ("lower", pa.binary())])
GRAMS_SQL = "bucket int, part long, seq int, context binary, runs binary, of binary, word binary, num binary, lower binary"


def send_grams(answered: DataFrame, tokens, buckets: int) -> DataFrame:
    """tokens: (batch, row, documents) -> Tokens that have gone to the order that is asked."""

    def run(batches):
        for batch in batches:
            for r, docs in chunk_docs(batch):
                t = tokens(batch, r, docs)
                made = {n: [] for n in GRAMS.names}
                for b in np.flatnonzero(np.diff(t.cut)).tolist():
                    mine = t.in_order[t.cut[b] : t.cut[b + 1]]
                    context, word, of, lower = (x[mine] for x in t.gram)
                    head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                    values = (b, batch.column("part")[r].as_py(), batch.column("seq")[r].as_py(), squeezed(context[head], True), squeezed(np.diff(np.append(head, len(mine))).astype(np.uint32)), squeezed(of[head]), squeezed(word.astype(np.uint32)), squeezed(t.num[mine]), squeezed(lower))
                    for n, v in zip(GRAMS.names, values):
                        made[n].append(v)
                if made["bucket"]:
                    yield from in_batches(made, GRAMS)
                trimmed_memory()

    return answered.mapInArrow(run, GRAMS_SQL)


def codes(sent: DataFrame, order: int, m: float, counted: bool) -> DataFrame:
    """part, seq, bucket, ans, counts: a code and (if counted) a count for each n-gram, from the trie of the bucket's training n-grams."""

    def answer(group: pa.Table) -> pa.Table:
        trimmed_memory()

        def column(name: str, dtype, sorted_: bool = False) -> list[np.ndarray]:
            return [expanded(x.as_py(), dtype, sorted_) for x in group.column(name)]

        contexts, sizes = column("context", U, True), column("runs", np.uint32)
        context, at, back = np.unique(np.concatenate(contexts), return_index=True, return_inverse=True)
        n_context = np.concatenate(column("of", np.int64))[at]
        words = column("word", np.uint32)
        key = np.repeat(back.astype(U), np.concatenate(sizes)) << U(32) | np.concatenate(words).astype(U)
        each, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        del key, back
        total = np.bincount(inverse, np.concatenate(column("num", np.uint32)), len(each)).astype(np.int64)
        lower = np.concatenate(column("lower", np.uint8))[at]
        del at
        row, seen = (each >> U(32)).astype(np.int64), total > 0

        def split(some) -> list[np.ndarray]:
            of = context[row[some]]
            return [of >> U(32), of & U(0xFFFFFFFF), each[some] & U(0xFFFFFFFF)][3 - order :]

        p = (total[seen] + m * MEANS[lower[seen]]) / (n_context[row[seen]] + m)
        # every distinct question once; the answers then go back to each chunk's questions
        code, counts = with_trie(split(seen), p, lambda trie: trie.lookup(split(slice(None))))[inverse], total[inverse]
        end = np.cumsum([0] + [len(x) for x in words])
        found = [code[a:b] for a, b in zip(end, end[1:])]
        return pa.table({"part": group.column("part"), "seq": group.column("seq"), "bucket": group.column("bucket"), "ans": pa.array([squeezed(x) for x in found], pa.binary()), "counts": pa.array([squeezed(counts[a:b]) if counted else None for a, b in zip(end, end[1:])], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(answer, "part long, seq int, bucket int, ans binary, counts binary")


SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def lm_scores(docs: DataFrame, of: int = 7, fold: int = 2, prior: tuple[float, ...] = PRIOR, max_bytes: int = 3_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    prior: m of each order from 2 on, at most of two; () stops at order 1.
    """
    if len(prior) > 2:
        raise ValueError("a context key has two words")
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    volume = text_bytes(docs)
    word_buckets = 1 + volume // 6 // 5 // PER_BUCKET
    buckets = [1 + volume // 6 * (3, 4)[n] // 4 // PER_BUCKET for n in range(len(prior))]
    chunks = chunk_table(docs, "lm", "text", max_bytes)
    words = written(vocabulary(send_words(chunks, of, fold, word_buckets), word_buckets), "words")
    n_tokens, n_types = (x or 0 for x in words.agg(F.sum("n_tokens"), F.sum("n_types")).first())
    answered = with_answers(chunks, words, "order1")
    shares = [max(1, n_tokens // n) for n in buckets]

    def upto(order: int):
        """Tokens that have the answers up to this order, and questions of the next one if there is one."""

        def tokens(batch: pa.RecordBatch, r: int, got: pa.RecordBatch) -> Tokens:
            t = Tokens(got, of, fold)
            t.known(answers_for(batch, r, np.int64, "order1", expanded), n_tokens, n_types)
            counts = None
            for n in range(len(prior)):
                if n + 1 > order:
                    break
                if n:
                    t.smoothed(t.each(answers_for(batch, r, np.uint8, f"order{n + 1}", expanded)), prior[n - 1])
                    counts = t.each(answers_for(batch, r, np.int64, f"order{n + 1}", expanded, "counts"))
                t.deeper(shares[n], buckets[n], counts)
            return t

        return tokens

    for n, m in enumerate(prior):
        grams = written(codes(send_grams(answered, upto(n + 1), buckets[n]), n + 2, m, n + 1 < len(prior)), f"order{n + 2}")
        answered = with_answers(answered, grams, f"order{n + 2}", ("ans", "counts") if n + 1 < len(prior) else ("ans",))

    def run(batches):
        tokens = upto(len(prior))
        for batch in batches:
            for r, got in chunk_docs(batch):
                t = tokens(batch, r, got)
                p1 = (t.count + 1) / (n_tokens + n_types + 1)
                if prior:
                    t.smoothed(t.each(answers_for(batch, r, np.uint8, f"order{len(prior) + 1}", expanded)), prior[-1])
                at = t.at[:-1]
                yield rows(SCORES, doc_id=got.column("doc_id"), n_tokens=t.size, n_known=np.add.reduceat((t.count > 0).astype(np.int64), at), base_score=np.add.reduceat(np.log10(p1), at), score=np.add.reduceat(np.log10(t.p), at))
                trimmed_memory()

    out = answered.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == fold, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
