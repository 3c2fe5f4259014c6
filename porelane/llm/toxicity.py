"""Operator 1: toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its own vector (words of the training sample) next to the mean vector of
all its byte trigrams (hashed, so unseen words have one too).  Words end at white space and
punctuation, those of Unicode too; a run of more than RUN bytes without either, as in scripts
without spaces, is a sequence of pieces that hold all of its trigrams.  Both directions of a GRU run
over windows of `window` words that start every `stride` words, attention pools the states
of a window into a logit, and a document scores the sigmoid of its largest window logit.
Everything is numpy: inputs are projected once per distinct word of a batch, and the windows
of a batch go through the recurrence in lockstep.

Training (driver, numpy, Adam): at most `clean` and `toxic` labelled documents of the two
classes, those of smallest hash, of at most `max_bytes` bytes each; a document's gradient goes
through its highest-scoring window.  A word has a vector of its own if it is in 3 to 10 of these
documents, more the larger the sample.  Scoring reads whole texts of every document in any partitioning.

Edge cases: null text, empty text or text without words scores as one empty window; null
labels and null ids are no training rows; without both classes every score is the share of
toxic training rows; repeated rows are scored each; extra columns are ignored; a document
with any toxic label row counts as toxic.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import PUNCTUATION, Words, mix64, slices, string_buffers

U = np.uint64
RUN, PIECE = 48, 24  # bytes: longest word that is one input, and the pieces of longer ones
#: white space and punctuation outside ASCII, by code point
_BREAK = np.array([c > 127 and (c in (0x85, 0x200B) or unicodedata.category(chr(c))[0] in "ZP") for c in range(0x10000)])


@dataclass(frozen=True)
class Shape:
    words: int = 20_000
    word_dim: int = 12
    char_rows: int = 16_384
    char_dim: int = 6
    hidden: int = 8
    attention: int = 8
    window: int = 32
    stride: int = 16


def sigmoid(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def spaced(data: np.ndarray) -> np.ndarray:
    """UTF-8 with blanks instead of the white space and punctuation outside ASCII."""
    at = np.flatnonzero(data >= 0xC2)
    if not len(at):
        return data
    raw = np.concatenate([data, [0, 0]]).astype(np.int64)
    a, b, c = raw[at], raw[at + 1] & 63, raw[at + 2] & 63
    two, three = a < 0xE0, (a >= 0xE0) & (a < 0xF0)
    code = np.where(two, (a & 31) << 6 | b, np.where(three, (a & 15) << 12 | b << 6 | c, 0))
    gone = _BREAK[code]
    out = data.copy()
    for k in range(3):
        out[at[gone & three if k == 2 else gone] + k] = 32
    return out


def cut_runs(words: Words) -> None:
    """Words of more than RUN bytes become pieces that start every PIECE bytes, at a character, and hold all trigrams together.

    A piece goes two bytes into the next one.
    """
    long = np.flatnonzero(words.end - words.start > RUN)
    if not len(long):
        return
    start, end = [words.start], [words.end.copy()]
    for w in long.tolist():
        a, b = int(words.start[w]), int(words.end[w])
        at = np.arange(a + PIECE, b - PIECE // 2, PIECE)
        for _ in range(3):
            at -= (words.data[at] & 0xC0) == 0x80  # a continuation byte
        end[0][w] = at[0] + 2
        start.append(at)
        end.append(np.append(at[1:] + 2, b))
    start, end = np.concatenate(start), np.concatenate(end)
    order = np.argsort(start, kind="stable")
    words.start, words.end = start[order], end[order]
    words.bounds = np.searchsorted(words.start, words.offsets)


class Text:
    """Distinct words of a batch, the word sequence as indices into them, and char trigrams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shape: Shape):
        words = Words(spaced(data), offsets, True, PUNCTUATION)
        cut_runs(words)
        h = words.hashes()
        self.hash, first, self.index = np.unique(h, return_index=True, return_inverse=True)
        self.bounds = words.bounds
        start, end = words.start[first], words.end[first]
        # trigrams of a word with one edge mark at either side: a word of n bytes has n
        size = end - start
        at = np.concatenate([[0], np.cumsum(size)])
        pos = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
        owner = np.repeat(np.arange(len(size)), size)
        raw = np.concatenate([[0], words.data, [0]]).astype(np.uint32)
        left = np.where(pos == start[owner], 1, raw[pos]) if len(pos) else pos.astype(np.uint32)
        right = np.where(pos + 1 == end[owner], 2, raw[pos + 2]) if len(pos) else left
        mid = raw[pos + 1] if len(pos) else left
        key = (left.astype(U) << U(16)) | (mid.astype(U) << U(8)) | right.astype(U)
        self.tri, self.tri_owner, self.tri_at, self.tri_n = (mix64(key) % U(shape.char_rows)).astype(np.int64), owner, at, size

    def windows(self, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and document of every window; a text without words has one of length 0."""
        n = np.diff(self.bounds)
        count = np.where(n > shape.window, -(-(n - shape.window) // shape.stride) + 1, 1)
        doc = np.repeat(np.arange(len(n)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = nth * shape.stride
        return self.bounds[:-1][doc] + start, np.minimum(shape.window, n[doc] - start), doc


class Network:
    def __init__(self, shape: Shape, vocabulary: np.ndarray, prior: float):
        self.shape, self.vocabulary, self.prior, self.p = shape, vocabulary, prior, None

    def start(self, odds: np.ndarray, tri_odds: np.ndarray, seed: int = 1) -> None:
        """odds, tri_odds: starting values of the first component of each word's and each trigram's vector."""
        s, r = self.shape, np.random.default_rng(seed)
        d, h = s.word_dim + s.char_dim, s.hidden
        n = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": n(len(self.vocabulary) + 1, s.word_dim, scale=0.1), "char": n(s.char_rows, s.char_dim, scale=0.3), "att": n(2 * h, s.attention, scale=0.4), "att_b": np.zeros(s.attention, np.float32), "att_v": n(s.attention, scale=0.4), "out": n(2 * h, scale=0.4), "out_b": np.full(1, -1, np.float32)}
        self.p["word"][1:, 0], self.p["char"][:, 0] = odds, tri_odds
        for k in "fb":
            self.p |= {f"x{k}": n(d, 3 * h, scale=d**-0.5), f"u{k}": n(h, 3 * h, scale=h**-0.5), f"b{k}": np.zeros(3 * h, np.float32)}

    def inputs(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.vocabulary, text.hash)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == text.hash[known]
        row = np.where(known, at + 1, 0)
        char = np.zeros((len(text.hash), self.shape.char_dim), np.float32)
        if len(text.tri):
            char = np.add.reduceat(self.p["char"][text.tri], text.tri_at[:-1]) / text.tri_n[:, None].astype(np.float32)
        return row, np.concatenate([self.p["word"][row], char], 1)

    def direction(self, k: str, gates: np.ndarray, steps: np.ndarray, live: np.ndarray, keep: list | None):
        """States of one direction. gates: projected inputs of each word; steps, live: (time, window)."""
        h, p = self.shape.hidden, self.p
        state = np.zeros((steps.shape[1], h), np.float32)
        out = np.empty((*steps.shape, h), np.float32)
        for t in range(len(steps)) if k == "f" else range(len(steps) - 1, -1, -1):
            g, r = gates[steps[t]], state @ p[f"u{k}"]
            zr = sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
            z, rs = zr[:, :h] * live[t][:, None], zr[:, h:]
            c = np.tanh(g[:, 2 * h :] + rs * r[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, zr[:, :h], z, rs, c, r[:, 2 * h :]))
            state = state + z * (c - state)
            out[t] = state
        return out

    def logits(self, gates: dict, index: np.ndarray, start: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p, w = self.p, int(max(1, size.max(initial=1)))
        t = np.arange(w)[:, None]
        live = (t < size[None, :]).astype(np.float32)
        steps = np.minimum(start[None, :] + np.minimum(t, np.maximum(size - 1, 0)[None, :]), max(0, len(index) - 1))
        steps = index[steps] if len(index) else np.zeros(steps.shape, np.int64)
        trace = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        s = np.concatenate([self.direction(k, gates[k], steps, live, trace[k]) for k in "fb"], 2)
        a = np.tanh(s @ p["att"] + p["att_b"])
        e = np.exp((a @ p["att_v"]) + (live - 1) * 30)
        weight = e / e.sum(0)
        pooled = np.einsum("tbh,tb->bh", s, weight) * (size > 0)[:, None]
        if keep is not None:
            keep |= {"trace": trace, "s": s, "a": a, "weight": weight, "pooled": pooled, "steps": steps, "live": live}
        return pooled @ p["out"] + p["out_b"][0]

    def gates(self, x: np.ndarray) -> dict:
        if not len(x):
            x = np.zeros((1, x.shape[1]), np.float32)
        return {k: x @ self.p[f"x{k}"] + self.p[f"b{k}"] for k in "fb"}

    def window_logits(self, text: Text, block: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        start, size, doc = text.windows(self.shape)
        gates = self.gates(self.inputs(text)[1])
        # windows of like length share a block, so short texts cost few steps
        order = np.argsort(size, kind="stable")
        logit = np.empty(len(start), np.float32)
        for a in range(0, len(order), block):
            o = order[a : a + block]
            logit[o] = self.logits(gates, text.index, start[o], size[o])
        return logit, start, size, doc

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.p is None:
            return np.full(n, self.prior)
        logit, _, _, doc = self.window_logits(Text(data, offsets, self.shape))
        best = np.full(n, -np.inf)
        np.maximum.at(best, doc, logit)
        return 1 / (1 + np.exp(-best))

    def gradient(self, text: Text, start: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
        """Of the mean cross entropy of these windows' logits."""
        p, h = self.p, self.shape.hidden
        row, x = self.inputs(text)
        gates, keep = self.gates(x), {}
        y = self.logits(gates, text.index, start, size, keep)
        prob = 1 / (1 + np.exp(-y))
        loss = float(np.mean(np.maximum(y, 0) - y * label + np.log1p(np.exp(-np.abs(y)))))
        dy = ((prob - label) / len(y)).astype(np.float32)
        g = {"out": keep["pooled"].T @ dy, "out_b": dy.sum(keepdims=True)}
        dpool = dy[:, None] * p["out"] * (size > 0)[:, None]
        s, a, weight = keep["s"], keep["a"], keep["weight"]
        ds = weight[:, :, None] * dpool[None]
        dweight = np.einsum("tbh,bh->tb", s, dpool)
        de = weight * (dweight - (weight * dweight).sum(0))
        g["att_v"] = np.einsum("tb,tba->a", de, a)
        da = de[:, :, None] * p["att_v"] * (1 - a * a)
        g["att"], g["att_b"] = np.einsum("tbh,tba->ha", s, da), da.sum((0, 1))
        ds = ds + da @ p["att"].T
        dx = np.zeros_like(x) if len(x) else np.zeros((1, self.shape.word_dim + self.shape.char_dim), np.float32)
        for i, k in enumerate("fb"):
            du, dg, carry = np.zeros_like(p[f"u{k}"]), np.zeros_like(gates[k]), np.zeros((len(y), h), np.float32)
            for t, before, z0, z, r, c, rc in reversed(keep["trace"][k]):
                d = ds[t][:, i * h : (i + 1) * h] + carry
                dc = d * z * (1 - c * c)
                dz = d * (c - before) * keep["live"][t][:, None] * z0 * (1 - z0)
                dr = dc * rc * r * (1 - r)
                step = np.concatenate([dz, dr, dc], 1)
                inner = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(dg, keep["steps"][t], step)
                du += before.T @ inner
                carry = d * (1 - z) + inner @ p[f"u{k}"].T
            g[f"u{k}"], g[f"b{k}"] = du, dg.sum(0)
            g[f"x{k}"] = x.T @ dg if len(x) else np.zeros_like(p[f"x{k}"])
            dx += dg @ p[f"x{k}"].T
        dim = self.shape.word_dim
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        if len(x):
            np.add.at(g["word"], row, dx[:, :dim])
            np.add.at(g["char"], text.tri, (dx[:, dim:] / text.tri_n[:, None])[text.tri_owner])
        return g, loss


def train(texts: list[str], labels: list[int], shape: Shape = Shape(), epochs: int = 5, batch: int = 64, steps: int = 300, rate: float = 0.02, seed: int = 1) -> Network:
    """At least `steps` steps: a small sample goes through in smaller batches, more often."""
    label = np.array(labels, np.float32)
    batch = min(batch, max(16, len(texts) // 32))
    epochs = max(epochs, -(-steps * batch // max(1, len(texts))))
    prior = float(label.mean()) if len(label) else 0.0
    if not 0 < prior < 1:
        return Network(shape, np.zeros(0, U), prior)
    cut = [pa.array(texts[i : i + batch], pa.string()) for i in range(0, len(texts), batch)]
    seen, toxic = {}, {}
    tri_seen, tri_toxic = np.zeros(shape.char_rows), np.zeros(shape.char_rows)
    for i, part in enumerate(cut):
        text = Text(*string_buffers(part), shape)
        for j in range(len(part)):
            own = np.unique(text.index[text.bounds[j] : text.bounds[j + 1]])
            tri = np.unique(np.concatenate([text.tri[:0], *(text.tri[text.tri_at[w] : text.tri_at[w + 1]] for w in own)]))
            tri_seen[tri] += 1
            tri_toxic[tri] += label[i * batch + j]
            for w in own:
                k = int(text.hash[w])
                seen[k] = seen.get(k, 0) + 1
                toxic[k] = toxic.get(k, 0) + int(label[i * batch + j])
    often = sorted(seen, key=lambda k: (-seen[k], k))[: shape.words]
    least = int(min(10, max(3, len(texts) // 400)))
    vocabulary = np.array(sorted(k for k in often if seen[k] >= least), U)
    net = Network(shape, vocabulary, prior)
    n1, n0 = label.sum(), len(label) - label.sum()
    add = least / 2
    odds = [np.log((toxic[int(k)] + add) / (n1 + 2 * add)) - np.log((seen[int(k)] - toxic[int(k)] + add) / (n0 + 2 * add)) for k in vocabulary]
    tri_odds = np.log((tri_toxic + add) / (n1 + 2 * add)) - np.log((tri_seen - tri_toxic + add) / (n0 + 2 * add))
    net.start(np.array(odds, np.float32) / 2, np.where(tri_seen >= least, tri_odds, 0).astype(np.float32), seed)
    rng, m, v, step = np.random.default_rng(seed), {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            text = Text(*string_buffers(pa.array([texts[i] for i in some], pa.string())), shape)
            logit, start, size, doc = net.window_logits(text)
            best = np.lexsort((-logit, doc))
            best = best[np.searchsorted(doc[best], np.arange(len(some)))]
            grad, _ = net.gradient(text, start[best], size[best], label[some])
            step += 1
            lr = rate * (1 - 0.8 * step / (epochs * -(-len(texts) // batch)))
            for k, x in net.p.items():
                m[k] += 0.1 * (grad[k] - m[k])
                v[k] += 0.01 * (grad[k] ** 2 - v[k])
                x -= (lr * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def held_out(fold: int = 2, of: int = 4):
    """Rows that no training may use."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, clean: int, toxic: int, max_bytes: int) -> list:
    """At most so many labelled documents of each class, in hash order; the limits are what bounds training."""
    marked = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((0, clean), (1, toxic))]
    some = some[0].unionByName(some[1])
    # F.broadcast: at most clean + toxic rows of two numbers
    got = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes).join(F.broadcast(some), "doc_id")
    return sorted(got.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])


def scored(docs: DataFrame, net: Network, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the score of every row as one more column."""
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(net)  # bounded by Shape

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.scores(*string_buffers(part.column(text))), pa.float64())], names=[*part.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def fitted(docs: DataFrame, labels: DataFrame, clean: int = 3000, toxic: int = 1000, max_bytes: int = 6000, shape: Shape = Shape()) -> Network:
    got = training_rows(docs, labels, clean, toxic, max_bytes)
    net = train([r["text"] for r in got], [r["toxic"] for r in got], shape)
    if net.p is not None:
        # the sample holds the classes in other shares than the labels: shift the logit by the ratio of odds
        n, n1 = labels.where("doc_id is not null and toxic is not null").where(~held_out()).agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("int"))).first()
        net.p["out_b"] += np.float32(np.log(n1 / (n - n1)) - np.log(net.prior / (1 - net.prior)))
    return net


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = scored(docs.select("doc_id", "text"), fitted(docs, labels, **how))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
