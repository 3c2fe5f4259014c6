"""Operator 3: exact n-gram Jaccard join by filters under several global token orders.

A text's tokens are its distinct word shingles (64-bit hashes).  Texts with equal sets form
one class (told by 128 bits); classes are what is compared.  For any global order of tokens,
two sets of similarity t share a token among the first |x| - ceil(t|x|) + 1 of each (with k
more tokens, k + 1 shared ones).  Three orders are used and their filters intersected:

A  hash order, with a lengthened prefix: classes that share too few prefix tokens with any
   other class leave.
B  rarest first (a logarithmic class of the number of surviving classes that hold a token,
   then hash).
C  rarest first with another hash.

A prefix token of at most SHORT classes yields its pairs, at most SHORT / 2 for each posting; a
pair is a candidate if it comes under B and C both.  A more frequent token, as in a group of
thousands of near copies, yields no pairs: its classes are tied to one of them.  Candidates
and ties are connected into clusters, and a pair of one cluster is verified if it shares a
prefix token under A, B and C each: all in blocked products of incidence matrices, first of
the three prefixes, then of the whole sets that are left.  A pair of blocks is a task and
yields each member's links and one edge to its root in that block pair, never a row for each pair.

Scale: no step gathers a token's or a class's documents in one task.  In each map task at
most two postings a token are sent on (others are counted there), tokens are counted in hash
buckets of bounded size, and membership is joined on a class with one row on one side.  Two
given different shingles share a hash with probability 2**-64, which is what a verified pair
depends on.

Edge cases: null or empty text and text without words has an empty set, its own component
and no links; a null doc_id gets n_shingles and null component_id, and links with nothing;
repeated rows are documents of one class, rows of one doc_id with different texts are of
several; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blob, components, dropped, free, in_batches, rows, text_bytes, trimmed_memory, unblob, with_least, written
from .words import Words, mix64, shingles, slices, string_buffers

U = np.uint64
PER_BUCKET = 1_000_000  # tokens a bucket of postings holds, about
BLOCK = 256  # members a block of a cluster holds, about
SHORT = 16  # classes of a prefix token that yields pairs
TASK = 2000  # members of small clusters in a task, about


def need(n, percent):
    """Least overlap that a set of n tokens can have with a similar set."""
    return -(-n * percent // 100)


def token_sets(batches, k: int):
    """(doc_ids, sets) of each slice of a stream of (doc_id, text) batches."""
    for batch in batches:
        for part in slices(batch):
            words = Words(*string_buffers(part.column("text")), True)
            yield part.column("doc_id"), shingles(words.hashes(), words.bounds, k)


def class_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def short_key(key: bytes) -> int:
    """64 bits of a class's key: filter A may confuse classes by it, which keeps more of them."""
    return int.from_bytes(key[:8], "little", signed=True)


MEMBERS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("short", pa.int64())])


def members(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, key (of the set; null where the set is empty) and 64 bits of it."""

    def run(batches):
        for ids, sets in token_sets(batches, k):
            keys = [class_key(s) if len(s) else None for s in sets]
            yield rows(MEMBERS, doc_id=ids, n=[len(s) for s in sets], key=keys, short=[x and short_key(x) for x in keys])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, short long")


POSTINGS = pa.schema([("bucket", pa.int32()), ("tok", pa.binary()), ("ref", pa.binary()), ("cid", pa.binary()), ("known", pa.binary())])
SHARED = pa.schema([("short", pa.int64()), ("shared", pa.int64())])


def prefix_a(n: int, percent: int, longer: float) -> int:
    p = n - need(n, percent) + 1
    return min(n, p + int(longer * p))


def shared_counts(docs: DataFrame, k: int, percent: int, longer: float, buckets: int) -> DataFrame:
    """short, shared: how many tokens of its prefix under order A another class has in its own, at least."""

    def send(batches):
        def chunk():
            tok, ref = np.concatenate(toks), np.repeat(np.arange(len(toks), dtype=np.uint32), [len(t) for t in toks])
            cid = np.array(cids, np.int64)
            order = np.argsort(tok, kind="stable")
            tok, ref = tok[order], ref[order]
            head = np.concatenate([[True], tok[1:] != tok[:-1]])
            tail = np.concatenate([head[1:], [True]])
            known = np.bincount(ref[~(head | tail)], minlength=len(cid)).astype(np.int64)
            tok, ref = tok[head | tail], ref[head | tail]
            # the highest bits: sorted tokens are in order of buckets
            cut = np.searchsorted((tok >> U(32)) * U(buckets) >> U(32), np.arange(buckets + 1))
            made = {n: [] for n in POSTINGS.names}
            for b in np.flatnonzero(np.diff(cut)).tolist():
                s = slice(cut[b], cut[b + 1])
                own, at = np.unique(ref[s], return_inverse=True)  # only the classes with a token in the bucket
                for name, v in zip(POSTINGS.names, (b, blob(tok[s]), blob(at.astype(np.uint32)), blob(cid[own]), None)):
                    made[name].append(v)
            if known.any():
                own = np.flatnonzero(known)
                for name, v in zip(POSTINGS.names, (abs(cids[0]) % buckets, b"", b"", blob(cid[own]), blob(known[own]))):
                    made[name].append(v)
            return in_batches(made, POSTINGS)

        toks, cids, seen, size = [], [], set(), 0
        for _, sets in token_sets(batches, k):
            for s in sets:
                if len(s) and (c := short_key(class_key(s))) not in seen:
                    seen.add(c)
                    cids.append(c)
                    toks.append(s[: prefix_a(len(s), percent, longer)])
                    size += len(toks[-1])
            if size > PER_BUCKET:
                yield from chunk()
                toks, cids, seen, size = [], [], set(), 0
                trimmed_memory()
        if toks:
            yield from chunk()

    def count(group: pa.Table) -> pa.Table:
        trimmed_memory()
        toks, owners, out = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for tok, ref, cid, known in zip(*(group.column(c).to_pylist() for c in ("tok", "ref", "cid", "known"))):
            cid = unblob(cid, np.int64)
            if known is None:
                toks.append(unblob(tok, U))
                owners.append(cid[unblob(ref, np.uint32)])
            else:
                out.append(np.stack([cid, unblob(known, np.int64)], 1))
        tok, owner = np.concatenate(toks), np.concatenate(owners)
        if len(tok):
            order = np.argsort(tok, kind="stable")
            tok, owner = tok[order], owner[order]
            head = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            many = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)
            got, n = np.unique(owner[np.repeat(many, np.diff(np.append(head, len(tok))))], return_counts=True)
            out.append(np.stack([got, n], 1))
        out = np.concatenate(out)
        return pa.table({"short": pa.array(out[:, 0]), "shared": pa.array(out[:, 1])}, schema=SHARED)

    sent = docs.select("doc_id", "text").mapInArrow(send, "bucket int, tok binary, ref binary, cid binary, known binary")
    return sent.groupBy("bucket").applyInArrow(count, "short long, shared long").groupBy("short").agg(F.sum("shared").alias("shared"))


CHUNK = pa.schema([("chunk", pa.int64()), ("cid", pa.binary()), ("size", pa.binary()), ("tok", pa.binary())])


def set_chunks(docs: DataFrame, alive: DataFrame, k: int) -> DataFrame:
    """The surviving classes' sets, some hundreds in a row: chunk, cid, size, tok."""

    def run(batches):
        from pyspark import TaskContext

        nth, cids, toks, size = TaskContext.get().partitionId() << 32, [], [], 0

        def chunk():
            return rows(CHUNK, chunk=[nth], cid=[blob(np.array(cids, np.int64))], size=[blob(np.array([len(t) for t in toks], np.int64))], tok=[blob(np.concatenate(toks))])

        for batch in batches:
            wanted, keys, at = batch.column("cid").to_pylist(), batch.column("key").to_pylist(), 0
            for _, sets in token_sets([batch.select(["doc_id", "text"])], k):
                for s in sets:
                    if len(s) and class_key(s) == keys[at]:
                        cids.append(wanted[at])
                        toks.append(s)
                        size += len(s)
                    at += 1
            if size > PER_BUCKET // 4:
                yield chunk()
                nth, cids, toks, size = nth + 1, [], [], 0
        if toks:
            yield chunk()

    few = alive.count() <= 200_000  # checked: 32 bytes a row; a shuffled join beyond it
    wanted = alive.select(F.col("rep").alias("doc_id"), "cid", "key")
    return docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id").mapInArrow(run, "chunk long, cid binary, size binary, tok binary")


COUNTED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("rarity", pa.binary())])
TOKENS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("tok", pa.binary()), ("count", pa.binary())])


def rarities(chunks: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, rarity: of each distinct token of the chunk in the bucket, in order, 0 if one class has it, else 1 + 4 log2 of how many do."""

    def send(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                tok, n = np.unique(unblob(batch.column("tok")[r], U), return_counts=True)
                cut = np.searchsorted((tok >> U(32)) * U(buckets) >> U(32), np.arange(buckets + 1))
                chunk = batch.column("chunk")[r].as_py()
                full = np.flatnonzero(np.diff(cut)).tolist()
                s = [slice(cut[b], cut[b + 1]) for b in full]
                yield from in_batches({"bucket": full, "chunk": [chunk] * len(full), "tok": [blob(tok[x]) for x in s], "count": [blob(n[x].astype(np.uint32)) for x in s]}, TOKENS)

    def count(group: pa.Table) -> pa.Table:
        trimmed_memory()
        toks = [unblob(x, U) for x in group.column("tok")]
        _, inverse = np.unique(np.concatenate(toks), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unblob(x, np.uint32) for x in group.column("count")]))
        rarity = np.where(total > 1, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(total, 1)))), 0).astype(np.uint8)[inverse]
        at = np.cumsum([0] + [len(t) for t in toks])
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "rarity": pa.array([blob(rarity[a:b]) for a, b in zip(at, at[1:])], pa.binary())}, schema=COUNTED)

    return chunks.mapInArrow(send, "bucket int, chunk long, tok binary, count binary").groupBy("bucket").applyInArrow(count, "chunk long, bucket int, rarity binary")


SETS = pa.schema([("cid", pa.int64()), ("tok", pa.binary()), ("flag", pa.binary())])
PREFIX = pa.schema([("ord", pa.int32()), ("tok", pa.int64()), ("cid", pa.int64())])
ORDERS = 2  # orders by rarity: bits 0 and 1 of a token's flag; bit 2: the hash order


def prefixed(chunks: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """cid, tok, flag: every surviving class with its tokens, each with the orders under which it is in the prefix.

    Under the orders by rarity only tokens that another surviving class has, too, are flagged.
    """
    back = counted.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "rarity"))).alias("back"))  # one small row a bucket

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                tok = unblob(batch.column("tok")[r], U)
                rarity = np.concatenate([unblob(x["rarity"], np.uint8) for x in batch.column("back")[r].as_py()])
                rarity = rarity[np.unique(tok, return_inverse=True)[1]].astype(U)
                size, cid = unblob(batch.column("size")[r], np.int64), unblob(batch.column("cid")[r], np.int64)
                owner = np.repeat(np.arange(len(size)), size)
                at, keep = np.concatenate([[0], np.cumsum(size)]), size - need(size, percent) + 1
                nth = np.arange(len(tok)) - at[owner]
                flag = (nth < keep[owner]).astype(np.uint8) << ORDERS  # a set's tokens are in hash order
                for o in range(ORDERS):
                    order = np.lexsort((mix64(tok + U(o)) if o else tok, rarity, owner))
                    mine = order[nth < keep[owner]]
                    flag[mine[rarity[mine] > 0]] |= 1 << o
                yield from in_batches({"cid": cid.tolist(), "tok": [blob(tok[a:b]) for a, b in zip(at, at[1:])], "flag": [blob(flag[a:b]) for a, b in zip(at, at[1:])]}, SETS, 512)

    return chunks.join(back, "chunk").mapInArrow(run, "cid long, tok binary, flag binary")


def postings(sets: DataFrame) -> DataFrame:
    """ord, tok, cid: flagged tokens under the orders by rarity."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                toks, flags = ([unblob(x, t) for x in part.column(c)] for c, t in (("tok", np.int64), ("flag", np.uint8)))
                cid = np.repeat(part.column("cid").to_numpy(), [len(t) for t in toks])
                tok, flag = np.concatenate(toks), np.concatenate(flags)
                for o in range(ORDERS):
                    mine = np.flatnonzero(flag >> o & 1)
                    yield rows(PREFIX, ord=np.full(len(mine), o, np.int32), tok=tok[mine], cid=cid[mine])

    return sets.mapInArrow(run, "ord int, tok long, cid long")


def clusters(sets: DataFrame) -> DataFrame:
    """cid, cluster: classes connected by candidate pairs, and by frequent prefix tokens."""
    listed = written(postings(sets), "postings")
    hot = written(listed.groupBy("ord", "tok").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("low")).where(F.col("n") > SHORT).drop("n"), "hot")
    few = hot.count() <= 500_000  # checked: 20 bytes a row; a shuffled join beyond it
    often = F.broadcast(hot) if few else hot
    ties = listed.join(often, ["ord", "tok"]).select(F.col("cid").alias("a"), F.col("low").alias("b")).distinct()
    each = listed.join(often, ["ord", "tok"], "left_anti").groupBy("ord", "tok").agg(F.sort_array(F.collect_set("cid")).alias("c")).where("size(c) > 1")  # at most SHORT
    pair = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = each.select("ord", F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.bit_or(F.expr("shiftleft(1, ord)")).alias("under"))
    # a pair under one order alone shares no prefix token under the other, unless a frequent one, which ties it
    edges = pairs.where(F.col("under") == (1 << ORDERS) - 1).select("a", "b").unionByName(ties)
    out = components(edges).select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
    dropped(listed, hot)
    return out


LINKS = pa.schema([("cid", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def products(n: int, row: np.ndarray, col: np.ndarray, masks: list[np.ndarray], step: int = 4096) -> list[np.ndarray]:
    """For each mask, how many of its tokens each two of n sets have in common. row, col: sorted by col."""
    out = [np.zeros((n, n), np.float32) for _ in masks]  # exact: counts below 2**24
    cut = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else 0) + step + 1, step))
    for i, (a, b) in enumerate(zip(cut, cut[1:])):
        if a == b:
            continue
        for both, mask in zip(out, masks):
            m = np.zeros((n, min(step, int(col[b - 1]) - i * step + 1)), np.float32)
            m[row[a:b], col[a:b] - i * step] = mask[a:b]
            both += m @ m.T
    return out


def compare(cid: np.ndarray, copies: np.ndarray, toks: list[np.ndarray], flags: list[np.ndarray], half: np.ndarray, percent: int):
    """Exact links among the sets, or between halves 0 and 1: (root, links) of each."""
    n, size = len(cid), np.array([len(t) for t in toks])
    flag = np.concatenate(flags)
    _, col = np.unique(np.concatenate(toks), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    often = np.bincount(col) > 1
    new = np.cumsum(often) - 1
    keep = often[col]
    row, col, flag = row[keep], new[col[keep]], flag[keep]
    order = np.argsort(col, kind="stable")
    row, col, flag = row[order], col[order], flag[order]
    # candidates: pairs that share a prefix token under every order
    some = np.flatnonzero(flag)
    found = products(n, row[some], np.unique(col[some], return_inverse=True)[1], [flag[some] >> o & 1 for o in range(ORDERS + 1)])
    asked = np.logical_and.reduce([x > 0 for x in found]) & (cid[:, None] != cid[None, :])
    if half.any():
        asked &= half[:, None] != half[None, :]
    left = asked.any(1)
    if not left.any():
        return cid, np.zeros(n, np.int64)
    mine = left[row]
    both = products(n, row[mine], np.unique(col[mine], return_inverse=True)[1], [np.ones(mine.sum(), np.float32)])[0].astype(np.int64)
    linked = asked & (100 * both >= percent * (size[:, None] + size[None, :] - both))
    root, old = cid.copy(), None
    while old is None or (old != root).any():
        old = root
        root = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1))
    return root, (linked * copies[None, :]).sum(1)


def verified(sets: DataFrame, members_: DataFrame, n_members: int, percent: int) -> DataFrame:
    """cid, root, links over every block pair of every cluster. members_: cid, copies, cluster."""
    sizes = members_.groupBy("cluster").count().where("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK)
    placed = members_.join(sizes, "cluster").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
    # small clusters go many to a task; a large one is compared block pair by block pair
    small = F.col("blocks") == 1
    task = F.when(small, F.struct(F.pmod(F.xxhash64("cluster"), F.lit(1 + n_members // TASK)).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    spread = placed.select("*", other).withColumn("task", F.coalesce(task, F.struct(F.col("cluster").alias("a"), (1 + F.least("block", "other")).alias("b"), (1 + F.greatest("block", "other")).alias("c"))))
    spread = spread.withColumn("half", (~small & (F.col("block") > F.col("other"))).cast("int"))
    joined = sets.join(spread.select("cid", "copies", "cluster", "half", "task"), "cid")

    def verify(group: pa.Table) -> pa.Table:
        trimmed_memory()
        cid, copies, cluster, half = (group.column(c).to_numpy() for c in ("cid", "copies", "cluster", "half"))
        toks, flags = ([unblob(x, t) for x in group.column(c)] for c, t in (("tok", U), ("flag", np.uint8)))
        order, out = np.argsort(cluster, kind="stable"), []
        for at in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            at = at[np.unique(cid[at], return_index=True)[1]]
            root, links = compare(cid[at], copies[at], [toks[i] for i in at], [flags[i] for i in at], half[at], percent)
            out.append((cid[at], root, links))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], schema=LINKS)

    return joined.groupBy("task").applyInArrow(verify, "cid long, root long, links long")


def grouped(docs: DataFrame, words: int, percent: int, longer: float) -> DataFrame:
    """doc_id, key, n, component_id, n_links, stays: a row a document; of a component's rows, those of one doc_id and class stay."""
    buckets = 1 + text_bytes(docs) // 6 // 3 // PER_BUCKET  # a word has about six bytes; about a third of the tokens are in a prefix
    of = written(members(docs, words), "members")
    classes = of.where("key is not null and doc_id is not null").groupBy("key").agg(F.first("short").alias("short"), F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    shared = shared_counts(docs.where("doc_id is not null"), words, percent, longer, buckets)
    least = F.ceil(F.col("n") * percent / 100)  # of a partner's size
    k = 1 + F.floor(F.lit(longer) * (least - F.ceil(least * percent / 100) + 1))
    alive = written(classes.join(shared, "short").where(F.col("shared") >= k).select("cid", "key", "rep", "n", "copies"), "alive")
    chunks = written(set_chunks(docs, alive, words), "sets")
    sets = written(prefixed(chunks, rarities(chunks, buckets), percent), "prefixed")
    dropped(chunks)
    found = clusters(sets)
    links = written(verified(sets, alive.select("cid", "copies").join(found, "cid"), alive.count(), percent), "links")
    found = components(links, "cid", "root").select(F.col("node").alias("cid"), "component")
    low = found.join(classes.select("cid", "rep", "key"), "cid")
    low = with_least(low, "component", F.struct("rep", "key"), "low").select("cid", "low")
    per_class = classes.join(low, "cid", "left").join(links.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    first = F.coalesce("low", F.struct("rep", "key"))
    per_class = written(per_class.select("key", first["rep"].alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), (first["key"] == F.col("key")).alias("first")), "per-class")
    dropped(alive, sets, links, classes)
    some = of.where("key is not null and doc_id is not null").join(per_class, "key")
    some = some.select("doc_id", "key", "n", "component_id", "n_links", (F.col("first") & (F.col("doc_id") == F.col("component_id"))).alias("stays"))
    # a null key: no words
    rest = of.where("key is null or doc_id is null")
    return some.unionByName(rest.select("doc_id", "key", "n", F.col("doc_id").alias("component_id"), F.when(F.col("doc_id").isNotNull(), 0).cast("long").alias("n_links"), F.lit(True).alias("stays")))


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, longer: float = 0.5) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document."""
    return grouped(docs, words, percent, longer).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, longer: float = 0.5) -> DataFrame:
    """docs with one document of each component: of its smallest doc_id (of several texts under it, one).

    Rows are told by doc_id and text, so a row of the same doc_id with another text is judged by
    itself; of rows with one doc_id and one text that have copies, one stays.  Texts without words
    and rows without a doc_id all stay.  Extra columns are kept, whatever their names.
    """
    found = written(grouped(docs, words, percent, longer).where("key is not null and doc_id is not null").select("doc_id", "key", "stays"), "found")
    gone = found.where("not stays")
    repeated = written(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    once = gone.join(repeated, "doc_id", "left_anti").select("doc_id")
    small = lambda ids: F.broadcast(ids) if ids.count() <= 500_000 else ids  # noqa: E731  checked: 24 bytes a row; a shuffled join beyond it
    out = docs.join(small(once), "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return out
    key = free("key", docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())])

    def keyed(batches):
        for batch in batches:
            for part in slices(batch):
                (_, sets), = token_sets([part.select(["doc_id", "text"])], words)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([class_key(s) if len(s) else None for s in sets], pa.binary())], names=[*part.schema.names, key])

    ids = small(repeated)
    twice = out.join(ids, "doc_id", "left_semi").select(docs.columns).mapInArrow(keyed, schema)
    gone = gone.join(ids, "doc_id", "left_semi").select("doc_id", F.col("key").alias(key)).distinct()
    twice = twice.join(gone, ["doc_id", key], "left_anti")
    worded = twice.where(F.col(key).isNotNull()).dropDuplicates(["doc_id", "text"])
    both = worded.unionByName(twice.where(F.col(key).isNull()))
    return out.join(ids, "doc_id", "left_anti").select(docs.columns).unionByName(both.select(docs.columns))
