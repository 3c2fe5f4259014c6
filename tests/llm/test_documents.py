"""Operators on documents against brute force, on invented prose and on rough rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from porelane.llm import jaccard, licenses, lm, media, packing, phrases, pieces, toxicity, trie, words
from porelane.llm.queries import tokenizer_path

from .conftest import ROWS

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def tokens(text, lower=False):
    raw = (text or "").encode()
    return SPLIT.findall(raw.lower() if lower else raw)


# --- words


def test_words_and_hashes_agree_with_a_plain_split():
    texts = [t for _, t in ROWS]
    for lower in (False, True):
        w = words.Words(*words.string_buffers(pa.array(texts, pa.string())), lower)
        data = w.data.tobytes()
        got = [[data[w.start[k] : w.end[k]] for k in range(w.bounds[i], w.bounds[i + 1])] for i in range(len(texts))]
        assert got == [tokens(t, lower) for t in texts]
        h = w.hashes()
        by = {}
        for k in range(len(h)):
            by.setdefault(data[w.start[k] : w.end[k]], set()).add(int(h[k]))
        assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)


def thue_morse(n, a="a", b="b"):
    """n letters (a power of two) on which every polynomial modulo 2**64 agrees with their complement's."""
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join(b if x else a for x in out)


#: pairs of different words that a polynomial modulo 2**64 can't tell apart
ALIKE = [(thue_morse(1 << k), thue_morse(1 << k, "b", "a")) for k in range(5, 14)]


def test_hashes_tell_structured_values_apart():
    flat = [w for pair in ALIKE for w in pair] + ["a", "a\0", "\0", "\0\0", "a" * 8, "a" * 9, "a" * 256, "a" * 257, "a" * 264]
    w = words.Words(*words.string_buffers(pa.array([" ".join(flat), *flat])), True)
    h = w.hashes()
    assert len(set(h[: len(flat)].tolist())) == len(flat) and (h[: len(flat)] == h[len(flat) :]).all()
    # runs: every window of two words in Thue-Morse order and its complement
    for k in (2, 4, 5, 18, 32, 35, 64):
        texts = [" ".join(thue_morse(128)), " ".join(thue_morse(128, "b", "a"))]
        v = words.Words(*words.string_buffers(pa.array(texts)), False)
        run, at = words.runs(v.hashes(), v.bounds, k)
        by = {}
        for i, t in enumerate(texts):
            for j in range(129 - k):
                by.setdefault(tuple(t.split()[j : j + k]), set()).add(int(run[at[i] + j]))
        assert all(len(x) == 1 for x in by.values()) and len({x for y in by.values() for x in y}) == len(by)


def test_hashes_do_not_depend_on_the_block(monkeypatch):
    column = words.string_buffers(pa.array([t for _, t in ROWS], pa.string()))
    whole = words.Words(*column, True).hashes()
    monkeypatch.setattr(words, "BLOCK", 10)
    assert (words.Words(*column, True).hashes() == whole).all()


# --- 1 toxicity


def test_toxicity_learns_and_scores_everything(spark):
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeioustrn"), 4)) for _ in range(300)]
    rows, marks = [], []
    for i in range(900):
        text = list(rng.choice(plain, int(rng.integers(20, 120))))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text[int(rng.integers(0, len(text)))] = ["vile", "nasty"][i % 2]
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, clean=400, toxic=150).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 900 and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_toxicity_gradient():
    shape = toxicity.Shape(words=50, word_dim=3, char_rows=32, char_dim=2, hidden=3, attention=2, window=6, stride=3)
    texts = ["bad cat sat on the mat", "the cat sat", "x"]
    text = toxicity.Text(*words.string_buffers(pa.array(texts)), shape)
    net = toxicity.Network(shape, np.sort(text.hash)[:4], 0.5)
    net.start(np.zeros(4, np.float32), np.zeros(32, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    start, size, doc = text.windows(shape)
    label = np.array([1.0, 0.0, 1.0])[doc]
    grad, _ = net.gradient(text, start, size, label)
    rng = np.random.default_rng(0)
    for name in ("word", "char", "xf", "ub", "bb", "att", "att_v", "out", "out_b"):
        flat = net.p[name].reshape(-1)
        for at in rng.integers(0, flat.size, 4):
            old = flat[at]
            loss = []
            for step in (1e-4, -1e-4):
                flat[at] = old + step
                loss.append(net.gradient(text, start, size, label)[1])
            flat[at] = old
            assert abs((loss[0] - loss[1]) / 2e-4 - grad[name].reshape(-1)[at]) < 2e-3


def test_toxicity_windows_overlap_and_cover():
    shape = toxicity.Shape(window=8, stride=4)
    for n in (0, 1, 7, 8, 9, 12, 13, 100):
        text = toxicity.Text(*words.string_buffers(pa.array([" ".join(["w"] * n)])), shape)
        start, size, _ = text.windows(shape)
        assert {x for a, b in zip(start, size) for x in range(a, a + b)} == set(range(n)) and (size <= 8).all()
        assert all(b - a == 4 for a, b in zip(start, start[1:]))


def text_of(*texts, shape=toxicity.Shape()):
    return toxicity.Text(*words.string_buffers(pa.array(texts)), shape)


def test_toxicity_takes_all_of_a_word():
    net = toxicity.Network(toxicity.Shape(), np.zeros(0, np.uint64), 0.5)
    net.start(np.zeros(0, np.float32), np.zeros(16_384, np.float32))
    # only bytes after the 24th differ
    for a, b in (("a" * 30 + "vile", "a" * 30 + "mild"), ("漢字仮名交" * 4 + "死", "漢字仮名交" * 4 + "生"), ("漢" * 500 + "死", "漢" * 500 + "生"), ("x" * 5000 + "vile" + "x" * 5000, "x" * 10_004)):
        assert not np.array_equal(net.window_logits(text_of(a))[0], net.window_logits(text_of(b))[0]), a[-5:]
    # words apart by white space and punctuation outside ASCII
    want = text_of("two vile words")
    for mark in "\u00a0\u0085\u1680\u2003\u200b\u2028\u202f\u205f\u3000、。—“…":
        got = text_of(mark.join(["two", "vile", "words"]) + mark)
        assert (got.hash[got.index] == want.hash[want.index]).all(), mark
    assert len(text_of("naïve Ünï漢字é").index) == 2


def test_toxicity_pieces_of_a_run_hold_all_trigrams():
    rng = np.random.default_rng(4)
    shape = toxicity.Shape()
    for n in (16, 17, 40, 300):
        run = "".join(rng.choice(list("abcdé漢字仮😀"), n))
        text = text_of("before " + run, run + " after", shape=shape)
        raw = run.encode()
        key = np.array([raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)], np.uint64)
        assert set((words.mix64(key) % np.uint64(shape.char_rows)).tolist()) <= set(text.tri.tolist())
        k = text.bounds[1]
        assert (text.index[1:k] == text.index[k:-1]).all() and (text.tri_n <= toxicity.RUN).all()


@pytest.mark.parametrize("marks", [[], [(1, 0)], [(1, None), (None, 1)], [(i, i % 2) for i in range(1, 19)] + [(1, 1)]])
def test_toxicity_on_rough_rows(spark, rough, none, marks):
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.toxicity(rough, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(none, labels).count() == 0


# --- 2 media


def check_media(got, rows):
    want = []
    for doc, text in rows:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (64 if not data else 0))
        want.append((doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44))
    assert rows_of(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes") == sorted(want, key=str)


def test_media(prose, rough, none):
    check_media(media.media(prose[0]), prose[1])
    got = media.media(rough)
    check_media(got, ROWS)
    by_text = {}
    texts = dict(ROWS)
    for r in got.collect():
        if r["doc_id"] is not None:
            by_text.setdefault(texts[r["doc_id"]] or "", set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.media(none).count() == 0


def test_media_come_from_the_stored_tables(spark):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdefghij \n"), 60_000))
    rows = [("a", base), ("b", base), ("c", base[:30_000] + "x" + base[30_000:]), ("d", "")]
    df = spark.createDataFrame(rows, "name string, text string").selectExpr("encode(name, 'UTF-8') AS key", "text")
    tables = {t.name for t in spark.catalog.listTables()}
    listed, store, words = media.stored(df)
    assert {t.name for t in spark.catalog.listTables()} == tables
    digests = [r["digest"] for r in store.select("digest").collect()]
    lists = listed.collect()
    assert len(digests) == len(set(digests)) and {r["digest"] for r in lists} == set(digests) and len(digests) < len(lists)
    # a chunk that has changed in the store is noticed
    bad = store.withColumn("packed", F.lit(bytearray(zstandard.compress(b"other"))))
    with pytest.raises(Exception, match="differs from its digest"):
        media.reread(media.assembled(listed, bad, 20_000), None).collect()


def test_a_hot_chunk_is_joined_with_a_salt(spark):
    head = " ".join(f"word{i}" for i in range(3000))
    rows = [(i, f"{head} {i}") for i in range(30)] + [(100 + i, "short") for i in range(20)] + [(200, None)]
    got = media.media(spark.createDataFrame(rows, "doc_id long, text string"), hot=4)
    check_media(got, rows)
    assert max(r["n_chunks"] for r in got.collect()) > 1


def test_gear_hash_is_the_rolling_one():
    data = np.random.default_rng(0).integers(0, 256, 1000).astype(np.uint8)
    h, want = 0, []
    for b in data:
        h = (2 * h + int(media._GEAR[b])) % 2**64
        want.append(h)
    assert media.gear(data).tolist()[64:] == want[64:]


def test_chunk_cuts_follow_content():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 200_000).astype(np.uint8).tobytes()
    a, b = media.cuts(data), media.cuts(b"inserted bytes" + data)
    pieces_of = lambda d, at: {d[x:y] for x, y in zip([0, *at], at)}
    shared = pieces_of(data, a) & pieces_of(b"inserted bytes" + data, b)
    assert a[-1] == len(data) and len(shared) >= 0.9 * len(a)
    assert all(2048 <= y - x <= 32768 for x, y in zip([0, *a], a[:-1])) and media.cuts(b"") == []


def test_wav_round_trip():
    assert media.from_wav(media.to_wav(b"\x00\x80\xff" * 64)) == b"\x00\x80\xff" * 64
    with pytest.raises(Exception):
        media.from_wav(b"RIFF" + bytes(60))


# --- 3 jaccard


def brute_jaccard(rows):
    """doc row -> (n, component, links) by all pairs; rows with a null id stand alone."""
    sets = []
    for _, text in rows:
        w = tokens(text, True)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low[find(i)] if d is not None else None, links[i] if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def test_jaccard_join(prose, rough, none):
    columns = "doc_id", "n_shingles", "component_id", "n_links"
    assert rows_of(jaccard.jaccard_join(prose[0]), *columns) == brute_jaccard(prose[1])
    assert rows_of(jaccard.jaccard_join(rough), *columns) == brute_jaccard(ROWS)
    assert jaccard.jaccard_join(none).count() == 0


def test_jaccard_threshold_is_exact(spark):
    """Similarity of exactly 0.8 links, a shingle less does not; blocks smaller than the cluster."""
    base = [f"w{i}" for i in range(94)]  # 90 shingles
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        rows.append((i, " ".join([*base[: 94 - i], *(f"x{i}_{k}" for k in range(i))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.jaccard_join(df), "doc_id", "n_shingles", "component_id", "n_links") == brute_jaccard(rows)


def test_jaccard_blocks_of_a_large_cluster(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 5))):
            w[at] = f"n{i}_{at}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.jaccard_join(df), "doc_id", "n_shingles", "component_id", "n_links") == brute_jaccard(rows)


def test_jaccard_tells_alike_words_apart(spark):
    rows = [(i, t) for i, t in enumerate(x for pair in ALIKE for x in (*pair, f"a b c d {pair[0]} e f g h", f"a b c d {pair[1]} e f g h"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.jaccard_join(df), "doc_id", "n_shingles", "component_id", "n_links") == brute_jaccard(rows)


@pytest.mark.parametrize("short", [1, 3])
def test_jaccard_frequent_prefix_tokens_lose_nothing(prose, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    assert rows_of(jaccard.jaccard_join(prose[0]), "doc_id", "n_shingles", "component_id", "n_links") == brute_jaccard(prose[1])


def test_candidates_share_a_prefix_token_under_every_order():
    toks = [np.arange(10, dtype=np.uint64)] * 3
    flags = [np.full(10, f, np.uint8) for f in (7, 7, 3)]
    cid, ones, half = np.arange(3), np.ones(3, np.int64), np.zeros(3, np.int64)
    root, links = jaccard.compare(cid, ones, toks, flags, half, 80)
    assert root.tolist() == [0, 0, 2] and links.tolist() == [1, 1, 0]


def test_one_of_each_group_stays(rough):
    got = jaccard.one_of_each(rough)
    kept = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert got.columns == rough.columns
    assert sorted(map(str, kept)) == sorted(map(str, [1, 5, 6, 7, 8, 10, 11, 13, None, None, 15, 16, 17, 18]))


def test_rows_of_one_doc_id_are_judged_by_their_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    near = a + " more"
    cases = [
        ([(1, a), (5, a), (5, b)], [(1, a), (5, b)]),
        ([(5, a), (5, a), (5, b), (7, b)], [(5, a), (5, b)]),
        ([(2, b), (5, a), (5, b), (5, c), (5, None), (5, "")], [(2, b), (5, a), (5, c), (5, None), (5, "")]),
        ([(3, a), (3, near), (4, near)], 1),
    ]
    for rows, want in cases:
        df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key int")
        got = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(df).collect()]
        assert len(got) == want if isinstance(want, int) else sorted(got, key=str) == sorted(want, key=str)


# --- 5 substrings


def brute_substrings(rows, window=35):
    split = [tokens(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(prose, rough, none):
    columns = "doc_id", "n_words", "n_removed", "kept_sha256"
    assert rows_of(phrases.digest(phrases.substring_dedup(prose[0])), *columns) == brute_substrings(prose[1])
    got = phrases.substring_dedup(rough)
    assert rows_of(phrases.digest(got), *columns) == brute_substrings(ROWS)
    assert set(rough.columns) | {"n_removed"} == set(got.columns)
    assert phrases.substring_dedup(none).count() == 0


def test_words_that_look_alike_to_a_polynomial_stay_apart(spark):
    a, b = ALIKE[-3]
    head = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join([*head, a, *head[::-1]])), (1, " ".join([*head[5:], b, *head[::-1][:30]])), (2, " ".join([a] * 40)), (3, " ".join([b] * 40)), (4, " ".join([a, b] * 20)), (5, " ".join([b, a] * 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(phrases.digest(phrases.substring_dedup(df)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


def test_values_of_two_hashes_are_grouped_exactly():
    rng = np.random.default_rng(0)
    for top in (1 << 60, 5):
        v = rng.integers(0, top, (200, 2)).astype(np.uint64)
        v = np.concatenate([v, v[:50]])
        first, inverse, n = phrases.grouped(v)
        assert (v[first][inverse] == v).all() and len({tuple(x) for x in v.tolist()}) == len(first) and n.sum() == len(v)
        assert sorted(map(tuple, v[first].tolist())) == list(map(tuple, v[first].tolist()))


def test_automata_locate_overlapping_occurrences(spark):
    a = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(a[:60])), (1, " ".join(a[20:90])), (2, " ".join(a[50:])), (3, " ".join(["r"] * 90)), (4, " ".join(["r"] * 34)), (5, " ".join(["r"] * 35))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(phrases.digest(phrases.substring_dedup(df)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


# --- 6 pieces


def test_pieces_without_dropout_are_the_librarys(prose, rough):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = pieces.Encoder(path, 0.0, 7, 4)
    texts = [t for _, t in prose[1][:60]] + [t or "" for _, t in ROWS if "▁" not in (t or "")]
    assert encoder.encode_all(list(range(len(texts))), texts) == [model.encode(t) for t in texts]


def test_merge_dropout_varies_and_decodes(rough, none, prose, monkeypatch):
    path = tokenizer_path("piece_bpe_32k.model")
    texts = [t or "" for _, t in ROWS] + ["a  b", " a", "a ", "▁", "▁▁ a▁b ▁", "", "\n\n"]
    ids = {seed: pieces.Encoder(path, 0.2, seed, 4).encode_all(list(range(len(texts))), texts) for seed in (1, 2)}
    decode = pieces.vocabulary(path).decode
    assert [decode(x) for x in ids[1]] == texts == [decode(x) for x in ids[2]] and ids[1] != ids[2]
    word = pieces.Encoder(path, 0.3, 1, 4).encode(5, "internationalisation " * 40)
    assert decode(word) == "internationalisation " * 40 and len(set(re.findall(r"\d+", str(word)))) > len(set(pieces.Encoder(path, 0, 1, 1).encode(5, "internationalisation ")))
    # neither batches nor the size of the cache change a segmentation
    monkeypatch.setattr(pieces, "CACHE", 5)
    small = pieces.Encoder(path, 0.2, 1, 4)
    assert [small.encode(i, t) for i, t in enumerate(texts)] == ids[1]
    got = pieces.round_trip(rough, path).collect()
    assert len(got) == len(ROWS) and all(r["lossless"] for r in got)
    both = pieces.decoded(pieces.encoded(prose[0], path), path)
    assert rows_of(both, "doc_id", "text") == sorted(prose[1], key=str)
    assert pieces.round_trip(none, path).count() == 0


def test_arrays_and_lists_encode_alike(prose, monkeypatch):
    path = tokenizer_path("piece_bpe_32k.model")
    texts = [t for _, t in prose[1]] + [t for _, t in ROWS] + ["a  b", " a", "a ", "a\nb c", "\n", "x\n", "a \nb", "▁", "\tx y"]
    ids = list(range(len(texts)))
    want = pieces.Encoder(path, 0.2, 3, 4).encode_all(ids, [t or "" for t in texts])
    for store in (pieces.STORE, 10):
        monkeypatch.setattr(pieces, "STORE", store)
        encoder = pieces.Encoder(path, 0.2, 3, 4)
        got = [x for a in range(0, len(texts), 50) for x in encoder.encode_column(ids[a : a + 50], pa.array(texts[a : a + 50], pa.string()))]
        assert [x.tolist() for x in got] == want


def test_long_and_structured_words_are_encoded_whole(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdest"), 300_000)), *(" ".join(pair) for pair in ALIKE), *(w for pair in ALIKE for w in pair)]
    got = [x.tolist() for x in pieces.Encoder(path, 0.0, 7).encode_column(list(range(len(texts))), pa.array(texts))]
    assert got == [model.encode(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts[1:])), "doc_id long, text string")
    assert all(r["lossless"] for r in pieces.round_trip(df, path).collect())
    # places beyond 20 bits
    long = "".join(rng.choice(list("abcdest"), 1_100_000))
    assert pieces.vocabulary(path).unit("▁" + long, 1, 0) == model.encode(long)


def test_lockstep_equals_the_agenda_of_one_unit():
    path = tokenizer_path("piece_bpe_32k.model")
    p = pieces.vocabulary(path)
    units = ["▁hello", "▁▁▁x", "▁naïve", "漢字", "a", "▁" * 9, "▁" + "ab" * 60, "▁internationalisation"]
    for threshold in (0, 1 << 30, 1 << 31):
        assert p.many(units, [77] * len(units), threshold) == [p.unit(u, 77, threshold) for u in units]


def test_every_occurrence_draws_on_its_own():
    path = tokenizer_path("piece_bpe_32k.model")
    p, word = pieces.vocabulary(path), "internationalisation"
    texts = [" ".join([word] * 50)] * 40
    encoder = pieces.Encoder(path, 0.1, 7)
    got = [x.tolist() for x in encoder.encode_column(list(range(40)), pa.array(texts))]
    # each occurrence is the agenda of its unit under its own key
    keys = encoder.draws(list(range(40)), np.full(40, 50)).tolist()
    alone = [p.unit("▁" + word, k, encoder.threshold) for k in keys]
    assert got == [[i for x in alone[50 * d : 50 * d + 50] for i in x] for d in range(40)] == encoder.encode_all(list(range(40)), texts)
    runs = []
    p.many(["▁" + word], [0], 0, runs)
    entry = np.array(runs[0], np.uint64)
    entry = entry >> np.uint64(6) << np.uint64(20) | entry & np.uint64(63)
    kept = ~pieces.skipped(np.array(keys, np.uint64)[:, None], entry[None, :], encoder.threshold)
    assert len(set(map(tuple, alone))) > 20 and abs(kept.all(1).mean() - 0.9 ** len(entry)) < 0.04
    assert all(x == p.unit("▁" + word, 0, 0) for x, k in zip(alone, kept.all(1)) if k)
    # one merge: skipped in a tenth of all occurrences, and not in none or a quarter of them
    short = next(u for u in sorted(p.id) if len(u) == 2 and u[0] == "▁" and u[1].isascii() and u[1].isalpha())
    ids = encoder.encode(3, " ".join([short[1]] * 4000))
    assert abs(sum(i != p.id[short] for i in ids) / 2 / 4000 - 0.1) < 0.02


# --- 8 licenses


def test_license_scan_equals_brute_force(spark, rough, none, prose):
    import duckdb

    lines = [t for _, t in licenses.TEMPLATES]
    rows = [(i, f"{t} start {lines[i % 4]} and more {t}") for i, t in prose[1][:40]]
    rows += [(100, lines[2].upper()), (101, lines[2].replace("General ", "")), (102, None), (103, ""), (104, lines[0].replace("Apache", "other")), (105, "licensed"), (106, " ".join(lines * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(licenses.oracle())
    names = [c[0] for c in want.description]
    got = rows_of(licenses.license_scan(df), *names)
    assert got == sorted(want.fetchall(), key=str) and len(got) >= 40
    assert licenses.license_scan(rough).count() == 0 and licenses.license_scan(none).count() == 0
    assert licenses.license_scan(df, []).count() == 0


def test_anchor_words_lose_nothing():
    """Without any anchor word too few of a template's shingles can be left."""
    for _, text in [*licenses.TEMPLATES, ("x", " ".join(f"t{i}" for i in range(40)))]:
        w = licenses.plain_words(text)
        s = licenses.shape(w, 5, 80, 0.999)
        chosen = licenses.anchors(w, 5, s["least"])
        left = {tuple(w[i : i + s["k"]]) for i in range(len(w) - s["k"] + 1)}
        assert len([x for x in left if not chosen & set(x)]) < s["least"]


# --- 9 packing


def check_packing(got, rows, capacity=1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = [r.asDict() for r in got.collect()]
    want = Counter()
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        want.update((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(bounds, bounds[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in got) // capacity)


def test_packing(prose, rough, none):
    path = tokenizer_path("byte_bpe_50k.json")
    check_packing(packing.pack(prose[0], path, per_salt=2), prose[1])
    n, least = check_packing(packing.pack(prose[0], path), prose[1])
    assert n <= least + 1
    check_packing(packing.pack(rough, path), ROWS)
    assert packing.pack(none, path).count() == 0


def test_ids_are_those_of_tokenizers(prose):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    slow, fast = Tokenizer.from_file(path), packing.encoder(path)
    for text in [t or "" for _, t in ROWS] + [t for _, t in prose[1][:50]] + ["it's  we'll\n\n x", "<|endoftext|>a<|endoftext|>", "１２３ ½ İ ß"]:
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000 + "x", "x" * 300_000, "a" + "\u3000" * 200_000 + "b", "!" * 300_000, "\u0301" * 100_000, ("word " * 900 + " " * 5000 + "\t\n" * 3000) * 20])
def test_ids_of_long_runs_are_those_of_tokenizers(text):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_runs_are_measured_inside_a_text():
    n = packing.RUN
    texts = ["", None, " " * n, " " * (n + 1), "x" * n, "x" * (n + 1), "x" * n, " " * n, "a " * n, "a" + " " * (n + 1), " " * (n + 1) + "a", "", "\u3000" * n]
    assert packing.without_long_runs(pa.array(texts)).tolist() == [True, True, True, False, True, False, True, True, True, False, False, True, False]


def test_local_search_empties_bins():
    bins = packing.Bins(10)
    for contents in ((6, 3), (6, 3), (5, 4), (1, 1, 1)):
        bins.add(contents, 1)
    assert packing.local_search(bins).total() == 3
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = Counter(int(x) for x in rng.integers(20, 70, 200))
        before = packing.best_fit(lengths, 100)
        n, squares = before.total(), sum(sum(c) ** 2 * k for c, k in before.count.items())
        after = packing.local_search(before)
        assert after.total() <= n and sum(sum(c) ** 2 * k for c, k in after.count.items()) >= squares
        held = Counter()
        for contents, k in after.count.items():
            assert sum(contents) <= 100
            for x in contents:
                held[x] += k
        assert held == lengths


def exchange_left(source, target, capacity):
    """Whether one or two documents of source can go for none, one or two (one) of target's, with more squared fill."""
    f, t = sum(source), sum(target)
    ones = lambda x: set(x)
    twos = lambda x: {a + b for a, b in itertools.combinations(x, 2)}
    shifts = {a - b for a in ones(source) for b in {0} | ones(target) | twos(target)} | {a - b for a in twos(source) for b in {0} | ones(target)}
    return any(0 < s <= capacity - t and s > f - t for s in shifts)


@pytest.mark.parametrize("n, low, high", [(3000, 180, 700), (300, 5, 600), (400, 300, 500), (60, 400, 900)])
def test_local_search_ends_where_no_exchange_is_left(n, low, high):
    rng = np.random.default_rng(n)
    lengths = Counter(int(x) for x in rng.integers(low, high + 1, n))
    least = -(-sum(k * v for k, v in lengths.items()) // 1024)
    after = packing.local_search(packing.best_fit(lengths, 1024))
    held = Counter()
    for contents, k in after.count.items():
        assert k > 0 and sum(contents) <= 1024
        for x in contents:
            held[x] += k
    assert held == lengths
    open_ = [c for c in after.count if sum(c) < 1024]
    assert after.total() == least or not any(exchange_left(a, b, 1024) for a in open_ for b in open_ if a != b or after.count[a] > 1)


def test_local_search_isnt_cut_on_many_classes():
    rng = np.random.default_rng(0)
    lengths = Counter(int(x) for x in rng.integers(180, 701, 200_000))
    least = -(-sum(k * v for k, v in lengths.items()) // 1024)
    assert packing.local_search(packing.best_fit(lengths, 1024)).total() <= 1.001 * least


# --- 10 language model


def brute_lm(rows, prior=lm.PRIOR):
    toks = [[*tokens(t, True), None] for _, t in rows]
    train = [i for i, (d, _) in enumerate(rows) if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    count = Counter()
    for i in train:
        for k in range(len(prior) + 1):
            padded = ["start"] * k + toks[i]
            count.update(tuple(padded[j : j + k + 1]) for j in range(len(toks[i])))
            count[("start",) * (k + 1)] += 1
    n, v = sum(len(toks[i]) for i in train), len({w for i in train for w in toks[i]})
    out = []
    for (d, _), t in zip(rows, toks):
        base = score = 0.0
        for j, w in enumerate(t):
            p = (count[(w,)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k, m in enumerate(prior, 1):
                h = tuple((["start"] * k + t)[j : j + k])
                if count[h]:
                    p = (count[(*h, w)] + m * p) / (count[h] + m)
            score += math.log10(p)
        out.append((d, len(t), sum(count[(w,)] > 0 for w in t), n, base, score))
    return out


def check_lm(got, rows, prior=lm.PRIOR):
    want = sorted(brute_lm(rows, prior), key=lambda r: str(r[:2]))
    got = sorted((tuple(r) for r in got.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=lambda r: str(r[:2]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], rtol=1e-9)
    # codes of one byte: half a step a token, 0.02 at a probability of 0.001 and 0.05 at 10**-10
    assert all(abs(a[5] - b[5]) <= 0.05 * a[1] for a, b in zip(got, want))
    assert abs(np.mean([(a[5] - b[5]) / a[1] for a, b in zip(got, want)])) < 0.01


def test_lm_scores(prose, rough, none):
    got = lm.lm_scores(prose[0], max_bytes=20_000)
    check_lm(got, prose[1])
    held = got.where("held_out").collect()
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    three = lm.lm_scores(prose[0], prior=(100.0, 4.0), max_bytes=20_000)
    check_lm(three, prose[1], (100.0, 4.0))
    assert sum(r["score"] for r in three.where("held_out").collect()) > sum(r["score"] for r in held)
    check_lm(lm.lm_scores(rough, prior=(100.0, 4.0)), ROWS, (100.0, 4.0))
    check_lm(lm.lm_scores(rough, prior=()), ROWS, ())
    assert lm.lm_scores(none).count() == 0


def test_lm_tells_alike_words_apart(spark):
    rows = [(i, " ".join([*pair, "and", pair[i % 2]])) for i, pair in enumerate(ALIKE)] + [(i, f"{ALIKE[-1][i % 2]} x") for i in range(20, 30)]
    check_lm(lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_elias_fano_access_and_successor():
    rng = np.random.default_rng(0)
    for top in (1, 50, 10_000, 1 << 45):
        x = np.sort(rng.integers(0, top, 5000)).astype(np.uint64)
        ef = trie.EliasFano(**trie.EliasFano.parts(x))
        assert (ef.access(np.arange(5000)) == x).all()
        q = np.concatenate([x, rng.integers(0, top + 5, 300).astype(np.uint64), np.array([1 << 60], np.uint64)])
        at, hit = ef.successor(q)
        assert (at == np.searchsorted(x, q)).all() and (hit == np.isin(q, x)).all()
    empty = trie.EliasFano(**trie.EliasFano.parts(x[:0]))
    assert empty.successor(q)[0].sum() == 0 and not empty.successor(q)[1].any()


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(1)
    for depth, top in ((2, 400), (3, 40), (3, 1 << 31), (1, 100_000)):
        held = np.unique(rng.integers(1, top, (3000, depth)), axis=0)
        p = rng.random(len(held)) * 0.9 + 0.01
        columns = list(held.astype(np.uint64).T)
        q = np.unique(np.concatenate([rng.integers(0, top + 10, (5000, depth)), held[::3]]), axis=0)
        asked = list(q.astype(np.uint64).T)
        got = trie.with_trie(columns, p, lambda t: (t.lookup(columns), t.lookup(asked)))
        assert np.allclose(np.log10(trie.MEANS[got[0]]), np.log10(p), atol=0.03)
        known = set(map(tuple, held.tolist()))
        assert [(c > 0) for c in got[1].tolist()] == [tuple(x) in known for x in q.tolist()]
        assert trie.with_trie([c[:0] for c in columns], p[:0], lambda t: t.lookup(asked)).sum() == 0


def test_codes_are_finest_for_likely_words():
    p = 10.0 ** -np.linspace(0, 14, 2000)
    step = np.abs(np.log10(trie.MEANS[trie.quantised(p)]) - np.log10(p))
    assert step.max() < 0.06 and step[p > 0.1].max() < 0.02 and trie.quantised(np.array([1.0])) == 255 and trie.MEANS[255] == 1
