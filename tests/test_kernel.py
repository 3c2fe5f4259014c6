"""The numpy kernel against plain dynamic programs and known alignments."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from porelane.operators import kernel as k
from porelane.plans.groups import kit_groups

dna = st.text("ACGTN", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTNRY", min_size=1, max_size=80), st.lists(dna, min_size=1, max_size=4), st.sampled_from([0.4, 0.5, 1.0]))
def test_bit_vectors_equal_the_plain_program(pattern, texts, alpha):
    p, left = k.encode(pattern), k.border(len(pattern), alpha)
    codes = [k.encode(t) for t in texts]
    text = np.zeros((max(map(len, codes)), len(codes)), np.uint8)
    for i, c in enumerate(codes):
        text[: len(c), i] = c
    cost, _ = k.last_row(k.bit_tables(p[None]), len(p), text, left)
    for i, c in enumerate(codes):
        assert cost[: len(c) + 1, i, 0].tolist() == k.last_row_dp(p, c, left).tolist()


def sub_alignment(pattern, text, cutoff, lo, hi):
    g = k.Group("Ftag", pattern, "", "", (lo, hi), (0, len(pattern)), ["x"], [pattern], cutoff).prepared()
    x = k.encode(text)[:, None]
    read, end, cost, row, left = k.search_flank(g, x, np.array([len(text)]), 1.0)
    zero = np.zeros_like(end)
    path = k.trace(np.repeat(g.tables["flank"][0], len(end), 0), k.gathered(x, read, zero, end), end, np.repeat(left[None], len(end), 0), row)
    i, j, op = (a[: path.steps[0], 0] for a in (path.i, path.j, path.op))
    inside = np.flatnonzero((i >= lo) & (i < hi))
    return int((op[inside[0] : inside[-1] + 1] != k.MATCH).sum()), int(j[inside[0]]), int(j[inside[-1]] + 1)


@pytest.mark.parametrize(
    "text, cutoff, cost, where",
    [
        ("GGGGAAAAACCCAAAAGGGGG", 0, 0, None),
        ("GGGGAAAAACGCAAAA", 1, 1, None),
        ("ACGCAAAAGGGGGGGGGGGG", 5, 1, (1, 4)),
        ("GAAAAACGC", 5, 1, (6, 9)),
        ("GCAAAAGGGGGGGGGGGG", 8, 2, (0, 2)),
    ],
)
def test_cost_and_place_of_a_sub_alignment(text, cutoff, cost, where):
    got = sub_alignment("AAAAACCCAAAA", text, cutoff, 5, 8)
    assert got[0] == cost and (where is None or got[1:] == where)


def test_hits_are_local_minima_and_the_rightmost_of_a_plateau():
    cost = np.array([[9], [5], [3], [3], [4], [2], [6], [1], [1]], np.int16)
    assert k.local_minima(cost, np.array([8]), 3)[1].tolist() == [3, 5, 8]
    assert k.local_minima(cost, np.array([3]), 9)[1].tolist() == [3]


def test_scores_of_matches_only():
    assert round(k.perfect_score(44), 6) == 20.0 and round(k.perfect_score(41), 6) == 18.5
    op = np.zeros((44, 1), np.int16)
    op[10] = k.SUB
    assert 0.5 * 20 < k.subsequence_scores(op, np.array([44]))[0] < 20


def test_overhang_costs_a_fraction():
    assert k.border(5, 0.4).tolist() == [0, 0, 0, 1, 1, 2]


@pytest.mark.parametrize("pos, want", [(-3, 1), (0, 1), (1, 1), (50, 50), (51, -49), (99, -1), (100, -1)])
def test_distance_to_the_nearer_end(pos, want):
    assert k.rel_dist(pos, 100) == want


def test_exact_read_on_both_strands_and_case():
    group = kit_groups("SQK-RBK110-96")[0]
    body = "ACGTTGCA" * 30
    query = group.prefix + group.seqs[4][10:34] + group.suffix
    back = k.COMPLEMENT[k.encode(query + body)[::-1]]
    reverse = "".join("=AC=G===T"[c] for c in back)
    got = k.annotate_reads([(query + body).encode(), reverse.encode(), (query + body).lower().encode(), b"", body.encode()], [group], 0.4, 0.2, 0.1)
    assert [(m[0]["label"], m[0]["strand"], m[0]["flank_cost"], m[0]["read_start_flank"], m[0]["read_end_flank"]) for m in got[:3]] == [("BC05", "Fwd", 0, 0, 90), ("BC05", "Rc", 0, 240, 330), ("BC05", "Fwd", 0, 0, 90)]
    assert got[3] == got[4] == []


def test_barcode_coordinates_leave_out_the_last_base():
    """The barcode's region ends inclusive but is read as exclusive: 23 of 24 bases."""
    group = kit_groups("SQK-RBK110-96")[0]
    query = group.prefix + group.seqs[4][10:34] + group.suffix
    m = k.annotate_reads([(query + "ACGT" * 50).encode()], [group], 0.4, 0.2, 0.1)[0][0]
    assert (m["read_start_bar"], m["read_end_bar"], m["barcode_cost"]) == (16, 39, 0)
    # the window starts ten bases before the barcode, and pattern offsets are added to that
    assert (m["bar_start"], m["bar_end"]) == (16, 39)


def test_an_unclear_barcode_leaves_the_flank():
    group = kit_groups("SQK-RBK110-96")[0]
    blurred = "".join(a if i % 2 else b for i, (a, b) in enumerate(zip(group.seqs[0][10:34], group.seqs[1][10:34])))
    read = group.prefix + blurred + group.suffix + "ACGT" * 50
    m = k.annotate_reads([read.encode()], [group], 0.4, 0.2, 0.9)[0][0]
    assert (m["match_type"], m["label"], m["barcode_cost"], m["bar_start"], m["read_start_bar"]) == ("Fflank", "flank", 44, 0, m["read_start_flank"])


def test_pruning_by_the_score_bound_never_changes_a_result(monkeypatch):
    rng = np.random.default_rng(3)
    group = kit_groups("SQK-RBK110-96")[0]
    reads = []
    for i in range(40):
        q = list(group.prefix + group.seqs[i][10:34] + group.suffix + "".join(rng.choice(list("ACGT"), 200)))
        for at in rng.integers(0, 80, 8):
            q[at] = "ACGT"[rng.integers(4)]
        reads.append("".join(q).encode())
    pruned = k.annotate_reads(reads, [group], 0.4, 0.2, 0.1)
    monkeypatch.setattr(k, "perfect_score", lambda n: 20.0)  # the bound admits all candidates; the group keeps its own perfect score
    assert k.annotate_reads(reads, [group], 0.4, 0.2, 0.1) == pruned


@pytest.mark.parametrize("apart", [1, 3, None])
def test_the_bound_holds_with_insertions_and_deletions(monkeypatch, apart):
    """Barcodes some bases apart, reads with bases put in, taken out and changed inside the barcode."""
    from dataclasses import replace

    rng = np.random.default_rng(8)
    group = kit_groups("SQK-RBK110-96")[0]
    if apart:
        near = list(group.seqs[0])
        for at in range(apart):
            near[20 + 4 * at] = "ACGT"["CGTA".index(near[20 + 4 * at])]
        group = replace(group, labels=["A", "B", "C"], seqs=[group.seqs[0], "".join(near), group.seqs[5]], tables={})
    reads = []
    for i in range(120):
        bar = list(group.seqs[i % len(group.seqs)][10:34])
        for _ in range(int(rng.integers(0, 5))):
            at = int(rng.integers(1, len(bar) - 1))
            kind = rng.integers(4)
            bar[at : at + (kind != 0)] = list(rng.choice(list("ACGT"), int(rng.integers(1, 9)))) if kind == 0 else [] if kind == 1 else ["ACGT"[rng.integers(4)]]
        reads.append((group.prefix + "".join(bar) + group.suffix + "".join(rng.choice(list("ACGT"), 150))).encode())
    pruned = k.annotate_reads(reads, [group], 0.4, 0.2, 0.1)
    monkeypatch.setattr(k, "perfect_score", lambda n: 20.0)
    assert k.annotate_reads(reads, [group], 0.4, 0.2, 0.1) == pruned
    assert len({m["label"] for ms in pruned for m in ms}) >= 2


def test_residual_adapters_are_counted():
    group = kit_groups("SQK-RBK110-96")[0]
    whole = group.prefix + group.seqs[4][10:34] + group.suffix
    body = "ACGTTGCA" * 30
    bars = [s[10:34] for s in group.seqs]
    back = "".join("=AC=G===T"[c] for c in k.COMPLEMENT[k.encode(body + whole)[::-1]])
    reads = [body, whole + body, whole + body + whole, back, whole[20:] + body, whole[45:] + body, ""]
    assert k.residual_counts([r.encode() for r in reads], group, bars, 15, 4, 0.5)[:4] == [0, 1, 2, 1]
    assert k.residual_counts([r.encode() for r in reads], group, bars, 15, 4, 0.5)[5:] == [0, 0]


def test_least_cost_with_overhang_equals_the_plain_program():
    rng = np.random.default_rng(0)
    for m in (8, 24, 70):
        p, texts = rng.choice([1, 2, 4, 8], (3, m)).astype(np.uint8), [rng.choice([1, 2, 4, 8], n).astype(np.uint8) for n in (1, 9, 40)]
        text = np.zeros((40, 3), np.uint8)
        for i, t in enumerate(texts):
            text[: len(t), i] = t
        got = k.least_with_overhang(k.bit_tables(p), m, text, np.array([1, 9, 40]), 0.5)
        left = k.border(m, 0.5)
        for i, t in enumerate(texts):
            for j in range(3):
                column = left.astype(int)
                best = column[-1]
                for c in t:
                    new = np.zeros(m + 1, int)
                    for r in range(1, m + 1):
                        new[r] = min(column[r - 1] + (p[j, r - 1] & c == 0), column[r] + 1, new[r - 1] + 1)
                    column = new
                    best = min(best, column[-1])
                assert got[i, j] == min(best, (column + left[::-1]).min())


@pytest.mark.parametrize("pattern", ["ACGTTGCAAC", "ACGTAGCTAGCATCGA" + "N" * 24 + "ACGTTGCATGCATTAGCATCGATTGCATCGGATCGATTAGCATTTGCAAC", "N" * 20 + "ACGGT" * 13, "ACGTC" * 20, "ACGNNT" * 11])
def test_scan_equals_the_plain_recurrence(pattern):
    rng = np.random.default_rng(len(pattern))
    p = k.encode(pattern)
    m, left = len(p), k.border(len(p), 0.4)
    texts = ["".join(rng.choice(list("ACGTR"), n)) for n in (1, 7, 30, 119, 120)] + [pattern.replace("N", "A")[3:] + "ACGT" * 5]
    lengths = np.array([len(t) for t in texts])
    block = np.zeros((lengths.max(), len(texts)), np.uint8)
    for x, t in enumerate(texts):
        block[: len(t), x] = k.encode(t)
    cost, delta = k.scan(k.words_of(p), m, block, left, lengths)
    for x, n in enumerate(lengths):
        assert cost[: n + 1, x].tolist() == k.last_row_dp(p, block[:n, x], left).tolist()
        rows = [int(k.last_row_dp(p[:i], block[:n, x], left[: i + 1])[n]) for i in range(m + 1)]
        assert k.last_column(delta[x : x + 1], cost[n, x : x + 1].astype(np.int32))[0].tolist() == rows


def test_equal_windows_are_judged_once(monkeypatch):
    group = kit_groups("SQK-RBK110-96")[0]
    query = group.prefix + group.seqs[4][10:34] + group.suffix
    rng = np.random.default_rng(1)
    reads = [(query + "".join(rng.choice(list("ACGT"), 150))).encode() for _ in range(200)]
    seen, judged, best, traced, trace = {}, [], k.best_barcodes, [], k.trace
    monkeypatch.setattr(k, "best_barcodes", lambda g, s, w, *a, **b: judged.append(len(w)) or best(g, s, w, *a, **b))
    monkeypatch.setattr(k, "trace", lambda p, *a, **b: traced.append(len(p)) or trace(p, *a, **b))
    for _ in range(2):
        got = k.annotate_columns(*k.joined(reads), [group], 0.4, 0.2, 0.1, seen=seen)
        assert got["read"][got["label"] == 4].tolist() == list(range(200))
    # one window in all and that of a chance hit; no hit without gaps is traced back
    assert sum(judged) == 2 and sum(traced) < 100


def test_hits_without_gaps_are_those_of_the_trace(monkeypatch):
    rng = np.random.default_rng(5)
    group = kit_groups("SQK-RBK110-96")[0]
    reads = []
    for i in range(120):
        q = list(group.prefix + group.seqs[i % 96][10:34] + group.suffix)[int(rng.integers(0, 14)) :] + list(rng.choice(list("ACGT"), 60))
        for at in rng.integers(0, 90, i % 7):
            q[at : at + 1] = [["ACGT"[rng.integers(4)]], [], ["A", "C"]][rng.integers(3)]
        reads.append("".join(rng.choice(list("ACGT"), int(rng.integers(0, 2)) * 40)) + "".join(q))
    reads = [r.encode() for r in reads]
    got = k.annotate_reads(reads, [group], 0.4, 0.2, 0.1)
    monkeypatch.setattr(k, "without_gaps", lambda pattern, text, read, *a: np.zeros(len(read), bool))
    assert sum(map(len, got)) >= 110 and k.annotate_reads(reads, [group], 0.4, 0.2, 0.1) == got


@pytest.mark.parametrize("m", [3, 24, 32, 40, 64])
def test_distances_are_edit_distances(m):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = np.random.default_rng(m)
    patterns = ["".join(rng.choice(list("ACGT"), m)) for _ in range(5)]
    texts = ["", patterns[0], patterns[1][2:], patterns[2] + "ACG"] + ["".join(rng.choice(list("ACGT"), n)) for n in rng.integers(0, 70, 20)]
    block = np.zeros((80, len(texts)), np.uint8)
    for x, t in enumerate(texts):
        block[: len(t), x] = k.encode(t)
    got = k.distances(np.stack([k.encode(p) for p in patterns]), block, np.array([len(t) for t in texts]), chunk=7)
    assert got.tolist() == [[plain(p, t) for p in patterns] for t in texts]


@pytest.mark.parametrize("passing", [True, False])
def test_scan_over_several_words_of_texts(passing):
    rng = np.random.default_rng(11)
    group = kit_groups("SQK-RBK110-96")[0].prepared()
    p = group.tables["flank"][0][0]
    m, left = len(p), k.border(len(p), 0.4)
    lengths = rng.integers(1, 140, 150)
    block = np.zeros((lengths.max(), 150), np.uint8)
    for x, n in enumerate(lengths):
        block[:n, x] = rng.choice([1, 2, 4, 8, 5, 15] + [0] * (not passing), n)
    cost, delta = k.scan(group.tables["words"], m, block, left, lengths, passing)
    for x in (0, 63, 64, 127, 128, int(lengths.argmin()), int(lengths.argmax())):
        n = lengths[x]
        assert cost[: n + 1, x].tolist() == k.last_row_dp(p, block[:n, x], left).tolist()
        rows = k.last_column(delta[x : x + 1], cost[n, x : x + 1].astype(np.int32))[0]
        assert [rows[i] for i in (0, 5, 16, 17, 31, 40, 41, 90)] == [k.last_row_dp(p[:i], block[:n, x], left[: i + 1])[n] for i in (0, 5, 16, 17, 31, 40, 41, 90)]


def test_both_strands_are_searched_at_once(monkeypatch):
    group = kit_groups("SQK-RBK110-96")[0]
    rng = np.random.default_rng(2)
    reads = ["".join(rng.choice(list("ACGT"), 300)) + group.prefix + group.seqs[i][10:34] + group.suffix for i in range(96)]
    reads += ["".join("=AC=G===T"[c] for c in k.COMPLEMENT[k.encode(r)[::-1]]) for r in reads]
    calls, scan = [], k.scan
    monkeypatch.setattr(k, "scan", lambda *a, **b: calls.append(1) or scan(*a, **b))
    got = k.annotate_reads([r.encode() for r in reads], [group], 0.4, 0.2, 0.1)
    assert len(calls) == 1
    assert [[(m["label"], m["strand"]) for m in ms if m["flank_cost"] == 0] for ms in got] == [[(label, strand)] for strand in k.STRANDS for label in group.labels]
