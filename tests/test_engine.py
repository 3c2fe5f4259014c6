"""Collapse, patterns, filter, inspect and trim on hand-made matches."""

import pytest
from pyspark.sql import functions as F

from porelane.functions import dna
from porelane.functions.patterns import Cut, matches, parse, read_patterns
from porelane.operators import collapse, inspect, trim
from porelane.operators import filter as flt
from porelane.schema import MATCH


def match(start=0, end=0, kind="Ftag", label="A", strand="Fwd", read_len=500, cost=0, flank=None, cuts=None, rel=1, flank_cost=0):
    f = flank or (start, end)
    return (read_len, rel, start, end, f[0], f[1], 0, 0, kind, flank_cost, cost, label, strand, cuts)


def table(spark, reads):
    return spark.createDataFrame([(str(i), ms) for i, ms in enumerate(reads)], f"read_id string, matches array<{MATCH.simpleString()}>")


def fits(spark, pattern, reads):
    df = table(spark, reads).select("read_id", matches(F.col("matches"), parse(pattern)).alias("ok"))
    return [r["ok"] for r in sorted(df.collect(), key=lambda r: int(r["read_id"]))]


def test_positions(spark):
    assert fits(spark, "Ftag[fw, *, @left(0..250)]", [[match(s, s + 20)] for s in (0, 100, 250, 251)]) == [True, True, True, False]
    assert fits(spark, "Ftag[fw, *, @right(0..250)]", [[match(e - 20, e)] for e in (500, 450, 250, 249)]) == [True, True, True, False]
    second = [[match(50, 100), match(s, s + 10, "Fflank")] for s in (105, 200, 50, 100, 201)]
    assert fits(spark, "Ftag[fw, *]__Fflank[fw, @prev_left(5..100)]", second) == [True, True, False, False, False]


def test_positions_are_those_of_the_barcode(spark):
    assert fits(spark, "Ftag[fw, *, @left(0..250)]", [[match(260, 280, flank=(100, 300))], [match(240, 280, flank=(300, 400))]]) == [False, True]


def test_labels_and_placeholders(spark):
    two = lambda a, b: [match(0, 100, label=a, read_len=250), match(100, 200, "Rtag", b, read_len=250)]
    same = "Ftag[fw, ?1, @left(0..250)]__Rtag[fw, ?1, @right(0..250)]"
    assert fits(spark, same, [two("XXX", "XXX"), two("XXX", "yyyy")]) == [True, False]
    assert fits(spark, same.replace("Rtag[fw, ?1", "Rtag[fw, ?2"), [two("XXX", "yyyy")]) == [True]
    three = [match(0, 10, label=x) for x in ("XXX", "YYY", "XXX")]
    assert fits(spark, "Ftag[?1]__Ftag[?2]__Ftag[?1]", [three, three[:2] + [match(label="Z")]]) == [True, False]
    assert fits(spark, "Ftag[~C0]", [[match(label="BC01")], [match(label="AB01")]]) == [True, False]
    assert fits(spark, "Fflank[other]", [[match(kind="Fflank", label="flank")]]) == [True]  # flanks match whatever the label
    assert fits(spark, "Ftag[rc, *]", [[match()], [match(strand="Rc")]]) == [False, True]


def test_cuts_in_patterns():
    cuts = lambda p: [(i, c) for i, e in enumerate(parse(p)) for c in e.cuts]
    assert cuts("Ftag[>>]__Ftag[<<]") == [(0, Cut("After")), (1, Cut("Before"))]
    assert cuts("Ftag[>>1]__Ftag[<<1]__Ftag[<<2]") == [(0, Cut("After", 1)), (1, Cut("Before", 1)), (2, Cut("Before", 2))]


@pytest.mark.parametrize("text", ["Ftag[@left(0 to 250)]", "Ftag[@pev_left(0..5)]", "Ftag[<<. fw]", "Ftag[?x]", "Xtag[fw]", "Ftag[fw", "Ftag[>]"])
def test_unreadable_patterns_raise(text):
    with pytest.raises(ValueError):
        parse(text)


def test_lenient_patterns_are_less_constrained():
    e = parse("Ftag[fw, @left(0 to 250)]", lenient=True)[0]
    assert e.anchor is None and e.strand == "Fwd"


def test_pattern_files():
    assert len(read_patterns(["Ftag[fw]\n\n  Ftag[rc]  \n", "Rtag[fw]"])) == 3
    with pytest.raises(ValueError, match="no patterns"):
        read_patterns(["\n\n"])


def test_the_longest_pattern_wins_and_must_cover_the_read(spark):
    one, two = "Ftag[fw, *, >>]", "Ftag[fw, *, >>4]__Ftag[fw, *]"
    reads = table(spark, [[match()], [match(), match(50, 60)], [match(), match(50, 60), match(70, 80, "Rtag")], [match(kind="Rtag")]])
    got = {r["read_id"]: r for r in flt.filter_reads(reads, [parse(one), parse(two)]).select("read_id", "kept", F.transform("matches", lambda m: dna.cuts_text(m["cuts"])).alias("c")).collect()}
    assert [got[str(i)]["kept"] for i in range(4)] == [True, True, False, False]
    # cuts are written on dropped reads, too
    assert [got[str(i)]["c"] for i in range(4)] == [["After(0):0"], ["After(4):0", ""], ["After(4):0", "", ""], [""]]


def test_filtering_again_appends(spark):
    reads = table(spark, [[match(cuts=[("Before", 3, 0)])]])
    got = flt.filter_reads(reads, [parse("Ftag[*, >>]")]).select(dna.cuts_text(F.col("matches")[0]["cuts"])).first()[0]
    assert got == "Before(3):0,After(0):0"


def test_cut_text(spark):
    texts = ["", None, "After(1):0", "Before(2):5,After(0):1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = df.select(dna.cuts_from_text(F.col("t")).alias("c")).select("c", dna.cuts_text(F.col("c")).alias("t")).collect()
    assert [r["t"] for r in got] == ["", "", *texts[2:]] and got[0]["c"] is None
    for bad in ("Invalid", "After(abc)", "After(1)"):
        with pytest.raises(Exception, match="malformed cut"):
            spark.createDataFrame([(bad,)], "t string").select(dna.cuts_from_text(F.col("t"))).collect()


def spans(rows):
    return [match(s, e, kind, label, cost=c, flank_cost=0) for s, e, c, label, kind in rows]


@pytest.mark.parametrize(
    "rows, threshold, want",
    [
        ([], 0.5, []),
        ([(0, 10, 3, "test1")], 0.5, ["test1"]),
        ([(0, 10, 3, "test1"), (10, 20, 3, "test2")], 0.5, ["test1", "test2"]),
        ([(0, 20, 0, "test1"), (15, 20, 3, "test2")], 0.5, ["test1"]),
        ([(0, 20, 0, "test1"), (10, 35, 3, "test2")], 0.5, ["test1"]),
        ([(0, 20, 0, "test1"), (10, 35, 3, "test2")], 0.6, ["test1", "test2"]),
        ([(10, 20, 3, "test2"), (100, 110, 3, "test3"), (0, 15, 3, "test2"), (0, 10, 0, "test1")], 0.5, ["test1", "test3"]),
        *[([(0, 10, 3, "test1"), (10 - s, 20 - s, 1, "test2")], 0.5, ["test1", "test2"] if s < 5 else ["test2"]) for s in range(1, 6)],
        # equality in single precision
        ([(0, 100, 1, "a"), (20, 120, 0, "b")], 0.8, ["b"]),
        ([(0, 5, 1, "a"), (1, 6, 0, "b")], 0.8, ["b"]),
        ([(0, 10, 1, "a"), (2, 12, 0, "b")], 0.8, ["b"]),
    ],
)
def test_overlap_collapse(spark, rows, threshold, want):
    df = collapse.collapse_reads(table(spark, [spans([(*r, "Ftag") for r in rows])]), threshold)
    assert [m["label"] for m in df.first()["matches"]] == want


def test_collapse_prefers_tags_then_long_flanks(spark):
    flanks = [match(0, 100, "Fflank", "short", cost=9), match(0, 110, "Fflank", "long", cost=9)]
    tag = match(5, 100, "Ftag", "tag", cost=30)
    got = collapse.collapse_reads(table(spark, [flanks, [*flanks, tag]])).orderBy("read_id").collect()
    assert [[m["label"] for m in r["matches"]] for r in got] == [["long"], ["tag"]]


def test_inspect_structure(spark):
    reads = [
        [match(10, 30, rel=10), match(480, 500, strand="Rc")],
        [match(400, 420, rel=-80)],
        [match(10, 30, rel=10, cuts=[("After", 0, 0)]), match(40, 50, "Fflank", strand="Rc", cuts=[("After", 0, 0)])],
    ]
    got = [r[0] for r in table(spark, reads).orderBy("read_id").select(inspect.structure(F.col("matches"))).collect()]
    assert got == ["Ftag[fw, *, @left(0..250)]__Ftag[rc, *, @right(0..250)]", "Ftag[fw, *, @right(0..250)]", "Ftag[fw, *, <<, @left(0..250)]__Fflank[rc, *, >>, @prev_left(0..250)]"]


def test_buckets(spark):
    pos = [0, 1, 250, 251, 500, 501]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pos)], "i int, p int").orderBy("i").select(dna.bucketed(F.col("p"), 250))
    assert [r[0] for r in df.collect()] == [0, 0, 0, 250, 250, 500]


def cut_read(spark, seq, marks, **how):
    """marks: (start, end, kind, label, strand, direction, group)."""
    ms = [match(0, 0, k, lab, strand, len(seq), flank=(s, e), cuts=[(d, g, i)] if d else None) for i, (s, e, k, lab, strand, d, g) in enumerate(marks)]
    df = table(spark, [ms]).withColumns({"desc": F.lit(""), "seq": F.lit(seq), "qual": F.lit("".join(chr(33 + i) for i in range(len(seq))))})
    return [(r["id"], r["seq"], r["label"], r["qual"]) for r in trim.trim_reads(df, trim.LabelConfig(sort_labels=True), **how).orderBy("slice_idx").collect()]


PAIR = [(4, 8, "Ftag", "Fbar", "Fwd", "After", 0), (12, 16, "Rtag", "Rbar", "Fwd", "Before", 0)]


def test_trim_between_two_cuts(spark):
    assert cut_read(spark, "CCCCCCCCAAAACCCCCCCCCCCC", PAIR)[0][:3] == ("0", "AAAA", "Fbar_fw__Rbar_fw")
    assert cut_read(spark, "CCCCCCCCAAAACCCCCCCCCCCC", PAIR, skip_trim=True)[0][1:3] == ("CCCCCCCCAAAACCCCCCCCCCCC", "Fbar_fw__Rbar_fw")


def test_trim_two_groups(spark):
    marks = [(4, 8, "Ftag", "F1", "Fwd", "After", 1), (20, 24, "Rtag", "R1", "Fwd", "Before", 1), (24, 26, "Ftag", "F2", "Fwd", "After", 2), (28, 30, "Rtag", "R2", "Fwd", "Before", 2)]
    got = cut_read(spark, "CCCCCCCCAAAAAAAAAAAACCCCCCGGCC", marks)
    assert [g[:3] for g in got] == [("0", "AAAAAAAAAAAA", "F1_fw__R1_fw"), ("0_1", "GG", "F2_fw__R2_fw")]


def test_trim_flip(spark):
    seq = "CCCCCCCCAGGCCCCCCCCCCCCC"
    turned = [(4, 8, "Ftag", "Fbar", "Rc", "After", 0), PAIR[1]]
    (_, s, name, q), (_, s2, _, _) = cut_read(spark, seq, turned, flip=True)[0], cut_read(spark, seq, PAIR, flip=True)[0]
    assert (s, name, q, s2) == ("GCCT", "Fbar_rc__Rbar_fw", ",+*)", "AGGC")


def test_trim_single_cuts_look_at_their_neighbours(spark):
    seq = "ACGT" * 10
    before = [(4, 8, "Ftag", "A", "Fwd", "After", 1), (20, 24, "Ftag", "B", "Fwd", "Before", 2)]
    assert [(g[0], len(g[1]), g[2]) for g in cut_read(spark, seq, before)] == [("0", 12, "A_fw__B_fw"), ("0_1", 12, "A_fw__B_fw")]
    assert [len(g[1]) for g in cut_read(spark, seq, [(4, 8, "Ftag", "A", "Fwd", "After", 0)])] == [32]
    assert [len(g[1]) for g in cut_read(spark, seq, [(4, 8, "Ftag", "A", "Fwd", "Before", 0)])] == [4]
    # an empty slice is left out, but counts for the next one's suffix
    empty = [(0, 4, "Ftag", "A", "Fwd", "Before", 1), (4, 8, "Ftag", "B", "Fwd", "After", 2)]
    assert [(g[0], len(g[1])) for g in cut_read(spark, seq, empty)] == [("0_1", 32)]
    # three cuts of one group yield nothing
    assert cut_read(spark, seq, [(i, i + 2, "Ftag", "A", "Fwd", "After", 0) for i in (0, 10, 20)]) == []


def test_labels(spark):
    ms = [match(label="B", strand="Rc"), match(kind="Fflank", label="flank"), match(label="A")]
    cases = {
        (): "B_rc__flank_fw__A_fw",
        (("include_label", False),): "none",
        (("include_orientation", False), ("include_flank", False)): "B__A",
        (("sort_labels", True),): "A_fw__B_rc__flank_fw",
        (("only_side", "left"), ("include_orientation", False)): "B",
        (("only_side", "right"),): "A_fw",
    }
    for options, want in cases.items():
        assert table(spark, [ms]).select(trim.label(F.col("matches"), trim.LabelConfig(**dict(options)))).first()[0] == want
    with pytest.raises(ValueError):
        trim.LabelConfig(sort_labels=True, only_side="left")


def test_reads_without_quality_raise(spark):
    reads = spark.createDataFrame([("0", "", "ACGT", None)], "read_id string, desc string, seq string, qual string")
    annotations = spark.createDataFrame([("0", 0, *match())], f"read_id string, anno_idx int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in MATCH.fields)}")
    with pytest.raises(Exception, match="without quality"):
        trim.trim(reads, annotations).collect()
