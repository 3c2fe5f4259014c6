"""FASTQ, tables, the command line and streaming."""

import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from porelane import cli, kits
from porelane.plans.kit import demux, unmatched_tags
from porelane.sources import fastq, tables
from porelane.streaming.demux import demux_folder, read_folder

FLANK = kits.FLANKS["RBK4"]


def read(i, name, qual="I", desc=""):
    body = "ACGTTGCAGT" * 40
    seq = FLANK[0] + kits.BC[i] + FLANK[1] + body
    return f"@{name}{' ' + desc if desc else ''}\n{seq}\n+\n{qual * len(seq)}\n"


@pytest.mark.parametrize("head, want", [("read1 some description", ("read1", "some description")), ("read1", ("read1", "")), ("a\t  b c", ("a", "b c"))])
def test_header_split(head, want):
    assert fastq.split_header(head) == want


def test_quality_lines_may_begin_with_at():
    text = "@a\nACGT\n+\n@@@@\n@b x\nAC\n+b\nII\n"
    assert list(fastq.records(iter(text.splitlines(True)))) == [("a", "ACGT", "@@@@"), ("b x", "AC", "II")]
    with pytest.raises(ValueError, match="broken"):
        list(fastq.records(iter("@a\nACGT\n+\nII\n".splitlines(True))))


def test_no_files_is_an_error():
    with pytest.raises((ValueError, FileNotFoundError)):
        fastq.files_of(" ")


def test_reading_files_folders_and_gzip(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(read(0, "a", "@", "x y"))
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(read(1, "b") + read(2, "c"))
    (tmp_path / "c.fasta").write_text(">f one\nACGT\nAC\n")
    got = {r["read_id"]: r for r in fastq.read_fastq(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a", "b", "c", "f"] and got["a"]["desc"] == "x y" and got["c"]["ord"] == 1
    assert got["f"]["seq"] == "ACGTAC" and got["f"]["qual"] is None
    stored = fastq.read_stored(spark, f"file://{tmp_path}/*")
    assert sorted(r["read_id"] for r in stored.collect()) == ["a", "b", "c", "f"]


def test_annotation_text_round_trip(spark, tmp_path):
    from porelane import synth
    from porelane.operators.filter import filter_annotations

    orders = spark.range(1, 40).withColumnRenamed("id", "o_orderkey")
    made = filter_annotations(synth.match_lists(orders), ["Ftag[*, >>]"]).drop("kept")
    tables.write_annotations(made, str(tmp_path / "t"))
    back = tables.read_annotations(spark, str(tmp_path / "t"))
    columns = ["read_id", "label", "strand", "read_start_bar", "cuts", "match_type"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, made.select(columns).collect()))
    header = next(line for p in glob.glob(str(tmp_path / "t/*.csv")) for line in open(p))
    assert header.split("\t")[:3] == ["read_id", "read_len", "rel_dist_to_end"] and header.strip().endswith("cuts")


def test_command_line_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fastq").write_text(read(0, "a") + read(1, "b") + "@none\nACGTACGT\n+\nIIIIIIII\n")
    p = lambda x: str(tmp_path / x)
    assert cli.main(["annotate", "-i", p("in"), "-o", p("anno"), "-k", "SQK-RBK110-96"], spark) == 0
    (tmp_path / "patterns.txt").write_text("Ftag[fw, *, @left(0..250), >>]\n")
    assert cli.main(["filter", "-i", p("anno"), "-o", p("kept"), "-f", p("patterns.txt"), "--dropped", p("dropped")], spark) == 0
    assert cli.main(["inspect", "-i", p("anno"), "-o", p("per_read")], spark) == 0
    assert cli.main(["trim", "-i", p("kept"), "-r", p("in"), "-o", p("out"), "--no-orientation", "--failed-out", p("failed")], spark) == 0
    names = sorted(os.path.basename(x) for x in glob.glob(p("out/*.fastq")))
    assert names == ["BC01.trimmed.fastq", "BC02.trimmed.fastq"]
    lines = open(p("out/BC01.trimmed.fastq")).read().splitlines()
    assert lines[0] == "@a" and lines[1] == "ACGTTGCAGT" * 40 and len(lines) == 4
    assert cli.main(["pull", "-i", p("kept"), "-r", p("in"), "-o", p("pulled"), "--gzip"], spark) == 0
    with gzip.open(p("pulled/BC02_fw.trimmed.fastq.gz"), "rt") as f:
        assert f.readline() == "@b\n" and f.readline().startswith(FLANK[0])
    assert cli.main(["kit", "-i", p("in"), "-o", p("kit"), "-k", "SQK-RBK110-96"], spark) == 0
    assert sorted(os.listdir(p("kit/reads"))) == names


def test_command_line_with_own_queries(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(read(0, "a"))
    (tmp_path / "q.fasta").write_text("".join(f">x{i}\n{FLANK[0]}{kits.BC[i]}{FLANK[1]}\n" for i in range(4)))
    assert cli.main(["annotate", "-i", str(tmp_path / "a.fastq"), "-o", str(tmp_path / "anno"), "-q", str(tmp_path / "q.fasta")], spark) == 0
    assert [r["label"] for r in tables.read_annotations(spark, str(tmp_path / "anno")).collect()] == ["x0"]
    with pytest.raises(SystemExit):
        cli.main(["annotate", "-i", "x", "-k", "SQK-RBK110-96", "-q", "q"], spark)


def test_a_hot_label_can_be_spread_over_files(spark, tmp_path):
    rows = [(f"r{i}", "", "ACGT", "IIII", "A") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, desc string, seq string, qual string, label string")
    fastq.write_fastq(df, str(tmp_path / "o"), files_per_label=3)
    files = glob.glob(str(tmp_path / "o/*.fastq"))
    assert sorted(map(os.path.basename, files)) == [f"A.trimmed.{i}.fastq" for i in range(3)]
    assert sum(open(f).read().count("@r") for f in files) == 40


def test_streaming_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.fastq").write_text(read(i, f"r{i}"))
    demux_folder(spark, f"file://{tmp_path}/in", "SQK-RBK110-96", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = sorted((r["id"], r["label"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = sorted((r["id"], r["label"], r["seq"]) for r in demux(fastq.read_fastq(spark, str(tmp_path / "in")), "SQK-RBK110-96").trimmed.collect())
    assert streamed == batch and len(batch) == 3
    assert read_folder(spark, f"file://{tmp_path}/in").isStreaming


def test_right_tags_are_counted(spark):
    front, back = kits.FLANKS["RAB_2ND"]
    reads = spark.createDataFrame([("a", "", front + kits.BC[3] + back + "ACGT" * 60, "I" * 300)], "read_id string, desc string, seq string, qual string")
    found = demux(reads, "SQK-RAB204").annotated
    assert unmatched_tags(found).first()["reads"] == 1
    assert found.select(F.col("matches")[0]["match_type"], F.col("matches")[0]["label"]).first()[:] == ("Rtag", "BC04")


def test_plans_of_a_kit_shuffle_only_to_sum_up(spark):
    reads = spark.createDataFrame([("a", "", "ACGT", "IIII")], "read_id string, desc string, seq string, qual string")
    plan = demux(reads, "SQK-RBK110-96").trimmed._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_labels_stay_inside_the_folder_and_paths_may_hold_commas(spark, tmp_path):
    rows = [("r1", "../up", "ACGT", "IIII"), ("r2", "a/b", "AC", "II"), ("r3", ".hid", "G", "I")]
    out = tmp_path / "out"
    trimmed = spark.createDataFrame(rows, "id string, label string, seq string, qual string")
    fastq.write_fastq(trimmed.withColumn("desc", trimmed["id"]), str(out))
    assert sorted(p.name for p in out.iterdir()) == ["_._up.trimmed.fastq", "_hid.trimmed.fastq", "a_b.trimmed.fastq"]
    odd = tmp_path / "x,y.fastq"
    odd.write_text("@r1\nACGT\n+\nIIII\n")
    assert [r["seq"] for r in fastq.read_fastq(spark, [str(odd)]).collect()] == ["ACGT"]
