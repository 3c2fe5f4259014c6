"""Command line: annotate, filter, trim, inspect, kit, pull."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kits
from .functions.patterns import read_patterns
from .operators import annotate as an
from .operators import filter as fi
from .operators import inspect as ins
from .operators import trim as tr
from .operators.report import shown
from .plans.groups import fasta_groups, kit_groups
from .plans.kit import demux
from .schema import flat
from .session import ship
from .sources.fastq import read_fastq, write_fastq
from .sources.tables import read_annotations, write_annotations, write_counters, write_lines, write_patterns


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="porelane", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    def search(p, kit_required):
        p.add_argument("-i", "--input", nargs="+", required=True)
        p.add_argument("-o", "--output", default="output" if kit_required else "annotations")
        p.add_argument("-k", "--kit", required=kit_required)
        p.add_argument("--flank-max-errors", type=int)
        p.add_argument("--min-score", type=float, default=0.2)
        p.add_argument("--min-score-diff", type=float, default=0.1)
        p.add_argument("--use-extended", action="store_true")
        p.add_argument("--alpha", type=float, default=0.4)

    a = verbs.add_parser("annotate")
    search(a, False)
    a.add_argument("-q", "--queries", nargs="+")
    a.add_argument("-b", "--barcode-types", nargs="+", default=["Ftag"])
    f = verbs.add_parser("filter")
    f.add_argument("-i", "--input", required=True)
    f.add_argument("-o", "--output", required=True)
    f.add_argument("-f", "--file", nargs="+", required=True)
    f.add_argument("--dropped")
    f.add_argument("--lenient", action="store_true")
    for verb in ("trim", "pull"):
        t = verbs.add_parser(verb)
        t.add_argument("-i", "--input", required=True)
        t.add_argument("-r", "--reads", nargs="+", required=True)
        t.add_argument("-o", "--output", required=True)
        for flag in ("no-label", "no-orientation", "no-flanks", "sort-labels", "skip-trim", "flip", "gzip"):
            t.add_argument(f"--{flag}", action="store_true")
        t.add_argument("--only-side", choices=["left", "right"])
        t.add_argument("--failed-out")
    n = verbs.add_parser("inspect")
    n.add_argument("-i", "--input", required=True)
    n.add_argument("-n", "--top-n", type=int, default=10)
    n.add_argument("-o", "--read-pattern-out")
    n.add_argument("-s", "--bucket-size", type=int, default=250)
    k = verbs.add_parser("kit")
    search(k, True)
    for flag in ("maximize", "gzip", "flip"):
        k.add_argument(f"--{flag}", action="store_true")
    for verb in verbs.choices.values():
        verb.add_argument("-t", "--threads", type=int, help="ignored: the cluster decides")
        verb.add_argument("-v", "--verbose", action="store_true", help="show query groups")
    return top


def summary(counts: DataFrame, top_n: int) -> None:
    """How many patterns there are, and the most frequent ones."""
    print(f"{counts.count()} patterns")
    for r in counts.orderBy(F.desc("count"), "pattern").limit(top_n).collect():  # the top n
        print(f"{r['count']}\t{r['pattern']}")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("porelane").getOrCreate()
    ship(spark)
    if o.verb == "annotate":
        if bool(o.kit) == bool(o.queries):
            raise SystemExit("give either a kit or query files")
        groups = kit_groups(o.kit, o.use_extended, o.flank_max_errors) if o.kit else fasta_groups(o.queries, o.barcode_types, o.flank_max_errors)
        for group in groups if o.verbose else ():
            print(shown(group))
        write_annotations(an.annotate(read_fastq(spark, o.input), groups, alpha=o.alpha, min_score=o.min_score, min_diff=o.min_score_diff), o.output)
    elif o.verb == "filter":
        texts = [open(p, encoding="utf-8").read() for p in o.file]
        out = fi.filter_annotations(read_annotations(spark, o.input), read_patterns(texts, o.lenient)).persist()
        write_annotations(out.where("kept"), o.output)
        if o.dropped:
            write_annotations(out.where("not kept"), o.dropped)
        out.unpersist()
    elif o.verb in ("trim", "pull"):
        config = tr.LabelConfig(not o.no_label, not o.no_orientation, not o.no_flanks, o.sort_labels, o.only_side)
        reads, annotations = read_fastq(spark, o.reads), read_annotations(spark, o.input)
        write_fastq(tr.trim(reads, annotations, config, o.skip_trim or o.verb == "pull", o.flip), o.output, o.gzip)
        write_counters(tr.counters(reads, annotations), f"{o.output}/_trim.{int(time.time() * 1000)}.log")
        if o.failed_out:
            write_lines(tr.failed(reads, annotations), o.failed_out)
    elif o.verb == "inspect":
        patterns = ins.read_patterns(read_annotations(spark, o.input), o.bucket_size).persist()
        summary(ins.pattern_counts(patterns), o.top_n)
        if o.read_pattern_out:
            write_patterns(patterns, o.read_pattern_out)
        patterns.unpersist()
    else:
        kits.family(o.kit)
        got = demux(read_fastq(spark, o.input), o.kit, o.maximize, o.use_extended, o.flank_max_errors, o.alpha, o.min_score, o.min_score_diff, o.flip, keep=True)
        write_annotations(flat(got.annotated.select("read_id", "matches")), f"{o.output}/annotation")
        write_annotations(flat(got.filtered.where("kept").select("read_id", "matches")), f"{o.output}/filtered")
        write_patterns(got.annotated.select("read_id", ins.structure(F.col("matches")).alias("pattern")), f"{o.output}/pattern_per_read")
        write_fastq(got.trimmed, f"{o.output}/reads", o.gzip)
        summary(got.patterns, 10)
        got.annotated.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
