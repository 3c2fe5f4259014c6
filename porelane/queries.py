"""Registered queries of the demultiplexing engine. Their SQL is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kits, made, synth
from .functions import dna
from .functions.patterns import parse
from .operators.annotate import annotate, annotated, codes_of
from .operators.collapse import collapse_annotations
from .operators.filter import filter_annotations, filter_from_pattern, filter_reads
from .operators.inspect import inspect, pattern_counts, read_patterns
from .operators.kernel import bit_tables, border, distances, encode, last_row
from .operators.kernel import gathered as gathered_codes
from .operators.report import normalised, residual_adapters
from .operators.trim import LabelConfig, counters, failed, label, pull, trim, trim_reads
from .plans import groups
from .plans.kit import demux, unmatched_tags
from .schema import gathered, held

RAPID = "SQK-RBK110-96"
PAIR = ["Ftag[fw, *, @left(0..250), >>]__Ftag[<<, *, @right(0..250)]"]


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet")


def _spread(spark: SparkSession, sf: str) -> DataFrame:
    """Keys dealt over all cores before reads are made of them: the table may be one block."""
    return _orders(spark, sf).select("o_orderkey").repartition(2 * spark.sparkContext.defaultParallelism)


def _lists(spark, sf) -> DataFrame:
    return synth.match_lists(_spread(spark, sf))


def _cut(spark, sf, patterns) -> DataFrame:
    return filter_annotations(_lists(spark, sf), patterns).where("kept")


def fastq_header_split(spark, sf):
    o = _orders(spark, sf)
    k = F.col("o_orderkey").cast("string")
    header = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("read"), k)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("read"), k, F.lit("  runid="), k, F.lit(" ch=1"))).otherwise(F.concat(F.lit("read"), k, F.lit("\tbarcode "), k))
    return o.select("o_orderkey", dna.header_id(header).alias("read_id"), dna.header_description(header).alias("description"))


def reverse_complement(spark, sf):
    seq = F.concat(synth.dna(F.col("o_orderkey"), "a"), F.lit("RYKMBDHVNSWX"))
    return _orders(spark, sf).select("o_orderkey", dna.reverse_complement(seq).alias("seq"))


def iupac_check(spark, sf):
    seq = F.concat(synth.dna(F.col("o_orderkey"), "a"), F.when(F.col("o_orderkey") % 5 == 0, "J").when(F.col("o_orderkey") % 5 == 1, "n").otherwise("R"))
    return _orders(spark, sf).select("o_orderkey", dna.is_iupac(seq).alias("valid"))


def rel_dist(spark, sf):
    k = F.col("o_orderkey")
    return _orders(spark, sf).select("o_orderkey", dna.rel_dist_to_end(((k * 37) % 1003 - 1).cast("int"), F.lit(1000)).alias("rel_dist"))


def edit_cutoff(spark, sf):
    return _orders(spark, sf).select("o_orderkey", dna.edit_cutoff(F.col("o_orderkey") % 200).alias("cutoff"))


def derive_reads_planted(spark, sf):
    return synth.planted_reads(_spread(spark, sf))


def listed_matches(spark, sf):
    return _lists(spark, sf)


def barcode_label_ranges(spark, sf):
    spans = [("BC01", "BC12", False), ("BC01", "BC12", True), ("NB13", "NB24", False), ("RBK24", "RBK61", False), ("AB01", "AB24", False), ("BC1A", "BC13A", False), ("BC12", "BC01", False)]
    return spark.createDataFrame([(f"{a}-{b}" + "+12A" * x, i, name) for a, b, x in spans for i, name in enumerate(kits.label_range(a, b, x))], "span string, position int, label string")


def kit_catalog(spark, sf):
    return spark.createDataFrame([(k, f, len(kits.FAMILIES[f][0]), "double" if kits.FAMILIES[f][1] else "single") for k, f in kits.KITS.items()], "kit string, family string, templates int, labels string")


def kit_catalog_expand(spark, sf):
    """Queries of every kit family, from DataFrames of templates, label ranges and barcodes."""
    template = spark.createDataFrame([(f, i, t.kind, t.text, t.first, t.last, t.use_12a, t.extended) for f, (ts, _) in kits.FAMILIES.items() for i, t in enumerate(ts)], "family string, template int, kind string, text string, first string, last string, use_12a boolean, extended boolean")
    number = lambda c: F.regexp_extract(F.upper(c), r"^([A-Z]*)([0-9]+)(A?)", 2).cast("int")
    prefix = F.regexp_extract(F.upper("first"), r"^([A-Z]*)", 1)
    spans = template.withColumn("prefix", prefix).withColumn("n", F.explode(F.sequence(number("first"), number("last"))))
    special = F.col("n").isin(*kits.RBK)
    name = F.concat(F.when((F.col("prefix") == "RBK") & ~special, "BC").otherwise(F.col("prefix")), F.lpad(F.col("n").cast("string"), 2, "0"), F.when((F.col("n") == 12) & F.col("use_12a"), "A").otherwise(""))
    labels = sorted({x for ts, _ in kits.FAMILIES.values() for t in ts for x in kits.label_range(t.first, t.last, t.use_12a)})
    bars = spark.createDataFrame([(x, kits.barcode(x)) for x in labels], "label string, bar string")
    out = spans.withColumn("label", name).join(F.broadcast(bars), "label")  # at most some hundred labels
    return out.select("family", "template", "kind", "extended", "label", F.replace("text", F.lit("{BAR}"), F.col("bar")).alias("seq"))


def group_flanks(spark, sf):
    """Derived constants of each kit's groups."""
    got = [(k, i, g.kind, g.prefix, g.suffix, *g.bar_region, *g.pad_region, len(g.labels), len(g.seqs[0]), g.cutoff) for k in sorted(kits.KITS) for i, g in enumerate(groups.kit_groups(k, True))]
    return spark.createDataFrame(got, "kit string, template int, kind string, prefix string, suffix string, bar_start int, bar_last int, pad_start int, pad_end int, queries int, padded_len int, cutoff int")


def approx_min_cost(spark, sf):
    """Least edit cost of a 24-nt barcode in the first 64 nt of a read, by the kernel's bit vectors."""
    import numpy as np
    import pyarrow as pa

    reads = _orders(spark, sf).where("o_orderkey is not null").select("o_orderkey", synth.dna(F.col("o_orderkey"), "a").alias("a"), synth.dna(F.col("o_orderkey"), "b").alias("b")).select("o_orderkey", F.concat("a", "b").alias("seq"))
    pattern = kits.barcode("BC01")

    def run(batches):
        p = encode(pattern)[None, :]
        tables, left = bit_tables(p), border(p.shape[1], 1.0)
        for batch in batches:
            if batch.num_rows:
                text = np.stack([encode(s) for s in batch.column("seq").to_pylist()], 1)
                cost, _ = last_row(tables, p.shape[1], text, left)
                yield pa.RecordBatch.from_arrays([batch.column("o_orderkey"), pa.array(cost[:, :, 0].min(0), pa.int32())], names=["o_orderkey", "cost"])

    return reads.mapInArrow(run, "o_orderkey long, cost int")


def barcode_assign_margin(spark, sf):
    """Nearest of 24 barcodes by edit distance, valid if the next one is at least 3 edits further."""
    import numpy as np
    import pyarrow as pa

    k = F.col("o_orderkey")
    own = F.element_at(F.array(*map(F.lit, kits.BC[:24])), (k % 24 + 1).cast("int"))
    edits = F.substring(synth.dna(k, "e"), F.lit(1), (k % 9).cast("int"))
    window = F.concat(edits, F.substring(own, F.length(edits) + 1, F.lit(24)))
    labels, bars = [f"BC{i + 1:02d}" for i in range(24)], np.stack([encode(s) for s in kits.BC[:24]])

    def run(batches):
        for batch in batches:
            codes, offsets = codes_of(batch.column("window"))
            size = np.diff(offsets)
            every = np.arange(batch.num_rows)
            cost = distances(bars, gathered_codes(codes[:, None], 0 * every, offsets[:-1], offsets[1:]).T, size)
            best = cost.argmin(1)  # the first label among equals
            least = cost[every, best]
            cost[every, best] = 1 << 20
            none = batch.column("window").is_null().to_numpy(zero_copy_only=False)
            best[none] = 0
            yield pa.RecordBatch.from_arrays([batch.column("o_orderkey"), pa.array(labels).take(pa.array(best)), pa.array(least, mask=none), pa.array(cost.min(1) - least >= 3, mask=none)], names=["o_orderkey", "label", "cost", "valid"])

    return _spread(spark, sf).select("o_orderkey", window.alias("window")).mapInArrow(run, "o_orderkey long, label string, cost int, valid boolean")


def exact_planted_demux(spark, sf):
    """All error-free planted reads through the kit's safe patterns, digests of whole slices."""
    return _digest(demux(made.planted_reads(_spread(spark, sf)), RAPID).trimmed)


def planted_slices(spark, sf):
    """The same with the patterns that `maximize` adds."""
    return _digest(demux(made.planted_reads(_spread(spark, sf)), RAPID, maximize=True).trimmed)


def overlap_collapse(spark, sf):
    return collapse_annotations(_lists(spark, sf)).select("read_id", "anno_idx", "read_start_flank", "read_end_flank", "match_type", "label", "barcode_cost", "flank_cost")


def overlap_collapse_half(spark, sf):
    return collapse_annotations(_lists(spark, sf), 0.5).select("read_id", "anno_idx", "read_start_flank", "read_end_flank", "match_type", "label", "barcode_cost", "flank_cost")


def cuts_roundtrip(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("After("), (k % 5).cast("string"), F.lit("):0"))).otherwise(F.concat(F.lit("Before("), (k % 4).cast("string"), F.lit("):1,After(2):"), (k % 7).cast("string")))
    cuts = dna.cuts_from_text(text)
    return _orders(spark, sf).select("o_orderkey", F.coalesce(F.size(cuts), F.lit(0)).alias("n"), dna.cuts_text(cuts).alias("cuts"))


FILTERS = {
    "filter_single_safe": kits.PATTERNS["single", "safe"],
    "filter_single_maximize": kits.PATTERNS["single", "maximize"],
    "filter_double_safe": kits.PATTERNS["double", "safe"],
    "filter_double_maximize": kits.PATTERNS["double", "maximize"],
    "filter_label_substring": ["Ftag[fw, ~C02, @left(0..250), >>]", "Ftag[fw, BC01, @left(0..250), >>]__Ftag[<<2, *]"],
    "filter_placeholder": ["Ftag[?1, >>]__Ftag[?1, <<]", "Ftag[?1]__Ftag[?2]__Ftag[?1, >>3]"],
    "filter_prev_left": ["Ftag[fw, *, @left(0..250)]__Ftag[*, @prev_left(5..200), >>]"],
}


def _filter(patterns):
    def run(spark, sf):
        return filter_annotations(_lists(spark, sf), patterns).select("read_id", "anno_idx", "kept", dna.cuts_text(F.col("cuts")).alias("cuts"))

    return run


def filter_dropped(spark, sf):
    return filter_from_pattern(_lists(spark, sf), PAIR[0]).where("not kept").select("read_id", "anno_idx", dna.cuts_text(F.col("cuts")).alias("cuts"))


def filter_again(spark, sf):
    """Filtering what is filtered adds cuts to those that are there."""
    once = filter_reads(gathered(_lists(spark, sf)), [parse(PAIR[0])])
    twice = filter_reads(once.drop("kept"), [parse("Ftag[*, <<7]__Ftag[*]")])
    return twice.select("read_id", "kept", F.array_join(F.transform("matches", lambda m: dna.cuts_text(m["cuts"])), "|").alias("cuts"))


def inspect_read_pattern(spark, sf):
    return read_patterns(_lists(spark, sf))


def inspect_topk(spark, sf):
    return inspect(_lists(spark, sf), 10)


def inspect_unique(spark, sf):
    return pattern_counts(read_patterns(_lists(spark, sf), 100)).agg(F.count(F.lit(1)).alias("patterns"), F.sum("count").alias("reads"))


def _digest(trimmed):
    return trimmed.select("id", "label", F.length("seq").alias("bases"), F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"))


def _trim(patterns, **how):
    def run(spark, sf):
        return _digest(trim(synth.listed_reads(_spread(spark, sf)), _cut(spark, sf, patterns), **how))

    return run


def pull_reads(spark, sf):
    return _digest(pull(synth.listed_reads(_spread(spark, sf)), _cut(spark, sf, PAIR)))


SINGLE = ["Ftag[fw, *, @left(0..250), >>]"]
BEFORE = ["Ftag[*]__Ftag[<<, rc, *]"]
MULTI = ["Ftag[*, >>1]__Ftag[*, <<1, >>2]__Ftag[*, <<2]"]


def label_variants(spark, sf):
    """Labels of each read under every valid configuration: the reads are made and filtered once."""
    variants = []
    for i in range(48):
        parts = dict(include_label=i % 2 == 0, include_orientation=i // 2 % 2 == 0, include_flank=i // 4 % 2 == 0, sort_labels=i // 8 % 2 == 0, only_side=(None, "left", "right")[i // 16])
        if parts["sort_labels"] and parts["only_side"]:
            continue
        name = "".join("01"[v] for v in list(parts.values())[:4]) + (parts["only_side"] or "none")
        variants.append(F.struct(F.lit(name).alias("variant"), label(F.col("matches"), LabelConfig(**parts)).alias("label")))
    return gathered(_cut(spark, sf, PAIR)).select("read_id", F.inline(F.array(*variants)))


def stage_counters(spark, sf):
    return counters(synth.listed_reads(_spread(spark, sf)), filter_annotations(_lists(spark, sf), PAIR))


def failed_reads(spark, sf):
    return failed(synth.listed_reads(_spread(spark, sf)), filter_annotations(_lists(spark, sf), PAIR))


def demux_noisy_recall(spark, sf):
    """Noisy reads by scenario: reads, reads with the planted label first, and reads that the kit keeps."""
    reads = synth.noisy_reads(_spread(spark, sf))
    found = annotated(made.noisy_reads(_spread(spark, sf), "scenario", "label", "seq"), groups.kit_groups(RAPID), carry=["scenario", "label"])
    kept = filter_reads(found, [parse(p) for p in kits.patterns(RAPID, True)])
    first = F.get("matches", F.lit(0))["label"]
    hits = kept.groupBy("scenario").agg(F.count(F.lit(1)).alias("annotated"), F.count_if(F.col("label").isNotNull() & (first == F.col("label"))).alias("right_label"), F.count_if("kept").alias("kept"))
    return reads.groupBy("scenario").agg(F.count(F.lit(1)).alias("reads")).join(hits, "scenario", "left").na.fill(0)


def annotate_table(spark, sf):
    return annotate(made.planted_reads(_spread(spark, sf), "read_id", "seq"), groups.kit_groups(RAPID)).select("read_id", "anno_idx", "match_type", "label", "strand", "flank_cost", "barcode_cost", "read_start_flank", "read_end_flank")


def residual_adapter_qc(spark, sf):
    got = demux(made.noisy_reads(_spread(spark, sf)), RAPID, maximize=True)
    return residual_adapters(got.trimmed, groups.kit_groups(RAPID)[0])


def residual_exact(spark, sf):
    """Untrimmed error-free reads: how many adapters each holds."""
    reads = made.planted_reads(_spread(spark, sf), "read_id", "label", "seq")
    bars = [kits.barcode(x) for x in kits.label_range("RBK01", "RBK96")]
    return normalised(reads, groups.kit_groups(RAPID)[0], bars).withColumn("barcode", F.coalesce("barcode", F.lit("none")))


def trimmed_ends(spark, sf):
    return synth.trimmed_ends(_orders(spark, sf)).select("read_id", F.length("seq").alias("bases"), F.md5("seq").alias("seq_md5"))


def kit_right_tags(spark, sf):
    return unmatched_tags(annotated(made.planted_reads(_spread(spark, sf), "read_id", "seq"), groups.kit_groups("SQK-RAB204"), carry=["read_id"]))


def demux_rapid(spark, sf):
    """The flagship: planted reads through the rapid kit, reads and bases a label."""
    return demux(made.planted_reads(_spread(spark, sf)), RAPID, maximize=True).summary()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        demux_rapid, fastq_header_split, reverse_complement, iupac_check, rel_dist, edit_cutoff, derive_reads_planted, listed_matches, barcode_label_ranges,
        kit_catalog, kit_catalog_expand, group_flanks, approx_min_cost, barcode_assign_margin, exact_planted_demux, planted_slices, overlap_collapse, overlap_collapse_half,
        cuts_roundtrip, filter_dropped, filter_again, inspect_read_pattern, inspect_topk, inspect_unique, pull_reads, label_variants, stage_counters, failed_reads,
        demux_noisy_recall, annotate_table, residual_adapter_qc, residual_exact, trimmed_ends, kit_right_tags,
    )
} | {name: _filter(p) for name, p in FILTERS.items()} | {
    "trim_pair": _trim(PAIR),
    "trim_single_cut": _trim(SINGLE),
    "trim_single_before": _trim(BEFORE),
    "trim_multi_group": _trim(MULTI),
    "trim_flip": _trim(PAIR, flip=True),
    "trim_skip": _trim(PAIR, skip_trim=True),
}
