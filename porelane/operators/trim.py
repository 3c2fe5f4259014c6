"""Trim: cut reads at their marks, label the slices, and lay them out as FASTQ."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from ..schema import gathered, held


@dataclass(frozen=True)
class LabelConfig:
    include_label: bool = True
    include_orientation: bool = True
    include_flank: bool = True
    sort_labels: bool = False
    only_side: str | None = None  # left or right

    def __post_init__(self):
        if self.sort_labels and self.only_side:
            raise ValueError("sorting labels makes a single side ambiguous")
        if self.only_side not in (None, "left", "right"):
            raise ValueError(f"not a side: {self.only_side}")


def label(annos: Column, config: LabelConfig) -> Column:
    """The label of a slice from the matches that bound it."""
    if not config.include_label:
        return F.lit("none")
    if not config.include_flank:
        annos = F.filter(annos, lambda m: ~m["label"].contains("flank"))
    parts = F.transform(annos, lambda m: F.concat(m["label"], F.when(m["strand"] == "Fwd", "_fw").otherwise("_rc")) if config.include_orientation else m["label"])
    if config.sort_labels:
        parts = F.array_sort(parts)
    joined = F.get(parts, F.lit(0)) if config.only_side == "left" else F.get(parts, F.size(parts) - 1) if config.only_side == "right" else F.array_join(parts, "__")
    return F.when(F.size(parts) == 0, F.lit("none")).otherwise(joined)


def with_slices(reads: DataFrame, bases: Column | None = None) -> DataFrame:
    """reads (seq, matches, ...) with slices, in order of their cut groups: array of (start, end, annos).

    annos are indices of the matches that bound the slice. bases: a read's length, of seq by default.
    """
    bases = F.length("seq") if bases is None else bases
    none = F.array().cast("array<struct<direction:string,group_id:int,match_idx:int>>")

    def of_match(m: Column, i: Column) -> Column:
        return F.transform(F.coalesce(m["cuts"], none), lambda c: F.struct(m["read_start_flank"].alias("start"), m["read_end_flank"].alias("end"), c["direction"].alias("direction"), c["group_id"].alias("group_id"), i.alias("anno")))

    out = held(reads, "__cut", F.flatten(F.transform("matches", of_match)))
    cut = F.col("__cut")
    ids = F.array_distinct(F.transform(cut, lambda c: c["group_id"]))
    # groups in order of their first member's start, then of their number
    groups = F.array_sort(F.transform(ids, lambda g: F.struct(F.get(F.filter(cut, lambda c: c["group_id"] == g), F.lit(0))["start"].alias("start"), g.alias("id"))))
    out = held(out, "__members", F.transform(groups, lambda g: F.filter(cut, lambda c: c["group_id"] == g["id"])))
    members = F.col("__members")

    def slice_of(mine: Column, i: Column) -> Column:
        one, two = F.get(mine, F.lit(0)), F.get(mine, F.lit(1))
        edge = lambda c: F.when(c["direction"] == "Before", c["start"]).otherwise(c["end"])
        of = lambda start, end, *annos: F.struct(start.alias("start"), end.alias("end"), F.array(*annos).alias("annos"))
        # neighbours: the last member of the furthest end, the first of the nearest start
        earlier, later = F.get(members, i - 1), F.get(members, i + 1)
        before = F.aggregate(earlier, F.get(earlier, F.lit(0)), lambda x, c: F.when(c["end"] >= x["end"], c).otherwise(x))
        after = F.aggregate(later, F.get(later, F.lit(0)), lambda x, c: F.when(c["start"] < x["start"], c).otherwise(x))
        left = F.when(i > 0, of(before["end"], one["start"], before["anno"], one["anno"])).otherwise(of(F.lit(0), one["start"], one["anno"]))
        right = F.when(i < F.size(members) - 1, of(one["end"], after["start"], one["anno"], after["anno"])).otherwise(of(one["end"], bases, one["anno"]))
        single = F.when(one["direction"] == "Before", left).otherwise(right)
        return F.when(F.size(mine) == 2, of(edge(one), edge(two), one["anno"], two["anno"])).when(F.size(mine) == 1, single)

    return out.withColumn("slices", F.filter(F.transform(members, slice_of), lambda s: s.isNotNull())).drop("__cut", "__members")


def n_slices() -> Column:
    """How many slices are not empty."""
    return F.size(F.filter("slices", lambda s: s["start"] < s["end"]))


def trim_reads(reads: DataFrame, config: LabelConfig = LabelConfig(), skip_trim: bool = False, flip: bool = False) -> DataFrame:
    """reads (read_id, desc, seq, qual, matches) -> read_id, slice_idx, id, desc, seq, qual, label. No shuffle.

    Slices that are empty are left out, but count for the suffix of the id.
    """
    cut = with_slices(reads).select("read_id", "desc", "seq", "qual", "matches", F.posexplode("slices").alias("slice_idx", "s")).where("s.start < s.end")
    cut = cut.withColumn("annos", F.transform("s.annos", lambda i: F.get("matches", i)))
    start, size = F.col("s.start") + 1, F.col("s.end") - F.col("s.start")
    seq, qual = (F.col(c) if skip_trim else F.substring(c, start, size) for c in ("seq", "qual"))
    if flip:
        turn = F.exists("annos", lambda m: (m["match_type"] == "Ftag") & (m["strand"] == "Rc"))
        seq, qual = F.when(turn, reverse_complement(seq)).otherwise(seq), F.when(turn, F.reverse(qual)).otherwise(qual)
    name = F.concat("read_id", F.when(F.col("slice_idx") == 0, F.lit("")).otherwise(F.concat(F.lit("_"), F.col("slice_idx").cast("string"))))
    return cut.select("read_id", "slice_idx", name.alias("id"), "desc", seq.alias("seq"), qual.alias("qual"), label(F.col("annos"), config).alias("label"))


def _by_read(annotations: DataFrame) -> DataFrame:
    """Matches to be merged with reads: Spark takes a derived string for 20 bytes and would broadcast whole reads."""
    return gathered(annotations).hint("merge")


def with_reads(reads: DataFrame, annotations: DataFrame) -> DataFrame:
    """Reads that have matches, with them: one row a read. A read without quality raises."""
    qual = F.when(F.col("qual").isNull(), F.raise_error(F.concat(F.lit("read without quality: "), F.col("read_id"))).cast("string")).otherwise(F.col("qual"))
    return reads.select("read_id", "desc", "seq", qual.alias("qual")).join(_by_read(annotations), "read_id")


def trim(reads: DataFrame, annotations: DataFrame, config: LabelConfig = LabelConfig(), skip_trim: bool = False, flip: bool = False) -> DataFrame:
    return trim_reads(with_reads(reads, annotations), config, skip_trim, flip)


def pull(reads: DataFrame, annotations: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """Whole reads by label."""
    return trim(reads, annotations, config, skip_trim=True)


def slice_counts(reads: DataFrame, annotations: DataFrame) -> DataFrame:
    """read_id, n: how many slices each read with matches yields. Only lengths of reads travel."""
    sizes = reads.select("read_id", F.length("seq").alias("bases")).join(_by_read(annotations), "read_id")
    return with_slices(sizes, F.col("bases")).select("read_id", n_slices().alias("n"))


def failed(reads: DataFrame, annotations: DataFrame) -> DataFrame:
    """read_id of reads with matches that yield no slice."""
    return slice_counts(reads, annotations).where("n = 0").select("read_id")


def counters(reads: DataFrame, annotations: DataFrame) -> DataFrame:
    """step, metric, count: reads with matches, trimmed, split into several slices, and failed."""
    n = slice_counts(reads, annotations)
    total = n.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > 0).alias("trimmed"), F.count_if(F.col("n") > 1).alias("split"), F.count_if(F.col("n") == 0).alias("failed"))
    return total.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, total.columns)), F.array(*total.columns))).alias("metric", "count")).select(F.lit("trim").alias("step"), "metric", "count")


def fastq_text(trimmed: DataFrame) -> DataFrame:
    """label, record: one FASTQ record of four lines."""
    head = F.concat(F.lit("@"), F.col("id"), F.when(F.coalesce("desc", F.lit("")) != "", F.concat(F.lit(" "), F.col("desc"))).otherwise(F.lit("")))
    return trimmed.select("label", F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("record"))
