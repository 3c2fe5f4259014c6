"""A kit from reads to labelled slices, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kits
from ..functions.patterns import parse
from ..made import Made
from ..operators.annotate import annotated
from ..operators.filter import filter_reads
from ..operators.inspect import pattern_counts, structure
from ..operators.trim import LabelConfig, trim_reads
from .groups import kit_groups

#: labels only, from the left side
LABELS = LabelConfig(include_orientation=False, include_flank=False, only_side="left")


@dataclass
class Demux:
    annotated: DataFrame  # read_id, desc, seq, qual, matches
    patterns: DataFrame  # pattern, count
    filtered: DataFrame  # annotated with cuts, and kept
    trimmed: DataFrame

    def summary(self) -> DataFrame:
        return self.trimmed.groupBy("label").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).cast("long").alias("bases"))


def demux(reads: DataFrame | Made, kit: str, maximize: bool = False, use_extended: bool = False, flank_max_errors: int | None = None, alpha: float = 0.4, min_score: float = 0.2, min_diff: float = 0.1, flip: bool = False, keep: bool = False) -> Demux:
    """reads (read_id, desc, seq, qual) through a kit. Sequences travel with their matches, so nothing is shuffled.

    keep: persist the annotated reads, for callers that use several of the results.
    """
    groups = kit_groups(kit, use_extended, flank_max_errors)
    columns = ["read_id", "desc", "seq", "qual"]
    found = annotated(reads if isinstance(reads, Made) else reads.select(columns), groups, alpha, min_score, min_diff, carry=columns)
    if keep:
        found = found.persist()
    filtered = filter_reads(found, [parse(p) for p in kits.patterns(kit, maximize)])
    trimmed = trim_reads(filtered.where("kept").drop("kept"), LABELS, flip=flip)
    counts = pattern_counts(found.select(structure(F.col("matches")).alias("pattern")))
    return Demux(found, counts, filtered, trimmed)


def unmatched_tags(found: DataFrame) -> DataFrame:
    """Reads with a tag or flank of the right template, which no built-in pattern names."""
    return found.where(F.exists("matches", lambda m: m["match_type"].startswith("R"))).agg(F.count(F.lit(1)).alias("reads"))
