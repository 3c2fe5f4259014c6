"""Filter: keep reads whose whole list of matches fits a pattern, and note where to cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Element, chosen, parse, pattern_cuts
from ..schema import MATCH, flat, gathered, held


def filter_reads(reads: DataFrame, patterns: list[list[Element]]) -> DataFrame:
    """reads (read_id, matches, ...) with cuts added and a column kept.

    The longest matching pattern, the first among equals, adds its cuts to those that are
    there; a read is kept if that pattern covers all its matches.  No shuffle.
    """
    if not patterns:
        raise ValueError("no patterns")
    picked = held(reads, "__pick", chosen(F.col("matches"), patterns))
    # the patterns' lengths and cuts are constant arrays, looked up by the pick
    of = lambda values: F.get(F.array(*values), F.col("__pick"))
    length, cuts = of([F.lit(len(p)) for p in patterns]), of([pattern_cuts(p) for p in patterns])
    picked = picked.withColumn("__cuts", cuts).withColumn("kept", F.coalesce(length == F.size("matches"), F.lit(False)))

    def marked(m, i):
        new = F.filter(F.col("__cuts"), lambda c: c["match_idx"] == i)
        return m.withField("cuts", F.when(F.size(new) > 0, F.concat(F.coalesce(m["cuts"], F.array().cast(MATCH["cuts"].dataType)), new)).otherwise(m["cuts"]))

    return picked.withColumn("matches", F.when(F.col("__cuts").isNotNull(), F.transform("matches", marked)).otherwise(F.col("matches"))).drop("__pick", "__cuts")


def filter_annotations(annotations: DataFrame, patterns: list[str] | list[list[Element]], lenient: bool = False) -> DataFrame:
    """The same for a flat table of matches: one shuffle, on read_id. Adds kept to every row."""
    parsed = [parse(p, lenient) if isinstance(p, str) else p for p in patterns]
    return flat(filter_reads(gathered(annotations), parsed), "kept")


def filter_from_pattern(annotations: DataFrame, pattern: str) -> DataFrame:
    return filter_annotations(annotations, [pattern])
