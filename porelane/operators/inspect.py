"""Inspect: the structure of each read as pattern text, and how often each structure occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import bucketed
from ..schema import gathered


def structure(a: Column, size: int = 250) -> Column:
    """Pattern text of an array of matches; empty for none."""

    def span(name: str, low: Column, high: Column) -> Column:
        return F.concat(F.lit(f"@{name}("), low.cast("string"), F.lit(".."), high.cast("string"), F.lit(")"))

    def element(m: Column, i: Column) -> Column:
        start, end, n = m["read_start_bar"], m["read_end_bar"], m["read_len"]
        gap = F.greatest(start - F.get(a, i - 1)["read_end_bar"], F.lit(0))
        to_right = F.greatest(n - end, F.lit(0))
        right = span("right", bucketed(to_right, size), bucketed(F.greatest(n - start, F.lit(0)), size) + size)
        near = span("prev_left", bucketed(gap, size), bucketed(gap, size) + size)
        left = span("left", bucketed(start, size), bucketed(start, size) + size)
        where = F.when(i > 0, F.when(gap <= to_right, near).otherwise(right)).otherwise(F.when(m["rel_dist_to_end"] > 0, left).otherwise(right))
        forward = m["strand"] == "Fwd"
        cut = F.when(F.coalesce(F.size(m["cuts"]), F.lit(0)) > 0, F.when(forward, F.lit(", <<")).otherwise(F.lit(", >>"))).otherwise(F.lit(""))
        return F.concat(m["match_type"], F.lit("["), F.when(forward, "fw").otherwise("rc"), F.lit(", *"), cut, F.lit(", "), where, F.lit("]"))

    return F.array_join(F.transform(a, element), "__")


def read_patterns(annotations: DataFrame, size: int = 250) -> DataFrame:
    """read_id, pattern."""
    return gathered(annotations).select("read_id", structure(F.col("matches"), size).alias("pattern"))


def pattern_counts(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"))


def inspect(annotations: DataFrame, top_n: int = 10, size: int = 250) -> DataFrame:
    """The top_n most frequent patterns; ties in order of the text."""
    return pattern_counts(read_patterns(annotations, size)).orderBy(F.desc("count"), "pattern").limit(top_n)
