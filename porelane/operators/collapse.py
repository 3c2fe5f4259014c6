"""Overlap collapse: of matches whose flanks overlap, the best one stays. A fold over each read's array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import similar
from ..schema import MATCH, flat, gathered, held


def best_of(group: Column) -> Column:
    """Tags before flanks; tags by barcode, then flank cost; flanks by length; then the earlier one."""
    tag = lambda m: m["match_type"].endswith("tag")
    ranked = F.transform(group, lambda m, i: F.struct(F.when(tag(m), 0).otherwise(1).alias("a"), F.when(tag(m), m["barcode_cost"]).otherwise(m["read_start_flank"] - m["read_end_flank"]).alias("b"), F.when(tag(m), m["flank_cost"]).otherwise(0).alias("c"), i.alias("d"), m.alias("m")))
    # structs compare field by field; the position decides before the match itself is looked at
    return F.array_min(ranked)["m"]


def collapsed(a: Column, threshold: float = 0.8) -> Column:
    """Matches sorted by flank start, in groups: one joins the open group if it overlaps any member."""
    order = F.array_sort(F.transform(a, lambda m, i: F.struct(m["read_start_flank"].alias("s"), i.alias("i"), m.alias("m"))))
    kind = MATCH.simpleString()
    empty = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(f"array<{kind}>").alias("open"))

    def overlaps(g: Column, m: Column) -> Column:
        shared = F.least(g["read_end_flank"], m["read_end_flank"]) - F.greatest(g["read_start_flank"], m["read_start_flank"])
        shorter = F.least(g["read_end_flank"] - g["read_start_flank"], m["read_end_flank"] - m["read_start_flank"])
        return (shared > 0) & similar(shared, F.nullif(shorter, F.lit(0)), threshold)

    def step(acc: Column, x: Column) -> Column:
        joins = (F.size(acc["open"]) == 0) | F.exists(acc["open"], lambda g: F.coalesce(overlaps(g, x["m"]), F.lit(False)))
        return F.when(joins, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x["m"])).alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(best_of(acc["open"]))).alias("done"), F.array(x["m"]).alias("open")))

    return F.aggregate(order, empty, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(best_of(acc["open"])))).otherwise(acc["done"]))


def collapse_reads(reads: DataFrame, threshold: float = 0.8) -> DataFrame:
    # a match alone needs no fold
    return held(reads, "matches", F.when(F.size("matches") <= 1, F.col("matches")).otherwise(collapsed(F.col("matches"), threshold)))


def collapse_annotations(annotations: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The same for a flat table; anno_idx is numbered anew, in group order."""
    return flat(collapse_reads(gathered(annotations), threshold))
