"""Column functions for reads and match records; everything stays in the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_FROM, _TO = "ACGTRYKMBDHVacgtrykmbdhv", "TGCAYRMKVHDBtgcayrmkvhdb"


def reverse_complement(seq: Column) -> Column:
    """IUPAC reverse complement, case kept; other characters pass through."""
    return F.reverse(F.translate(seq, _FROM, _TO))


def header_id(header: Column) -> Column:
    return F.regexp_extract(header, r"(?U)^(\S*)", 1)


def header_description(header: Column) -> Column:
    """What follows the first white space, without leading white space; empty if nothing does."""
    return F.regexp_replace(F.substring(header, F.length(header_id(header)) + 1, F.length(header)), r"(?U)^\s+", "")


def rel_dist_to_end(pos: Column, read_len: Column) -> Column:
    """Signed distance of a position to the nearer end; never 0: 1 is the left end, -1 the right one."""
    near = F.when(pos == 0, 1).otherwise(pos)
    far = F.when(pos == read_len, -1).otherwise(pos - read_len)
    return F.when(pos < 0, 1).otherwise(F.when(pos <= F.floor(read_len / 2), near).otherwise(far)).cast("int")


def bucketed(pos: Column, size: int) -> Column:
    """0..size -> 0, size + 1..2 size -> size, and so on."""
    return (F.floor(F.greatest(pos - 1, F.lit(0)) / size) * size).cast("int")


def edit_cutoff(length: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(0.51 * length - 1.7312 * F.sqrt(length))).cast("int")


def is_iupac(seq: Column) -> Column:
    return seq.rlike("(?i)^[ACGTRYSWKMBDHVNX]+$")


def cuts_text(cuts: Column) -> Column:
    """`After(1):0,Before(1):2`; empty for null and for no cuts."""
    return F.coalesce(F.array_join(F.transform(cuts, lambda c: F.concat(c["direction"], F.lit("("), c["group_id"].cast("string"), F.lit("):"), c["match_idx"].cast("string"))), ","), F.lit(""))


def cuts_from_text(text: Column) -> Column:
    """The array of that text, null where it is empty; malformed cuts raise."""
    part = r"^(Before|After)\((\d+)\):(\d+)$"

    def one(t: Column) -> Column:
        good = F.when(t.rlike(part), t).otherwise(F.raise_error(F.concat(F.lit("malformed cut: "), t)).cast("string"))
        return F.struct(F.regexp_extract(good, part, 1).alias("direction"), F.regexp_extract(good, part, 2).cast("int").alias("group_id"), F.regexp_extract(good, part, 3).cast("int").alias("match_idx"))

    return F.when(F.coalesce(text, F.lit("")) != "", F.transform(F.split(text, ","), one))


def similar(overlap: Column, shorter: Column, threshold: float) -> Column:
    """overlap / shorter >= threshold in single precision."""
    return (overlap.cast("float") / shorter.cast("float")).cast("float") >= F.lit(float(np.float32(threshold))).cast("float")
