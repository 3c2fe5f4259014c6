"""Reads and match lists derived from the keys of `orders`: the driver's tables hold no DNA.

Everything is integer arithmetic and md5, so another engine can derive the same rows.
Scenarios of planted reads, by key modulo 6: 0 no adapter, 1 adapter at the left, 2 the same
with 10 nt cut off, 3 two adapters 10 nt apart, 4 a second adapter in the middle, 5 a reverse
complemented second adapter at the right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kits
from .functions.dna import reverse_complement

LEFT, RIGHT = kits.FLANKS["RBK4"]


def dna(key: Column, salt: str) -> Column:
    """32 nt from a key."""
    return F.translate(F.md5(F.concat(key.cast("string"), F.lit(salt))), "0123456789abcdef", "ACGTACGTACGTACGT")


def body(key: Column, blocks: int = 20) -> Column:
    return F.concat(*(dna(key, chr(97 + i)) for i in range(blocks)))


def quality(seq: Column, key: Column) -> Column:
    line = F.translate(F.md5(F.concat(key.cast("string"), F.lit("q"))), "0123456789abcdef", "56789:;<=>?@ABCD")
    return F.substring(F.repeat(line, 64), F.lit(1), F.length(seq))


def barcode_at(i: Column) -> Column:
    return F.element_at(F.array(*(F.lit(kits.barcode(x)) for x in kits.label_range("RBK01", "RBK96"))), (i + 1).cast("int"))


def label_at(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, kits.label_range("RBK01", "RBK96"))), (i + 1).cast("int"))


def planted_reads(orders: DataFrame) -> DataFrame:
    """read_id, desc, scenario, label (of the first adapter), seq, qual."""
    k = F.col("o_orderkey")
    adapter = lambda i: F.concat(F.lit(LEFT), barcode_at(i), F.lit(RIGHT))
    first, second = adapter(k % 96), adapter((k * 7 + 5) % 96)
    s, b = k % 6, body(k)
    seq = (
        F.when(s == 0, b)
        .when(s == 1, F.concat(first, b))
        .when(s == 2, F.concat(F.substring(first, F.lit(11), F.length(first)), b))
        .when(s == 3, F.concat(first, F.substring(b, 1, 10), second, b))
        .when(s == 4, F.concat(first, F.substring(b, 1, 320), second, F.substring(b, 321, 320)))
        .otherwise(F.concat(first, b, reverse_complement(second)))
    )
    out = orders.select(F.concat(F.lit("read"), k.cast("string")).alias("read_id"), F.concat(F.lit("order "), k.cast("string")).alias("desc"), s.cast("int").alias("scenario"), F.when(s > 0, label_at(k % 96)).alias("label"), seq.alias("seq"), k.alias("k"))
    return out.withColumn("qual", quality(F.col("seq"), F.col("k"))).drop("k")


def _hash(read_id: Column, i: int, salt: str) -> Column:
    return F.pmod(F.xxhash64(read_id, F.lit(i), F.lit(salt)), F.lit(1 << 30))


def noise(read_id: Column, edits: int) -> list[Column]:
    """How many edits a read gets; then place (modulo the length so far), base and kind of each."""
    each = [(_hash(read_id, i, "at"), _hash(read_id, i, "base") % 4, _hash(read_id, i, "kind") % 3) for i in range(edits)]
    return [c.cast("int") for c in (_hash(read_id, -1, "n") % (edits + 1), *(c for one in each for c in one))]


def noisy_reads(orders: DataFrame, edits: int = 6) -> DataFrame:
    """planted_reads with 0..edits edits at hash-chosen positions: a substitution, deletion or insertion each."""
    out = planted_reads(orders)
    n, *each = noise(F.col("read_id"), edits)
    seq = F.col("seq")
    for i in range(edits):
        place, base, kind = each[3 * i : 3 * i + 3]
        at = (1 + place % F.length("seq")).cast("int")
        base = F.element_at(F.array(*map(F.lit, "ACGT")), 1 + base)
        head, tail = F.substring(seq, F.lit(1), at - 1), F.substring(seq, at + 1, F.length(seq))
        here = F.substring(seq, at, F.lit(1))
        seq = F.when(i < n, F.concat(head, F.when(kind == 0, base).when(kind == 1, F.lit("")).otherwise(F.concat(here, base)), tail)).otherwise(seq)
        out, seq = out.withColumn("seq", seq), F.col("seq")
    return out.withColumn("qual", quality(F.col("seq"), F.col("read_id")))


def trimmed_ends(orders: DataFrame, most: int = 20) -> DataFrame:
    """listed_reads without 1..most nt at the left if the key is even, and at the right if a third of it is odd."""
    k = F.col("read_id").substr(F.lit(2), F.length("read_id")).cast("long")
    out = listed_reads(orders)
    left, right = F.when(k % 2 == 0, 1 + k * 13 % most).otherwise(0), F.when(F.floor(k / 3) % 2 == 1, 1 + k * 17 % most).otherwise(0)
    start, size = (1 + left).cast("int"), (F.length("seq") - left - right).cast("int")
    return out.withColumns({"seq": F.substring("seq", start, size), "qual": F.substring("qual", start, size)})


def match_lists(orders: DataFrame) -> DataFrame:
    """A flat table of 1 to 4 matches a read."""
    k = F.col("o_orderkey")
    base = orders.select(F.concat(F.lit("r"), k.cast("string")).alias("read_id"), k.alias("k"), (1000 + k % 997).cast("int").alias("read_len"), F.explode(F.sequence(F.lit(0), (k % 4).cast("int"))).alias("anno_idx"))
    k, i, n = F.col("k"), F.col("anno_idx"), F.col("read_len")
    s0 = k * 7 % 300
    second = F.when(k % 3 == 0, s0 + 60 + k * 13 % 220).when(k % 3 == 1, n - 40 - k * 11 % 280).otherwise(500)
    start = F.when(i == 0, s0).when(i == 1, second).when(i == 2, n - 40 - k * 5 % 260).otherwise(n - 38).cast("int")
    kind = F.when(i == 0, F.when(k % 11 == 0, "Fflank").when(k % 11 == 1, "Rtag").otherwise("Ftag")).otherwise(F.when((k + i) % 9 == 0, "Fflank").otherwise("Ftag"))
    strand = F.when(i == 0, F.when(k % 13 == 0, "Rc").otherwise("Fwd")).otherwise(F.when((k + i) % 2 == 0, "Rc").otherwise("Fwd"))
    t = base.withColumn("read_start_bar", start).withColumn("match_type", kind).withColumn("strand", strand)
    s = F.col("read_start_bar")
    label = F.when(F.col("match_type").endswith("flank"), "flank").otherwise(F.concat(F.lit("BC0"), ((k + i * (k % 2)) % 3 + 1).cast("string")))
    from .functions.dna import rel_dist_to_end

    flank = F.greatest(F.lit(0), s - 16)
    return t.select("read_id", "anno_idx", "read_len", rel_dist_to_end(flank, n).alias("rel_dist_to_end"), "read_start_bar", (s + 24).alias("read_end_bar"), flank.alias("read_start_flank"), F.least(n, s + 74).alias("read_end_flank"), s.alias("bar_start"), (s + 23).alias("bar_end"), "match_type", ((k + i) % 7).cast("int").alias("flank_cost"), ((k * 3 + i) % 5).cast("int").alias("barcode_cost"), label.alias("label"), "strand")


def listed_reads(orders: DataFrame) -> DataFrame:
    """The reads that match_lists describes: read_id, desc, seq, qual."""
    k = F.col("o_orderkey")
    out = orders.select(F.concat(F.lit("r"), k.cast("string")).alias("read_id"), F.lit("").alias("desc"), F.substring(F.repeat(dna(k, "a"), 63), F.lit(1), (1000 + k % 997).cast("int")).alias("seq"), k.alias("k"))
    return out.withColumn("qual", quality(F.col("seq"), F.col("k"))).drop("k")
