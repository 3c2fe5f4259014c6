"""Quality reports of trimmed reads, and a plain view of a query group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kits
from ..made import Made, stage
from .annotate import codes_of
from .kernel import Group, residual_group, residuals


def normalised(trimmed: DataFrame | Made, group: Group, bars: list[str] | None = None, flank_edits: int = 15, barcode_edits: int = 4, alpha: float = 0.5) -> DataFrame:
    """trimmed (id or read_id, label, seq) -> read_id, barcode, len, n_flank.

    n_flank: flank hits within flank_edits that hold a barcode within barcode_edits on the same strand.
    """
    bars = list(bars or kits.BC)
    name = "id" if "id" in trimmed.schema.names else "read_id"
    trimmed = trimmed if isinstance(trimmed, Made) else trimmed.select(name, "label", "seq")

    def run(batches):
        own = residual_group(group, bars, flank_edits)
        for batch in batches:
            codes, offsets = codes_of(batch.column("seq"))
            counts = residuals(codes, offsets, own, barcode_edits, alpha)
            yield pa.RecordBatch.from_arrays([batch.column(name), batch.column("label"), pa.array(np.diff(offsets), pa.int32()), pa.array(counts, pa.int32())], names=["read_id", "barcode", "len", "n_flank"])

    return stage(trimmed, "read_id string, barcode string, len int, n_flank int", run)


def residual_adapters(trimmed: DataFrame, group: Group, **how) -> DataFrame:
    """label, reads, residual: trimmed reads of each label, and those that still hold an adapter."""
    return normalised(trimmed, group, **how).groupBy(F.col("barcode").alias("label")).agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("n_flank") > 0).alias("residual"))


def fasta_text(reads: DataFrame) -> DataFrame:
    """One FASTA record a row of (id, seq)."""
    return reads.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), F.col("seq")).alias("record"))


def shown(group: Group, n: int = 2) -> str:
    """A group's flanks with its first barcodes below the place that they take."""
    lines = [group.prefix + "-" * (group.bar_region[1] - group.bar_region[0] + 1) + group.suffix]
    at = group.bar_region[0] - group.pad_region[0]
    size = group.bar_region[1] - group.bar_region[0] + 1
    for label, seq in list(zip(group.labels, group.seqs))[:n]:
        lines.append(f"{label}: ".ljust(max(len(group.prefix), len(label) + 3)) + seq[at : at + size])
    if len(group.labels) > n:
        lines.append(f"... and {len(group.labels) - n} more")
    return "\n".join(lines)
