"""Annotate: approximate join of reads with query groups, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..made import Made, stage
from ..plans.groups import PADDING
from ..schema import FIELDS, MATCH, flat
from .collapse import collapse_reads
from .kernel import CODE, STRANDS, Group, annotate_columns

_CUT = pa.list_(pa.struct([("direction", pa.string()), ("group_id", pa.int32()), ("match_idx", pa.int32())]))
_ARROW = {T.IntegerType(): pa.int32(), T.StringType(): pa.string(), MATCH["cuts"].dataType: _CUT}
_MATCH = pa.struct([(f.name, _ARROW[f.dataType]) for f in MATCH.fields])


def codes_of(seq: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a column of strings in one array, and where each begins; null is empty."""
    seq = (seq.fill_null("") if seq.null_count else seq).cast(pa.large_string())
    _, offsets, data = seq.buffers()
    offsets = np.frombuffer(offsets, np.int64)[seq.offset : seq.offset + len(seq) + 1] if len(seq) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return CODE[data], offsets - offsets[0]


def _records(found: dict[str, np.ndarray], groups: list[Group]) -> pa.Array:
    """Match records from columns of numbers."""
    base = np.concatenate([[0], np.cumsum([len(g.labels) for g in groups])])
    valid = found["label"] >= 0
    labels, kinds = [x for g in groups for x in g.labels] + ["flank"], [k for g in groups for k in (g.kind, g.kind[0] + "flank")]
    text = {
        "label": (labels, np.where(valid, base[found["group"]] + found["label"], len(labels) - 1)),
        "match_type": (kinds, 2 * found["group"] + ~valid),
        "strand": (STRANDS, found["strand"]),
    }
    column = lambda k: pa.nulls(len(valid), _CUT) if k == "cuts" else pa.array(text[k][0], pa.string()).take(pa.array(text[k][1])) if k in text else pa.array(found[k], pa.int32())
    return pa.StructArray.from_arrays([column(k) for k in FIELDS], fields=list(_MATCH))


def annotated(reads: DataFrame | Made, groups: list[Group], alpha: float = 0.4, min_score: float = 0.2, min_diff: float = 0.1, collapse: bool = True, overlap: float = 0.8, carry: list[str] | None = None) -> DataFrame:
    """reads (read_id, seq, ...) with matches: array of match records; reads without a match leave.

    One narrow stage: the groups travel with the task (some hundred short strings), a read's
    columns are carried through, so nothing is joined or shuffled afterwards.  carry: only these.
    """
    if not groups:
        raise ValueError("no query groups")
    kept = [f for f in reads.schema.fields if carry is None or f.name in carry]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("matches", T.ArrayType(MATCH))])

    def run(batches):
        seen: dict = {}
        for batch in batches:
            found = annotate_columns(*codes_of(batch.column("seq")), groups, alpha, min_score, min_diff, PADDING, seen=seen)
            count = np.bincount(found["read"], minlength=batch.num_rows)
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[count > 0])]), pa.int32()), _records(found, groups))
            out = batch.select(names).filter(pa.array(count > 0))
            yield pa.RecordBatch.from_arrays([*out.columns, rows], names=[*names, "matches"])

    out = stage(reads, schema, run)
    return collapse_reads(out, overlap) if collapse else out


def annotate(reads: DataFrame | Made, groups: list[Group], **how) -> DataFrame:
    """The flat table of matches: read_id, the match's fields, anno_idx. Sequences don't come back."""
    reads = reads if isinstance(reads, Made) else reads.select("read_id", "seq")
    return flat(annotated(reads, groups, **how, carry=["read_id"]))
