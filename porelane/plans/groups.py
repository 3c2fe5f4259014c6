"""Query groups: the build side of annotation, on the driver (a group has at most some hundred queries)."""

from __future__ import annotations

import math
import os
import re

from .. import kits
from ..operators.kernel import Group

PADDING = 10
KINDS = "Ftag", "Rtag", "Fflank", "Rflank"


def edit_cutoff(length: int) -> int:
    """Most edits that a flank of this many characters may have."""
    return max(0, math.ceil(0.51 * length - 1.7312 * math.sqrt(length)))


def common_prefix(seqs: list[str]) -> str:
    return os.path.commonprefix(seqs)


def common_suffix(seqs: list[str]) -> str:
    return os.path.commonprefix([s[::-1] for s in seqs])[::-1]


def build_group(seqs: list[str], labels: list[str], kind: str = "Ftag", cutoff: int | None = None) -> Group:
    """A group of equal-length <left flank><barcode><right flank> queries."""
    if kind not in KINDS[:2]:
        raise ValueError(f"not a query type: {kind}")
    if len(seqs) != len(labels) or not seqs:
        raise ValueError("queries and labels differ in number or are empty")
    seqs = [s.upper() for s in seqs]
    for s, label in zip(seqs, labels):
        if not re.fullmatch("[ACGTRYSWKMBDHVNX]+", s):
            raise ValueError(f"query {label} has characters outside the IUPAC alphabet")
    if len(seqs) == 1:
        raise ValueError("one query alone has no barcode region")
    if len({len(s) for s in seqs}) > 1:
        raise ValueError("queries differ in length")
    n, prefix = len(seqs[0]), common_prefix(seqs)
    if len(prefix) == n:
        raise ValueError("all queries are equal: no barcode region")
    suffix = common_suffix(seqs)
    if not prefix and not suffix:
        raise ValueError("queries share no flank")
    mask = n - len(prefix) - len(suffix)
    if mask < 1:
        raise ValueError("no barcode region is left between the flanks")
    p = len(prefix)
    pad = max(0, p - PADDING), p + mask + PADDING
    return Group(kind, prefix + "N" * mask + suffix, prefix, suffix, (p, p + mask - 1), pad, list(labels), [s[pad[0] : pad[1]] for s in seqs], edit_cutoff(len(prefix) + len(suffix)) if cutoff is None else cutoff)


def kit_groups(kit: str, use_extended: bool = False, cutoff: int | None = None) -> list[Group]:
    rows = kits.expanded(kit, use_extended)
    return [build_group([r[3] for r in mine], [r[2] for r in mine], mine[0][1], cutoff) for t in sorted({r[0] for r in rows}) if (mine := [r for r in rows if r[0] == t])]


def read_fasta(text: str) -> list[tuple[str, str]]:
    """(first word of the header, upper-case sequence) of every record."""
    out = []
    for record in re.split(r"^>", text, flags=re.M)[1:]:
        head, _, body = record.partition("\n")
        out.append(((head.split() or [""])[0], "".join(body.split()).upper()))
    return out


def fasta_groups(files: list[str], kinds: list[str], cutoff: int | None = None) -> list[Group]:
    """One group a FASTA file; paths are read on the driver."""
    if len(files) != len(kinds):
        raise ValueError(f"{len(files)} query files but {len(kinds)} types")
    out = []
    for path, kind in zip(files, kinds):
        with open(path, encoding="ascii") as f:
            records = read_fasta(f.read())
        out.append(build_group([s for _, s in records], [label for label, _ in records], kind, cutoff))
    return out
