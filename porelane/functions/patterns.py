"""The read pattern language: a parser, and a compiler to Catalyst columns.

pattern = element ("__" element)*
element = Type "[" parameter ("," parameter)* "]", Type one of Ftag, Rtag, Fflank, Rflank
parameter = fw | rc | @left(a..b) | @right(a..b) | @prev_left(a..b) | ?N | >>[N] | <<[N] | * | label | ~part

`>>` cuts after, `<<` before the match, in cut group N (0 by default); `?N` binds a label that
later `?N` must equal; positions are those of the barcode.  A pattern is anchored at a read's
first match.  Unreadable parameters raise; `lenient=True` ignores them, which leaves the
element less constrained.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = "Ftag", "Rtag", "Fflank", "Rflank"


@dataclass(frozen=True)
class Cut:
    direction: str  # Before or After
    group_id: int = 0


@dataclass(frozen=True)
class Element:
    kind: str
    strand: str | None = None
    label: str | None = None
    placeholder: int | None = None
    anchor: str | None = None  # left, right, prev_left
    low: int = 0
    high: int = 0
    cuts: tuple[Cut, ...] = field(default=())


def _parameter(text: str, lenient: bool) -> dict:
    if text in ("fw", "rc"):
        return {"strand": "Fwd" if text == "fw" else "Rc"}
    if text == "*":
        return {}
    if got := re.fullmatch(r"@(left|right|prev_left)\((-?\d+)\.\.(-?\d+)\)", text):
        return {"anchor": got[1], "low": int(got[2]), "high": int(got[3])}
    if got := re.fullmatch(r"\?(\d+)", text):
        return {"placeholder": int(got[1])}
    if got := re.fullmatch(r"(>>|<<)(\d*)", text):
        return {"cut": Cut("After" if got[1] == ">>" else "Before", int(got[2] or 0))}
    if text[:1] in "@?<>" or not text:
        if lenient:
            return {}
        raise ValueError(f"unreadable pattern parameter: {text!r}")
    return {"label": text}


def parse(text: str, lenient: bool = False) -> list[Element]:
    """The elements of a pattern."""
    out = []
    for part in text.strip().split("__"):
        got = re.fullmatch(r"\s*(\w+)\[(.*)\]\s*", part, re.S)
        if not got or got[1] not in KINDS:
            raise ValueError(f"unreadable pattern element: {part!r}")
        made, cuts = {}, []
        for parameter in got[2].split(","):
            for k, v in _parameter(parameter.strip(), lenient).items():
                if k == "cut":
                    cuts.append(v)
                else:
                    made[k] = v
        out.append(Element(got[1], cuts=tuple(cuts), **made))
    return out


def read_patterns(texts: list[str], lenient: bool = False) -> list[list[Element]]:
    """Patterns of text files: one a line, blank lines dropped; none at all is an error."""
    out = [parse(line, lenient) for text in texts for line in text.splitlines() if line.strip()]
    if not out:
        raise ValueError("no patterns")
    return out


def matches(a: Column, elements: list[Element]) -> Column:
    """Whether an array of matches begins with the pattern."""
    tests, first = [F.size(a) >= len(elements)], {}
    for i, e in enumerate(elements):
        m = F.get(a, F.lit(i))
        tests.append(m["match_type"] == e.kind)
        if e.label is not None and e.kind.endswith("tag"):
            tests.append(m["label"].contains(e.label[1:]) if e.label.startswith("~") else m["label"] == e.label)
        if e.placeholder is not None:
            j = first.setdefault(e.placeholder, i)
            if j != i:
                tests.append(m["label"] == F.get(a, F.lit(j))["label"])
        if e.strand is not None:
            tests.append(m["strand"] == e.strand)
        if e.anchor == "left":
            tests.append(m["read_start_bar"].between(e.low, e.high))
        elif e.anchor == "right":
            tests.append(m["read_end_bar"].between(m["read_len"] - e.high, m["read_len"] - e.low))
        elif e.anchor == "prev_left" and i:
            before = F.get(a, F.lit(i - 1))["read_end_bar"]
            tests.append(m["read_start_bar"].between(before + e.low, before + e.high))
    return F.coalesce(reduce(lambda x, y: x & y, tests), F.lit(False))


def chosen(a: Column, patterns: list[list[Element]]) -> Column:
    """Index of the longest matching pattern, the first among equals; null if none matches."""
    order = sorted(range(len(patterns)), key=lambda i: -len(patterns[i]))
    return F.coalesce(*(F.when(matches(a, patterns[i]), F.lit(i)) for i in order))


def pattern_cuts(elements: list[Element]) -> Column:
    cuts = [F.struct(F.lit(c.direction).alias("direction"), F.lit(c.group_id).alias("group_id"), F.lit(i).alias("match_idx")) for i, e in enumerate(elements) for c in e.cuts]
    return F.array(*cuts).cast("array<struct<direction:string,group_id:int,match_idx:int>>")
