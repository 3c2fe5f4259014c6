"""Sequencing kits: constant tables of barcodes, templates, kits and read patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

# The barcode sequences of the supported kits, BC01 to BC96.
BC = [
    "AAGAAAGTTGTCGGTGTCTTTGTG",
    "TCGATTCCGTTTGTAGTCGTCTGT",
    "GAGTCTTGTGTCCCAGTTACCAGG",
    "TTCGGATTCTATCGTGTTTCCCTA",
    "CTTGTCCAGGGTTTGTGTAACCTT",
    "TTCTCGCAAAGGCAGAAAGTAGTC",
    "GTGTTACCGTGGGAATGAATCCTT",
    "TTCAGGGAACAAACCAAGTTACGT",
    "AACTAGGCACAGCGAGTCTTGGTT",
    "AAGCGTTGAAACCTTTGTCCTCTC",
    "GTTTCATCTATCGGAGGGAATGGA",
    "CAGGTAGAAAGAAGCAGAATCGGA",
    "AGAACGACTTCCATACTCGTGTGA",
    "AACGAGTCTCTTGGGACCCATAGA",
    "AGGTCTACCTCGCTAACACCACTG",
    "CGTCAACTGACAGTGGTTCGTACT",
    "ACCCTCCAGGAAAGTACCTCTGAT",
    "CCAAACCCAACAACCTAGATAGGC",
    "GTTCCTCGTGCAGTGTCAAGAGAT",
    "TTGCGTCCTGTTACGAGAACTCAT",
    "GAGCCTCTCATTGTCCGTTCTCTA",
    "ACCACTGCCATGTATCAAAGTACG",
    "CTTACTACCCAGTGAACCTCCTCG",
    "GCATAGTTCTGCATGATGGGTTAG",
    "GTAAGTTGGGTATGCAACGCAATG",
    "CATACAGCGACTACGCATTCTCAT",
    "CGACGGTTAGATTCACCTCTTACA",
    "TGAAACCTAAGAAGGCACCGTATC",
    "CTAGACACCTTGGGTTGACAGACC",
    "TCAGTGAGGATCTACTTCGACCCA",
    "TGCGTACAGCAATCAGTTACATTG",
    "CCAGTAGAAGTCCGACAACGTCAT",
    "CAGACTTGGTACGGTTGGGTAACT",
    "GGACGAAGAACTCAAGTCAAAGGC",
    "CTACTTACGAAGCTGAGGGACTGC",
    "ATGTCCCAGTTAGAGGAGGAAACA",
    "GCTTGCGATTGATGCTTAGTATCA",
    "ACCACAGGAGGACGATACAGAGAA",
    "CCACAGTGTCAACTAGAGCCTCTC",
    "TAGTTTGGATGACCAAGGATAGCC",
    "GGAGTTCGTCCAGAGAAGTACACG",
    "CTACGTGTAAGGCATACCTGCCAG",
    "CTTTCGTTGTTGACTCGACGGTAG",
    "AGTAGAAAGGGTTCCTTCCCACTC",
    "GATCCAACAGAGATGCCTTCAGTG",
    "GCTGTGTTCCACTTCATTCTCCTG",
    "GTGCAACTTTCCCACAGGTAGTTC",
    "CATCTGGAACGTGGTACACCTGTA",
    "ACTGGTGCAGCTTTGAACATCTAG",
    "ATGGACTTTGGTAACTTCCTGCGT",
    "GTTGAATGAGCCTACTGGGTCCTC",
    "TGAGAGACAAGATTGTTCGTGGAC",
    "AGATTCAGACCGTCTCATGCAAAG",
    "CAAGAGCTTTGACTAAGGAGCATG",
    "TGGAAGATGAGACCCTGATCTACG",
    "TCACTACTCAACAGGTGGCATGAA",
    "GCTAGGTCAATCTCCTTCGGAAGT",
    "CAGGTTACTCCTCCGTGAGTCTGA",
    "TCAATCAAGAAGGGAAAGCAAGGT",
    "CATGTTCAACCAAGGCTTCTATGG",
    "AGAGGGTACTATGTGCCTCAGCAC",
    "CACCCACACTTACTTCAGGACGTA",
    "TTCTGAAGTTCCTGGGTCTTGAAC",
    "GACAGACACCGTTCATCGACTTTC",
    "TTCTCAGTCTTCCTCCAGACAAGG",
    "CCGATCCTTGTGGCTTCTAACTTC",
    "GTTTGTCATACTCGTGTGCTCACC",
    "GAATCTAAGCAAACACGAAGGTGG",
    "TACAGTCCGAGCCTCATGTGATCT",
    "ACCGAGATCCTACGAATGGAGTGT",
    "CCTGGGAGCATCAGGTAGTAACAG",
    "TAGCTGACTGTCTTCCATACCGAC",
    "AAGAAACAGGATGACAGAACCCTC",
    "TACAAGCATCCCAACACTTCCACT",
    "GACCATTGTGATGAACCCTGTTGT",
    "ATGCTTGTTACATCAACCCTGGAC",
    "CGACCTGTTTCTCAGGGATACAAC",
    "AACAACCGAACCTTTGAATCAGAA",
    "TCTCGGAGATAGTTCTCACTGCTG",
    "CGGATGAACATAGGATAGCGATTC",
    "CCTCATCTTGTGAAGTTGTTTCGG",
    "ACGGTATGTCGAGTTCCAGGACTA",
    "TGGCTTGATCTAGGTAAGGTCGAA",
    "GTAGTGGACCTAGAACCTGTGCCA",
    "AACGGAGGAGTTAGTTGGATGATC",
    "AGGTGATCCCAACAAGCGTAAGTA",
    "TACATGCTCCTGTTGTTAGGGAGG",
    "TCTTCTACTACCGATCCGAAGCAG",
    "ACAGCATCAATGTTTGGCTAGTTG",
    "GATGTAGAGGGTACGGTTTGAGGC",
    "GGCTCCATAGGAACTCACGCTACT",
    "TTGTGAGTGGAAAGATACAGGACC",
    "AGTTTCCATCACTTCAGACTTGGG",
    "GATTGTCCTCAAACTGCCACCTAC",
    "CCTGTCTGGAAGAAGAATGGACTT",
    "CTGAACGGTCATAGAGTCCACCAT",
]

# The amplicon barcode sequences, AB01 to AB24.
AB = [
    "GCACCTGGAACTTGTGCCTTCCAC",
    "CCGAAATAGGTTATCTGTTGTTGT",
    "ATCAATCGCTGGACGATGGATTAG",
    "CCACCCGCTCCTGCCGGTGGGCGT",
    "AGACTCTTGGGCTCGCCACGTCCC",
    "TCTGTATCCGGAGACGGGATGGAC",
    "TTTCGGATCAATCGACCGCAAACG",
    "ACTCAAACATTCTGTTAGATCGCG",
    "AAATGGAACCCGGATATGTTTACT",
    "TAAATCGACCTATGATGAACACAG",
    "ACATGTTGGAGTGAAAGTCGGGTA",
    "CCTGGACCACGATCATTGTAACAT",
    "TATGGTGGATCTCCCTCTATCTTC",
    "AAGTAAATGGGACGCCCACTCCGA",
    "TGTTCGCGGCTTGATCTAATATTA",
    "AGAGAGCTTCCCGGGAGGGTGGTC",
    "TTGTGAATATCTGTCACAAACACC",
    "CAATCGTACCAGGGAACATAAAGT",
    "CACACCCAAACAATATGGACCCGT",
    "AATAACCACATCCGCCCTCCGCAC",
    "TCCTAATAATGTGTAGATCGGTCC",
    "AGTCGATGGAACAAGAGAAGTTAT",
    "AAACTCACTGTATGTCGTTTCTAT",
    "TGACATCACTGATCGAGGAAGATC",
]

# The sequence of barcode 12A, and the rapid barcodes that differ from BC.
BC12A = "GTTGAGTTACAAAGCACCGATCAG"
RBK = {
    26: "ACTATGCCTTTCCGTGAAACAGTT",
    39: "TCTGCCACACACTCGTAAGTCCTT",
    40: "GTCGATACTGGACCTATCCCTTGG",
    48: "GAGTCCGTGACAACTTCTGAAAGC",
    54: "GGGTGCCAACTACATACCAAACCT",
    60: "GAACCCTACTTTGGACAGACACCT",
}

# The flanks of each template, before and after the barcode.
FLANKS = {
    "RAB_1ST": ("CCGTGAC", "AGAGTTTGATCATGGCTCAG"),
    "RAB_2ND": ("CCGTGAC", "CGGTTACCTTGTTACGACTT"),
    "RBK": ("TATTGCT", "GTTTTCGCATTTATCGTGAAACGCTTTCGCGTTTTTCGTGCGCCGCTTCA"),
    "RBK4": ("GCTTGGGTGTTTAACC", "GTTTTCGCATTTATCGTGAAACGCTTTCGCGTTTTTCGTGCGCCGCTTCA"),
    "RBK4_FUSION": ("TTCGTGCGCCGCTTCA", "GTTTTCGCATTTATCGTGAAACGCTTTCGCGTTTTTCGTGCGCCGCTTCA"),
    "RLB": ("CCGTGAC", "CGTTTTTCGTGCGCCGCTTC"),
    "BC_1ST": ("GGTGCTG", "TTAACCTTTCTGTTGGTGCTGATATTGC"),
    "BC_2ND": ("GGTGCTG", "TTAACCTACTTGCCTGTCGCTCTATCTTC"),
    "NB": ("ATTGCTAAGGTTAA", "CAGCACCT"),
    "LWB_1ST": ("CCGTGAC", "ACTTGCCTGTCGCTCTATCTTC"),
    "LWB_2ND": ("CCGTGAC", "TTTCTGTTGGTGCTGATATTGC"),
    "MAB": ("TTTAACC", "CCATATCCGTGTC"),
}


@dataclass(frozen=True)
class Template:
    flanks: str
    first: str
    last: str
    side: str = "Left"  # Left tags are Ftag, Right ones Rtag
    extended: bool = False
    use_12a: bool = False

    @property
    def kind(self) -> str:
        return "Ftag" if self.side == "Left" else "Rtag"

    @property
    def text(self) -> str:
        return "{BAR}".join(FLANKS[self.flanks])


def _both(name: str, first: str, last: str) -> list[Template]:
    return [Template(f"{name}_1ST", first, last), Template(f"{name}_2ND", first, last, "Right")]


# Templates of each kit family, and whether its patterns allow a label at either end.
FAMILIES: dict[str, tuple[list[Template], bool]] = {
    "16S": (_both("RAB", "BC01", "BC24"), True),
    "LWB": (_both("LWB", "BC01", "BC12"), True),
    "LWB24": (_both("LWB", "BC01", "BC24"), True),
    "NB12": ([Template("NB", "NB01", "NB12")], False),
    "NB13-24": ([Template("NB", "NB13", "NB24")], False),
    "NB24": ([Template("NB", "NB01", "NB24")], True),
    "NB96": ([Template("NB", "NB01", "NB96")], True),
    "RAB": (_both("RAB", "BC01", "BC12"), True),
    "PCR12": (_both("BC", "BC01", "BC12"), True),
    "PCR96": (_both("BC", "BC01", "BC96"), True),
    "RBK": ([Template("RBK", "BC01", "BC12")], False),
    "RBK4": ([Template("RBK4", "BC01", "BC12")], False),
    "RBK24": ([Template("RBK4", "RBK01", "RBK24")], False),
    "RBK96": ([Template("RBK4", "RBK01", "RBK96")], False),
    "RBK24_kit14": ([Template("RBK4", "RBK01", "RBK24")], False),
    "RBK096_kit14": ([Template("RBK4", "RBK01", "RBK96"), Template("RBK4_FUSION", "RBK01", "RBK96", extended=True)], False),
    "RLB": ([Template("RLB", "BC01", "BC12", use_12a=True)], False),
    "RPB24-Kit14": ([Template("RLB", "BC01", "BC24", use_12a=True)], True),
    "VMK": ([Template("RBK", "BC01", "BC04")], False),
    "VMK4": ([Template("RBK4", "BC01", "BC10")], False),
    "MAB": ([Template("MAB", "AB01", "AB24")], False),
}

# Kit names and their families.
KITS = {
    "SQK-16S024": "16S",
    "SQK-16S114-24": "16S",
    "SQK-LWB001": "LWB",
    "SQK-PBK004": "LWB",
    "SQK-PCB109": "LWB",
    "SQK-PCB110": "LWB",
    "SQK-PCB111-24": "LWB24",
    "SQK-PCB114-24": "LWB24",
    "EXP-NBD103": "NB12",
    "EXP-NBD104": "NB12",
    "EXP-NBD114": "NB13-24",
    "SQK-NBD111-24": "NB24",
    "SQK-NBD114-24": "NB24",
    "EXP-NBD114-24": "NB24",
    "SQK-HTB114-96": "NB96",
    "EXP-NBD196": "NB96",
    "SQK-MLK111-96-XL": "NB96",
    "SQK-NBD111-96": "NB96",
    "SQK-NBD114-96": "NB96",
    "SQK-MLK114-96-XL": "NB96",
    "EXP-PBC001": "PCR12",
    "EXP-PBC096": "PCR96",
    "SQK-RAB204": "RAB",
    "SQK-RAB201": "RAB",
    "SQK-RBK001": "RBK",
    "SQK-RBK110-96": "RBK96",
    "SQK-RBK111-96": "RBK96",
    "SQK-RBK114-96": "RBK096_kit14",
    "SQK-RBK111-24": "RBK24",
    "SQK-RBK114-24": "RBK24_kit14",
    "SQK-RBK004": "RBK4",
    "VSK-PTC001": "RBK4",
    "VSK-VPS001": "RBK4",
    "SQK-RPB004": "RLB",
    "SQK-RLB001": "RLB",
    "SQK-RPB114-24": "RPB24-Kit14",
    "VSK-VMK001": "VMK",
    "VSK-VMK004": "VMK4",
    "SQK-MAB114-24": "MAB",
}

# Read patterns, by label ends and mode; see functions/patterns.py for the grammar.
_LEFT = "Ftag[fw, *, @left(0..250), >>]"
_TWO_LEFT_SAME = "Ftag[fw, ?1, @left(0..250)]__Ftag[fw, ?1, @prev_left(0..250), >>]"
_TWO_LEFT = "Ftag[fw, *, @left(0..250)]__Ftag[fw, *, @prev_left(0..250), >>]"
_RIGHT = "Ftag[<<, rc, *, @right(0..250)]"
_BOTH_SAME = "Ftag[fw, ?1, @left(0..250), >>]__Ftag[<<, rc, ?1, @right(0..250)]"
PATTERNS = {
    ("single", "safe"): [_LEFT, _TWO_LEFT_SAME],
    ("single", "maximize"): [
        _LEFT,
        _TWO_LEFT_SAME,
        _TWO_LEFT,
        "Ftag[fw, *, @left(0..250), >>]__Ftag[<<, fw, *, @right(0..250)]",
        "Ftag[fw, *, @left(0..250)]__Ftag[fw, *, @prev_left(0..250), >>]__Ftag[<<, fw, *, @right(0..250)]",
    ],
    ("double", "safe"): [_LEFT, _RIGHT, _BOTH_SAME],
    ("double", "maximize"): [
        _LEFT,
        _RIGHT,
        _BOTH_SAME,
        "Ftag[fw, *, @left(0..250)]__Ftag[fw, ?1, @prev_left(0..250), >>]__Ftag[<<, rc, ?1, @right(0..250)]",
        "Ftag[fw, *, @left(0..250), >>]__Fflank[<<, rc, *, @right(0..250)]",
        "Fflank[fw, *, @left(0..250), >>]__Ftag[<<, rc, *, @right(0..250)]",
        _TWO_LEFT,
        "Ftag[fw, ?1, @left(0..250), >>]__Ftag[<<, fw, ?1, @right(0..250)]__Ftag[rc, *, @right(0..250)]",
        "Ftag[fw, *, @left(0..250)]__Ftag[rc, *, @prev_left(0..250)]__Ftag[fw, ?1, @prev_left(0..250), >>]__Ftag[<<, rc, ?1, @right(0..250)]",
    ],
}


def reverse_complement(seq: str) -> str:
    return seq[::-1].translate(str.maketrans("ACGTRYKMBDHVacgtrykmbdhv", "TGCAYRMKVHDBtgcayrmkvhdb"))


def parsed_label(label: str) -> tuple[str, int, bool]:
    """Prefix, number, and whether an A follows; any case."""
    got = re.match(r"([A-Z]*)([0-9]+)(A?)", label.upper())
    if not got:
        raise ValueError(f"no number in label {label}")
    return got[1], int(got[2]), bool(got[3])


def label_range(first: str, last: str, use_12a: bool = False) -> list[str]:
    """Labels from first to last in either order, as reads carry them."""
    (kind, a, a12), (other, b, b12) = parsed_label(first), parsed_label(last)
    if kind != other:
        raise ValueError(f"labels of two kinds: {first}, {last}")
    a, b = min(a, b), max(a, b)
    if not 1 <= a <= b <= (24 if kind == "AB" else 96):
        raise ValueError(f"labels out of range: {first}, {last}")
    with_12a = use_12a or ((a12 or b12) and a <= 12 <= b)
    if kind == "AB":
        return [f"AB{n:02d}" for n in range(a, b + 1)]
    out = []
    for n in range(a, b + 1):
        prefix = "NB" if kind == "NB" else "RBK" if kind == "RBK" and n in RBK else "BC"
        out.append(f"{prefix}{n:02d}" + ("A" if n == 12 and with_12a else ""))
    return out


def barcode(label: str) -> str | None:
    """The sequence of a label; None if there is none."""
    kind, n, is_a = parsed_label(label)
    if kind in ("BC", "NB") and is_a and n == 12:
        return BC12A
    if kind == "AB":
        return AB[max(0, n - 1)] if n <= 24 else None
    if kind not in ("BC", "NB", "BP", "RBK") or n > (24 if kind == "BP" else 96):
        return None
    seq = BC[max(0, n - 1)]
    if kind == "RBK":
        return RBK.get(n, seq)
    if kind == "BP":
        return f"C{seq}AC"
    # native barcodes 1 to 12 are read from the other strand
    return reverse_complement(seq) if kind == "NB" and n <= 12 else seq


def family(kit: str) -> str:
    name = kit if kit in KITS else kit.replace(".", "-")
    if name not in KITS:
        raise ValueError(f"unknown kit: {kit}")
    return KITS[name]


def templates(kit: str, use_extended: bool = False) -> list[Template]:
    return [t for t in FAMILIES[family(kit)][0] if use_extended or not t.extended]


def patterns(kit: str, maximize: bool = False) -> list[str]:
    return PATTERNS["double" if FAMILIES[family(kit)][1] else "single", "maximize" if maximize else "safe"]


def expanded(kit: str, use_extended: bool = False) -> list[tuple[int, str, str, str]]:
    """(template, kind, label, query sequence) of every query of a kit."""
    out = []
    for i, t in enumerate(templates(kit, use_extended)):
        out += [(i, t.kind, label, t.text.replace("{BAR}", barcode(label))) for label in label_range(t.first, t.last, t.use_12a)]
    return out
