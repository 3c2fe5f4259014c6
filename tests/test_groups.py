"""Kits and query groups."""

import pytest

from porelane import kits
from porelane.plans import groups as g


def test_common_prefix_and_suffix():
    assert g.common_prefix(["ACGTAGAGAG", "ACGTAGACTA", "ACGAGCAGGA"]) == "ACG"
    assert g.common_suffix(["ACGTAGAGAGGGA", "ACGTTAGACTAGA", "ACGAGCAGGAGAA"]) == "A"


def test_regions_of_a_small_group():
    got = g.build_group(["AAATTTGGG", "AAACCCGGG"], ["a", "b"])
    assert (got.flank, got.bar_region, got.seqs) == ("AAANNNGGG", (3, 5), ["AAATTTGGG", "AAACCCGGG"])


@pytest.mark.parametrize(
    "seqs, why",
    [(["AAATTT"], "one query"), (["AAAT", "AAACC"], "length"), (["AAJT", "AACT"], "IUPAC"), (["AAAA", "CCCC"], "no flank"), (["AACC", "AACC"], "no barcode")],
)
def test_bad_queries(seqs, why):
    with pytest.raises(ValueError, match=why):
        g.build_group(seqs, [str(i) for i in range(len(seqs))])


def test_cutoffs():
    assert [g.edit_cutoff(n) for n in (66, 57, 36, 35, 29, 27, 22, 20)] == [20, 16, 8, 8, 6, 5, 4, 3]


@pytest.mark.parametrize(
    "kit, flanks, cutoff, pad, padded, perfect",
    [
        ("SQK-RBK114-96", (16, 50), 20, (6, 50), 44, 20.0),
        ("SQK-RBK001", (7, 50), 16, (0, 41), 41, 18.5),
        ("SQK-NBD114-96", (14, 8), 4, (4, 48), 42, 20.0),
        ("SQK-16S024", (7, 20), 5, (0, 41), 41, 18.5),
        ("SQK-PBK004", (7, 22), 6, (0, 41), 41, 18.5),
        ("EXP-PBC096", (7, 28), 8, (0, 41), 41, 18.5),
        ("SQK-MAB114-24", (7, 13), 3, (0, 41), 41, 18.5),
    ],
)
def test_derived_constants(kit, flanks, cutoff, pad, padded, perfect):
    got = g.kit_groups(kit)[0].prepared()
    assert ((len(got.prefix), len(got.suffix)), got.cutoff, got.pad_region, len(got.seqs[0]), round(got.perfect, 6)) == (flanks, cutoff, pad, padded, perfect)


def test_label_ranges():
    assert kits.label_range("BC01", "BC12")[-1] == "BC12"
    assert kits.label_range("BC01", "BC12", True)[-1] == kits.label_range("BC1A", "BC12A")[-1] == "BC12A"
    assert kits.label_range("BC1A", "BC13A")[-2:] == ["BC12A", "BC13"]
    assert kits.label_range("NB01", "NB12")[0] == "NB01"
    assert kits.label_range("RBK24", "RBK28") == ["BC24", "BC25", "RBK26", "BC27", "BC28"]
    assert kits.label_range("BC01", "BC24", True)[11] == "BC12A"
    with pytest.raises(ValueError):
        kits.label_range("BC01", "NB02")


def test_barcode_sequences():
    assert kits.barcode("bc12a").endswith("CACCGATCAG") and kits.barcode("NB13") == kits.barcode("BC13")
    assert kits.barcode("NB01") == kits.reverse_complement(kits.barcode("BC01"))
    assert kits.barcode("BP01") == "C" + kits.BC[0] + "AC" and kits.barcode("RBK26") != kits.barcode("BC26") and kits.barcode("XX1") is None


def test_kit_names():
    assert len(kits.KITS) == 39 and len(kits.FAMILIES) == 21
    assert kits.family("SQK-RBK114.96") == "RBK096_kit14"
    assert len(kits.templates("SQK-RBK114-96")) == 1 and len(kits.templates("SQK-RBK114-96", True)) == 2
    with pytest.raises(ValueError, match="unknown kit"):
        kits.family("NOPE")


def test_fasta(tmp_path):
    path = tmp_path / "q.fasta"
    path.write_text(">a some words\nAAAT\nTTGGG\n>b\naaacccggg\n")
    got = g.fasta_groups([str(path)], ["Rtag"], 2)[0]
    assert (got.labels, got.kind, got.cutoff, got.seqs[1]) == (["a", "b"], "Rtag", 2, "AAACCCGGG")
    with pytest.raises(ValueError, match="types"):
        g.fasta_groups([str(path), str(path)], ["Ftag"])


def test_a_group_can_be_shown():
    from porelane.operators.report import shown

    text = shown(g.kit_groups("SQK-RBK001")[0]).splitlines()
    assert text[0].startswith("TATTGCT" + "-" * 24 + "GTTTT") and text[1] == "BC01:  " + kits.BC[0] and text[-1] == "... and 10 more"
