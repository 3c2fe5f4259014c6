import numpy as np
import pytest

# Rows with everything that can go wrong: nulls, empty and long texts, ties, repeated rows, clashing extra columns.
LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(30_000))
PASSAGE = " ".join(f"pass{i}" for i in range(60))
PLAIN = " ".join(f"plain{i}" for i in range(80))


def shaken(text, every, by="other"):
    return " ".join(w if i % every else f"{by}{i}" for i, w in enumerate(text.split()))


ROWS = [
    (1, PLAIN),
    (2, PLAIN),
    (2, PLAIN),
    (3, shaken(PLAIN, 60)),
    (4, shaken(PLAIN, 60, "third")),
    (5, None),
    (6, ""),
    (7, "  \t\n "),
    (8, "Two words"),
    (9, "two WORDS"),
    (10, "one"),
    (11, LONG),
    (12, LONG + " tail"),
    (13, "begin " + PASSAGE + " end of thirteen"),
    (14, "another start here " + PASSAGE),
    (None, PLAIN),
    (None, None),
    (15, "same " * 100),
    (16, "x" * 70_000),
    (17, "ünïcödé ▁ <|endoftext|> 　 wide space 漢字 😀\r\nline"),
    (18, "a b c d e f g h i j"),
    (19, "a b c d e f g h i j"),
]


@pytest.fixture(scope="session")
def rough(spark):
    """Rough documents with extra columns whose names operators use themselves."""
    names = "doc_id long, text string, n_words string, kept string, score string, cid string, part string, seq string, n string, component_id string, answers string, piece string, length string"
    return spark.createDataFrame([(d, t, *["x"] * 11) for d, t in ROWS], names).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def prose(spark):
    """A few hundred invented texts with copies, near copies and shared passages."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(600)]
    passage = " ".join(rng.choice(vocabulary, 45))
    rows = []
    for i in range(240):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 160))))
        if rows and i % 4 == 0:
            words = rows[int(rng.integers(0, len(rows)))][1].split()
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(0, len(words)))] = "changed"
        if i % 7 == 0:
            words[len(words) // 2 : 0] = passage.split()
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows
