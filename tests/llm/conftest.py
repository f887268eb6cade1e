"""Documents with nulls, empty texts, ties, repeated rows, a long text, and columns whose names clash with the operators' own."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, th string, fp long, key string, score string, size long"
WORDS = [f"wort{i}" for i in range(400)]


def rows():
    base = " ".join(WORDS[:60])
    other = " ".join(WORDS[100:180])
    texts = [
        (1, base), (2, base), (3, " ".join(WORDS[:30] + ["neu"] + WORDS[31:60])), (4, other), (4, other), (5, None), (6, ""), (7, "  \n\t"), (8, "ein"), (9, "Ein  ZWEI"),
        (None, other), (10, " ".join(WORDS[200:230] + WORDS[100:130] + WORDS[200:230])), (11, "é" * 50 + " ß x\u00a0y\x85z"), (12, " ".join(WORDS[i % 7] for i in range(300))),
        (13, " ".join(WORDS * 30)), (14, "you 1d10t"), (None, None), (15, "x " * 40),
    ]
    return [(i, t, "en", s, None if t is None else len(t), "c", "c", 1, "c", "c", 1) for (i, t), s in zip(texts, ["a", "b", None, "a", "a", "é"] * 3, strict=True)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def texts():
    return [(r[0], r[1]) for r in rows()]
