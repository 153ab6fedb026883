import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, n: int) -> str:
    syllables = "an ber con del en for ga hin is ja ku lor men no or pre qua ri sta ter un ver wo xi yo zu".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows."""
    r = random.Random(5)
    long = prose(r, 30_000)
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (4, "one", "en", "b", 3), (5, long, "en", "b", len(long)),
        (6, "same text here for all of us", "en", "b", 28), (6, "same text here for all of us", "en", "b", 28), (None, "same text here for all of us", None, None, None),
        (7, "ünïcödé wörds — and\nlines\nlines", "de", "c", 31), (8, "x" * 5000, "en", "c", 5000),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
