import random

import pytest

#: Columns whose names clash with those that the operators use inside.
EXTRA = "body string, doc string, n int, key string, row string, id string, text_hash string, kept string"


def odd_texts() -> list[tuple]:
    """(doc_id, text) with nulls, empties, repeated rows, ties and one long text."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega", "Éclair", "naïve", "zwölf"]
    prose = " ".join(rng.choice(words) for _ in range(60))
    long = "\n".join(" ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(12)) for _ in range(900))
    return [(None, prose), (1, None), (2, ""), (3, " \t\n \r\n"), (4, prose), (4, prose), (5, "one"),
            (6, prose + " more"), (7, long), (8, "a line of ten\nA LINE OF TEN  \nshort"),
            (9, "\n\n  a line of ten\n"), (None, None), (10, "###\t***\n" * 5)]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "x", "y", 1, "k", "r", "i", "h", "z") for i, t in odd_texts()]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
