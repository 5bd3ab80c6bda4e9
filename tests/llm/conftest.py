import random

import pytest

WORDS = [a + b for a in "ka lo mi re tu sen vor".split() for b in "ba di no ru pel".split()]


@pytest.fixture(scope="session")
def prose():
    """Texts of known words, the same for the same seed."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """documents-like rows from (doc_id, text), with columns whose names clash with results."""

    def make(rows, **columns):
        rows = [(i, t, "en", "s", len(t or ""), 7, "x", 0.5, "y") for i, t in rows]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, size int, score string, taken double, cid string")

    return make
