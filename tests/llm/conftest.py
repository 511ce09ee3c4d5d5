import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, score double, _gone int, _quality int, _leaks int, _spans int"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, x, "s", len(t or ""), 1, 0.5, 1, 1, 1, 1) for i, t, x in rows], SCHEMA)


WORDS = "the river of stones and green hills in winter with open doors by night was quiet for travellers from far lands".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(1)
    base = prose(rng, 120)
    rows = [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, base + " end", None), (4, "", "en"), (5, None, None), (6, " \n\t ", "en"),
        (None, base, "en"), (7, "one", "en"), (8, "é漢🙂 " * 50, "xx"), (9, prose(rng, 30_000), "en"), (10, "x" * 40_000, "en"), (-5, "A B c d E f", "en"),
    ]
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).cache()
