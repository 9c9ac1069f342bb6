import datetime as dt

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, label int, words int"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows every operator must stand: null and empty texts, null ids and sources, a long text, ties, repeats, clashing columns."""
    long_text = "word other thing " * 20_000
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a"), (2, "alpha beta gamma delta epsilon zeta", "en", "a"), (2, "alpha beta gamma delta epsilon zeta", "en", "a"),
            (3, None, None, None), (4, "", "en", "b"), (5, " \t\n", "en", "b"), (None, "one two", "en", None), (6, "one two", "de", "c"), (7, long_text, "en", "a"),
            (8, "ONE Two", "en", "c"), (9, "▁ mark é中\U0001F600 joe@mail.example.com +1 (988) 555-2485", "en", "b")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "n", 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def ts(text):
    """As in ../conftest.py: whichever of the two files is loaded last is the tests' ``conftest``."""
    return dt.datetime.fromisoformat(text)
