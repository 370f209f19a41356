import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (id, text) to a documents frame with columns that clash with names the operators use."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), 1, "x", 0.5) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA + ", row_ int, fp string, kept_ double")

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    passage = words(60, 1)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, passage),
        (5, words(80, 2) + "\n" + passage + " " + words(20, 3)),
        (6, passage),
        (6, passage),
        (None, words(55, 4)),
        (None, None),
        (7, words(9000, 5)),
        (8, "Don't  stop\r\n  the café's 12½　中文 \U0001f600 it's 'll we'll   "),
        (9, "a <|endoftext|> b Ᲊ c"),
        (10, "one " * 200),
        (11, words(40, 6).upper()),
    ]
