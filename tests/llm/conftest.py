"""Small documents with every awkward case, and how to make a table of them."""

from __future__ import annotations

import random

import pytest

SYLLABLES = "the an in er on at ti es or en of ed is it al ar st to nt ng".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def make(spark):
    """``make(rows)``: a table of ``(doc_id, text)`` with clashing further columns."""

    def table(rows, source="a"):
        data = [(i, t, "en", s if s != "?" else None, None, "row", 1.5, "x", 3)
                for (i, t), s in zip(rows, source if len(source) == len(rows) else [source] * len(rows),
                                     strict=True)]
        return spark.createDataFrame(
            data, "doc_id long, text string, lang string, source string, n_chars long, "
                  "row string, score double, class string, n int")

    return table


@pytest.fixture(scope="session")
def empty(make):
    return make([])
