from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """documents from (id, text) pairs, with further columns of names that operators use."""

    def make(pairs):
        rows = [(i, t, "en", "s", len(t or ""), "x", 7, -1) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", blob string, th long, kept int").coalesce(2)

    return make


@pytest.fixture
def prose():
    """Texts of invented words."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdeghilmnorstu") for _ in range(draw.randint(1, 9))) for _ in range(700)]

    def make(n):
        return " ".join(draw.choice(words) for _ in range(n))

    return make
