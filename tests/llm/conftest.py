"""Small tables with the awkward cases: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, k string, row int, digest string, label int, start int, key string, v double"


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows):
        """A documents table of (doc_id, text) with columns whose names the operators use inside."""
        return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), 7, "k", 1, "d", 2, 3, "x", 0.5) for i, t in rows], SCHEMA)

    return docs


@pytest.fixture(scope="session")
def awkward():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    passage = " ".join(r.choice(words) for _ in range(70))
    long = " ".join(r.choice(words) for _ in range(6000))
    texts = [None, "", " \n\t ", "One", "one", "one two three", "one  two\nthree", passage, passage, f"start {passage} end", f"{passage} {long}", long, f"x {long} y", "e\u0301 <|endoftext|> 🙂  \u00a0 z "]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(40)]
    rows = list(enumerate(texts, 10))
    return [*rows, rows[7], (None, passage), (None, None), (12, passage)]
