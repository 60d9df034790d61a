"""Caches of the Python workers, which outlive tasks."""

from __future__ import annotations

from tessera.llm import bpe, packing, quality, substrings
from test_texts import VOCABULARY


def test_a_worker_holds_the_caches_of_one_step():
    def entries():
        return [len(c) + len(c.old) for c in (quality._shapes, substrings._made[0].hashes, packing._loaded[VOCABULARY].pieces)]

    quality._begin()
    shapes = [quality.slots(w) for w in ("Some", "words-2")]
    windows = substrings.windows()
    hashes = [windows.hashes[w] for w in (b"some", b"words")]
    tokens = packing._tokens(VOCABULARY)
    ids = tokens("some words")
    assert [n > 0 for n in entries()] == [False, False, True]
    assert [substrings.windows().hashes[w] for w in (b"some", b"words")] == hashes
    assert [n > 0 for n in entries()] == [False, True, False]
    # results stay, and so do the entries of the step's next task
    substrings.windows()
    assert entries()[1] == 2 and packing._tokens(VOCABULARY)("some words") == ids
    quality._begin()
    assert [quality.slots(w) for w in ("Some", "words-2")] == shapes and bpe._held == [quality._shapes]
