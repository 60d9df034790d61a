"""A statistical hash embedding of texts, as a vectorised function.

A token stands for itself, its character 3-grams in order and, from five letters on, its
first and last five. The k-th of these adds 1 / k times the token's weight to the slot that
the polynomial hash of its characters (base 131) names, with the sign of the parity of the
sum of its characters. A running modulus can't be folded by column expressions at this
volume, so it runs in Arrow batches: texts are counted one by one, and the distinct tokens
of about ``BLOCK`` counts are cut and hashed at once, as arrays of code points. So memory is
that of one block and one text, whatever a batch holds.

Defined results: null texts and texts without tokens have a zero vector; texts are read
whole; an empty column gives an empty column.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[\w\-/\.]+")
BASE = 131
#: Counted tokens that are cut, hashed and added at once: 32,768.
BLOCK = 1 << 15
#: Widths of the arrays of code points, which are as wide as their longest token; longer tokens are hashed one by one.
WIDTHS = (0, 8, 16, 64)
#: Words that count on an axis of their own: fixed values.
AXES = (
    ("api", "openapi", "endpoint", "rest", "graphql"),
    ("postgres", "database", "pgvector", "sql", "schema"),
    ("service", "component", "module", "backend", "frontend"),
    ("rule", "must", "shall", "required", "обязан", "должен"),
    ("integration", "event", "queue", "message", "broker"),
    ("risk", "constraint", "assumption", "nfr", "latency"),
)
#: What a word of an axis adds there: a fixed value.
AXIS_WEIGHT = 0.75


def _horner(codes: np.ndarray, length: int) -> np.ndarray:
    """The slot of each row of code points; zeros at its end don't count."""
    slot = np.zeros(len(codes), np.int64)
    for column in codes.T:
        slot = np.where(column > 0, (slot * BASE + column) % length, slot)
    return slot


def stands_for(tokens: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(slots, shares, counts)``: what each token stands for, one token after the other."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    counts = 1 + np.maximum(sizes - 2, 0) + 2 * (sizes >= 5)
    begins = counts.cumsum() - counts
    slots, sums = np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
    for low, high in zip(WIDTHS, WIDTHS[1:], strict=False):
        at = np.flatnonzero((sizes > low) & (sizes <= high))
        codes = np.array([tokens[k] for k in at], dtype=f"U{high}").view(np.uint32).reshape(len(at), high).astype(np.int64)
        slots[begins[at]], sums[begins[at]] = _horner(codes, length), codes.sum(axis=1)
        row, k = np.nonzero(np.arange(high - 2) < sizes[at, None] - 2)
        grams = np.stack([codes[row, k + i] for i in range(3)], axis=1)
        slots[begins[at][row] + 1 + k], sums[begins[at][row] + 1 + k] = _horner(grams, length), grams.sum(axis=1)
        row = np.flatnonzero(sizes[at] >= 5)
        for nth, start in enumerate((np.zeros(len(row), np.int64), sizes[at][row] - 5)):
            ends = codes[row[:, None], start[:, None] + np.arange(5)]
            place = begins[at][row] + sizes[at][row] - 1 + nth
            slots[place], sums[place] = _horner(ends, length), ends.sum(axis=1)
    for t in np.flatnonzero(sizes > WIDTHS[-1]):
        token = tokens[t]
        for k, part in enumerate(chain([token], (token[a : a + 3] for a in range(len(token) - 2)), [token[:5], token[-5:]])):
            slot = 0
            for c in map(ord, part):
                slot = (slot * BASE + c) % length
            slots[begins[t] + k], sums[begins[t] + k] = slot, sum(map(ord, part))
    nth = np.arange(len(slots)) - np.repeat(begins, counts) + 1
    return slots, np.where(sums % 2 == 0, 1.0, -1.0) / nth, counts


def embeddings(texts: pd.Series, length: int) -> np.ndarray:
    """A unit vector of each whole text."""
    out, held, on_axis = np.zeros((len(texts), length)), [], []
    number: dict[str, int] = {}
    full = 0

    def add() -> None:
        slots, shares, counts = stands_for(list(number), length)
        token, weight = np.concatenate([t for _, t, _ in held]), np.concatenate([w for *_, w in held])
        row = np.repeat([r for r, *_ in held], [len(w) for *_, w in held])
        n, begins = counts[token], counts.cumsum() - counts
        at = np.repeat(begins[token] - (n.cumsum() - n), n) + np.arange(n.sum())
        np.add.at(out.reshape(-1), np.repeat(row * length, n) + slots[at], np.repeat(weight, n) * shares[at])
        held.clear()
        number.clear()

    for row, text in enumerate(texts.fillna("")):
        uses = Counter(map(str.lower, map(re.Match.group, _TOKEN.finditer(text))))
        tokens, most, at = sorted(uses), max(uses.values(), default=1), 0
        while at < len(tokens):
            part = tokens[at : at + BLOCK - full]
            counted = np.fromiter(map(uses.__getitem__, part), np.float64, len(part))
            held.append((row, np.fromiter((number.setdefault(t, len(number)) for t in part), np.int64, len(part)), 0.5 + 0.5 * counted / most))
            at, full = at + len(part), full + len(part)
            if full >= BLOCK:
                add()
                full = 0
        on_axis += [(row, axis) for axis, lexicon in enumerate(AXES[:length]) for word in lexicon if word in uses]
    if held:
        add()
    for row, axis in on_axis:
        out[row, axis] += AXIS_WEIGHT
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def hash_embedding(length: int = 64):
    """A column function from text to ``array<double>``."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embeddings(texts, length)), index=texts.index)

    return run
