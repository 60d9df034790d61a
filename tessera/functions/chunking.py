"""Chunking of one text. These folds depend on order, so they are plain functions that
``operators.chunks`` runs over the rows of a table.

A text is cut to sections by its headings, a section to units (paragraphs, bullets,
table blocks, API operations), long units to sentences and words, and the units are
packed into windows of a target number of words that overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

HEADING = re.compile(r"^(#+\s+.+|\d+(?:\.\d+)*\s+.+|[A-Z][^\n]{0,80}:)$", re.MULTILINE)
BULLET = re.compile(r"\n\s*(?:[-*•]|\d+[\).])\s+")
OPERATION = re.compile(r"(?=\b(?:GET|POST|PUT|PATCH|DELETE)\s+/)")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Words of a chunk by kind of document: fixed values.
TARGET_WORDS = {"normative": 320, "api": 360, "architecture": 480, "technology": 420, "other": 400}
LEAST_TARGET = 120


@dataclass(frozen=True)
class Chunk:
    number: int
    title: str
    content: str
    location: str


def words(text: str) -> int:
    return len(text.split())


def sections(text: str) -> list[tuple[str, str]]:
    """``(heading, body)``; what stands before the first heading has none."""
    found, at, heading = [], 0, ""
    for m in HEADING.finditer(text):
        if heading or text[at : m.start()].strip():
            found.append((heading, text[at : m.start()].strip()))
        heading, at = m[0].strip(), m.end()
    if heading or text[at:].strip():
        found.append((heading, text[at:].strip()))
    return found


def is_tabular(text: str) -> bool:
    return sum(" | " in line or bool(re.search(r"\|.+\|", line)) for line in text.splitlines()) >= 2


def paragraphs(text: str) -> list[str]:
    """Paragraphs; those with bullets are cut at each."""
    return [item for p in re.split(r"\n\s*\n", text) for item in map(str.strip, BULLET.split(p.strip())) if item]


def table_blocks(text: str) -> list[str]:
    """Neighbouring lines that are all in a table, or all not."""
    blocks: list[tuple[bool, list[str]]] = []
    for line in filter(str.strip, text.splitlines()):
        inside = " | " in line or bool(re.search(r"\|.+\|", line))
        if not blocks or blocks[-1][0] != inside:
            blocks.append((inside, []))
        blocks[-1][1].append(line.rstrip())
    return ["\n".join(lines) for _, lines in blocks]


def _fits(text: str, most: int, target: int) -> bool:
    return len(text) <= most and words(text) <= target


def fitted(unit: str, most: int, target: int) -> Iterator[str]:
    """A unit in parts that fit: whole sentences together, a long sentence by words."""
    if _fits(unit, most, target):
        yield unit
        return
    held: list[str] = []
    for sentence in filter(None, map(str.strip, SENTENCE.split(unit))):
        for part in [sentence] if _fits(sentence, most, target) else sentence.split():
            if held and not _fits(" ".join([*held, part]), most, target):
                yield " ".join(held)
                held = []
            held.append(part)
    if held:
        yield " ".join(held)


def windows(units: list[str], target: int, overlap: int) -> list[str]:
    """Units in order in windows of up to ``target`` words (one unit at least); the next
    window goes back by units until ``overlap`` words are repeated, and always forward."""
    sizes, found, start = [words(u) for u in units], [], 0
    while start < len(units):
        end, total = start + 1, sizes[start]
        while end < len(units) and total < target and total + sizes[end] <= target:
            total += sizes[end]
            end += 1
        window = "\n\n".join(units[start:end])
        if not found or found[-1] != window:
            found.append(window)
        if end == len(units):
            break
        back, repeated = end, 0
        while overlap > 0 and back > start + 1 and repeated < overlap:
            back -= 1
            repeated += sizes[back]
        start = back if overlap > 0 else end
    return found


def chunk(text: str | None, kind: str = "other", target: int | None = None, overlap: int | None = None, most: int = 1200) -> list[Chunk]:
    """The chunks of a whole text by its kind of document."""
    text = (text or "").strip()
    if not text:
        return []
    target = max(LEAST_TARGET, target or TARGET_WORDS.get(kind, TARGET_WORDS["other"]))
    overlap = max(12, round(target * 0.05)) if overlap is None else max(0, overlap)
    found: list[Chunk] = []
    tabular = kind not in ("normative", "architecture", "api") and is_tabular(text)
    parts = [("", text)] if tabular else sections(text)
    for s, (heading, body) in enumerate(parts, 1):
        if kind == "api":
            units = [u.strip() for u in OPERATION.split(body) if u.strip()]
        else:
            units = table_blocks(body) if tabular else paragraphs(body)
        pieces = [p for u in units or ([heading] if heading else []) for p in fitted(u, most, target)]
        for w, content in enumerate(windows(pieces, target, overlap), 1):
            title = heading or " ".join(content.split())[:120]
            whole = f"{heading}\n{content}" if heading and kind != "normative" and not content.startswith(heading) else content
            found.append(Chunk(len(found) + 1, title, whole, f"section:{s}.{w}"))
    return found


def compacted(contents: list[str], groups: int) -> list[str]:
    """Neighbouring chunks joined into at most ``groups`` of about equal words; the last takes the rest."""
    if len(contents) <= groups:
        return contents
    share = sum(map(words, contents)) / groups
    out: list[list[str]] = [[]]
    held = 0
    for c in contents:
        if out[-1] and held >= share and len(out) < groups:
            out.append([])
            held = 0
        out[-1].append(c)
        held += words(c)
    return ["\n\n".join(g) for g in out]


def adaptive(size: int, target: int, most: int, large: int = 1_048_576, chunks: int = 640) -> tuple[int, int]:
    """Target words and characters of a chunk for a document of ``size`` bytes: large ones get bigger chunks."""
    if size < large:
        return target, most
    wanted = min(1800, max(target, -(-size // (4 * chunks))))
    return wanted, max(most, wanted * 6)


def budgeted(sizes: list[int], budget: int) -> list[int]:
    """Places of the items taken in order while they fit; an item too large doesn't end the scan."""
    taken, left = [], budget
    for k, n in enumerate(sizes):
        if n <= left:
            taken.append(k)
            left -= n
    return taken
