"""All groups of phrases that a text contains, in one pass over it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping


class Automaton:
    """A trie of all phrases whose failure links lead to the longest suffix that is still a beginning.

    A state's mask has the groups of every phrase that ends there, those of its
    suffixes included, so a text costs one step a character whatever the number of phrases.
    """

    def __init__(self, groups: Mapping[str, Iterable[str]]):
        self.names = list(groups)
        self.next: list[dict[str, int]] = [{}]
        self.mask = [0]
        for bit, phrases in enumerate(groups.values()):
            for phrase in phrases:
                state = 0
                for c in phrase:
                    if c not in self.next[state]:
                        self.next[state][c] = len(self.next)
                        self.next.append({})
                        self.mask.append(0)
                    state = self.next[state][c]
                self.mask[state] |= 1 << bit
        self.fail = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for c, child in self.next[state].items():
                queue.append(child)
                back = self.fail[state]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(c, 0)
                self.mask[child] |= self.mask[self.fail[child]]

    def groups(self, text: str) -> list[str]:
        """The names of the groups of which a phrase is in the text, in their order."""
        found, state, nxt, fail, mask = self.mask[0], 0, self.next, self.fail, self.mask
        for c in text:
            while state and c not in nxt[state]:
                state = fail[state]
            state = nxt[state].get(c, 0)
            found |= mask[state]
        return [name for bit, name in enumerate(self.names) if found >> bit & 1]
