"""Byte-pair merges as tables: ranks, the pair each token was last merged from,
and whether two tokens may stand next to each other.

A token sequence is the encoding of its text if and only if every two
neighbours are compatible, that is, if merging the two tokens' own text by rank
gives exactly these two tokens. Compatibility is found by undoing merges at the
common border, latest first, and remembered for each pair asked for.
"""

from __future__ import annotations

import ahocorasick


class Bounded(dict):
    """A cache of two generations: when the young one is full, it becomes the old one.

    What is asked for again moves from the old generation to the young one, so
    frequent keys stay. A generation holds about limit bytes at most, by the
    sizes of keys and values; keys of over LONG characters are not held.
    """

    LONG = 512
    ENTRY = 150  # bytes of a key and a value beside their contents, about

    def __init__(self, limit: int, make):
        super().__init__()
        self.limit, self.make, self.old, self.held = limit, make, {}, 0

    def __missing__(self, key):
        if len(key) > self.LONG:
            return self.make(key)
        if self.held >= self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.held += self.ENTRY + 4 * len(key) + (len(value) * 4 if hasattr(value, "__len__") else 0)
        return value


class Merges:
    """tokens: text by number. rank: -1 for what no merge makes. parts: (left, right) of the last merge. limit: of the pairs remembered."""

    def __init__(self, tokens: list[str], rank: list[int], parts: list[tuple[int, int] | None], limit: int = 96 << 20):
        self.tokens, self.rank, self.parts = tokens, rank, parts
        self.merged = {p: rank[k] for k, p in enumerate(parts) if p is not None}
        self.lengths = [len(t) for t in tokens]
        self.trie = ahocorasick.Automaton()
        for k, t in enumerate(tokens):
            if t:
                self.trie.add_word(t, k)
        self.trie.make_automaton()
        self._fits = Bounded(limit, lambda pair: self._compatible(*pair))

    def _compatible(self, a: int, b: int) -> bool:
        limit, rank, parts = float("inf"), self.rank, self.parts
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = rank[a], parts[a][1]
            else:  # of equal ranks the left one was merged first
                limit, b = rank[b] + 1, parts[b][0]

    def encode(self, text: str) -> list[int]:
        """Backtracking: the longest match first, shorter ones where it doesn't fit, a step back where none does."""
        fits, lengths, size = self._fits, self.lengths, len(text)
        matches: list[list[int]] = [[] for _ in range(size)]  # by begin, shortest first
        for end, k in self.trie.iter(text):
            matches[end + 1 - lengths[k]].append(k)
        out: list[int] = []
        back: list[tuple[int, int]] = []  # where each token of out begins, and how many shorter ones are left there
        dead: set[int] = set()
        at, left = 0, len(matches[0]) if size else 0
        while at < size:
            here = matches[at]
            while left:
                left -= 1
                token = here[left]
                end = at + lengths[token]
                if end not in dead and (not out or fits[out[-1], token]):
                    break
            else:
                if not out:
                    raise ValueError(f"no tokens make up {text!r}")
                dead.add(at)
                out.pop()
                at, left = back.pop()
                continue
            out.append(token)
            back.append((at, left))
            at = end
            left = len(matches[at]) if at < size else 0
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """The number of tokens of text[:i] for each i; -1 where text[:i] has no encoding.

        Of the tokens that end at a place exactly one is compatible with the
        last token of the prefix before it.
        """
        fits, lengths = self._fits, self.lengths
        last = [-1] * (len(text) + 1)
        count = [0] + [-1] * len(text)
        for end, k in self.trie.iter(text):
            begin = end + 1 - lengths[k]
            if count[begin] >= 0 and count[end + 1] < 0 and (begin == 0 or fits[last[begin], k]):
                last[end + 1], count[end + 1] = k, count[begin] + 1
        return count
