"""Whether a transcript word stands for a canonical one, word by word and in tables."""

from __future__ import annotations

import numpy as np

from . import kernels


class Matcher:
    """Whether a transcript word stands for a canonical one: equal, same ends, few edits, or by a dictionary."""

    def __init__(self, dictionary: dict[str, str] | None = None):
        self.dictionary = dictionary or {}
        self.known: dict[tuple[str, str], bool] = {}
        self.shapes: dict[str, tuple[int, int, int, int]] = {}

    def __call__(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[key] = self.direct(a, b) or a in self.dictionary and self.direct(self.dictionary[a], b)
        return self.known[key]

    def table(self, window: list[str], verse: list[str]) -> np.ndarray:
        """Matches of all pairs; only pairs that could be within the edit limit are compared letter by letter."""
        (la, fa, za, ma), (lb, fb, zb, mb) = ([np.array(x) for x in zip(*map(self.shape, w))] for w in (window, verse))
        low, high = np.minimum.outer(la, lb), np.maximum.outer(la, lb)
        same = np.equal.outer(np.array(window, object), np.array(verse, object)).astype(bool) & (low > 0)
        same |= (low >= 5) & (high - low <= 2) & np.equal.outer(fa, fb) & np.equal.outer(za, zb)
        limit = np.where(high <= 5, 1, np.where(high <= 9, 2, 3))
        near = ~same & (low >= 4) & (high - low <= limit) & (np.bitwise_count(np.bitwise_xor.outer(ma, mb)) <= 2 * limit)
        if self.dictionary:
            near[[a in self.dictionary for a in window]] = True
        for i, j in zip(*np.nonzero(near & ~same)):
            same[i, j] = self(window[i], verse[j])
        return same

    def rows(self, words: list[str], vocabulary: list[str]) -> dict[str, list[str]]:
        """For each of the words those of a vocabulary that it stands for; edits of all pairs that may be near come together."""
        every = list(dict.fromkeys([*words, *(self.dictionary[w] for w in words if w in self.dictionary)]))
        (lb, fb, zb, mb), names = (np.array(x) for x in zip(*map(self.shape, vocabulary))), np.array(vocabulary, object)
        place = {w: j for j, w in enumerate(vocabulary)}
        again = np.array(list(map(self._again, vocabulary)))
        out: dict[str, set[int]] = {}
        for k in range(0, len(every), 256):
            part = every[k : k + 256]
            la, fa, za, ma = (np.array(x)[:, None] for x in zip(*map(self.shape, part)))
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            ends = (low >= 5) & (high - low <= 2) & (fa == fb) & (za == zb)
            limit = np.where(high <= 5, 1, np.where(high <= 9, 2, 3))
            # an insertion or deletion changes one bit, a substitution two
            most = np.where(ends | (low < 4) | (high - low > limit), -1, 2 * limit - (high - low))
            i, j = np.nonzero(np.bitwise_count(ma ^ mb).astype(np.int8) <= most)
            apart = np.bitwise_count(ma[i, 0] ^ mb[j]) + np.bitwise_count(np.array(list(map(self._again, part)))[i] ^ again[j])
            i, j = (x[apart <= most[i, j]] for x in (i, j))
            near = kernels.edit_pairs(part, vocabulary, i, j) <= limit[i, j]
            found = [{place[w]} if w and w in place else set() for w in part]
            for a, b in zip(*np.nonzero(ends)):
                found[a].add(int(b))
            for a, b in zip(i[near].tolist(), j[near].tolist()):
                found[a].add(b)
            out |= dict(zip(part, found))
        return {w: names[sorted(out[w] | out[self.dictionary[w]] if w in self.dictionary else out[w])].tolist() for w in words}

    @staticmethod
    def _again(word: str) -> int:
        """The letters that a word has more than once, as bits."""
        once = twice = 0
        for c in word:
            bit = 1 << ord(c) % 61
            twice |= once & bit
            once |= bit
        return twice

    def shape(self, word: str) -> tuple[int, int, int, int]:
        """Length, first and last letter, and the set of letters as bits: each edit changes two bits at most."""
        if word not in self.shapes:
            bits = 0
            for c in word:
                bits |= 1 << ord(c) % 61
            self.shapes[word] = (len(word), ord(word[0]) if word else -1, ord(word[-1]) if word else -2, bits)
        return self.shapes[word]

    @staticmethod
    def direct(a: str, b: str) -> bool:
        if not a or not b or a == b:
            return bool(a) and a == b
        low, high = sorted((len(a), len(b)))
        if low >= 5 and high - low <= 2 and (a[0], a[-1]) == (b[0], b[-1]):
            return True
        limit = 1 if high <= 5 else 2 if high <= 9 else 3
        return low >= 4 and high - low <= limit and kernels.edits(a, b) <= limit
