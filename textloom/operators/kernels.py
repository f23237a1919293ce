"""Sequential kernels, free of Spark: shared by the Arrow functions and the tests."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from ..functions.text import SPACES, VARIANTS

_SPACES = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", SPACES)
DISPLAY = re.compile(f"[A-Za-z0-9_]+|[^A-Za-z0-9_{_SPACES}]+")
_SIGNS = re.compile(r"^(?:[^\w&]|_)+|(?:[^\w&]|_)+$")
_KNOWN = {frozenset(p) for p in VARIANTS}
_PARTNERS: dict[str, set[str]] = {}
for _a, _b in (p for p in map(tuple, _KNOWN) if len(p) == 2):
    _PARTNERS.setdefault(_a, set()).add(_b)
    _PARTNERS.setdefault(_b, set()).add(_a)
_WORDLIKE = re.compile(r"[a-zA-Z&()<]")


def display(text: str) -> list[str]:
    """Display tokens (F1)."""
    return DISPLAY.findall(text)


def diff(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """(value, op) with op eq, del or ins: fewest insertions and deletions, deletions first (D-1).

    Common ends are set aside; between them a row of the table is a whole number with a bit for each word of the other text,
    and comes from the row before it by one addition. All rows are held for the way back: two texts of 20,000 words take 50 MB.
    """
    a, b = 0, 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    while b < min(len(old), len(new)) - a and old[-1 - b] == new[-1 - b]:
        b += 1
    x, y = old[a : len(old) - b], new[a : len(new) - b]
    out = [(t, "eq") for t in old[:a]]
    out += _middle(x, y)
    return out + [(t, "eq") for t in old[len(old) - b :]]


def _middle(x: list[str], y: list[str]) -> list[tuple[str, str]]:
    m, n = len(x), len(y)
    if not m or not n:
        return [(t, "del") for t in x] + [(t, "ins") for t in y]
    places: dict[str, int] = {}
    for j, t in enumerate(y):
        places[t] = places.get(t, 0) | 1 << j
    every = (1 << n) - 1
    free, rows = every, []
    for t in x:
        hit = free & places.get(t, 0)
        if hit:
            free = (free + hit | free - hit) & every
        rows.append(free)  # a zero: one more in common with this word of y than without it
    out = []
    i, j = m, n
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((x[i], "eq"))
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((y[j], "ins"))
        else:
            i -= 1
            out.append((x[i], "del"))
    out += [(t, "del") for t in x[:i][::-1]] + [(t, "ins") for t in y[:j][::-1]]
    return out[::-1]


def runs(ops: list[str]) -> int:
    """Maximal runs of changed tokens."""
    return sum(o != "eq" and (i == 0 or ops[i - 1] == "eq") for i, o in enumerate(ops))


@lru_cache(maxsize=1 << 16)
def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(b, 1):
            last, row[j] = row[j], last if c == e else 1 + min(last, row[j], row[j - 1])
    return row[-1]


#: Pairs that are compared together.
CELLS = 1 << 17


def edit_pairs(x: list[str], y: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distances of the words x[i] and y[j], all pairs of a block at once.

    A column of the usual table is two 64-bit numbers with a bit for each letter of x (Myers); words over 64 letters are
    compared one by one.
    """
    if len(i) > CELLS:
        return np.concatenate([edit_pairs(x, y, i[k : k + CELLS], j[k : k + CELLS]) for k in range(0, len(i), CELLS)])
    mine, size = np.array([len(w) for w in x], np.int64), np.array([len(w) for w in y], np.int64)
    letters = {c: k for k, c in enumerate({c for w in y for c in w})}
    codes = np.full((int(size.max(initial=0)), len(y)), len(letters), np.int64)
    for k, w in enumerate(y):
        codes[: len(w), k] = [letters[c] for c in w]
    where = np.zeros((len(letters) + 1, len(x)), np.uint64)
    for k, w in enumerate(x):
        bit = 1
        for c in w[:64]:
            if c in letters:
                where[letters[c], k] |= np.uint64(bit)
            bit <<= 1
    order = np.argsort(-size[j], kind="stable")  # pairs with another letter come first
    a, b = i[order], j[order]
    left = np.searchsorted(-size[b], -np.arange(len(codes)), side="left")
    one = np.uint64(1)
    last = np.where(mine[a] > 0, one << np.maximum(np.minimum(mine[a], 64) - 1, 0).astype(np.uint64), np.uint64(0))
    score = mine[a].astype(np.int32)
    up, down = np.full(len(a), -1, np.int64).view(np.uint64), np.zeros(len(a), np.uint64)
    for k, n in enumerate(left.tolist()):
        same, p, m = where[codes[k, b[:n]], a[:n]], up[:n], down[:n]
        across = (((same & p) + p) ^ p) | same
        more, less = m | ~(across | p), p & across
        score[:n] += ((more & last[:n]) != 0).astype(np.int8) - ((less & last[:n]) != 0).astype(np.int8)
        more, less = (more << one) | one, less << one
        either = same | m
        up[:n], down[:n] = less | ~(either | more), more & either
    score = np.where(mine[a] > 0, score, size[b].astype(np.int32))
    for k in np.flatnonzero(mine[a] > 64).tolist():
        score[k] = edits(x[a[k]], y[b[k]])
    out = np.empty(len(a), np.int32)
    out[order] = score
    return out


def edit_table(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of all pairs, a row for each word of a; distinct words are compared once."""
    if len(a) * len(b) <= 48:
        return np.array([[edits(v, w) for w in b] for v in a], np.int32).reshape(len(a), len(b))
    x, y = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    step = max(1, CELLS // len(y))
    parts = [x[k : k + step] for k in range(0, len(x), step)]
    out = np.concatenate([edit_pairs(p, y, np.tile(np.arange(len(p)), len(y)), np.repeat(np.arange(len(y)), len(p))).reshape(len(y), len(p)).T for p in parts])
    row, column = {w: i for i, w in enumerate(x)}, {w: j for j, w in enumerate(y)}
    return out[np.ix_([row[w] for w in a], [column[w] for w in b])]


@lru_cache(maxsize=1 << 16)
def is_punctuation(token: str) -> bool:
    return not _WORDLIKE.search(token)


@lru_cache(maxsize=1 << 16)
def plain(token: str) -> str:
    return _SIGNS.sub("", token).lower()


def substitution(old: str, new: str) -> str:
    if is_punctuation(old) or is_punctuation(new):
        return "punctuation"
    if old.lower() == new.lower():
        return "capitalization"
    a, b = plain(old), plain(new)
    longest = max(len(a), len(b))
    if a != b and frozenset((a, b)) in _KNOWN:
        return "spelling"
    if longest >= 5 and (n := edits(a, b)) <= 3 and n / longest <= 0.34:
        return "spelling"
    return "wordChange"


def classified(tokens: list[tuple[str, str]]) -> list[tuple[str, str, str | None]]:
    """(value, op, kind): each run of changes gets its kinds (D-5)."""
    kinds: list[str | None] = [None] * len(tokens)
    at = 0
    while at < len(tokens):
        if tokens[at][1] == "eq":
            at += 1
            continue
        end = at
        while end < len(tokens) and tokens[end][1] != "eq":
            end += 1
        gone, come = [], []
        for i in range(at, end):
            if is_punctuation(tokens[i][0]):
                kinds[i] = "punctuation"
            else:
                (gone if tokens[i][1] == "del" else come).append(i)
        _pair(tokens, gone, come, kinds)
        at = end
    return [(v, o, k) for (v, o), k in zip(tokens, kinds)]


def _ranks(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Numbers in the order of part / whole, small ones where few values are possible: these sort faster."""
    high, wide = int(part.max()) + 1, int(whole.max()) + 1
    if high * wide > min(part.size, 60_000):
        return part / whole
    ratio = np.arange(high)[:, None] / np.maximum(np.arange(wide), 1)
    return np.unique(ratio, return_inverse=True)[1].reshape(high, wide).astype(np.uint16)[part, whole]


def _closest(left: list[int], free: list[int], value: Callable[[int], str]) -> list[tuple[int, int]]:
    """Pairs of both lists, the closest pair of all first, then the one of the first words."""
    if not left or not free:
        return []
    x, y = [plain(value(i)) for i in left], [plain(value(j)) for j in free]
    longest = np.maximum.outer([len(w) for w in x], [len(w) for w in y])
    order = np.argsort(_ranks(edit_table(x, y), np.maximum(longest, 1)), axis=None, kind="stable")
    out, wanted = [], min(len(x), len(y))
    rows, columns = np.ones(len(x), bool), np.ones(len(y), bool)
    while len(out) < wanted:  # of a lot the pairs whose words are both free, in turn
        for k in order[: 4 * len(y) + 64].tolist():
            i, j = divmod(k, len(y))
            if rows[i] and columns[j]:
                rows[i] = columns[j] = False
                out.append((left[i], free[j]))
        order = order[4 * len(y) + 64 :]
        order = order[rows[order // len(y)] & columns[order % len(y)]]
    return out


def _pair(tokens: list[tuple[str, str]], gone: list[int], come: list[int], kinds: list[str | None]) -> None:
    value = lambda i: tokens[i][0]
    spelled = lambda ids: re.sub(r"[\W_]", "", "".join(map(value, ids)).lower())
    if gone and come and len(gone) != len(come) and spelled(gone) == spelled(come):
        for i in gone + come:  # the same letters, divided otherwise
            kinds[i] = "spelling"
        return
    free, left = dict.fromkeys(come), []
    pairs: list[tuple[int, int]] = []
    by_plain: dict[str, list[int]] = {}
    by_lower: dict[str, list[int]] = {}
    for j in reversed(come):  # the first one at the end
        by_plain.setdefault(plain(value(j)), []).append(j)
        by_lower.setdefault(value(j).lower(), []).append(j)

    def first(found: list[int]) -> int | None:
        while found and found[-1] not in free:
            found.pop()
        return found[-1] if found else None

    for i in gone:
        known = [j for w in _PARTNERS.get(plain(value(i)), ()) if w in by_plain and (j := first(by_plain[w])) is not None]
        best = min(known) if known else first(by_lower.get(value(i).lower(), []))
        if best is None:
            left.append(i)
        else:
            del free[best]
            pairs.append((i, best))
    pairs += _closest(left, list(free), value)
    for _, j in pairs:
        free.pop(j, None)
    for i, j in pairs:
        kinds[i] = kinds[j] = substitution(value(i), value(j))
    for i in left:
        kinds[i] = kinds[i] or "omission"
    for j in free:
        kinds[j] = "addition"


def lcs_latest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, met from the end, the first side giving way on ties (Q2).

    One bit of each cell is kept: whether the first side may give way.
    """
    n, m = len(a), len(b)
    codes: dict[str, int] = {}
    p, q = (np.array([codes.setdefault(w, len(codes)) for w in side], np.int64) for side in (a, b))
    size = np.zeros(m + 1, np.int32)
    bits = []
    for i in range(n):
        now = np.zeros(m + 1, np.int32)
        now[1:] = np.maximum.accumulate(np.where(q == p[i], size[:-1] + 1, size[1:])) if m else 0
        bits.append(np.packbits(size[1:] >= now[:-1]))
        size = now
    out = []
    i, j = n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif bits[i - 1][(j - 1) >> 3] >> (7 - (j - 1 & 7)) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest strictly increasing chain of the second numbers, pairs being sorted by the first."""
    from bisect import bisect_left

    tops: list[int] = []
    at: list[int] = []
    prior = [-1] * len(pairs)
    for k, (_, t) in enumerate(pairs):
        i = bisect_left(tops, t)
        prior[k] = at[i - 1] if i else -1
        tops[i : i + 1], at[i : i + 1] = [t], [k]
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = prior[k]
    return out[::-1]
