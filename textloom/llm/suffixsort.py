"""Suffix arrays by induced sorting, and permuted common prefixes, as array operations.

Suffixes are classified as S (smaller than the next) or L; the leftmost S of each run (LMS) are sorted by their substrings
with one induction and named. Where names repeat, the string of names is sorted recursively in the same way. A last
induction sorts all suffixes. All levels take linear time. An induction goes through the buckets of first characters and
moves the predecessors of a whole bucket at once, only runs of one character taking further waves within it; where the
alphabet is large, as that of names is, and buckets are small, it moves one suffix at a time.
"""

from __future__ import annotations

import numpy as np

SMALL = 2_000  # characters of an alphabet up to which whole buckets are moved


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in the order that the given order of LMS suffixes induces. ends: of the buckets of first characters."""
    n, k = len(t), len(ends)
    if k > SMALL:
        return _induce_each(t, is_s, lms, ends)
    out = np.full(n, -1, np.int64)
    start = np.concatenate([[0], ends[:-1]])
    head = start.copy()
    order = np.argsort(t[lms], kind="stable")
    lms_cuts = np.concatenate([[0], np.cumsum(np.bincount(t[lms], minlength=k))])
    lms_sorted = lms[order]

    def put_l(at: np.ndarray) -> None:
        """Appends L suffixes to the heads of their buckets, in order."""
        c = t[at]
        o = np.argsort(c, kind="stable")
        c, at = c[o], at[o]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(first, len(c)))
        out[np.repeat(head[c[first]], size) + np.arange(len(c)) - np.repeat(first, size)] = at
        head[c[first]] += size

    put_l(np.array([n - 1]))  # the end is smaller than any character
    present = np.flatnonzero(ends > start).tolist()
    for c in present:
        done = start[c]
        while head[c] > done:
            wave = out[done : head[c]]
            done = head[c]
            wave = wave[wave > 0] - 1
            wave = wave[~is_s[wave]]
            if len(wave):
                put_l(wave)
        own = lms_sorted[lms_cuts[c] : lms_cuts[c + 1]]
        own = own[own > 0] - 1
        if len(own):
            put_l(own)
    tail = ends.copy()

    def put_s(at: np.ndarray) -> None:
        """Puts S suffixes before the tails of their buckets; `at` goes from large to small."""
        c = t[at]
        o = np.argsort(c, kind="stable")
        c, at = c[o], at[o]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(first, len(c)))
        out[np.repeat(tail[c[first]], size) - 1 - (np.arange(len(c)) - np.repeat(first, size))] = at
        tail[c[first]] -= size

    for c in reversed(present):
        done = ends[c]
        while tail[c] < done:
            wave = out[tail[c] : done][::-1]
            done = tail[c]
            wave = wave[wave > 0] - 1
            wave = wave[is_s[wave]]
            if len(wave):
                put_s(wave)
        wave = out[start[c] : head[c]][::-1]
        wave = wave[wave > 0] - 1
        wave = wave[is_s[wave]]
        if len(wave):
            put_s(wave)
    return out


def _induce_each(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As _induce(), suffix by suffix."""
    n = len(t)
    out = [-1] * n
    # the character before each suffix, if it begins an L or an S suffix
    prior_l, prior_s = ([-1, *np.where(is_s[:-1] == kind, t[:-1], -1).tolist()] for kind in (False, True))
    tail = ends.tolist()
    for i, c in zip(lms[::-1].tolist(), t[lms[::-1]].tolist()):
        tail[c] -= 1
        out[tail[c]] = i
    head = [0, *ends[:-1].tolist()]
    c = int(t[n - 1])
    out[head[c]] = n - 1
    head[c] += 1
    for j in out:  # which fills as it is read
        if j > 0 and (c := prior_l[j]) >= 0:
            out[head[c]] = j - 1
            head[c] += 1
    tail = ends.tolist()
    for j in reversed(out):
        if j > 0 and (c := prior_s[j]) >= 0:
            tail[c] -= 1
            out[tail[c]] = j - 1
    return np.array(out, np.int64)


def _classify(t: np.ndarray) -> np.ndarray:
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0  # of equal characters, what the next other one says


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of t (non-negative numbers) in order; a suffix comes before those that it begins."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    ends = np.cumsum(np.bincount(t))
    is_s = _classify(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        by = _induce(t, is_s, lms, ends)
        mark = np.full(n, -1, np.int64)
        mark[lms] = np.arange(len(lms))
        by = by[mark[by] >= 0]  # LMS suffixes by their substrings
        names = np.empty(len(lms), np.int64)
        names[mark[by]] = np.cumsum(np.concatenate([[0], _differ(t, lms, mark, by)]))
        if (top := int(names.max())) + 1 < len(lms):
            lms = lms[suffix_array(names)]
        else:
            lms = by
    return _induce(t, is_s, lms, ends)


def _differ(t: np.ndarray, lms: np.ndarray, mark: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Whether each LMS substring but the first differs from the one before; a substring goes to the next LMS, inclusive."""
    size = np.append(np.diff(lms) + 1, len(t) - lms[-1] + 1)[mark[by]]  # the last includes the end, so it is like no other
    a, b = by[:-1], by[1:]
    out = size[:-1] != size[1:]
    out |= (a == lms[-1]) | (b == lms[-1])
    left, i = np.flatnonzero(~out), 0
    while len(left):
        unlike = t[a[left] + i] != t[b[left] + i]
        out[left[unlike]] = True
        i += 1
        left = left[~unlike & (size[1:][left] > i)]
    return out


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, the length that its suffix shares with the one before it in order (0 for the first).

    Only irreducible lengths, whose preceding characters differ, are compared; the others are one less than their left
    neighbour's.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    first = np.ones(n, bool)
    inner = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    first[inner] = t[inner - 1] != t[before[inner] - 1]
    at = np.flatnonzero(first & (before >= 0))
    padded = np.concatenate([t.astype(np.uint8), np.zeros(16, np.uint8)]) if t.dtype == np.uint8 else None
    length = np.zeros(n, np.int64)
    a, b, live = at.copy(), before[at], np.arange(len(at))
    got = np.zeros(len(at), np.int64)
    word = np.lib.stride_tricks.sliding_window_view(padded, 8) if padded is not None else None
    while len(live):
        x, y = a[live] + got[live], b[live] + got[live]
        if word is not None:
            inside = (x + 8 <= n) & (y + 8 <= n)
            same = np.zeros(len(live), bool)
            i = np.flatnonzero(inside)
            same[i] = (word[x[i]].view(np.uint64) == word[y[i]].view(np.uint64)).ravel() if len(i) else False
            got[live[same]] += 8
            rest = live[~same]
        else:
            same, rest = np.zeros(len(live), bool), live
        while len(rest):  # up to seven more characters, or the end
            x, y = a[rest] + got[rest], b[rest] + got[rest]
            inside = (x < n) & (y < n)
            like = inside & (t[np.minimum(x, n - 1)] == t[np.minimum(y, n - 1)])
            got[rest[like]] += 1
            rest = rest[like]
        live = live[same]
    length[at] = got
    # a reducible length follows from the last irreducible one before it
    reach = np.where(first, np.arange(n) + length, 0)
    out = np.maximum.accumulate(reach) - np.arange(n)
    out[before < 0] = 0
    return np.maximum(out, 0)
