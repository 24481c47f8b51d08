"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

A suffix is smaller-type (S) if it is smaller than the one after it, else larger-type (L).  A leftmost S suffix (LMS) follows an L suffix.
Placing the LMS suffixes in their first-symbol buckets, one scan from the left sorts all L suffixes and one from the right all S suffixes: the
predecessor of each suffix met goes to the next free place of its bucket.  Run once on unsorted LMS suffixes this sorts the substrings
between them; these get names, the string of names (a third as long, or less) is sorted recursively, and the scans are run on the now sorted LMS suffixes.

With few symbols (the bytes) the scans go bucket by bucket with whole arrays: what a bucket holds when it is met is read at once, and only predecessors with the
same symbol take another round (as many as the longest run of one symbol).  With many symbols (the names) the same order is induced for all buckets at once:
an L suffix stands by its symbol and then by the place of the suffix after it, which is L or LMS; those still level after that are told apart by the
suffix 1, 2, 4, ... further on, up to the LMS suffix that ends their run.  S suffixes go likewise, by the L suffixes that end theirs.
"""

from __future__ import annotations

import numpy as np

FEW = 256  # buckets are scanned one by one if they hold so many suffixes on average


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is S-type; the last symbol is the only 0 and S-type."""
    n = len(t)
    up = np.ones(n, bool)
    up[:-1] = t[:-1] < t[1:]
    settled = np.ones(n, bool)
    settled[:-1] = t[:-1] != t[1:]
    at = np.minimum.accumulate(np.where(settled, np.arange(n), n)[::-1])[::-1]
    return up[at]


def _put(sa: np.ndarray, free: np.ndarray, symbols: np.ndarray, places: np.ndarray, step: int) -> None:
    """Put places into the next free slots of their symbols' buckets, in order."""
    if len(places) == 1:
        s = symbols[0]
        sa[free[s]] = places[0]
        free[s] += step
        return
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    sizes = np.diff(np.append(first, len(s)))
    within = np.arange(len(s)) - np.repeat(first, sizes)
    sa[free[s] + step * within] = places[order]
    free[s[first]] += step * sizes


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in the order that the given order of the LMS suffixes induces."""
    n = len(t)
    sizes = np.bincount(t, minlength=k)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.empty(n, np.int32)
    lms_first = np.searchsorted(t[lms], np.arange(k + 1))  # lms comes bucket by bucket
    head = starts.copy()
    present = np.flatnonzero(sizes)
    for c in present:
        lo = starts[c]
        while lo < head[c]:
            hi = head[c]
            j = sa[lo:hi] - 1
            j = j[j >= 0]
            j = j[~small[j]]
            if len(j):
                _put(sa, head, t[j], j, 1)
            lo = hi
        j = lms[lms_first[c] : lms_first[c + 1]] - 1
        j = j[j >= 0]
        if len(j):
            _put(sa, head, t[j], j, 1)
    tail = ends - 1
    for c in present[::-1]:
        hi = ends[c]
        while hi > tail[c] + 1:
            lo = tail[c] + 1
            j = sa[lo:hi][::-1] - 1
            j = j[j >= 0]
            j = j[small[j]]
            if len(j):
                _put(sa, tail, t[j], j, -1)
            hi = lo
        j = sa[starts[c] : head[c]][::-1] - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            _put(sa, tail, t[j], j, -1)
    sa[0] = n - 1
    return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the sorted substrings that begin at ``order`` and end with the next LMS place: equal ones share a name."""
    size = np.zeros(len(t), np.int32)
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = 1
    same = np.zeros(len(order), bool)
    same[1:] = size[order[1:]] == size[order[:-1]]
    at, k = np.flatnonzero(same), 0
    while len(at):
        differ = t[order[at] + k] != t[order[at - 1] + k]
        same[at[differ]] = False
        k += 1
        at = at[~differ]
        at = at[size[order[at]] > k]
    name = np.cumsum(~same) - 1
    return name, int(name[-1]) + 1


def _level(rank: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Puts the elements ``at``, whole groups of equal rank, in order of ``key`` within their groups; returns those still level.
    A rank is the number of elements before its group."""
    group = rank[at]
    order = np.lexsort([key, group])
    g, k = group[order], key[order]
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    new = new_group | np.concatenate([[True], k[1:] != k[:-1]])
    i = np.arange(len(g))
    first = np.maximum.accumulate(np.where(new, i, 0))
    rank[at[order]] = g + first - np.maximum.accumulate(np.where(new_group, i, 0))
    alone = new & np.append(new[1:], True)
    return at[order[~alone]]


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by ``key`` and the elements that share theirs."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.empty(len(k), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    return rank, order[~(new & np.append(new[1:], True))]


def _names_of_many(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the substrings between LMS places, in the order of the text: sorted symbol by symbol, those still level only."""
    typed = t.astype(np.int64) * 2 + small
    rank, level = _ranked(typed[lms])
    ends = np.append(lms[1:], lms[-1])
    k = 1
    while len(level):
        level = level[lms[level] + k <= ends[level]]
        if len(level):
            level = _level(rank, level, typed[lms[level] + k])
        k += 1
    kinds, name = np.unique(rank, return_inverse=True)
    return name, len(kinds)


def _induce_many(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of the LMS suffixes induces, for many symbols."""
    n, t = len(t), t.astype(np.int64)
    large = np.flatnonzero(~small)
    some = np.concatenate([large, lms])
    place = np.zeros(len(some), np.int64)
    place[len(large) :] = np.arange(1, len(lms) + 1)
    rank = np.zeros(n, np.int64)
    got, level = _ranked(t[some] * (len(lms) + 2) + place)
    rank[some] = got
    level, h = some[level], 1
    while len(level):  # L suffixes; LMS ones are never level
        level = _level(rank, level, rank[level + h])
        h *= 2
    key = t * (n + 2) + n + 1
    key[large] = t[large] * (n + 2) + rank[large]
    rank, level = _ranked(key)
    h = 1
    while len(level):
        level = _level(rank, level, rank[level + h])
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


def _sort(t: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of symbols below ``k``, whose last is the only 0."""
    n = len(t)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    small = _smaller(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    few = n > FEW * k
    if few:
        t = t.astype(np.uint16) if k <= 1 << 16 else t  # numpy sorts 16 bits by radix
        order = _induce(t, small, lms[np.argsort(t[lms], kind="stable")], k)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        sorted_names, kinds = _names(t, lms, order)
        place = np.empty(n, np.int64)
        place[order] = sorted_names
        name = place[lms]
    else:
        name, kinds = _names_of_many(t, small, lms)
    if kinds < len(lms):
        order = place = None
        order = lms[_sort(name, kinds)]
    else:
        order = np.empty(len(lms), np.int64)
        order[name] = lms
    return _induce(t, small, order, k) if few else _induce_many(t, small, order)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of an array of bytes."""
    s = np.empty(len(t) + 1, np.uint16)
    s[:-1] = t
    s[:-1] += 1
    s[-1] = 0
    return _sort(s, int(s.max(initial=0)) + 1)[1:]


def common_prefixes(t: np.ndarray, sa: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(length, other)`` for each place of the bytes ``t``: the suffix before it in order, and the prefix they share within ``left`` bytes.

    A place whose symbol before is also the symbol before its neighbour has one less than the place before it, so only the other
    places are compared, eight bytes at a time.  ``left[i]`` falls by one from place to place and starts anew where a piece begins."""
    n = len(t)
    other = np.full(n, -1, np.int64)
    other[sa[1:]] = sa[:-1]
    at = np.arange(n)
    fresh = other < 1
    fresh[0] = True
    fresh[1:] |= left[1:] != left[:-1] - 1
    rest = np.flatnonzero(~fresh)
    fresh[rest] = t[rest - 1] != t[other[rest] - 1]
    data = np.concatenate([t, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", data.tobytes(), strides=(1,))
    i = np.flatnonzero(fresh & (other >= 0))
    length = np.zeros(n, np.int64)
    a, b, k = i, other[i], 0
    while len(i):
        x = words[np.minimum(a + k, n)] ^ words[np.minimum(b + k, n)]
        more = np.where(x == 0, 8, np.bitwise_count((x & -x) - np.uint64(1)) >> 3)
        length[i] += more.astype(np.int64)
        k += 8
        on = (x == 0) & (left[a] > k) & (b + k < n)
        i, a, b = i[on], a[on], b[on]
    length = np.minimum(length, np.minimum(left, n - np.maximum(other, 0)))
    last = np.maximum.accumulate(np.where(fresh, at, 0))
    return np.maximum(length[last] - (at - last), 0), other
