"""Vectorised word hashing over Arrow string columns (numpy, bounded temporaries).

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``; A-Z count as
a-z.  Each word gets a 64-bit hash: at 10^10 distinct words fewer than three
collisions are expected.  Texts are hashed in pieces of about one megabyte cut
between words, so one very long text needs eight bytes a word, not a multiple of
its own size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_M = (1 << 64) - 1


def splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def mix(a: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    a = a ^ (a >> np.uint64(30))
    a = a * np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(27)
    a *= np.uint64(0x94D049BB133111EB)
    a ^= a >> np.uint64(31)
    return a


IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BYTE = np.array([splitmix(int(i) + 1) for i in _FOLD], np.uint64) * IS_WORD.astype(np.uint64)
_BASE = splitmix(77) | 1
_STEP = [np.uint64(splitmix(1000 + j) | 1) for j in range(16)]
_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        p = np.full(max(n, 256), _BASE, np.uint64)
        p[0] = 1
        _POW = np.cumprod(p, dtype=np.uint64)
    return _POW


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d, o


IS_MARK = np.array([i < 128 and chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for i in range(256)])


def bare(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with the ASCII punctuation before and after each word blanked; a word of nothing else goes."""
    lo = int(offsets[0])
    d, o = data[lo : int(offsets[-1])].copy(), offsets - lo
    at = np.arange(len(d))
    word = IS_WORD[d]
    solid = word & ~IS_MARK[d]
    begins = o[:-1][o[:-1] < o[1:]]
    gap = np.where(word, -1, at)
    gap[begins] = np.maximum(gap[begins], begins - 1)
    lead = np.maximum.accumulate(np.where(solid, at, -1)) <= np.maximum.accumulate(gap)
    lasts = o[1:][o[:-1] < o[1:]] - 1
    gap = np.where(word, len(d), at)
    gap[lasts] = np.minimum(gap[lasts], lasts + 1)
    trail = np.minimum.accumulate(np.where(solid, at, len(d))[::-1])[::-1] >= np.minimum.accumulate(gap[::-1])[::-1]
    d[word & (lead | trail)] = 0x20
    return d, o


def _pieces(data: np.ndarray, lo: int, hi: int):
    """Byte ranges of about PIECE bytes that end where no word goes on."""
    at = lo
    while at < hi:
        end = min(hi, at + PIECE)
        while end < hi and IS_WORD[data[end]]:
            gap = np.flatnonzero(~IS_WORD[data[end : min(hi, end + 4096)]])
            end = min(hi, end + (int(gap[0]) if len(gap) else 4096))
        yield at, end
        at = end


def hash_words(data: np.ndarray, offsets: np.ndarray, places: bool = False) -> tuple[np.ndarray, ...]:
    """``(hashes, first)``: all words' hashes in order; text i has ``hashes[first[i]:first[i + 1]]``.
    With ``places`` also the words' first bytes and the bytes after them."""
    hashes, starts, ends = [], [], []
    for a, b in _pieces(data, int(offsets[0]), int(offsets[-1])):
        d = data[a:b]
        word = IS_WORD[d]
        before = np.empty(b - a, bool)
        before[0] = False
        before[1:] = word[:-1]
        cut = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        before[cut] = False
        s = np.flatnonzero(word & ~before)
        if not len(s):
            continue
        nxt = np.append(s[1:], b - a)
        pos = np.arange(b - a) - np.concatenate([np.zeros(s[0], np.int64), np.repeat(s, nxt - s)])
        v = _BYTE[d] * _powers(int(pos.max()) + 1)[pos]
        hashes.append(mix(np.add.reduceat(v, s)))
        starts.append(s + a)
        if places:
            after = np.zeros(b - a, bool)
            after[:-1] = word[1:]
            after[cut[cut > 0] - 1] = False
            ends.append(np.flatnonzero(word & ~after) + 1 + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    st = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    first = np.searchsorted(st, offsets)
    if places:
        return h, first, st, np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return h, first


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams starting at each of the first ``len(h) - n + 1`` places."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:m] * _STEP[0]
    for j in range(1, n):
        acc += h[j : j + m] * _STEP[j]
    return mix(acc)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of a text's word n-grams; a shorter text is one shingle, an empty one none."""
    return ngrams(h, min(n, len(h))) if len(h) else h


def groups(col: pa.Array, most_bytes: int = 4 << 20):
    """Row ranges of a string column with about ``most_bytes`` of text each (one longer text stands alone)."""
    _, o = buffers(col)
    at = 0
    while at < len(o) - 1:
        end = max(at + 1, int(np.searchsorted(o, o[at] + most_bytes, side="right")) - 1)
        yield at, min(end, len(o) - 1)
        at = min(end, len(o) - 1)
