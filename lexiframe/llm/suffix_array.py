"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays."""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (equal neighbours take the type to their right)."""
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[at] > 0, True)


def _spread(positions: np.ndarray, t: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append positions to the buckets of their characters, in the given order."""
    if not len(positions):
        return
    ch = t[positions]
    order = np.argsort(ch, kind="stable")
    positions, ch = positions[order], ch[order]
    cuts = np.flatnonzero(ch[1:] != ch[:-1]) + 1
    for c, part in zip(ch[np.append(0, cuts)].tolist(), np.split(positions, cuts)):
        buckets[c].append(part)


def _induce_by_bucket(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, induced from sorted seeds; a bucket at a time, whole arrays within it."""
    edges = np.searchsorted(t[seeds], np.arange(k + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(k)]
    larger: list[np.ndarray] = []
    none = np.empty(0, dtype=seeds.dtype)
    for c in range(k):
        parts, wave = [], np.concatenate(waiting[c]) if waiting[c] else none
        while len(wave):
            parts.append(wave)
            p = wave[wave > 0] - 1
            p = p[~small[p]]
            same = t[p] == c
            _spread(p[~same], t, waiting)
            wave = p[same]
        larger.append(np.concatenate(parts) if parts else none)
        s = seeds[edges[c] : edges[c + 1]]
        p = s[s > 0] - 1
        _spread(p[~small[p]], t, waiting)
    waiting = [[] for _ in range(k)]
    out: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):
        parts = []
        wave = np.concatenate(waiting[c]) if waiting[c] else none
        if c == 0:
            wave = np.array([len(t) - 1], dtype=seeds.dtype)  # the end of the text
        while len(wave):
            parts.append(wave)
            p = wave[wave > 0] - 1
            p = p[small[p]]
            same = t[p] == c
            _spread(p[~same], t, waiting)
            wave = p[same]
        back = larger[c][::-1]
        p = back[back > 0] - 1
        _spread(p[small[p]], t, waiting)
        out += [np.concatenate(parts)[::-1] if parts else none, larger[c]]
    return np.concatenate(out[::-1])


def _induce_by_entry(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The same for large alphabets, one suffix at a time."""
    n, counts = len(t), np.bincount(t, minlength=k)
    ends = np.cumsum(counts)
    sa = np.full(n, n, dtype=np.int64)  # n: nothing yet
    chars = t[seeds]
    sa[ends[chars] - (np.searchsorted(chars, chars, side="right") - np.arange(len(seeds)))] = seeds
    sa = sa.tolist()
    # the character before each suffix, if the suffix before is of the kind to be placed; -1 else
    before = np.append(-1, t[:-1])
    larger = np.append(np.where(np.append(True, small[:-1]), -1, before), -1).tolist()
    smaller = np.append(np.where(np.append(False, small[:-1]), before, -1), -1).tolist()
    head = (ends - counts).tolist()
    for j in sa:  # reads what the loop has placed further on
        c = larger[j]
        if c >= 0:
            at = head[c]
            sa[at] = j - 1
            head[c] = at + 1
    tail = ends.tolist()
    for j in reversed(sa):
        c = smaller[j]
        if c >= 0:
            at = tail[c] - 1
            sa[at] = j - 1
            tail[c] = at
    sa[0] = n - 1
    return np.array(sa, dtype=seeds.dtype)


def _sort_substrings(t: np.ndarray, small: np.ndarray, places: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The substrings of ``size`` characters at ``places`` in order, and which of them equals the one before: whole
    columns at a time, for those that are still tied. Of equal characters the larger suffix comes first."""
    key = 2 * t.astype(np.int64) + small
    first = key[places]
    turn = np.argsort(first, kind="stable")
    order, first = places[turn], first[turn]
    same = np.append(False, first[1:] == first[:-1])
    depth = 1
    while True:
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        at = at[size[order[at]] > depth]  # substrings that have ended alike are equal
        if not len(at):
            return order, same[1:]
        group, items = np.cumsum(~same)[at], order[at]
        column = key[items + depth]
        turn = np.lexsort((column, group))
        order[at], column, group = items[turn], column[turn], group[turn]
        same[at] = np.append(False, (column[1:] == column[:-1]) & (group[1:] == group[:-1]))
        depth += 1


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of ``t``: characters 0 to k - 1, of which 0 stands at the end and nowhere else.

    Suffixes are classed as smaller or larger than the next; the leftmost smaller ones are sorted by their
    substrings (by inducing; by columns if the alphabet is large), named, and sorted as a shorter text if two names
    are equal; the others are induced from them.
    """
    if len(t) == 1:
        return np.zeros(1, dtype=np.int32)
    small = _types(t)
    leftmost = np.append(False, small[1:] & ~small[:-1])
    places = np.flatnonzero(leftmost).astype(np.int32)
    # substrings run to the next leftmost smaller suffix; equal ones get one name
    size = np.zeros(len(t), dtype=np.int32)
    size[places] = np.append(places[1:], len(t) - 1) - places + 1
    if k > SMALL_ALPHABET:
        induce = _induce_by_entry
        order, same = _sort_substrings(t, small, places, size)
    else:
        induce = _induce_by_bucket
        rough = induce(t, small, places[np.argsort(t[places], kind="stable")], k)
        order = rough[leftmost[rough]]
        a, b = order[:-1], order[1:]
        same = size[a] == size[b]
        open_, o = np.flatnonzero(same), 0
        while len(open_):
            open_ = open_[size[a[open_]] > o]
            differ = t[a[open_] + o] != t[b[open_] + o]
            same[open_[differ]] = False
            open_, o = open_[~differ], o + 1
    names = np.append(0, np.cumsum(~same))
    if names[-1] + 1 < len(order):
        name = np.zeros(len(t), dtype=np.int64)
        name[order] = names
        order = places[suffix_array(name[places], int(names[-1]) + 1)]
    return induce(t, small, order, k)


def permuted_lcp(text: np.ndarray, places: np.ndarray, cap: int) -> np.ndarray:
    """For places in suffix order: bytes (``cap`` at most) that each shares with the one before it, computed in
    text order, where neighbouring places read neighbouring memory. ``text`` (uint8) has ``cap`` + 8 bytes after
    the last place."""
    if not len(places):
        return np.empty(0, dtype=np.int64)
    by_text = np.argsort(places)
    here = places[by_text].astype(np.int64)
    before = np.append(-1, places[:-1])[by_text].astype(np.int64)
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    shared = np.zeros(len(here), dtype=np.int64)
    live = np.flatnonzero(before >= 0)
    for at in range(0, cap, 8):
        x = np.ascontiguousarray(words[here[live] + at]).view("<u8").ravel()
        y = np.ascontiguousarray(words[before[live] + at]).view("<u8").ravel()
        diff = x ^ y
        low = diff & (~diff + np.uint64(1))  # lowest set bit: in the first byte that differs
        same = np.where(diff == 0, 8, np.log2(np.where(diff == 0, 1, low).astype(np.float64)).astype(np.int64) // 8)
        shared[live] = np.minimum(at + same, cap)
        live = live[diff == 0]
    out = np.empty(len(places), dtype=np.int64)
    out[by_text] = shared
    return out
