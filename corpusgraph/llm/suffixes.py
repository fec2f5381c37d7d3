"""Suffix arrays of numpy arrays, their common prefixes, range minima and next smaller values.

A sequence is one array of symbols >= 0 in which each string ends with a symbol of its own that occurs nowhere else. So
no two suffixes are equal and no common prefix crosses the end of a string.
"""

from __future__ import annotations

import numpy as np


def packed(s: np.ndarray) -> tuple[np.ndarray, int]:
    """Of each place the first symbols from there on as one number, and how many those are."""
    bits = max(1, int(s.max()).bit_length())
    many = max(1, 63 // bits)
    out = np.zeros(len(s), np.int64)
    for k in range(many):
        out <<= bits
        out[: max(0, len(s) - k)] |= s[k:]
    return out, many


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the rank of each, by Larsson-Sadakane refinement.

    A rank is the place where its group of not yet told apart suffixes begins. Each pass sorts only the members of groups
    of two or more, by the ranks that lie as far ahead as the groups are already told apart, and that distance doubles."""
    n = len(s)
    key, ahead = packed(s)
    order = np.argsort(key, kind="stable")
    rank, at = np.empty(n, np.int64), np.arange(n)
    first = np.ones(n + 1, bool)  # whether a group begins at a place of the order
    np.not_equal(key[order[1:]], key[order[:-1]], out=first[1:n])
    rank[order] = np.maximum.accumulate(np.where(first[:n], at, 0))
    places = np.flatnonzero(~(first[:n] & first[1:]))
    while len(places):
        suffixes = order[places]
        key = rank[suffixes] << 32 | rank[suffixes + ahead]
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[places] = suffixes
        begins = np.ones(len(places), bool)
        np.not_equal(key[1:], key[:-1], out=begins[1:])
        first[places] = begins
        rank[suffixes] = np.maximum.accumulate(np.where(begins, places, 0))
        places = places[~(begins & np.append(begins[1:], True))]
        ahead *= 2
    return order, rank


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each place of the order, how much its suffix shares with the one before it; 0 for the first.

    Kasai's recurrence: where a suffix and its neighbour are preceded by one symbol, the suffix a place earlier shares one
    more with its own. So in the order of the text only the other suffixes are compared with their neighbours, all at
    once, and the rest count down from the last of those."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    fresh = (at == 0) | (before <= 0)
    fresh[1:] |= s[:-1] != s[before[1:] - 1]
    key, many = packed(s)
    own = np.flatnonzero(fresh & (before >= 0))
    other, shared = before[own], np.zeros(len(own), np.int64)
    left = np.arange(len(own))
    while len(left):
        a, b = own[left] + shared[left], other[left] + shared[left]
        inside = np.maximum(a, b) + many <= n
        same = inside.copy()
        same[inside] = key[a[inside]] == key[b[inside]]
        shared[left[same]] += many
        left = left[same]
    left = np.arange(len(own))
    while len(left):  # what remains is less than a number holds
        same = s[own[left] + shared[left]] == s[other[left] + shared[left]]
        left = left[same]
        shared[left] += 1
    last = np.maximum.accumulate(np.where(fresh, at, 0))
    found = np.zeros(n, np.int64)
    found[own] = shared
    out = np.zeros(n, np.int64)
    out[rank] = found[last] - (at - last)
    out[0] = 0
    return out


class Minima:
    """Minima of ranges of an array by a table of those of 1, 2, 4, ... numbers."""

    def __init__(self, x: np.ndarray) -> None:
        self.levels = [x.astype(np.int32)]
        while 2 << (len(self.levels) - 1) <= len(x):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each begin..end-1, which isn't empty."""
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        out = np.empty(len(begin), np.int64)
        for k in np.unique(level):
            here = level == k
            out[here] = np.minimum(self.levels[k][begin[here]], self.levels[k][end[here] - (1 << int(k))])
        return out


def next_smaller(x: np.ndarray) -> np.ndarray:
    """Of each place the first later one with a smaller number, or the length."""
    x, n = x.tolist(), len(x)
    out = [n] * n
    for i in range(n - 1, -1, -1):
        own, j = x[i], i + 1
        while j < n and x[j] >= own:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)
