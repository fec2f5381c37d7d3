"""Periodic runs of words, by the runs theorem.

Every run has, in one of two opposite orders of the words, a Lyndon root that is the longest Lyndon word from its place on;
that word ends at the next smaller value of the inverse suffix array. So next smaller values under both orders name at
most two possible roots a place. A root's run is found from the common prefix of the root and what follows it (a range
minimum over the common prefixes of the suffix array) and, of the first root of a run, from fewer than a period of words
before it. All texts of a slice form one sequence of words, each text with an end of its own, so that arrays are long
and a text of any length is taken whole.

Nulls: a null text has no words; a null doc_id is a value like any other, and such a text isn't altered. A text without
runs has four nulls. Repeated rows are rows of their own; an empty table gives no rows; extra columns aren't read.
Memory: some 300 bytes a word of a slice, which is 512 KiB of text or one longer text.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_slices, read
from .suffixes import Minima, common_prefixes, next_smaller, suffix_array

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3


def runs(texts: list[np.ndarray], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Of each sequence of numbers >= 0 its maximal runs (start, length, smallest period), in order.

    periods >= 2. The numbers need only tell words apart."""
    n, found = len(texts), [set() for _ in texts]
    if not sum(map(len, texts)):
        return [[] for _ in texts]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    begins = ends - [len(t) for t in texts]
    s = np.empty(ends[-1] + 1, np.int64)
    for k, t in enumerate(texts):
        s[begins[k] : ends[k]] = t + n
        s[ends[k]] = k  # ends are smallest in both orders
    order, rank = suffix_array(s)
    shared = Minima(common_prefixes(s, order, rank))
    at, top = np.arange(len(s)), int(s.max())
    for turned in (False, True):
        if turned:
            rank_here = suffix_array(np.where(s < n, s, n + top - s))[1]
        else:
            rank_here = rank
        follow = np.minimum(next_smaller(rank_here), len(s) - 1)  # of the smallest end there is none
        roots = at[(s >= n) & (s == s[follow])]
        if not len(roots):
            continue
        ahead = follow[roots]
        low, high = np.minimum(rank[roots], rank[ahead]), np.maximum(rank[roots], rank[ahead])
        extra, period = shared.of(low + 1, high + 1), ahead - roots
        whole = np.zeros(len(s), bool)  # roots that are followed by themselves
        whole[roots[extra >= period]] = True
        back = roots - period
        again = (back >= 0) & whole[back] & (follow[back] == roots)
        keep = ~again & (extra + 3 * period > np.maximum(least, periods * period))
        for i, p, more in zip(roots[keep].tolist(), period[keep].tolist(), extra[keep].tolist(), strict=True):
            k = int(np.searchsorted(ends, i))
            most = min(p, i - int(begins[k]))
            differs = np.flatnonzero(s[i - most : i] != s[i + p - most : i + p])
            start = i - most + (int(differs[-1]) + 1 if len(differs) else 0)
            length = i + p + more - start
            if length >= max(least, periods * p):
                found[k].add((start - int(begins[k]), length, p))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def altered(words: list, doc_id: int | None) -> list:
    """The words of a document, the tail of every tenth made periodic."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that a run has beyond its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not d]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length over period; of equal ones the first, then that of the smallest period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def described(batch: pa.RecordBatch) -> dict:
    ids = batch.column("doc_id").to_pylist()
    known: dict[bytes, int] = {}
    words = [altered((t or "").encode().split(), i) for t, i in zip(batch.column("text").to_pylist(), ids, strict=True)]
    found = runs([np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, len(ws)) for ws in words])
    best = [strongest(f) for f in found]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return {
        "doc_id": ids,
        "n_runs": [len(f) for f in found],
        "start": [b and b[0] for b in best],
        "length": [b and b[1] for b in best],
        "period": [b and b[2] for b in best],
        "exponent_milli": [b and 1000 * b[1] // b[2] for b in best],
        "runs_sha256": [sha("".join(f"{x},{y},{z}\n" for x, y, z in f).encode()) for f in found],
        "collapsed_sha256": [sha(b" ".join(collapsed(w, f))) for w, f in zip(words, found, strict=True)],
    }


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_slices(read(spark, sf_dir, "documents").select("doc_id", "text"), described, SCHEMA)
