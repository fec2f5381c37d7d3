"""Which of many fixed strings texts contain, in one pass over the text for all strings of similar length.

A string is known by two hashes: of its first and of its last bytes, as many as the greatest power of two that it has (64
at most). Rolling hashes of those lengths are taken at every place of a text at once and looked up in the sorted hashes
of the strings; the last bytes' hash is compared next, and then the bytes. So the cost grows with the text and the number
of lengths (seven at most), hardly with the number of strings.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of strings that one pass takes; they go to the workers with the function.
BLOCK_BYTES = 8 << 20
#: Bytes of texts that are looked through at once.
TEXT_BYTES = 1 << 20
ODD = 0x9E3779B97F4A7C15


class Matcher:
    """Strings by the length of their hashes. The empty string is in every text."""

    def __init__(self, strings: Sequence[str]) -> None:
        self.strings = [s.encode() for s in strings]
        self.empty = [i for i, s in enumerate(self.strings) if not s]
        by: dict[int, list[int]] = {}
        for i, s in enumerate(self.strings):
            if s:
                by.setdefault(min(64, 1 << (len(s).bit_length() - 1)), []).append(i)
        self.groups = []
        for q, which in sorted(by.items()):
            first = np.concatenate([rolling(np.frombuffer(self.strings[i][:q], np.uint8), q) for i in which])
            last = np.concatenate([rolling(np.frombuffer(self.strings[i][-q:], np.uint8), q) for i in which])
            order = np.argsort(first, kind="stable")
            self.groups.append((q, first[order], last[order], np.array(which)[order], np.array([len(self.strings[i]) for i in which])[order]))

    def found(self, texts: Sequence[bytes]) -> list[list[int]]:
        """Of each text the numbers of the strings in it, ascending."""
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        out = [set(self.empty) for _ in texts]
        whole = data.tobytes()
        for q, first, last, which, sizes in self.groups:
            if len(data) < q:
                continue
            h = rolling(data, q)
            low, high = np.searchsorted(first, h, "left"), np.searchsorted(first, h, "right")
            at = np.flatnonzero(high > low)
            many = high[at] - low[at]
            place = np.repeat(at, many)
            entry = np.repeat(low[at] - np.cumsum(many) + many, many) + np.arange(len(place))
            text = np.searchsorted(ends, place, side="right")
            fits = place + sizes[entry] <= (ends[text] if len(ends) else 0)
            place, entry, text = place[fits], entry[fits], text[fits]
            same = h[place + sizes[entry] - q] == last[entry]
            for p, e, t in zip(place[same].tolist(), entry[same].tolist(), text[same].tolist(), strict=True):
                i = int(which[e])
                if i not in out[t] and whole.startswith(self.strings[i], p):
                    out[t].add(i)
        return [sorted(x) for x in out]


def rolling(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes at each place: a polynomial modulo 2^64, by doubling, then mixed."""
    h, step = data.astype(np.uint64) + np.uint64(1), 1
    factor = ODD
    while step < q:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        step *= 2
    return h ^ h >> np.uint64(32)


def matched(text: Column, strings: Sequence[str]) -> Column:
    """array<int>: the numbers of the strings that a text contains, ascending; null for null. At most BLOCK_BYTES of strings."""
    if sum(len(s.encode()) for s in strings) > BLOCK_BYTES:
        raise ValueError("more strings than one pass takes: use match_table")
    kept = list(strings)

    @F.pandas_udf("array<int>")
    def run(parts: pd.Series) -> pd.Series:
        out: list = [None] * len(parts)
        todo = [i for i, t in enumerate(parts) if t is not None]
        matcher = Matcher(kept)
        while todo:
            batch, size = [], 0
            while todo and (not batch or size < TEXT_BYTES):
                batch.append(todo.pop())
                size += len(parts.iloc[batch[-1]])
            for i, x in zip(batch, matcher.found([parts.iloc[i].encode() for i in batch]), strict=True):
                out[i] = x
        return pd.Series(out, dtype=object)

    return run(text)


def match_table(docs: DataFrame, text: str, strings: DataFrame, key: str, string: str) -> DataFrame:
    """docs without `text`, and `key`: a row for each string (distinct keys, none null) that a text contains. Blocks of BLOCK_BYTES of
    strings are taken in turn, each a pass over docs."""
    sized = strings.where(F.col(string).isNotNull()).select(key, string)
    total = sized.agg(F.sum(F.octet_length(string))).first()[0] or 0
    n = max(1, -(-2 * total // BLOCK_BYTES))
    rest, out = [c for c in docs.columns if c != text], None
    for k in range(n):
        block = sized.where(F.pmod(F.xxhash64(key), F.lit(n)) == k).orderBy(key).collect()  # about half of BLOCK_BYTES
        keys = F.array(*[F.lit(r[0]) for r in block]).cast(f"array<{strings.schema[key].dataType.simpleString()}>")
        hits = docs.select(*rest, F.explode(matched(F.col(text), [r[1] for r in block])).alias("_i"))
        part = hits.select(*rest, F.get(keys, F.col("_i")).alias(key))
        out = part if out is None else out.unionByName(part)
    return out
