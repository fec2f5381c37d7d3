"""SentencePiece encoding and decoding from a model file, without the library.

An Aho-Corasick automaton over the pieces reads a stretch of text once; at each position its output links give every
piece that ends there, and each relaxes the best score of a way to the position (Viterbi, a single pass). In a BPE model
a step from one piece to the next is possible only if merging the two pieces' text by rank gives the two again: the
scores' sum alone isn't what such a model means. Then at most one step into a position is possible, so a position that
is reached has its best score. A unigram model allows every step. Both give the library's ids.
Characters outside the vocabulary become byte pieces, or the unknown piece.

Texts are cut before runs of the space mark, which no piece of the vocabulary spans (else they stay whole). Short
stretches and the answers to possible steps are kept in caches bounded by bytes, which a worker takes from task to task
until another operator runs in it; where spaces stand alone, the text is cut at them and a word is the key. The ids of a slice are decoded at once. Null texts have null ids, empty texts none; texts of any length are whole.
Repeated rows each get a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Sequence
from itertools import groupby, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, map_slices, read

#: The default vocabulary: a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of a generation of the caches of words, other stretches and steps, about, and characters of a key at most.
WORD_BYTES, STRETCH_BYTES, STEP_BYTES, CACHED_CHARS = 40 << 20, 8 << 20, 24 << 20, 64
#: What an entry takes besides its key and value.
ENTRY_BYTES = 120
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What an unknown character scores below the worst piece, in unigram models.
UNKNOWN_PENALTY = 10.0


def fields(data: bytes):
    """Protocol-buffer fields: (number, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            value = varint()
        elif tag & 7 == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Cache(dict):
    """What make gives, in two generations: when the newer has its bytes, the older goes. size: of a value. keeps: whether
    a key's value is kept."""

    def __init__(self, make, size, most, keeps=lambda key: True):
        super().__init__()
        self.make, self.size, self.most, self.keeps, self.older, self.bytes = make, size, most, keeps, {}, 0

    def __missing__(self, key):
        if not self.keeps(key):
            return self.make(key)
        if self.bytes >= self.most:
            self.older, self.bytes = dict(self), 0
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.bytes += ENTRY_BYTES + self.size(key, value)
        return value


class Model:
    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.algorithm, self.prefix, self.squeeze = UNIGRAM, True, True
        for k, v in fields(data):
            if k == 1:
                own = dict(fields(v))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif k == 2:
                self.algorithm = dict(fields(v)).get(3, UNIGRAM)
            elif k == 3:
                own = dict(fields(v))
                self.prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
                if own.get(2):
                    raise ValueError("models with a table of character normalisation are not supported")
        if USER in self.kinds or self.algorithm not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL and p}
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.automaton = ahocorasick.Automaton()
        self.usable = self.ids if self.algorithm == UNIGRAM else {p: i for p, i in self.ids.items() if self.merged(p) == [i]}
        for p, i in self.usable.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.letters = frozenset(p for p in self.usable if len(p) == 1)
        self.lengths = list(map(len, self.pieces))
        self.follows = Cache(lambda key: self.can_follow(*divmod(key, len(self.pieces))), lambda _, __: 0, STEP_BYTES)
        self.floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        spans = any(MARK in p.lstrip(MARK) for p in self.ids)
        loose = [c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.ids)]
        stop = re.escape("".join(loose))
        self.cut = re.compile(rf"[{stop}]|{MARK}+[^{MARK}{stop}]*|[^{MARK}{stop}]+" if loose else rf"{MARK}+[^{MARK}]*|[^{MARK}]+").findall if not spans else lambda t: [t]
        size, short = lambda k, v: 4 * len(k) + len(v), lambda k: len(k) <= CACHED_CHARS
        self.cache = Cache(self.packed, size, STRETCH_BYTES, short)
        self.words = Cache(self.packed_word, size, WORD_BYTES, short) if self.prefix and not spans else None
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.raw_column = pa.array(self.raw, pa.large_binary())

    def merged(self, text: str) -> list[int]:
        """By merging the pair of best score, the leftmost of equals, until none is a piece. Defines BPE; used for short texts."""
        part = list(text)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, part[a] + part[b]))

        for a in range(len(part) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, whole = heapq.heappop(heap)
            if not part[a] or not part[b] or part[a] + part[b] != whole or right[a] != b:
                continue
            part[a], part[b], right[a] = whole, "", right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.ids.get(p, -1) for p in part if p]

    def can_follow(self, a: int, b: int) -> bool:
        return self.merged(self.pieces[a] + self.pieces[b]) == [a, b]

    def packed(self, text: str) -> bytes:
        return array("i", self.stretch(text)).tobytes()

    def packed_word(self, word: str) -> bytes:
        """The ids of a word with the space mark in front, where what follows it begins a stretch."""
        first, *more = self.cut(MARK + word)
        return self.packed(first) if not more else self.words[first[1:]] + b"".join([self.cache[x] for x in more])

    def best_path(self, text: str) -> list[int] | None:
        """The pieces of the best way through a text, -1 for a character outside the vocabulary; None if no way is possible.

        best[e], last[e]: the score of the best way up to character e, and its last piece. The extra place at the end of
        both is reached by index -1: the start."""
        n, scores, lengths = len(text), self.scores, self.lengths
        best: list = [None] * n + [0.0]
        last = [-1] * (n + 1)
        if self.algorithm == BPE:
            follows, many = self.follows, len(self.pieces)
            for end, (length, i) in self.automaton.iter(text):
                # one step into a position is possible at most, so the first is the best
                if best[end] is None and (score := best[end - length]) is not None and ((p := last[end - length]) < 0 or follows[p * many + i]):
                    best[end], last[end] = score + scores[i], i
        else:
            found: list = [[] for _ in range(n)]
            for end, match in self.automaton.iter(text):
                found[end].append(match)
            for end in range(n):
                for length, i in found[end]:
                    if (score := best[end - length]) is not None and (best[end] is None or score + scores[i] > best[end]):
                        best[end], last[end] = score + scores[i], i
                if text[end] not in self.ids and best[end - 1] is not None and (best[end] is None or best[end - 1] + self.floor > best[end]):
                    best[end], last[end] = best[end - 1] + self.floor, -1
        if n and best[n - 1] is None:
            return None
        at, out = n - 1, []
        while at >= 0:
            out.append(i := last[at])
            at -= lengths[i] if i >= 0 else 1
        return out[::-1]

    def stretch(self, text: str) -> list[int]:
        """The ids of a stretch."""
        if self.algorithm == BPE and not self.letters.issuperset(text):
            parts = [(known, "".join(part)) for known, part in groupby(text, self.letters.__contains__)]
            return [i for known, part in parts for i in (self.stretch(part) if known else self.spelt([-1] * len(part), part))]
        path = self.best_path(text)
        if path is None:
            return self.merged(text)  # not a vocabulary made by merging
        return self.spelt(path, text)

    def spelt(self, ids: list[int], text: str) -> list[int]:
        if -1 not in ids:
            return ids
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.pieces[i])
            elif self.bytes:
                out += [self.bytes[b] for b in text[at].encode()]
                at += 1
            else:
                if not out or out[-1] != self.unknown:  # unknown characters that follow each other are one piece
                    out.append(self.unknown)
                at += 1
        return out

    def encode(self, text: str) -> np.ndarray:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return np.zeros(0, np.int32)
        if self.words is not None and text[0] != " " and "  " not in text and MARK not in text:  # each space begins a stretch
            return np.frombuffer(b"".join(map(self.words.__getitem__, text.split(" "))), np.int32)
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.cut(text))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded(ids, [0, len(ids)])[0]

    def decoded(self, ids: np.ndarray, ends: Sequence[int]) -> list[str]:
        """The texts of ids that lie one after the other: text k has those from ends[k] to ends[k + 1]."""
        taken = self.raw_column.take(pa.array(ids, pa.int32()))
        at = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1, 8 * taken.offset)[np.asarray(ends)].tolist() if len(ids) else [0] * len(ends)
        data = taken.buffers()[2].to_pybytes() if len(ids) else b""
        texts = [data[a:b].decode(errors="replace") for a, b in pairwise(at)]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in texts]


def model_of(data: bytes) -> Model:
    """The model of a file's bytes, made once in each worker."""
    return held("pieces", zlib.crc32(data), lambda: Model(data))


def model_bytes(path: str = MODEL) -> bytes:
    """A vocabulary file is at most a few MB; it is read on the driver and sent to the executors."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError as e:
        raise FileNotFoundError(f"no vocabulary at {path}: give the path of a SentencePiece model file") from e


def encode_texts(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens, and of the decoded ids the CRC-32 and whether they are the text again."""
    data = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batch: pa.RecordBatch) -> dict:
        model = model_of(data.value)
        texts = batch.column("text").to_pylist()
        found = [None if t is None else model.encode(t) for t in texts]
        sizes = [0 if x is None else len(x) for x in found]
        whole = np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int32)])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        offsets = pa.array(ends, pa.int32(), mask=np.array([*[x is None for x in found], False]))
        back = [None if x is None else b for x, b in zip(found, model.decoded(whole, ends), strict=True)]
        return {
            "doc_id": batch.column("doc_id"),
            "ids": pa.ListArray.from_arrays(offsets, pa.array(whole, pa.int32())),
            "n_tokens": sizes,
            "decoded_crc32": [None if b is None else zlib.crc32(b.encode()) for b in back],
            "round_trip": [None if b is None else b == t for b, t in zip(back, texts, strict=True)],
        }

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>, n_tokens long, decoded_crc32 long, round_trip boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read(spark, sf_dir, "documents"))
