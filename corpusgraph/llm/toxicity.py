"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input joins a hashed word vector and the mean of hashed vectors of its character n-grams. Windows of WINDOW
words that overlap by half cover the whole text; a text's score is that of its worst window. Training takes whole texts
of at most TRAIN_BYTES from a bounded sample of labelled rows (POSITIVES and NEGATIVES) and learns from the window that
scores highest in each text, chosen anew in each epoch, and from random windows of the others.

Null texts, and those without a word, score 0. Ties can't arise: every row gets its own score. Repeated rows each get a
row; equal texts score equally up to float rounding. Without labels of both kinds every score is 0. An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, held, map_slices, read
from .langid import fold
from .quality import bounded_ids, chosen, sigmoid

WINDOW, STRIDE = 32, 16
WORD_BUCKETS, GRAM_BITS, WIDTH, HIDDEN, ATTENTION = 1 << 15, 18, 8, 8, 8
#: Of a position: both directions' states and the word's own input.
STATE = 2 * HIDDEN + 2 * WIDTH
POSITIVES, NEGATIVES, TRAIN_BYTES = 1200, 2000, 8000
EPOCHS, BATCH, RATE = 14, 64, 0.05
#: Of word and n-gram vectors: the rate, and where Adagrad's sums begin.
VECTOR_RATE, SEEN = 0.1, 1e-2
#: Words that a worker keeps inputs of.
VOCABULARY = 100_000
find_words = re.compile(r"[^\W_]+").findall


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 3-, 4- and 5-grams of <word>, and the word that each is of. <word> itself is one if it's short."""
    a = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 2 for w in words])
    ids, own = [], []
    h = a * np.uint32(0x9E3779B1)
    for n in range(2, 6):
        if len(a) < n:
            break
        h = (h[: len(a) - n + 1] ^ a[n - 1 :]) * np.uint32(0x85EBCA6B)
        if n > 2:
            inside = of[n - 1 :] == of[: len(a) - n + 1]
            ids.append(((h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - GRAM_BITS))[inside])
            own.append(of[: len(a) - n + 1][inside])
    return (np.concatenate(ids), np.concatenate(own)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int32))


def word_buckets(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in words], np.int64)


def windows(n: int) -> range:
    """Where the windows of n words begin."""
    return range(0, max(1, n - STRIDE), STRIDE)


def windowed(rows: np.ndarray, pad: int) -> np.ndarray:
    """Windows of one text's word rows."""
    at = windows(len(rows))
    whole = np.full((len(at) - 1) * STRIDE + WINDOW, pad, rows.dtype)
    whole[: len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(whole, WINDOW)[::STRIDE]


class Net:
    """Parameters as float32 arrays, with Adagrad. Directions are stacked: axis 0 is forward, then backward."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        n = lambda *s, by: rng.normal(0, by, s).astype(np.float32)
        self.word, self.gram = n(WORD_BUCKETS, WIDTH, by=0.05), n(1 << GRAM_BITS, WIDTH, by=0.05)
        self.p = {
            "wx": n(2, 2 * WIDTH, 3 * HIDDEN, by=0.4), "bx": np.zeros((2, 3 * HIDDEN), np.float32),
            "u": n(2, HIDDEN, 3 * HIDDEN, by=0.3),
            "a": n(STATE, ATTENTION, by=0.3), "ba": np.zeros(ATTENTION, np.float32), "v": n(ATTENTION, by=0.3),
            "w": n(STATE, by=0.3), "b": np.full(1, -1, np.float32),
        }
        self.seen = {k: np.full_like(x, 1e-2) for k, x in self.p.items()}
        self.seen_word, self.seen_gram = np.full((WORD_BUCKETS, 1), SEEN, np.float32), np.full((1 << GRAM_BITS, 1), SEEN, np.float32)

    def inputs(self, bucket: np.ndarray, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word inputs (a row of zeros for padding comes last), and the n-grams of each word."""
        n = len(bucket)
        count = np.bincount(own, minlength=n).astype(np.float32)
        sums = np.stack([np.bincount(own, self.gram[ids, j], n) for j in range(WIDTH)], axis=1) if len(ids) else np.zeros((n, WIDTH))
        e = np.concatenate([self.word[bucket], sums / np.maximum(count, 1)[:, None]], axis=1)
        return np.vstack([e, np.zeros((1, 2 * WIDTH))]).astype(np.float32), count

    def project(self, e: np.ndarray) -> list[np.ndarray]:
        """What words add to the gates of each direction, and their inputs."""
        return [*(e @ self.p["wx"][k] + self.p["bx"][k] for k in (0, 1)), e]

    def forward(self, table: list[np.ndarray], win: np.ndarray, pad: int, keep: bool = False):
        """Logits of windows of rows of `table` (see project), of which `pad` is padding."""
        p, n = self.p, len(win)
        real = (win != pad).astype(np.float32)
        hs = np.empty((2, WINDOW, n, HIDDEN), np.float32)
        steps: dict = {}
        for k in (0, 1):
            h, x_of, u = np.zeros((n, HIDDEN), np.float32), table[k], p["u"][k]
            for t in range(WINDOW) if k == 0 else range(WINDOW - 1, -1, -1):
                x, hu = x_of[win[:, t]], h @ u
                zr = 1 / (1 + np.exp(-np.clip(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN], -30, 30)))
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = h + (real[:, t, None] * (1 - z)) * (c - h)
                if keep:
                    steps[k, t] = h, z, r, c, hu[:, 2 * HIDDEN :]
                hs[k, t] = h = new
        both = np.concatenate([hs[0], hs[1], table[2][win.T]], axis=2)
        q = np.tanh(both @ p["a"] + p["ba"])
        s = np.where(real.T > 0, q @ p["v"], -1e9)
        w = np.exp(s - s.max(axis=0))
        w /= w.sum(axis=0)
        c = np.einsum("tn,tnh->nh", w, both)
        out = c @ p["w"] + p["b"]
        return (out, (real, steps, both, q, w, c)) if keep else out

    def gradients(self, bucket: np.ndarray, ids: np.ndarray, own: np.ndarray, win: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Of the mean cross-entropy of windows of local rows of words: by each parameter, by word inputs, and by the inputs' n-grams."""
        p, n = self.p, len(win)
        e, count = self.inputs(bucket, ids, own)
        out, (real, steps, both, q, w, c) = self.forward(self.project(e), win, len(e) - 1, keep=True)
        g = {k: np.zeros_like(x) for k, x in p.items()}
        d_out = (sigmoid(out) - y).astype(np.float32) / n
        g["w"], g["b"] = c.T @ d_out, d_out.sum(keepdims=True)
        dc = d_out[:, None] * p["w"]
        dw = np.einsum("nh,tnh->tn", dc, both)
        ds = w * (dw - (w * dw).sum(axis=0))
        dq = ds[:, :, None] * p["v"] * (1 - q * q)
        g["v"] = np.einsum("tn,tna->a", ds, q)
        g["a"], g["ba"] = np.einsum("tnh,tna->ha", both, dq), dq.sum(axis=(0, 1))
        d_both = w[:, :, None] * dc + dq @ p["a"].T
        d_table = np.zeros((len(e), 2, 3 * HIDDEN), np.float32)
        for k in (0, 1):
            dh, u = np.zeros((n, HIDDEN), np.float32), p["u"][k]
            for t in range(WINDOW - 1, -1, -1) if k == 0 else range(WINDOW):
                dh = dh + d_both[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                h, z, r, cand, hu = steps[k, t]
                m = real[:, t, None]
                dz = -m * dh * (cand - h) * z * (1 - z)
                dn = m * dh * (1 - z) * (1 - cand * cand)
                dr = dn * hu * r * (1 - r)
                gates = np.concatenate([dz, dr, dn], axis=1)
                np.add.at(d_table[:, k], win[:, t], gates)
                gates = np.concatenate([dz, dr, dn * r], axis=1)
                g["u"][k] += h.T @ gates
                dh = dh * (1 - m * (1 - z)) + gates @ u.T
        de = sum(d_table[:, k] @ p["wx"][k].T for k in (0, 1))
        np.add.at(de, win.T, d_both[:, :, 2 * HIDDEN :])
        de = de[:-1]
        for k in (0, 1):
            g["wx"][k], g["bx"][k] = e.T @ d_table[:, k], d_table[:-1, k].sum(axis=0)
        return g, de, de[own, WIDTH:] / np.maximum(count, 1)[own, None]

    def train(self, bucket: np.ndarray, ids: np.ndarray, own: np.ndarray, win: np.ndarray, y: np.ndarray) -> None:
        """One step of Adagrad."""
        p, n = self.p, len(win)
        g, de, dg = self.gradients(bucket, ids, own, win, y)
        for k, d in g.items():
            self.seen[k] += d * d
            p[k] -= RATE * d / np.sqrt(self.seen[k])
        for table, seen, at, d in ((self.word, self.seen_word, bucket, de[:, :WIDTH]), (self.gram, self.seen_gram, ids, dg)):
            rows, inverse = np.unique(at, return_inverse=True)
            total = np.stack([np.bincount(inverse, d[:, j], len(rows)) for j in range(WIDTH)], axis=1).astype(np.float32)
            total *= n
            seen[rows] += (total * total).mean(axis=1, keepdims=True)
            table[rows] -= VECTOR_RATE * total / np.sqrt(seen[rows])


def fit(texts: list[str], toxic: list[int], seed: int = 5) -> Net:
    """Multiple-instance learning: a text is toxic if its worst window is."""
    rng, net = np.random.default_rng(seed), Net(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in find_words(t.lower())], np.int32) for t in texts]
    pairs = [(d, y) for d, y in zip(docs, toxic, strict=True) if len(d)]
    if not pairs or len({y for _, y in pairs}) < 2:
        return net
    words, pad = list(vocabulary), len(vocabulary)
    bucket, (ids, own) = word_buckets(words), grams(words)
    order = np.argsort(own, kind="stable")
    ids, own_sorted = ids[order], own[order]
    first = np.searchsorted(own_sorted, np.arange(pad + 1))
    del own, order
    every = [windowed(d, pad) for d, _ in pairs]
    of, all_windows = np.repeat(np.arange(len(pairs)), [len(w) for w in every]), np.concatenate(every)
    y_of, starts = np.array([y for _, y in pairs]), np.concatenate(([0], np.cumsum([len(w) for w in every])))
    del docs, every, vocabulary
    for epoch in range(EPOCHS):
        if epoch < 2:
            pick = rng.integers(starts[:-1], starts[1:])
        else:
            table = net.project(net.inputs(bucket, ids, own_sorted)[0])
            logits = np.concatenate([net.forward(table, all_windows[i : i + 2048], pad) for i in range(0, len(all_windows), 2048)])
            del table
            order = np.lexsort((logits, of))
            pick = order[starts[1:] - 1]
        clean = np.flatnonzero(y_of == 0)
        more = rng.integers(starts[:-1][clean], starts[1:][clean])
        chosen_windows = np.concatenate([pick, more])
        y = np.concatenate([y_of, np.zeros(len(more), int)])
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            win = all_windows[chosen_windows[part]]
            used, local = np.unique(win, return_inverse=True)
            local = local.reshape(win.shape)
            if used[-1] == pad:
                used = used[:-1]
            sizes = first[used + 1] - first[used]
            at = np.repeat(first[used] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            net.train(bucket[used], ids[at], np.repeat(np.arange(len(used)), sizes), local, y[part])
    return net


class Scorer:
    """Scores texts, keeping the gate inputs of words that come again."""

    def __init__(self, net: Net):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = [np.zeros((1 << 12, n), np.float32) for n in (3 * HIDDEN, 3 * HIDDEN, 2 * WIDTH)]
        self.used = 1  # row 0 is padding

    def learn_words(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if not new:
            return
        got = self.net.project(self.net.inputs(word_buckets(new), *grams(new))[0])
        for k in range(3):
            if (need := self.used + len(new)) > len(self.table[k]):
                grown = np.zeros((need * 5 // 4, self.table[k].shape[1]), np.float32)
                grown[: self.used] = self.table[k][: self.used]
                self.table[k] = grown
            self.table[k][self.used : self.used + len(new)] = got[k][:-1]
        self.rows.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.used > VOCABULARY:
            self.clear()
        docs = [find_words(t.lower()) for t in texts]
        self.learn_words([w for d in docs for w in d])
        out, some = np.zeros(len(texts)), [i for i, d in enumerate(docs) if d]
        if not some:
            return out
        parts = [windowed(np.array(list(map(self.rows.__getitem__, docs[i])), np.int32), 0) for i in some]
        of, win = np.repeat(some, [len(p) for p in parts]), np.concatenate(parts)
        logits = np.concatenate([self.net.forward(self.table, win[i : i + 2048], 0) for i in range(0, len(win), 2048)])
        best = np.maximum.reduceat(logits, np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])))
        out[some] = sigmoid(best.astype(np.float64))
        return out


def learn(docs: DataFrame, labels: DataFrame, keep) -> Net | None:
    """keep: a condition on doc_id for rows that may be learned from."""
    labels = labels.where(keep & F.col("toxic").isNotNull())
    bad, good = (set(bounded_ids(labels.where(F.col("toxic") == y), n, 31)) for y, n in ((1, POSITIVES), (0, NEGATIVES)))
    if not bad or not good:
        return None
    short = docs.where(F.octet_length("text") <= TRAIN_BYTES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = sorted((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        net = fit([t for _, t in rows], [int(i in bad) for i, _ in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    sample = chosen(short, bad | good).repartition(1)  # bounded: one task fits the network, outside the driver
    got = sample.mapInArrow(run, "net binary").first()
    return got and pickle.loads(got[0])


def scored(docs: DataFrame, net: Net | None) -> DataFrame:
    """Every row with all its columns, and score."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        if sent.value is None:
            return {"score": np.zeros(len(texts))}
        scorer = held("toxicity", id(sent.value), lambda: Scorer(sent.value))
        return {"score": scorer.scores(texts)}

    return map_slices(docs, run, "score double", whole=True)


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id and score of every row."""
    return scored(docs.select(F.col("doc_id").cast("long"), "text"), net).select("doc_id", "score")


def op9_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = score(docs, learn(docs, labels, fold(5) != 0))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
