"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled rows of quality 1; unlabelled web text is what the documents say, without their labels. The
share of positives in it, the class prior, is estimated by the best bin of a classifier of positives against unlabelled
text: the least ratio of the two distributions' upper tails, that of the positives from rows that the classifier didn't
see, that of unlabelled text from all documents, whose scores are counted in one distributed histogram. A small network on features of the whole text is then fitted
to prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)); where the second part turns negative, the
step goes back along it. Labels of quality 0 are never used.

POSITIVES and UNLABELLED bound the rows that networks are fitted on; only their features reach the driver. Nulls are empty texts;
an empty text gets the score of its features like any other. Very long texts are used whole. Without positives every
score is 0.5. Repeated rows each get a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, read, slices
from .langid import fold

POSITIVES, UNLABELLED = 3000, 4000
HIDDEN, STEPS, BATCH = 24, 1500, 256
#: Bins of scores in the histogram of all unlabelled rows.
BINS = 1000
#: What a short tail costs when the best bin is chosen, in standard deviations of a share.
SLACK = 0.5
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "far": range(128, 256), "space": (9, 10, 11, 12, 13, 32)}
N_FEATURES = 128 + len(CLASSES) + 9


def features(text: bytes | None) -> np.ndarray:
    """Rates of the ASCII characters and of classes of bytes, and how words and lines repeat."""
    text = text or b""
    out = np.zeros(N_FEATURES, np.float32)
    words = text.split()
    if not words:
        return out
    n, count = len(text), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:128] = np.log1p(1000 * count[:128] / n)
    for i, c in enumerate(CLASSES.values()):
        out[128 + i] = count[list(c)].sum() / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    own, of = len(set(words)), len(words)
    out[128 + len(CLASSES) :] = (
        own / of,
        np.log1p(own) / np.log1p(of),
        sum(map(eq, words, islice(words, 1, None))) / of,
        sum(map(eq, words, islice(words, 2, None))) / of,
        1 - len(set(lines)) / len(lines),
        np.log1p(of),
        np.log1p(of / len(lines)),
        np.log1p(n / of),
        np.log1p(max(map(len, words))),
    )
    return out


def text_hash(text: bytes | None) -> int:
    return zlib.crc32(text or b"")


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, x and hash of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        return {"doc_id": batch.column("doc_id"), "x": [features(t) for t in texts], "hash": [text_hash(t) for t in texts]}

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, x array<float>, hash long")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Net:
    """One hidden layer, over standardised features."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.05
        d = x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3], h

    def step(self, z: np.ndarray, h: np.ndarray, g: np.ndarray, rate: float) -> None:
        """Adam, for the gradient g of the risk by each output."""
        gh = g[:, None] * self.p[2] * (1 - h * h)
        grads = [z.T @ gh + 1e-4 * self.p[0], gh.sum(axis=0), h.T @ g + 1e-4 * self.p[2], np.array([g.sum()])]
        self.t += 1
        for a, m, v, d in zip(self.p, self.m, self.v, grads, strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            a -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(self.scaled(x))[0])


def binned(scores: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum((scores * BINS).astype(int), BINS - 1), minlength=BINS)


class Splits:
    """Classifiers of positives against unlabelled rows, each fitted on a half of both, and the scores of the positives that
    it didn't see. An unlabelled row's halves are bits of its hash, so that of all rows those of the other half can be told."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, hashes: np.ndarray, rng: np.random.Generator, repeats: int = 3):
        self.nets, self.held, self.sides = [], [], [(r, side) for r in range(repeats) for side in (0, 1)]
        halves = [rng.random(len(positive)) < 0.5 for _ in range(repeats)]
        for r, side in self.sides:
            seen, own = halves[r] == bool(side), unlabelled[(hashes >> r & 1) == side]
            x, y = np.vstack([positive[seen], own]), np.repeat([1.0, 0.0], [seen.sum(), len(own)])
            net = Net(x if len(x) else np.zeros((1, positive.shape[1])), rng)
            z, w = net.scaled(x), np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
            for _ in range(150):
                out, h = net.forward(z)
                net.step(z, h, w * (sigmoid(out) - y), 0.01)
            self.nets.append(net)
            self.held.append(net.score(positive[~seen]))

    def counts(self, x: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """How many rows of x that a classifier didn't see fall on each of BINS bins of its scores; a row of counts for each."""
        return np.stack([binned(net.score(x[(hashes >> r & 1) != side])) for net, (r, side) in zip(self.nets, self.sides, strict=True)])

    def prior(self, counts: np.ndarray) -> float:
        """From the counts of all unlabelled rows: the median of the classifiers' best bins."""
        found = []
        for held, n in zip(self.held, counts, strict=True):
            if not len(held) or not n.sum():
                continue
            tail, part = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (binned(held), n))
            fits = (tail >= 0.2) & (tail <= 0.98)
            slack = SLACK * (np.sqrt(1 / len(held)) + np.sqrt(1 / n.sum()))
            if fits.any():
                best = int(np.argmin(np.where(fits, (part + slack) / np.maximum(tail, 1e-9), np.inf)))
                found.append(part[best] / tail[best])
        return float(np.clip(np.median(found), 0.02, 0.98)) if found else 0.5


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, rng: np.random.Generator) -> float:
    """The share of positives in unlabelled rows that are all at hand."""
    hashes = rng.integers(0, 1 << 16, len(unlabelled))
    splits = Splits(positive, unlabelled, hashes, rng)
    return splits.prior(splits.counts(unlabelled, hashes))


def counted(docs: DataFrame, splits: Splits) -> np.ndarray:
    """Splits.counts over the texts of all rows: each task sums its own, what arrives has BINS numbers a classifier."""
    sent, many = docs.sparkSession.sparkContext.broadcast(splits), len(splits.nets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((many, BINS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                if texts:
                    total += sent.value.counts(np.stack([features(t) for t in texts]), np.array([text_hash(t) for t in texts]))
        net, bin_ = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(net), pa.array(bin_), pa.array(total[net, bin_])], ["net", "bin", "n"])

    out = np.zeros((many, BINS), np.int64)
    for r in docs.select("text").mapInArrow(run, "net long, bin long, n long").groupBy("net", "bin").agg(F.sum("n").alias("n")).collect():
        out[r["net"], r["bin"]] = r["n"]
    return out


def risk(out: np.ndarray, positives: int, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of outputs, positives first: prior * R+, the unbiased R- (unlabelled less the prior's share), and the gradients of both.
    The loss is the sigmoid's."""
    minus, n, m = sigmoid(out), positives, len(out) - positives  # the loss of a positive call where the truth is negative
    slope, part = minus * (1 - minus), np.arange(len(out)) < positives
    plus, negative = prior * (1 - minus[:n]).mean(), minus[n:].mean() - prior * minus[:n].mean()
    g_plus, g_negative = np.where(part, -prior * slope / n, 0.0), np.where(part, -prior * slope / n, slope / m)
    return float(plus), float(negative), g_plus, g_negative


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, seed: int = 11) -> tuple[Net, float]:
    """Non-negative risk with the sigmoid loss."""
    rng = np.random.default_rng(seed)
    prior = class_prior(positive, unlabelled, rng) if prior is None else prior
    net = Net(unlabelled, rng)
    zp, zu = net.scaled(positive), net.scaled(unlabelled)
    for t in range(STEPS):
        a, b = zp[rng.integers(0, len(zp), BATCH)], zu[rng.integers(0, len(zu), BATCH)]
        z = np.vstack([a, b])
        out, h = net.forward(z)
        _, negative, g_plus, g_negative = risk(out, BATCH, prior)
        net.step(z, h, g_plus + g_negative if negative >= 0 else -g_negative, 0.01 * (1 - t / STEPS) + 1e-4)
    return net, prior


def bounded_ids(rows: DataFrame, n: int, seed: int) -> list[int]:
    """At most n doc_ids, by a hash."""
    key = F.xxhash64("doc_id", F.lit(seed))
    return [r[0] for r in rows.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), key.alias("k")).distinct().orderBy("k", "doc_id").limit(n).collect()]


def chosen(docs: DataFrame, ids: set[int]) -> DataFrame:
    """The rows of a bounded set of ids, one of each."""
    few = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "doc_id long"))
    return docs.select(F.col("doc_id").cast("long"), "text").join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, keep) -> Net | None:
    """keep: a condition on doc_id for rows that may be learned from."""
    ids = set(bounded_ids(labels.where((F.col("quality") == 1) & keep), POSITIVES, 21))
    others = set(bounded_ids(docs.where(keep), UNLABELLED, 22))
    if not ids or not others:
        return None
    x = {r[0]: (np.array(r[1], np.float64), r[2]) for r in featured(chosen(docs, ids | others)).collect()}
    p, u = [x[i][0] for i in sorted(ids) if i in x], [x[i] for i in sorted(others) if i in x]
    if not p or not u:
        return None
    p, hashes, u = np.stack(p), np.array([h for _, h in u]), np.stack([v for v, _ in u])
    splits = Splits(p, u, hashes, np.random.default_rng(13))
    return fit(p, u, splits.prior(counted(docs, splits)))[0]


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        got = sent.value.score(np.stack([features(t) for t in texts])) if sent.value is not None and texts else np.full(len(texts), 0.5)
        return {"doc_id": batch.column("doc_id"), "score": got}

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = score(docs, learn(docs, labels, fold(3) != 1))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
