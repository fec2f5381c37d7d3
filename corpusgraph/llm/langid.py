"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams (1 to 3 characters, letters lower-cased, anything else a space) are made on the executors from
a bounded sample of labelled rows, SAMPLE_ROWS of each language at most in expectation; their log-probabilities are a
matrix of BUCKETS rows and a column per language, which is broadcast. A batch's n-grams are scored by one gather and one
segmented sum.

A null text, or one without a letter, is `und` with score 0, as is everything if nothing was learned. Very long texts
are scored whole, in slices. Ties go to the language that sorts first. Repeated rows each get a row; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, map_slices, read, slices

BUCKETS = 1 << 16
#: Labelled rows that are learned from, for each language.
SAMPLE_ROWS = 1500
SPACE = 32


def letter_table() -> np.ndarray:
    """For code points below 65,536: the lower-case letter, or a space. Others stand for themselves."""
    table = np.full(1 << 16, SPACE, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of texts, the text that each is of, and for each text whether it has a letter."""
    table = held("letters", None, letter_table)
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    far = a >= 1 << 16
    c = table[np.where(far, SPACE, a)]
    if far.any():
        letters = np.array([x for x in np.unique(a[far]) if chr(x).isalpha()], np.uint32)
        c = np.where(far & np.isin(a, letters), a, c)
    lettered = np.bincount(of[c != SPACE], minlength=len(texts)) > 0
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE) | (of[1:] != of[:-1])  # a run of spaces is one
    c, of = c[keep], of[keep]
    h1 = c * np.uint32(0x9E3779B1)
    h2 = (h1[:-1] ^ c[1:]) * np.uint32(0x85EBCA77) if len(c) > 1 else h1[:0]
    h3 = (h2[:-1] ^ c[2:]) * np.uint32(0xC2B2AE3D) if len(c) > 2 else h1[:0]
    h = [(x ^ x >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(16) for x in (h1, h2, h3)]
    inside = [np.ones(len(c), bool), of[1:] == of[:-1], of[2:] == of[:-2]]
    inside[0] = c != SPACE
    inside[1:] = [x[: len(y)] for x, y in zip(inside[1:], h[1:], strict=True)]
    ids = np.concatenate([x[m] for x, m in zip(h, inside, strict=True)])
    own = np.concatenate([of[: len(m)][m] for m in inside])
    return ids, own, lettered


def counted(docs: DataFrame) -> dict[str, np.ndarray]:
    """Counts of n-gram buckets for each lang, summed on the executors; what arrives has BUCKETS numbers a language at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column("lang").to_pylist()
                for lang in set(langs):
                    texts = [t for t, x in zip(part.column("text").to_pylist(), langs, strict=True) if x == lang]
                    total[lang] = total.get(lang, 0) + np.bincount(ngrams(texts)[0], minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    sums = docs.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for row in sums.groupBy("lang").agg(F.collect_list("bucket"), F.collect_list("n")).collect():
        out[row[0]] = np.zeros(BUCKETS)
        out[row[0]][row[1]] = row[2]
    return out


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability matrix (BUCKETS + 1 rows; the last has the log-priors). labelled: doc_id, text, lang.

    The prior is even: a language's share of the corpus says nothing about a text.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_rows / n))])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 11) / F.lit(float(1 << 53))
    counts = counted(labelled.where(draw < share[F.col("lang")]))
    langs = sorted(counts)
    n = np.stack([counts[x] for x in langs], axis=1) + 0.5
    table = np.log(n / n.sum(axis=0))
    return langs, np.vstack([table, np.full((1, len(langs)), -np.log(len(langs) or 1))]).astype(np.float32)


def predicted(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """Every row with all its columns, lang_pred and score."""
    matrix = docs.sparkSession.sparkContext.broadcast(table)

    def run(batch: pa.RecordBatch) -> dict:
        m = matrix.value
        texts = [t or "" for t in batch.column("text").to_pylist()]
        total, lettered = np.zeros((len(texts), len(langs))), np.zeros(len(texts), bool)
        if langs:
            ids, own, lettered = ngrams(texts)
            total += m[BUCKETS]
            for i in range(0, len(ids), 1 << 20):
                part, whose = m[ids[i : i + (1 << 20)]], own[i : i + (1 << 20)]
                at = np.concatenate(([0], np.flatnonzero(np.diff(whose)) + 1))  # n-grams of a size come in the order of texts
                np.add.at(total, whose[at], np.add.reduceat(part, at, axis=0, dtype=np.float64))
            best = total.argmax(axis=1)
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return {
            "lang_pred": [langs[best[i]] if ok else "und" for i, ok in enumerate(lettered)],
            "score": [float(p[i]) if ok else 0.0 for i, ok in enumerate(lettered)],
        }

    return map_slices(docs, run, "lang_pred string, score double", whole=True)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    return predicted(docs.select(F.col("doc_id").cast("long"), "text"), langs, table)


def fold(of: int):
    """crc32 of doc_id as text, modulo `of`; of a null doc_id: that of the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


def op3_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs, *learn(docs.where(fold(4) != 2)))
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
