"""Exact top-k inner products by an impact-ordered index, score at a time.

Each task indexes blocks of its rows: in every dimension, rows are ordered by quantised component, so the rows of a
level are a segment. A component's contribution, counted from the least in the block (or from the greatest, where the
query is negative), is never negative; its quantised upper bound is the segment's impact. Segments of a query are
processed by descending impact class. A row not met yet in a dimension adds no more than the class's floor there, which
bounds every score; processing stops once the bound proves that most rows can't be among the k best, and the rest are
scored exactly in integers. Queries are broadcast in chunks of QUERY_CHUNK vectors at most.

Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part. Vectors of
different lengths are padded with zeros. Queries of the same vec_id count once (the first by vector); a query's own
rows are those of its vec_id. Ties go to the smaller vec_id; repeated rows each count. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

LEVELS = 64
BLOCK_ROWS = 16384
QUERY_CHUNK = 16384


class Block:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        """x: int64, a row for each id."""
        self.ids, self.x = ids, x
        n, d = x.shape
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.width = ((self.high - self.low) // LEVELS + 1).astype(np.float64)
        level = ((x - self.low) // self.width.astype(np.int64)).T
        self.rows = np.argsort(level, axis=1, kind="stable").astype(np.int32)
        ordered = np.take_along_axis(level, self.rows, axis=1)
        self.offsets = np.array([np.searchsorted(ordered[j], np.arange(LEVELS + 1)) for j in range(d)])
        self.up = (ordered + 1) * self.width[:, None]  # at least x - low
        self.down = (self.high - self.low)[:, None] - ordered * self.width[:, None]  # at least high - x

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of rows that may be among the k best, given that k rows elsewhere score `floor` or more."""
        n, d = self.x.shape
        size, positive = np.abs(query).astype(np.float64), query > 0
        span = np.where(positive, self.up[:, -1], self.down[:, 0]) * size
        base = float(np.where(positive, query * self.low, query * self.high).sum())
        bound, met = np.zeros(n), np.zeros(n)
        dims = np.flatnonzero(size)
        done = np.where(positive, n, 0)  # from the top, or up to here
        t, last = float(span.max(initial=0)), False
        best = np.arange(n)
        while n > 4 * k and len(dims):
            t = t / 1.6
            last = t < 1e-3 * span.max()
            cut = np.full(d, -1.0) if last else np.floor(t / np.maximum(size * self.width, 1e-300))
            weights, rows, sizes, counts = [], [], [], []
            for j in dims:
                if positive[j]:
                    a, b = self.offsets[j, int(min(max(cut[j], 0), LEVELS))] if not last else 0, done[j]
                    done[j] = min(a, b)
                else:  # levels l with high - low - l * width > t / size
                    reach = (self.high[j] - self.low[j]) / self.width[j] - t / (size[j] * self.width[j])
                    a, b = done[j], n if last else self.offsets[j, int(min(max(np.ceil(reach), 0), LEVELS))]
                    done[j] = max(a, b)
                if a < b:
                    rows.append(self.rows[j, a:b])
                    weights.append((self.up if positive[j] else self.down)[j, a:b])
                    sizes.append(size[j])
                    counts.append(b - a)
            if rows:
                at = np.concatenate(rows)
                bound += np.bincount(at, np.concatenate(weights) * np.repeat(sizes, counts), n)
                met += np.bincount(at, minlength=n)
            if floor == -np.inf and bound.any():  # exact scores of promising rows are a first bar
                some = np.argpartition(-bound, 4 * k)[: 4 * k]
                some = some[self.ids[some] != own]
                if len(some) >= k:
                    floor = float(np.partition(self.x[some] @ query, len(some) - k)[len(some) - k])
            best = np.flatnonzero(base + bound + (len(dims) - met) * (0 if last else t) >= floor - 1)
            if last or len(best) <= n // 8:
                break
        best = best[self.ids[best] != own]
        score = self.x[best] @ query
        if len(best) > k:
            keep = np.lexsort((self.ids[best], -score))[:k]
            best, score = best[keep], score[keep]
        return self.ids[best], score


def padded(x: np.ndarray, d: int) -> np.ndarray:
    return x if x.shape[1] == d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def matrix(column: pa.Array) -> np.ndarray:
    """List<bigint> as int64 rows."""
    rows = column.to_numpy(zero_copy_only=False)
    d = max(map(len, rows), default=0)
    return np.stack([np.pad(np.asarray(r, np.int64), (0, d - len(r))) for r in rows]) if len(rows) else np.zeros((0, d), np.int64)


def chunk_top(vectors: DataFrame, queries: list, k: int) -> DataFrame:
    """The k best of each partition for each of at most QUERY_CHUNK queries (vec_id, v)."""
    d = max(len(q[1]) for q in queries)
    asked = vectors.sparkSession.sparkContext.broadcast((np.array([q[0] for q in queries]), np.stack([np.pad(np.array(q[1], np.int64), (0, d - len(q[1]))) for q in queries])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, qs = asked.value
        best: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

        def add(own: np.ndarray, x: np.ndarray) -> None:
            wide = max(qs.shape[1], x.shape[1])
            block, padded_qs = Block(own, padded(x, wide)), padded(qs, wide)
            for i, query in enumerate(padded_qs):
                had = best[i]
                got = block.search(query, ids[i], k, float(had[1][k - 1]) if len(had[1]) == k else -np.inf)
                a, s = np.concatenate((had[0], got[0])), np.concatenate((had[1], got[1]))
                keep = np.lexsort((a, -s))[:k]
                best[i] = a[keep], s[keep]

        held: list = []
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(i, BLOCK_ROWS))
                if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                    t = pa.Table.from_batches(held).combine_chunks().to_batches()
                    for b in t:
                        add(b.column("vec_id").to_numpy(), matrix(b.column("v")))
                    held = []
        if held:
            for b in pa.Table.from_batches(held).combine_chunks().to_batches():
                if b.num_rows:
                    add(b.column("vec_id").to_numpy(), matrix(b.column("v")))
        for i in range(0, len(ids), 256):
            part = best[i : i + 256]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(ids[i : i + 256], [len(a) for a, _ in part])), pa.array(np.concatenate([a for a, _ in part])), pa.array(np.concatenate([s for _, s in part])),
            ], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def topk(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score; vectors has vec_id and v (array<bigint>, no nulls). is_query: a condition on vec_id."""
    asking, parts, last = vectors.where(is_query), [], None
    while True:
        more = asking if last is None else asking.where(F.col("vec_id") > last)
        chunk = more.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(QUERY_CHUNK).collect()
        if len(chunk) == QUERY_CHUNK and not parts:  # more rounds follow: they read vectors that are ready
            vectors = materialize(vectors)
            asking = vectors.where(is_query)
        if chunk:
            last = chunk[-1]["vec_id"]
            top = chunk_top(vectors, chunk, k)
            parts.append(top if len(chunk) < QUERY_CHUNK and not parts else materialize(top))
        if len(chunk) < QUERY_CHUNK:
            break
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(table: DataFrame) -> DataFrame:
    """floor(1024 x) of every component; vectors that take no part go."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(ok).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("v"))


def op8_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(quantised(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0, 10)


SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
