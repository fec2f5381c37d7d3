"""Exact nearest neighbours of many queries at once, with a proof of what needn't be scored.

Points are unit vectors in cells, each cell those of one lane that are nearest to one of a bounded number of pivots. By
Cauchy-Schwarz no point of a cell scores more than the pivot's score plus the distance of the farthest point (its radius).
A query asks some lanes, with conditions of its own. It first scores its best cells, until they hold a few times k
points; its k-th score there is a floor. Then it scores every cell that its bound allows above that floor, and no other:
two rounds, whatever the number of queries. Where vectors have no clusters the bound allows nearly every cell, and the
work is that of a product of both tables; it is right in any case.

Queries and points meet by the shuffle in blocks of bounded size. A block is many small cells of a lane, or a part of a
large one; a visit is one row for each query and block, with marks for the block's cells that it asks. So where no cell is
excluded, rows grow with the product of queries and points over a block's size, not with queries times cells; and of much
asked blocks the queries are spread over parts.

Nulls: a null, empty or zero vector, and one of null or non-finite components, is no point and no query. A null lane is a
lane; a null condition holds for all; a point's null field meets no condition. Scores are rounded to nine decimals before
they are ranked, ties by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from .buckets import shared_folder

#: Pivots at most, and the bytes that they may have (they are broadcast).
PIVOTS, PIVOT_BYTES = 512, 16 << 20
#: Pivots are chosen among so many times as many points.
SAMPLE = 8
#: Points and queries of a block at most, the bytes of its vectors, and the scores that are in memory at once.
BLOCK_POINTS, BLOCK_QUERIES, BLOCK_BYTES, SCORES = 8192, 4096, 16 << 20, 1 << 20
#: The first round's cells hold so many times k points.
FIRST = 8
DECIMALS = 9


class Lane(NamedTuple):
    """A lane's cells, their radius and their points; the cells (places in these arrays) of each of its blocks."""

    cells: np.ndarray
    radius: np.ndarray
    n: np.ndarray
    blocks: list[np.ndarray]


class Cells(NamedTuple):
    #: key, lane, cell, block, _v (unit vector), and the fields of conditions.
    points: DataFrame
    pivots: np.ndarray
    lanes: dict[object, Lane]
    key: str
    lane: str
    fields: tuple[str, ...]


def written(df: DataFrame) -> DataFrame:
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, without nulls, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that can be scored, and those as unit vectors."""
    inner = column.flatten()
    if inner.null_count:  # a vector with a null component is left out
        owner = pa.compute.list_parent_indices(column).to_numpy()
        holed = np.unique(owner[inner.is_null().to_numpy(zero_copy_only=False)])
    else:
        holed = np.zeros(0, int)
    full = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy() > 0
    full[holed] = False
    at = np.flatnonzero(full)
    if not len(at):
        return np.zeros(0, int), np.zeros((0, 0))
    v = matrix(column.take(pa.array(at)))
    with np.errstate(all="ignore"):
        norm = np.sqrt((v * v).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return at[ok], v[ok] / norm[ok, None]


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | Iterator[pa.Table]], schema: StructType) -> DataFrame:
    kind = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            for part in [made] if isinstance(made, pa.Table) else made:
                yield from part.cast(kind).to_batches()

    return df.mapInArrow(run, schema)


def vectors(found: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * (found.shape[1] if len(found) else 0), pa.int32()), pa.array(found.ravel()))


def spread_out(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots: each is the vector that is farthest from those before it, so that no cluster of the sample goes without."""
    most = min(most, len(sample), max(1, PIVOT_BYTES // (8 * max(1, sample.shape[1]))))
    near, chosen = np.full(len(sample), -np.inf), []
    for _ in range(most):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def chained(v: np.ndarray) -> np.ndarray:
    """An order of vectors in which each is followed by the nearest of those left, so that neighbours share blocks."""
    left, order = np.ones(len(v), bool), [0]
    for _ in range(len(v) - 1):
        left[order[-1]] = False
        order.append(int(np.where(left, v @ v[order[-1]], -np.inf).argmax()))
    return np.array(order)


def laid_out(own: np.ndarray, n: np.ndarray, pivots: np.ndarray, most: int) -> list[np.ndarray]:
    """The blocks of a lane: cells in the order of chained, as many as have `most` points together; a larger cell is
    dealt over blocks of its own."""
    blocks: list[np.ndarray] = []
    held: list[int] = []
    for i in chained(pivots[own]):
        if held and n[held].sum() + n[i] > most:
            blocks.append(np.array(held))
            held = []
        if n[i] > most:
            blocks += [np.array([i])] * int(-(-n[i] // most))
        else:
            held.append(int(i))
    return [*blocks, np.array(held)] if held else blocks


def cells(points: DataFrame, key: str, vector: str, lane: str, fields: Sequence[str] = (), most: int = PIVOTS) -> Cells:
    """Points laid out in cells. Vectors have one length. fields: string columns that queries may set conditions on."""
    kept = points.select(key, lane, *fields, vector)
    some = kept.where(F.size(vector) > 0).orderBy(F.xxhash64(F.col(key).cast("string"))).select(vector).limit(SAMPLE * most)
    pivots = spread_out(unit_rows(pa.array([r[0] for r in some.collect()], pa.list_(pa.float64())))[1], most)
    own = [kept.schema[c] for c in (key, lane, *fields)]
    schema = StructType([*own, StructField("cell", IntegerType()), StructField("_far", DoubleType()), StructField("_v", ArrayType(DoubleType()))])

    def dealt(batch: pa.RecordBatch) -> pa.Table:
        at, v = unit_rows(batch.column(vector))
        near = v @ pivots.T if len(at) else np.zeros((0, 1))
        cell = near.argmax(1)
        far = np.sqrt(((v - pivots[cell]) ** 2).sum(1)) if len(at) else np.zeros(0)
        names = [f.name for f in own]
        return pa.table([*[batch.column(c).take(pa.array(at)) for c in names], pa.array(cell, pa.int32()), pa.array(far), vectors(v)], names=schema.names)

    rows = written(mapped(kept, dealt, schema))
    told = rows.groupBy(lane, "cell").agg(F.max("_far").alias("r"), F.count("*").alias("n")).orderBy("cell").collect()  # lanes times pivots
    found: dict[object, list] = {}
    for r in told:
        found.setdefault(r[0], []).append((r["cell"], r["r"], r["n"]))
    size = max(1, min(BLOCK_POINTS, BLOCK_BYTES // (8 * max(1, pivots.shape[1]))))
    lanes: dict[object, Lane] = {}
    places = []
    for k, v in found.items():
        at, radius, n = map(np.array, zip(*v, strict=True))
        lanes[k] = Lane(at, radius, n, laid_out(at, n, pivots, size))
        first: dict[int, list[int]] = {}
        for block, held in enumerate(lanes[k].blocks):
            for i in held.tolist():
                first.setdefault(i, []).append(block)
        places += [(k, int(at[i]), b[0], len(b)) for i, b in first.items()]
    kind = StructType([StructField("_l", points.schema[lane].dataType), StructField("_c", IntegerType()), StructField("_first", IntegerType()), StructField("_many", IntegerType())])
    where = F.broadcast(rows.sparkSession.createDataFrame(places, kind))
    rows = rows.join(where, F.col(lane).eqNullSafe(F.col("_l")) & (F.col("cell") == F.col("_c"))).withColumn("block", (F.col("_first") + F.pmod(F.xxhash64(key), F.col("_many"))).cast("int"))
    return Cells(rows.drop("_l", "_c", "_first", "_many", "_far"), pivots, lanes, key, lane, tuple(fields))


def visits(asked: DataFrame, c: Cells, k: int, query: str, floors: DataFrame | None) -> DataFrame:
    """query, lane, block and marks (a bit for each cell of the block) of each visit: of the first round, or of the second,
    which knows each floor (query, lane, floor)."""
    out = StructType([asked.schema[query], StructField(c.lane, asked.schema[c.lane].dataType), StructField("block", IntegerType()), StructField("marks", BinaryType()), StructField("_q", ArrayType(DoubleType()))])
    rows = asked.select(query, c.lane, "_q")
    rows = rows.withColumn("floor", F.lit(None).cast("double")) if floors is None else rows.join(floors, [query, c.lane], "left")
    pivots, lanes, second, lane = c.pivots, c.lanes, floors is not None, c.lane

    def plan(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for begin in range(0, batch.num_rows, 1024):
            part = batch.slice(begin, 1024)
            near = matrix(part.column("_q")) @ pivots.T
            pick, block, marks = [], [], []
            for i, (which, floor) in enumerate(zip(part.column(lane).to_pylist(), part.column("floor").to_pylist(), strict=True)):
                if which not in lanes:
                    continue
                own = lanes[which]
                bound = near[i, own.cells] + own.radius
                order = np.argsort(-bound, kind="stable")
                first = int(np.searchsorted(np.cumsum(own.n[order]), FIRST * k)) + 1
                if second:  # rounding must not hide a tie with the floor
                    order = order[first:][bound[order[first:]] >= (-9 if floor is None else floor) - 10.0 ** (1 - DECIMALS)]
                else:
                    order = order[:first]
                asks = np.zeros(len(bound), bool)
                asks[order] = True
                for b, held in enumerate(own.blocks):
                    if asks[held].any():
                        pick.append(i)
                        block.append(b)
                        marks.append(np.packbits(asks[held]).tobytes())
            at = pa.array(pick, pa.int64())
            yield pa.table([part.column(query).take(at), part.column(lane).take(at), pa.array(block, pa.int32()), pa.array(marks, pa.binary()), part.column("_q").take(at)], names=out.names)

    return mapped(rows, plan, out)


def k_best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest scores of each row, ties to the smaller column; -inf is no score."""
    floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    row, col = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept]


def scored(c: Cells, went: DataFrame, wants: DataFrame, k: int, query: str) -> DataFrame:
    """The k best of each block for each visit: query, lane, key, score; and rows without a key whose score says how many
    points were scored."""
    conditions = [f"want_{f}" for f in c.fields]
    went = written(went)
    keys = [c.lane, "block"]
    asked = F.broadcast(went.groupBy(*[F.col(x).alias(f"_{x}") for x in keys]).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("long").alias("_parts")))  # blocks
    both = lambda df: df[c.lane].eqNullSafe(F.col(f"_{c.lane}")) & (df["block"] == F.col("_block"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    points = c.points.join(asked, both(c.points)).withColumn("part", each("_parts")).drop("_parts", *[f"_{x}" for x in keys])
    queries = went.join(wants.select(query, *conditions), query) if conditions else went
    queries = queries.join(asked, both(queries)).withColumn("part", F.pmod(F.xxhash64(query), F.col("_parts"))).drop("_parts", *[f"_{x}" for x in keys])
    group = F.xxhash64(*keys, "part")
    out = StructType([went.schema[query], c.points.schema[c.lane], c.points.schema[c.key], StructField("score", DoubleType())])
    names, lane, key, fields, lanes = out.names, c.lane, c.key, c.fields, c.lanes
    kind = to_arrow_schema(out)

    def met(which: object, block: int, of: pa.Table, by: pa.Table) -> Iterator[pa.Table]:
        """of: the points of a block; by: queries that visit it."""
        of = of.take(pa.compute.sort_indices(of.column(key)))  # nulls last
        own, x, q, asking = lanes[which], matrix(of.column("_v")), matrix(by.column("_q")), by.column(query).combine_chunks()
        held = own.blocks[block]
        place = np.zeros(int(own.cells.max()) + 1, int)
        place[own.cells[held]] = np.arange(len(held))
        at = place[of.column("cell").to_numpy()]
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(held) + 1))
        marks = np.unpackbits(np.frombuffer(b"".join(by.column("marks").to_pylist()), np.uint8).reshape(by.num_rows, -1), axis=1)[:, : len(held)].astype(bool)
        fits = np.ones((by.num_rows, 1), bool)
        for f in fields:
            coded = of.column(f).combine_chunks().dictionary_encode(null_encoding="encode")
            values = coded.dictionary.to_pylist()
            may = np.array([[w is None or v is not None and v in w for v in values] for w in by.column(f"want_{f}").to_pylist()])
            fits = fits & may[:, coded.indices.to_numpy()]
        step = max(1, SCORES // of.num_rows)
        for i in range(0, by.num_rows, step):
            part = slice(i, i + step)
            scores = np.full((len(q[part]), of.num_rows), -np.inf)
            for cell in np.flatnonzero(marks[part].any(axis=0)):
                asks, stand = np.flatnonzero(marks[part, cell]), order[ends[cell] : ends[cell + 1]]
                scores[np.ix_(asks, stand)] = np.round(q[part][asks] @ x[stand].T, DECIMALS)
            if fields:
                scores[~np.broadcast_to(fits[part], scores.shape)] = -np.inf
            row, col = k_best(scores, k)
            asks = pa.concat_arrays([asking.slice(i, step).take(pa.array(row)), asking.slice(i, step)])
            ids = pa.concat_arrays([of.column(key).combine_chunks().take(pa.array(col)), pa.nulls(len(scores), of.column(key).type)])
            said = np.concatenate([scores[row, col], (scores > -np.inf).sum(axis=1).astype(float)])
            yield pa.table([asks, pa.array([which] * len(ids), kind.field(1).type), ids, pa.array(said)], names=names).cast(kind)

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        groups: dict[tuple, tuple[list[int], list[int]]] = {}
        # groups are hashes: of those that share one, only equal ones meet
        for side, t in enumerate((left, right)):
            for i, g in enumerate(zip(*[t.column(x).to_pylist() for x in (lane, "block", "part")], strict=True)):
                groups.setdefault(g, ([], []))[side].append(i)
        found = [t for g, (of, by) in groups.items() if of and by for t in met(g[0], g[1], left.take(pa.array(of)), right.take(pa.array(by)))]
        return pa.concat_tables(found) if found else kind.empty_table()

    return points.withColumn("_g", group).groupBy("_g").cogroup(queries.withColumn("_g", group).groupBy("_g")).applyInArrow(product, out)


def best_of(found: DataFrame, k: int, query: str, lane: str, key: str) -> DataFrame:
    by = Window.partitionBy(query, lane).orderBy(F.col("score").desc(), F.col(key))
    return found.where(F.col(key).isNotNull()).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_of_lanes(points: DataFrame, queries: DataFrame, key: str, k: int, query: str = "query_id", vector: str = "embedding", lane: str = "lane", fields: Sequence[str] = (), pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """query, lane, key, score, rank: the k best points of each lane that a query asks; and query, lane, scored: how many
    points were scored for it. Keys are unique and not null.

    points: key, vector, lane, fields. queries: query (unique), vector, lanes (an array, null for all), and for each field
    an array want_<field> of the values that fit (null: all)."""
    c = cells(points, key, vector, lane, fields, pivots)
    wants = queries.withColumns({f"want_{f}": queries[f"want_{f}"] if f"want_{f}" in queries.columns else F.lit(None).cast("array<string>") for f in fields})
    schema = StructType([queries.schema[query], StructField("lanes", ArrayType(points.schema[lane].dataType)), StructField("_q", ArrayType(DoubleType()))])

    def units(batch: pa.RecordBatch) -> pa.Table:
        at, v = unit_rows(batch.column(vector))
        take = lambda x: batch.column(x).take(pa.array(at))
        return pa.table([take(query), take("lanes"), vectors(v)], names=schema.names)

    every = F.array(*[F.lit(x).cast(points.schema[lane].dataType) for x in c.lanes])
    asked = mapped(queries.select(query, "lanes", vector), units, schema)
    asked = written(asked.select(query, F.explode(F.array_distinct(F.coalesce("lanes", every) if c.lanes else F.col("lanes"))).alias(lane), "_q"))
    first = written(scored(c, visits(asked, c, k, query, None), wants, k, query))
    floors = best_of(first, k, query, lane, key).where(F.col("rank") == k).select(query, lane, F.col("score").alias("floor"))
    second = written(scored(c, visits(asked, c, k, query, floors), wants, k, query))
    found = first.unionByName(second)
    counts = found.where(F.col(key).isNull()).groupBy(query, lane).agg(F.sum("score").cast("long").alias("scored"))
    return best_of(found, k, query, lane, key), counts


def weighted(best: DataFrame, weights: DataFrame, k: int, query: str, lane: str, key: str) -> DataFrame:
    """Of each query the best over its lanes, k for each of them. weights: query, lane, weight; scores are multiplied."""
    told = weights.withColumn("_lanes", F.count("*").over(Window.partitionBy(query)))
    rows = best.drop("rank").join(told, [query, lane]).withColumn("score", F.col("score") * F.col("weight"))
    by = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(key))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k * F.col("_lanes")).drop("_lanes", "weight")
