"""Minimum-cost-flow resharding.

Old shard sizes are supplies, new capacities are demands; an arc i -> i (rows that stay) costs nothing and an arc
i -> j costs one per byte, so the cheapest flow moves the fewest bytes. Each old shard is laid out in the order of a
hash of its rows' places in the files and cut where the flow says: the first part stays, the others are the blocks that
move. So a row's new shard follows from its place and a few cuts, and texts are shuffled once, to the files of their new
shards. Offsets are distributed prefix sums over hash buckets: no task holds more than a bucket's rows, whatever keys or
texts are alike, and the driver sees shard sizes and cuts only. Only shards whose rows change are rewritten.

Nulls: a null text has no bytes (size 1, CRC-32 of the empty string); a null doc_id is a value like any other. Repeated
rows each get a place of their own. An empty table gives no rows. Extra columns are kept in the files, but for those
named shard, slot or old_shard, which are left out.
"""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import materialize, read, scratch

#: Rows of a hash bucket, on average: few beside those of a partition, so that partitions fill evenly.
BUCKET_ROWS = 250


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> tuple[list[int], int]:
    """Successive shortest paths. arcs: (from, to, capacity, cost); returns the flow of each arc and the total cost."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)
    total = 0
    while True:
        dist, via, queue, queued = [None] * n, [-1] * n, deque([source]), [False] * n
        dist[source] = 0
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in out[x]:
                y = to[e]
                if cap[e] and (dist[y] is None or dist[x] + cost[e] < dist[y]):
                    dist[y], via[y] = dist[x] + cost[e], e
                    if not queued[y]:
                        queued[y] = True
                        queue.append(y)
        if dist[sink] is None:
            return [cap[2 * k + 1] for k in range(len(arcs))], total
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
        total += push * dist[sink]


def plan_transfers(old: list[int], new: list[int]) -> list[list[int]]:
    """Units that go from each old shard to each new one; row and column sums are the sizes given."""
    if sum(old) != sum(new):
        raise ValueError("the new capacities must hold exactly what the old shards hold")
    n, m = len(old), len(new)
    arcs = [(0, 1 + i, s, 0) for i, s in enumerate(old)] + [(1 + n + j, 1 + n + m, c, 0) for j, c in enumerate(new)]
    pairs = [(i, j) for i in range(n) for j in range(m)]
    arcs += [(1 + i, 1 + n + j, min(old[i], new[j]), int(i != j)) for i, j in pairs]
    flow, _ = min_cost_flow(n + m + 2, arcs, 0, n + m + 1)
    moved = [[0] * m for _ in range(n)]
    for (i, j), f in zip(pairs, flow[n + m :], strict=True):
        moved[i][j] = f
    return moved


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


class Placement(NamedTuple):
    #: Of each old shard: where its parts begin in the order of _at, and the new shard of each part.
    cuts: dict[int, list[tuple[int, int]]]
    buckets: int
    #: shard, _old, _bucket, _first: how many rows of the shard come before the bucket's.
    firsts: DataFrame


def numbered(table: DataFrame, text: str) -> DataFrame:
    """A table read from Parquet files with _at, a hash of each row's place in them (63 bits), and _size."""
    place = F.shiftrightunsigned(F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"), F.lit(17)), 1)
    return table.withColumn("_at", place).withColumn("_size", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"))


def bucket_of(buckets: int) -> Column:
    return F.floor(F.shiftright("_at", 32) * buckets / F.lit(1 << 31))


def shard_of(cuts: dict[int, list[tuple[int, int]]]) -> Column:
    """The new shard of a row, by _old and _at."""
    out: Column = F.lit(None)
    for old, parts in cuts.items():
        one: Column = F.lit(parts[0][1])
        for begin, shard in parts[1:]:
            one = F.when(F.col("_at") >= begin, F.lit(shard)).otherwise(one)
        out = F.when(F.col("_old") == old, one).otherwise(out)
    return out.cast("int")


def placement(rows: DataFrame, n_old: int, n_new: int) -> Placement:
    """Where rows (_old, _size, _at) go from the old shards 0..n_old-1, to n_new even ones, moving the fewest bytes.

    rows should be thin and written (see materialize). Each new shard is within a few rows of its capacity: a flow has at
    most n_old + n_new - 1 arcs in use, and each cut is at the row boundary nearest to it.
    """
    held = {r[0]: (r[1], r[2]) for r in rows.groupBy("_old").agg(F.sum("_size"), F.count("*")).collect()}
    sizes = [held.get(i, (0, 0))[0] for i in range(n_old)]
    moved = plan_transfers(sizes, even(sum(sizes), n_new))
    buckets = max(1, sum(n for _, n in held.values()) // (BUCKET_ROWS * n_old))
    rows = rows.withColumn("_bucket", bucket_of(buckets))
    sums = rows.groupBy("_old", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_old").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_old", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_old", "_bucket").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(sums, ["_old", "_bucket"]).withColumn("_start", F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))

    part: Column = F.lit(0)
    order = [[j for j in sorted(range(n_new), key=lambda j: (j != i, j)) if moved[i][j]] for i in range(n_old)]
    for i, shards in enumerate(order):  # what stays comes first; then the blocks that move, by new shard
        one: Column = F.lit(len(shards) - 1)
        for k in reversed(range(len(shards) - 1)):
            one = F.when(F.col("_start") * 2 + F.col("_size") < 2 * sum(moved[i][j] for j in shards[: k + 1]), F.lit(k)).otherwise(one)
        part = F.when(F.col("_old") == i, one).otherwise(part) if shards else part
    begins = placed.groupBy("_old", part.alias("part")).agg(F.min("_at").alias("at")).orderBy("_old", "part").collect()
    cuts: dict[int, list[tuple[int, int]]] = {}
    for r in begins:
        cuts.setdefault(r["_old"], []).append((r["at"], order[r["_old"]][r["part"]]))

    counts = rows.groupBy(shard_of(cuts).alias("shard"), "_old", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_old", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "_old", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    return Placement(cuts, buckets, materialize(firsts))


def located(rows: DataFrame, to: Placement) -> DataFrame:
    """rows (_old, _at and any others) with shard and slot: one shuffle, by parts of a bucket."""
    rows = rows.withColumn("shard", shard_of(to.cuts)).withColumn("_bucket", bucket_of(to.buckets))
    place = Window.partitionBy("shard", "_old", "_bucket").orderBy("_at")
    out = rows.join(to.firsts, ["shard", "_old", "_bucket"])
    return out.withColumn("slot", (F.col("_first") + F.row_number().over(place) - 1).cast("long")).drop("_bucket", "_first")


def changed(to: Placement, n_old: int) -> list[int]:
    """Shards, old or new, that a row leaves or enters."""
    return sorted({x for old, parts in to.cuts.items() for _, new in parts if new != old for x in (old, new)})


def old_layout(doc_id: Column, n_old: int) -> Column:
    """The layout that is resharded: a hash of doc_id over n_old shards, shard 0 holding two shares."""
    return (F.pmod(F.xxhash64(doc_id), F.lit(n_old + 1)) % n_old).cast("int")


def resharded(table: DataFrame, n_old: int, n_new: int, dst: str, text: str = "text") -> tuple[DataFrame, list[int]]:
    """A table read from Parquet files, with the column _old, in its new shards: the changed ones are written under dst and
    read back, the others stay in their files. Returns all rows with shard, slot and _old, and the changed shards."""
    data = [c for c in table.columns if c.lower() not in ("shard", "slot", "old_shard", "_old")]
    sized = numbered(table, text)
    to = placement(materialize(sized.select("_old", "_size", "_at")), n_old, n_new)
    touched = changed(to, n_old)
    at = located(sized.select(*data, "_old", "_at"), to).select(*data, F.col("_old").alias("old_shard"), "shard", "slot")
    spark = table.sparkSession
    schema = StructType([*at.drop("shard").schema.fields, StructField("shard", IntegerType())])
    at.where(F.col("shard").isin(touched)).write.mode("overwrite").partitionBy("shard").parquet(dst)
    new = spark.read.schema(schema).parquet(dst)
    rest = at.where(~F.col("shard").isin(touched))
    return (new.unionByName(rest) if any(i not in touched for i in range(n_old)) else new), touched


def op1_reshard_flow(spark: SparkSession, sf_dir: str, n_old: int = 6, n_new: int = 8) -> DataFrame:
    """All documents in shards 0..7 by the law `bytes`, from a layout of six uneven shards; read back from the new files."""
    docs = read(spark, sf_dir, "documents")
    docs = docs.withColumn("_old", old_layout(F.col("doc_id"), n_old))
    rows, _ = resharded(docs, n_old, n_new, scratch(spark))
    return rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def rewrite_shards(spark: SparkSession, src: str, dst: str, n_new: int, text: str = "text") -> dict[str, list[int]]:
    """Reshard a Parquet table partitioned by an int column `shard`, to n_new shards of even bytes under dst.

    Only the shards whose rows change are rewritten there; the others are named in the answer and keep their files.
    """
    table = spark.read.parquet(src)
    n_old = (table.agg(F.max("shard")).first()[0] or 0) + 1
    _, touched = resharded(table.withColumnRenamed("shard", "_old"), n_old, n_new, dst, text)
    return {"rewritten": [s for s in touched if s < n_new], "emptied": [s for s in touched if s >= n_new], "kept": [s for s in range(n_old) if s not in touched]}
