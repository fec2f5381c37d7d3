"""Relational division of many wish lists at once, by bitmaps.

An index has, for each feature and each range of 32,768 nodes, one bitmap of the nodes that have the feature. A wish list is
answered by OR and AND of bitmaps, range by range, so edges are read once for all lists. Equal lists are answered once (list_sizes,
list_members), and so is an OR that several lists have; what is answered costs a bitmap (4 KB) for each of its ORs and
ranges. Nodes are longs; other keys are numbered first.

Repeated edges and wishes count once; edges and wishes with nulls are left out; a list without wishes has no nodes. A
feature that no node has makes its AND empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: bits of a bitmap.
BITS = 32768


def index(edges: DataFrame) -> DataFrame:
    """feature, bucket, bits of edges (src: long, dst)."""
    rows = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("dst").alias("feature"), F.bitmap_bucket_number("src").alias("bucket"), F.bitmap_bit_position("src").alias("_at"))
    return rows.groupBy("feature", "bucket").agg(F.bitmap_construct_agg("_at").alias("bits"))


def kinds(wishes: DataFrame) -> DataFrame:
    """list and kind of each list: its ORs (sorted arrays of features), sorted; equal lists have one kind."""
    if "any" not in wishes.columns:
        wishes = wishes.withColumn("any", F.col("feature"))
    wishes = wishes.where("list IS NOT NULL AND feature IS NOT NULL AND any IS NOT NULL")
    ors = wishes.groupBy("list", "any").agg(F.array_sort(F.collect_set("feature")).alias("_or"))
    return ors.groupBy("list").agg(F.array_sort(F.collect_set("_or")).alias("kind"))


def divided_kinds(found: DataFrame, kinds: DataFrame) -> DataFrame:
    """kind, bucket, bits: the nodes that fulfil each kind of list."""
    told = kinds.select("kind").distinct()
    asked = told.select("kind", F.explode("kind").alias("_or"))
    features = asked.select("_or").distinct().select("_or", F.explode("_or").alias("feature"))
    one = features.join(found, "feature").groupBy("_or", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    whole = asked.join(one, "_or").groupBy("kind", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_n"))
    return whole.where(F.col("_n") == F.size("kind")).select("kind", "bucket", "bits")


def divided(found: DataFrame, wishes: DataFrame) -> DataFrame:
    """list, bucket, bits: the nodes that fulfil a list's wishes. wishes: list, feature and, if it has it, `any`: of wishes with one
    value of it one is enough; all others must hold. Each list has bitmaps of its own here; list_sizes and list_members need none."""
    every = kinds(wishes)
    return every.join(divided_kinds(found, every), "kind").select("list", "bucket", "bits")


def list_sizes(found: DataFrame, wishes: DataFrame) -> DataFrame:
    """sizes of divided, counted once for each kind of list."""
    every = kinds(wishes)
    counted = sizes(divided_kinds(found, every).withColumnRenamed("kind", "list")).withColumnRenamed("list", "kind")
    return every.join(counted, "kind").select("list", "n")


def list_members(found: DataFrame, wishes: DataFrame) -> DataFrame:
    """members of divided, unpacked once for each kind of list."""
    every = kinds(wishes).withColumn("_kind", F.md5(F.to_json(F.struct("kind")).cast("binary")))
    nodes = divided_kinds(found, every).select(F.md5(F.to_json(F.struct("kind")).cast("binary")).alias("list"), "bucket", "bits")
    return every.join(members(nodes).withColumnRenamed("list", "_kind"), "_kind").select("list", "src")


def sizes(divided: DataFrame) -> DataFrame:
    """list and n: how many nodes each list has, if any."""
    return divided.groupBy("list").agg(F.sum(F.bitmap_count("bits")).cast("long").alias("n")).where("n > 0")


def members(divided: DataFrame) -> DataFrame:
    """list and src: the nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column("bucket")[i].as_py()
                at = np.flatnonzero(np.unpackbits(np.frombuffer(batch.column("bits")[i].as_py(), np.uint8), bitorder="little"))
                src = (bucket - 1) * BITS + at + 1 if bucket > 0 else bucket * BITS - at
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("list")[i].as_py()] * len(src), batch.schema.field("list").type), pa.array(src, pa.int64())], names=["list", "src"])

    return divided.mapInArrow(run, f"list {divided.schema['list'].dataType.simpleString()}, src long")
