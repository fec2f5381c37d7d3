"""Incremental synchronisation: three-way differences, keyed upserts and deletes, folder checks, orphans.

Null keys are a key like any other, and a null digest is a digest that equals only itself: whether a file is on a side is
told by a mark, not by its digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import last_rows


def diff(disk: DataFrame, stored: DataFrame, key: str, digest: str, full_sync: bool = False) -> DataFrame:
    """key and op (add, update, delete, keep) by one full outer join; full_sync takes the store to be empty. Each side has
    a key once."""
    if full_sync:
        stored = stored.limit(0)
    d = disk.select(F.col(key).alias("_k"), F.col(digest).alias("_d"), F.lit(True).alias("_disk"))
    s = stored.select(F.col(key).alias("_l"), F.col(digest).alias("_s"), F.lit(True).alias("_stored"))
    op = F.when(F.col("_stored").isNull(), "add").when(F.col("_disk").isNull(), "delete").when(F.col("_s").eqNullSafe(F.col("_d")), "keep").otherwise("update")
    return d.join(s, F.col("_k").eqNullSafe(F.col("_l")), "full_outer").select(F.coalesce("_k", "_l").alias(key), op.alias("op"))


def upsert(target: DataFrame, rows: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """target with rows in place of those of their keys; of several rows of a key the last by `order`, then by all columns."""
    last = last_rows(rows, key, order)
    keys = last.select(F.col(key).alias("_k"))
    return target.join(keys, F.col(key).eqNullSafe(F.col("_k")), "left_anti").unionByName(last, allowMissingColumns=True)


def delete(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    keys = keys.select(F.col(key).alias("_k"))
    return target.join(keys, F.col(key).eqNullSafe(F.col("_k")), "left_anti")


def stored_hashes(points: DataFrame, path: str, digest: str, order: str) -> DataFrame:
    """The first digest of each path by `order`, without rows where either is null or empty."""
    ok = (F.coalesce(F.col(path).cast("string"), F.lit("")) != "") & (F.coalesce(F.col(digest), F.lit("")) != "")
    return points.where(ok).groupBy(path).agg(F.min_by(digest, order).alias(digest))


def twins(files: DataFrame, digest: str, path: str) -> DataFrame:
    """Digests that several paths share: a delete by digest would take them all."""
    return files.groupBy(digest).agg(F.count_distinct(path).alias("paths")).where("paths > 1")


def dirty_folders(disk: DataFrame, stored: DataFrame, folder: str, path: str, digest: str) -> DataFrame:
    """Folders of the disk whose set of (path, digest) isn't the stored one."""
    side = lambda df, n: df.select(folder, path, digest).distinct().withColumn("_in", F.lit(n))
    seen = side(disk, 1).unionByName(side(stored, 2)).groupBy(folder, path, digest).agg(F.sum("_in").alias("_in"))
    per = seen.groupBy(folder).agg(F.max(F.col("_in") != 3).alias("dirty"), F.max((F.col("_in") % 2 == 1)).alias("on_disk"))
    return per.where("on_disk").select(folder, "dirty")


def orphans(stored: DataFrame, disk: DataFrame, path: str) -> DataFrame:
    return stored.select(path).distinct().join(disk.select(path), path, "left_anti")
