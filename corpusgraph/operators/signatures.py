"""Signatures of folders: which folders of two trees of files differ, without reading those that don't.

A folder's signature is a hash of the set of its files (path and digest) below it, in no order: the sums of 32-bit parts of
each file's MD5, and their number. So a folder's signature is the sum of its children's, and signatures of all folders take
one pass over the files and then only folders. Two trees are compared from the root, a level at a time: of each level only
children of folders that differ are looked at, so an equal subtree costs one row. Signature tables are written by level,
which makes a level a partition.

Paths are relative, with "/" between names; the root is "". A null path is left out, a null digest is a digest of its own.
Of repeated (path, digest) pairs one counts. Equal sums of unlike sets are as likely as equal 128-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import shared_folder

PARTS = ("s0", "s1", "s2", "s3", "files")
OWN = ("own0", "own1", "own2", "own3", "own")
STORED = ", ".join(["folder string", *[f"{c} long" for c in (*PARTS, *OWN)], "level int"])


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def depth(folder: Column) -> Column:
    """0 of the root, 1 of the folders in it."""
    return F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/"))).cast("int")


def signatures(files: DataFrame, path: str = "file_path", digest: str = "file_id") -> DataFrame:
    """folder, level, s0 to s3, files (how many lie below it), and own0 to own3, own (the same of the files in the folder
    itself), for every folder that has files below it."""
    one = files.where(F.col(path).isNotNull()).select(F.col(path).cast("string").alias("p"), F.col(digest).cast("string").alias("d")).distinct()
    told = F.md5(F.concat(F.octet_length("p").cast("string"), F.lit(":"), "p", F.coalesce(F.concat(F.lit("="), "d"), F.lit("-"))).cast("binary"))
    rows = one.select(parent(F.col("p")).alias("folder"), told.alias("h"))
    part = lambda k: F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long")
    own = rows.groupBy("folder").agg(*[F.sum(part(k)).alias(OWN[k]) for k in range(4)], F.count("*").alias("own"))
    names = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/")))
    sums = own.withColumn("at", F.explode(above))
    mine = lambda c: F.sum(F.when(F.col("at") == F.col("folder"), F.col(c)).otherwise(0)).alias(c)
    out = sums.groupBy("at").agg(*[F.sum(c).alias(p) for c, p in zip(OWN, PARTS, strict=True)], *[mine(c) for c in OWN])
    return out.select(F.col("at").alias("folder"), *PARTS, *OWN, depth(F.col("at")).alias("level"))


def stored(spark: SparkSession, found: DataFrame, at: str | None = None) -> str:
    """Write signatures by level; the folder that they are in."""
    at = at or shared_folder(spark)
    found.repartition("level").write.partitionBy("level").parquet(at)
    return at


def differing(spark: SparkSession, a: str, b: str) -> tuple[DataFrame, int]:
    """Folders (folder, own) that differ between two stored trees, and how many rows of signatures were looked at; own:
    whether the files in the folder itself do. A folder that only one tree has differs."""
    left, right = (spark.read.schema(STORED).parquet(x) for x in (a, b))
    levels = max(x.agg(F.max("level")).first()[0] if x.head(1) else -1 for x in (left, right))
    read, out, last = 0, spark.createDataFrame([], "folder string, own boolean"), None
    for level in range(levels + 1):
        sides = []
        for x in (left, right):
            rows = x.where(F.col("level") == level)
            sides.append(rows if last is None else rows.join(last.select(F.col("folder").alias("_up")), parent(F.col("folder")) == F.col("_up"), "left_semi"))
        names = [*PARTS, *OWN]
        mark = lambda df, side: df.select("folder", *[F.col(c).alias(f"{side}_{c}") for c in names])
        both = mark(sides[0], "a").join(mark(sides[1], "b"), "folder", "full_outer")
        of = lambda side, some: F.struct(*[F.coalesce(f"{side}_{c}", F.lit(0)) for c in some])
        unlike = lambda some: of("a", some) != of("b", some)
        at = shared_folder(spark)
        both.select("folder", unlike(PARTS).alias("differs"), unlike(OWN).alias("own")).write.parquet(at)
        seen = spark.read.schema("folder string, differs boolean, own boolean").parquet(at)
        read += seen.count()
        last = seen.where("differs")
        if not last.head(1):
            break
        out = out.unionByName(last.select("folder", "own"))
    return out, read


def changed_files(disk: DataFrame, kept: DataFrame, folders: DataFrame, path: str = "file_path", digest: str = "file_id") -> DataFrame:
    """path and op of the files of folders whose own files differ: add, update or delete. Other folders' files are dropped
    before anything is compared."""
    from .sync import diff

    own = folders.where("own").select("folder")
    some = lambda df: df.where(F.col(path).isNotNull()).join(own, parent(F.col(path)) == F.col("folder"), "left_semi").select(path, digest).distinct()
    return diff(some(disk), some(kept), path, digest).where("op <> 'keep'")
