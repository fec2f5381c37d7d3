"""Synchronisation of collections of points with files, vectors, and stores of records and jobs.

Collections are those of `buckets`: points lie by their file's path, so that a changed file rewrites one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets, sync

#: Versions that stay beside the newest one, for readers that still hold them.
KEPT_VERSIONS = 1
#: Texts of a batch at most, and the status codes after which a call is tried again.
BATCH = 100
#: The columns that points are told apart and laid out by.
KEY, BY = "point_id", "file_path"

current, versions = buckets.current, buckets.versions


def ensure(spark: SparkSession, path: str, schema: str, n: int = buckets.BUCKETS) -> bool:
    """Make an empty collection of points unless there is one; whether it was made."""
    return buckets.create(spark, path, schema, KEY, BY, n)


def ensure_all(spark: SparkSession, root: str, names: Mapping[str, str], schemas: Mapping[str, str]) -> dict[str, str]:
    """The paths of all kinds of collections, each made if it isn't there."""
    paths = {kind: f"{root}/{name}" for kind, name in names.items()}
    for kind, at in paths.items():
        ensure(spark, at, schemas[kind])
    return paths


def delete_by_digest(points: DataFrame, digests: DataFrame, digest: str = "file_id", dry_run: bool = False) -> DataFrame:
    """The points without those of some digests; dry_run: how many those are (n) instead. Files of equal bytes share a
    digest, so all of them go: sync.delete by path is the safe way."""
    gone = points.join(digests.select(digest), digest, "left_semi")
    return gone.agg(F.count("*").alias("n")) if dry_run else points.join(digests.select(digest), digest, "left_anti")


def hashed_vector(text: str, dims: int) -> np.ndarray:
    """A unit vector of hashed words and word pairs; of an empty text the zero vector."""
    import zlib

    v, words = np.zeros(dims, np.float32), text.lower().split()
    for w in (*words, *map(" ".join, zip(words, words[1:], strict=False))):
        h = zlib.crc32(w.encode())
        v[h % dims] += 1.0 if h >> 31 else -1.0
    n = float(np.sqrt((v * v).sum()))
    return v / n if n else v


def embedded(text: Column, dims: int, task: str | None = None, backend: Callable[[list[str]], Sequence[Sequence[float]]] | None = None) -> Column:
    """Unit vectors of texts, null for null. task: put before each text as "task: ". backend: gets at most BATCH texts at a
    time and gives their vectors in order; without one, hashed_vector, which needs no network."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        places = [i for i, t in enumerate(texts) if t is not None]
        for k in range(0, len(places), BATCH):
            part = places[k : k + BATCH]
            got = [hashed_vector(texts.iloc[i], dims) for i in part] if backend is None else backend([texts.iloc[i] for i in part])
            if len(got) != len(part):
                raise ValueError(f"{len(got)} vectors for {len(part)} texts")
            for i, v in zip(part, got, strict=True):
                v = np.asarray(v, np.float32)
                n = float(np.sqrt((v * v).sum()))
                out[i] = (v / n if n else v).tolist()
        return pd.Series(out, dtype=object)

    return run(text if task is None else F.concat(F.lit(f"{task}: "), text))


def plan_of(disk: DataFrame, stored: DataFrame, path: str = "file_path", digest: str = "file_id", keep_if_empty: bool = False) -> DataFrame:
    """sync.diff of files against the stored points' files. keep_if_empty: an empty scan plans nothing, instead of deleting all."""
    ops = sync.diff(disk, sync.stored_hashes(stored, path, digest, "chunk_index"), path, digest)
    if keep_if_empty:
        some = disk.limit(1).agg((F.count("*") > 0).alias("_some"))
        ops = ops.join(F.broadcast(some), F.col("_some"), "left_semi")  # one row
    return ops


def synchronise(spark: SparkSession, path: str, files: DataFrame, points_of: Callable[[DataFrame], DataFrame], schema: str, dry_run: bool = False, keep_if_empty: bool = False) -> dict[str, int]:
    """Bring a collection in line with files (file_path, file_id, ...): points of deleted and changed files go, those of
    new and changed ones are made by points_of (chunks, enrichment, vectors) and added. Only the buckets of those files are
    written anew; if another writer commits meanwhile, this one fails with buckets.Conflict. Returns how many files are
    added, updated and deleted, and how many points came in. dry_run: only the numbers, no point is made."""
    if not dry_run:
        ensure(spark, path, schema)
    v = buckets.version(spark, path)
    stored = spark.createDataFrame([], schema) if v is None else buckets.rows_of(spark, path, v)
    ops = plan_of(files, stored, keep_if_empty=keep_if_empty)
    n = {r["op"]: r["count"] for r in ops.groupBy("op").count().collect()}
    told = {"added": n.get("add", 0), "updated": n.get("update", 0), "deleted": n.get("delete", 0), "upserted": 0}
    if dry_run or not (told["added"] or told["updated"] or told["deleted"]):
        return told
    fresh = points_of(files.join(ops.where("op IN ('add', 'update')").select("file_path"), "file_path", "left_semi"))
    done = buckets.change(spark, path, fresh, files=ops.where("op <> 'keep'"), parent=v.number)
    buckets.vacuum(spark, path, 1 + KEPT_VERSIONS)
    return told | {"upserted": done.added}


def synchronise_all(spark: SparkSession, jobs: Mapping[str, dict], only: Sequence[str] | None = None, dry_run: bool = False) -> dict[str, dict[str, int]]:
    """synchronise for each kind of collection, or those in `only`. jobs: the arguments of each."""
    return {kind: synchronise(spark, dry_run=dry_run, **args) for kind, args in jobs.items() if only is None or kind in only}


def folder_plan(disk: DataFrame, stored: DataFrame, folder: str = "example_id", only: str | None = None) -> DataFrame:
    """folder and op (write, keep, delete): dirty folders are written anew, vanished ones deleted with their summaries.
    only: that folder alone, and then nothing is deleted."""
    dirty = sync.dirty_folders(disk, stored, folder, "file_path", "file_id")
    ops = dirty.select(folder, F.when(F.col("dirty"), "write").otherwise("keep").alias("op"))
    gone = stored.select(folder).distinct().join(disk.select(folder).distinct(), folder, "left_anti").withColumn("op", F.lit("delete"))
    return ops.where(F.col(folder) == only) if only is not None else ops.unionByName(gone)


# Records and jobs.


def record(values: Mapping[str, Column], spark: SparkSession) -> DataFrame:
    """One new row: id (a random UUID), the values (structs and maps as JSON), created_at."""
    base = spark.range(1).select(F.uuid().alias("id"), *[v.alias(k) for k, v in values.items()])
    nested = {f.name for f in base.schema if f.dataType.typeName() in ("struct", "map", "array")}
    return base.select("id", *[F.to_json(k).alias(k) if k in nested else F.col(k) for k in values], F.current_timestamp().alias("created_at"))


def saved(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def cascaded(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children whose parent is still there, and those without one."""
    alone = children.where(F.col(foreign).isNull())
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_semi").select(*children.columns).unionByName(alone)


#: What state may follow which.
NEXT = {"pending": ("processing", "failed"), "processing": ("completed", "failed")}


def longest_life() -> int:
    """How many events a job can have at most: NEXT has no cycles."""
    def after(state: str) -> int:
        return 1 + max((after(x) for x in NEXT.get(state, ())), default=0)

    return after("pending")


def job_events(log: DataFrame, job: str = "id", status: str = "status", at: Sequence[str] = ("updated_at",)) -> DataFrame:
    """The log's events that are allowed after the last allowed one of their job, in the order of `at`: a job begins as
    pending and never leaves completed or failed.

    A job's next event is the least of those that its last one allows, so each step is an aggregate with one row a job;
    no task holds a job's events, however many they are."""
    cols = [c for c in log.columns if c != job]
    event = F.struct(*at, *[c for c in cols if c not in at])
    when = lambda x: F.struct(*[x[c] for c in at])
    last = log.where(F.col(status) == "pending").groupBy(job).agg(F.min(event).alias("_last"))
    steps = [last]
    for _ in range(longest_life() - 1):
        allowed = reduce(lambda a, b: a | b, [(F.col("_last")[status] == state) & F.col(status).isin(*follow) for state, follow in NEXT.items()])
        later = when({c: F.col(c) for c in at}) > when({c: F.col("_last")[c] for c in at})
        last = log.join(last, job).where(later & allowed).groupBy(job).agg(F.min(event).alias("_last"))
        steps.append(last)
    return union(steps).select(job, "_last.*").select(job, *cols)


def job_answer(states: DataFrame, job: str, kind: str) -> DataFrame:
    """What a poll for one job gives: code 404 if it isn't there, 400 if it is of another kind, else 200 with status, its
    result if it is completed, and its error if it failed."""
    one = states.sparkSession.createDataFrame([(job,)], "id string")
    row = one.join(states, "id", "left")
    code = F.when(F.col("status").isNull(), 404).when(F.col("job_type") != kind, 400).otherwise(200)
    row = row.withColumn("code", code)
    shown = lambda c, state: F.when((F.col("code") == 200) & (F.col("status") == state), F.col(c)).alias(c)
    return row.select("id", "code", F.when(F.col("code") == 200, F.col("status")).alias("status"), shown("result", "completed"), shown("error_message", "failed"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
