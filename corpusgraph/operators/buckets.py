"""Keyed collections in buckets, with committed versions.

A collection's rows lie in files by a hash of one column (`by`, for points their file's path), so that all points of a file
are in one bucket. A version is a manifest that lists each bucket's files, its rows, and the version that wrote it. A
change reads and rewrites only the buckets that its keys are in, writes beside the old files, and becomes the collection
when its manifest gets the next version's name. That name can be taken once: of two writers that began at one version
the second fails (Conflict), or begins again. A job that is lost before leaves files that no manifest lists.

Readers keep the version they began with until `vacuum` takes its files. The name is taken by a rename that doesn't
replace (HDFS and local disks; an object store needs a committer of its own for it).

Null keys and null `by` are values like any other. Of rows with one key in a batch the last by `order` wins; without an
order, the greatest by all columns.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Buckets of a collection unless told otherwise, and rows that a task writes of one bucket.
BUCKETS, TASK_ROWS = 64, 2_000_000


class Conflict(Exception):
    """Another writer has committed the version that this one was about to."""


class Version(NamedTuple):
    number: int
    schema: StructType
    key: str
    by: str
    buckets: int
    #: Of each bucket that has rows: files (below data/), rows, and the version that wrote them.
    files: dict[int, tuple[list[str], int, int]]
    #: Of each stream that writes here, the last batch that is in.
    batches: dict[str, int] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one of a local session, else an error."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="corpusgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/collections/{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, oldest first."""
    p, fs = _path(spark, f"{path}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The newest version, or the one of a number; None if there is none."""
    if number is None:
        found = versions(spark, path)
        if not found:
            return None
        number = found[-1]
    p, fs = _path(spark, f"{path}/manifest/v{number}.json")
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    m = json.loads(text)
    return Version(number, StructType.fromJson(m["schema"]), m["key"], m["by"], m["buckets"], {int(k): tuple(v) for k, v in m["files"].items()}, m["batches"])


def _commit(spark: SparkSession, path: str, v: Version) -> None:
    jvm = spark._jvm
    name = f"{path}/manifest/v{v.number}.json"
    tmp, fs = _path(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    stream = fs.create(tmp, False)
    stream.write(bytearray(json.dumps({"schema": v.schema.jsonValue(), "key": v.key, "by": v.by, "buckets": v.buckets, "files": v.files, "batches": v.batches}).encode()))
    stream.close()
    to, _ = _path(spark, name)
    to, tmp = fs.makeQualified(to), fs.makeQualified(tmp)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(tmp, to, options)
    except Py4JJavaError as e:
        fs.delete(tmp, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            raise Conflict(f"version {v.number} of {path} is taken") from None
        raise


def bucket_of(by: Column, buckets: int) -> Column:
    """The bucket of a value: 28 bits of its MD5, so that other engines can tell it too; null is in bucket 0."""
    hashed = F.conv(F.substring(F.md5(by.cast("string").cast("binary")), 1, 7), 16, 10).cast("int")
    return F.coalesce(hashed % buckets, F.lit(0))


def create(spark: SparkSession, path: str, schema: str | StructType, key: str, by: str | None = None, buckets: int = BUCKETS) -> bool:
    """Make an empty collection unless there is one; whether it was made. `by` is the key unless given."""
    if versions(spark, path):
        return False
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    p, fs = _path(spark, f"{path}/manifest")
    fs.mkdirs(p)
    try:
        _commit(spark, path, Version(1, kind, key, by or key, buckets, {}))
    except Conflict:
        return False
    return True


def rows_of(spark: SparkSession, path: str, v: Version, only: Sequence[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets."""
    files = [f"{path}/data/{f}" for b, (names, _, _) in sorted(v.files.items()) if only is None or b in set(only) for f in names]
    return spark.read.schema(v.schema).parquet(*files) if files else spark.createDataFrame([], v.schema)


def current(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The collection, or an older version of it; None if it was never made."""
    v = version(spark, path, number)
    return None if v is None else rows_of(spark, path, v)


def found(spark: SparkSession, path: str, value: object) -> DataFrame:
    """The rows whose `by` is a value: one bucket is read."""
    v = version(spark, path)
    kind = v.schema[v.by].dataType
    bucket = spark.range(1).select(bucket_of(F.lit(value).cast(kind), v.buckets)).first()[0]
    return rows_of(spark, path, v, [bucket]).where(F.col(v.by).eqNullSafe(F.lit(value).cast(kind)))


def last_rows(batch: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """One row of each key: the last by `order`, then by all columns."""
    whole = F.struct(*order, *[c for c in batch.columns if c not in order])
    return batch.groupBy(F.col(key).alias("_key")).agg(F.max(whole).alias("_x")).select("_x.*").select(*batch.columns)


class Change(NamedTuple):
    number: int
    #: Buckets that were written anew, and rows that came in, were replaced or deleted there.
    rewritten: list[int]
    added: int
    removed: int


def change(
    spark: SparkSession, path: str, rows: DataFrame | None = None, keys: DataFrame | None = None, files: DataFrame | None = None,
    order: Sequence[str] = (), parent: int | None = None, tries: int = 1, batch: tuple[str, int] | None = None,
) -> Change:
    """One new version: without the rows of some keys (`keys` has the key and `by`) and of some files (`files` has `by`),
    and with `rows` in place of those of their keys.

    A key's rows have one value of `by`: what changes it is deleted under the old one. parent: the version that the
    change is made for, the newest unless given; a Conflict if another came meanwhile, after so many tries. batch: a
    stream's name and its batch; one that is in already changes nothing."""
    for left in range(tries - 1, -1, -1):
        v = version(spark, path, parent)
        if batch is not None:
            if v.batches.get(batch[0], -1) >= batch[1]:
                return Change(v.number, [], 0, 0)
            v = v._replace(batches=v.batches | {batch[0]: batch[1]})
        try:
            return _changed(spark, path, v, rows, keys, files, order)
        except Conflict:
            if not left:
                raise
            parent = None


def _changed(spark: SparkSession, path: str, v: Version, rows: DataFrame | None, keys: DataFrame | None, files: DataFrame | None, order: Sequence[str]) -> Change:
    name = f"{v.number + 1}-{uuid.uuid4().hex}"
    fresh = spark.createDataFrame([], v.schema)
    if rows is not None:  # written once, for it is read several times and may be dear to make
        last = last_rows(rows, v.key, order)
        last = last.select(*[F.col(f.name).cast(f.dataType) if f.name in last.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in v.schema])
        last.write.parquet(f"{path}/batch/{name}")
        fresh = spark.read.schema(v.schema).parquet(f"{path}/batch/{name}")
    try:
        return _rewritten(spark, path, v, name, fresh, keys, files)
    finally:
        p, fs = _path(spark, f"{path}/batch/{name}")
        fs.delete(p, True)


def _rewritten(spark: SparkSession, path: str, v: Version, name: str, fresh: DataFrame, keys: DataFrame | None, files: DataFrame | None) -> Change:
    schema, bucket = v.schema, bucket_of(F.col(v.by), v.buckets)
    gone = reduce(DataFrame.unionByName, [x.select(F.col(v.key).alias("_k"), F.col(v.by).alias("_b")) for x in (fresh, keys) if x is not None])
    named = (files if files is not None else fresh.limit(0)).select(F.col(v.by).alias("_b")).distinct()
    # each of these has v.buckets rows at most
    incoming = {r["b"]: r["count"] for r in fresh.groupBy(bucket.alias("b")).count().collect()}
    places = named if keys is None else named.union(keys.select(v.by))
    touched = sorted({*incoming, *(r["b"] for r in places.select(bucket_of(F.col("_b"), v.buckets).alias("b")).distinct().collect())})
    kept = rows_of(spark, path, v, touched)
    kept = kept.join(gone, kept[v.by].eqNullSafe(gone["_b"]) & kept[v.key].eqNullSafe(gone["_k"]), "left_anti")
    if files is not None:
        kept = kept.join(named, kept[v.by].eqNullSafe(named["_b"]), "left_anti")
    tasks = [-(-((v.files[b][1] if b in v.files else 0) + incoming.get(b, 0)) // TASK_ROWS) for b in touched]
    out = kept.unionByName(fresh).withColumn("_bucket", bucket).withColumn("_part", F.pmod(F.xxhash64(v.key), F.lit(max(1, *tasks, 1))))
    out = out.repartition(max(1, sum(tasks)), "_bucket", "_part").drop("_part").sortWithinPartitions("_bucket", v.by, v.key)
    out.write.partitionBy("_bucket").parquet(f"{path}/data/{name}")
    written, counts = _files(spark, path, name), {}
    if written:
        whole = spark.read.schema(StructType([*schema.fields]).add("_bucket", IntegerType())).parquet(f"{path}/data/{name}")
        counts = {r["_bucket"]: r["count"] for r in whole.groupBy("_bucket").count().collect()}  # v.buckets rows at most
    now = {b: f for b, f in v.files.items() if b not in touched} | {b: (names, counts[b], v.number + 1) for b, names in written.items()}
    _commit(spark, path, v._replace(number=v.number + 1, files=now))
    came, before = fresh.count(), sum(v.files[b][1] for b in touched if b in v.files)
    return Change(v.number + 1, touched, came, before + came - sum(counts.values()))


def _files(spark: SparkSession, path: str, at: str) -> dict[int, list[str]]:
    p, fs = _path(spark, f"{path}/data/{at}")
    out: dict[int, list[str]] = {}
    for folder in fs.listStatus(p):
        name = folder.getPath().getName()
        if name.startswith("_bucket="):
            files = [s.getPath().getName() for s in fs.listStatus(folder.getPath())]
            out[int(name.removeprefix("_bucket="))] = sorted(f"{at}/{name}/{f}" for f in files if f.endswith(".parquet"))
    return out


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """version, bucket, n (rows) and written (the version that wrote the bucket), of all versions that are there."""
    found = [(n, b, rows, by) for n in versions(spark, path) for b, (_, rows, by) in version(spark, path, n).files.items()]
    return spark.createDataFrame(found, "version int, bucket int, n long, written int")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the newest `keep` versions, and the files that only those had; what no manifest lists stays, for a
    writer may be at it. Returns the deleted files."""
    numbers = versions(spark, path)
    listed = lambda ns: {f for n in ns for names, _, _ in version(spark, path, n).files.values() for f in names}
    gone = sorted(listed(numbers[:-keep]) - listed(numbers[-keep:])) if len(numbers) > keep else []
    for n in numbers[:-keep]:
        p, fs = _path(spark, f"{path}/manifest/v{n}.json")
        fs.delete(p, False)
    for f in gone:
        p, fs = _path(spark, f"{path}/data/{f}")
        fs.delete(p, False)
    return gone
