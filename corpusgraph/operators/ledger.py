"""A ledger of model calls: what has been asked isn't asked again, and calls keep to a limit over all tasks.

A call is known by a hash of its model, schema and prompt. Its answer is written under that name as soon as it is there, in
a file of its own that appears whole, so a job that is killed loses the calls under way and no other, and a task that is
tried again finds those of its first try. A run asks what the ledger lacks; equal requests are asked once.

`at_once` tasks run side by side as one barrier stage, each making one call after the other: so many calls are under way
at most. Each has an equal share of the calls a minute, by a token bucket. Failed calls aren't in the ledger: they come
back with their error and are asked again by the next run.

The folder is one that pyarrow's file systems reach from every executor (file, hdfs, s3, gs). `compact` gathers the small files
into a table; readers see both.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import _path

ENTRY = "call_key string, answer string, tokens_in long, tokens_out long, at double"
#: Fixed value: calls under way at most, unless told otherwise.
AT_ONCE = 15


class Bucket:
    """A token bucket: `burst` calls at once, then one each time that a token is there."""

    def __init__(self, per_minute: float | None, burst: int = 1, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = per_minute and per_minute / 60, burst, clock, sleep
        self.tokens, self.then = float(burst), clock()

    def take(self) -> None:
        if not self.rate:
            return
        while True:
            now = self.clock()
            self.tokens, self.then = min(self.burst, self.tokens + (now - self.then) * self.rate), now
            if self.tokens >= 1 - 1e-9:
                self.tokens -= 1
                return
            self.sleep((1 - self.tokens) / self.rate)


def call_key(model: Column, schema: Column, prompt: Column) -> Column:
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (model, schema, prompt)]
    return F.sha2(F.concat(*parts), 256)


def known(spark: SparkSession, path: str) -> DataFrame:
    """The ledger (ENTRY), each call once."""
    found = spark.createDataFrame([], ENTRY)
    for at, read in ((f"{path}/table", lambda p: spark.read.schema(ENTRY).parquet(p)), (f"{path}/calls", lambda p: spark.read.schema(ENTRY).json(p))):
        p, fs = _path(spark, at)
        if fs.exists(p):
            found = found.unionByName(read(at))
    return found.where("call_key IS NOT NULL").dropDuplicates(["call_key"])


def _place(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)


def asked(spark: SparkSession, path: str, requests: DataFrame, call: Callable[[str, str | None, str], tuple[str, int, int]], at_once: int = AT_ONCE, per_minute: float | None = None, burst: int = 1) -> DataFrame:
    """requests (model, schema, prompt and others) with answer, tokens_in, tokens_out and error.

    call: from model, schema and prompt to the answer and the tokens that went in and out. per_minute: calls of all tasks
    together; `burst` of each may come at once. Runs when it is called; fewer tasks if there are fewer slots."""
    at_once = min(at_once, spark.sparkContext.defaultParallelism)
    keyed = requests.withColumn("call_key", call_key(F.col("model"), F.col("schema"), F.col("prompt")))
    missing = keyed.select("call_key", "model", "schema", "prompt").dropDuplicates(["call_key"]).join(known(spark, path), "call_key", "left_anti")
    share = per_minute and per_minute / at_once

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _place(f"{path}/calls")
        fs.create_dir(base, recursive=True)
        bucket = Bucket(share, burst)
        for batch in batches:
            for row in batch.to_pylist():
                to = f"{base}/{row['call_key']}.json"
                if fs.get_file_info(to).type != files.FileType.NotFound:
                    continue  # an earlier try of this task came so far
                bucket.take()
                try:
                    answer, tokens_in, tokens_out = call(row["model"], row["schema"], row["prompt"])
                except Exception as e:  # noqa: BLE001  (any fault of a call is its row's error)
                    yield pa.RecordBatch.from_pydict({"call_key": [row["call_key"]], "error": [str(e)]})
                    continue
                entry = {"call_key": row["call_key"], "answer": answer, "tokens_in": tokens_in, "tokens_out": tokens_out, "at": time.time()}
                tmp = f"{base}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(tmp) as out:
                    out.write(json.dumps(entry).encode() + b"\n")
                fs.move(tmp, to)

    failed = missing.repartition(at_once, "call_key").mapInArrow(run, "call_key string, error string", barrier=True)
    failed = spark.createDataFrame(failed.collect(), failed.schema)  # the run; a row for each failed call
    own = [c for c in requests.columns if c not in ("answer", "tokens_in", "tokens_out", "error")]
    answers = known(spark, path).drop("at")
    return keyed.select(*own, "call_key").join(answers, "call_key", "left").join(failed, "call_key", "left").select(*own, "answer", "tokens_in", "tokens_out", "error")


def compact(spark: SparkSession, path: str) -> int:
    """Gather the files of single calls into the table; how many there were. No run may be under way."""
    p, fs = _path(spark, f"{path}/calls")
    if not fs.exists(p):
        return 0
    single = spark.read.schema(ENTRY).json(f"{path}/calls").where("call_key IS NOT NULL")
    n = single.count()
    if n:
        single.repartition(1 + n // 100_000).write.mode("append").parquet(f"{path}/table")
        fs.delete(p, True)
    return n
