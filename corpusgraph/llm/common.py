"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: a temporary one in a local session, else an error, because
    executors of a cluster don't share local folders."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="corpusgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: The tables that were written since the innermost `tables_of` began; None outside.
_scope: ContextVar[list[DataFrame] | None] = ContextVar("corpusgraph_tables", default=None)


@contextlib.contextmanager
def tables_of() -> Iterator[list[DataFrame]]:
    """The tables that materialize writes inside, and no one else's: the list fills as they are written."""
    token = _scope.set(own := [])
    try:
        yield own
    finally:
        _scope.reset(token)


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder, for an operator to write to."""
    return f"{shared_dir(spark)}/corpusgraph/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    at = scratch(spark)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    if (own := _scope.get()) is not None:
        own.append(out)
    return out


def release(*tables: DataFrame, keep: DataFrame | None = None) -> None:
    """Delete tables of materialize that nothing reads any more, but for `keep`; those that are gone already are left out."""
    for df in tables:
        if df is not keep and (at := getattr(df, "_written_at", None)):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
            df._written_at = None


def met_by_shuffle(df: DataFrame) -> DataFrame:
    """df for the right of a join that meets it by a shuffle, however small it is: a broadcast would be built in the driver, and
    an operator of many small joins leaves dozens of them there."""
    return df.hint("merge")


#: A key counts as hot if it has more than one of so many parts of all rows; so there are no more hot keys than this.
HOT_PARTS = 1000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Inner join of left with right, whose keys are unique, where a key may have any share of left's rows.

    A hot key's rows of left are dealt into parts by a hash of the whole row, each as large as a key can be that isn't hot,
    and its row of right is repeated for each part. counts (on, _n) and rows: how many rows of left a key has, and all
    of them; else left is counted, and should be written. Only the hot keys are broadcast: HOT_PARTS rows at most."""
    if counts is None:
        counts = left.groupBy(*on).agg(F.count("*").alias("_n"))
    part = (left.count() if rows is None else rows) / HOT_PARTS
    if part < 1:  # every key would count as hot
        return left.join(right, on)
    hot = F.broadcast(materialize(counts.where(F.col("_n") > part).select(*on, F.ceil(F.col("_n") / part).cast("long").alias("_parts"))))
    dealt = left.join(hot, on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_parts")), F.lit(0)))
    again = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.drop("_parts").join(again.drop("_parts"), [*on, "_part"]).drop("_part")


def row_key(*columns: str) -> Column:
    """A key of a row's content, the same for equal rows only: 128 bits of a hash over every column and its length."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(x).cast("string") for x in columns)]
    return F.md5(F.concat(*parts).cast("binary"))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of `column` each, so that working arrays stay small; a longer row is a part."""
    n = batch.num_rows
    if not n:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size + 16
    yield batch.slice(begin, n - begin)


_kept: dict = {}


def held(owner: str, key: object, make: Callable[[], object]) -> object:
    """What a worker keeps between tasks, made once. Workers outlive a stage, so only one operator's is kept at a time."""
    if _kept.get("of") != (owner, key):
        forget()
        _kept.update({"value": make(), "of": (owner, key)})
    return _kept["value"]


def forget() -> None:
    """A worker drops what an operator left in it."""
    _kept.clear()


def give_back() -> None:
    """A worker returns freed memory to the system, for it outlives its task. Where the C library can't, it keeps it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def driver_gives_back(spark: SparkSession) -> bool:
    """The driver's JVM returns memory that its compilers and ended threads have freed; whether it did. Where the JVM can't, it keeps it."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName
    try:
        # by its interface: the server's own class isn't open to Py4J, which finds no method in it
        types, args = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = of(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        of("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def left(owner: str) -> object | None:
    """What an operator keeps in this worker, if it is there."""
    return _kept["value"] if _kept.get("of", ("",))[0] == owner else None


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text", whole: bool = False, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over slices: fn gets a RecordBatch and returns a dict of columns, in the order of schema.

    whole: the rows' own columns stand before those of schema, so that a row needn't be found again by a join. done: called
    in the worker at a task's end."""
    own = StructType(list(df.schema.fields) if whole else [])
    more = StructType.fromDDL(schema)
    kind = StructType(own.fields + more.fields)
    kept, arrow, out_schema = own.names, to_arrow_schema(more), to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = fn(part)
                columns = [part.column(c) for c in kept] + [pa.array(out[f.name], type=f.type, from_pandas=True) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=out_schema.names)
        if done:
            done()
        give_back()

    return df.mapInArrow(run, kind)
