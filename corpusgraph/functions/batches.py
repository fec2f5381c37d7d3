"""Rows of long texts taken a few at a time: what a worker holds is bounded by bytes of text, not by rows of a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

#: Bytes of text that are worked on at once; a longer text is taken by itself.
SLICE_BYTES = 1 << 19


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size + 16
    if sizes:
        yield batch.slice(begin)


def items(df: DataFrame, key: str, text: str, more: Sequence[str], fn: Callable[..., Iterable[tuple]], fields: str, pos: str = "pos") -> DataFrame:
    """key, pos (from 0) and fields: a row for each tuple that fn gives for a row's text and its columns `more`; a null text
    has none."""
    out = StructType([df.schema[key], StructField(pos, IntegerType()), *StructType.fromDDL(fields)])
    kind = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                rows = [(i, p, *x) for i, row in enumerate(zip(*[part.column(c).to_pylist() for c in (text, *more)], strict=True)) if row[0] is not None for p, x in enumerate(fn(*row))]
                ids = part.column(key).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.cast(kind.field(0).type), *[pa.array([r[n] for r in rows], kind.field(n).type) for n in range(1, len(kind))]], schema=kind)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return df.select(key, text, *more).mapInArrow(run, out)
