"""Job-state log as a stateful stream: what a job's state allows, jobs that are stuck, and the table of states.

The state of a job is its last accepted event; it is kept by key in the state store, so a batch costs what its events
cost, not what all jobs cost. Events are taken in the order that they come in, those of one batch in the order of `at`.
A job that stays in processing is failed by a timer of event time. Each batch's accepted events are upserted into a
bucketed collection together with the batch's number, so a batch that is repeated after a crash changes nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import buckets
from ..operators.store import NEXT

#: The stream's rows inside the stateful step: the event as JSON, which keeps every type.
OUT, STATE = "status string, event string", "status string, event string"


def steps(at: Sequence[str], limit: int | None, follow: dict[str, tuple[str, ...]] = NEXT) -> Callable:
    """Of one job's events those that its state allows; a job in processing for `limit` milliseconds of event time fails."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, event = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            if status == "processing":
                state.update(("failed", event))
                yield pd.DataFrame({"status": ["failed"], "event": [event]})
            return
        rows = pd.concat(list(parts)).sort_values([f"_{k}" for k in range(len(at))], kind="stable", na_position="first")
        taken, began = [], None
        for s, e, t in zip(rows["_status"], rows["_event"], rows["_0"], strict=True):
            if s == "pending" if status is None else s in follow.get(status, ()):
                status, event, began = s, e, t
                taken.append((s, e))
        if taken:
            state.update((status, event))
            if limit is not None and status == "processing":
                state.setTimeoutTimestamp(max(int(began.timestamp() * 1000) + limit, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(taken, columns=["status", "event"])

    return run


def states(log: DataFrame, at: Sequence[str] = ("updated_at",), job: str = "id", status: str = "status", late: str = "1 hour", limit: int | None = None) -> DataFrame:
    """The accepted events of a streamed log, as they come. at: the columns of an event's time, the first a timestamp;
    limit: see steps. A job that the timer fails has the time of the event that it was stuck at."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers of a stream needn't find this package
    whole = F.to_json(F.struct(*log.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    rows = log.withWatermark(at[0], late).select(job, F.col(status).alias("_status"), whole.alias("_event"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(at)])
    timeout = "NoTimeout" if limit is None else "EventTimeTimeout"
    found = rows.groupBy(job).applyInPandasWithState(steps(tuple(at), limit), OUT, STATE, "append", timeout)
    event = F.from_json("event", log.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return found.select(event.alias("e"), F.col("status").alias("_now")).select("e.*", "_now").withColumn(status, F.col("_now")).drop("_now")


def keep_states(accepted: DataFrame, path: str, checkpoint: str, at: Sequence[str] = ("updated_at",), job: str = "id", status: str = "status", n: int = buckets.BUCKETS) -> StreamingQuery:
    """Upsert each batch's accepted events into the collection at path (the last event of each job), once each, for all data that is there."""
    rank = F.when(F.col(status) == "pending", 0).when(F.col(status) == "processing", 1).otherwise(2)
    schema = StructType([*accepted.schema.fields])

    def put(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        buckets.create(spark, path, schema, job, buckets=n)
        last = df.groupBy(job).agg(F.max_by(F.struct(*df.columns), F.struct(rank, *at)).alias("_x")).select("_x.*")
        buckets.change(spark, path, last, tries=3, batch=(checkpoint, batch))
        buckets.vacuum(spark, path)

    return accepted.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
