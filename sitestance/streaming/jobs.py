"""Structured Streaming: time-bucket counters, TTL cache, partitioned sink."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from sitestance import config
from sitestance.operators import captures, index

TTL_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
}


def counters(
    events: DataFrame, ts: str, scope: str, size: str | None = None, lateness: str = "1 hour"
) -> DataFrame:
    """S13 on a stream: the batch plan behind a watermark, which bounds the state.

    Events later than ``lateness`` are not counted any more.
    """
    return captures.counters(events.withWatermark(ts, lateness), ts, scope, size)


def run_to_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Drain an aggregation in update mode; the newest row of every key, open buckets included.

    A micro-batch writes only the groups it changed, into its own subfolder; run again
    after a failure it overwrites that one.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    # Without any input there is no micro-batch, but there is a table.
    write(spark.createDataFrame([], stream.schema), -1)
    (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    table = spark.read.schema(schema).parquet(path)
    values = [c for c in table.columns if c not in (*keys, "batch")]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("newest"))
    return newest.select(*keys, "newest.*")


class _Cache(StatefulProcessor):
    """Holds one time per origin: when its policy was last fetched."""

    def __init__(self, ttl_us: int, expires: bool):
        self.ttl_us = ttl_us
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.written = handle.getValueState("written", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.written.get()[0] if self.written.exists() else None
        # An origin's rows come in several chunks without order among them.
        ordered = pd.concat(list(rows), ignore_index=True)[["ts", "row_id"]].sort_values(
            ["ts", "row_id"], kind="stable", na_position="first"
        )
        times = ordered["ts"].to_numpy("datetime64[us]").astype("int64")
        timeless = int(ordered["ts"].isna().sum())
        cached = np.ones(len(times), bool)
        written = before
        while True:
            free = timeless if written is None else np.searchsorted(times, written + self.ttl_us)
            at = max(int(free), timeless)
            if at >= len(times):
                break
            cached[at] = False
            written = int(times[at])
        yield pd.DataFrame(
            {
                "origin": key[0],
                "row_id": ordered["row_id"].to_numpy(),
                "ts": ordered["ts"].to_numpy(),
                "cached": cached,
            }
        )
        if written != before:
            self.written.update((written,))
            if self.expires:
                self.handle.registerTimer(-(-(written + self.ttl_us) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if self.written.exists() and self.written.get()[0] + self.ttl_us <= passed:
            self.written.clear()
        return iter([])

    def close(self) -> None:
        pass


def cache_hits(
    requests: DataFrame, ttl_days: int = config.CACHE_TTL_DAYS, lateness: str | None = None
) -> DataFrame:
    """F5 on a stream of ``(origin, ts, row_id)``; micro-batches should come in time order.

    Within a micro-batch rows may have any order; those of one origin are sorted together,
    so bound a micro-batch by the source's maxima per trigger.  The state is one number per
    origin.  With ``lateness`` it is dropped once the watermark has passed its span, and rows
    later than that are not looked at; without, every origin is kept and no row is lost.
    Rows without an origin have ``cached`` NULL and touch no state; rows without a time are hits.
    """
    keyed = requests.where("origin is not null")
    if lateness is not None:
        keyed = keyed.withWatermark("ts", lateness)
    flagged = keyed.groupBy("origin").transformWithStateInPandas(
        _Cache(ttl_days * 86_400_000_000, lateness is not None),
        outputStructType="origin string, row_id bigint, ts timestamp, cached boolean",
        outputMode="append",
        timeMode="None" if lateness is None else "EventTime",
    )
    others = requests.where("origin is null").select(
        F.col("origin").cast("string").alias("origin"),
        F.col("row_id").cast("bigint").alias("row_id"),
        "ts",
        F.lit(None).cast("boolean").alias("cached"),
    )
    return flagged.union(others)


def write_index(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """E5 on a stream: every micro-batch goes to its own subfolder of the index.

    A batch that is run again after a failure overwrites its own output, so a
    document is never written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        index.write_index(batch, f"{path}/batch={batch_id}")

    return (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available now into parquet files."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def event_stream(events: DataFrame) -> DataFrame:
    """Cache requests out of an event table: user as origin, event as row."""
    return events.select(
        F.col("user_id").cast("string").alias("origin"), "ts", F.col("event_id").alias("row_id")
    )

# Python workers get the code of this module along with the task, so the package
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
