"""Structured Streaming forms of the incremental jobs: ingest once, first evidence, changes per key, runs, rates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.feeds import register_snapshots
from ..sources.store import KeyedStore


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_snapshots(spark: SparkSession, folder: str, registry_path: str, checkpoint: str, source: str) -> StreamingQuery:
    """Register every file of a folder once, whatever its arrival; what the registry has already is left out.

    The file source's checkpoint and the registry's hash make reruns idempotent.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def append(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        try:
            registry = session.read.parquet(registry_path)
        except Exception as e:  # the first batch finds no registry
            if "PATH_NOT_FOUND" not in str(e):
                raise
            registry = session.createDataFrame([], "source_key string, filename string, sha256 string")
        register_snapshots(batch, registry, source).write.mode("append").parquet(registry_path)

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upsert(stream: DataFrame, store: KeyedStore, order: Sequence[str], checkpoint: str, name: str) -> StreamingQuery:
    """Put a stream's rows into a store: of each key the row with the greatest ``order`` stays.

    Late rows of older snapshots never replace newer ones and need no state or watermark, as the store holds
    what was seen. A batch that is run again after a failure is known by its number and changes nothing;
    rows that come again in another batch change nothing either.
    """

    def put(batch: DataFrame, number: int) -> None:
        store.merge(batch, order, name, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_evidence(stream: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark; what is seen again is left out."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_rates(stream: DataFrame, at: str, width: str, delay: str, kind: str, suppressed: Column, slide: str | None = None) -> DataFrame:
    """(start, kind, live, suppressed) by window of event time."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    counted = stream.withWatermark(at, delay).groupBy(w.alias("w"), kind).agg(F.count_if(~suppressed).alias("live"), F.count_if(suppressed).alias("suppressed"))
    return counted.select(F.col("w.start").alias("start"), kind, "live", "suppressed")


def stream_stints(stream: DataFrame, keys: Sequence[str], at: str, gap_days: int, delay: str) -> DataFrame:
    """Runs of days with at most ``gap_days`` between neighbours: (keys, start, end, n).

    ``at`` is a day's start. Whether a session takes in an event exactly one gap later is the engine's
    matter, and a run does, so the gap is a second longer.
    """
    day = stream.withWatermark(at, delay)
    gap = f"{gap_days} days 1 second"
    runs = day.groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))
    return runs.select(*keys, "start", "end", "n")


class _Changes(StatefulProcessor):
    """Emits a row when a key's value differs from the one before it in event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "value"])
        before = self.last.get() if self.last.exists() else None
        out = []
        for at, value in zip(frame["at"], frame["value"]):
            if before is not None and at < before[0]:
                continue  # late: an older observation never replaces a newer one
            if before is not None and before[1] != value:
                out.append((key[0], at, before[1], value))
            before = (at, value)
        if before is not None:
            self.last.update((pd.Timestamp(before[0]).to_pydatetime(), before[1]))
        yield pd.DataFrame(out, columns=["key", "at", "before", "after"])

    def close(self) -> None:
        pass


def stream_changes(stream: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, at, before, after) of a key's changes of value between one observation and the next."""
    shaped = stream.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(value).cast("string").alias("value"))
    return shaped.groupBy("key").transformWithStateInPandas(_Changes(), "key string, at timestamp, before string, after string", "append", "none")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream in append mode over what is there now and return the written table.

    State that the watermark has passed is dropped as its rows are written; what it hasn't passed yet is
    written by a later run from the same checkpoint.
    """
    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
