"""Continuous ingest of registry events: files in, each event once, states folded anew for the keys a batch touches.

Late events are always accepted: a batch appends its new events to the store and folds all events of the touched
keys again, so the states equal those of one fold over everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.utils import AnalysisException

from tessera.functions import text as X
from tessera.operators import lifecycle


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder, each read once: the checkpoint is the ledger of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Events once per key within the watermark; state older than that is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], like.schema)


#: Parts of the store and of the states, by hash of the application: a batch reads those that it touches.
BUCKETS = 256


def fold_batch(store: str, states: str, fold: Callable[[DataFrame], DataFrame] = lifecycle.trademark_fold) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps events at `store` and the states of touched keys at `states`.

    Both are partitioned by batch and bucket and a repeated batch overwrites its own part, so a restart after a lost
    executor or driver leaves every event once. Only the buckets of the batch's keys are read again. Readers of
    `states` take the newest batch of a key; compact_states() leaves one row a key.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = batch.withColumn("fingerprint", X.fingerprint(*[F.col(c) for c in batch.columns])).dropDuplicates(["fingerprint"])
        once = once.withColumn("bucket", F.pmod(F.xxhash64("application_no"), F.lit(BUCKETS)).cast("int")).persist()
        touched_buckets = [r.bucket for r in once.select("bucket").distinct().collect()]  # at most BUCKETS
        old = _stored(spark, store, once.withColumn("batch", F.lit(0)))
        before = old.where((F.col("batch") != number) & F.col("bucket").isin(touched_buckets))
        new = once.join(before.select("bucket", "fingerprint"), ["bucket", "fingerprint"], "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")
        once.unpersist()
        fresh = _stored(spark, f"{store}/batch={number}", new)
        touched = fresh.select("application_no").distinct()
        rest = [c for c in batch.columns]
        history = before.select(*rest).unionByName(fresh.select(*rest)).join(touched, "application_no", "left_semi")
        fold(history).write.mode("overwrite").parquet(f"{states}/batch={number}")

    return run


def compact_states(spark: SparkSession, states: str, target: str) -> None:
    """Writes the newest state of every key to `target`, as batch 0 of a new folder of states."""
    current_states(spark, states).write.mode("overwrite").parquet(f"{target}/batch=0")


def start_fold(events: DataFrame, store: str, states: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = events.writeStream.foreachBatch(fold_batch(store, states)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


#: The state store that keeps maps of its own, entry by entry, and its changes as a log.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class History(StatefulProcessor):
    """Keeps the events of a key by fingerprint, and hands on all of them whenever one is new."""

    def __init__(self, schema: str):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "fingerprint string", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  the interface's names
        fresh = False
        for row in rows:
            mark = (row["fingerprint"],)
            if not self.events.containsKey(mark):
                self.events.updateValue(mark, tuple(row))
                fresh = True
        if fresh:
            for value in self.events.values():
                yield Row(**dict(zip(self.names, value, strict=True)))

    @property
    def names(self) -> list[str]:
        return [part.split(" ")[0] for part in self.schema.split(", ")]

    def close(self) -> None:
        pass


def start_keyed_fold(events: DataFrame, states: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame] = lifecycle.trademark_fold, key: str = "application_no") -> StreamingQuery:
    """As start_fold(), without a store to read again: every key's events lie in keyed state, once by fingerprint.

    Events may come late, out of order or twice. A batch hands on all events of the keys to which it brings new ones, and
    their fold is written as the batch's part of `states`, which a repeated batch overwrites; current_states() reads them.
    State is kept in RocksDB, whose changes Spark writes to `checkpoint`, so it survives lost executors. Columns of
    events must be of plain types.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    marked = events.withColumn("fingerprint", X.fingerprint(*[F.col(c) for c in events.columns]))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema)
    histories = marked.groupBy(key).transformWithState(History(schema), schema, "Append", "None")

    def write(batch: DataFrame, number: int) -> None:
        fold(batch.drop("fingerprint")).write.mode("overwrite").parquet(f"{states}/batch={number}")

    return histories.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(spark: SparkSession, states: str) -> DataFrame:
    """The newest state of every key."""
    rows = spark.read.parquet(states)
    rest = [c for c in rows.columns if c not in ("application_no", "batch")]
    return rows.groupBy("application_no").agg(F.max_by(F.struct(*rest), "batch").alias("s")).select("application_no", "s.*")


def _watermarked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """A stream has one watermark: without `late`, that which the events already carry stays."""
    return events.withWatermark(time, late) if late else events


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Extension beyond the registry's own queries: tumbling or sliding counts under a watermark.

    Events that come from deduplicated() carry a watermark; others, if streamed, need `late`.
    """
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return _watermarked(events, time, late).groupBy(window.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Extension: sessions of a key, closed by a gap. Streamed events need a watermark, as in windowed_counts()."""
    return _watermarked(events, time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
