"""Incremental runs with Structured Streaming: seen ledgers, quotas, failure streaks, recomputed consensus."""

from __future__ import annotations

import atexit
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ledgerloom.operators import consensus, dedupe
from ledgerloom.streaming.ledger import Ledger, names_in, remove

_folders: list[tuple[SparkSession, str]] = []


def work_folder(spark: SparkSession) -> str:
    """Where stores and checkpoints of registered streams go: ``spark.checkpoint.dir``, which only a local master may leave unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/ledgerloom-streams"
    return f"{folder.rstrip('/')}/ledgerloom-streams"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream's files; it goes when Python ends."""
    folder = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, folder))
    return folder


@atexit.register
def _leave() -> None:
    for spark, folder in _folders:
        try:
            remove(spark, folder)
        except Exception:  # the session has ended; the files belong to its folder
            return


def available_now(query, checkpoint: str):
    """Run a streaming writer over what has arrived, then stop; the checkpoint remembers it."""
    run = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return run


def ingest(stream: DataFrame, store: str, checkpoint: str, source: str, record: str, order: str, limit: int | None = None, buckets: int = 64, fan: int = 8):
    """Append records that the store does not hold, at most ``limit`` a source and batch; the others wait and come first in the next batch.

    What the store holds is read from a :class:`~ledgerloom.streaming.ledger.Ledger`
    of (source, record): only the hash buckets that a batch falls into, from a
    number of runs that grows with the logarithm of the batches. What waits is a
    table of its own (``deferred``), of which the last batch's counts; a run
    that finds nothing new takes the next ones from it. A batch is written
    under its id, so one that runs again after a failure replaces its own files
    and appends nothing twice.
    """
    ledger = Ledger(stream.sparkSession, f"{store}/seen", stream.select(source, record).schema, buckets, fan)

    def take(rows: DataFrame, epoch: float) -> None:
        spark, shape = rows.sparkSession, rows.schema
        ledger.merge(before=epoch)
        waiting = read_deferred(spark, store, shape, before=epoch)
        rows = rows.withColumn("_late", F.lit(1))
        if waiting is not None:
            rows = rows.unionByName(waiting.withColumn("_late", F.lit(0)))
        new = ledger.unseen(dedupe.keep_first(rows, [F.col(source), F.col(record)], [F.col("_late"), F.col(order)]), before=epoch)
        if limit:
            new = dedupe.write_quota(new, source, F.lit(False), [F.col("_late"), F.col(order)], limit)
            new.where("action = 'defer'").drop("action", "is_seen", "_late").write.mode("overwrite").parquet(f"{store}/deferred/epoch={epoch}")
            new = new.where("action = 'create'").drop("action", "is_seen")
        target = f"{store}/records/epoch={epoch}"
        new.drop("_late").write.mode("overwrite").parquet(target)
        ledger.add(spark.read.schema(shape).parquet(target), epoch)
        for old in _epochs(spark, f"{store}/deferred")[:-2]:  # the last two may still be read
            remove(spark, f"{store}/deferred/epoch={old}")

    took: list[int] = []

    def batch(rows: DataFrame, epoch: int) -> None:
        took.append(epoch)
        take(rows, float(epoch))

    run = available_now(stream.writeStream.foreachBatch(batch), checkpoint)
    spark = stream.sparkSession
    if limit and not took and (waiting := read_deferred(spark, store, stream.schema)) is not None and not waiting.isEmpty():
        # between the last batch and the next one, whatever the number of such runs
        last = _epochs(spark, f"{store}/deferred")[-1]
        take(waiting.limit(0), (last + math.floor(last) + 1) / 2)
    return run


def _epochs(spark: SparkSession, folder: str) -> list[float]:
    """The batch ids under a folder, ascending."""
    return sorted(float(n) for n in names_in(spark, folder, "epoch="))


def read_deferred(spark: SparkSession, store: str, schema: StructType | str, before: float | None = None) -> DataFrame | None:
    """Rows that wait after the last batch (before ``before``), or None if no batch has deferred any."""
    epochs = [e for e in _epochs(spark, f"{store}/deferred") if before is None or e < before]
    return spark.read.schema(schema).parquet(f"{store}/deferred/epoch={epochs[-1]}") if epochs else None


def read_store(spark: SparkSession, store: str, schema: StructType | str) -> DataFrame | None:
    """Rows appended so far, or None if there are none."""
    folder = f"{store}/records"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder) if names_in(spark, folder, "epoch=") else None


def unseen(stream: DataFrame, keys: list[str], moment: str | None = None, delay: str = "30 days") -> DataFrame:
    """A stream without repeated keys; with a moment, state older than ``delay`` is dropped."""
    return stream.withWatermark(moment, delay).dropDuplicatesWithinWatermark(keys) if moment else stream.dropDuplicates(keys)


def running_consensus(stream: DataFrame, keys: tuple[str, ...], sentiment: str) -> DataFrame:
    """Verdicts that follow the stream (update mode): only touched keys are emitted."""
    return consensus.verdicts(stream, keys, sentiment)


def failure_states(stream: DataFrame, key: str, order: str, failed: str) -> DataFrame:
    """``key, runs, consecutive_failures, state`` after each batch, from state kept per key.

    Within a batch a key's runs are taken in order; one success sets the
    streak back, one failure is degraded, two or more are failing.
    """

    def follow(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, streak = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for bad in rows[failed]:
            runs, streak = runs + 1, streak + 1 if bad else 0
        state.update((runs, streak))
        label = "healthy" if streak == 0 else "degraded" if streak == 1 else "failing"
        yield pd.DataFrame({key: [name[0]], "runs": [runs], "consecutive_failures": [streak], "state": [label]})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, order, failed).groupBy(key).applyInPandasWithState(
        follow, f"{key} {kind}, runs long, consecutive_failures long, state string", "runs long, streak long", "update", GroupStateTimeout.NoTimeout
    )


def in_window(stream: DataFrame, windows: DataFrame, keys: list[str], moment: str, start: str, end: str) -> DataFrame:
    """Stream rows with the release window (static table, half-open, disjoint per key) that holds their moment."""
    inside: Column = (F.col(moment) >= F.col(start)) & (F.col(end).isNull() | (F.col(moment) < F.col(end)))
    return stream.join(windows, keys, "left").where(inside | F.col(start).isNull())
