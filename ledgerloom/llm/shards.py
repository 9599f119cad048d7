"""Shards of vectors that answer queries streamed past them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums below these are exact in doubles and in single floats.
_EXACT, _EXACT_SINGLE = float(1 << 53), float(1 << 24)


def number_kind(largest: float) -> type:
    """The fastest number type in which integers up to ``largest`` are exact."""
    return np.float32 if largest < _EXACT_SINGLE else np.float64 if largest < _EXACT else object


def ask(
    held: DataFrame,
    asked: DataFrame,
    shards: int,
    build: Callable[[pa.Table], Any],
    answer: Callable[[Any, pa.RecordBatch], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """What each shard answers to the queries sent to it.

    Both inputs have the same columns, ``s`` being the shard. A task has its
    shards one after the other, the rows held of each before its queries, so it
    keeps one built shard and a batch of queries. A shard without rows gives nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, shard, here = [], None, None
        for batch in batches:
            kinds = batch["s"].to_numpy() * 2 + batch["asks"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                rows, which = batch.slice(a, b - a), int(kinds[a]) // 2
                if which != here:
                    parts, shard, here = [], None, which
                if kinds[a] % 2 == 0:
                    parts.append(rows)
                    continue
                if shard is None and parts:
                    shard, parts = build(pa.Table.from_batches(parts).combine_chunks()), []
                if shard is not None:
                    yield answer(shard, rows)

    both = held.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1)))
    return both.repartition(shards, "s").sortWithinPartitions("s", "asks").mapInArrow(run, schema)
