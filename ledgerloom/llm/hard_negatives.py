"""Hard-negative mining by branch and bound over vertically stored vectors (BOND).

A shard holds its vectors dimension by dimension, its rows in the order of their
labels. An anchor reads the dimensions in the falling order of its own
magnitudes and adds up what they contribute. What the dimensions not yet read
can add lies between two sums of each one's smallest and largest contribution in
the shard; a row whose whole range misses what is wanted leaves the candidate
bitmap, and only the columns' entries of rows still in it are read on.

Two passes: the best rows of an anchor's own label (its positives), then, within
the score windows that the positives span, the best rows of other labels.
Vectors are dealt to shards by hash, so no label's rows meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut
from ledgerloom.llm.shards import ask, number_kind
from ledgerloom.llm.topk_search import integer_vectors, matrix

#: Dimensions that are read between two looks at the bitmap.
STEP = 8
Decide = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Columns:
    """The vectors of a shard, one column a dimension, rows by label and then by id (null last)."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, ~known, labels))
        self.ids, self.known, self.labels = ids[order], known[order], labels[order]
        #: Place of each row in the order of ids, which breaks ties between labels.
        self.by_id = np.empty(len(order), dtype=np.int64)
        self.by_id[np.lexsort((self.ids, ~self.known))] = np.arange(len(order))
        self._columns = np.ascontiguousarray(vectors[order].T)
        self._held: dict[type, np.ndarray] = {}
        self.high, self.low = vectors.max(axis=0).astype(float), vectors.min(axis=0).astype(float)
        #: Entries of columns read so far.
        self.read = 0

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, side="left")), int(np.searchsorted(self.labels, label, side="right"))

    def scan(self, anchor: np.ndarray, live: np.ndarray, decide: Decide) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``live`` that ``decide`` keeps to the end, with their exact scores.

        ``decide`` gets the least and the largest score that each live row can
        still have and gives the bitmap of those to keep.
        """
        size = min(len(anchor), len(self._columns))  # dimensions that one side lacks add nothing
        q = anchor[:size].astype(float)
        most, least = np.maximum(q * self.high[:size], q * self.low[:size]), np.minimum(q * self.high[:size], q * self.low[:size])
        kind = number_kind(np.maximum(np.abs(most), np.abs(least)).sum())
        if kind not in self._held:
            self._held[kind] = self._columns.astype(kind)
        columns, order = self._held[kind], np.argsort(-np.abs(q), kind="stable")
        terms = anchor[:size].astype(kind)
        # what the dimensions from the i-th on can still add
        above = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0.0]])
        below = np.concatenate([np.cumsum(least[order][::-1])[::-1], [0.0]])
        slack = 0 if kind is not object else 1e-9 * float(above[0] - below[0])
        part = np.zeros(len(live), dtype=kind)
        for at in range(0, size, STEP):
            dims = order[at : at + STEP]
            part = part + terms[dims] @ columns[np.ix_(dims, live)]
            self.read += len(dims) * len(live)
            rest = min(at + STEP, size)
            keep = decide(part + float(below[rest] - slack), part + float(above[rest] + slack)) if rest < size else decide(part, part)
            if rest == size or 4 * int(keep.sum()) < 3 * len(live):  # the bitmap has thinned out
                live, part = live[keep], part[keep]
            if not len(live):
                break
        return live, part

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int | None, int]]:
        """Ids and scores of the k best rows, ties to the smaller id."""
        top = sorted(range(len(rows)), key=lambda i: (-scores[i], self.by_id[rows[i]]))[:k] if scores.dtype == object else np.lexsort((self.by_id[rows], -scores))[:k]
        return [(int(self.ids[rows[i]]) if self.known[rows[i]] else None, max(-(1 << 63), min((1 << 63) - 1, int(scores[i])))) for i in top]

    def positives(self, own: int, label: int, anchor: np.ndarray, k: int) -> list[tuple[int | None, int]]:
        """The k best rows of the anchor's label but those of its id."""
        a, b = self.of_label(label)
        live = np.arange(a, b)
        live = live[~(self.known[a:b] & (self.ids[a:b] == own))]

        def decide(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            return most >= np.partition(least, len(least) - k)[len(least) - k] if len(least) > k else np.ones(len(least), dtype=bool)

        return self.best(*self.scan(anchor, live, decide), k)

    def negatives(self, own: int, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int | None, int]]]:
        """For each window of scores the k best rows of other labels within it."""
        a, b = self.of_label(label)
        live = np.concatenate([np.arange(a), np.arange(b, len(self.ids))])
        live = live[~(self.known[live] & (self.ids[live] == own))]
        wanted = [w for w in dict.fromkeys(windows) if w[0] <= w[1]]

        def decide(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            keep = np.zeros(len(least), dtype=bool)
            for low, high in wanted:
                inside = least[(least >= low) & (most <= high)]
                floor = max(low, np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else low
                keep |= (most >= floor) & (least <= high)
            return keep

        rows, scores = self.scan(anchor, live, decide) if wanted else (np.zeros(0, dtype=np.int64), np.zeros(0))
        found = {(low, high): self.best(rows[m := (scores >= low) & (scores <= high)], scores[m], k) for low, high in wanted}
        return [found.get(w, []) for w in windows]


def _columns(table: pa.Table) -> Columns:
    ids, labels = table["id"].combine_chunks(), table["label"].combine_chunks()
    return Columns(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), labels.to_numpy(), matrix(table["vector"].combine_chunks()))


def mine(
    vectors: DataFrame,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: int = 256,
    shard_rows: int = 65_536,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor and positive.

    Anchors are the rows whose id is divisible by ``every``; an anchor's
    positives are its best rows of the same label, its negatives for each of
    them the best rows of other labels with a score of ``window`` per cent of
    the positive's. Ties go to the smaller id, null last; rows of the anchor's
    own id take no part for it; an anchor repeated with its vector and label
    counts once. Null labels and vectors null or with null, NaN or infinite
    components are left out; null ids are no anchors. Missing components of
    shorter vectors count as 0. Scores beyond 64 bits are cut to them. An empty
    table gives an empty result; other columns are not read. A task holds one
    shard of about ``shard_rows`` vectors and reads anchors in batches.
    """
    label = F.col(f"`{label_col}`").cast("long").alias("label")
    rows = cut(integer_vectors(vectors.where(F.col(f"`{label_col}`").isNotNull()), id_col, vector_col, scale, label), "vectors")
    count, cores = rows.count(), vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(count / shard_rows), min(cores, math.ceil(count / 4096)))
    no_goals = F.lit(None).cast("array<bigint>").alias("goals")
    held = rows.select(F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).alias("s"), F.lit(0).cast("long").alias("key"), "id", "label", "vector", no_goals)
    anchors = rows.where(F.col("id") % every == 0).distinct().select(F.xxhash64("vector", "label").alias("key"), "id", "label", "vector")
    anchors = cut(anchors, "anchors")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s")
    names = ["s", "key", "id", "label", "vector", "goals"]

    def near(shard: Columns, asked: pa.RecordBatch) -> pa.RecordBatch:
        out = [(own, key, *hit) for own, key, label, q in zip(*(asked[c].to_pylist() for c in ("id", "key", "label")), matrix(asked["vector"])) for hit in shard.positives(own, label, q, positives)]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zip(*out) if out else [()] * 4)], names=["id", "key", "positive_id", "positive_score"])

    def far(shard: Columns, asked: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for own, key, label, goals, q in zip(*(asked[c].to_pylist() for c in ("id", "key", "label", "goals")), matrix(asked["vector"])):
            windows = [(-(-window[0] * p // 100), window[1] * p // 100) for p in goals]
            for p, hits in zip(goals, shard.negatives(own, label, q, windows, negatives)):
                out += [(own, key, p, *hit) for hit in hits]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zip(*out) if out else [()] * 5)], names=["id", "key", "positive_score", "negative_id", "negative_score"])

    first = ask(held, anchors.select(everywhere, "*", no_goals).select(names), shards, _columns, near, "id long, key long, positive_id long, positive_score long")
    order = Window.partitionBy("id", "key").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    chosen = cut(first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives), "positives")
    goals = chosen.groupBy("id", "key").agg(F.collect_set("positive_score").alias("goals"))  # at most ``positives`` a key
    told = anchors.join(goals, ["id", "key"]).select(everywhere, "*").select(names)
    second = ask(held, told, shards, _columns, far, "id long, key long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("id", "key", "positive_score").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    kept = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return chosen.join(kept, ["id", "key", "positive_score"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
