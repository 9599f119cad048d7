"""Exact top-k search by integer inner product with MaxScore.

Components are the terms of a vector. A shard's postings of a term are its
column; the term's largest and smallest value there bound what it adds to a
query's score. The columns are stored by falling bound. For a threshold that k
vectors are known to reach, the last terms whose largest contributions together
stay below it are non-essential. A block of queries traverses the postings of
the essential terms only, by one product, and the next ones while most vectors
still compete; the others are probed in the rest, largest bound first, and
dropped as soon as they cannot reach the threshold, which rises by block.

Vectors are dealt to shards once and stay there. Each query first searches the
shard it lies in, then travels with the threshold found to all others, where
queries are read as a stream; shards' results are merged by score and id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import col, cut
from ledgerloom.llm.shards import ask, number_kind



def matrix(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of integer lists as a matrix of that width (default: the longest), shorter ones filled with 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width if width is not None else int(sizes.max()) if len(sizes) else 0), dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Shard:
    """Postings of some vectors: one column per term, by falling bound."""

    #: Terms that are read or probed between two looks at what still competes.
    STEP = 8

    def __init__(self, ids: np.ndarray, known: np.ndarray, vectors: np.ndarray, block: int = 4096):
        order = np.lexsort((ids, ~known))  # ties go to the smaller id, null last
        self.ids, self.known, self._block = ids[order], known[order], block
        high, low = vectors.max(axis=0).astype(float), vectors.min(axis=0).astype(float)
        self.terms = np.argsort((low - high) * np.sqrt((vectors.astype(float) ** 2).mean(axis=0)), kind="stable")
        self._high, self._low = high[self.terms], low[self.terms]
        self._rows = np.ascontiguousarray(vectors[order][:, self.terms])
        self._held: dict[type, tuple[np.ndarray, np.ndarray]] = {}
        #: Postings read so far.
        self.read = 0

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, reached: np.ndarray | None = None, together: int = 32) -> list[tuple[np.ndarray, list[int]]]:
        """For each query the places and scores of the k best vectors but its ``own``, best first.

        ``reached`` are scores that k vectors are known to have, here or
        elsewhere; vectors below may be left out.
        """
        full = np.zeros((len(queries), len(self.terms)), dtype=np.int64)  # terms that one side lacks add nothing
        size = min(queries.shape[1], len(self.terms))
        full[:, :size] = queries[:, :size]
        q = full[:, self.terms].astype(np.float64)
        most, least = np.maximum(q * self._high, q * self._low), np.minimum(q * self._high, q * self._low)
        kinds = [number_kind(v) for v in np.maximum(np.abs(most), np.abs(least)).sum(axis=1)]
        # the largest sum that the terms from each one on can add
        rest = np.concatenate([np.cumsum(most[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1))], axis=1)
        reached = np.full(len(q), -np.inf) if reached is None else reached.astype(float)
        essential = (rest > reached[:, None]).sum(axis=1)
        out: list[tuple[np.ndarray, list[int]]] = [(np.zeros(0, dtype=np.int64), [])] * len(q)
        for kind in dict.fromkeys(kinds):
            mine = np.array([i for i in range(len(q)) if kinds[i] is kind])
            if kind is object:
                for i in mine:
                    out[i] = self._plain(queries[i], own[i], k)
                continue
            mine = mine[np.argsort(essential[mine], kind="stable")]  # queries with as many essential terms go together
            for part in np.array_split(mine, -(-len(mine) // together)):
                for i, found in zip(part, self._search(q[part].astype(kind), own[part], k, reached[part].copy(), rest[part], kind)):
                    out[i] = found
        return out

    def _search(self, q: np.ndarray, own: np.ndarray, k: int, reached: np.ndarray, rest: np.ndarray, kind: type) -> list[tuple[np.ndarray, list[int]]]:
        rows, columns = self._postings(kind)
        size, found = q.shape[1], [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in q]
        for start in range(0, len(rows), self._block):
            stop = min(len(rows), start + self._block)
            at = min(size, max(1, int(np.median((rest > reached[:, None]).sum(axis=1))))) if size else 0
            score = q[:, :at] @ columns[:at, start:stop]
            self.read += score.size * at
            while True:
                competes = score >= (reached - rest[:, at])[:, None].astype(kind) if at < size else score >= reached[:, None].astype(kind)
                if at == size or 4 * int(np.count_nonzero(competes)) < score.size:
                    break
                upto = min(at + self.STEP, size)
                score += q[:, at:upto] @ columns[at:upto, start:stop]
                self.read += score.size * (upto - at)
                at = upto
            asking, live = np.nonzero(competes)
            edges = np.searchsorted(asking, np.arange(len(q) + 1))
            for i in np.flatnonzero(np.diff(edges)):
                mine = live[edges[i] : edges[i + 1]]
                part, place, term = score[i, mine], mine + start, at
                while term < size and len(place):
                    upto = min(term + self.STEP, size)
                    part = part + rows[place, term:upto] @ q[i, term:upto]
                    self.read += len(place) * (upto - term)
                    term = upto
                    keep = part >= reached[i] - rest[i, term]
                    place, part = place[keep], part[keep]
                other = ~(self.known[place] & (self.ids[place] == own[i]))
                place, part = place[other], part[other]
                if len(part) > k:
                    keep = part >= np.partition(part, len(part) - k)[len(part) - k]
                    place, part = place[keep], part[keep]
                place, part = np.concatenate([found[i][0], place]), np.concatenate([found[i][1], part.astype(np.float64)])
                top = np.lexsort((place, -part))[:k]
                found[i] = (place[top], part[top])
                if len(top) == k:
                    reached[i] = max(reached[i], part[top[-1]])
        return [(place, [int(s) for s in part]) for place, part in found]

    def _postings(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """By vector and by term."""
        if kind not in self._held:
            rows = self._rows.astype(kind)
            self._held[kind] = rows, np.ascontiguousarray(rows.T)
        return self._held[kind]

    def _plain(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
        """Values too large for exact doubles: Python's integers, all vectors, cut to 64 bits at the end."""
        live = np.flatnonzero(~(self.known & (self.ids == own)))
        full = np.zeros(max(len(query), len(self.terms)), dtype=object)
        full[: len(query)] = query.astype(object)
        self.read += len(live) * len(self.terms)
        scores = self._rows[live].astype(object) @ full[self.terms] if len(self.terms) else np.zeros(len(live), dtype=object)
        top = sorted(range(len(live)), key=lambda i: (-scores[i], i))[:k]
        return live[top], [max(-(1 << 63), min((1 << 63) - 1, int(scores[i]))) for i in top]


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256, *more: Column) -> DataFrame:
    """``id, vector`` with floor(scale * x) of every component, and ``more``; vectors null or with null, NaN or infinite ones go."""
    v = col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(col(vector_col).isNotNull()).where(finite)
    return rows.select(col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("vector"), *more)


def top_k(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    scale: int = 256,
    shard_rows: int = 65_536,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best vectors by inner product.

    Queries are the rows whose id is divisible by ``every``; candidates all
    rows but those of the query's id. Ties go to the smaller id, null last.
    Null ids are no query. Rows that repeat id and vector are one query but
    each is a candidate. Missing components of shorter vectors count as 0.
    Scores beyond 64 bits are cut to them. An empty table gives an empty
    result; other columns are not read. A task holds one shard of about
    ``shard_rows`` vectors (fewer where cores would idle) and reads queries in
    batches; each query is sent to ``n / shard_rows`` shards, each of the ``n`` vectors to one.
    """
    rows = cut(integer_vectors(vectors, id_col, vector_col, scale), "vectors")
    count, cores = rows.count(), vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(count / shard_rows), min(cores, math.ceil(count / 4096)))
    at = F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).alias("s")
    none = F.lit(None).cast("double").alias("reached")
    held = rows.select(at, F.lit(0).cast("long").alias("key"), none, "id", "vector")
    queries = cut(rows.where(F.col("id") % every == 0).distinct().select(at, F.xxhash64("vector").alias("key"), none, "id", "vector"), "queries")

    def build(table: pa.Table) -> Shard:
        ids = table["id"].combine_chunks()
        return Shard(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), matrix(table["vector"].combine_chunks()))

    def answer(shard: Shard, asked: pa.RecordBatch) -> pa.RecordBatch:
        own = asked["id"].to_numpy()
        found = shard.best(matrix(asked["vector"]), own, k, asked["reached"].fill_null(-np.inf).to_numpy())
        times = [len(places) for places, _ in found]
        ids = [int(shard.ids[p]) if shard.known[p] else None for places, _ in found for p in places]
        columns = [np.repeat(own, times), np.repeat(asked["key"].to_numpy(), times), ids, [v for _, scores in found for v in scores]]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["query_id", "key", "vec_id", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        return ask(held, asked, shards, build, answer, "query_id long, key long, vec_id long, score long")

    near = cut(searched(queries), "near")
    # the k-th score of a query's own shard is the threshold in the others
    known = near.groupBy("query_id", "key").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k)
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda s: s != F.col("s")))
    found = near
    if shards > 1:
        told = queries.join(known.withColumnRenamed("query_id", "id").drop("n"), ["id", "key"], "left").withColumn("reached", F.col("least")).drop("least")
        found = near.unionByName(searched(told.withColumn("s", others)))
    merged = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
