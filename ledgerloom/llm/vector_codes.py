"""Vector code compression: product codes whose codebooks are learned on metric trees.

Vectors are cut into equal parts. Rows stay where they are read: each task packs
blocks of them and builds one metric tree a part and block
(:mod:`~ledgerloom.llm.metric_trees`), which is written once. A round sends the
codebooks - their size is a parameter - to the blocks, walks the trees and adds
up each entry's sums and counts; only those totals reach the driver. The last
walk reads all parts' codes of a row in the block that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import col, cut, spread_join
from ledgerloom.llm.metric_trees import Owner, Tree, build
from ledgerloom.llm.topk_search import integer_vectors, matrix

#: Components beyond are cut to it, so that the sums of a block stay within 64 bits.
LARGEST = 1 << 40
_BALLS = ",".join(f"`{n}`:binary" for n in Tree.NAMES)
BLOCKS = f"ids array<bigint>, labels array<string>, vectors binary, trees array<struct<{_BALLS}>>"


def label_key(label_col: str) -> Column:
    """The label as a string in which null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), col(label_col).cast("string")), F.lit(""))


def _blocks(rows: DataFrame, width: int, parts: int, block_values: int) -> DataFrame:
    """Packed vectors (padded with 0) of up to ``block_values`` components, with a tree for each part."""
    most = max(256, block_values // max(1, width * parts))

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = matrix(table["vector"].combine_chunks(), width * parts)
        trees = [build(np.ascontiguousarray(vectors[:, p * width : (p + 1) * width])).packed() for p in range(parts)]
        kind = pa.struct([(n, pa.binary()) for n in Tree.NAMES])
        return pa.RecordBatch.from_arrays(
            [pa.array([table["id"].to_pylist()], pa.list_(pa.int64())), pa.array([table["label"].to_pylist()], pa.list_(pa.string())),
             pa.array([vectors.tobytes()], pa.binary()), pa.array([trees], pa.list_(kind))],
            names=["ids", "labels", "vectors", "trees"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, most - count))
                count += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if count == most:
                    yield packed(held)
                    held, count = [], 0
        if count:
            yield packed(held)

    return rows.mapInArrow(pack, BLOCKS)


def _owners(row: dict, width: int, parts: int) -> list[Owner]:
    vectors = np.frombuffer(row["vectors"], dtype=np.int64).reshape(len(row["ids"]), width * parts)
    return [Owner(Tree.unpacked(t), vectors[:, p * width : (p + 1) * width]) for p, t in enumerate(row["trees"])]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _totals(blocks: DataFrame, books: list[np.ndarray], width: int) -> list:
    """Count and component sums of every entry that owns parts, over all blocks."""
    parts = len(books)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            for p, owner in enumerate(_owners(row, width, parts)):
                _, sums, counts = owner.assign(books[p])
                used = np.flatnonzero(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64()), lists], names=["part", "entry", "n", "sums"])

    told = blocks.mapInArrow(walk, "part int, entry int, n bigint, sums array<bigint>")
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()  # at most parts x entries rows


def learn(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, block_values: int = 1 << 20) -> tuple[DataFrame, list[np.ndarray]]:
    """The written blocks of ``id, label, vector`` rows, and the codebook of each part after ``rounds`` rounds."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts)
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    start = np.zeros((len(first), width * parts), dtype=np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["vector"])] = r["vector"]
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    blocks = cut(_blocks(rows, width, parts, block_values), "blocks")
    for _ in range(rounds if width else 0):
        for r in _totals(blocks, books, width):
            books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return blocks, books


def encode(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``id, label, code, error`` of every row in the blocks; errors beyond 64 bits are cut to them."""
    parts, width = len(books), books[0].shape[1]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            n = len(row["ids"])
            codes, errors = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=object)
            for p, owner in enumerate(_owners(row, width, parts)):
                entry = owner.assign(books[p])[0]
                codes[owner.tree.order, p] = entry
                errors[owner.tree.order] += [int(e) for e in owner.errors(books[p], entry)]
            digits = codes.tobytes().hex()
            texts = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            capped = [min(e, (1 << 63) - 1) for e in errors]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(texts), pa.array(capped, pa.int64())], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(walk, "id bigint, label string, code string, error bigint")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal: by part, entry and position, joined with commas."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    block_values: int = 1 << 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector.

    A code has two hex digits a part: the nearest of at most 256 ``entries``
    by squared distance, ties to the lower. The codebooks start as the parts of
    the smallest ids (null ids last, equal ids by their vectors) and follow the
    floored means of what they own for ``rounds`` rounds; unused entries stay.

    Vectors null or with null, NaN or infinite components are left out. Shorter
    vectors count as filled with 0 up to the longest, whose length is rounded up
    to a multiple of ``parts``. Components beyond 2^40 after scaling are cut to
    it. Null labels are one label. Repeated rows are coded one by one; an empty
    table gives an empty result; other columns are not read. ``block_values``
    bounds what a task holds; labels that many rows share are joined apart.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code holds two hex digits a part: 1 to 256 entries")
    rows = integer_vectors(vectors, id_col, vector_col, scale, label_key(label_col).alias("label"))
    rows = rows.withColumn("vector", F.transform("vector", lambda v: F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST))))
    blocks, books = learn(rows, parts, entries, rounds, block_values)
    coded = cut(encode(blocks, books), "codes")
    labels = coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    found = spread_join(coded, labels, ["label"])
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
