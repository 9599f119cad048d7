"""Token-id files of directly addressable codes (DACs).

A segment holds the ids of some documents, each id split into chunks of
``bits`` bits, lowest first. Level k holds the k-th chunk of every id that has
one, next to a bitmap that says which of them continue at level k + 1 and a
rank directory (ones before every 512 bits). The chunk of an id at the next
level stands at the rank of its bit, so any token is read with one look per
level, and no block is decoded.

Segments are rows of a Parquet table in the shared folder, so that Spark's
writers commit them, any store Spark reaches can hold them, and a lost
executor's task is simply run again.

Segment layout, little-endian: ``b"DAC1"``; u32 levels, u32 bits, u64 ids;
per level u64 chunks, the chunks (u8), the bitmap (ceil(chunks / 64) u64) and
the directory (ceil(chunks / 512) u64). Documents' places are in the row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import col, new_path, partition_starts
from ledgerloom.llm.tokens import encoder

SEGMENTS = "part int, segment int, part_start long, tokens long, doc_ids array<long>, starts array<long>, payload binary"
_HEAD, _BLOCK = struct.Struct("<4sIIQ"), 512


def encode_segment(ids: np.ndarray, bits: int = 8) -> bytes:
    """The DAC bytes of unsigned 32-bit ids."""
    levels: list[bytes] = []
    rest = ids.astype(np.uint32)
    while True:
        chunks = (rest & ((1 << bits) - 1)).astype(np.uint8)
        rest = rest >> bits
        more = rest > 0
        padded = np.zeros(-(-len(chunks) // _BLOCK) * _BLOCK, dtype=np.uint8)
        padded[: len(chunks)] = more
        ones = padded.reshape(-1, _BLOCK).sum(axis=1, dtype=np.uint64)
        words = np.packbits(padded, bitorder="little").view("<u8")[: -(-len(chunks) // 64)]
        ranks = (np.cumsum(ones, dtype=np.uint64) - ones).astype("<u8")
        levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes() + words.tobytes() + ranks.tobytes())
        rest = rest[more]
        if not len(rest):
            return _HEAD.pack(b"DAC1", len(levels), bits, len(ids)) + b"".join(levels)


class Segment:
    """Reads a segment's tokens at any places."""

    def __init__(self, payload: bytes):
        magic, levels, self._bits, self.tokens = _HEAD.unpack_from(payload)
        if magic != b"DAC1":
            raise ValueError("not a DAC segment")
        self._levels, at = [], _HEAD.size
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            chunks = np.frombuffer(payload, np.uint8, n, at := at + 8)
            words = np.frombuffer(payload, "<u8", -(-n // 64), at := at + n)
            ranks = np.frombuffer(payload, "<u8", -(-n // _BLOCK), at := at + 8 * len(words))
            at += 8 * len(ranks)
            self._levels.append((chunks, words, ranks))

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at ``places`` (any order, repeats allowed): one look per level for each."""
        at = np.asarray(places, dtype=np.int64)
        ids = np.zeros(len(at), dtype=np.uint32)
        live = np.arange(len(at))
        for k, (chunks, words, ranks) in enumerate(self._levels):
            ids[live] |= chunks[at].astype(np.uint32) << np.uint32(self._bits * k)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            on = (words[word] >> bit) & np.uint64(1) == 1
            live, at, word, bit = live[on], at[on], word[on], bit[on]
            if not len(live):
                break
            rank = ranks[at // _BLOCK].astype(np.int64)
            first = (at // _BLOCK) * (_BLOCK // 64)
            for j in range(_BLOCK // 64 - 1):  # whole words of the block before the bit's own
                here = first + j < word
                rank[here] += np.bitwise_count(words[(first + j)[here]]).astype(np.int64)
            below = (np.uint64(1) << bit) - np.uint64(1)
            at = rank + np.bitwise_count(words[word] & below).astype(np.int64)
        return ids

    def scan(self, start: int, stop: int) -> np.ndarray:
        """The ids of a run of places: a run's continuing chunks stand together at the next level too."""
        ids = np.zeros(stop - start, dtype=np.uint32)
        live = np.arange(stop - start)
        for k, (chunks, words, _) in enumerate(self._levels):
            if not len(live):
                break
            ids[live] |= chunks[start:stop].astype(np.uint32) << np.uint32(self._bits * k)
            lowest = start >> 6
            bits = np.unpackbits(words[lowest : -(-stop // 64)].view(np.uint8), bitorder="little")
            on = bits[start - 64 * lowest : stop - 64 * lowest].astype(bool)
            start = self._rank(k, start)
            stop = start + int(on.sum())
            live = live[on]
        return ids

    def _rank(self, level: int, at: int) -> int:
        """Ones before place ``at`` of a level."""
        _, words, ranks = self._levels[level]
        if at // _BLOCK >= len(ranks):
            return 0
        first = at // _BLOCK * (_BLOCK // 64)
        ones = int(ranks[at // _BLOCK]) + int(np.bitwise_count(words[first : at >> 6]).sum())
        return ones + (int(words[at >> 6]) & ((1 << (at & 63)) - 1)).bit_count() if at & 63 else ones


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    partitions: int | None = None,
    segment_tokens: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every document and write DAC segments to ``path`` in ascending id order, null ids first.

    Rows with one id are ordered by their text. Null and empty texts are the
    end id alone; an empty table writes no segment; other columns are not
    read. A segment ends at the first document that takes it to
    ``segment_tokens``; a longer document is one segment.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id).document
        number, before, held, ids, starts, parts = 0, 0, 0, [], [], []
        part = None

        def flush() -> pa.RecordBatch:
            payload = encode_segment(np.frombuffer(b"".join(parts), dtype="<u4"))
            return pa.RecordBatch.from_pylist(
                [{"part": part, "segment": number, "part_start": before, "tokens": held, "doc_ids": ids, "starts": starts, "payload": payload}],
                schema=pa.schema(
                    [("part", pa.int32()), ("segment", pa.int32()), ("part_start", pa.int64()), ("tokens", pa.int64()),
                     ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("payload", pa.binary())]
                ),
            )

        for batch in batches:
            for row_id, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                part = at.as_py()
                data = encode(text.as_py())
                ids.append(row_id)
                starts.append(held)
                parts.append(data)
                held += len(data) // 4
                if held >= segment_tokens:
                    yield flush()
                    number, before, held, ids, starts, parts = number + 1, before + held, 0, [], [], []
        if ids:
            yield flush()

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(partitions, "doc_id", tie) if partitions else rows.repartitionByRange("doc_id", tie)
    rows = rows.sortWithinPartitions("doc_id", tie, "text").withColumn("part", F.spark_partition_id())
    rows.mapInArrow(segments, SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, tokens, ids, starts, payload in zip(*batch.columns):
                segment, starts = Segment(payload.as_buffer()), starts.as_py()
                ends = [*starts[1:], tokens.as_py()]
                sums = [zlib.crc32(segment.scan(a, b).astype("<u4").tobytes()) for a, b in zip(starts, ends)]
                first = np.array(starts, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), part.as_py(), dtype=np.int32)), ids.values, pa.array(first + before.as_py()),
                     pa.array(np.array(ends, dtype=np.int64) - first), pa.array(sums, pa.int64())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    found = _segments(spark, path)
    # one row per write task, so the broadcast is bounded by the number of partitions
    bases = partition_starts(found.groupBy("part").agg(F.sum("tokens").alias("tokens")), "part", "tokens")
    rows = found.select("part", "part_start", "tokens", "doc_ids", "starts", "payload").mapInArrow(
        documents, "part int, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Single tokens: ``doc_id, place, token`` for each ``doc_id, place`` of ``wanted`` that exists.

    Documents' places are joined first; each segment with wanted tokens is
    then read once, with all of its places.
    """

    def tokens(segments: pa.Table, places: pa.Table) -> pa.Table:
        found = np.zeros(len(places), dtype=np.int64)
        if len(segments) and len(places):
            found = Segment(segments["payload"][0].as_buffer()).get(places["at"].to_numpy()).astype(np.int64)
        return pa.table({"doc_id": places["doc_id"], "place": places["place"], "token": pa.array(found)})

    docs = _segments(spark, path).withColumn("ends", F.concat(F.slice("starts", 2, F.size("starts")), F.array("tokens")))
    docs = docs.select("part", "segment", F.explode(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("starts").alias("a"), F.col("ends").alias("b"))).alias("d"))
    found = docs.join(wanted.select("doc_id", "place"), (F.col("d.doc_id") == F.col("doc_id")) & (F.col("place") >= 0) & (F.col("d.a") + F.col("place") < F.col("d.b")))
    found = found.select("part", "segment", "doc_id", "place", (F.col("d.a") + F.col("place")).alias("at"))
    touched = found.select("part", "segment").distinct()
    read = _segments(spark, path).join(touched, ["part", "segment"], "left_semi").select("part", "segment", "payload")
    return read.groupBy("part", "segment").cogroup(found.groupBy("part", "segment")).applyInArrow(tokens, "doc_id long, place long, token long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' token files to the shared folder and return what :func:`read_documents` finds there."""
    path = new_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer_path, end_id, partitions, id_col=id_col, text_col=text_col)
    return read_documents(docs.sparkSession, path)
