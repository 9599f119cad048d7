"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are encoded and cut into pieces; full pieces are sequences of their
own. The others are dealt to shards of bounded size. In each shard, best-fit
decreasing opens the bins; a local search then exchanges one document for one,
two for one, one for two, or moves one, between any two underfull bins, until
no step raises the sum of squared fills; so the emptiest bins run empty. The
underfull bins of all shards are dealt anew while a round saves sequences.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import col, cut
from ledgerloom.llm.tokens import encoder

PIECES = "doc_id long, key long, piece int, start long, length long, ids_crc32 long"
_NONE = np.iinfo(np.int64).max
PACKED = PIECES + ", bin long, offset long, fill long"


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of a document: its ids, the end id last, cut every ``capacity`` ids.

    Null text counts as empty: a piece of the end id alone. ``key`` numbers
    the rows apart where ids repeat or are null.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoder(tokenizer_path, end_id).document, 4 * capacity
        for batch in batches:
            which, piece, length, crc = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                ids = encode(text.as_py())
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    which.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            rows = batch.select([0, 1]).take(pa.array(which, pa.int64()))
            numbers = np.array(piece, dtype=np.int32)
            made = [numbers, numbers.astype(np.int64) * capacity, np.array(length, dtype=np.int64), np.array(crc, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *map(pa.array, made)], names=["doc_id", "key", "piece", "start", "length", "ids_crc32"]
            )

    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("key"), col(text_col).cast("string").alias("text")
    )
    return rows.mapInArrow(cut_up, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item, longest first, to the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the distinct rooms that bins have, ascending
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(rooms, lengths[item])
        if at == len(rooms):
            room, which = capacity, len(bins)
            bins.append([])
        else:
            room = rooms[at]
            which = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[which].append(item)
        if left := room - lengths[item]:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(which)
    return bins


class _Search:
    """The underfull bins of a shard, and for each number of tokens the emptiest bin that can give it.

    ``least[k][s]`` is the fill of the emptiest bin that holds ``k`` documents
    of ``s`` tokens together (k 1 or 2). Heaps give it; entries of a bin that
    has changed since carry an old stamp and are dropped when they come up.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fills = [sum(lengths[i] for i in b) for b in bins]
        self.stamps = [0] * len(bins)
        self.sums: list[tuple[list[int], list[int]]] = [([], [])] * len(bins)
        self.heaps: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.least = tuple(np.full(capacity + 1, _NONE, dtype=np.int64) for _ in range(2))
        self.gains = np.arange(1, capacity + 1)
        for k in range(len(bins)):
            self.put(k)

    def renew(self, k: int) -> None:
        """Note what one and what two documents of a bin hold."""
        sizes = sorted(self.lengths[i] for i in self.bins[k])
        one = sorted(set(sizes))
        self.sums[k] = (one, sorted({x + y for i, x in enumerate(one) for y in one[i + 1 :]} | {2 * x for x, y in zip(sizes, sizes[1:]) if x == y}))

    def put(self, k: int) -> None:
        """Make a bin a giver, unless it is empty or full."""
        if not 0 < self.fills[k] < self.capacity:
            return
        self.renew(k)
        entry = (self.fills[k], k, self.stamps[k])
        for heaps, least, sums in zip(self.heaps, self.least, self.sums[k]):
            for s in sums:
                heapq.heappush(heaps.setdefault(s, []), entry)
                if entry[0] < least[s]:
                    least[s] = entry[0]

    def take(self, k: int) -> None:
        """The bin gives nothing until it is put back."""
        self.stamps[k] += 1
        for heaps, least, sums in zip(self.heaps, self.least, self.sums[k]):
            for s in sums:
                heap = heaps[s]
                while heap and heap[0][2] != self.stamps[heap[0][1]]:
                    heapq.heappop(heap)
                least[s] = heap[0][0] if heap else _NONE

    def find(self, k: int) -> tuple[int, int, int, int] | None:
        """The step that puts most into bin ``k`` and raises squared fill: its gain, what ``k`` gives, how many documents it gets, from where."""
        fill, (one, two) = self.fills[k], self.sums[k]
        gains = self.gains[: self.capacity - fill]
        best = None
        for n, outs in enumerate(([0, *one, *two], one)):  # a move, one for one, one for two; two for one
            outs = np.array(outs)
            # the giver ends below where k began, or it was the emptier one
            fits = self.least[n][outs[:, None] + gains] < fill + gains
            found = np.flatnonzero(fits.any(axis=0))
            if len(found) and (best is None or found[-1] + 1 > best[0]):
                gain = int(found[-1]) + 1
                out = int(outs[fits[:, gain - 1].argmax()])
                best = (gain, out, n + 1, self.heaps[n][out + gain][0][1])
        return best

    def pick(self, k: int, total: int, most: int) -> list[int]:
        """Documents of bin ``k`` of ``total`` tokens: none, one, or at most ``most``."""
        if not total:
            return []
        by_length: dict[int, list[int]] = {}
        for i in self.bins[k]:
            by_length.setdefault(self.lengths[i], []).append(i)
        if total in by_length and most != 2:
            return by_length[total][:1]
        for x, here in by_length.items():
            if len(there := by_length.get(total - x, [])) > (2 * x == total):
                return [here[0], there[-1]]
        raise AssertionError("no such documents")

    def swap(self, k: int, step: tuple[int, int, int, int]) -> int:
        """Take the step with bin ``k``, which is no giver now; returns the other bin."""
        gain, out, n, low = step
        one = n == 2 or out in self.sums[k][0]
        gives, gets = self.pick(k, out, 1 if one else 2), self.pick(low, out + gain, n)
        self.take(low)
        self.bins[k] = [i for i in self.bins[k] if i not in gives] + gets
        self.bins[low] = [i for i in self.bins[low] if i not in gets] + gives
        self.fills[k] += gain
        self.fills[low] -= gain
        self.put(low)
        return low


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Moves and exchanges between all pairs of underfull bins, until none raises squared fill.

    Bins take their turns fullest first. In its turn a bin takes, of all steps
    with all other underfull bins (a move, one for one, two for one, one for
    two), the one that puts most into it, until there is none. Turns go on
    until no bin has changed since every other one's last turn.
    """
    search = _Search([list(b) for b in bins], lengths, capacity)
    clock, seen = 1, [0] * len(bins)
    while True:
        began = clock
        for k in sorted(range(len(bins)), key=lambda k: (-search.fills[k], k)):
            if seen[k] == clock or not 0 < search.fills[k] < capacity:
                continue
            search.take(k)
            while search.fills[k] < capacity and (step := search.find(k)):
                search.swap(k, step)
                clock += 1
                search.renew(k)
            search.put(k)
            seen[k] = clock
        if clock == began:
            return [b for b in search.bins if b]


def _pack_shard(key: tuple, pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["key", "piece"], ignore_index=True)
    lengths = pdf["length"].tolist()
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    if (pdf["was"] >= 0).all():  # packed before: the bins of that round are no worse a start
        kept = local_search([b.tolist() for b in pdf.groupby("was").indices.values()], lengths, capacity)
        bins = min(kept, bins, key=len)
    rows = np.fromiter((i for b in bins for i in b), dtype=np.int64)
    sizes = np.array([len(b) for b in bins])
    out = pdf.iloc[rows].reset_index(drop=True)
    length = out["length"].to_numpy()
    first = np.cumsum(sizes) - sizes
    before = np.cumsum(length) - length
    out["bin"] = np.repeat(np.arange(len(bins), dtype=np.int64), sizes)
    out["offset"] = before - np.repeat(before[first], sizes)
    out["fill"] = np.repeat(np.add.reduceat(length, first), sizes)
    out["shard"] = key[0]
    return out.drop(columns="was")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    shard_pieces: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    Null ids stay null and repeated rows are packed one by one; null and empty
    texts are one end token; an empty table gives an empty result; other
    columns, whatever their names, are not read. ``shard_pieces`` bounds what
    one task packs on average. Full bins are final; the others are dealt anew,
    bin by bin, as long as there are several shards, a round has saved
    sequences and fewer sequences could hold their tokens.
    """
    rest = cut(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces").withColumn("was", F.lit(-1).cast("long"))
    done: list[DataFrame] = []
    count, before = rest.count(), None
    while True:
        shards, number = max(1, math.ceil(count / shard_pieces)), len(done)
        unit = [F.col("was")] if number else [F.col("key"), F.col("piece")]
        packed = rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(number), *unit), F.lit(shards)))
        packed = cut(packed.groupBy("shard").applyInPandas(lambda key, pdf: _pack_shard(key, pdf, capacity), PACKED + ", shard long"), "packed")
        packed = packed.withColumn("was", F.shiftleft("shard", 28) + F.col("bin"))
        ready = packed.select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.shiftleft(F.lit(number).cast("long"), 52) + F.col("was")).alias("sequence_id"), "offset", "fill",
        )
        # every bin has one piece at offset 0
        full = F.col("fill") == capacity
        made, loose, count, tokens = packed.agg(
            F.count_if(F.col("offset") == 0), F.count_if(~full & (F.col("offset") == 0)), F.count_if(~full), F.coalesce(F.sum(F.when(~full, F.col("length"))), F.lit(0))
        ).first()
        if shards == 1 or loose == math.ceil(tokens / capacity) or (before is not None and made >= before):
            done.append(ready.drop("fill"))
            break
        done.append(ready.where(full).drop("fill"))
        rest = packed.where(~full).select("doc_id", "key", "piece", "start", "length", "ids_crc32", "was")
        before = loose
    return reduce(DataFrame.unionByName, done)
