"""Runs of bytes in a batch of texts and their 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BYTE = np.arange(256, dtype=np.uint8)
LOWER = np.where((BYTE >= 65) & (BYTE <= 90), BYTE + 32, BYTE).astype(np.uint8)
#: Digits, letters and all bytes of non-ASCII characters.
ALNUM = ((BYTE >= 48) & (BYTE <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (BYTE >= 128)
#: All but space and the controls from tab to carriage return.
VISIBLE = (BYTE != 32) & ~((BYTE >= 9) & (BYTE <= 13))
MULTIPLIER = np.uint64(0xFF51AFD7ED558CCD)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_VALUE = mix(BYTE.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    power, inverse = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    power[0] = inverse[0] = 1
    return np.cumprod(power), np.cumprod(inverse)


class Texts:
    """The bytes of some texts (null: empty) one after another."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        self.offsets = offsets - offsets[0]
        self.data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if self.offsets[-1] else np.zeros(0, dtype=np.uint8)
        self._opens = np.zeros(len(self.data) + 1, dtype=bool)
        self._opens[self.offsets] = True

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and stops of the maximal runs of ``inside`` bytes within a text, and each text's first run."""
        held = inside[self.data]
        begins, ends = held.copy(), held.copy()
        begins[1:] &= ~held[:-1] | self._opens[1:-1]
        ends[:-1] &= ~held[1:] | self._opens[1:-1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and stops of the lines that a line feed splits, and each text's first line."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([feeds + 1, self.offsets[:-1]]), kind="stable")
        stops = np.sort(np.concatenate([feeds, self.offsets[1:]]), kind="stable")
        count = np.searchsorted(feeds, self.offsets[1:]) - np.searchsorted(feeds, self.offsets[:-1]) + 1
        return starts, stops, np.concatenate([[0], np.cumsum(count)])

    def hashes(self, starts: np.ndarray, stops: np.ndarray, fold: np.ndarray = BYTE) -> np.ndarray:
        """Hashes of runs of bytes, each byte seen as ``fold`` says."""
        power, inverse = _powers(max(SLICE_BYTES, 1 << max(0, len(self.data)).bit_length()))
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[fold][self.data] * power[: len(self.data)], out=sums[1:])
        return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))

    def counts(self, table: np.ndarray) -> np.ndarray:
        """For each text the sum of a 0/1 table over its bytes."""
        sums = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(table[self.data], out=sums[1:])
        return np.diff(sums[self.offsets])


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each word (only the first len - n + 1 are whole)."""
    out = np.zeros(len(words), dtype=np.uint64)
    for k in range(min(n, len(words))):
        out[: len(words) - k] = out[: len(words) - k] * MULTIPLIER + words[k:]
    return mix(out)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about SLICE_BYTES; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > SLICE_BYTES:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(texts) > start:
        yield texts.slice(start)
