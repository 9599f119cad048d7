"""A convolutional text classifier in numpy: hashed word embeddings, several filter widths, max pooling.

A word's vector is the sum of the vectors of its buckets: hashes of the whole
word, of its first 3 to 6 bytes and of its last 4. Buckets that too few training
texts hold have no vector. As a filter is linear in the words under it, each
distinct word of a batch is multiplied by each filter's rows once, and windows
only add up what is found there; a text's features are each filter's largest and
second largest value over all windows of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ledgerloom.llm.bytehash import ALNUM, LOWER, Texts, mix, slices

HEADS, TAILS = (3, 4, 5, 6), (4,)
WIDTHS = (1, 2, 3)
#: How many of a filter's largest values are pooled.
POOLED = 2


@dataclass
class Words:
    """Some texts as places in a list of distinct words; ``at`` has each text's first place."""

    buckets: np.ndarray
    places: np.ndarray
    at: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """The words (letters, digits and non-ASCII characters) of whole texts, lower-cased in ASCII; null counts as empty."""
    batch = Texts(texts)
    starts, stops, at = batch.runs(ALNUM)
    names = batch.hashes(starts, stops, LOWER)
    _, first, places = np.unique(names, return_index=True, return_inverse=True)
    a, b = starts[first], stops[first]
    size = b - a
    kinds = [names[first]]
    for kind, (x, y) in enumerate([*((a, np.minimum(a + n, b)) for n in HEADS), *((np.maximum(b - n, a), b) for n in TAILS)], start=1):
        part = mix(batch.hashes(x, y, LOWER) + np.uint64(kind))
        kinds.append(np.where(size > (*HEADS, *TAILS)[kind - 1], part, np.uint64(0)))  # shorter words are known as a whole
    return Words(np.stack(kinds, axis=1) if len(first) else np.zeros((0, 1 + len(HEADS) + len(TAILS)), dtype=np.uint64), places.reshape(-1), at)


@dataclass
class TextCnn:
    """``keys`` are the sorted hashes of the buckets with a vector; row 0 of ``table`` is that of all others."""

    keys: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]
    shift: np.ndarray
    weight: np.ndarray
    bias: float

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        """Rows of the table for bucket hashes."""
        if not len(self.keys):
            return np.zeros(buckets.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, buckets), len(self.keys) - 1)
        return np.where(self.keys[at] == buckets, at + 1, 0)

    def pooled(self, vectors: np.ndarray, places: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's POOLED largest values of each filter (relu), and the windows they come from (-1: none)."""
        n, count = len(at) - 1, self.shift.shape[0]
        values = np.zeros((n, POOLED, count), dtype=np.float32)
        where = np.full((n, POOLED, count), -1, dtype=np.int64)
        filled = np.flatnonzero(np.diff(at))
        if not len(filled):
            return values, where
        starts, ends = at[filled], at[filled + 1]
        begin = 0
        for width, filt in zip(WIDTHS, self.filters):
            each = filt.shape[2]
            mine = slice(begin, begin + each)
            begin += each
            made = np.tile(self.shift[mine], (len(places), 1))
            for k in range(width):  # a window may reach beyond its text's end, where nothing is added
                spoken = (vectors @ filt[k])[places[k:]]
                if k:
                    ours = np.ones(len(places) - k, dtype=bool) if len(places) > k else np.zeros(0, dtype=bool)
                    for back in range(1, k + 1):
                        cut = ends[ends < len(places)] - back
                        ours[cut[(cut >= 0) & (cut < len(ours))]] = False
                    spoken[~ours] = 0
                made[: len(places) - k] += spoken
            for r in range(POOLED):
                top = np.maximum.reduceat(made, starts, axis=0)
                spread = np.repeat(top, ends - starts, axis=0)
                row, column = np.nonzero(made == spread)
                owner = np.repeat(np.arange(len(filled)), ends - starts)[row]
                first = np.full((len(filled), each), len(places), dtype=np.int64)
                first[owner[::-1], column[::-1]] = row[::-1]  # the first window with that value
                live = top > 0
                values[filled, r, mine] = np.where(live, top, 0)
                where[filled, r, mine] = np.where(live, first, -1)
                if r + 1 < POOLED:
                    made[first.ravel(), np.tile(np.arange(each), len(filled))] = -np.inf
        return values, where

    def raw(self, texts: pa.Array) -> np.ndarray:
        """Log-odds of class 1 of whole texts."""
        out = [np.zeros(0)]
        for run in slices(texts):
            words = words_of(run)
            values, _ = self.pooled(self.table[self.rows(words.buckets)].sum(axis=1), words.places, words.at)
            out.append(values.reshape(len(values), self.weight.size) @ self.weight.ravel() + self.bias)
        return np.concatenate(out).astype(float)


def gathered(texts: pa.Array) -> Words:
    """:func:`words_of` many texts, a slice at a time."""
    runs = [words_of(run) for run in slices(texts)]
    if not runs:
        return words_of(texts)
    buckets = np.concatenate([r.buckets for r in runs])
    _, first, which = np.unique(buckets[:, 0], return_index=True, return_inverse=True)
    which, base, places = which.reshape(-1).astype(np.int32), 0, []
    for r in runs:
        places.append(which[base + r.places])
        base += len(r.buckets)
    sizes = np.concatenate([np.diff(r.at) for r in runs])
    return Words(buckets[first], np.concatenate(places), np.concatenate([[0], np.cumsum(sizes)]))


def bucket_counts(words: Words, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket hashes of some texts, how many texts hold each, and how many of class 1."""
    keys, codes = np.unique(words.buckets, return_inverse=True)
    codes = codes.reshape(words.buckets.shape).astype(np.int32)
    counts, ones = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    for a, b, label in zip(words.at[:-1], words.at[1:], y):
        held = np.unique(codes[np.unique(words.places[a:b])])
        counts[held] += 1
        ones[held] += int(label)
    told = keys != 0  # 0: of words too short for a bucket
    return keys[told], counts[told], ones[told]


def start(keys: np.ndarray, counts: np.ndarray, ones: np.ndarray, mean: float, rng: np.random.Generator, dim: int = 8, filters: int = 8) -> TextCnn:
    """The classifier before its fit, for bucket hashes and the texts (of class 1) that hold them; ``mean`` is the share of class 1.

    The first component of a bucket's vector begins at its log-odds, so that a
    small sample suffices to tell rare words from telling ones.
    """
    order = np.argsort(keys)
    keys, counts, ones = keys[order], counts[order], ones[order]
    share = np.clip((ones + mean) / (counts + 1), 1e-3, 1 - 1e-3)
    odds = np.log(share / (1 - share)) - np.log(max(mean, 1e-3) / max(1 - mean, 1e-3))
    table = rng.normal(0, 0.05, (len(keys) + 1, dim)).astype(np.float32)
    table[1:, 0] = odds / 4
    table[0] = 0
    convs = [rng.normal(0, 0.2, (w, dim, filters)).astype(np.float32) for w in WIDTHS]
    for conv in convs:
        conv[:, 0, : filters // 2] = np.abs(conv[:, 0, : filters // 2]) + 0.3  # half of them begin as sums of log-odds
    count = filters * len(WIDTHS)
    mean = float(np.clip(mean, 1e-3, 1 - 1e-3))
    return TextCnn(keys, table, convs, np.zeros(count, dtype=np.float32), rng.normal(0.1, 0.02, (POOLED, count)).astype(np.float32), float(np.log(mean / (1 - mean))))


def fit(texts: pa.Array, y: np.ndarray, epochs: int = 8, least_texts: int = 3, most: int = 1 << 15, seed: int = 7) -> TextCnn:
    """A classifier of texts at hand, with the ``most`` frequent of the buckets that ``least_texts`` hold. With one class only, it is that constant."""
    rng = np.random.default_rng(seed)
    words = gathered(texts)
    keys, counts, ones = bucket_counts(words, y) if len(words.places) else (np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 2)
    kept = np.flatnonzero(counts >= max(1, least_texts))
    kept = kept[np.argsort(-counts[kept], kind="stable")[:most]]
    model = start(keys[kept], counts[kept], ones[kept], float(y.mean()) if len(y) else 0.5, rng)
    if not len(y) or y.min() == y.max():
        model.weight[:] = 0
        return model
    return descend(model, words, y.astype(np.float64), epochs, rng)


def descend(model: TextCnn, words: Words, y: np.ndarray, epochs: int, rng: np.random.Generator, rate: float = 0.01, batch: int = 64) -> TextCnn:
    """Adam on logistic loss from a model on, in place; the order of the texts is drawn anew each epoch."""
    table, convs, filters = model.table, model.filters, model.filters[0].shape[2]
    rows = model.rows(words.buckets)
    held = {"table": table, **{f"conv{i}": c for i, c in enumerate(convs)}, "shift": model.shift, "weight": model.weight}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in held.items()}
    bias_moments, step = [0.0, 0.0], 0
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            step += 1
            spans = [words.places[words.at[i] : words.at[i + 1]] for i in chosen]
            at = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
            used, places = np.unique(np.concatenate(spans), return_inverse=True)
            places = places.reshape(-1)
            vectors = table[rows[used]].sum(axis=1)
            values, where = model.pooled(vectors, places, at)
            raw = values.reshape(len(chosen), -1) @ model.weight.ravel() + model.bias
            wrong = (1 / (1 + np.exp(-raw)) - y[chosen]) / len(chosen)
            grads = {k: np.zeros_like(v) for k, v in held.items() if k != "table"}
            grads["weight"][:] = np.einsum("n,npc->pc", wrong, values)
            back = (wrong[:, None, None] * model.weight[None]) * (where >= 0)
            grads["shift"][:] = back.sum(axis=(0, 1))
            d_vectors = np.zeros_like(vectors)
            text, r, column = np.nonzero(where >= 0)
            window, told = where[text, r, column], back[text, r, column].astype(np.float32)
            for i, width in enumerate(WIDTHS):
                ours = (column >= i * filters) & (column < (i + 1) * filters)
                for k in range(width):
                    inside = ours & (window + k < at[text + 1])
                    word, f, g = places[window[inside] + k], column[inside] - i * filters, told[inside]
                    np.add.at(grads[f"conv{i}"][k].T, f, vectors[word] * g[:, None])
                    np.add.at(d_vectors, word, convs[i][k].T[f] * g[:, None])
            touched = np.flatnonzero(np.abs(d_vectors).sum(axis=1))
            grads["table"] = np.zeros_like(table)
            np.add.at(grads["table"], rows[used[touched]], d_vectors[touched][:, None, :])
            for k, v in held.items():
                m, s = moments[k]
                m += 0.1 * (grads[k] - m)
                s += 0.001 * (grads[k] ** 2 - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            table[0] = 0
            g = float(wrong.sum())
            bias_moments[0] += 0.1 * (g - bias_moments[0])
            bias_moments[1] += 0.001 * (g * g - bias_moments[1])
            model.bias -= rate * (bias_moments[0] / (1 - 0.9**step)) / (np.sqrt(bias_moments[1] / (1 - 0.999**step)) + 1e-8)
    return model
