"""Quality rules: fixed limits first, then gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents, flattened to
node arrays and walked for a whole batch at once. They are monotonic in the
features that can only speak against a text (signs, repeats, capitals).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.boosting import Trees, fit
from ledgerloom.llm.bytehash import BYTE, VISIBLE, Texts, slices, window_hashes
from ledgerloom.llm.common import col, source_columns, whole_row

#: Statistics of the contract, then features of the trees with their direction (1 rising, -1 falling, 0 free).
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = {
    "words_log": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "capital_share": -1,
    "digit_share": 0, "exclaim_per_word": -1, "bar_per_word": -1, "stop_per_word": 0, "words_per_line": 0, "high_share": 0,
}
_SIGNS = np.isin(BYTE, np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_TABLES = {
    "points": VISIBLE & ((BYTE & 0xC0) != 0x80),
    "symbols": _SIGNS,
    "capitals": (BYTE >= 65) & (BYTE <= 90),
    "letters": ((BYTE | 32) >= 97) & ((BYTE | 32) <= 122),
    "digits": (BYTE >= 48) & (BYTE <= 57),
    "exclaims": BYTE == 33,
    "bars": BYTE == 124,
    "stops": (BYTE == 46) | (BYTE == 44),
    "high": (BYTE & 0xC0) == 0xC0,
}


def _repeated(grams: np.ndarray) -> int:
    """Words that lie in a window found twice or more, by 64-bit hashes of the windows' word hashes."""
    if len(grams) < 6:  # fewer than two windows
        return 0
    grams = grams[: len(grams) - 4]
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    place = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
    hit = (twice[place] == grams).astype(np.int64)
    cover = np.zeros(len(grams) + 5, dtype=np.int64)
    cover[: len(grams)] += hit
    cover[5:] -= hit
    return int((np.cumsum(cover) > 0).sum())


def measure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """STATISTICS (integers) and FEATURES of whole texts; null counts as empty, with all values 0."""
    statistics, features = [np.zeros((0, len(STATISTICS)), dtype=np.int64)], [np.zeros((0, len(FEATURES)))]
    for run in slices(texts):
        batch = Texts(run)
        starts, stops, at = batch.runs(VISIBLE)
        n = np.diff(at)
        grams = window_hashes(batch.hashes(starts, stops), 5)
        repeats = np.array([_repeated(grams[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], dtype=np.int64)
        a, b, lines = batch.lines()
        worded = np.searchsorted(starts, b) > np.searchsorted(starts, a)
        named = batch.hashes(a, b)
        held = np.diff(np.concatenate([[0], np.cumsum(worded)])[lines])
        dups = np.array([k - len(np.unique(named[x:y][worded[x:y]])) for k, x, y in zip(held.tolist(), lines[:-1].tolist(), lines[1:].tolist())], dtype=np.int64)
        c = {k: batch.counts(t.astype(np.int64)) for k, t in _TABLES.items()}
        statistics.append(np.stack([n, c["points"], c["symbols"], dups, repeats], axis=1))
        words, points, letters, some = (np.maximum(v, 1) for v in (n, c["points"], c["letters"], held))
        features.append(
            np.stack(
                [np.log1p(n), c["points"] / words, c["symbols"] / words, dups / some, repeats / words, c["capitals"] / letters,
                 c["digits"] / points, c["exclaims"] / words, c["bars"] / words, c["stops"] / words, n / some, c["high"] / points], axis=1,
            )
        )
    return np.concatenate(statistics), np.concatenate(features)


def _features_udf():
    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        _, x = measure(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    return features


def held_out(x: np.ndarray, y: np.ndarray, folds: int = 3) -> np.ndarray:
    """Each row's score by trees that were fitted without its fold."""
    scores, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        if (fold == k).any():
            scores[fold == k] = fit(x[fold != k], y[fold != k], np.array(list(FEATURES.values()))).score(x[fold == k])
    return scores


def keep_limit(scores: np.ndarray, y: np.ndarray, good_weight: float = 10.0) -> float:
    """The limit, 0.5 at most, at which good rows dropped (times the weight) and bad rows kept are fewest, as shares; of equal ones the lowest."""
    if not len(y) or not (y == 1).any():
        return 0.0
    limits = np.linspace(0.02, 0.5, 49)
    dropped = np.searchsorted(np.sort(scores[y == 1]), limits, side="left") / max(1, int((y == 1).sum()))
    kept = 1 - np.searchsorted(np.sort(scores[y == 0]), limits, side="left") / max(1, int((y == 0).sum()))
    return float(limits[int(np.argmin(good_weight * dropped + kept))])


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 10_000, good_weight: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[Trees, float]:
    """Trees for quality 1 and the score from which a document is kept.

    At most ``max_labels`` labelled ids are used, those with the smallest hash;
    an id with several labels counts as its lowest, one with several texts as
    its first. The limit is chosen on held-out folds by both errors
    (:func:`keep_limit`); a good document dropped weighs ``good_weight`` bad
    ones kept. Without usable labels every document is kept.
    """
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(max_labels)
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    # max_labels rows bound the broadcast, and what is collected
    texts = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = sorted(texts.select("id", "quality", _features_udf()("text").alias("x")).collect())
    x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES))
    y = np.array([float(r["quality"] > 0) for r in rows])
    trees = fit(x, y, np.array(list(FEATURES.values())))
    return trees, keep_limit(held_out(x, y), y, good_weight) if len(rows) else 0.0


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows with the statistics, ``base_failed``, ``score`` and ``kept``.

    Words are runs outside ``[\\x20\\x09-\\x0D]``. ``base_failed``: fewer than 10
    words, or over 20% of them in repeated 5-word windows. Whole texts are
    measured, however long. Null text counts as empty, so it fails. Rows are judged one by one, so ties and repeated rows
    make no difference; an empty table gives an empty result; input columns
    named like the added ones are replaced.
    """
    trees, limit = train(docs, labels, id_col=id_col, text_col=text_col, **options)

    @F.arrow_udf(f"struct<{','.join(f'{s}:long' for s in STATISTICS)},score:double>")
    def measured(texts: pa.Array) -> pa.Array:
        numbers, x = measure(texts)
        return pa.StructArray.from_arrays([*(pa.array(numbers[:, i]) for i in range(len(STATISTICS))), pa.array(trees.score(x))], names=[*STATISTICS, "score"])

    rows = docs.select(whole_row(docs).alias("src"), measured(col(text_col).cast("string")).alias("m"))
    failed = (F.col("m.n_words") < 10) | (100 * F.col("m.n_repeat_words") > 20 * F.col("m.n_words"))
    added = {s: F.col(f"m.{s}") for s in STATISTICS} | {"base_failed": failed, "score": F.col("m.score"), "kept": ~failed & (F.col("m.score") >= F.lit(limit))}
    names = [c for c in docs.columns if c.lower() not in added]
    return rows.select(*[c for c, name in zip(source_columns(docs), docs.columns) if name in names], *[v.alias(k) for k, v in added.items()])
