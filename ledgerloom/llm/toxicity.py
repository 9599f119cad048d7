"""Toxicity scores of whole texts, by a convolutional classifier with limits calibrated by language.

The score depends on the text alone. Labels are learned from all labelled rows
outside the held-out ones; a fifth of them is kept from the fit to calibrate the
score as a probability and to choose for each language the score from which a
text counts as toxic.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.llm.common import col, cut, owned, release, source_columns, whole_row
from ledgerloom.llm.text_cnn import TextCnn, bucket_counts, descend, gathered, start


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def calibrated(raw: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, steps: int = 50) -> tuple[float, float]:
    """Slope (at least 0.05) and shift for which sigmoid(slope * raw + shift) fits the labels, whose ends are drawn in by their counts.

    Each entry counts as often as ``times`` says (once).
    """
    times = np.ones(len(y)) if times is None else times
    ones, n = float((times * y).sum()), float(times.sum())
    if not 0 < ones < n:
        return 1.0, 0.0
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (n - ones + 2))
    slope, shift = 1.0, 0.0
    for _ in range(steps):  # Newton's steps on the logistic loss
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))
        g, w = times * (p - t), times * (p * (1 - p) + 1e-9)
        a, b, c = (w * raw * raw).sum() + 1e-3, (w * raw).sum(), w.sum() + 1e-3
        ga, gb = (g * raw).sum() + 1e-3 * (slope - 1), g.sum() + 1e-3 * shift
        d = a * c - b * b
        slope, shift = slope - np.clip((c * ga - b * gb) / d, -1, 1), shift - np.clip((a * gb - b * ga) / d, -1, 1)
    return max(0.05, float(slope)), float(shift)


def best_limit(scores: np.ndarray, y: np.ndarray, otherwise: float, times: np.ndarray | None = None) -> float:
    """The limit with the best F1, halfway between the scores at either side; ``otherwise`` where one class is missing.

    Each entry counts as often as ``times`` says (once).
    """
    times = np.ones(len(y)) if times is None else times
    ones = (times * y).sum()
    if not 0 < ones < times.sum():
        return otherwise
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum((times * y)[order])
    f1 = 2 * hits / (np.cumsum(times[order]) + ones)
    f1[:-1][s[:-1] == s[1:]] = 0  # equal scores go together
    k = int(f1.argmax())
    return float(np.clip((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2, 0.05, 0.95))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of each batch of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            words = gathered(some.column("text"))
            if len(words.places):
                keys, n, ones = bucket_counts(words, some.column("y").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(ones)], names=["key", "n", "ones"])


def _dense(model: TextCnn) -> np.ndarray:
    """All parameters but the table, in one row."""
    return np.concatenate([*(f.ravel() for f in model.filters), model.shift, model.weight.ravel(), [model.bias]]).astype(np.float64)


def _moved(model: TextCnn, table: np.ndarray, dense: np.ndarray) -> TextCnn:
    """The model with its parameters moved by these steps."""
    new = _dense(model) + dense
    cuts = np.split(new, np.cumsum([*(f.size for f in model.filters), model.shift.size, model.weight.size]))
    filters = [c.reshape(f.shape).astype(np.float32) for c, f in zip(cuts, model.filters)]
    shift, weight, bias = cuts[len(filters) :]
    return TextCnn(model.keys, (model.table + table).astype(np.float32), filters, shift.astype(np.float32), weight.reshape(model.weight.shape).astype(np.float32), float(bias[0]))


_STEPS = "first long, rows long, met binary, steps binary, dense binary"


def _packed(first: int, rows: int, met: np.ndarray, steps: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
    blobs = [pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in ((met, np.int32), (steps, np.float32), (dense, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([rows], pa.int64()), *blobs], names=["first", "rows", "met", "steps", "dense"])


def _summed(found: Iterable[tuple]) -> tuple | None:
    """The sums of several tasks' steps, in the order of their first rows where they are listed so."""
    total = None
    for first, rows, met, steps, dense in found:
        one = [first, rows, np.frombuffer(met, np.int32), np.frombuffer(steps, np.float32), np.frombuffer(dense, np.float64)]
        total = one if total is None else [min(total[0], first), *[a + b for a, b in zip(total[1:], one[1:])]]
    return total


def _round(rows: DataFrame, model: TextCnn, passes: int, seed: int) -> TextCnn:
    """One round over all rows: each task descends on its own rows from the model on, and the steps are averaged.

    A bucket's vector moves by the mean over the tasks that met it, all else by
    the mean over rows. The sums are made in tasks first, so about the square
    root of the tasks' number of models reaches the driver.
    """

    def descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, met, n, first = _moved(model, np.zeros_like(model.table), np.zeros_like(_dense(model))), np.zeros(len(model.table), dtype=np.int32), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(np.argsort(batch.column("h").to_numpy(), kind="stable")))
            first = batch.column("h")[0].as_py() if first is None else first
            words = gathered(batch.column("text"))
            descend(mine, words, batch.column("y").to_numpy().astype(np.float64), passes, np.random.default_rng([seed, first & 0xFFFFFFFF, n]))
            met[np.unique(mine.rows(words.buckets))] = 1
            n += batch.num_rows
        if n:
            yield _packed(first, n, met, mine.table - model.table, n * (_dense(mine) - _dense(model)))

    def gathered_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _summed(tuple(v.as_py() for v in row) for batch in batches for row in zip(*batch.columns))
        if total:
            yield _packed(*total)

    steps = rows.select("h", "text", "y").mapInArrow(descended, _STEPS)
    tasks = rows.rdd.getNumPartitions()
    if tasks > 16:
        steps = steps.repartition(math.isqrt(tasks)).mapInArrow(gathered_steps, _STEPS)
    total = _summed(sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in steps.collect()))
    if total is None:
        return model
    _, n, met, moved, dense = total
    return _moved(model, moved.reshape(model.table.shape) / np.maximum(met, 1)[:, None], dense / n)


def train(
    docs: DataFrame,
    labels: DataFrame,
    shard: int = 4_096,
    rounds: int = 1,
    passes: int = 8,
    least_texts: int = 3,
    most: int = 1 << 15,
    least_rows: int = 20,
    most_langs: int = 256,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> tuple[TextCnn, tuple[float, float], dict[str, float], float]:
    """The classifier, slope and shift of its score, limits by language, and the limit of all other languages.

    Every labelled id that is not held out is used, and its whole text. Bucket
    counts are aggregates over all of them; the fit goes over all in rounds
    (:func:`_round`), dealt into tasks of about ``shard`` rows or more; slope
    and limits are chosen on the counts, by score in steps of 1/256 of log-odds,
    of all the fifth that is kept from the fit. The driver holds the model
    (``most`` buckets), those counts, and the ``most_langs`` most frequent
    languages; others have the overall limit. An id with several labels is toxic
    if one says so; one with several texts counts by its first.
    """
    sample = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id"))
    sample = sample.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).cast("long").alias("y"))
    lang = col(lang_col) if lang_col in docs.columns else F.lit(None)
    texts = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"))
    rows = texts.where(~held_out("id")).join(sample, "id").groupBy("id").agg(F.min(F.struct("text", "lang")).alias("t"), F.max("y").alias("y"))
    rows = rows.select(F.xxhash64("id").alias("h"), "t.text", "t.lang", "y", (F.pmod(F.xxhash64("id", F.lit(seed)), 5) == 4).alias("kept"))
    with owned() as mine:
        rows = cut(rows.repartition(max(1, -(-sample.count() // shard)), "h"), "toxicity")
        model = _fitted(rows.where("NOT kept"), rounds, passes, least_texts, most, seed)
        found = _judged(rows.where("kept"), model, most_langs)
        release(mine)
    raw, y, n = (np.array([r[c] for r in found], dtype=float) for c in ("step", "y", "n"))
    raw, langs = raw / 256, np.array([r["lang"] for r in found], dtype=object)
    slope, shift = calibrated(raw, y, n)
    scores = _sigmoid(slope * raw + shift)
    overall = best_limit(scores, y, 0.7, n)
    known = {k for k in langs if k is not None}
    limits = {k: best_limit(scores[langs == k], y[langs == k], overall, n[langs == k]) for k in sorted(known) if n[langs == k].sum() >= least_rows}
    return model, (slope, shift), limits, overall


def _fitted(rows: DataFrame, rounds: int, passes: int, least_texts: int, most: int, seed: int) -> TextCnn:
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = rows.select("text", "y").mapInArrow(_counted, "key long, n long, ones long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    got = counts.where(F.col("n") >= max(1, least_texts)).orderBy(F.desc("n"), "key").limit(most).collect()
    keys = np.array([r["key"] for r in got], dtype=np.int64).view(np.uint64)
    model = start(keys, *(np.array([r[c] for r in got], dtype=np.int64) for c in ("n", "ones")), ones / n if n else 0.5, np.random.default_rng(seed))
    if not 0 < ones < n:
        model.weight[:] = 0
        return model
    for nth in range(rounds):
        model = _round(rows, model, passes, seed + nth)
    return model


def _judged(rows: DataFrame, model: TextCnn, most_langs: int) -> list[Row]:
    """``lang, step, y, n``: counts of rows by language (null: a rare one), 256 times their log-odds, and class."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.rint(256 * np.clip(model.raw(batch.column("text")), -40, 40)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(step), batch.column("y")], names=["lang", "step", "y"])

    known = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()]
    lang = F.when(F.col("lang").isin(known), F.col("lang")) if known else F.lit(None).cast("string")
    counts = rows.select("text", "lang", "y").mapInArrow(scored, "lang string, step int, y long")
    return sorted(counts.groupBy(lang.alias("lang"), "step", "y").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["lang"] or "", r["step"], r["y"]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """All rows with ``held_out``, ``score``, ``limit`` and ``toxic`` (score of at least the limit of the row's language).

    The whole text is read, however long; null counts as empty, and empty texts
    get the score of a text without words. Rows are judged one by one, so ties
    and repeated rows make no difference. Languages unknown to the labelled rows, rare or
    null have the overall limit; without usable labels every score is the same.
    An empty table gives an empty result; input columns named like the added
    ones are replaced.
    """
    model, (slope, shift), limits, overall = train(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(_sigmoid(slope * model.raw(texts) + shift), pa.float64())

    lang = F.coalesce(col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    limit = F.lit(overall)
    if limits:  # at most most_langs languages
        limit = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in limits.items() for v in pair]), lang), limit)
    rows = docs.select(whole_row(docs).alias("src"), held_out(id_col).alias("h"), scored(F.coalesce(col(text_col).cast("string"), F.lit(""))).alias("s"), limit.alias("l"))
    added = {"held_out": F.col("h"), "score": F.col("s"), "limit": F.col("l"), "toxic": F.col("s") >= F.col("l")}
    names = [c for c in docs.columns if c.lower() not in added]
    return rows.select(*[c for c, name in zip(source_columns(docs), docs.columns) if name in names], *[v.alias(k) for k, v in added.items()])
