"""Hard negatives, vector codes, toxicity: against plain versions, SQL and odd inputs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives, metric_trees, queries, text_cnn, toxicity, vector_codes

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, s string, key string"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls in every column, ties, repeated rows and ids, short, empty and bad vectors, clashing extra columns."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 8) / 8], i % 4) for i in range(120)]
    rows += [(0, rows[0][1], 0), (50, rows[50][1], 2), (50, rows[50][1], 2), (None, rows[3][1], 1), (None, None, None), (131, rows[9][1], None)]
    rows += [(133, None, 1), (134, [], 2), (135, [0.5], 3), (136, [math.nan] * 8, 1), (137, [math.inf] + [0.0] * 7, 2), (138, [None] * 8, 3)]
    rows += [(150, rows[50][1], 2), (151, [1e12] * 8, 1), (200, [-1.0] * 8, 1)]
    return spark.createDataFrame([(*r, "id", "s", "key") for r in rows], VECTORS)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes"])
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


def usable(df, scale, labelled):
    rows = []
    for r in df.collect():
        v = r["embedding"]
        if v is None or any(x is None or not math.isfinite(x) for x in v) or (labelled and r["label"] is None):
            continue
        rows.append((r["vec_id"], [math.floor(scale * x) for x in v], r["label"]))
    return rows


def plain_negatives(rows, every=50, positives=5, negatives=3):
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for own, q, label in {(i, tuple(v), y) for i, v, y in rows if i is not None and i % every == 0}:
        scored = [(dot(q, v), i, y) for i, v, y in rows if i != own]
        best = sorted((s for s in scored if s[2] == label), key=lambda s: (-s[0], last(s[1])))[:positives]
        for p, pid, _ in best:
            hits = sorted((s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p), key=lambda s: (-s[0], last(s[1])))[:negatives]
            out += [(own, pid, k + 1, s[1], p, s[0]) for k, s in enumerate(hits)]
    return out


def capped(rows):
    most, least = (1 << 63) - 1, -(1 << 63)
    return sorted(((*r[:4], max(least, min(most, r[4])), max(least, min(most, r[5]))) for r in rows), key=str)


@pytest.mark.parametrize("shard_rows", [65_536, 20])
def test_hard_negatives_of_odd_vectors(spark, odd_vectors, shard_rows):
    small = odd_vectors.where("vec_id IS NULL OR vec_id <> 151")
    got = hard_negatives.mine(small, shard_rows=shard_rows)
    assert capped(map(tuple, got.collect())) == capped(plain_negatives(usable(small, 256, True)))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.mine(odd_vectors.where("vec_id < 0")).count() == 0
    # values beyond exact doubles are compared as Python's integers
    huge = odd_vectors.select("vec_id", F.transform("embedding", lambda x: x * 1e9).alias("embedding"), "label")
    assert capped(map(tuple, hard_negatives.mine(huge, shard_rows=shard_rows, scale=1).collect())) == capped(plain_negatives(usable(huge, 1, True)))


def test_hard_negatives_of_one_label_only(spark):
    rows = [(i, [float(i % 7), 1.0], 3) for i in range(101)]
    assert hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 4))
def test_vertical_scan_keeps_all_that_count(seed, wide, k):
    rng = np.random.default_rng(seed)
    x = rng.integers(-wide, wide + 1, (90, 20))
    labels = rng.integers(0, 3, 90)
    shard = hard_negatives.Columns(np.arange(90), np.ones(90, dtype=bool), labels, x)
    q = rng.integers(-wide, wide + 1, 20)
    rows = [(i, x[i].tolist(), int(labels[i])) for i in range(90)]
    best = sorted((-int(q @ x[i]), i) for i in range(90) if labels[i] == 1 and i != 4)[:k]
    assert shard.positives(4, 1, q, k) == [(i, -s) for s, i in best]
    windows = [(-5, 5), (0, 30), (9, 3), (10, 10)]
    for (low, high), got in zip(windows, shard.negatives(4, 1, q, windows, k)):
        hits = sorted((-int(q @ np.array(v)), i) for i, v, y in rows if y != 1 and i != 4 and low <= int(q @ np.array(v)) <= high)
        assert got == [(i, -s) for s, i in hits[:k]]


def test_vertical_scan_leaves_entries_unread():
    rng = np.random.default_rng(3)
    x = (256 * rng.normal(0, 1, (20_000, 64)) / 8).astype(int)
    x[:, :16] *= 6  # a few dimensions say most
    shard = hard_negatives.Columns(np.arange(len(x)), np.ones(len(x), dtype=bool), np.arange(len(x)) % 2, x)
    shard.positives(0, 0, x[0], 5)
    assert shard.read < 0.5 * 10_000 * 64
    best = shard.positives(0, 0, x[0], 1)[0][1]
    shard.read = 0
    shard.negatives(0, 0, x[0], [(best // 2, 95 * best // 100)], 3)
    assert shard.read < 0.7 * 10_000 * 64


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(id, label, code, error), books."""
    width = -(-max((len(v) for _, v, _ in rows), default=0) // parts)
    rows = [(i, [max(-(1 << 40), min(1 << 40, c)) for c in v], y) for i, v, y in rows]
    full = [v + [0] * (width * parts - len(v)) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    cuts = [[v[p * width : (p + 1) * width] for v in full] for p in range(parts)]
    books = [[list(cuts[p][k]) for k in order] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in cuts[p]:
                own.setdefault(nearest(x, books[p])[1], []).append(x)
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for k, (i, _, y) in enumerate(rows):
        hits = [nearest(cuts[p][k], books[p]) for p in range(parts)]
        out.append((i, y, "".join(f"{e:02x}" for _, e in hits), min((1 << 63) - 1, sum(d for d, _ in hits))))
    return out, books


@pytest.mark.parametrize("options", [{}, {"block_values": 1, "entries": 9}, {"parts": 3, "entries": 5, "rounds": 2}])
def test_codes_of_odd_vectors(spark, odd_vectors, options):
    got = vector_codes.compress(odd_vectors.repartition(3), **options).collect()
    rows, books = plain_codes(usable(odd_vectors, 1024, False), **{k: v for k, v in options.items() if k != "block_values"})
    by_label = {}
    for _, y, _, e in rows:
        by_label[y] = by_label.get(y, 0) + e
    digest = vector_codes.books_digest([np.array(b, dtype=object) for b in books])
    assert sorted(map(str, got)) == sorted(str(type(got[0])(vec_id=i, code=c, error=e, label_error=by_label[y], codebooks_sha256=digest)) for i, y, c, e in rows)
    assert vector_codes.compress(odd_vectors.where("vec_id < 0")).count() == 0
    assert vector_codes.compress(odd_vectors.where("vec_id = 134")).count() == 1  # a vector without components


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 5), st.sampled_from([1, 3, 1000, 1 << 30]), st.integers(1, 20))
def test_trees_own_what_a_full_scan_owns(seed, n, width, wide, entries):
    rng = np.random.default_rng(seed)
    points = rng.integers(-wide, wide + 1, (n, width))
    tree = metric_trees.build(points, leaf=4)
    assert sorted(tree.order.tolist()) == list(range(n)) and (tree.sums[0] == points.sum(axis=0)).all()
    tree = metric_trees.Tree.unpacked(tree.packed())
    owner, book = metric_trees.Owner(tree, points), rng.integers(-wide, wide + 1, (entries, width))
    entry, sums, counts = owner.assign(book)
    away = ((owner.points.astype(object)[:, None, :] - book.astype(object)[None]) ** 2).sum(axis=2)
    assert entry.tolist() == [min(range(entries), key=lambda e: (row[e], e)) for row in away]
    assert counts.tolist() == np.bincount(entry, minlength=entries).tolist()
    assert (sums == np.stack([owner.points[entry == e].sum(axis=0) for e in range(entries)])).all()
    assert [int(e) for e in owner.errors(book, entry)] == [int(row[e]) for row, e in zip(away, entry)]


def test_trees_spare_distances_where_points_cluster():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (64, 16))
    points = centres[rng.integers(0, 64, 8000)] + rng.integers(-20, 21, (8000, 16))
    owner = metric_trees.Owner(metric_trees.build(points), points)
    owner.assign(points[:256])
    assert owner.asked < 0.2 * 8000 * 256
    owner.asked = 0
    owner.assign(centres)  # whole balls have one entry left
    assert owner.asked < 0.1 * 8000 * 64


def test_toxicity_on_held_out_rows(spark, tmp_path):
    """Labels that stems decide, in two languages, with unseen endings in the held-out half."""
    rng = np.random.default_rng(2)
    ends = ["a", "en", "isch", "ung", "eit", "ers", "ino", "ab"]
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "ter", "no", "su"], rng.integers(1, 4)))
    rows, truth = [], {}
    for i in range(1200):
        words, toxic = [word() for _ in range(rng.integers(5, 80))], int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words.insert(int(rng.integers(0, len(words))), "idiot" if i % 2 else "grumpf" + str(rng.choice(ends)))
        rows.append((i, " ".join(words), "en" if i % 2 else "de"))
        truth[i] = toxic
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, t) for i, t in truth.items()], "doc_id long, quality int, toxic int")
    judged = {r["doc_id"]: r for r in toxicity.judge(docs, labels).collect()}
    out = [(judged[i]["score"] >= 0.7, judged[i]["toxic"], t) for i, t in truth.items() if judged[i]["held_out"]]
    assert len(out) > 300
    for k in (0, 1):
        assert np.mean([bool(o[k]) == bool(o[2]) for o in out]) > 0.97
    # neither the held-out labels nor language, source and id change a score
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.judge(docs.withColumn("source", F.lit("x")), turned).collect()}
    assert again == {i: r["score"] for i, r in judged.items()}
    moved = docs.union(docs.select(F.col("doc_id") + 10_000, "text", F.lit("xx")))
    both = {r["doc_id"]: r["score"] for r in toxicity.judge(moved, labels).collect()}
    assert all(both[i] == both[i + 10_000] for i in truth)


def test_toxicity_learns_from_every_label(spark):
    """What only labels beyond the 5,000 smallest hashes tell is learned, over several tasks whose steps are summed in two ways."""
    rng = np.random.default_rng(4)
    ids = spark.range(9_000).select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("out"), F.xxhash64("id").alias("h")).collect()
    late = {r["doc_id"] for r in sorted((r for r in ids if not r["out"]), key=lambda r: r["h"])[5_000:]}
    assert len(late) > 500
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "ter", "no", "su"], 3))
    rows = []
    for r in ids:
        toxic = int((r["out"] or r["doc_id"] in late) and r["doc_id"] % 2)
        rows.append((r["doc_id"], " ".join([word() for _ in range(6)] + ["zorg"] * toxic), "en", toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    judged = toxicity.judge(docs, docs.select("doc_id", "toxic"), shard=1_000).where("held_out").select("toxic", "score").collect()
    truth = {r[0]: r[3] for r in rows}
    assert {r["toxic"] for r in judged} == {False, True} and len(judged) > 2_500
    scores = {r["doc_id"]: r["score"] for r in toxicity.judge(docs.drop("toxic"), docs.select("doc_id", "toxic")).where("held_out").collect()}
    assert np.mean([(s >= 0.7) == bool(truth[i]) for i, s in scores.items()]) > 0.99
    # twenty tasks: their steps are summed in tasks first
    few = docs.select(F.xxhash64("doc_id").alias("h"), "text", F.col("toxic").cast("long").alias("y")).repartition(20, "h")
    model = text_cnn.fit(pa.array([r[1] for r in rows[:500]]), np.array([r[3] for r in rows[:500]]), epochs=0)
    moved = toxicity._round(few, model, 1, 1).raw(pa.array(["balomi zorg", "balomi"]))
    assert moved[0] - moved[1] > np.subtract(*model.raw(pa.array(["balomi zorg", "balomi"])))


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (5, 1, 1), (5, 1, 0), (None, 1, 1), (10, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(odd_documents, labels).collect()
    assert len(got) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in got)
    assert [c for c in got[0].asDict() if c not in ("held_out", "limit", "toxic")] == [c for c in odd_documents.columns if c != "score"] + ["score"]
    assert toxicity.judge(no_documents, labels).count() == 0
    blank = {r["score"] for r in toxicity.judge(odd_documents, labels.where("doc_id < 0")).collect()}
    assert len(blank) == 1
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}


def test_classifier_reads_whole_texts_and_keeps_windows_apart():
    texts = ["bad day"] * 20 + ["good day"] * 20
    model = text_cnn.fit(pa.array(texts), np.array([1] * 20 + [0] * 20), epochs=30)
    long = "day " * 400_000 + "bad day"  # longer than a slice
    raw = model.raw(pa.array(["bad day", "good day", long, None, "", "bad day"]))
    assert raw[0] > 1 and raw[1] < 0 and raw[2] > 0 and raw[0] == raw[5] and raw[3] == raw[4]
    alone = [model.raw(pa.array([t]))[0] for t in ("day", "bad", "bad bad", "x")]
    assert np.allclose(model.raw(pa.array(["day", "bad", "bad bad", "x"])), alone, atol=1e-5)


def test_limits_follow_the_better_cut():
    assert toxicity.best_limit(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0]), 0.7) == pytest.approx(0.55)
    assert toxicity.best_limit(np.array([0.9, 0.8]), np.array([1, 1]), 0.7) == 0.7
    slope, shift = toxicity.calibrated(np.array([-4.0, -3, 3, 4] * 10), np.array([0.0, 0, 1, 1] * 10))
    assert slope > 0.05 and abs(shift) < 1
