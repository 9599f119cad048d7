"""Packing, search, mixing, token files, line dedup, n-gram join, pipeline: against plain versions and on odd inputs."""

import itertools
import json

import numpy as np
import pytest
import reference as plain
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect
from pyspark.sql import functions as F

from ledgerloom.llm import common, line_dedup, mixing, ngram_join, packing, queries, token_files, tokens, topk_search
from ledgerloom.llm.components import components


@pytest.fixture(scope="module")
def tokenizer(tokenizer_file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aAéÉßÿÖ's tTlL 09²½.,!<|>enof\t\n\r\x1c\u2003\u0301İıſKÅΣς中🙂_-#*×", max_size=40))
def test_encoder_is_the_library(tokenizer_file, text):
    encoder = tokens.encoder(tokenizer_file, 1)
    assert np.frombuffer(encoder.document(text), "<u4").tolist() == plain.encode(encoder_library(tokenizer_file), text)


def encoder_library(path, held={}):
    from tokenizers import Tokenizer

    return held.setdefault(path, Tokenizer.from_file(path))


def test_other_tokenizer_files_go_to_the_library(tmp_path, tokenizer_file, tokenizer):
    assert tokens.encoder(tokenizer_file, 1).by_words
    file = json.loads(tokenizer.to_str())
    file["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file))
    other, library = tokens.TextEncoder(str(path), 1), encoder_library(str(path))
    assert not other.by_words
    for text in ("Été\u0301 x\t y", "a b", "", None):
        assert np.frombuffer(other.document(text), "<u4").tolist() == plain.encode(library, text)


def test_special_token_strings(tokenizer_file, tokenizer):
    for text in ("a<|endoftext|>b", "<|startoftext|> x", "it's we'll", None, ""):
        assert np.frombuffer(tokens.encoder(tokenizer_file, 1).document(text), "<u4").tolist() == plain.encode(tokenizer, text)


def check_packing(rows, expected, capacity):
    """expected: key -> ids, rows: packed pieces."""
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    made = sorted((r["start"], r["length"], r["ids_crc32"], r["piece"]) for r in rows)
    wanted = sorted(
        (k, len(ids[k : k + capacity]), plain.crc(ids[k : k + capacity]), k // capacity) for ids in expected for k in range(0, len(ids), capacity)
    )
    assert made == wanted
    return len(bins)


def test_packing(spark, sf_dir, documents, tokenizer):
    ids = [plain.encode(tokenizer, t) for _, t in documents]
    rows = queries.op2_best_fit_packing(spark, sf_dir).collect()
    total = sum(map(len, ids))
    assert check_packing(rows, ids, 4096) <= -(-total // 4096) + 1


def test_packing_in_rounds_and_odd_documents(spark, odd_documents, no_documents, tokenizer_file, tokenizer):
    ids = [plain.encode(tokenizer, r["text"]) for r in odd_documents.collect()]
    rows = packing.pack(odd_documents, tokenizer_file, capacity=64, shard_pieces=100).collect()
    check_packing(rows, ids, 64)
    assert packing.pack(no_documents, tokenizer_file).count() == 0


def test_packing_deals_underfull_bins_anew(spark, tokenizer_file):
    """One-token words and the end token; bins of a shard that are 98% full still take part."""
    words = np.random.default_rng(3).integers(20, 60, 600).tolist()
    docs = spark.createDataFrame([(i, "a " * n) for i, n in enumerate(words)], "doc_id bigint, text string")
    cut_up = packing.pieces(docs, tokenizer_file, 128).collect()
    lengths = {r["doc_id"]: r["length"] for r in cut_up}
    assert len(cut_up) == len(lengths) == 600 and max(lengths.values()) < 128
    rows = packing.pack(docs, tokenizer_file, capacity=128, shard_pieces=20).collect()
    fills, ids = {}, []
    for r in rows:
        fills.setdefault(r["sequence_id"], []).append(r["length"])
        ids.append(r["doc_id"])
    assert sorted(ids) == list(range(600)) and all(sum(f) <= 128 for f in fills.values())
    least = -(-sum(lengths.values()) // 128)
    assert least == 190 and len(fills) <= 192


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_local_search_never_adds_bins(lengths):
    first = packing.best_fit(lengths, 50)
    after = packing.local_search([list(b) for b in first], lengths, 50)
    assert sorted(i for b in after for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in after) and len(after) <= len(first)


def test_local_search_empties_bins():
    """Best fit decreasing needs four bins here, exchanges bring it to three."""
    lengths = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    best = packing.best_fit(lengths, 60)
    assert len(packing.local_search(best, lengths, 60)) <= len(packing.best_fit(lengths, 60))
    swapped = packing.local_search([[0], [1], [2, 3]], [30, 30, 20, 20], 60)
    assert len(swapped) == 2


def steps_left(bins, lengths, capacity):
    """Moves, one for one, two for one and one for two that would raise squared fill."""
    fills = [sum(lengths[i] for i in b) for b in bins]
    for a, b in itertools.permutations(range(len(bins)), 2):
        for n_out, n_in in ((0, 1), (1, 1), (1, 2), (2, 1)):
            for out in itertools.combinations(bins[a], n_out):
                for into in itertools.combinations(bins[b], n_in):
                    gain = sum(lengths[i] for i in into) - sum(lengths[i] for i in out)
                    if 0 < gain <= capacity - fills[a] and (fills[a] + gain) ** 2 + (fills[b] - gain) ** 2 > fills[a] ** 2 + fills[b] ** 2:
                        yield out, into


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40))
def test_local_search_ends_where_no_step_is_left(lengths):
    after = packing.local_search(packing.best_fit(lengths, 97), lengths, 97)
    assert sorted(i for b in after for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 97 for b in after)
    assert next(steps_left(after, lengths, 97), None) is None


def test_local_search_saves_bins_among_many_underfull_ones():
    lengths = np.random.default_rng(1).integers(700, 1301, 2000).tolist()
    best = packing.best_fit(lengths, 4096)
    after = packing.local_search(best, lengths, 4096)
    assert sorted(i for b in after for i in b) == list(range(2000)) and all(sum(lengths[i] for i in b) <= 4096 for b in after)
    assert len(best) == 529 and len(after) <= 500  # at least 492


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-300, 300), min_size=6, max_size=6), min_size=1, max_size=80), st.integers(1, 6), st.integers(1, 20))
def test_shard_finds_the_best_for_any_threshold_that_k_reach(vectors, k, block):
    x = np.array(vectors, dtype=np.int64)
    shard = topk_search.Shard(np.arange(len(x)), np.ones(len(x), dtype=bool), x, block)
    scores = x @ x[0]
    wanted = sorted(range(1, len(x)), key=lambda i: (-scores[i], i))[:k]
    for reached in (-np.inf, float(scores[wanted[-1]]) if len(wanted) == k else -np.inf):
        asked = np.stack([x[0], x[-1]])
        places, found = shard.best(asked, np.array([0, -1]), k, np.array([reached, -np.inf]))[0]
        assert (places.tolist(), found) == (wanted, [int(scores[i]) for i in wanted])
        huge = [int(v) << 50 for v in x[0]]  # beyond exact doubles
        assert shard.best(np.array([huge]), np.array([0]), k)[0][0].tolist() == wanted


@pytest.mark.parametrize(("spread", "most"), [(1.0, 1.0), (0.9, 0.5), (0.8, 0.4)])
def test_search_reads_essential_postings_and_no_more_than_all(spread, most):
    """The more some terms count than others, the fewer postings are read."""
    rng = np.random.default_rng(8)
    x = (256 * rng.normal(0, 1, (20_000, 64)) * spread ** np.arange(64)).astype(np.int64)[:, rng.permutation(64)]
    shard = topk_search.Shard(np.arange(len(x)), np.ones(len(x), dtype=bool), x)
    asked = np.arange(0, len(x), 500)
    found = shard.best(x[asked], asked, 5)
    assert shard.read <= most * 64 * len(x) * len(asked)
    shard.read = 0
    again = shard.best(x[asked], asked, 5, np.array([float(s[-1]) for _, s in found]))
    assert shard.read <= 64 * len(x) * len(asked) and [f[0].tolist() for f in again] == [f[0].tolist() for f in found]
    scores = (x[asked[:3]] @ x.T).astype(float)
    for i in range(3):
        scores[i, asked[i]] = -np.inf
        assert found[i][0].tolist() == np.lexsort((np.arange(len(x)), -scores[i]))[:5].tolist()


def test_search_matches_sql_on_ties_and_bad_vectors(spark):
    nan = float("nan")
    rows = [(i, [float(i % 7) / 3, -0.5, 0.25 * (i % 3)]) for i in range(120)] + [(100, [9.0, 9.0, 9.0])]
    rows += [(200, None), (250, [1.0, None, 2.0]), (300, [nan, 1.0, 1.0]), (350, [float("inf"), 0.0, 0.0]), (None, [2.0, -0.5, 0.5]), (400, [0.5]), (450, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    kept = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wanted = []
    for q, v in {(i, tuple(v)) for i, v in kept if i is not None and i % 50 == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i is None, i or 0, i) for i, w in kept if i != q))
        wanted += [(q, k + 1, s[3], -s[0]) for k, s in enumerate(scored[:5])]
    for shard in (16, 4096):
        got = topk_search.top_k(df, shard_rows=shard).collect()
        assert sorted((r["query_id"], r["rank"], r["score"], str(r["vec_id"])) for r in got) == sorted((q, k, s, str(i)) for q, k, i, s in wanted)
    assert topk_search.top_k(df.where("vec_id < 0")).count() == 0
    huge = spark.createDataFrame([(0, [3e18]), (1, [3e18]), (2, [-1.0])], "vec_id bigint, embedding array<double>")
    assert [(r["vec_id"], r["score"] > 0) for r in topk_search.top_k(huge).collect()] == [(1, True), (2, False)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


def test_mixing_odd_documents(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_documents.collect()]
    got = mixing.plan(odd_documents).collect()
    key = lambda size, source_size, target, taken: (size, source_size, round(target, 6), taken)
    assert sorted(key(r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == sorted(key(*x) for x in plain.mix(rows))
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    mixed = mixing.mix(odd_documents)
    assert mixed.columns == odd_documents.columns
    assert mixed.agg(F.sum(F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")))).first()[0] > 0
    assert mixed.count() == sum(r["repeats"] for r in got)
    assert mixing.plan(no_documents).count() == 0 and mixing.mix(no_documents).count() == 0


def test_rows_of_one_id_and_text_keep_their_sources_repeats(spark):
    """Two sources share ids and texts; the mix of any order of the rows takes from each what the plan says."""
    rows = [(i, f"w{i} a b c d", s, k) for i in range(200) for k, s in enumerate(("s1", "s2"))]
    schema = "doc_id bigint, text string, source string, nr int"
    wanted = None
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: (r[2], -r[0]))):
        df = spark.createDataFrame(order, schema).repartition(3)
        took = {r["source"]: r["t"] for r in mixing.plan(df, share=0.5).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
        got = sorted(tuple(r) for r in mixing.mix(df, share=0.5).collect())
        assert {s: 5 * sum(g[2] == s for g in got) for s in took} == took
        wanted = wanted or got
        assert got == wanted


def test_one_source_takes_its_cap(spark):
    df = spark.createDataFrame([(i, "a b", "s") for i in range(9)], "doc_id bigint, text string, source string")
    got = mixing.plan(df, share=5.0).collect()
    assert {(r["target"], r["taken"]) for r in got} == {(36.0, 4)}


def test_token_files(spark, sf_dir, documents, tokenizer):
    got = {r["doc_id"]: r for r in queries.op8_token_files(spark, sf_dir).collect()}
    start = 0
    for doc_id, text in documents:
        ids = plain.encode(tokenizer, text)
        assert tuple(got[doc_id])[1:] == (start, len(ids), plain.crc(ids))
        start += len(ids)


def test_token_files_of_odd_documents(spark, odd_documents, no_documents, tokenizer_file, tokenizer, tmp_path):
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(odd_documents, path, tokenizer_file, partitions=3, segment_tokens=50)
    rows = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r["start"])
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in odd_documents.collect()), key=lambda x: x[:2])
    assert [r["doc_id"] for r in rows] == [i if known else None for known, i, _ in texts]
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    assert sorted(r["ids_crc32"] for r in rows) == sorted(plain.crc(plain.encode(tokenizer, t)) for _, _, t in texts)
    ids = plain.encode(tokenizer, next(t for _, i, t in texts if i == 7))
    wanted = spark.createDataFrame([(7, p) for p in (0, 5, len(ids) - 1, len(ids), -1)], "doc_id bigint, place bigint")
    assert {r["place"]: r["token"] for r in token_files.read_tokens(spark, path, wanted).collect()} == {p: ids[p] for p in (0, 5, len(ids) - 1)}
    assert token_files.token_files(no_documents, tokenizer_file).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=1500), st.sampled_from([4, 8]))
def test_segment_round_trip(ids, bits):
    segment = token_files.Segment(token_files.encode_segment(np.array(ids, dtype=np.uint32), bits))
    assert segment.scan(0, len(ids)).tolist() == ids
    places = np.random.default_rng(1).integers(0, len(ids), 40)
    assert segment.get(places).tolist() == [ids[p] for p in places]
    a, b = sorted(places[:2].tolist())
    assert segment.scan(a, b).tolist() == ids[a:b]


def test_line_dedup_odd_documents(spark, odd_documents, no_documents):
    rows = odd_documents.dropDuplicates(["doc_id", "text"]).select("doc_id", "text").collect()
    order = sorted(((r["doc_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    wanted = {(i, t): left for (i, t), left in zip(order, plain.dedup_lines(order))}
    got = line_dedup.dedup_lines(odd_documents)
    assert got.count() == odd_documents.count() and set(got.columns) >= set(odd_documents.columns)
    both = got.select("doc_id", F.col("text").alias("left"), "n_lines", "n_deleted").collect()
    assert sorted(map(str, {(r["doc_id"], r["left"]) for r in both})) == sorted(map(str, {(i, left) for (i, _), left in wanted.items()}))
    assert line_dedup.dedup_lines(no_documents).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a b c", "d e", "f g h i", "", "j", "k l m"]), max_size=7), min_size=1, max_size=5))
def test_line_dedup_on_any_lines(spark, docs):
    rows = [(i, "\n".join(x)) for i, x in enumerate(docs)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=6).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == plain.dedup_lines(rows, 6)


def test_near_duplicates_odd_documents(spark, odd_documents, no_documents):
    got = ngram_join.near_duplicates(odd_documents)
    assert got.count() == odd_documents.count()
    rows = [(r["doc_id"], r["text"], r["class_id"], r["n_links"], r["is_first"]) for r in got.collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    wanted = plain.near_duplicates([r[:2] for r in order])
    assert [(r[2], r[3]) for r in order] == wanted
    assert sum(r[4] for r in rows) == len(rows) - 4  # one class of five rows
    assert ngram_join.near_duplicates(no_documents).count() == 0


def test_near_duplicates_in_blocks(spark):
    """A large group over many blocks: every link is found, and none of the others' texts."""
    draw = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(90):
        words = list(base)
        for p in draw.integers(0, 200, 2 if i % 3 else 1):
            words[p] = f"x{draw.integers(1000)}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, " ".join(f"q{i}_{j}" for j in range(50))) for i in range(20)] + [(200 + i, docs[0][1]) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = ngram_join.near_duplicates(df, block_texts=16).orderBy("doc_id").collect()
    assert [(r["class_id"], r["n_links"]) for r in got] == plain.near_duplicates(docs)


def test_band_count_reaches_its_recall():
    bands = ngram_join.band_count(0.8, 0.9999)
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** bands >= 0.9999


def test_near_duplicates_of_a_hot_group_and_of_null_texts(spark):
    """A third of all rows is one text, a third has none."""
    docs = [(i, "one two three four five six") for i in range(60)] + [(100 + i, None) for i in range(60)] + [(200 + i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(60)]
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r["class_id"], r["n_links"], r["is_first"]) for r in got] == [(0, 59, i == 0) for i in range(60)] + [(i, 0, True) for i in range(100, 160)] + [(i, 0, True) for i in range(200, 260)]


def test_spread_join_is_a_join(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 99, i) for i in range(200)] + [(None, -1)], "k int, i int")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("most")).where("k IS NULL OR k < 99 AND k > 1 OR k = 99")
    for parts in (1, 4, 1024):
        got = common.spread_join(rows, keyed, ["k"], parts=parts)
        assert sorted(map(tuple, got.select("k", "i", "most").collect())) == sorted(map(tuple, rows.join(keyed, "k").select("k", "i", "most").collect()))
        semi = common.spread_join(rows, keyed, ["k"], "left_semi", parts=parts)
        assert sorted(map(tuple, semi.collect())) == sorted(map(tuple, rows.join(keyed, "k", "left_semi").collect()))


def test_a_pipeline_stage_deletes_no_other_result(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = queries.op2_best_fit_packing(spark, sf_dir)
    count = packed.count()
    first = corpus_pipeline.STAGES[1][1](spark, docs, sf_dir)
    left = first.count()
    corpus_pipeline.STAGES[1][1](spark, docs, sf_dir).count()
    assert (packed.count(), first.count()) == (count, left)
    corpus_pipeline.run(spark, sf_dir).count()
    assert packed.count() == count
    # two corpora with their stages interleaved, in any order
    other = docs.where("doc_id < 50")
    near, lines = corpus_pipeline.STAGES[2][1](spark, other, sf_dir), corpus_pipeline.STAGES[1][1](spark, other, sf_dir)
    mixed = corpus_pipeline.STAGES[3][1](spark, first, sf_dir)
    counts = (near.count(), lines.count(), mixed.count())
    corpus_pipeline.STAGES[4][1](spark, lines, sf_dir).count()
    corpus_pipeline.STAGES[2][1](spark, docs, sf_dir).count()
    assert (first.count(), near.count(), lines.count(), mixed.count()) == (left, *counts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100}


def test_pipeline(spark, sf_dir, tokenizer, documents):
    """run() against the plain versions, stage by stage, quality verdicts taken from its operator."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    verdicts = {r["doc_id"]: r["kept"] for r in queries.op7_quality_rules(spark, sf_dir).collect()}
    kept = [(i, t) for i, t in documents if verdicts[i]]
    left = [(i, t) for (i, was), t in zip(kept, plain.dedup_lines(kept)) if t or not was]
    classes = plain.near_duplicates(left)
    left = [d for d, (c, _) in zip(left, classes) if d[0] == c]
    taken = plain.mix([(i, t, source[i]) for i, t in left])
    ids = [plain.encode(tokenizer, t) for (_, t), m in zip(left, taken) for _ in range(m[3] // m[0] if m[0] else 0)]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing(rows, ids, 4096)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]


def test_pipeline_stages_keep_the_columns(spark, sf_dir, odd_documents):
    import corpus_pipeline

    docs = odd_documents.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, docs.where("doc_id < 0"), sf_dir).count() == 0, name


def test_pipeline_drops_copies_of_which_blank_lines_are_left(spark, sf_dir):
    import corpus_pipeline

    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, line), (2, "\n\n" + line), (3, line + "\n\n \n"), (4, "\n\n"), (5, line + "\n\nrest")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_lines(spark, docs, sf_dir).collect()) == [1, 4, 5]
