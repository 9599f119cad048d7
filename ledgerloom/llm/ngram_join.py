"""Similarity join of whole texts on word n-gram sets: MinHash banding, then exact verification.

Texts with equal n-gram sets are one class representative with a number of
copies. Bands of a representative's MinHash signature are dealt by their hash;
of buckets with the same members one is kept. A bucket's texts are compared on
their full n-gram sets inside tasks, a large bucket's in blocks of bounded size,
and each two texts only in the first band that they share. Counts and spanning
links leave a task, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bytehash import ALNUM, LOWER, MULTIPLIER, Texts, mix, slices, window_hashes
from ledgerloom.llm.common import col, cut, source_columns, spread_join, whole_row
from ledgerloom.llm.components import components

ROWS = 6


def band_count(threshold: float, target_recall: float, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows so that a pair at the threshold shares one with the target probability."""
    return math.ceil(math.log(1 - target_recall) / math.log(1 - threshold**rows))


def ngram_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """For each text its set of hashed word n-grams, sorted.

    A-Z are lower-cased; words are runs of digits, letters a-z and non-ASCII
    characters. A text of fewer than n words has one gram of all its words; a
    null text or one without words has an empty set.
    """
    batch = Texts(texts)
    starts, stops, at = batch.runs(ALNUM)
    words = batch.hashes(starts, stops, LOWER)
    grams = window_hashes(words, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                whole = mix(whole * MULTIPLIER + words[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def band_hashes(sets: list[np.ndarray], bands: int, rows: int = ROWS, seed: int = 7) -> np.ndarray:
    """One hash per band (columns) of each non-empty set's MinHash signature (rows)."""
    draw = np.random.default_rng(seed)
    factors = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    start = 0
    while start < len(sets):  # runs that stay in the cache
        stop, held = start + 1, len(sets[start])
        while stop < len(sets) and held + len(sets[stop]) <= 16_384:
            held += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[start:stop])
        first = np.cumsum([0] + [len(s) for s in sets[start : stop - 1]])
        buffer = np.empty_like(flat)
        for band in range(bands):
            key = np.full(stop - start, band + 1, dtype=np.uint64)
            for row in range(rows):
                np.multiply(flat, factors[band * rows + row], out=buffer)
                key = mix(key * MULTIPLIER + np.minimum.reduceat(buffer, first))
            out[start:stop, band] = key
        start = stop
    return out


def _sketch_udf(bands: int, n: int):
    @F.arrow_udf("struct<grams:long,digest:binary,bands:array<long>>")
    def sketch(texts: pa.Array) -> pa.Array:
        import xxhash

        grams, digests, keys, sizes = [], [], [], []
        for run in slices(texts):
            sets = ngram_sets(run, n)
            grams += [len(s) for s in sets]
            digests += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sizes += [bands if len(s) else 0 for s in sets]
            keys.append(band_hashes([s for s in sets if len(s)], bands).view(np.int64).ravel())
        flat = np.concatenate([np.zeros(0, dtype=np.int64), *keys])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(grams, pa.int64()), pa.array(digests, pa.binary()), lists], names=["grams", "digest", "bands"])

    return sketch


def _verify(reps: np.ndarray, copies: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, band: int, cross: bool, threshold: float):
    """For each text of a block its linked copies and the smallest text its links reach here.

    Two texts that share a band before ``band`` are left to that one. In a
    block of two sides only texts of different sides are compared.
    """
    sizes = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    marked = np.zeros(len(names), dtype=np.int32)
    links, parent = np.zeros(len(reps), dtype=np.int64), list(range(len(reps)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(len(reps)):
        if cross and sides[i]:
            continue
        others = np.flatnonzero(sides) if cross else np.arange(i + 1, len(reps))
        others = others[(sizes[others] >= threshold * sizes[i] - 1e-9) & (sizes[others] * threshold <= sizes[i] + 1e-9)]
        if len(others):
            others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]
        if not len(others):
            continue
        mine = flat[first[i] : first[i] + sizes[i]]
        marked[mine] = 1
        held = sizes[others]
        opens = np.cumsum(held) - held
        common = np.add.reduceat(marked[flat[np.repeat(first[others] - opens, held) + np.arange(held.sum())]], opens)
        marked[mine] = 0
        for j in others[common >= threshold * (sizes[i] + sizes[others] - common) - 1e-9].tolist():
            links[i] += copies[j]
            links[j] += copies[i]
            x, y = top(i), top(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return links, [reps[top(i)] for i in range(len(reps))]


def near_duplicates(
    docs: DataFrame,
    n: int = 5,
    threshold: float = 0.8,
    target_recall: float = 0.9999,
    block_texts: int = 1024,
    block_grams: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows with ``class_id`` (smallest id of the class), ``n_links`` and ``is_first``.

    Two rows are linked if the Jaccard similarity of their word n-gram sets is
    at least ``threshold``; a class is what links connect, ``n_links`` counts
    the rows linked to a row (copies included), ``is_first`` is true for one
    row of each class: the smallest id, null ids last. Every link is found with probability
    ``target_recall`` or more, all reported ones are exact up to 64-bit gram
    hashes. Rows without words (null, empty) link to nothing. Texts of any
    length count whole. Repeated rows and ids are rows of their own. An empty table gives an empty result;
    input columns named like the three added ones are replaced.
    ``block_texts`` and ``block_grams`` bound what a verification task holds
    of each side.
    """
    bands = band_count(threshold, target_recall)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"), whole_row(docs).alias("src")
    )
    rows = cut(rows.withColumn("sketch", _sketch_udf(bands, n)("text")).drop("text"), "sketched")
    keyed = rows.where("sketch.grams > 0").select("row", "id", "sketch.grams", "sketch.digest", "sketch.bands")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    alike = keyed.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("copies"), first)
    reps = cut(alike.join(keyed.select("row", "grams", "bands"), "row").withColumnRenamed("row", "rep"), "representatives")

    keys = reps.select("rep", "grams", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("grams").alias("all_grams"), F.min("band").alias("band"), F.min("rep").alias("least"), F.bit_xor(F.xxhash64("rep")).alias("members")
    )
    # buckets of the same members differ in their bands only: the first one stands for them
    one = F.min(F.struct("band", "key", "all_grams")).alias("one")
    buckets = buckets.where("n > 1").groupBy("n", "least", "members").agg(one).select("n", "one.*")
    chunks = F.greatest(F.ceil(F.col("n") / block_texts), F.ceil(F.col("all_grams") / block_grams))
    buckets = cut(buckets.withColumn("chunks", chunks), "buckets")
    small = F.col("chunks") == 1
    texts, held = buckets.where(small).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("all_grams"), F.lit(0))).first()
    bins = max(1, math.ceil(2 * texts / block_texts), math.ceil(2 * held / block_grams))  # small buckets share tasks
    dealt = spread_join(keys.select("rep", "key"), buckets.select("key", "band", "chunks", "n"), ["key"])
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    dealt = cut(dealt.select("rep", "key", "band", "chunks", "chunk"), "candidates")

    # one text a candidate, then as often as its buckets' blocks need it
    text = F.col("src").getField(text_col).cast("string").alias("text")
    wanted = dealt.select("rep").distinct().join(reps.select("rep", "copies", "bands"), "rep")
    wanted = cut(wanted.join(rows.select(F.col("row").alias("rep"), text), "rep"), "texts")
    dealt = dealt.join(wanted, "rep").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select(
        F.when(small, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.col("key")).alias("bin"), small.alias("small"),
        F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") > F.col("other")).alias("second"),
        "key", "band", "rep", "copies", "bands", "text",
    )

    def verify(block: pa.Table) -> pa.Table:
        block = block.combine_chunks().sort_by([("key", "ascending"), ("rep", "ascending")])
        cross = bool(len(block)) and block["i"][0] != block["j"][0]
        buckets = block["key"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        nodes, all_links, reached = [], [], []
        for a, b in zip(edges[:-1], edges[1:]):
            part = block.slice(a, b - a).combine_chunks()
            sets: list[np.ndarray] = []
            for run in slices(part["text"].combine_chunks()):
                sets += ngram_sets(run, n)
            signature = part["bands"].combine_chunks().flatten().to_numpy().reshape(b - a, bands)
            reps_here = part["rep"].to_numpy()
            sides = part["second"].combine_chunks().to_numpy(zero_copy_only=False)
            links, tops = _verify(reps_here, part["copies"].to_numpy(), sides, sets, signature, part["band"][0].as_py(), cross, threshold)
            nodes += reps_here.tolist()
            all_links += links.tolist()
            reached += [int(t) for t in tops]
        return pa.table({"node": pa.array(nodes, pa.int64()), "links": pa.array(all_links, pa.int64()), "reached": pa.array(reached, pa.int64())})

    found = cut(dealt.groupBy("small", "bin", "i", "j").applyInArrow(verify, "node long, links long, reached long").where("links > 0"), "links")
    classes = components(found, "node", "reached")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = reps.select("rep", "digest", "copies", "first").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.join(links.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    info = cut(info, "classes")
    heads = info.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("n"))
    info = spread_join(info, heads, ["root"]).select(F.col("digest").alias("set"), "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("copies").alias("n"))
    rows = rows.withColumn("set", F.col("sketch.digest"))
    wordless = rows.where("set IS NULL").select("*", F.lit(None).cast(info.schema["head"].dataType).alias("head"), F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("n"))
    out = spread_join(rows, cut(info, "sets"), ["set"]).unionByName(wordless)
    added = {
        "class_id": F.coalesce(F.col("head.id"), F.when(F.col("head").isNull(), F.col("id"))),
        "n_links": F.col("links").cast("long"),
        "is_first": F.coalesce(F.col("head.row") == F.col("row"), F.lit(True)),
    }
    kept = [c for c, name in zip(source_columns(docs), docs.columns) if name.lower() not in added]
    return out.select(*kept, *[v.alias(k) for k, v in added.items()])
