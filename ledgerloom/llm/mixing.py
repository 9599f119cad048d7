"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets its share of a budget by weight, but no more than
``max_epochs`` times its size; what is cut off is shared again by weight among
the others until no share is above its cap. Whole repetitions are taken of
every document; for the fraction that is left, documents are taken in seeded
random order until they come nearest to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import col, cut, partition_starts, source_columns, spread_join, text_of, whole_row, words_in

BUCKETS = 4096


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources numbered from 0 by code point, null last, without sorting them in one task."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = cut(ranged, "sources")
    bases = partition_starts(ranged.groupBy("part").agg(F.count("*").alias("n")), "part", "n")
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("within", within).join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + F.col("within")).drop("part", "base", "within")


def water_level(sources: DataFrame, share: float, max_epochs: float) -> tuple[float, float]:
    """The level by which ``weight`` is multiplied, and the budget; sums are all the driver sees.

    Each round clamps the sources whose share is above their cap and shares
    the rest of the budget among the others; it ends when no more are clamped.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum(F.col("weight").cast("double"))).first()
    budget = share * (total or 0)
    level, cap = (budget / weights if weights else 0.0), F.col("source_size") * F.lit(max_epochs)
    while True:
        clamped = cap < F.col("weight") * F.lit(level)
        held, free = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight").cast("double")))).first()
        if not free:
            return (float("inf") if held is not None else 0.0), budget
        after = max(level, (budget - (held or 0.0)) / free)
        if after <= level * (1 + 1e-15):
            return level, budget
        level = after


def _taken(docs: DataFrame, carried: list[Column], weights, share, max_epochs, seed, id_col, text_col, source_col) -> DataFrame:
    """The rows of :func:`plan` with the ``carried`` columns beside them."""
    text, source = text_of(text_col), col(source_col).cast("string")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(col(id_col).cast("string"), F.lit("")), F.md5(text)))
    rows = docs.select(
        col(id_col).cast("long").alias("id"), source.alias("source"), words_in(text).alias("size"), order.alias("draw"),
        F.xxhash64(*[col(c) for c, kind in docs.dtypes if "map<" not in kind]).alias("tie"), *carried,
    )
    rows = rows.withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"))
    # null is a source: its key is one that no name has
    rows = cut(rows.withColumn("key", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))), "sizes")

    # sums of hash buckets: a hot source is 4096 rows here, whatever it holds
    sums = cut(rows.groupBy("source", "key", "bucket").agg(F.sum("size").alias("held"), F.count("*").alias("n")), "buckets")
    sources = _ranked(sums.groupBy("source", "key").agg(F.sum("held").alias("source_size"), F.sum("n").alias("n")))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.get(turn, F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")))
    level, _ = water_level(sources, share, max_epochs)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    target = F.least(cap, F.col("weight") * F.lit(level)) if level != float("inf") else cap
    sources = sources.select("key", "source_size", target.alias("target"), "n")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("whole", whole.cast("long"))
    sources = sources.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))

    # the bucket in which a source's fraction runs out
    before = F.coalesce(F.sum("held").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("key", "bucket", "held", before.alias("before")).join(sources.select("key", "extra"), "key")
    ends = (F.col("before") < F.col("extra")) & (F.col("before") + F.col("held") > F.col("extra"))
    full = F.max(F.when((F.col("before") < F.col("extra")) & (F.col("before") + F.col("held") <= F.col("extra")), F.col("bucket"))).alias("full")
    edge = F.max(F.when(ends, F.struct("bucket", "before"))).alias("edge")
    sources = cut(sources.join(sums.groupBy("key").agg(full, edge), "key"), "targets")

    dealt = spread_join(rows, sources, ["key"])
    inside_edge = F.coalesce(F.col("bucket") == F.col("edge.bucket"), F.lit(False))
    by_bucket = dealt.where(~inside_edge).withColumn("more", F.coalesce((F.col("bucket") <= F.col("full")).cast("int"), F.lit(0)))
    inside = Window.partitionBy("key").orderBy("draw", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    near = dealt.where(inside_edge).withColumn("upto", F.col("edge.before") + F.sum("size").over(inside))
    # the document that crosses the target is taken if that comes nearer
    near = near.withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("extra")).cast("int")).drop("upto")
    both = by_bucket.unionByName(near).withColumn("repeats", F.col("whole") + F.col("more"))
    return both.withColumn("taken", F.col("repeats") * F.col("size"))


def plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, repeats, taken``.

    Sources in code point order (null last) take ``weights`` in turn. ``size``
    counts words of the whole text (null text: 0); ``repeats`` is how often the
    mix takes the document and ``taken`` its words, repeats counted. The order
    of the documents of a source is the md5 of seed, id and text, then a hash
    of the whole row, so reruns agree in any order of the input; rows that are
    equal in every column may stand for each other. Documents of size 0
    follow the order like all others, and are left out where their source has
    no words. An empty table gives an empty result. The 4,096th part of a
    source in which its fraction ends is sorted in one task, and spills there.
    """
    rows = _taken(docs, [], weights, share, max_epochs, seed, id_col, text_col, source_col)
    return rows.select("id", "source", "size", "source_size", "target", "repeats", "taken")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents' rows, each as often as :func:`plan` takes it; the columns stay.

    Each row keeps its own repeats, whatever other rows share its id and text.
    Nulls, ties, repeated rows and empty tables are as in :func:`plan`.
    """
    rows = _taken(docs, [whole_row(docs).alias("src")], weights, share, max_epochs, seed, id_col, text_col, source_col).where("repeats > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(*source_columns(docs))
