"""Line deduplication across documents by winnowing, in DataFrame operations only.

A window is the shortest run of consecutive non-blank lines, begun or ended at
a line, that holds ``min_words`` words. The place of its smallest line hash is
its fingerprint: a repeated run of ``min_words`` words holds a whole window, so
its copies share a fingerprint at the same line. Places are joined on their
fingerprints. Only from a place that another one shares is the match extended,
backward and forward over the hashes of its document's lines, to the bounds of
each window that it stands for; places whose lines agree both ways are copies,
and the first of them stays. From window to window the later ones' matches grow
to maximal runs, which are deleted. Repeats that begin or end inside a line
count only by their whole lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import col, cut, source_columns, spread_join, text_of, whole_row, words_in


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, k, text``; ``k`` hashes the text."""
    return docs.select(col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text")).select("doc", F.xxhash64("text").alias("k"), "text")


def _fingerprints(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per fingerprint place: ``doc, k, at, fp`` and the bounds of the windows it stands for.

    ``at``, ``first`` and ``last`` count non-blank lines, ``b`` and ``e`` all lines.
    """
    lines = _named(docs, id_col, text_col).select("doc", "k", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc", "k", "pos", F.xxhash64("line").alias("h"), words_in(F.col("line")).alias("w"))
    # rows that repeat a document's id and text count once
    lines = lines.where("w > 0").repartition("doc", "k").distinct()
    doc = Window.partitionBy("doc", "k")
    upto = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("d", F.sum("w").over(upto)).withColumn("i", F.count("*").over(upto).cast("int") - 1)
    lines = lines.withColumn("c", F.col("d") - F.col("w"))

    def window(over: Window) -> list[Column]:
        return [
            F.min("i").over(over).alias("first"), F.max("i").over(over).alias("last"), F.min("pos").over(over).alias("b"), F.max("pos").over(over).alias("e"),
            F.sum("w").over(over).alias("held"), F.min(F.struct("h", "i")).over(over).alias("least"),
        ]

    begun = lines.withColumn("begun", F.struct(*window(doc.orderBy("c").rangeBetween(0, min_words - 1))))
    both = begun.withColumn("ended", F.struct(*window(doc.orderBy("d").rangeBetween(1 - min_words, 0))))
    # a window that its first line begins and its last line ends is taken once
    again = F.col("ended.held") - F.col("w") < min_words
    found = both.select("doc", "k", F.inline(F.array_compact(F.array(
        F.when(F.col("begun.held") >= min_words, F.col("begun")), F.when((F.col("ended.held") >= min_words) & ~again, F.col("ended"))
    ))))
    found = found.select("doc", "k", F.col("least.i").alias("at"), F.col("least.h").alias("fp"), F.struct("first", "last", "b", "e").alias("window"))
    return found.groupBy("doc", "k", "at", "fp").agg(F.collect_list("window").alias("windows"))


def _extended(places: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, k, b, e, d1, d2``: each place followed backward and forward to the bounds of its windows."""
    filled = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = [F.transform(filled, lambda x: F.xxhash64(x)).alias("h"), F.transform(filled, lambda x: F.xxhash64(F.lit(1), x)).alias("g")]
    lines = _named(docs, id_col, text_col).select("doc", "k", *hashes).groupBy("doc", "k").agg(F.first("h").alias("h"), F.first("g").alias("g"))
    held = places.groupBy(F.col("doc").alias("of"), F.col("k").alias("key")).agg(F.collect_list(F.struct("at", "windows")).alias("places"))
    met = lines.join(held.hint("merge"), F.col("doc").eqNullSafe(F.col("of")) & (F.col("k") == F.col("key")))
    met = met.select("doc", "k", "h", "g", F.explode("places").alias("p")).select("doc", "k", "h", "g", "p.at", F.explode("p.windows").alias("w"))
    back, forth = F.col("at") - F.col("w.first") + 1, F.col("w.last") - F.col("at") + 1
    digest = lambda of: F.xxhash64(F.slice(of, F.col("w.first") + 1, back), F.slice(of, F.col("at") + 1, forth))
    return met.select("doc", "k", "w.b", "w.e", digest("h").alias("d1"), digest("g").alias("d2"))


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, k, b, e``: the maximal runs of lines (from 0) whose windows all stood earlier.

    Earlier: in a smaller id (null last), or further up. ``k`` hashes the text.
    """
    places = cut(_fingerprints(docs, min_words, id_col, text_col), "fingerprints")
    # a fingerprint at one place may still stand for two windows; those share it and differ
    shared = cut(places.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = cut(_extended(spread_join(places, shared, ["fp"], "left_semi"), docs, id_col, text_col), "extended")
    place = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "k", "b")
    first = cut(met.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "repeated")
    later = spread_join(met, first, ["d1", "d2"]).where(place != F.col("first")).select("doc", "k", "b", "e")
    doc = Window.partitionBy("doc", "k").orderBy("b", "e")
    reach = F.max("e").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("opens", F.coalesce(F.col("b") > reach, F.lit(True)).cast("int"))
    later = later.withColumn("run", F.sum("opens").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return later.groupBy("doc", "k", "run").agg(F.min("b").alias("b"), F.max("e").alias("e")).drop("run")


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with the text that is left, and ``n_lines``, ``n_deleted``, ``deleted_runs``.

    A line goes if it lies in a run of consecutive non-blank lines of at least
    ``min_words`` words (runs outside ``[\\x20\\x09-\\x0D]``) that stands
    earlier too; blank lines inside a run go with it. ``deleted_runs`` is an
    array of ``b, e`` (lines from 0, both included). Null text stays null, empty
    text stays empty; a text all of whose lines go is left empty. Texts of any
    length are read whole, as rows of lines. Rows that
    repeat a document's id and text get one result, as one document. Null ids
    come last. An empty table gives an empty result; input columns named like
    the three added ones are replaced.
    """
    runs = repeated_runs(docs, min_words, id_col, text_col)
    # a document's runs are fewer than its lines; written, so that both sides of the join are dealt anew and repeated rows can be split
    runs = cut(runs.groupBy("doc", "k").agg(F.sort_array(F.collect_list(F.struct("b", "e"))).alias("runs")), "runs")
    rows = docs.select(col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("key"), whole_row(docs).alias("src"))
    # one plan at every size: texts are dealt by document, never met by a table that grows with them
    rows = rows.join(runs.hint("merge"), F.col("id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("k")), "left")
    text = F.col("src").getField(text_col).cast("string")
    rows = rows.select("src", text.alias("text"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"), F.coalesce("runs", F.array().cast("array<struct<b:int,e:int>>")).alias("runs"))
    size, n = F.size("lines"), F.size("runs")
    # the kept stretches lie between the runs
    stretch = lambda i: F.slice(
        "lines",
        F.when(i == 0, F.lit(1)).otherwise(F.get("runs", i - 1)["e"] + 2),
        F.when(i == n, size).otherwise(F.get("runs", i)["b"]) - F.when(i == 0, F.lit(0)).otherwise(F.get("runs", i - 1)["e"] + 1),
    )
    kept = F.flatten(F.transform(F.sequence(F.lit(0), n), stretch))
    gone = F.aggregate("runs", F.lit(0), lambda s, r: s + r["e"] - r["b"] + 1)
    added = {"n_lines": size.cast("long"), "n_deleted": gone.cast("long"), "deleted_runs": F.col("runs")}
    left = F.when(n == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    names = [c for c in docs.columns if c.lower() not in added]
    return rows.select(*[c for c, name in zip(source_columns(docs, replaced={text_col: left}), docs.columns) if name in names], *[v.alias(k) for k, v in added.items()])
