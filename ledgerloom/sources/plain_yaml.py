"""A reader of the plain subset of YAML that needs no YAML library.

The subset: a list of flat maps at the root or under keys of the root, scalars
under other keys of the root, plain and quoted scalars on one line, comments.
A file is read line by line as a state machine whose state - the root key, the
item, the column at which the item's keys stand - is carried forward by
windows over the file's lines. A line that the machine has no rule for is
refused with a reason, and so is its whole file: no guess becomes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEY = r"[A-Za-z_][A-Za-z0-9_.-]*"
_SINGLE = r"^'((?:[^']|'')*)'\s*(?:#.*)?$"
_DOUBLE = r'^"((?:[^"\\]|\\["\\/nt])*)"\s*(?:#.*)?$'
#: A plain scalar begins with no sign of another form, and holds no key and no comment.
_PLAIN = r"^(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=\S))(?:(?!:(?:\s|$))(?!\s#).)*$"


def _scalar(raw: Column) -> Column:
    """The text of a scalar (nothing is empty), or null for one that is no scalar of the subset."""
    bare = F.regexp_replace(raw, r"(?:^|\s+)#.*$", "")
    # escapes are told apart before backslashes go
    parts = F.regexp_extract_all(F.regexp_extract(raw, _DOUBLE, 1), F.lit(r"(?s)\\.|[^\\]"), F.lit(0))
    double = F.array_join(F.transform(parts, lambda c: F.when(c == "\\n", "\n").when(c == "\\t", "\t").when(F.startswith(c, F.lit("\\")), F.substring(c, 2, 1)).otherwise(c)), "")
    return (
        F.when(raw.rlike(_SINGLE), F.regexp_replace(F.regexp_extract(raw, _SINGLE, 1), "''", "'")).when(raw.rlike(_DOUBLE), double)
        .when(bare == "", F.lit("")).when(bare.rlike(_PLAIN), F.rtrim(bare))
    )


def lines(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, n, line, kind, root, key, value, item, refused``: every line that counts, with the state it meets.

    ``kind`` is root, item or field; ``refused`` says why no rule holds, else null.
    """
    rows = texts.select(F.col(path).alias("path"), F.posexplode(F.split(F.regexp_replace(F.col(text), r"\r", ""), "\n", -1)).alias("n", "line"))
    rows = rows.where(~F.col("line").rlike(r"^\s*(?:#|$)") & ~((F.col("n") == 0) & F.col("line").rlike(r"^---\s*$")))
    dash, key = F.regexp_extract("line", r"^( *- +)", 1), rf"^ *(?:- +)?({_KEY}):(?: +(.*))?$"
    keyed, listed = F.col("line").rlike(key), F.col("line").rlike(r"^ *-(?: |$)")
    indent = F.length(F.regexp_extract("line", "^( *)", 1))
    kind = F.when(listed, "item").when(indent == 0, "root").otherwise("field")
    rows = rows.select(
        "path", "n", "line", kind.alias("kind"), indent.alias("indent"), keyed.alias("keyed"), F.when(keyed, F.regexp_extract("line", key, 1)).alias("key"),
        F.when(keyed, F.coalesce(F.trim(F.regexp_extract("line", key, 2)), F.lit(""))).alias("raw"), F.when(listed, F.length(dash)).alias("keys_at"),
    )
    upto = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    # every window has this one order, so a file's lines are dealt and sorted once; what holds since the last line of the root is taken by its place there
    rows = rows.withColumn("root_no", F.count_if(F.col("kind") == "root").over(upto))
    at_root = F.last(F.when(F.col("kind") == "root", F.struct("key", "raw")), ignorenulls=True).over(upto)
    rows = rows.withColumns({"items": F.count_if(F.col("kind") == "item").over(upto), "top": at_root})
    before = F.coalesce(F.last(F.when(F.col("kind") == "root", F.col("items")), ignorenulls=True).over(upto), F.lit(0))
    rows = rows.withColumn("item", F.col("items") - before)
    first = F.last(F.when((F.col("kind") == "item") & (F.col("item") == 1), F.col("indent")), ignorenulls=True).over(upto)
    latest = F.last(F.when(F.col("kind") == "item", F.struct("keys_at", "keyed")), ignorenulls=True).over(upto)
    rows = rows.withColumns({"first": first, "latest": latest})
    within = lambda c: F.when(F.col("item") > 0, c)
    rows = rows.withColumns(
        {
            "root": F.col("top.key"), "open": F.col("top.raw"), "dash_at": within(F.col("first")),
            "column": within(F.col("latest.keys_at")), "named": within(F.col("latest.keyed")),
        }
    ).drop("items", "top", "first", "latest")
    value = _scalar(F.when(F.col("keyed"), F.col("raw")).otherwise(F.trim(F.regexp_replace("line", r"^ *- +", ""))))
    last_root = F.col("kind") == "root"
    opens = last_root & (F.regexp_replace("raw", r"^#.*$", "") == "")
    refused = (
        F.when(F.col("line").rlike(r"^ *\t"), "tab in the indentation").when((F.col("kind") != "item") & ~F.col("keyed"), "no key")
        .when(F.col("line").rlike(r"^ *-\s*$"), "bare dash").when(value.isNull(), "no plain value")
        .when((F.col("kind") == "item") & ~F.col("keyed") & (value == ""), "bare dash")
        .when((F.col("kind") == "item") & (F.regexp_replace(F.coalesce("open", F.lit("")), r"^#.*$", "") != ""), "item under a scalar")
        .when((F.col("kind") == "item") & (F.col("indent") != F.col("dash_at")), "indentation of the item")
        .when((F.col("kind") == "field") & (F.col("item") == 0), "nested map").when((F.col("kind") == "field") & ~F.col("named"), "key under a scalar")
        .when((F.col("kind") == "field") & (F.col("indent") != F.col("column")), "indentation of the key")
        .when((F.col("root_no") > 0) & (F.first("root_no").over(upto) == 0), "list and map at the root")
    )
    rows = rows.withColumns({"value": value, "refused": refused, "opens": opens})
    # a key without a value opens a list under the root; elsewhere something nested would follow, which the next line shows
    after = F.lead(F.struct("indent", "kind")).over(Window.partitionBy("path").orderBy("n"))
    deeper = (F.col("kind") != "root") & F.col("keyed") & (value == "") & (F.col("raw") == "") & (after["indent"] > F.coalesce(F.col("column"), F.lit(0)))
    return rows.withColumn("refused", F.coalesce("refused", F.when(F.coalesce(deeper, F.lit(False)), "nested value"))).select(
        "path", "n", "line", "kind", "root_no", "root", "key", "value", "item", "opens", "keyed", "refused"
    )


def refusals(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, n, line, refused``: the lines for which a file gives no rows."""
    return lines(texts, path, text).where("refused IS NOT NULL").select("path", "n", "line", "refused")


def list_items(texts: DataFrame, key: str, path: str = "path", text: str = "text") -> DataFrame:
    """``path, item, data`` of the maps listed at the root, or under ``key``; files with a refused line give none.

    Of a key that an item repeats the last value counts; items that are bare scalars are left out.
    """
    rows = lines(texts, path, text)
    rows = rows.withColumn("bad", F.max(F.col("refused").isNotNull()).over(Window.partitionBy("path"))).where("NOT bad")
    # a root key that stands twice counts as its last
    last = F.max(F.when(F.col("root") == key, F.col("root_no"))).over(Window.partitionBy("path"))
    rows = rows.where(F.col("keyed") & (F.col("kind") != "root")).withColumn("last", last)
    rows = rows.where((F.col("root_no") == 0) | (F.col("root_no") == F.col("last")))
    fields = rows.groupBy("path", "item", "key").agg(F.max_by("value", "n").alias("value"))
    return fields.groupBy("path", "item").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("data"))


def scalars(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, data``: the scalars under the keys of the root; files with a refused line give none."""
    rows = lines(texts, path, text)
    rows = rows.withColumn("bad", F.max(F.col("refused").isNotNull()).over(Window.partitionBy("path"))).where("NOT bad AND kind = 'root' AND NOT opens")
    return rows.groupBy("path", "key").agg(F.max_by("value", "n").alias("value")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("data"))


def read_plain_list(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """What ``documents.read_yaml_list`` reads, for files of the subset."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return list_items(texts, key).select(F.from_json(F.to_json("data"), schema).alias("r")).select("r.*")
