"""License scans by ordered signature rules, in DataFrame operations only.

Texts become lower-cased words joined by single spaces. A text is
tried with the rules whose root and keyword it holds. Each match is
an interval of words; one that lies in another of at least its priority is
suppressed (of equal ones, the rule that comes first stays).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import license_rules
from ledgerloom.llm.common import col, text_of

_SCHEMA = "array<struct<rule:int,label:string,priority:int,score:double,base:boolean,root:string,keyword:string,pattern:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands in no text of words.
MARK = "\x01"
FOUND = "array<struct<label:string,start:long,length:long,priority:int,score:double,base:boolean>>"


def _spaces(text):
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan_licenses(docs: DataFrame, rules: list[dict] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, base, found`` of every row.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
    characters. ``base`` has the start and label of every place of a base
    rule, ``found`` the detections that are not suppressed; both are arrays
    ordered by place. Null text counts as empty; texts of any length and with
    any number of matches are scanned whole. Rows are scanned one by one:
    null and repeated ids stay apart; an empty table gives an empty result;
    other columns are not read.
    """
    rules = rules or license_rules.rules()
    words = F.regexp_replace(F.translate(text_of(text_col), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"), F.concat(F.lit(" "), F.btrim(words), F.lit(" ")).alias("words"))
    # every operand of a tag's expression but the first stands after a marked operator
    marked = F.regexp_replace("words", license_rules.EXPRESSION, f"$1$2 {license_rules.JOINER}")
    rows = rows.withColumn("words", F.when(F.contains("words", F.lit("e identifier ")), marked).otherwise(F.col("words")))
    rows = rows.withColumn("n_words", F.when(F.length("words") == 2, F.lit(0)).otherwise(_spaces(F.col("words")) - 1).cast("long"))
    tried = []
    for root in sorted({r["root"] for r in rules}):
        table = F.from_json(F.lit(json.dumps([r for r in rules if r["root"] == root])), _SCHEMA)
        tried.append(F.when(F.contains(F.col("words"), F.lit(root)), F.filter(table, lambda r: F.contains(F.col("words"), r["keyword"]))).otherwise(F.array().cast(_SCHEMA)))
    # one pass marks a rule's matches; of the pieces between marks, by their spaces, every second one is a match
    hits = F.transform(
        F.concat(*tried),
        lambda r: F.struct(
            r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), r["score"].alias("score"), r["base"].alias("base"),
            F.transform(F.split(F.regexp_replace(F.col("words"), r["pattern"], F.lit(f"{MARK}$0{MARK}")), MARK, -1), _spaces).alias("pieces"),
        ),
    )
    hits = F.filter(hits, lambda h: F.size(h["pieces"]) > 1)
    opened = rows.select("row", "id", "n_words", F.explode_outer(hits).alias("hit"))
    opened = opened.select("row", "id", "n_words", "hit.rule", "hit.label", "hit.priority", "hit.score", "hit.base", F.col("hit.pieces").alias("pieces"))
    # each number leaves its array once, whatever the number of matches
    opened = opened.select("row", "id", "n_words", "rule", "label", "priority", "score", "base", F.posexplode_outer("pieces").alias("nth", "inner")).repartition("row")

    of_rule = Window.partitionBy("row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = opened.withColumn("start", (F.sum("inner").over(of_rule) - 1).cast("long")).where("nth IS NULL OR nth % 2 = 1")
    placed = placed.withColumn("length", (F.col("inner") + 1).cast("long")).withColumn("end", F.col("start") + F.col("length"))
    before = Window.partitionBy("row").orderBy("start", F.desc("length"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for level in sorted({r["priority"] for r in rules}):
        reach = F.max(F.when(F.col("priority") >= level, F.col("end"))).over(before)
        covered = covered | ((F.col("priority") == level) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    placed = placed.withColumn("kept", F.col("rule").isNotNull() & ~covered)
    detection = F.struct("start", "length", "label", "priority", "score", "base")
    found = placed.groupBy("row").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.when(F.col("base"), F.struct("start", "label")))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("kept"), detection))).alias("found"),
    )
    return found.drop("row")
