"""URL filters: rules on host suffixes and path prefixes, found by short hashes and confirmed by digests.

Every URL is expanded into the expressions (host suffix + path prefix) whose
number of labels and path length occur in the rules. Expressions are joined
with the rules on the first 32 bits of their SHA-256; the full digest confirms
a hit, and the longest rule decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import col, cut, source_columns, whole_row

RULES = "host string, path string, verdict string, rank int"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", broadcast_rules: int = 100_000, salts: int = 16) -> DataFrame:
    """All rows with ``host``, ``path`` and ``hits``: for each rank of rules the deciding one or null.

    ``rules`` has host, path, verdict and rank; a rule fits its host and all
    subdomains where the URL's path starts with the rule's. In each rank the
    longest fitting rule wins (host and path together; of equal ones ``block``).
    ``hits`` is an array by rank of ``length, verdict, rule``. Null URLs and those without ``://`` have
    empty host and path and fit no rule; URLs of any length are judged whole. Repeated rows are judged one by one;
    rules that repeat change nothing; empty tables are fine; input columns named
    like the added ones are replaced. Up to ``broadcast_rules`` rules are
    broadcast; more are dealt by hash, the URLs' side salted and without the rows' own columns.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND host <> ''").select("host", "path", "verdict", "rank")
    expression = F.concat("host", "path")
    shape = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"), "rank")
    # small numbers that occur together, bounded by the longest host and path
    shapes = {r["labels"]: sorted(r["lengths"]) for r in shape.groupBy("labels").agg(F.collect_set("length").alias("lengths")).collect()}
    count, last = shape.agg(F.count("*"), F.coalesce(F.max("rank"), F.lit(0))).first()
    digests = rules.select(F.sha2(expression, 256).alias("digest"), F.length(expression).alias("length"), (F.col("verdict") == "block").alias("blocks"), "verdict", expression.alias("rule"), "rank")
    digests = digests.withColumn("short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")).distinct()

    url = col(url_col).cast("string")
    rows = urls.select(F.monotonically_increasing_id().alias("row"), whole_row(urls).alias("src"), url_host(url).alias("host"), url_path(url).alias("path"))
    parts = F.split("host", r"\.")

    def expressions(k: int) -> Column:
        """The suffix of ``k`` labels with each path prefix that a rule of so many labels has."""
        fitting = F.filter(F.array(*map(F.lit, shapes[k])), lambda n: n <= F.length("path"))
        suffix = F.array_join(F.slice(parts, -k, k), ".")
        return F.when(F.size(parts) >= k, F.transform(fitting, lambda n: F.concat(suffix, F.substring(F.col("path"), F.lit(1), n))))

    pairs = F.flatten(F.array_compact(F.array(*map(expressions, sorted(shapes))))) if shapes else F.array().cast("array<string>")
    confirmed = F.col("hash") == F.col("digest")
    best = lambda r: F.max(F.when(confirmed & (F.col("rank") == r), F.struct("length", "blocks", "verdict", "rule"))).alias(f"hit{r}")
    hits = [best(r) for r in range(last + 1)]
    hashed = lambda opened: opened.withColumn("hash", F.sha2("expression", 256)).withColumn("key", F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"))
    if count <= broadcast_rules:
        # rules come to the rows: what a row opens into meets again in its own task, before anything is shuffled
        opened = hashed(rows.select("row", "src", "host", "path", F.explode_outer(pairs).alias("expression")))
        met = opened.join(F.broadcast(digests), F.col("key") == F.col("short"), "left")
        judged = met.groupBy("row").agg(F.first("src").alias("src"), F.first("host").alias("host"), F.first("path").alias("path"), *hits)
    else:
        # rows are written with their numbers, which alone go to the rules and come back
        rows = cut(rows, "urls")
        opened = hashed(rows.select("row", F.explode(pairs).alias("expression"))).withColumn("grain", (F.col("row") % salts).cast("int"))
        spread = digests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = opened.select("row", "hash", "key", "grain").join(spread, (F.col("key") == F.col("short")) & (F.col("grain") == F.col("salt")))
        judged = rows.join(met.where(confirmed).groupBy("row").agg(*hits), "row", "left")
    added = {"host": F.col("host"), "path": F.col("path"), "hits": F.array(*[F.col(f"hit{r}") for r in range(last + 1)])}
    names = [c for c in urls.columns if c.lower() not in added]
    return judged.select(*[c for c, name in zip(source_columns(urls), urls.columns) if name in names], *[v.alias(k) for k, v in added.items()])
