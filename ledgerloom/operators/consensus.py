"""Consensus of the accepted reports of each product version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import buckets, dates

KEY = ("product_id", "update_version")


def sentiment_counts(evidence: DataFrame, keys: tuple[str, ...] = KEY, sentiment: str = "sentiment") -> DataFrame:
    """Reports of each sentiment; blank products go."""
    count = lambda s: F.count_if(F.lower(F.col(sentiment)) == s).alias(s)
    return evidence.groupBy(*keys).agg(F.count("*").alias("report_count"), *[count(s) for s in buckets.SENTIMENTS])


def verdicts(evidence: DataFrame, keys: tuple[str, ...] = KEY, sentiment: str = "sentiment") -> DataFrame:
    """Counts, label and strength tier of each version: one scan and one aggregation."""
    counts = sentiment_counts(evidence, keys, sentiment)
    total = F.col("report_count")
    return counts.withColumn("label", buckets.consensus_label(F.col("positive"), F.col("negative"), total)).withColumn("confidence", buckets.confidence(total))


def histogram(rows: DataFrame, keys: tuple[str, ...], value: str, arrival: str) -> DataFrame:
    """Counts of a column's values, with the rank by count, then first arrival."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(arrival).alias("first_seen"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first_seen")))


def top_themes(themes: DataFrame, keys: tuple[str, ...], theme: str, limit: int = 3) -> DataFrame:
    """The most frequent themes that say something, joined in order."""
    named = themes.where(~F.col(theme).isin("", "unspecified issue", "general workflow reports"))
    named = named.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).where(F.col("place") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("place", theme)))
    return named.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda t: t[theme]), ", ").alias("themes"))


def representatives(rows: DataFrame, keys: tuple[str, ...], bucket: str, severity_rank: Column, arrival: str, limit: int = 5) -> DataFrame:
    """Up to ``limit`` rows a group: first the worst of each bucket by bucket frequency, then the worst of the rest.

    A bucket can give no more than its ``limit`` worst rows, so only these are
    kept, already before the shuffle (a limit a group on each side of it); hot
    groups and buckets are neither sorted nor gathered whole. What is left is
    joined with the buckets' sizes and ranked.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(F.desc("severity_rank"), arrival)
    worst = rows.withColumn("severity_rank", severity_rank).withColumn("nth", F.row_number().over(inside)).where(F.col("nth") <= limit)
    ranks = histogram(rows, keys, bucket, arrival).select(*keys, bucket, F.col("rank").alias("bucket_rank"))
    heads = F.when(F.col("nth") == 1, F.col("bucket_rank"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(heads), F.desc("severity_rank"), arrival)
    kept = worst.join(ranks, [*keys, bucket])
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("nth")


def latest(rows: DataFrame, keys: tuple[str, ...], moment: str) -> DataFrame:
    """Largest parseable timestamp of a text column."""
    return rows.groupBy(*keys).agg(F.max(dates.parse_iso(F.col(moment))).alias("latest"))


def ordered_distinct(rows: DataFrame, keys: tuple[str, ...], value: str, arrival: str, limit: int = 4) -> DataFrame:
    """The first distinct values of a group in order of arrival, joined; values are aggregated before they are gathered."""
    seen = rows.groupBy(*keys, value).agg(F.min(arrival).alias("seen"))
    seen = seen.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("seen"))).where(F.col("place") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("place", value)))
    return seen.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda t: t[value]), ", ").alias("values"))


def share(rows: DataFrame, keys: tuple[str, ...], matches: Column) -> DataFrame:
    """Number of rows, of those that match, and their share."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(matches).alias("hits"))
    return counted.withColumn("share", F.col("hits") / F.col("n").cast("double"))


def ambiguous(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Identities that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def gate_failures(gates: dict[str, Column]) -> Column:
    """Names of the gates that do not hold, joined."""
    return F.concat_ws("; ", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items()])


def summary_sentence(label: Column, count: Column, themes: Column) -> Column:
    """One sentence about the consensus, plural forms included."""
    reports = F.when(count == 1, F.lit("report")).otherwise(F.lit("reports"))
    head = F.format_string("%s consensus from %d patch-specific %s", label, count, reports)
    return F.when(count <= 0, F.lit("No accepted patch-specific reports yet.")).otherwise(
        F.concat(head, F.when(F.coalesce(themes, F.lit("")) != "", F.concat(F.lit(", mostly "), themes)).otherwise(F.lit("")), F.lit("."))
    )
