"""Duplicates, ownership and quotas: keep-first, anti-joins, upserts, running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def first_ids(rows: DataFrame, key: Column, arrival: str) -> DataFrame:
    """Smallest arrival and number of rows of each key: partial sums, so one hot key is no hot task."""
    return rows.groupBy(key.alias("key")).agg(F.min(arrival).alias("first_id"), F.count("*").alias("copies"))


def later_copies(rows: DataFrame, key: Column, arrival: str) -> DataFrame:
    """Each row that repeats a key, with the arrival of the first that has it."""
    keyed = rows.withColumn("key", key)
    firsts = first_ids(rows, key, arrival)
    return keyed.join(firsts.where("copies > 1"), "key").where(F.col(arrival) > F.col("first_id"))


def append_new(new: DataFrame, stored: DataFrame, id_keys: list[str], url_keys: list[str], exempt: Column, arrival: str) -> DataFrame:
    """New rows whose id, and (unless exempt) URL, is neither stored nor earlier in the batch."""
    fresh = new.join(stored.select(*id_keys).distinct(), id_keys, "left_anti")
    fresh = keep_first(fresh, [F.col(k) for k in id_keys], [F.col(arrival)])
    bound, free = fresh.where(~exempt), fresh.where(exempt)
    bound = bound.join(stored.select(*url_keys).distinct(), url_keys, "left_anti")
    return keep_first(bound, [F.col(k) for k in url_keys], [F.col(arrival)]).unionByName(free)


def prefer_detail(rows: DataFrame, key: list[str], is_detail: Column) -> DataFrame:
    """Detail rows, and the others whose key no detail row has."""
    detail = rows.where(is_detail)
    return detail.unionByName(rows.where(~is_detail).join(detail.select(*key).distinct(), key, "left_anti"))


def not_accepted_elsewhere(rejected: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Rejected rows whose key no accepted row has."""
    return rejected.join(accepted.select(key).distinct(), key, "left_anti")


def exclusive_owner(rows: DataFrame, key: str, order: list[Column], owner: str) -> DataFrame:
    """Each row with the owner of its key: the first in order; others are duplicates of it.

    The first is found by a partial aggregation and joined back, so a key that
    many rows share is not sorted in one task.
    """
    first = rows.groupBy(key).agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(owner).alias("own"))).alias("least"))
    owned = rows.join(first.select(key, F.col("least.own").alias("owned_by")), key)
    return owned.withColumn("is_duplicate", F.col("owned_by") != F.col(owner))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Old rows replaced or joined by new ones of unique, fully known keys, with the kind of change."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "")
    a = old.select(*keys, F.struct(*values).alias("was"))
    b = new.where(known).select(*keys, F.struct(*values).alias("now"))
    merged = a.join(b, keys, "full_outer")
    kind = F.when(F.col("was").isNull(), "inserted").when(F.col("now").isNull() | F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("replaced")
    return merged.select(*keys, F.coalesce("now", "was").alias("row"), kind.alias("change")).select(*keys, "row.*", "change")


def write_quota(rows: DataFrame, source: str, seen: Column, order: list[Column], limit: int) -> DataFrame:
    """Per source: the first unseen rows are created, later ones deferred; the first seen refreshed, later ones skipped."""
    rows = rows.withColumn("is_seen", seen)
    nth = F.row_number().over(Window.partitionBy(source, "is_seen").orderBy(*order))
    within = nth <= limit
    action = F.when(~F.col("is_seen") & within, "create").when(~F.col("is_seen"), "defer").when(within, "refresh").otherwise("skip")
    return rows.withColumn("action", action)


def recent_only(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The newest rows of each key (a bounded ledger)."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= limit).drop("_nth")


def unique_pairs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have exactly one distinct value, with it."""
    return rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_most")).where(F.col(value) == F.col("_most")).drop("_most")
