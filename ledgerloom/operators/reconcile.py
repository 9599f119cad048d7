"""Records against evidence: counts, differences, audits, guarded updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import buckets
from ledgerloom.operators.gates import authoritative

KEY = ("product_id", "update_version")


def counted(evidence: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Authoritative number of reports of each key."""
    return evidence.where(authoritative(F.col("counted"), F.col("patch_version_matched"))).groupBy(*keys).agg(F.count("*").alias("n_counted"))


def reconcile(records: DataFrame, counts: DataFrame, keys: tuple[str, ...] = KEY, shown: str = "update_report_count") -> DataFrame:
    """Every record with its shown and authoritative count, derived states, and whether it must be written."""
    found = records.join(counts, list(keys), "left").withColumn("n_counted", F.coalesce("n_counted", F.lit(0)).cast("long"))
    return (
        found.withColumn("evidence_state", buckets.evidence_state(F.col("n_counted")))
        .withColumn("collection_status", buckets.collection_status(F.col("n_counted")))
        .withColumn("changed", ~F.col(shown).eqNullSafe(F.col("n_counted")))
    )


def full_audit(records: DataFrame, evidence: DataFrame, keys: tuple[str, ...], shown: str, actual: str) -> DataFrame:
    """Full outer join of two keyed counts with the finding of each key.

    Both sides carry unique keys; the last right row of a repeated key is the
    caller's to choose beforehand.
    """
    a, b = records.withColumn("in_records", F.lit(True)), evidence.withColumn("in_evidence", F.lit(True))
    both = a.join(b, list(keys), "full_outer")
    finding = (
        F.when(F.col("in_evidence").isNull(), "record_without_evidence").when(F.col("in_records").isNull(), "evidence_without_record")
        .when(~F.col(shown).eqNullSafe(F.col(actual)), "count_mismatch").otherwise("aligned")
    )
    return both.withColumn("finding", finding).drop("in_records", "in_evidence")


def changed_rows(before: DataFrame, after: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Keys added, removed or changed between two tables of unique keys."""
    a = before.select(*keys, F.struct(*values).alias("was"))
    b = after.select(*keys, F.struct(*values).alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, list(keys), "full_outer").withColumn("change", kind).where("change IS NOT NULL")


def fill_blank(existing: Column, incoming: Column) -> Column:
    """The existing value unless it is blank."""
    return F.when(F.coalesce(F.trim(existing), F.lit("")) == "", incoming).otherwise(existing)


def guarded_fields(fields: set[str], approved: set[str], protected: set[str]) -> None:
    """Refuse to write protected or unapproved fields."""
    if bad := sorted(fields & protected):
        raise ValueError(f"protected fields: {', '.join(bad)}")
    if bad := sorted(fields - approved):
        raise ValueError(f"unapproved fields: {', '.join(bad)}")


def ownership_violations(before: DataFrame, after: DataFrame, allowed: dict[str, set[str]]) -> DataFrame:
    """Rows deleted or altered, and new rows outside the allow-lists, with the reason."""
    gone = before.exceptAll(after).withColumn("reason", F.lit("existing_row_changed_or_deleted"))
    new = after.exceptAll(before)
    outside = F.lit(False)
    for name, values in allowed.items():
        outside = outside | ~F.coalesce(F.col(name).isin(*sorted(values)), F.lit(False))
    return gone.unionByName(new.where(outside).withColumn("reason", F.lit("new_row_outside_allow_list")))


def set_parts(a: DataFrame, b: DataFrame, only: str) -> DataFrame:
    """Sizes of the difference, the intersection and the union of two sets of rows (both sides' columns alike)."""
    both = a.distinct().withColumn("_a", F.lit(True)).join(b.distinct().withColumn("_b", F.lit(True)), a.columns, "full_outer")
    counts = both.agg(F.count_if(F.col("_b").isNull()).alias("only"), F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count("*").alias("either"))
    return counts.select(F.expr(f"stack(3, '{only}', only, 'both', both, 'either', either) AS (part, n)"))
