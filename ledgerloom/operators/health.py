"""Health of methods and sources: the monitoring ladder, statuses, failure streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import DAY, seconds

DEGRADED = ("partial", "blocked", "broken", "stale", "low_confidence", "manual_review_needed")


def monitoring_ladder(
    records: DataFrame, methods: DataFrame, keys: tuple[str, ...], now: Column, published: str, reports: str, max_age_days: int = 14, least_healthy: int = 2
) -> DataFrame:
    """Monitoring status of every record from its methods' last runs (unique keys on the left).

    Method rows are aggregated before the join. The order of the rungs is the
    contract; unknown is never safe.
    """
    status, run, clock = F.lower(F.trim(F.col("status"))), seconds(F.col("last_run")), seconds(now)
    joined = methods.join(records.select(*keys, F.coalesce(seconds(F.col(published)), F.lit(0.0)).alias("pub")), list(keys))
    usable, valid = status != "disabled", run <= clock
    ok = usable & F.coalesce(valid, F.lit(False))
    after = ok & (run >= F.col("pub"))
    fresh = after & (clock - run <= max_age_days * DAY)
    seen = joined.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(status == "disabled").alias("disabled"), F.count_if(fresh).alias("fresh"),
        F.count_if(fresh & status.isin("success", "no_results")).alias("healthy"), F.coalesce(F.bool_or(ok), F.lit(False)).alias("valid"),
        F.coalesce(F.bool_or(after), F.lit(False)).alias("post_release"), F.bool_or(status.isin("blocked", "broken")).alias("blocked"),
        F.bool_or(status.isin(*DEGRADED)).alias("degraded"), F.bool_or(usable & ~F.coalesce(valid, F.lit(False))).alias("invalid"),
        F.max(F.when(ok, F.col("last_run"))).alias("latest_run"),
    )
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    b = lambda name: F.coalesce(F.col(name), F.lit(False))
    ladder = (
        F.when((c("total") == 0) | (c("disabled") == c("total")), "OFFICIAL SOURCE ONLY")
        .when(~b("valid"), "COLLECTION STALE").when(~b("post_release"), "NOT YET MONITORED").when(c("fresh") == 0, "COLLECTION STALE")
        .when((c("healthy") == 0) & b("blocked"), "COLLECTION BLOCKED")
        .when(b("degraded") | (c("disabled") > 0) | b("invalid"), "MONITORING DEGRADED")
        .when(c("healthy") < least_healthy, "INSUFFICIENT COVERAGE")
        .when(F.coalesce(F.col(reports), F.lit(0)) > 0, "MONITORING ACTIVE").otherwise("NO ACCEPTED PATCH-SPECIFIC REPORTS")
    )
    return records.join(seen, list(keys), "left").select(
        *records.columns, c("total").alias("methods"), c("healthy").alias("healthy_methods"), "latest_run", ladder.alias("monitoring_status")
    )


def failure_streaks(runs: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], failed: Column) -> DataFrame:
    """Each run with the number of failures in a row up to it, and the state they give."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("_failed", failed).withColumn("_island", F.sum(F.when(F.col("_failed"), 0).otherwise(1)).over(over))
    streak = F.sum(F.col("_failed").cast("int")).over(Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("consecutive_failures", streak)
    state = F.when(F.col("consecutive_failures") == 0, "healthy").when(F.col("consecutive_failures") == 1, "degraded").otherwise("failing")
    return runs.withColumn("state", state).drop("_failed", "_island")


def changes(rows: DataFrame, keys: list[str], order: list[str], status: str) -> DataFrame:
    """Rows whose status is another than that of the row before (the first of a key always)."""
    was = F.lag(status).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_was", was).where(~F.col("_was").eqNullSafe(F.col(status))).drop("_was")


def status_totals(rows: DataFrame, status: str, classes: tuple[str, ...]) -> DataFrame:
    """Counts of a fixed list of statuses, zeros included."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(c,) for c in classes], f"{status} string")
    return wanted.join(rows.groupBy(status).agg(F.count("*").alias("n")), status, "left").fillna(0, ["n"])


# States of sources in the order in which they are reported.
SOURCE_STATES = ("Active", "Manual watch", "Needs adapter", "Disabled", "Error", "Unknown")


def source_totals(rows: DataFrame, status: str = "status") -> DataFrame:
    """Number of sources in each known state, zeros included, with its place in the report; other states are not reported."""
    place = F.array_position(F.array(*map(F.lit, SOURCE_STATES)), F.col(status))
    return status_totals(rows, status, SOURCE_STATES).withColumn("place", place.cast("int"))


def validation_errors(rows: DataFrame, required: tuple[str, ...], counters: tuple[str, ...], statuses: tuple[str, ...], moment: str) -> DataFrame:
    """Rows with the array of rules that they break: required fields, known status, timestamp, counters."""
    rules = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"missing {c}")) for c in required]
    rules.append(F.when(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), F.lit("unknown status")))
    rules.append(F.when(F.col(moment).isNotNull() & F.try_to_timestamp(F.col(moment)).isNull(), F.lit(f"bad {moment}")))
    rules += [F.when(F.col(c) < 0, F.lit(f"negative {c}")) for c in counters]
    return rows.withColumn("errors", F.array_compact(F.array(*rules))).where(F.size("errors") > 0)
