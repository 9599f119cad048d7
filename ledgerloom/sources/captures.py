"""Capture files (JSON lines): strict reading, row validity, known URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.urls import normalize_url
from ledgerloom.schemas import CAPTURE

REQUIRED = ("source_url", "source_name", "captured_at", "capture_method", "capture_status")
STATUSES = ("success", "blocked", "error")


def read(spark: SparkSession, path: str, max_rows: int | None = None, schema: str = CAPTURE) -> DataFrame:
    """Rows of JSON lines; a malformed line fails the read, blank lines are skipped; at most ``max_rows`` rows (a limit of the feature)."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.limit(max_rows) if max_rows else rows


def known_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct normalised source URLs of a folder's captures; malformed lines are ignored."""
    rows = spark.read.schema("source_url string").option("mode", "DROPMALFORMED").json(folder)
    return rows.select(normalize_url(F.col("source_url")).alias("url")).where("url <> ''").distinct()


def problems(rows: DataFrame) -> DataFrame:
    """Rows with what is wrong with them: missing fields, unknown status, an error without a reason."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rules = [F.when(blank(c), F.lit(f"missing {c}")) for c in REQUIRED]
    rules.append(F.when(~F.coalesce(F.col("capture_status").isin(*STATUSES), F.lit(False)), F.lit("unknown status")))
    rules.append(F.when((F.col("capture_status") == "error") & blank("error_reason"), F.lit("error without reason")))
    return rows.withColumn("problems", F.array_compact(F.array(*rules)))
