"""Sinks: staged publishing, JSON reports, documents, bounded ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import reconcile
from ledgerloom.operators.dedupe import recent_only


def _fs(df: DataFrame, path: str):
    session = df.sparkSession
    target = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()), target


def publish(df: DataFrame, path: str, valid: Column | None = None, fmt: str = "parquet") -> int:
    """Write to a staging folder beside ``path``, check every row, and put it in place; returns the rows.

    If a row is not valid nothing changes: the staged files go and an error
    says how many rows failed. Folders cannot be exchanged in one step on
    every store, so a reader may meet none for the moment between two renames;
    if the second one fails, the first is taken back.
    """
    staged = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    fs, target = _fs(df, path)
    stage = _fs(df, staged)[1]
    try:
        df.write.format(fmt).save(staged)
        back = df.sparkSession.read.format(fmt).schema(df.schema).load(staged)
        checks = [F.count("*").alias("n"), (F.count_if(~F.coalesce(valid, F.lit(False))) if valid is not None else F.lit(0)).alias("bad")]
        n, bad = back.agg(*checks).first()
        if bad:
            raise ValueError(f"{bad} of {n} rows are not valid; nothing was published")
        old = _fs(df, f"{staged}-old")[1]
        had = fs.exists(target)
        if had and not fs.rename(target, old):
            raise OSError(f"{path} could not be set aside")
        if not fs.rename(stage, target):
            if had:
                fs.rename(old, target)
            raise OSError(f"{path} could not be put in place")
        fs.delete(old, True)
        return n
    finally:
        fs.delete(stage, True)


def json_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, null fields left out."""
    publish(df, path, fmt="json")


def split_log(rows: DataFrame, path: str, reason: str = "exclusion_reason") -> None:
    """Accepted and rejected rows as two JSON folders."""
    json_report(rows.where(F.col(reason).isNull()), f"{path}/accepted")
    json_report(rows.where(F.col(reason).isNotNull()), f"{path}/rejected")


def documents(rows: DataFrame, fields: list[str], body: str = "body") -> DataFrame:
    """``text`` of front-matter documents: fields as quoted YAML scalars between fences, then the body."""
    quoted = lambda c: F.concat(F.lit(f"{c}: "), F.to_json(F.array(F.coalesce(F.col(c).cast("string"), F.lit("")))))
    line = lambda c: F.regexp_replace(quoted(c), r"\[(.*)\]$", "$1")
    return rows.withColumn("text", F.concat_ws("\n", F.lit("---"), *[line(c) for c in fields], F.lit("---"), F.coalesce(F.col(body), F.lit(""))))


def save_ledger(rows: DataFrame, path: str, source: str, newest: list[Column], most: int = 200) -> None:
    """The newest ids of each source."""
    publish(recent_only(rows, [source], newest, most), path)


def fresh_if_all(rows: DataFrame, guards: dict[str, Column]) -> Column:
    """Whether every row holds every guard (an empty table does not)."""
    return F.coalesce(F.every(F.array_min(F.array(*[F.coalesce(g, F.lit(False)) for g in guards.values()]))), F.lit(False))


def transact(stored: DataFrame, produced: DataFrame, path: str, owner: dict[str, set[str]], valid: Column, keys: list[str]) -> tuple[bool, str]:
    """Publish what one collector produced, or nothing: whether it was, and why not.

    Rows outside the collector's allow-lists, stored rows that are changed or
    gone, invalid rows and repeated keys each leave the stored table as it is.
    """
    bad = reconcile.ownership_violations(stored, produced, owner)
    if (row := bad.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").first()) is not None:
        return False, f"{row['reason']}: {row['n']}"
    if (n := produced.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").count()) > 0:
        return False, f"repeated keys: {n}"
    try:
        publish(produced, path, valid)
    except ValueError as error:
        return False, str(error)
    return True, ""


def refresh_dates(records: DataFrame, verified: DataFrame, key: list[str], expected: int, guards: dict[str, Column], now: Column, field: str = "evidence_last_checked") -> DataFrame:
    """Records with one date set for the confirmed key, if the number of verified rows is the expected one and all hold every guard; else as they are."""
    per = verified.groupBy(*key).agg(F.count("*").alias("_n"), fresh_if_all(verified, guards).alias("_ok"))
    rows = records.join(per, key, "left")
    ok = F.coalesce((F.col("_n") == expected) & F.col("_ok"), F.lit(False))
    return rows.withColumn(field, F.when(ok, now.cast("string")).otherwise(F.col(field))).drop("_n", "_ok")
