"""Helpers that the training-data operators share: written tables, row keys, joins on hot keys, ordered sums."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only by a local master whose session names no shared folder (tests, a laptop).
LOCAL_SHARED_DIR = "/tmp/ledgerloom-shared"

Tables = list[tuple[SparkSession, str]]
_lasting: Tables = []
_owner: ContextVar[Tables] = ContextVar("owner", default=_lasting)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, which only a local master may leave unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_SHARED_DIR
    return f"{folder}/ledgerloom"


@contextmanager
def owned() -> Iterator[Tables]:
    """Tables written inside belong to the list given, which :func:`release` deletes; others stay until Python ends."""
    tables: Tables = []
    before = _owner.set(tables)
    try:
        yield tables
    finally:
        _owner.reset(before)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _owner.get().append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files every executor sees."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(tables: Tables) -> None:
    """Delete an owner's tables; call once every result built on them is stored."""
    while tables:
        spark, path = tables.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; the files belong to its folder
            return


atexit.register(release, _lasting)


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], how: str = "inner", count: str = "n", total: int | None = None, parts: int = 1024) -> DataFrame:
    """Inner or left semi join of ``rows`` with ``keyed`` in which no hot key's rows meet in one task.

    ``keyed`` has one row a key, and in ``count`` how many rows hold it.
    Keys with over a ``parts``-th of ``total`` rows (default: all that are
    counted) are fewer than ``parts``, whatever the input's size: they are
    broadcast. The rows of all others are dealt by key. Null keys match nothing.
    """
    if total is None:
        total = keyed.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * parts > F.lit(total)
    hot, rest = keyed.where(heavy), keyed.where(~heavy)
    if how == "left_semi":
        hot, rest = hot.select(*keys), rest.select(*keys)
    held = rows.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    cold = held.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return rows.join(F.broadcast(hot), keys, how).unionByName(cold)


def col(name: str) -> Column:
    """The top-level column of that exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All of a row's columns as one struct, so that added names cannot clash with them."""
    return F.struct(*[col(c) for c in df.columns])


def source_columns(df: DataFrame, struct: str = "src", replaced: dict[str, Column] | None = None) -> list[Column]:
    """The columns that :func:`whole_row` packed from ``df``, some of them replaced."""
    replaced = replaced or {}
    return [replaced.get(c, F.col(struct).getField(c)).alias(c) for c in df.columns]


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def words_in(text: Column) -> Column:
    """Number of runs outside ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def partition_starts(totals: DataFrame, part: str, size: str) -> DataFrame:
    """For one row per partition (at most the number of write tasks): what all earlier ones hold."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("base"))
