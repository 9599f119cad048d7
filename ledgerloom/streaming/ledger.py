"""A ledger of seen keys on files, whose cost a batch does not grow with its history.

A batch adds one run: its new keys, partitioned by a hash of the key. Before a
batch reads, runs of one level are merged into a run of the next as soon as
there are ``fan`` of them, so a ledger of n batches has at most ``fan`` runs on
each of log(n) levels, and a key is written anew once a level. A batch reads
only the hash buckets that its own keys fall into.

A run names the batches it holds. Only runs of batches before the present one
are merged, which the stream has committed; one that runs again after a failure
replaces its own run and sees the ledger as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def names_in(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """What a folder holds, without the prefix; nothing if there is no folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _rename(spark: SparkSession, folder: str, to: str) -> None:
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = jvm.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path, jvm.Path(to)):
        raise OSError(f"{to} could not be put in place")


@dataclass(frozen=True)
class Run:
    level: int
    first: float
    last: float

    @property
    def name(self) -> str:
        return f"{self.level}_{float(self.first)}_{float(self.last)}"

    @classmethod
    def of(cls, name: str) -> Run:
        level, first, last = name.split("_")
        return cls(int(level), float(first), float(last))


class Ledger:
    """Keys seen, under ``folder``; ``schema`` is that of the key columns."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, buckets: int = 64, fan: int = 8):
        self.spark, self.folder, self.keys, self.buckets, self.fan = spark, folder, schema.names, buckets, fan
        self.schema = StructType([*schema.fields, StructField("bucket", IntegerType())])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def runs(self, before: float | None = None) -> list[Run]:
        """The runs that make up the ledger (of batches before ``before``): those that no other holds."""
        found = [Run.of(n) for n in names_in(self.spark, self.folder, "run=")]
        found = [r for r in found if before is None or r.last < before]
        return sorted((r for r in found if not any(o.level > r.level and o.first <= r.first and r.last <= o.last for o in found)), key=lambda r: r.first)

    def read(self, rows: DataFrame | None = None, before: float | None = None) -> DataFrame | None:
        """The keys seen in the buckets that ``rows`` fall into (default: in all), or None before the first run."""
        runs = self.runs(before)
        if not runs:
            return None
        found = self.spark.read.option("basePath", self.folder).schema(self.schema).parquet(*[f"{self.folder}/run={r.name}" for r in runs])
        if rows is not None:  # at most ``buckets`` numbers
            found = found.where(F.col("bucket").isin([r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]))
        return found.select(*self.keys)

    def unseen(self, rows: DataFrame, before: float | None = None) -> DataFrame:
        """Rows whose key (null counts as a value) no earlier batch has added."""
        seen = self.read(rows, before)
        if seen is None:
            return rows
        a, b = rows.alias("a"), seen.alias("b")
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
        return a.join(b, same, "left_anti")

    def add(self, rows: DataFrame, batch: float) -> None:
        """The keys of a batch as a run of the lowest level; again after a failure it replaces itself."""
        self._write(rows.select(*self.keys).distinct(), Run(0, batch, batch))

    def _write(self, rows: DataFrame, run: Run) -> None:
        dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        target = f"{self.folder}/run={run.name}"
        staged = f"{self.folder}/_staged-{uuid.uuid4().hex}"
        dealt.write.partitionBy("bucket").parquet(staged)
        remove(self.spark, target)
        _rename(self.spark, staged, target)

    def merge(self, before: float) -> None:
        """Merge runs of committed batches where a level is full; what a merged run holds is then deleted."""
        while True:
            held = self.runs(before)
            levels: dict[int, list[Run]] = {}
            for r in held:
                levels.setdefault(r.level, []).append(r)
            full = next((rs for _, rs in sorted(levels.items()) if len(rs) >= self.fan), None)
            if full is None:
                break
            runs = full[: self.fan]
            rows = self.spark.read.option("basePath", self.folder).schema(self.schema).parquet(*[f"{self.folder}/run={r.name}" for r in runs])
            self._write(rows.select(*self.keys).distinct(), Run(runs[0].level + 1, runs[0].first, runs[-1].last))
        kept = set(self.runs(before))
        for name in names_in(self.spark, self.folder, "run="):
            if (r := Run.of(name)) not in kept and r.last < before:
                remove(self.spark, f"{self.folder}/run={name}")
