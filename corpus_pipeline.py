"""A training corpus from raw documents: quality, line and near-duplicate removal, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's documents. What a stage writes for
itself in the shared folder belongs to the result of that call: run() deletes it
once the result is stored; a stage that is called by itself and writes more than
totals stores its own result, deletes the rest at once, and returns what it
stored. Nothing that a result needs is deleted before Python ends.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import common, line_dedup, mixing, ngram_join, packing, quality
from ledgerloom.llm.queries import CAPACITY, END_ID, JACCARD, MIN_WORDS, NGRAM, table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits and the trees keep.

    Null and empty texts fail; rows are judged one by one on their whole text,
    so repeated ones stay or go together, and no row is lost for a null id.
    """
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stood earlier; n_chars counts what is left.

    A document of which no word is left goes; one that had none before (null,
    empty) stays. Repeated rows of one id stay or go together. Whole texts count.
    """
    left = line_dedup.dedup_lines(docs, MIN_WORDS).where((F.col("n_deleted") == 0) | (common.words_in(F.col("text")) > 0))
    return left.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id.

    Of rows that tie in their id one stays, null ids come last; rows without
    words (null, empty) are no one's duplicates and stay. Whole texts count.
    """
    return ngram_join.near_duplicates(docs, NGRAM, JACCARD).where("is_first").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null is a source like the others, the last; null and empty texts have size
    0 and follow the order of their source; rows that are equal in every column
    may stand for each other; nothing is cut.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document.

    Null and empty texts are one end token, repeated rows are packed one by
    one, a long text is cut into pieces of the sequence length.
    """
    return packing.pack(docs, tokenizer_path(), CAPACITY, END_ID)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_PLAIN: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]
#: Stages whose own tables are about as large as their documents.
_LARGE = (dedup_lines, near_duplicates)


def _alone(name: str, stage: Stage) -> Stage:
    @wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if stage not in _LARGE:
            return stage(spark, docs, sf_dir)
        with common.owned() as tables:
            made = stage(spark, docs, sf_dir)
        stored = common.cut(made, name.replace(" ", "-"))
        common.release(tables)
        return stored

    return begin


STAGES: list[tuple[str, Stage]] = [(name, _alone(name, stage)) for name, stage in _PLAIN]
#: Fitted trees and a tokenizer are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what the last one reads stays until Python ends."""
    docs, last = table(spark, sf_dir, "documents"), _PLAIN[-1][1]
    for name, stage in _PLAIN[:-1]:
        with common.owned() as tables:
            made = stage(spark, docs, sf_dir)
        docs = common.cut(made, name.replace(" ", "-"))
        common.release(tables)
    return last(spark, docs, sf_dir)
