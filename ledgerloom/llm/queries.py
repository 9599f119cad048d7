"""The ``opN_`` queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    hard_negatives, license_scan, line_dedup, mixing, ngram_join, oracles, packing, pii, quality, token_files, topk_search, toxicity, url_filter, vector_codes,
)

#: Host, path, verdict of the contract's rules, and hosts that the method blocks where none of these fits.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Hosts of advertising, tracking, betting and adult pages; LEDGERLOOM_URL_RULES names a Parquet table of others.
BLOCKED_HOSTS = (
    "2o7.net", "adnxs.com", "adsrvr.org", "bet365.com", "betfair.com", "criteo.com", "doubleclick.net", "exoclick.com", "googleadservices.com", "googlesyndication.com", "outbrain.com",
    "pokerstars.com", "popads.net", "pornhub.com", "propellerads.com", "quantserve.com", "rubiconproject.com", "scorecardresearch.com", "taboola.com", "xhamster.com", "xnxx.com", "xvideos.com",
)
CAPACITY, END_ID = 4096, 1
MIN_WORDS = 50
NGRAM, JACCARD = 5, 0.8


def tokenizer_path() -> str:
    """The file of the shared vocabulary; LEDGERLOOM_TOKENIZER names another place."""
    import public_tokenizers

    return os.environ.get("LEDGERLOOM_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["start"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base = F.transform("base", lambda b: b["label"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"),
        labels(F.concat(base, F.transform("found", lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda d: d["score"])), F.lit(0.0)).alias("score"),
        F.size("found").cast("long").alias("n_found"),
    )


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), *[count(k) for k in pii.KINDS if k not in pii.BASE],
    )


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    base_rules = spark.createDataFrame([(*r, 0) for r in URL_RULES], url_filter.RULES)
    given = os.environ.get("LEDGERLOOM_URL_RULES")
    own_rules = spark.read.parquet(given) if given else spark.createDataFrame([(h, "", "block") for h in BLOCKED_HOSTS], "host string, path string, verdict string")
    rules = base_rules.unionByName(own_rules.select("host", "path", "verdict", F.lit(1).alias("rank")))
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    base, own = F.col("hits")[0], F.col("hits")[1]
    return judged.select("page_id", "host", "path", base["rule"].alias("rule"), F.coalesce(base["verdict"], own["verdict"], F.lit("allow")).alias("verdict"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.STATISTICS, "base_failed", "kept", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY, END_ID)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), MIN_WORDS)
    runs = F.array_join(F.transform("deleted_runs", lambda r: F.concat_ws("-", r["b"], r["e"])), ",")
    return found.select("doc_id", "n_lines", "n_deleted", runs.alias("deleted"), "text")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), NGRAM, JACCARD)
    return found.select("doc_id", "class_id", "n_links", "is_first")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return judged.select("doc_id", "held_out", "score", predicted, "limit", "toxic")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 owes to its contract alone."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 owes to its contract alone."""
    return op4_personal_data(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.BASE], "base_sha256")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 owes to its contract alone."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", *quality.STATISTICS, "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_license_scan, op2_best_fit_packing, op3_exact_top_k, op4_personal_data, op5_source_mix, op6_url_filter,
        op7_quality_rules, op8_token_files, op9_line_dedup, op10_ngram_jaccard_join,
        op11_hard_negatives, op12_vector_codes, op13_toxicity, license_base, personal_data_base, quality_statistics,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_top_k": oracles.OP3, "op5_source_mix": oracles.OP5, "op6_url_filter": oracles.OP6, "op9_line_dedup": oracles.OP9, "op10_ngram_jaccard_join": oracles.OP10,
        "op11_hard_negatives": oracles.OP11, "op12_vector_codes": oracles.OP12,
        "license_base": oracles.LICENSE_BASE, "personal_data_base": oracles.PERSONAL_BASE, "quality_statistics": oracles.STATISTICS,
    }
