import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LONG = "alpha beta gamma delta epsilon " * 12


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing extra columns."""
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, shared, "en", "a", 1), (1, shared, "en", "a", 1), (2, shared + " end", "en", "a", 2), (3, None, None, None, None), (4, "", "en", "b", 0),
        (None, shared, "en", None, 5), (None, None, None, None, None), (5, "one two", "de", "b", 7), (5, "other text under one id", "de", "b", 7),
        (6, "x y\n\n" + shared + "\nlast line", "fr", "c", 9), (7, " ".join(f"v{i % 5000}" for i in range(30_000)), "en", "a", 1), (8, "\n\n \t\n", "en", "c", 1),
        (9, "Ünïcödé 🙂 中文 words, no ascii ones é", "en", "c", 1), (10, LONG, "en", "b", 1), (11, "two one", "de", "b", 7),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = {c: f"'{c}'" for c in ("row", "src", "key", "id", "k", "kept", "score", "class_id", "spans", "host", "n_lines", "bin", "shard")}
    return df.selectExpr("*", *[f"{v} AS `{c}`" for c, v in extra.items()])


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("doc_id < 0")


@pytest.fixture(scope="session")
def tokenizer_file():
    from ledgerloom.llm.queries import tokenizer_path

    return tokenizer_path()


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
