"""Front-matter documents and YAML tables as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A fence is a line of exactly three hyphens; a carriage return before its end is ignored.
FENCED = r"(?s)\A---\r?\n(.*?)(?m:^---\r?$)\n?(.*)\z"


def _yaml_map(texts: Column) -> Column:
    """Top-level scalars of YAML maps as text (nested values as JSON); anything else is an empty map."""

    @F.pandas_udf("map<string,string>")
    def parsed(batch: pd.Series) -> pd.Series:
        import json

        import yaml

        def one(text):
            try:
                found = yaml.load(text, Loader=yaml.BaseLoader) if isinstance(text, str) else None
            except yaml.YAMLError:
                found = None
            if not isinstance(found, dict):
                return {}
            return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in found.items()}

        return batch.map(one)

    return parsed(texts)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, data, body`` of every document below ``path``; one without fences is all body with empty data.

    Values stay text, so versions such as 2607 or 26.2 keep their form.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    fenced = F.col("text").rlike(FENCED)
    rows = rows.withColumn("yaml", F.when(fenced, F.regexp_extract("text", FENCED, 1)))
    rows = rows.withColumn("body", F.when(fenced, F.regexp_extract("text", FENCED, 2)).otherwise(F.col("text")))
    return rows.select("path", _yaml_map(F.col("yaml")).alias("data"), "body")


def records(documents: DataFrame, product: str | None = None, versions: list[str] | None = None, archived: bool = False) -> DataFrame:
    """Update records of documents: entries with a version, archived ones only if asked for."""
    d = lambda k: F.trim(F.coalesce(F.try_element_at("data", F.lit(k)), F.lit("")))
    rows = documents.where((F.lower(d("update_entry")) == "true") & (d("update_version") != "") & (d("product_id") != ""))
    if product:
        rows = rows.where(d("product_id") == product)
    if versions is not None:
        rows = rows.where(d("update_version").isin(*versions))
    if not archived:
        rows = rows.where(d("update_status") != "archived")
    names = ("product_id", "update_version", "update_product", "update_published_at", "update_status")
    return rows.select("path", *[d(n).alias(n) for n in names], "data")


def read_yaml_list(spark: SparkSession, path: str, key: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of YAML files that hold a list, or a map with the list under ``key``; other roots are empty, or an error if strict."""

    def rows(batches):
        import json

        import yaml

        for batch in batches:
            found = []
            for text in batch["value"]:
                root = yaml.load(text, Loader=yaml.BaseLoader) or []
                items = root.get(key) or [] if isinstance(root, dict) else root
                if strict and not isinstance(items, list):
                    raise ValueError(f"expected a list or a map with {key}")
                found += [json.dumps(i) for i in (items if isinstance(items, list) else []) if isinstance(i, dict)]
            if found:
                yield pd.DataFrame({"json": found})

    text = spark.read.text(path, wholetext=True)
    listed = text.mapInPandas(rows, "json string")
    return listed.select(F.from_json("json", schema).alias("r")).select("r.*")
