"""Tables of a data folder, read by Spark and offered to SQL as views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str, **args) -> DataFrame:
    """The query `text` over the folder's tables, of which those it names become views."""
    for name in NAMES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text, args=args or None)


def sql_query(text: str):
    """A registered query from SQL text."""
    return lambda spark, sf_dir: run_sql(spark, sf_dir, text)
