"""From raw documents to packed sequences in five stages, each over all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerbrook.llm.common import shielded, table
from ledgerbrook.llm.decontamination import decontaminate
from ledgerbrook.llm.near_dedup import near_dedup
from ledgerbrook.llm.packing import pack
from ledgerbrook.llm.quality_rules import quality_rules
from ledgerbrook.llm.substring_dedup import dedup_substrings
from ledgerbrook.sources.scratch import dropped, scratch, temporary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, of hosts that are kept."""
    rows, names, restored = shielded(docs)
    return restored(quality_rules(rows, text_col=names["text"], host_col=names["source"]).where("kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 0.8 or more)."""
    return near_dedup(docs, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words in repeated windows; n_chars follows the text."""
    return dedup_substrings(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into sequences of 2048 tokens; ids holds little-endian uint32."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Similarity groups and packing are not for SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns, stored; what a stage stores on its way is dropped once its result is written.

    An empty table passes through all stages; null, empty and very long texts count as each stage's operator says.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        with temporary(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            dropped(spark, before)
        before = path
    return docs
