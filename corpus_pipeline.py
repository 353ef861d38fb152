"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, then coding.

Each stage gets what the one before it kept, written as Parquet and read again. All but
the last return the columns of ``documents``; the last adds the codes of each text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinarm.llm import bpe, decontaminate, jaccard, quality, substring
from twinarm.llm.common import table, written
from twinarm.llm.queries import RANKS, quality_model
from twinarm.session import ship_package

#: SQL cannot express the scores of the first stage.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.score(docs, quality_model(spark, sf_dir)).where("kept").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of alike ones."""
    return jaccard.keep_one(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; those that lose all their text go. ``n_chars`` counts the new text."""
    cut = substring.remove_repeats(docs)
    left = cut.where((F.size("removed_starts") == 0) | (F.col("text") != ""))
    changed = F.when(F.size("removed_starts") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")).where(F.size("leak_items") == 0).select(docs.columns)


def coding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``ids``, the packed codes of the text, ``n_tokens``, and ``exact``, whether decoding gives the text back."""
    coded = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select(*docs.columns, "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), exact.alias("exact"))


def shipped(stage):
    """The stage with the package sent to the executors first."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality rules", shipped(quality_stage)),
    ("n-gram Jaccard join", shipped(near_duplicate_stage)),
    ("substring dedup", shipped(passage_stage)),
    ("benchmark decontamination", shipped(benchmark_stage)),
    ("byte-level BPE", shipped(coding_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
