"""A corpus pipeline: language, exact copies, near copies, benchmark passages, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import exact_dedup, language, near_dedup, pieces, tiling
from barwright.llm.queries import PIECE_MODEL
from barwright.llm.shared import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text is in a language that could be learnt from the labelled ones; null texts and texts
    without a letter go too. See `language.identify`."""
    return language.accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts. See `exact_dedup.without_copies`."""
    return exact_dedup.without_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies. See `near_dedup.without_near_copies`."""
    return near_dedup.without_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. See `tiling.decontaminate`."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents but their text, with ids, round_trip (whether the ids decode to the text) and n_tokens
    added; columns of these names are replaced. See `pieces.encode`."""
    others = [c for c in docs.columns if c.lower() not in ("text", "ids", "round_trip", "n_tokens")]
    got = pieces.encode(docs, PIECE_MODEL, round_trip="round_trip", carry=others)
    return got.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("pieces", token_ids),
]

#: Statistical models, iterative components and tokenization can't be said in SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next one reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
