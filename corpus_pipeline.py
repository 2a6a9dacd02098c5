"""The corpus pipeline: quality rules, exact and near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last
return documents with their columns; the last returns the packed layout, one row per piece.

Defined results, in every stage: a null text counts as empty; an empty table gives an empty table;
columns other than doc_id, text and source pass through whatever their names; a row without an id is
kept where only ids could tell which of several rows stays; rows that share an id and differ in text
are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamgrid.llm import exactdup, neardup, packing, quality, suffixdup
from loamgrid.plans.session import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and frequent lines of a host leave the texts that stay.

    Null and empty texts have no words and go; repeated rows are judged alike and all stay or go.
    """
    return quality.clean_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, in one row; all null and empty texts are equal."""
    return exactdup.keep_one(docs, keep="largest")


#: Word shingles of the pipeline: five words, similarity 0.8 or more.
NEAR = neardup.SketchParams(width=5, threshold=80)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id stays; texts without words are in no group."""
    return neardup.without_near_duplicates(docs, NEAR)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every repeat of a passage of 50 words or more is cut; its first occurrence stays, and so do all rows."""
    return suffixdup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in one or more pieces of 4096 tokens at most; null and empty texts are their end token alone."""
    return packing.pack_documents(docs, packing.default_params())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written and reread for the next."""
    s = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = s.keep(stage(spark, docs, sf_dir), name)
    return s.finish(STAGES[-1][1](spark, docs, sf_dir))


#: Connected components and packing have no practical SQL form; tests/llm compares with brute force.
ORACLE_SQL = None
