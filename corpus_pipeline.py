"""A training-corpus pipeline of five operators over ``documents``.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again for the next. All but the last return the columns of ``documents``. Nulls in any
column, empty and very long texts, repeated rows, empty tables and further columns have the results that the
operators' docstrings state; further columns are passed on by the stages that filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, jaccard_join, language_id, packing, suffix_dedup
from lexmill.session import Scratch, table

#: SQL for the rows of run(): none, since language identification and packing are not to be stated as SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; texts without letters, null ones among them, go."""
    judged = language_id.identify(docs.withColumnsRenamed({c: f"own_{c}" for c in ("language", "posterior", "kept") if c in docs.columns}))
    kept = judged.filter("kept").drop("language", "posterior", "kept")
    return kept.withColumnsRenamed({f"own_{c}": c for c in ("language", "posterior", "kept") if c in docs.columns}).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def cut_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the bytes that repeats of 400 bytes cover; n_chars is the new length."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else cut.select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose document contains no item of ``benchmark``."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences of 4096 tokens."""
    return packing.pack(packing.token_pieces(docs, packing.tokenizer_path()))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_long_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else scratch.table(out, name)
    return docs
