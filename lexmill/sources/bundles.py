"""Bundles of signed claims: one JSON object in a line, each line judged by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import is_document_id
from lexmill.operators.attest import key_fault, treatment
from lexmill.sources.lines import numbered_lines

CLAIM = "from_doc string, to_doc string, treatment string, from_para int, note string, signer string, signature string, created_at string"
# Hex digits of a key and of a signature, and what becomes of a line.
KEY_DIGITS, SIGNATURE_DIGITS = 64, 128
STATUSES = ("malformed", "rejected", "duplicate", "new")


def parse_lines(lines: DataFrame, verify: Column | None = None) -> DataFrame:
    """The claims of lines (path, line, value) with status and reason (SRC-20, FLT-12).

    A line that is no JSON object, or lacks a field, is malformed. A claim whose ids, treatment, key or signature cannot be
    read, or that ``verify`` (a boolean column over the claim's fields; all pass without one) refuses, is rejected.
    Of claims with one signer and signature the first line counts, the others are duplicates. Blank lines are skipped.
    """
    rows = lines.filter(F.trim("value") != "").withColumn("c", F.from_json("value", CLAIM, {"mode": "PERMISSIVE"})).select("path", "line", "c.*")
    missing = F.lit(None).cast("string")
    for name in ("created_at", "signature", "signer", "treatment", "to_doc", "from_doc"):
        missing = F.when(F.col(name).isNull(), F.lit(f"no {name}")).otherwise(missing)
    bad = (
        F.when(~is_document_id(F.col("from_doc")) | ~is_document_id(F.col("to_doc")), "id").when(treatment(F.col("treatment")).isNull(), "treatment")
        .when(key_fault(F.col("signer"), KEY_DIGITS).isNotNull(), F.concat(F.lit("signer "), key_fault(F.col("signer"), KEY_DIGITS)))
        .when(key_fault(F.col("signature"), SIGNATURE_DIGITS).isNotNull(), F.concat(F.lit("signature "), key_fault(F.col("signature"), SIGNATURE_DIGITS)))
        .when(F.lit(False) if verify is None else ~F.coalesce(verify, F.lit(False)), "signature")
    )
    judged = rows.withColumn("reason", F.coalesce(missing, bad)).withColumn("status", F.when(missing.isNotNull(), "malformed").when(bad.isNotNull(), "rejected").otherwise("new"))
    first = judged.filter("status = 'new'").groupBy("signer", "signature").agg(F.min(F.struct("path", "line")).alias("first"))
    out = judged.join(first, ["signer", "signature"], "left")
    again = (F.col("status") == "new") & (F.struct("path", "line") != F.col("first"))
    return out.withColumn("status", F.when(again, "duplicate").otherwise(F.col("status"))).drop("first")


def read_bundle(spark: SparkSession, path: str, verify: Column | None = None) -> DataFrame:
    """The claims of a bundle file or folder, with path and physical line number."""
    return parse_lines(numbered_lines(spark, path).withColumnRenamed("file", "path"), verify)


def bundle_tallies(claims: DataFrame) -> DataFrame:
    """One row: lines by what became of them."""
    return claims.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
