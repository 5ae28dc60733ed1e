"""Lookups of one document and listings in their fixed orders. Orders are given as columns, so pages can be cut from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The total order of each listing.
CITATIONS_FROM = ("from_para asc nulls first", "id asc")
CITED_BY = ("date desc nulls last", "from_doc asc", "from_para asc nulls first")
PROVENANCE = ("witness asc", "source_url asc")
ATTESTATIONS = ("created_at asc", "signer asc", "from_doc asc", "treatment asc", "signature asc")
NEIGHBOURHOOD = ("depth asc", "id asc")
CONFLICTS = ("to_doc asc", "from_doc asc")
DESCRIPTORS = ("built_at asc", "descriptor_id asc")


def order(spec: tuple[str, ...]) -> list[Column]:
    """A listing's order (ORD-3 to ORD-7, ORD-13 to ORD-15) as sort columns."""
    out = []
    for part in spec:
        name, how = part.split(" ", 1)
        out.append({"asc": F.col(name).asc(), "asc nulls first": F.col(name).asc_nulls_first(), "desc nulls last": F.col(name).desc_nulls_last()}[how])
    return out


def placed(rows: DataFrame, key: str, spec: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``place``, from 1, in the listing of their ``key``: the listings of all documents at once."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order(spec))))


def listing(rows: DataFrame, key: str, value, spec: tuple[str, ...]) -> DataFrame:
    """The listing of one document: the filter reaches the scan."""
    return rows.filter(F.col(key) == value).orderBy(*order(spec))


def case(judgments: DataFrame, provenance: DataFrame, cited: DataFrame, cites: DataFrame, doc_id) -> DataFrame:
    """One document with its authority (0 without one), class, and counts; no row for an unknown id (SRC-19, PRJ-3).

    cited: to_doc, cited_by_count. cites: from_doc, cites_count. Each side is filtered before it is joined.
    """
    own = judgments.filter(F.col("id") == doc_id).select("id", "court", "region", "date", F.coalesce("authority", F.lit(0.0)).alias("authority"))
    seen = provenance.filter(F.col("doc_id") == doc_id).select(F.col("doc_id").alias("id"), "provenance_class")
    inbound = cited.filter(F.col("to_doc") == doc_id).select(F.col("to_doc").alias("id"), "cited_by_count")
    outbound = cites.filter(F.col("from_doc") == doc_id).select(F.col("from_doc").alias("id"), "cites_count")
    rows = own.join(seen, "id", "left").join(inbound, "id", "left").join(outbound, "id", "left")
    return rows.withColumns({"provenance_class": F.coalesce("provenance_class", F.lit("manual")), "cited_by_count": F.coalesce("cited_by_count", F.lit(0)), "cites_count": F.coalesce("cites_count", F.lit(0))})


def nodes_by_id(nodes: DataFrame) -> DataFrame:
    """All nodes in the order of their ids (SRC-18): a range sort, which large results are written in."""
    return nodes.orderBy("id")


def json_columns(rows: DataFrame) -> DataFrame:
    """``rows`` with arrays, maps and structs as JSON text, for stores that have none (CR-7); null stays null."""
    nested = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return rows.withColumns({c: F.to_json(F.col(c)) for c in nested})


def nested_columns(rows: DataFrame, like: StructType) -> DataFrame:
    """The reverse: JSON text of columns that are nested in ``like``; text that is no such JSON is null."""
    nested = [f for f in like.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return rows.withColumns({f.name: F.from_json(F.col(f.name), f.dataType) for f in nested})


def write_authority(judgments: DataFrame, scores: DataFrame) -> DataFrame:
    """``judgments`` with the scores (id, score) as their authority; those without a score keep theirs (SNK-6)."""
    new = scores.select("id", F.col("score").alias("__score"))
    return judgments.join(new, "id", "left").withColumn("authority", F.coalesce("__score", "authority")).drop("__score").select(judgments.columns)


def upsert(stored: DataFrame, incoming: DataFrame, order_by: list[str]) -> DataFrame:
    """Documents after an upsert: the last incoming row of an id replaces the stored one, whose authority stays (SNK-2)."""
    from lexmill.operators.corpus import latest

    new = latest(incoming, ["id"], order_by).drop("authority")
    kept = stored.join(new.select("id"), "id", "left_anti")
    merged = new.join(stored.select("id", "authority"), "id", "left").select(stored.columns)
    return kept.unionByName(merged)


def attestation_stats(claims: DataFrame) -> DataFrame:
    """One row: attestations and distinct signers (AGG-8)."""
    return claims.agg(F.count("*").alias("attestations"), F.count_distinct("signer").alias("signers"))


def conflicting_claims(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """All claims of the pairs whose claims disagree (AGG-14), one row for each claim."""
    return claims.join(conflicts.select("to_doc", "from_doc"), ["to_doc", "from_doc"], "left_semi")
