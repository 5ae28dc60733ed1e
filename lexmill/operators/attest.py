"""Signed claims about how one document treats another: conflicts, currency and reader trust."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Treatments in their order, and the adverse ones.
TREATMENTS = ("followed", "applied", "distinguished", "criticised", "overruled")
ADVERSE = ("overruled", "criticised")


def treatment(value: Column) -> Column:
    """The named treatment, with the other spelling of one; null if unreadable (TR-1)."""
    low = F.lower(F.trim(value))
    low = F.when(low == "criticized", "criticised").otherwise(low)
    return F.when(low.isin(*TREATMENTS), low)


def treatment_order(value: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TREATMENTS]), value)


def distinct_claims(rows: DataFrame) -> DataFrame:
    """One claim for each (signer, signature): the smallest id (SNK-7, AGG-19, ST-4)."""
    return rows.groupBy("signer", "signature").agg(F.min(F.struct("id", *[c for c in rows.columns if c not in ("id", "signer", "signature")])).alias("r")).select("signer", "signature", "r.*").select(rows.columns)


def clamp_weight(weight: Column) -> Column:
    """A finite weight within 0 and 1, else 0 (NUM-3)."""
    w = weight.cast("double")
    return F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), 0.0).otherwise(F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)))


def weighted(claims: DataFrame, policy: DataFrame, unlisted: float = 0.0) -> DataFrame:
    """``claims`` with their reader's weight (JN-19, TR-3): the policy's first entry for a signer, else ``unlisted``.

    policy: ord, key, weight. Weights never filter or reorder claims.
    """
    first = policy.groupBy(F.lower("key").alias("__key")).agg(F.min_by("weight", "ord").alias("__w"))
    joined = claims.join(first, F.lower("signer") == F.col("__key"), "left")
    return joined.withColumn("weight", F.when(F.col("__key").isNull(), F.lit(unlisted)).otherwise(clamp_weight(F.col("__w")))).drop("__key", "__w")


def conflicts(claims: DataFrame) -> DataFrame:
    """to_doc, from_doc, treatments (in their order), claims: pairs with more than one treatment (AGG-14, TR-4).

    Treatments are aggregated as five flags, so a pair with very many claims stays one small row.
    """
    flags = [F.max((F.col("treatment") == t).cast("int")).alias(t) for t in TREATMENTS]
    pairs = claims.groupBy("to_doc", "from_doc").agg(F.count("*").alias("claims"), *flags)
    kinds = F.filter(F.array(*[F.when(F.col(t) == 1, t) for t in TREATMENTS]), lambda x: x.isNotNull())
    return pairs.withColumn("treatments", kinds).filter(F.size("treatments") > 1).select("to_doc", "from_doc", "treatments", "claims")


def currency(claims: DataFrame) -> DataFrame:
    """Each cited document's claims, adverse and overruling ones, signers, weights, contested flag and signal (AGG-15, TR-5).

    The signal of a document with claims is ``no_adverse_attestation``, else ``adverse_weighted`` if the reader weighs a
    signer of an adverse claim above zero, else ``adverse_unweighted``. Contested: about one pair some claim is
    adverse and some is not.
    """
    adverse = F.col("treatment").isin(*ADVERSE)
    pair = claims.groupBy("to_doc", "from_doc").agg(
        F.count("*").alias("n"), F.count_if(adverse).alias("a"), F.count_if(F.col("treatment") == "overruled").alias("o"),
        F.sum("weight").alias("w"), F.sum(F.when(adverse, F.col("weight")).otherwise(0.0)).alias("aw"),
    )
    total = pair.groupBy("to_doc").agg(
        F.sum("n").alias("claims"), F.sum("a").alias("adverse"), F.sum("o").alias("overruled"), F.round(F.sum("w"), 6).alias("weight"),
        F.round(F.sum("aw"), 6).alias("adverse_weight"), F.max((F.col("a") > 0) & (F.col("a") < F.col("n"))).alias("contested"),
    )
    signers = claims.groupBy("to_doc").agg(F.count_distinct("signer").alias("signers"))
    signal = F.when(F.col("adverse") == 0, "no_adverse_attestation").when(F.col("adverse_weight") > 0, "adverse_weighted").otherwise("adverse_unweighted")
    return total.join(signers, "to_doc").withColumn("signal", signal)


def currency_of(documents: DataFrame, report: DataFrame, holds_any: bool) -> DataFrame:
    """``report`` for given documents (to_doc), those without claims included (TR-6)."""
    none = "none_about_this_judgment" if holds_any else "no_attestations_held"
    return documents.join(report, "to_doc", "left").withColumn("signal", F.coalesce("signal", F.lit(none)))


def mechanical_support(claims: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``claims`` with what the graph holds of their pair (JN-18)."""
    known = lambda c: nodes.select(F.col("id").alias(c), F.lit(True).alias(f"__{c}"))
    edge = edges.select("from_doc", "to_doc", F.lit(True).alias("__edge"))
    out = claims.join(edge, ["from_doc", "to_doc"], "left").join(known("from_doc"), "from_doc", "left").join(known("to_doc"), "to_doc", "left")
    label = F.when(F.col("__from_doc").isNull(), "citing_judgment_not_held").when(F.col("__to_doc").isNull(), "cited_judgment_not_held").when(F.col("__edge"), "edge").otherwise("no_edge_in_this_corpus")
    return out.withColumn("support", label).select(*claims.columns, "support")


def signing_bytes(domain: str, *fields: Column) -> Column:
    """What a signature covers (CR-1): a domain line, then each field behind its length as eight bytes, high byte first."""
    raw = [F.encode(F.coalesce(f.cast("string"), F.lit("")), "UTF-8") for f in fields]
    return F.concat(F.encode(F.lit(domain + "\n"), "UTF-8"), *[F.concat(F.unhex(F.lpad(F.hex(F.octet_length(r).cast("long")), 16, "0")), r) for r in raw])


def key_fault(key: Column, digits: int) -> Column:
    """Why a hex key or signature cannot be read (CR-9): missing, not_hex or wrong_length; null if it can."""
    return F.when(key.isNull() | (key == ""), "missing").when(~key.rlike("^[0-9a-fA-F]*$"), "not_hex").when(F.length(key) != digits, "wrong_length")


def parse_policy(text: str, unlisted: float = 0.0) -> tuple[list[tuple[int, str, float]], float]:
    """A reader's policy from a request (NUM-4, TR-7, TR-8): rows (ord, key, weight) and the weight of signers that it does not name.

    ``key:weight`` parts between commas; a missing or unreadable weight is 1, weights are clamped to 0 and 1, keys are
    lower-cased, parts without a key of 64 hex digits go. An empty text is the empty policy.
    """

    def number(value: str, default: float) -> float:
        try:
            w = float(value)
        except ValueError:
            return default
        return min(max(w, 0.0), 1.0) if w == w and abs(w) != float("inf") else 0.0

    rows = []
    for part in (text or "").split(","):
        key, _, weight = part.strip().partition(":")
        if re.fullmatch("[0-9a-fA-F]{64}", key.strip()):
            rows.append((len(rows), key.strip().lower(), number(weight, 1.0)))
    return rows, number(str(unlisted), 0.0)


def treatment_view(claims: DataFrame, doc_id, policy: DataFrame, unlisted: float = 0.0) -> DataFrame:
    """The claims about one document with their reader's weights, in the order of the store (TR-6)."""
    about = claims.filter(F.col("to_doc") == doc_id)
    return weighted(about, policy, unlisted).orderBy("created_at", "signer", "from_doc", "treatment", "signature")


def request_policy(trust: str | None, unlisted=None, node: tuple[list[tuple[int, str, float]], float] = ((), 0.0)) -> tuple[list[tuple[int, str, float]], float, str]:
    """The policy that a request reads under (TR-7): rows, the weight of signers that they do not name, and where it comes from.

    A request's own ``trust`` replaces the node's policy outright, weights are never merged, and only then is its ``unlisted`` heard
    (an unreadable one is as if it were not given). Else the node's holds (``node``), or, if that is empty, ``none``.
    """
    if trust is not None:
        rows, rest = parse_policy(trust)
        try:
            return rows, rest if unlisted is None else parse_policy("", float(unlisted))[1], "request"
        except (TypeError, ValueError):
            return rows, rest, "request"
    return list(node[0]), node[1], "node" if node[0] else "none"


def treatment_report(claims: DataFrame, doc_id, policy: tuple[list[tuple[int, str, float]], float, str], edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole view of one document's treatment (TR-6, TR-7): its claims in order, and one row that sums them up.

    claims: as stored, with signature and created_at. policy: of ``request_policy``. A claim has its reader's weight, whether the
    policy lists its signer, whether it is adverse, and what the graph (edges: from_doc, to_doc; nodes: id) holds of its pair.
    The row has the counts and signal of ``currency_of`` and the origin of the policy.
    """
    spark, (rows, unlisted, origin) = claims.sparkSession, policy
    table = spark.createDataFrame(rows, "ord int, key string, weight double")
    about = weighted(claims.filter(F.col("to_doc") == doc_id), table, unlisted)
    listed = table.select(F.lower("key").alias("signer_key"), F.lit(True).alias("listed")).distinct()
    shown = mechanical_support(about, edges, nodes).join(F.broadcast(listed), F.lower("signer") == F.col("signer_key"), "left").drop("signer_key")
    shown = shown.withColumns({"listed": F.coalesce("listed", F.lit(False)), "adverse": F.col("treatment").isin(*ADVERSE)})
    one = claims.sparkSession.range(1).select(F.lit(doc_id).alias("to_doc"))
    summed = currency_of(one, currency(about), bool(claims.limit(1).count())).withColumn("policy", F.lit(origin))
    return shown.orderBy("created_at", "signer", "from_doc", "treatment", "signature"), summed


def tallies(claims: DataFrame) -> DataFrame:
    """examined, verified, rejected, unreadable over a ``status`` column (AGG-16)."""
    return claims.agg(F.count("*").alias("examined"), *[F.count_if(F.col("status") == s).alias(s) for s in ("verified", "rejected", "unreadable")])
