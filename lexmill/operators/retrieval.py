"""Vector and hybrid retrieval: chunks, hashed embeddings, exact cosine lists and reciprocal rank fusion."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import word_tokens

# The fusion constant, candidates per list, the dimension of hashed embeddings.
RRF, OVERFETCH, LEAST_CANDIDATES, DIMENSION = 60, 8, 64, 256


def candidates(k: int) -> int:
    """Candidates that each list contributes to the best ``k``."""
    return max(OVERFETCH * k, LEAST_CANDIDATES)


def chunks(docs: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """doc_id, para_index, text of every paragraph that is not blank (FLT-9, PRJ-4)."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("para_index", "text"))
    return lines.filter(~F.col("text").rlike(r"^(?U)\s*$"))


def dot(a: Column, b: Column) -> Column:
    """Inner product (VEC-2)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays (VEC-1)."""

    def over(w: Column) -> Column:
        """The lambda has the finished length, which would else be computed anew for each number."""
        scaled = lambda norm: F.when(norm > 0, F.transform(w, lambda x: x.cast("double") / norm)).otherwise(F.transform(w, lambda x: x.cast("double")))
        return F.get(F.transform(F.array(F.sqrt(dot(w, w))), scaled), F.lit(0))

    return F.get(F.transform(F.array(v), over), F.lit(0))


def cosine_top(vectors: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """id, similarity of the best ``k`` (VEC-3, ORD-11): an exact scan; Spark keeps k rows for each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = dot(unit(F.col(vector)), unit(q))
    rows = vectors.filter(F.size(vector) == len(query)).select(F.col(id_col), sim.alias("similarity"))
    return rows.orderBy(F.desc("similarity"), id_col).limit(k)


def ranks(best: DataFrame, *order) -> DataFrame:
    """A bounded list with its 1-based ``rank`` (WIN-1, WIN-2); the window sees one list of candidates."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(keyword: DataFrame, vector: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """id, score, keyword_rank, vector_rank of the best ``k`` by the sum of 1 / (60 + rank) (WIN-3, JN-13, ORD-12)."""
    both = keyword.select(id_col, F.col("rank").alias("keyword_rank")).join(vector.select(id_col, F.col("rank").alias("vector_rank")), id_col, "full")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF) + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part("keyword_rank") + part("vector_rank")).orderBy(F.desc("score"), id_col).limit(k)


def mode(keyword: int, has_vector: bool) -> str:
    """keyword-only without a query vector; vector-only without keyword hits; else hybrid."""
    return "keyword-only" if not has_vector else "vector-only" if not keyword else "hybrid"


def hashed_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """A vector of hashed words (VEC-4): SHA-256 gives each word a bucket and a sign; the sum has length one.

    The bucket comes from the first seven hex digits, the sign from the parity of the eighth. A batch hashes each of its words once.
    """

    @F.arrow_udf("array<double>")
    def summed(words: pa.Array) -> pa.Array:
        coded = words.flatten().dictionary_encode()
        digits = np.frombuffer(b"".join(hashlib.sha256(w.encode()).digest()[:4] for w in coded.dictionary.to_pylist()), dtype=">u4").astype(np.int64)
        bucket, sign = (digits >> 4) % dimension, np.where(digits % 2 == 0, 1.0, -1.0)
        code, n = coded.indices.to_numpy(), len(words)
        row = np.repeat(np.arange(n), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        sums = np.bincount(row * dimension + bucket[code], sign[code], n * dimension).astype(np.float64)
        missing = np.repeat(words.is_null().to_numpy(zero_copy_only=False), dimension)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dimension), pa.array(sums, mask=missing))

    return unit(summed(word_tokens(text)))


def embed_chunks(rows: DataFrame, text: str = "text", dimension: int = DIMENSION) -> DataFrame:
    """doc_id, para_index, bucket, value: the sparse form of hashed embeddings, by one aggregate (SNK-8)."""
    words = rows.select("doc_id", "para_index", F.explode(word_tokens(F.col(text))).alias("w"))
    h = F.sha2("w", 256)
    bucket = (F.conv(F.substring(h, 1, 7), 16, 10).cast("int") % dimension).alias("bucket")
    sign = F.when(F.conv(F.substring(h, 8, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return words.groupBy("doc_id", "para_index", bucket).agg(F.sum(sign).alias("value")).filter("value <> 0")
