"""Retrieval over described indexes: descriptors, their vectors, hybrid hits with the metadata of their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators import retrieval, search
from lexmill.operators.corpus import clamp, length_prefixed


def descriptor_id(*fields: Column) -> Column:
    """The name of an index: a hash of all that its vectors depend on (VEC-7)."""
    return F.sha2(length_prefixed(*fields), 256)


def with_latest(descriptors: DataFrame, by: str = "model") -> DataFrame:
    """``descriptors`` with ``latest``: the last built of each model, ties to the larger id (WIN-6, ORD-14)."""
    order = Window.partitionBy(by).orderBy(F.desc("built_at"), F.desc("descriptor_id"))
    return descriptors.withColumn("latest", F.row_number().over(order) == 1)


def with_staleness(descriptors: DataFrame, root: DataFrame) -> DataFrame:
    """``descriptors`` with ``stale``: whether they were built from another corpus than ``root`` (one row) tells (VEC-7, ST-6)."""
    return descriptors.crossJoin(F.broadcast(root.select(F.col("root").alias("__now")))).withColumn("stale", F.col("corpus_root") != F.col("__now")).drop("__now")


def chunk_counts(vectors: DataFrame) -> DataFrame:
    """descriptor_id, chunk_count (AGG-22)."""
    return vectors.groupBy("descriptor_id").agg(F.count("*").alias("chunk_count"))


def build_index(chunks: DataFrame, descriptor: str, dimension: int, embed) -> DataFrame:
    """descriptor_id, doc_id, para_index, vector: unit vectors of one dimension, which must be ``dimension`` (SNK-8).

    ``embed`` is an extension point: a function from a text column to a vector column. A vector of another size is an error.
    """
    raw = chunks.withColumn("vector", embed(F.col("text")))
    # The lambda has the finished vector, whose expression would else be repeated for its size and each of its numbers.
    once = F.get(F.transform(F.array("vector"), lambda v: F.when(F.size(v) == dimension, retrieval.unit(v)).otherwise(F.raise_error(F.lit(f"an embedding that has not {dimension} numbers")))), F.lit(0))
    return raw.select(F.lit(descriptor).alias("descriptor_id"), "doc_id", "para_index", once.alias("vector"))


#: The embedder that is known by its name and dimension alone.
HASHED = "feature-hash"


def query_embedder(embedder: str, dimension: int, remote: dict | None = None):
    """A function from a text column to a vector column, in the space that a descriptor names (VEC-6); null if there is none.

    Hashed embeddings follow from the descriptor. For others ``remote`` has, by name, a function from a dimension to such a
    function; without one retrieval has words alone, never vectors of another space.
    """
    if embedder == HASHED:
        return lambda text: retrieval.hashed_embedding(text, dimension)
    make = (remote or {}).get(embedder)
    return None if make is None else make(dimension)


def hits_of_latest(descriptors: DataFrame, vectors: DataFrame, chunks: DataFrame, query: str, nodes: DataFrame, courts: DataFrame, k: int = 10, model: str | None = None, remote: dict | None = None) -> tuple[DataFrame, str]:
    """Hits and the mode they were found in, over the last index that was built (VEC-9, ORD-14).

    descriptors: descriptor_id, model, dimension, built_at. vectors: descriptor_id, chunk_id, vector. Without a descriptor, or without an
    embedder for it, only words count.
    """
    held = with_latest(descriptors).filter("latest")
    held = held if model is None else held.filter(F.col("model") == model)
    last = held.orderBy(F.desc("built_at"), F.desc("descriptor_id")).first()
    embed = None if last is None else query_embedder(last["model"], last["dimension"], remote)
    own = None if embed is None else vectors.filter(F.col("descriptor_id") == last["descriptor_id"]).select("chunk_id", "vector")
    found = hybrid_hits(chunks, own, query, None if embed is None else embed(F.lit(query)), nodes, courts, k)
    words = found.filter("keyword_rank is not null").limit(1).count() if embed is not None else 1
    return found, retrieval.mode(words, embed is not None)


def replace_index(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index table after a build: one descriptor's rows are replaced as a whole, others stay (SNK-8)."""
    return stored.join(F.broadcast(fresh.select("descriptor_id").limit(1)), "descriptor_id", "left_anti").unionByName(fresh)


def hybrid_hits(chunks: DataFrame, vectors: DataFrame | None, query: str, query_vector: Column | None, nodes: DataFrame, courts: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` chunks by fused ranks, with the metadata of their documents (VEC-9, JN-14, JN-15, PRJ-2).

    chunks: chunk_id, doc_id, para_index, text. vectors: chunk_id, vector of one descriptor (FLT-6), or None: then, as without
    a query vector, only words count. nodes: id and metadata, courts: code and name; missing ones leave nulls. Both
    lists are bounded before they are ranked, by values of nine places, so that ties are ties; a ranked chunk that the store no
    longer holds is dropped.
    """
    k = clamp(k, 1, 100, 10)
    most = retrieval.candidates(k)
    keyword = search.bm25(chunks.withColumn("id", F.col("chunk_id")), query).select("chunk_id", F.round("bm25", 9).alias("bm25")).orderBy("bm25", "chunk_id").limit(most) if search.sanitise(query) else chunks.select("chunk_id", F.lit(0.0).alias("bm25")).limit(0)
    if vectors is None or query_vector is None:
        near = chunks.select("chunk_id", F.lit(0.0).alias("similarity")).limit(0)
    else:
        # The query's vector is computed once, as a row, and stands in the scan as a literal.
        numbers = chunks.sparkSession.range(1).select(retrieval.unit(query_vector).alias("v")).first()["v"]
        query_unit = F.array(*[F.lit(x) for x in numbers])
        fits = vectors.filter(F.size("vector") == len(numbers))
        near = fits.select("chunk_id", F.round(retrieval.dot(F.col("vector"), query_unit), 9).alias("similarity")).orderBy(F.desc("similarity"), "chunk_id").limit(most)
    fused = retrieval.fuse(retrieval.ranks(keyword, "bm25", "chunk_id"), retrieval.ranks(near, F.desc("similarity"), "chunk_id"), k)
    hits = chunks.select("chunk_id", "doc_id", "para_index", "text").join(F.broadcast(fused), "chunk_id")
    about = nodes.select(F.col("id").alias("doc_id"), "title", "court", "date").join(F.broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    names = courts.select(F.col("code").alias("court"), F.col("name").alias("court_name"))
    return hits.join(about, "doc_id", "left").join(F.broadcast(names), "court", "left").withColumn("court_name", F.coalesce("court_name", "court"))
