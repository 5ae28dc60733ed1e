"""Queries over stores that are kept up to date by change: links, tree differences, extraction, encoded graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import hash_tree
from lexmill.operators.adjacency import Adjacency
from lexmill.operators.extraction import Extraction
from lexmill.plans import views
from lexmill.plans.catalog import _HOPS, _query
from lexmill.plans.lookups import _KEYS
from lexmill.plans.views import with_views
from lexmill.session import Scratch, table
from lexmill.streaming.relink import LinkStore

#: The tables of the queries are small: few partitions.
BUCKETS = 8


@_query(with_views("linked", "SELECT from_doc, from_para, citation_key, coalesce(to_doc, -1) AS to_doc FROM linked"))
def links_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All citations after four batches: early citations, some claims, late citations, the other claims (ST-2, SNK-5, JN-4)."""
    citations, claims = views.citations(spark, sf_dir), views.claims(spark, sf_dir)
    store = LinkStore(spark, Scratch(spark, "links").root, BUCKETS)
    store.apply(0, citations.filter("from_para <= 2"))
    store.apply(1, None, claims.filter("doc_id % 3 = 0"))
    store.apply(2, citations.filter("from_para > 2"))
    store.apply(3, None, claims.filter("doc_id % 3 <> 0"))
    return store.links().withColumn("to_doc", F.coalesce("to_doc", F.lit(-1)))


_SNAPSHOTS = """WITH o AS (SELECT sha256(text) AS hash, octet_length(encode(text)) AS size, count(*) AS c FROM documents WHERE doc_id % 50 <> 0 GROUP BY 1, 2),
    n AS (SELECT sha256(t) AS hash, octet_length(encode(t)) AS size, count(*) AS c FROM (SELECT CASE WHEN doc_id % 40 = 1 THEN text || '.' ELSE text END AS t FROM documents WHERE doc_id % 60 <> 0) GROUP BY 1, 2),
    d AS (SELECT hash, size, coalesce(n.c, 0) - coalesce(o.c, 0) AS more FROM o FULL JOIN n USING (hash, size))
    """


def _trees(spark: SparkSession, sf_dir: str) -> tuple[hash_tree.HashTree, hash_tree.HashTree]:
    docs, root = table(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null"), Scratch(spark, "trees").root
    new = docs.filter("doc_id % 60 <> 0").withColumn("text", F.when(F.col("doc_id") % 40 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    shown = lambda rows: rows.select(F.sha2("text", 256).alias("hash"), F.octet_length("text").alias("size"))
    of = lambda rows, name: hash_tree.HashTree(spark, f"{root}/{name}", part_digits=1).build(shown(rows), "hash", "size")
    return of(docs.filter("doc_id % 50 <> 0"), "old"), of(new, "new")


@_query(_SNAPSHOTS + "SELECT hash, size, abs(more) AS copies, CASE WHEN more > 0 THEN 'added' ELSE 'removed' END AS change FROM d WHERE more <> 0")
def tree_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two snapshots of the documents, by descent of their trees (SET-1, ST-5)."""
    return hash_tree.difference(*_trees(spark, sf_dir)).rows


@_query(_SNAPSHOTS + "SELECT count(*) AS added_files, coalesce(sum(size), 0)::BIGINT AS added_bytes FROM d WHERE more > 0")
def tree_delta_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes that the newer snapshot adds (AGG-18)."""
    return hash_tree.delta_bytes(hash_tree.difference(*_trees(spark, sf_dir)).rows)


@_query(with_views("ct", _KEYS + " SELECT from_doc, to_doc, paragraph_count FROM x"))
def edges_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after documents came in two batches, one was taken back and came again, and owners moved between (GRA-7, JN-21)."""
    texts = views.citation_texts(spark, sf_dir).select("id", "idx", "text")
    store = Extraction(spark, Scratch(spark, "extraction").root)
    store.learn(texts)
    claimed = store.places(texts).select("citation_key", F.col("id").alias("doc_id")).distinct()
    owners = claimed.groupBy("citation_key").agg(F.min("doc_id").alias("doc_id"))
    early = claimed.filter("doc_id % 2 = 1").groupBy("citation_key").agg(F.min("doc_id").alias("doc_id"))
    moved = owners.join(early.withColumnRenamed("doc_id", "old"), "citation_key", "left").filter("not (old <=> doc_id)").select("citation_key")
    store.apply(0, early, texts.filter("id % 2 = 1"))
    store.apply(1, owners, texts.filter("id % 2 = 0"), moved=moved)
    some = texts.filter("id % 10 = 3")
    store.apply(2, owners, withdrawn=some.select("id").distinct())
    store.apply(3, owners, some)
    return store.edges()


def _encoded(spark: SparkSession, sf_dir: str) -> Adjacency:
    return Adjacency(spark, Scratch(spark, "adjacency").root).build(views.graph_edges(spark, sf_dir))


@_query(with_views("e", "SELECT src, dst, paragraph_count FROM e WHERE src <> dst AND paragraph_count > 0"))
def encoded_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges, encoded and decoded under its checks (CR-4)."""
    return _encoded(spark, sf_dir).edges()


@_query(with_views("e", ", o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1) SELECT id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM o FULL JOIN i USING (id)"))
def encoded_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degrees of all nodes, from the encoded rows of both ways (GRA-5)."""
    return _encoded(spark, sf_dir).degrees()


@_query(with_views("e", _HOPS.format(hops=2) + " SELECT id, depth FROM best"))
def encoded_khop_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps around one node, from the ranges that hold its neighbours (GRA-4)."""
    return _encoded(spark, sf_dir).neighbourhood(1, 2)
