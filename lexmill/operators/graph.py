"""The citation graph: weighted edges, PageRank and neighbourhoods, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lexmill.session import Scratch, shuffle_partitions

# PageRank, depth factor, tiers in rank order with their weights, the weight of unknown courts.
DAMPING, ITERATIONS = 0.85, 50
DEPTH_STEP, DEPTH_MOST = 0.25, 4
MOST_HOPS = 3
#: Edges of a bucket, at least, while there are fewer buckets than shuffle partitions.
BUCKET_EDGES = 250_000
TIERS = {"apex": 1.00, "appellate": 0.80, "specialist_appellate": 0.65, "high_court": 0.50, "specialist_high": 0.45, "tribunal": 0.20, "lower": 0.10}
FLOOR = 0.10


def depth_factor(paragraphs: Column) -> Column:
    """1 for one citing paragraph, a quarter more for each further one, 2 at most (NUM-1)."""
    return F.lit(1.0) + F.lit(DEPTH_STEP) * F.least(F.greatest(paragraphs - 1, F.lit(0)), F.lit(DEPTH_MOST))


def tier_weight(tier: Column) -> Column:
    """The weight of a tier, the floor for none (NUM-2)."""
    out = F.lit(FLOOR)
    for name, weight in TIERS.items():
        out = F.when(tier == name, F.lit(weight)).otherwise(out)
    return out


def tier_rank(tier: Column) -> Column:
    """0 for the highest tier; unknown ones last (NUM-5)."""
    out = F.lit(len(TIERS))
    for i, name in enumerate(TIERS):
        out = F.when(tier == name, F.lit(i)).otherwise(out)
    return out


def weighted_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, weight of the edges between known nodes: the citing node's tier times depth (GRA-1, JN-7, JN-8)."""
    tiers = nodes.select(F.col("id").alias("src"), tier_weight(F.col("tier")).alias("tier_weight"))
    real = edges.filter("src <> dst").join(tiers, "src").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return real.select("src", "dst", (F.col("tier_weight") * depth_factor(F.col("paragraph_count"))).alias("weight"))


def encoded_edges(edges: DataFrame) -> DataFrame:
    """src, dst, paragraph_count as a graph file holds them: no self edges, no zero counts, of repeated pairs the largest
    count (FLT-10, AGG-13, CR-4)."""
    real = edges.filter("src <> dst and paragraph_count > 0")
    return real.groupBy("src", "dst").agg(F.max("paragraph_count").alias("paragraph_count"))


def unsorted_edges(blob: DataFrame) -> DataFrame:
    """Rows of a graph file (ord, src, dst) that do not come strictly after the one before (WIN-9); none in a canonical one.

    Joined by place, so no window gathers the file.
    """
    before = blob.select((F.col("ord") + 1).alias("ord"), F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    return blob.join(before, "ord").filter((F.col("src") < F.col("__src")) | ((F.col("src") == F.col("__src")) & (F.col("dst") <= F.col("__dst")))).drop("__src", "__dst")


def reextracted_edges(found: DataFrame, owners: DataFrame) -> DataFrame:
    """from_doc, to_doc, paragraph_count of citations found anew in stored text (GRA-7, AGG-17, JN-21).

    found: id, idx, citation_key, as the extractor gives them. owners: citation_key, doc_id. Each distinct key is resolved
    once; keys that nobody owns and citations of the document itself make no edge.
    """
    places = found.select(F.col("id").alias("from_doc"), "idx", "citation_key").distinct()
    linked = places.join(owners.select("citation_key", F.col("doc_id").alias("to_doc")), "citation_key").filter("from_doc <> to_doc")
    return linked.groupBy("from_doc", "to_doc").agg(F.count_distinct("idx").alias("paragraph_count"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """id, score of every node, the highest score 1 (GRA-2).

    edges: src, dst, weight. Dangling mass spreads evenly. Edges are computed once and written in buckets by source, and
    nodes and scores in as many buckets by id, so an iteration shuffles the partial sums by target alone: a join of edges and
    scores bucket by bucket, the sums, a join with the nodes, and a written table, which cuts the lineage without local
    checkpoints. Scores are hashed and edges stream past them, so no iteration sorts the edges. The dangling sum of the
    next iteration is observed while the scores are written.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    scratch = Scratch(spark, "pagerank")
    plain = scratch.write(edges.select("src", "dst", "weight"), "edges")
    edges = scratch.read(plain, edges.select("src", "dst", "weight").schema)
    buckets = min(shuffle_partitions(spark), -(-edges.count() // BUCKET_EDGES) or 1)
    edges = scratch.bucketed(edges.repartition(buckets, "src"), "bucketed", "src", buckets)
    scratch.drop(plain)
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("out_weight")).withColumn("d", F.lit(False))
    every = nodes.select("id").repartition(buckets, "id").join(out, "id", "left").select("id", "out_weight", F.coalesce("d", F.lit(True)).alias("dangling"))
    every = scratch.bucketed(every, "nodes", "id", buckets)
    scores = every.withColumn("score", F.lit(1.0 / n))
    for i in range(iterations + 1):
        seen = Observation()
        loose = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0)).alias("loose")
        scores = scratch.bucketed(scores.observe(seen, loose, F.max("score").alias("top")), f"scores{i}", "id", buckets)
        if i == iterations:
            break
        spread = (1 - damping) / n + damping * seen.get["loose"] / n
        given = scores.filter(~F.col("dangling")).select(F.col("id").alias("src"), (F.col("score") / F.col("out_weight")).alias("given"))
        got = edges.join(given.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("given") * F.col("weight")).alias("got"))
        scores = every.join(got.hint("shuffle_hash"), "id", "left").select("id", "out_weight", "dangling", (F.lit(spread) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("score"))
    top, schema = seen.get["top"], scores.schema
    last = scratch.read(f"{scratch.root}/{scratch._n:03d}-scores{iterations}", schema)
    scratch.forget()
    return last.select("id", (F.col("score") / F.lit(top)).alias("score"))


def neighbourhood(edges: DataFrame, centre, hops: int = 1) -> DataFrame:
    """id, depth of the nodes within ``hops`` (at most 3) of ``centre``, in either direction (GRA-4, JN-10)."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).filter("src <> dst")
    seen = both.filter(F.col("src") == centre).select(F.col("src").alias("id")).distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, min(hops, MOST_HOPS) + 1):
        step = both.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.union(frontier)
    return seen


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (JN-11)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)
