"""Exact top-k search by Fagin's threshold algorithm.

The vectors are dealt into blocks. In a block every dimension has its entries sorted by value, and queries are
answered in blocks too: for a query the lists are read in parallel from their best end (the largest values for a
positive weight, the smallest for a negative one), every vector met is scored exactly, and reading stops when the
sum of the weighted values at the present depth, which bounds every vector not yet met, is below the k-th best
score. One block is searched first: its k-th best score is a floor for the search of the others, which then stop
earlier and return nothing below it. The best k of the blocks meet in one window by query.

The bound is only as good as the lists are steep: with many dimensions of like weight, most vectors are met before it
falls below the k-th score (the README has figures); results are exact either way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import Scratch, table

#: Most vectors in a block (on average), fewest blocks, and queries that are answered together over a block.
BLOCK_ROWS, LEAST_BLOCKS, QUERY_ROWS = 8192, 32, 2048
#: Entries that are read from each list at a time, at most, and as a share of a block's vectors.
DEPTH_STEP, STEP_SHARE = 48, 32
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class SortedLists:
    """The vectors of one block, sorted by id, with one sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)  # ascending
        self.values = np.take_along_axis(self.vectors, self.lists.astype(np.int64), axis=0)
        self.top = max(int(self.vectors.max(initial=0)), -int(self.vectors.min(initial=0)))
        self.floats = self.vectors.astype(np.float64)

    def products(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products: by floats while every sum of products is a whole number below 2**53, of Python's whole numbers where 63 bits are too few."""
        most = self.top * max(int(query.max(initial=0)), -int(query.min(initial=0))) * max(len(query), 1)
        if most < 1 << 53:
            return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
        if most <= MOST:
            return rows @ query
        return np.array([sum(a * b for a, b in zip(row, query.tolist(), strict=True)) for row in rows.tolist()], dtype=object)

    def search(self, query_id: int, query: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(rows, scores, depth, vectors scored): the k best other than the query's own id, ties to the smaller id; none below ``floor``."""
        n = len(self.vectors)
        used = np.flatnonzero(query)
        seen = np.zeros(n, dtype=bool)
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)
        depth, scored = 0, 0
        up = query[used] < 0
        falling, rising = used[~up], used[up]
        while depth < n:
            upto = min(n, depth + min(DEPTH_STEP, max(1, n // STEP_SHARE)))
            met = np.zeros(n, dtype=bool)
            met[self.lists[n - upto : n - depth, falling]] = True
            met[self.lists[depth:upto, rising]] = True
            if not len(used):
                met[depth:upto] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            depth, scored = upto, scored + len(fresh)
            fresh = fresh[self.ids[fresh] != query_id]
            own = self.products(self.vectors[fresh], query)
            if floor is not None:
                fresh, own = fresh[own >= floor], own[own >= floor]
            rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, own])
            if len(rows) > k:
                best = np.lexsort((rows, -scores))[:k]
                rows, scores = rows[best], scores[best]
            least = scores.min() if len(rows) >= k else floor
            if depth < n and least is not None and len(used):
                edge = np.where(up, self.values[depth - 1, used], self.values[n - depth, used])
                if self.products(edge[None], query[used])[0] < least:
                    break
        best = np.lexsort((rows, -scores))[:k]
        return rows[best], scores[best], depth, scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """query_id, rank (from 1), id, score, depth (entries read from each list) and scored (vectors scored in that block) of each query's k best vectors.

    Both inputs have an id (long) and a vector (array of long); other columns are left aside. A query never finds
    rows of its own id. Scores are exact inner products, whatever their size, within a block; between blocks, and in the
    result, those beyond 64 bits stand as the nearest 64-bit number. Equal scores go to the smaller id. Fewer than k
    rows come back where there are fewer candidates. Null ids, null vectors and vectors with null components take
    no part; vectors of another length than the query's do not meet it. Repeated rows of one id count as rows; a query row
    that is repeated has its whole list as often as it stands, and so has each of several queries of one id.
    Empty inputs give an empty result.
    """
    plain = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v")).filter("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)").withColumn("dims", F.size("v"))
    scratch = Scratch(vectors.sparkSession, "topk")
    vectors, queries = plain(vectors), plain(queries)
    # Each distinct query is searched once, under a number of its own.
    queries = queries.groupBy("id", "v", "dims").agg(F.count("*").alias("copies")).withColumn("query", F.monotonically_increasing_id())
    queries = scratch.table(queries, "queries")
    n, q = vectors.count(), queries.count()
    blocks, query_blocks = max(LEAST_BLOCKS, -(-n // BLOCK_ROWS)), max(1, -(-q // QUERY_ROWS))

    def cells(df: DataFrame, own: str, other: str, own_n: int, other_n: int) -> DataFrame:
        """Each row with its own block, once for every block of the other side."""
        mine = F.pmod(F.xxhash64("id", "v"), F.lit(own_n)).cast("int")
        return df.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    left = cells(vectors, "block", "query_block", blocks, query_blocks)
    right = cells(queries, "query_block", "block", query_blocks, blocks)

    def search(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(found) and len(asked):
            lists = SortedLists(found["id"].to_numpy(dtype=np.int64), np.stack(found["v"].to_numpy()).astype(np.int64))
            for number, query_id, query, floor in zip(asked["query"], asked["id"], asked["v"], asked["floor"].astype(object), strict=True):
                rows, scores, depth, scored = lists.search(query_id, np.asarray(query, dtype=np.int64), k, None if pd.isna(floor) or floor in (LEAST, MOST) else int(floor))
                out += [(number, int(lists.ids[r]), min(max(int(s), LEAST), MOST), depth, scored) for r, s in zip(rows, scores, strict=True)]
        return pd.DataFrame(out, columns=["query", "id", "score", "depth", "scored"])

    by = ["block", "query_block", "dims"]
    best_of = lambda df: df.groupBy(*by).cogroup
    schema = "query long, id long, score long, depth int, scored int"
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = best_of(left.filter("block = 0"))(right.filter("block = 0").withColumn("floor", F.lit(None).cast("string")).groupBy(*by)).applyInPandas(search, schema)
    first = scratch.table(first, "first")
    floors = ranked(first).filter(F.col("rank") == k).select("query", F.col("score").cast("string").alias("floor"))
    rest = best_of(left.filter("block > 0"))(right.filter("block > 0").join(floors, "query", "left").groupBy(*by)).applyInPandas(search, schema)
    best = ranked(first.union(rest)).join(queries.select("query", F.col("id").alias("query_id"), "copies"), "query")
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return best.select("query_id", "rank", "id", "score", "depth", "scored")


def whole_numbers(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """id and vector of whole numbers, floor(scale * x), at most 64 bits (larger ones stand as the nearest); vectors with null or non-finite components go."""
    bad = "embedding is null or exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return embeddings.filter(f"vec_id is not null and not ({bad})").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("vector")
    )


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of ``embeddings`` for every vector whose id is divisible by 100."""
    vectors = whole_numbers(table(spark, sf_dir, "embeddings"))
    found = top_k(vectors, vectors.filter("id % 100 = 0"), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM (SELECT *, row_number() OVER () AS number FROM e WHERE vec_id % 100 = 0) q JOIN e c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS k FROM s)
WHERE k <= 10
"""
