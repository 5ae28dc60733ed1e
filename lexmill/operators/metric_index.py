"""Exact cosine search with stored distances: vectors in groups around pivots, groups and rows skipped by the triangle inequality.

On vectors of length one the cosine falls as the distance grows, cos = 1 - d^2 / 2, so the most similar are the nearest. Each vector
lies in the group of its nearest pivot with its distance from it, in the order of these distances; a group of many rows
has several parts. A query knows its distances from all pivots; once it has k results, the k-th bounds how far a nearer
vector's distance from a pivot can be from its own, which rules out whole parts, and of others all rows outside a run.

The pivots are a bounded sample (PIVOTS vectors of the smallest hashes). All queries of a batch are answered together, and every
vector is indexed. How much a search reads depends on the data: independent directions of many dimensions are all equally far
from every pivot, and then all parts are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import Scratch

#: Pivots, rows of a part (about), and queries that meet a part at once.
PIVOTS, PART_ROWS, QUERY_ROWS = 128, 8192, 4096
#: Distances are sums of doubles.
SLACK = 1e-9
_PARTS = "pivot int, part int, low double, high double, n long"


def _grid(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.square(x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class MetricIndex:
    """Vectors of one length in a folder; a query of another length finds nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, vectors: DataFrame, id_col: str = "chunk_id", vector: str = "vector", pivots: int = PIVOTS, part_rows: int = PART_ROWS) -> MetricIndex:
        """Write the index of the vectors (id long, array of numbers) that have the length of most; zero vectors are similar to nothing
        and stand at distance one; vectors that are null or hold nulls or non-finite numbers are left out."""
        good = f"`{vector}` is not null and size(`{vector}`) > 0 and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        rows = vectors.filter(good).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        self.dims, total = (sizes["d"], sizes["n"]) if sizes else (0, 0)
        rows = rows.filter(F.size("v") == self.dims)
        hashed = rows.filter("exists(v, x -> x <> 0)").select("v", F.xxhash64("v").alias("h")).filter(F.pmod("h", F.lit(max(1, total // (4 * pivots)))) == 0)
        picked = [r.v for r in hashed.distinct().orderBy("h").limit(pivots).collect()]
        self.pivots = _unit(np.array(picked, dtype=np.float64).reshape(-1, max(self.dims, 1))) if picked else np.zeros((1, max(self.dims, 1)))
        told = self.spark.sparkContext.broadcast(self.pivots)

        @F.pandas_udf("struct<pivot:int,far:double>")
        def nearest(v: pd.Series) -> pd.DataFrame:
            far = _distances(_unit(_grid(v)), told.value)
            best = far.argmin(axis=1)
            return pd.DataFrame({"pivot": best.astype(np.int32), "far": far[np.arange(len(far)), best]})

        held = Scratch(self.spark, "metric").table(rows.withColumn("p", nearest("v")).select("id", "v", "p.*"), "placed")
        counts = held.groupBy("pivot").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
        # Parts of a group are runs of its distances: cut where a sketch of their quantiles says.
        cuts = held.groupBy("pivot").agg(F.percentile_approx("far", F.lit([i / 64 for i in range(1, 64)]), 1000).alias("cuts"))
        dealt = held.join(counts, "pivot").join(cuts, "pivot")
        rank = F.size(F.filter("cuts", lambda c: c < F.col("far")))
        spread = F.pmod(F.xxhash64("id"), F.greatest(F.ceil(F.col("parts") / 64), F.lit(1)))  # beyond 64 runs by a hash
        dealt = dealt.withColumn("part", (F.floor(rank * F.least("parts", F.lit(64)) / 64) + 64 * spread).cast("int")).select("id", "v", "pivot", "part", "far")
        dealt.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "far", "id").write.mode("overwrite").parquet(f"{self.folder}/vectors")
        self.vectors().groupBy("pivot", "part").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/parts")
        return self

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("id long, v array<double>, pivot int, part int, far double").parquet(f"{self.folder}/vectors")

    def parts(self) -> DataFrame:
        return self.spark.read.schema(_PARTS).parquet(f"{self.folder}/parts")

    def _compared(self, asked: DataFrame, k: int) -> DataFrame:
        """query, id, similarity (null in a row that counts, in ``read``, the rows compared) from the parts that are asked."""
        pivots = self.spark.sparkContext.broadcast(self.pivots)

        def search(held: pa.Table, asked: pa.Table) -> pa.Table:
            out = {"query": [], "id": [], "similarity": [], "read": []}
            if held.num_rows and asked.num_rows:
                held = held.sort_by([("far", "ascending"), ("id", "ascending")])
                dims = len(held.column("v")[0])
                grid = _unit(held.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims))
                far, ids = held.column("far").to_numpy(), held.column("id").to_numpy()
                pivot = pivots.value[held.column("pivot")[0].as_py()]
                for number, v, within in zip(asked.column("query").to_pylist(), asked.column("v").to_pylist(), asked.column("within").to_pylist(), strict=True):
                    q = _unit(np.array([v]))
                    own = _distances(q, pivot[None])[0, 0]
                    a, b = np.searchsorted(far, [own - within - SLACK, own + within + SLACK], side="left")
                    cosine = (grid[a:b] * q).sum(axis=1)
                    best = np.lexsort((ids[a:b], -cosine))[:k]
                    out["query"] += [number] * (len(best) + 1)
                    out["id"] += [*ids[a:b][best].tolist(), None]
                    out["similarity"] += [*cosine[best].tolist(), None]
                    out["read"] += [None] * len(best) + [int(b - a)]
            kinds = {"query": pa.int64(), "id": pa.int64(), "similarity": pa.float64(), "read": pa.int64()}
            return pa.table({name: pa.array(values, kinds[name]) for name, values in out.items()})

        cell = ["pivot", "part", "block"]
        cells = asked.select(*(F.col(c).alias(c) for c in cell)).distinct()
        return self.vectors().join(cells, ["pivot", "part"]).groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(search, "query long, id long, similarity double, read long")

    def search(self, queries: DataFrame, k: int, id_col: str = "query_id", vector: str = "vector") -> DataFrame:
        """query_id, rank, id, similarity, read of each query's k most similar (VEC-3, ORD-11), the same as a scan of all vectors.

        Equal similarities go to the smaller id. ``read`` says how many vectors the query was compared with. A zero query is
        similar to all by 0. Queries with the same id are answered as one, by any one of them.
        """
        scratch, told = Scratch(self.spark, "metric"), self.spark.sparkContext.broadcast(self.pivots)
        parts = self.parts().collect()  # a row for each part
        bounds = self.spark.sparkContext.broadcast([np.array([r[c] for r in parts]) for c in ("pivot", "low", "high")])
        fits = queries.filter(F.size(vector) == self.dims).select(F.col(id_col).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["query"])
        blocks = max(1, -(-fits.count() // QUERY_ROWS))
        fits = scratch.table(fits.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), "queries")

        def reached(home: bool):
            @F.pandas_udf("array<int>")
            def which(v: pd.Series, within: pd.Series) -> pd.Series:
                pivot, low, high = bounds.value
                far = _distances(_unit(_grid(v)), told.value)[:, pivot] if len(pivot) else np.zeros((len(v), 0))
                least = np.maximum(np.maximum(low - far, far - high), 0)
                if home:  # the part of the least bound, of these the nearest pivot's
                    return pd.Series([np.lexsort((f, x))[:1].astype(np.int32) for f, x in zip(far, least, strict=True)])
                return pd.Series([np.flatnonzero(x <= w + SLACK).astype(np.int32) for x, w in zip(least, within, strict=True)])

            return which

        place = F.array(*[F.struct(F.lit(r.pivot).alias("pivot"), F.lit(r["part"]).alias("part")) for r in parts]) if len(parts) <= 1000 else None
        table = self.spark.createDataFrame([(i, r.pivot, r["part"]) for i, r in enumerate(parts)], "at int, pivot int, part int")

        def cells(rows: DataFrame, home: bool) -> DataFrame:
            rows = rows.withColumn("at", F.explode(reached(home)("v", "within")))
            return rows.withColumn("c", F.get(place, F.col("at"))).select("*", "c.pivot", "c.part").drop("c") if place is not None else rows.join(F.broadcast(table), "at")

        first = scratch.table(cells(fits.withColumn("within", F.lit(4.0)), True), "home")
        found = scratch.table(self._compared(first, k), "first")
        worst = found.filter("id is not null").groupBy("query").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("s"))
        rest = fits.join(worst, "query", "left").withColumn("within", F.when(F.col("s").isNull(), 4.0).otherwise(F.sqrt(F.greatest(F.lit(2.0) - 2 * F.col("s"), F.lit(0.0)) + SLACK))).drop("s")
        rest = cells(rest, False).join(first.select("query", F.col("at").alias("had")), "query").filter("at <> had").drop("had")
        found = found.union(self._compared(scratch.table(rest, "rest"), k))
        order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
        best = found.filter("id is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        read = found.groupBy("query").agg(F.sum("read").alias("read"))
        return best.drop("read").join(read, "query").select(F.col("query").alias("query_id"), "rank", "id", "similarity", "read")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` and ``b``."""
    return np.sqrt(np.maximum(np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None] - 2 * (a @ b.T), 0))
