"""Graphs as encoded adjacency: compressed rows of edges in order, checked as they are read.

The canonical edges (no self edges, no zero counts, one row for each pair) are sorted and cut into rows of ROW_EDGES edges at
most, so a node of very many edges spans several rows. A row's payload holds its sources as differences, how many targets
each has, the targets as differences within a source, and the counts, all as variable-length numbers behind a version and
before a checksum. There is one such payload for a list of edges; a reader names the first fault of any other.

Rows lie in ranges, with the first and last source of each in a table, so a lookup or a hop reads the ranges that its nodes
can be sources in. The reversed edges are stored alike, for the way back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.graph import MOST_HOPS, encoded_edges
from lexmill.session import shuffle_partitions

VERSION, ROW_EDGES = 1, 4096
#: Edges of a range, about.
RANGE_EDGES = 1_000_000
_ROWS = "first long, last long, n int, payload binary, part_of int"


def _varints(values: np.ndarray) -> bytes:
    """Numbers from 0 as groups of seven bits, lowest first, the last one without the high bit."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    place = np.arange(int(size.sum())) - np.repeat(ends - size, size)
    out = (np.repeat(values, size) >> (np.uint64(7) * place.astype(np.uint64))).astype(np.uint8) & 127
    out |= 128
    out[ends - 1] &= 127
    return out.tobytes()


def _numbers(raw: np.ndarray) -> np.ndarray:
    """The numbers of whole bytes; ValueError for a number that is cut, too long or not in its shortest form."""
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    ends = np.flatnonzero(raw < 128)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise ValueError("cut number")
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts + 1
    if size.max() > 10 or (raw[ends[size == 10]] > 1).any():
        raise ValueError("number too long")
    if (raw[ends[size > 1]] == 0).any():
        raise ValueError("number not in shortest form")
    place = np.arange(len(raw)) - np.repeat(starts, size)
    return np.bitwise_or.reduceat((raw & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64)), starts)


def _zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).astype(np.int64).view(np.uint64)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def encode(src: np.ndarray, dst: np.ndarray, counts: np.ndarray) -> bytes:
    """The payload of edges in order of (src, dst), each pair once."""
    starts = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, dtype=np.int64)
    sources, degrees = src[starts], np.diff(np.append(starts, len(src)))
    steps = np.diff(dst.view(np.uint64), prepend=np.uint64(0)) if len(dst) else dst.view(np.uint64)
    steps[starts] = _zigzag(dst[starts])
    gaps = np.diff(sources.view(np.uint64), prepend=np.uint64(0)) if len(sources) else sources.view(np.uint64)
    gaps[:1] = _zigzag(sources[:1])
    head = np.array([VERSION, len(sources), len(src)])
    body = b"".join(map(_varints, (head, gaps, degrees, steps, counts)))
    return body + zlib.crc32(body).to_bytes(4, "little")


def decode(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, counts) of a payload; ValueError names the first thing that is not as ``encode`` writes it."""
    if len(payload) < 7 or zlib.crc32(payload[:-4]) != int.from_bytes(payload[-4:], "little"):
        raise ValueError("checksum")
    numbers = _numbers(np.frombuffer(payload[:-4], dtype=np.uint8))
    if len(numbers) < 3 or numbers[0] != VERSION:
        raise ValueError("version")
    k, n = int(numbers[1]), int(numbers[2])
    if len(numbers) != 3 + 2 * k + 2 * n or (k == 0) != (n == 0):
        raise ValueError("length")
    gaps, degrees, steps, counts = np.split(numbers[3:], np.cumsum([k, k, n]))
    gaps, steps = gaps.copy(), steps.copy()
    if not (degrees > 0).all() or degrees.sum() != n:
        raise ValueError("degrees")
    if not (counts > 0).all():
        raise ValueError("zero count")
    starts = (np.cumsum(degrees) - degrees).astype(np.int64)
    inner = np.ones(n, dtype=bool)
    inner[starts] = False
    if not (gaps[1:] > 0).all() or not (steps[inner] > 0).all():
        raise ValueError("order")
    if k:
        gaps[0] = _unzigzag(gaps[:1])[0].astype(np.uint64)
    sources = np.cumsum(gaps).view(np.int64)
    steps[starts] = _unzigzag(steps[starts]).view(np.uint64)
    total = np.cumsum(steps)
    dst = (total - np.repeat(total[starts] - steps[starts], degrees.astype(np.int64))).view(np.int64)
    src = np.repeat(sources, degrees.astype(np.int64))
    if (sources[1:] <= sources[:-1]).any() or ((dst[1:] <= dst[:-1]) & inner[1:]).any():
        raise ValueError("order")  # a sum that leaves the range of numbers
    if (src == dst).any():
        raise ValueError("self edge")
    return src, dst, counts.view(np.int64)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the sorted edges of a task."""
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId(), np.zeros((3, 0), dtype=np.int64)

    def row(edges: np.ndarray) -> pa.RecordBatch:
        src, dst, counts = np.ascontiguousarray(edges)
        columns = [[int(src[0])], [int(src[-1])], [len(src)], [encode(src, dst, counts)], [part]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()), strict=True)], names=["first", "last", "n", "payload", "part_of"])

    for batch in batches:
        held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
        while held.shape[1] >= ROW_EDGES:
            yield row(held[:, :ROW_EDGES])
            held = held[:, ROW_EDGES:]
    if held.shape[1]:
        yield row(held)


def _decoded(faults: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("first", "last", "n", "payload", "part_of")), strict=True)
            for first, last, n, payload, part in rows:
                fault = None
                try:
                    src, dst, counts = decode(payload or b"")
                    if len(src) != n or not n or (src[0], src[-1]) != (first, last):
                        fault = "not as its row says"
                except ValueError as e:
                    fault = str(e)
                if faults:
                    if fault:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([fault])], names=["part_of", "first", "fault"])
                elif fault:
                    raise ValueError(f"an encoded row from source {first}: {fault}")
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(counts)], names=["src", "dst", "paragraph_count"])

    return run


def _source_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n: how many edges of each row leave a source."""
    for edges in _decoded(False)(batches):
        src = edges.column("src").to_numpy()
        starts = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(src[starts]), pa.array(np.diff(np.append(starts, len(src))))], names=["id", "n"])


class Adjacency:
    """Encoded edges in a folder, both ways."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, edges: DataFrame, range_edges: int = RANGE_EDGES) -> Adjacency:
        """Write ``edges`` (src, dst, paragraph_count, all long); those that are there are replaced (CR-4)."""
        real = encoded_edges(edges.select(*(F.col(c).cast("long").alias(c) for c in ("src", "dst", "paragraph_count"))).dropna())
        real.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/edges")  # else each count, sample and way would group them anew
        real = self.spark.read.schema("src long, dst long, paragraph_count long").parquet(f"{self.folder}/edges")
        ranges = max(shuffle_partitions(self.spark), -(-real.count() // range_edges))
        for way, keys in (("out", ["src", "dst"]), ("in", ["dst", "src"])):
            rows = real.select(F.col(keys[0]).alias("src"), F.col(keys[1]).alias("dst"), "paragraph_count")
            rows = rows.repartitionByRange(ranges, "src", "dst").sortWithinPartitions("src", "dst").mapInArrow(_encoded, _ROWS)
            rows.write.mode("overwrite").partitionBy("part_of").parquet(f"{self.folder}/{way}")
            held = self.rows(way).groupBy("part_of").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("edges"))
            held.write.mode("overwrite").parquet(f"{self.folder}/{way}-ranges")
        return self

    def rows(self, way: str = "out") -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(f"{self.folder}/{way}")

    def ranges(self, way: str = "out") -> DataFrame:
        return self.spark.read.schema("part_of int, first long, last long, edges long").parquet(f"{self.folder}/{way}-ranges")

    def edges(self) -> DataFrame:
        """All edges; a row that is not canonical is an error."""
        return self.rows().mapInArrow(_decoded(False), "src long, dst long, paragraph_count long")

    def faults(self, way: str = "out") -> DataFrame:
        """part_of, first, fault of the rows that are not canonical, and of those that begin before the row before them ends (WIN-9)."""
        own = self.rows(way)
        bad = own.mapInArrow(_decoded(True), "part_of int, first long, fault string")
        # A range's rows follow each other, and ranges do.
        ranges = self.ranges(way)
        after = ranges.select((F.col("part_of") + 1).alias("part_of"), F.col("last").alias("before"))
        return bad.unionByName(ranges.join(after, "part_of").filter("first < before").select("part_of", "first", F.lit("ranges overlap").alias("fault")))

    def of(self, nodes: DataFrame, way: str = "out") -> DataFrame:
        """src, dst, paragraph_count of the edges that leave (``out``) or reach (``in``: then src is reached) the nodes (id): reads
        the ranges that hold them, and of these the rows that can."""
        ids = nodes.select(F.col(nodes.columns[0]).alias("id")).distinct()
        held = [r.part_of for r in self.ranges(way).join(ids, F.col("id").between(F.col("first"), F.col("last")), "left_semi").select("part_of").collect()]  # ranges
        low, high = ids.agg(F.min("id"), F.max("id")).first()
        rows = self.rows(way).filter(F.col("part_of").isin(held))
        rows = rows.filter((F.col("last") >= low) & (F.col("first") <= high)) if low is not None else rows.limit(0)
        found = rows.mapInArrow(_decoded(False), "src long, dst long, paragraph_count long")
        return found.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")

    def node(self, node: int) -> DataFrame:
        """way, other, paragraph_count of one node's edges, in order (GRA-5, ORD-7)."""
        one = self.spark.range(1).select(F.lit(node).cast("long").alias("id"))
        found = [self.of(one, way).select(F.lit(way).alias("way"), F.col("dst").alias("other"), "paragraph_count") for way in ("out", "in")]
        return found[0].unionByName(found[1]).orderBy("way", "other")

    def degrees(self) -> DataFrame:
        """id, out_degree, in_degree of all nodes with an edge (GRA-5): edges are counted where they lie, the counts meet in as many tasks as there are ranges."""
        none = F.lit(0).cast("long")
        out, into = (self.rows(way).mapInArrow(_source_counts, "id long, n long") for way in ("out", "in"))
        counts = out.select("id", F.col("n").alias("out_degree"), none.alias("in_degree")).union(into.select("id", none, "n"))
        tasks = max(shuffle_partitions(self.spark), self.ranges("out").count(), self.ranges("in").count())
        return counts.repartition(tasks, "id").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("out_degree", "in_degree")))

    def neighbourhood(self, centre: int, hops: int = 1) -> DataFrame:
        """id, depth of the nodes within ``hops`` (3 at most) of ``centre`` in either direction (GRA-4); nothing for a node without edges."""
        frontier = self.spark.range(1).select(F.lit(centre).cast("long").alias("id"))
        near = [self.of(frontier, way) for way in ("out", "in")]
        seen = near[0].union(near[1]).select(F.col("src").alias("id")).distinct().withColumn("depth", F.lit(0))
        for depth in range(1, min(hops, MOST_HOPS) + 1):
            step = self.of(frontier, "out").union(self.of(frontier, "in")).select(F.col("dst").alias("id")).distinct()
            frontier = step.join(seen.select("id"), "id", "left_anti")
            seen = seen.union(frontier.withColumn("depth", F.lit(depth)))
        return seen
