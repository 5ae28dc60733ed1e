"""Tables written in an order, with the counts of their ranges: a row's place, and any page, without sorting again.

The rows are dealt to ranges of the order and sorted within them, once. A row's place is the number of rows in the ranges
before its own and its place in its range. A page is found from the ranges' counts, and only the ranges that it lies in
are read, however deep it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import free_names, shuffle_partitions

#: Rows of a range, about.
RANGE_ROWS = 100_000


class OrderedTable:
    """Rows of a folder in an order, in ranges (the partition column ``part_of``), with ``ranges``: part_of, first, rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, rows: DataFrame, *order, range_rows: int = RANGE_ROWS, ranges: int | None = None) -> OrderedTable:
        """Write ``rows`` by ``order`` (columns that tell all rows apart, else equal rows stand as they come); a table that is there is replaced."""
        if free_names(rows.columns, "part_of", "place") != ["part_of", "place"]:
            raise ValueError("rows have a column part_of or place")
        ranges = ranges or max(shuffle_partitions(self.spark), -(-rows.count() // range_rows))
        dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
        # The number holds the range above its 33rd bit and the place in the range below it.
        dealt = dealt.withColumns({"part_of": F.shiftright("place", 33).cast("int"), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
        dealt.write.mode("overwrite").partitionBy("part_of").option("compression", "zstd").parquet(f"{self.folder}/rows")
        self.schema = dealt.schema
        before = Window.orderBy("part_of").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
        counted = self._rows().groupBy("part_of").agg(F.count("*").alias("rows"))
        counted.select("part_of", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), "rows").write.mode("overwrite").parquet(f"{self.folder}/ranges")
        return self

    def _rows(self) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(self.schema) if hasattr(self, "schema") else reader).parquet(f"{self.folder}/rows")

    def ranges(self) -> DataFrame:
        return self.spark.read.schema("part_of int, first long, rows long").parquet(f"{self.folder}/ranges")

    def placed(self) -> DataFrame:
        """All rows with their place, from 0."""
        first = F.broadcast(self.ranges().select("part_of", "first"))  # a row for each range
        return self._rows().join(first, "part_of").withColumn("place", F.col("first") + F.col("place")).drop("part_of", "first")

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows at places ``offset`` to ``offset + limit - 1``, with their place: reads the ranges that hold them."""
        offset, limit = max(offset, 0), max(limit, 0)
        held = self.ranges().filter((F.col("first") < offset + limit) & (F.col("first") + F.col("rows") > offset)).collect() if limit else []
        rows = self._rows().filter(F.col("part_of").isin([r.part_of for r in held]))
        first = F.coalesce(*[F.when(F.col("part_of") == r.part_of, r["first"]) for r in held], F.lit(0))
        rows = rows.withColumn("place", first + F.col("place")).drop("part_of")
        return rows.filter(F.col("place").between(offset, offset + limit - 1)).orderBy("place")
