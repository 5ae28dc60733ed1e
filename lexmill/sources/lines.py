"""Physical line numbers of files that many tasks read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, line (from 1), value of every line of the files under ``path``; blank lines count and come back.

    Files are read in splits. One pass counts the lines of each split; sums over the splits before it in its file, and a
    line's place in its split, make the number. A split's lines have consecutive row numbers, in the order of the file, and both
    passes read the same splits, so the place is the distance from the split's first row number. Lines end with a line feed, a
    carriage return or both.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader if glob is None else reader.option("pathGlobFilter", glob)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("row"))
    counted = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each split.
    counted = counted.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(counted, ["file", "block"]).select("file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line"), "value")
