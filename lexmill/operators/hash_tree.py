"""A table's hash tree in a folder, and what differs between two: by descent from the roots.

The tree is that of ``sorted_root``: leaves are the rows' hashes with their counts, and the nodes above them stand for the
leaves that share six, three and no hex digits. The leaves and the level above them are dealt by their first digits, the others have 4097 rows at
most. Two trees are compared
level by level, and of each level only the nodes below a differing one are read, so that what is read follows the
difference, not the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.corpus import length_prefixed

#: Digits that the nodes of each level share, and by which large ones are dealt to partitions (16 for each digit).
LEVELS, PART_DIGITS = (6, 3, 0), 2
#: Prefixes that a filter names, at most; more are joined.
NAMED = 1000


@dataclass
class Difference:
    """Rows added and removed (the columns, ``copies`` and ``change``), and how many nodes and leaves of both trees were read."""

    rows: DataFrame
    read: int


class HashTree:
    """The tree of a table's rows over some columns; leaves keep those columns. A tree that was built in another session is opened
    with the schema of its rows, where it may be empty."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | None = None, part_digits: int = PART_DIGITS):
        self.spark, self.folder, self.schema, self.part_digits = spark, folder.rstrip("/"), schema, part_digits

    def build(self, rows: DataFrame, *columns: str) -> HashTree:
        """Write the tree of ``rows``; one that is there is replaced."""
        self.schema = rows.select(*columns).schema
        own = rows.select(F.sha2(length_prefixed(*[F.col(c) for c in columns]), 256).alias("h"), F.struct(*columns).alias("own"))
        leaves = own.groupBy("h").agg(F.count("*").alias("copies"), F.first("own").alias("own")).withColumn("part", F.substring("h", 1, self.part_digits))
        leaves.repartition("part").sortWithinPartitions("part", "h").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/leaves")
        level = self.leaves().select(F.col("h").alias("b"), F.sha2(F.concat("h", F.lit(":"), F.col("copies").cast("string")), 256).alias("h"))
        for digits in LEVELS:
            joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: F.concat(x.b, x.h)), "")
            level = level.groupBy(F.substring("b", 1, digits).alias("b")).agg(F.sha2(joined, 256).alias("h"))
            self._write(level, digits)
            level = self.level(digits)
        return self

    def _write(self, level: DataFrame, digits: int) -> None:
        path = f"{self.folder}/level{digits}"
        if digits == LEVELS[0]:
            level.withColumn("part", F.substring("b", 1, self.part_digits)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
        else:
            level.withColumn("part", F.substring("b", 1, self.part_digits)).coalesce(1).write.mode("overwrite").parquet(path)

    def leaves(self) -> DataFrame:
        reader = self.spark.read
        if self.schema is not None:
            fields = [T.StructField("h", T.StringType()), T.StructField("copies", T.LongType()), T.StructField("own", self.schema), T.StructField("part", T.StringType())]
            reader = reader.schema(T.StructType(fields))
        return reader.parquet(f"{self.folder}/leaves")

    def level(self, digits: int) -> DataFrame:
        return self.spark.read.schema("b string, h string, part string").parquet(f"{self.folder}/level{digits}").select("b", "h", "part")

    def root(self) -> str | None:
        """The digest of all rows; null for an empty table, as ``sorted_root`` has it."""
        found = self.level(0).first()
        return found.h if found else None


def _below(nodes: DataFrame, key: str, digits: int, prefixes: DataFrame, named: list[str] | None) -> DataFrame:
    """Nodes or leaves under differing prefixes: partitions first, then rows."""
    if named is None:
        return nodes.join(prefixes.select(F.col("b").alias("under")), F.substring(key, 1, digits) == F.col("under"), "left_semi")
    parts = F.lit(False)
    for p in {p[:PART_DIGITS] for p in named}:  # partitions may be dealt by fewer digits
        parts = parts | F.lit(p).startswith(F.col("part"))
    return nodes.filter(parts).filter(F.substring(key, 1, digits).isin(named))


def difference(old: HashTree, new: HashTree) -> Difference:
    """What ``new`` holds beyond ``old`` and what it lacks (SET-1, ST-5): of equal trees only the roots are read.

    A row that stands more often in one of the trees is a difference by so many copies.
    """
    read = 2
    if old.root() == new.root():
        return Difference(_changes(old.leaves().limit(0), new.leaves().limit(0)), read)
    prefixes, named, digits = None, [""], 0
    for below in LEVELS[-2::-1]:  # 3, then 6 digits
        a, b = (_below(t.level(below), "b", digits, prefixes, named) if digits else t.level(below) for t in (old, new))
        read += a.count() + b.count()
        found = a.select("b", F.col("h").alias("one")).join(b.select("b", F.col("h").alias("two")), "b", "full").filter(~F.col("one").eqNullSafe(F.col("two"))).select("b")
        some = [r.b for r in found.limit(NAMED + 1).collect()]
        prefixes, named, digits = found, some if len(some) <= NAMED else None, below
    a, b = (_below(t.leaves(), "h", digits, prefixes, named) for t in (old, new))
    read += a.count() + b.count()
    return Difference(_changes(a, b), read)


def _changes(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.select("h", F.col("copies").alias("had"), F.col("own").alias("before")).join(new.select("h", F.col("copies").alias("has"), F.col("own").alias("after")), "h", "full")
    more = F.coalesce("has", F.lit(0)) - F.coalesce("had", F.lit(0))
    rows = both.filter(more != 0).select(F.coalesce("after", "before").alias("own"), F.abs(more).alias("copies"), F.when(more > 0, "added").otherwise("removed").alias("change"))
    return rows.select("own.*", "copies", "change")


def delta_bytes(changes: DataFrame, size: str = "size") -> DataFrame:
    """One row: the files and bytes that the additions of a difference bring (AGG-18), each once."""
    return changes.filter("change = 'added'").agg(F.count("*").alias("added_files"), F.coalesce(F.sum(size), F.lit(0)).alias("added_bytes"))
