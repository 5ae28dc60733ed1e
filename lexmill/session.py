"""Session helpers: table access and scratch tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Session settings of the engine: small Arrow batches, so that a task's memory does not follow the number of rows in a
#: batch, and shuffle files that go as soon as the result of their query is written.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Where that is unset, a session in one process (local runs and tests) takes a folder of its own; on a cluster, where
    executors would not see it, that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lexmill.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("lexmill.shared.dir", found)
    return found.rstrip("/")


def apply_settings(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


class Scratch:
    """A folder for the intermediate tables of one query: each is written once and read back, which cuts lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        apply_settings(spark)
        self.root = f"{shared_dir(spark)}/lexmill-{name}-{uuid.uuid4().hex[:12]}"
        self._n, self.names = 0, []

    def write(self, df: DataFrame, tag: str, partition_by: list[str] | None = None) -> str:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{tag}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return path

    def read(self, path: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(path)

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """``df`` written and read back under its own schema (so that empty tables work)."""
        return self.read(self.write(df, tag), df.schema)

    def bucketed(self, df: DataFrame, tag: str, column: str, buckets: int) -> DataFrame:
        """``df`` written in buckets of ``column`` and read back: joins and aggregates by it need no shuffle.

        Tables with as many buckets meet bucket by bucket. The entry in the session's catalog only holds the layout; the
        files lie with the other intermediate tables.
        """
        self._n += 1
        name = f"lexmill_{uuid.uuid4().hex}"
        writer = df.write.option("path", f"{self.root}/{self._n:03d}-{tag}").option("compression", "zstd").format("parquet")
        writer.bucketBy(buckets, column).sortBy(column).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self, keep: int = 0) -> None:
        """Take the bucketed tables but for the last ``keep`` out of the catalog; their files stay for running plans."""
        while len(self.names) > keep:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(0)}")

    def drop(self, path: str) -> None:
        """Delete one intermediate table that no later step reads."""
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores behind it as it takes to differ from ``columns`` and the others (letters of either case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a task that sorts or groups them, about.
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: a task's memory does not grow with the table."""
    return max(shuffle_partitions(spark), -(-rows // TASK_ROWS))
