"""Links kept up to date by change: a batch of claims and citations touches its own keys alone.

The store is a log in a folder: for each batch the claims (with a sign: withdrawn ones are -1), the citations, and the links that
the batch made or moved, each dealt to BUCKETS by a hash of the key. A batch reads the buckets that its keys fall into,
finds the keys whose owner it changes, and writes the new links of those keys' citations and of its own. The links of
today are the last that were written for each citation. Batches are named by number and replaced as a whole, so one that
runs again after a failure leaves the same store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.corpus import key_owners

BUCKETS = 256
_TABLES = {
    "claims": "citation_key string, doc_id long, sign long, batch long, bucket int",
    "citations": "from_doc long, from_para int, citation_key string, copies long, batch long, bucket int",
    "links": "from_doc long, from_para int, citation_key string, copies long, since long, to_doc long, batch long, bucket int",
}


class LinkStore:
    """Claims, citations and their links in a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(_TABLES[name]).parquet(f"{self.folder}/{name}")
        except Exception as e:  # the first batch: nothing is there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], _TABLES[name])
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        # Rebalanced: the rows of a key that very many citations name are written by several tasks.
        rows.withColumn("bucket", self._bucket(F.col("citation_key"))).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/batch={batch}")

    @staticmethod
    def _owners(claims: DataFrame) -> DataFrame:
        """citation_key, doc_id: the smallest document whose claims stand (SNK-3); what was claimed and withdrawn is gone."""
        held = claims.groupBy("citation_key", "doc_id").agg(F.sum("sign").alias("n")).filter("n > 0")
        return key_owners(held)

    def apply(self, batch: int, citations: DataFrame | None = None, claims: DataFrame | None = None) -> None:
        """Add a batch (ST-2, SNK-5, JN-4). citations: from_doc, from_para, citation_key. claims: citation_key, doc_id and, if some
        are withdrawn, sign. Rows with a null key are left out."""
        none = self.spark.createDataFrame([], _TABLES["citations"])
        fresh = (citations.select("from_doc", "from_para", "citation_key") if citations is not None else none).filter("citation_key is not null")
        fresh = fresh.groupBy("from_doc", "from_para", "citation_key").agg(F.count("*").alias("copies"))
        none = self.spark.createDataFrame([], _TABLES["claims"])
        new = (claims if claims is not None else none).filter("citation_key is not null")
        new = new.select("citation_key", "doc_id", F.col("sign").cast("long") if "sign" in new.columns else F.lit(1).cast("long").alias("sign"))
        self._write(new, "claims", batch)
        self._write(fresh, "citations", batch)
        # What follows reads the batch as written.
        own = self._read("claims").filter(F.col("batch") == batch)
        cited = self._read("citations").filter(F.col("batch") == batch)
        met = [r.bucket for r in own.select("bucket").union(cited.select("bucket")).distinct().collect()]  # buckets
        keys = own.select("citation_key").union(cited.select("citation_key")).distinct()
        before = self._read("claims", batch, met).join(keys, "citation_key", "left_semi")
        old = self._owners(before).withColumnRenamed("doc_id", "old_doc")
        now = self._owners(before.unionByName(own)).withColumnRenamed("doc_id", "to_doc")
        moved = old.join(now, "citation_key", "full").filter(~F.col("old_doc").eqNullSafe(F.col("to_doc"))).select("citation_key", "to_doc")
        again = self._read("citations", batch, met).join(moved, "citation_key").withColumnRenamed("batch", "since")
        first = cited.join(now, "citation_key", "left").withColumnRenamed("batch", "since")
        columns = ["from_doc", "from_para", "citation_key", "copies", "since", "to_doc"]
        self._write(again.select(*columns).unionByName(first.select(*columns)), "links", batch)

    def changes(self, batch: int) -> DataFrame:
        """The links that a batch made or moved."""
        return self._read("links").filter(F.col("batch") == batch).drop("batch", "bucket")

    def links(self) -> DataFrame:
        """from_doc, from_para, citation_key, to_doc of all citations today, repeated ones as often as they came."""
        last = self._read("links").groupBy("bucket", "citation_key", "from_doc", "from_para", "since", "copies").agg(F.max_by("to_doc", "batch").alias("to_doc"))
        return last.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("from_doc", "from_para", "citation_key", "to_doc")

    def compacted(self, folder: str) -> LinkStore:
        """The store in another folder, as one batch under the number of the last: claims by their sums, links as they are today."""
        out, last = LinkStore(self.spark, folder, self.buckets), self._read("claims").agg(F.max("batch")).first()[0] or 0
        claims = self._read("claims").groupBy("citation_key", "doc_id").agg(F.sum("sign").alias("sign")).filter("sign <> 0")
        out._write(claims, "claims", last)
        cited = self._read("citations").groupBy("from_doc", "from_para", "citation_key").agg(F.sum("copies").alias("copies"))
        out._write(cited, "citations", last)
        linked = cited.join(self._owners(self._read("claims")).withColumnRenamed("doc_id", "to_doc"), "citation_key", "left").withColumn("since", F.lit(last).cast("long"))
        out._write(linked.select("from_doc", "from_para", "citation_key", "copies", "since", "to_doc"), "links", last)
        return out


def relink_stream(source: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS):
    """A started query that feeds a stream of claims and citations to the store in ``folder``.

    source: kind (claim, withdrawal or citation), citation_key, doc_id, from_para; a citation's doc_id is where it stands.
    """

    def feed(batch: DataFrame, number: int) -> None:
        claims = batch.filter("kind in ('claim', 'withdrawal')").select("citation_key", "doc_id", F.when(F.col("kind") == "claim", 1).otherwise(-1).alias("sign"))
        cited = batch.filter("kind = 'citation'").select(F.col("doc_id").alias("from_doc"), "from_para", "citation_key")
        LinkStore(batch.sparkSession, folder, buckets).apply(number, cited, claims)

    return source.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
