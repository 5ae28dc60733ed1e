"""Citations found once for each text, and the edges that follow, kept up to date by change.

What the extractor finds in a paragraph depends on the paragraph and on the grammar, so results are stored under the text's hash
and the grammar's fingerprint: a text that is held already, in whichever document, is not read again, and a changed grammar
begins an own part. Edges are a log of signed counts: a batch takes back the edges of the documents that it touches and adds them
as they are now. Touched are documents that come, go, or cite a key whose owner moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.citations import Grammar, extract_citations
from lexmill.operators.graph import reextracted_edges

BUCKETS = 64
_FOUND = "text_hash string, places array<string>, grammar string, part string"
_TABLES = {
    "places": "id long, idx int, citation_key string, sign long, batch long, bucket int",
    "edges": "from_doc long, to_doc long, paragraph_count long, sign long, batch long, bucket int",
}


class Extraction:
    """Extraction results, places and edges in a folder."""

    def __init__(self, spark: SparkSession, folder: str, grammar: Grammar | None = None):
        self.spark, self.folder, self.grammar = spark, folder.rstrip("/"), grammar or Grammar()
        self.version = self.grammar.fingerprint()

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{path}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def found(self) -> DataFrame:
        """text_hash, places (citation keys) under this grammar."""
        return self._read("found", _FOUND).filter(F.col("grammar") == self.version)

    def learn(self, paragraphs: DataFrame) -> int:
        """Extract from the texts (id, idx, text) that are not held yet; how many there were (GRA-7, CT-12)."""
        texts = paragraphs.filter("text is not null").select(F.sha2("text", 256).alias("text_hash"), "text").dropDuplicates(["text_hash"])
        texts = texts.withColumn("part", F.substring("text_hash", 1, 1))
        fresh = texts.join(self.found().select("text_hash"), "text_hash", "left_anti")
        keys = extract_citations(fresh, grammar=self.grammar).groupBy("text_hash").agg(F.collect_set("citation_key").alias("places"))
        rows = fresh.select("text_hash", "part").join(keys, "text_hash", "left").select("text_hash", F.coalesce("places", F.expr("cast(array() as array<string>)")).alias("places"), F.lit(self.version).alias("grammar"), "part")
        n = fresh.select("text_hash").count()
        if n:
            rows.hint("rebalance", "part").write.mode("append").partitionBy("grammar", "part").parquet(f"{self.folder}/found")
        return n

    def places(self, paragraphs: DataFrame) -> DataFrame:
        """id, idx, citation_key of paragraphs whose texts are held."""
        hashed = paragraphs.select("id", "idx", F.sha2("text", 256).alias("text_hash"))
        return hashed.join(self.found(), "text_hash").select("id", "idx", F.explode("places").alias("citation_key"))

    def _log(self, name: str, before: int | None = None) -> DataFrame:
        rows = self._read(f"{name}/{self.version}", _TABLES[name])
        return rows if before is None else rows.filter(F.col("batch") < before)

    def _write(self, rows: DataFrame, name: str, batch: int, key: str) -> None:
        rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/{self.version}/batch={batch}")

    @staticmethod
    def _standing(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.groupBy(*columns).agg(F.sum("sign").alias("sign")).filter("sign > 0").select(*columns)

    def apply(self, batch: int, owners: DataFrame, inserted: DataFrame | None = None, withdrawn: DataFrame | None = None, moved: DataFrame | None = None) -> int:
        """Take a batch into the edges; how many texts were read anew. A batch of one number is replaced as a whole.

        owners: citation_key, doc_id, as they are now. inserted: id, idx, text of all paragraphs of documents that come, or
        come again. withdrawn: id of documents that go. moved: citation_key of keys whose owner is another than before.
        """
        none = self.spark.createDataFrame([], "id long, idx int, text string")
        inserted = none if inserted is None else inserted.select(F.col("id").cast("long").alias("id"), F.col("idx").cast("int").alias("idx"), "text")
        gone = none.select("id") if withdrawn is None else withdrawn.select(F.col("id").cast("long").alias("id"))
        read = self.learn(inserted)
        old = self._standing(self._log("places", batch), ["id", "idx", "citation_key"])
        renewed = gone.union(inserted.select("id")).distinct()
        away = old.join(renewed, "id", "left_semi").withColumn("sign", F.lit(-1).cast("long"))
        come = self.places(inserted).distinct().withColumn("sign", F.lit(1).cast("long"))
        self._write(away.unionByName(come), "places", batch, "id")
        touched = renewed
        if moved is not None:
            touched = touched.union(old.join(moved.select("citation_key").distinct(), "citation_key", "left_semi").select("id")).distinct()
        touched = touched.withColumnRenamed("id", "from_doc")
        back = self._standing(self._log("edges", batch), ["from_doc", "to_doc", "paragraph_count"]).join(touched, "from_doc", "left_semi").withColumn("sign", F.lit(-1).cast("long"))
        now = self._standing(self._log("places"), ["id", "idx", "citation_key"]).join(touched.withColumnRenamed("from_doc", "id"), "id", "left_semi")
        fresh = reextracted_edges(now, owners).withColumn("sign", F.lit(1).cast("long"))
        self._write(back.unionByName(fresh), "edges", batch, "from_doc")
        return read

    def edges(self) -> DataFrame:
        """from_doc, to_doc, paragraph_count of the documents that stand (AGG-17, JN-21)."""
        return self._standing(self._log("edges"), ["from_doc", "to_doc", "paragraph_count"])
