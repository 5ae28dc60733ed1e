"""Release snapshots: the file index, its verification by recomputation, and the step report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The outcomes of a step and of a report.
PASS, FAIL, SKIP = "PASS", "FAIL", "SKIP"
# The steps of a verification that are data work; signatures are none (they need a key library).
STEPS = ("file set", "document hashes", "corpus root", "closed references", "graph root", "re-extraction", "chain")


def file_index(documents: DataFrame, text: str = "text") -> DataFrame:
    """hash, path, size of each distinct document (SNK-9): files are named by their content."""
    raw = documents.select(F.sha2(text, 256).alias("hash"), F.octet_length(text).alias("size")).distinct()
    return raw.select("hash", F.concat(F.lit("documents/"), "hash").alias("path"), "size")


def blob_path(key: Column) -> Column:
    """Where a blob lies: a folder of the first two digits, then the rest (SNK-10)."""
    return F.concat(F.lit("objects/"), F.substring(key, 1, 2), F.lit("/"), F.substring(key, 3, 62))


def verify_files(index: DataFrame, blobs: DataFrame, content: str = "text") -> DataFrame:
    """``index`` with a status: ok, missing, wrong_size or wrong_hash (REL-5, JN-17).

    blobs: path and content. Hashes are recomputed where the blobs are, before the join, so contents are not shuffled.
    """
    found = blobs.select("path", F.sha2(content, 256).alias("__hash"), F.octet_length(content).alias("__size"))
    out = index.join(found, "path", "left")
    status = F.when(F.col("__hash").isNull(), "missing").when(F.col("__size") != F.col("size"), "wrong_size").when(F.col("__hash") != F.col("hash"), "wrong_hash").otherwise("ok")
    return out.withColumn("status", status).drop("__hash", "__size")


def open_references(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Ends of edges that are no document of the release (SET-6): none in a closed one."""
    ends = edges.select(F.col("from_doc").alias("id")).union(edges.select(F.col("to_doc").alias("id"))).distinct()
    return ends.join(ids.select("id"), "id", "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that stand more often in one of two tables (SET-7): none if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionAll(b.exceptAll(a).withColumn("side", F.lit("recomputed")))


def step(number: int, faults: DataFrame | None, examined: DataFrame | None) -> DataFrame:
    """One row: number, name, status, examined, faults. A step without its inputs is skipped, never passed."""
    named = [F.lit(number).alias("number"), F.lit(STEPS[number - 1]).alias("name")]
    if faults is None or examined is None:
        one = examined if examined is not None else faults
        if one is None:
            raise ValueError("a step needs one table at least, to be skipped with it")
        return one.agg(F.count("*").alias("n")).select(*named, F.lit(SKIP).alias("status"), F.lit(0).cast("long").alias("examined"), F.lit(0).cast("long").alias("faults"))
    seen, bad = examined.agg(F.count("*").alias("examined")), faults.agg(F.count("*").alias("faults"))
    both = seen.crossJoin(bad)  # two single rows
    return both.select(*named, F.when(F.col("faults") > 0, FAIL).otherwise(PASS).alias("status"), "examined", "faults")


def verify(index: DataFrame, documents: DataFrame, stored_edges: DataFrame, found_edges: DataFrame, manifest: DataFrame, previous: DataFrame | None) -> DataFrame:
    """The report of a release (REL-6, REL-9): number, name, status, examined, faults; each step is judged by itself.

    index: hash, path, size. documents: id, path, text (as held). stored_edges, found_edges: from_doc, to_doc,
    paragraph_count. manifest: one row with corpus_root, graph_root and previous (a release's hash). previous: one row with
    hash, or None where no earlier release is held: the chain is then skipped.
    """
    from lexmill.operators.corpus import sorted_root

    files = verify_files(index, documents)
    edges = ["from_doc", "to_doc", "paragraph_count"]
    roots = manifest.crossJoin(sorted_root(documents, "id").withColumnRenamed("root", "documents_now")).crossJoin(sorted_root(stored_edges, *edges).withColumnRenamed("root", "graph_now"))  # single rows
    steps = [
        step(1, files.filter("status in ('missing', 'wrong_size')"), files),
        step(2, files.filter("status = 'wrong_hash'"), files.filter("status <> 'missing'")),
        step(3, roots.filter("corpus_root <> documents_now"), documents),
        step(4, open_references(stored_edges, documents), stored_edges),
        step(5, roots.filter("graph_root <> graph_now"), stored_edges),
        step(6, same_rows(stored_edges.select(*edges), found_edges.select(*edges)), found_edges),
        step(7, None if previous is None else manifest.crossJoin(previous.select("hash")).filter("not (previous <=> hash)"), manifest),
    ]
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def write_release(documents: DataFrame, edges: DataFrame, folder: str, number: int, previous: str | None = None, extractor: str = "") -> None:
    """Write a release (SNK-9, SNK-10): ``blobs`` by the first two digits of their hash, ``index``, ``graph`` and a one-row ``manifest``.

    documents: id, text. Blobs stay in large files, a row each; their paths are those of single files.
    """
    from lexmill.operators.corpus import sorted_root

    index = file_index(documents)
    blobs = documents.select("id", F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["id"])
    blobs.select("id", F.concat(F.lit("documents/"), "hash").alias("path"), "text", F.substring("hash", 1, 2).alias("part")).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/blobs")
    index.write.mode("overwrite").json(f"{folder}/index")
    columns = ["from_doc", "to_doc", "paragraph_count"]
    edges.select(*columns).write.mode("overwrite").parquet(f"{folder}/graph")
    roots = sorted_root(documents.select("id").distinct(), "id").withColumnRenamed("root", "corpus_root").crossJoin(sorted_root(edges, *columns).withColumnRenamed("root", "graph_root"))  # single rows
    counted = roots.crossJoin(documents.agg(F.count_distinct("id").alias("doc_count")))
    counted.select(F.lit(number).alias("release"), F.lit(previous).cast("string").alias("previous"), "corpus_root", "graph_root", "doc_count", F.lit(extractor).alias("extractor_version")).write.mode("overwrite").json(f"{folder}/manifest")


def read_release(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a release folder (SRC-21): manifest, index, blobs (id, path, text) and graph."""
    return {
        "manifest": spark.read.schema("release int, previous string, corpus_root string, graph_root string, doc_count long, extractor_version string").json(f"{folder}/manifest"),
        "index": spark.read.schema("hash string, path string, size long").json(f"{folder}/index"),
        "blobs": spark.read.schema("id string, path string, text string, part string").parquet(f"{folder}/blobs").drop("part"),
        "graph": spark.read.schema("from_doc string, to_doc string, paragraph_count long").parquet(f"{folder}/graph"),
    }


def publish(documents: DataFrame, grammar, owners: DataFrame, folder: str, number: int, previous: str | None = None) -> DataFrame:
    """Publish a corpus and report on what was written (SNK-11): ids are recomputed, edges are found anew in the text.

    documents: id, text (paragraphs between blank lines). owners: citation_key, doc_id. A document whose id is not that
    of its text stops the release. The report verifies the folder as read back; its last step is left out for a first release.
    """
    from lexmill.functions.citations import extract_citations
    from lexmill.functions.text import document_id
    from lexmill.operators.graph import reextracted_edges

    spark = documents.sparkSession
    wrong = documents.filter(~F.col("id").eqNullSafe(document_id(F.col("text")))).limit(1).collect()
    if wrong:
        raise ValueError(f"the id of {wrong[0]['id']} is not that of its text")

    def edges(rows: DataFrame) -> DataFrame:
        paragraphs = rows.select("id", F.posexplode(F.split("text", r"\n\s*\n")).alias("idx", "text"))
        return reextracted_edges(extract_citations(paragraphs, grammar=grammar), owners)

    write_release(documents, edges(documents), folder, number, previous, grammar.fingerprint())
    held = read_release(spark, folder)
    before = None if previous is None else spark.range(1).select(F.lit(previous).alias("hash"))
    return verify(held["index"], held["blobs"], held["graph"], edges(held["blobs"].select("id", "text")), held["manifest"], before)


def report(steps: DataFrame) -> DataFrame:
    """One row: passed, failed, skipped and the outcome of steps (number, status): any failure fails, any skip leaves open (REL-8)."""
    count = lambda s: F.count_if(F.col("status") == s)
    outcome = F.when(count(FAIL) > 0, "failed").when(count(SKIP) > 0, "incomplete").otherwise("verified")
    return steps.agg(count(PASS).alias("passed"), count(FAIL).alias("failed"), count(SKIP).alias("skipped"), outcome.alias("outcome"))
