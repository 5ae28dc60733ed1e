"""Benchmark decontamination by a size-partitioned MinHash containment search, in DataFrame functions alone.

A test item is a set of word shingles. Items are partitioned by size (powers of two). An item's sketch is its bottom-k
MinHash: the k smallest hashes of its shingles, with k for the partition's largest size such that a document that
contains ``percent`` of the item must hold one of the k: 1 + the most shingles that may be missing. So no
contained item is lost, however long the document, and a document's shingles above the largest sketched hash of
all items need no lookup. Shingles that many items share come last in the order, so that they make candidates only of
items that consist of such shingles. Candidates are then verified on the shingles' words: each candidate pair looks up
its item's shingles among its document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import Scratch, free_names, table

WIDTH, PERCENT = 5, 80
#: Sketch rows that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Items that share a shingle before it comes last in their sketches.
COMMON_ITEMS = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of bytes other than space and 0x09 to 0x0D, with A-Z as a-z."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(values: Column, width: int, make) -> Column:
    """``make(i)`` for each shingle's first place in ``values``; nothing for an empty array."""
    n = F.size(values)
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: n > 0), make)


def hashes(ws: Column, *widths: int) -> Column:
    """Hashes, from the words' hashes, of the shingles of ``ws`` of each width; a shorter text is one shingle."""
    of_words = lambda h, width: _windows(h, width, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
    return _let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.concat(*[of_words(h, width) for width in widths]))


def shingles(ws: Column, *widths: int) -> Column:
    of_words = lambda w, width: _windows(w, width, lambda i: F.array_join(F.slice(w, i + 1, width), " "))
    return _let(ws, lambda w: F.concat(*[of_words(w, width) for width in widths]))


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def leaked_items(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_col: str = "item_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id, item, n_item and n_shared of each pair in which the document contains ``percent`` of the item's shingles.

    Sets are distinct shingles of ``width`` words, A-Z as a-z; a text of fewer words is one shingle, its whole
    sequence, and such an item is found wherever its sequence stands in a document. Items and documents that are null,
    empty or blank have no shingles and no pairs. Rows of one id are one document (null ids too), rows of one item
    are one item; items with a null id are left out. Repeated rows change nothing. Other columns are left aside.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    items = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    # The outer form: the inner one would have every array built once more, to test that it is not empty.
    of_item = items.select("item", F.explode_outer(shingles(words(F.col("text")), width)).alias("shingle")).distinct().filter("shingle is not null")
    # The hash of a shingle is that of its words' hashes, as on the documents' side.
    of_item = of_item.withColumn("hash", F.get(hashes(F.split("shingle", " "), width), F.lit(0)))
    of_item = of_item.withColumn("n", F.count("*").over(Window.partitionBy("item")))
    of_item = scratch.table(of_item.withColumn("class", _size_class(F.col("n"))), "items")
    largest = of_item.groupBy("class").agg(F.max("n").alias("most"))
    k = (F.col("most") - F.ceil(F.col("most") * percent / 100) + 1).cast("int")
    shared_by = of_item.groupBy("hash").agg((F.count_distinct("item") > COMMON_ITEMS).alias("common"))
    order = Window.partitionBy("item").orderBy("common", "hash")
    sketch = of_item.join(largest, "class").join(shared_by, "hash").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("item", "hash")
    sketch = scratch.table(sketch, "sketch")
    # Shorter items are looked up among the documents' shingles of their lengths.
    length = F.size(F.split("shingle", " "))
    widths = [width, *sorted(r[0] for r in of_item.select(length.alias("m")).filter(F.col("m") < width).distinct().collect())]
    bound = sketch.agg(F.count("*").alias("rows"), F.max("hash").alias("top")).first()
    if not bound["rows"]:
        return docs.select("id", F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared")).filter("false")
    few = F.broadcast if bound["rows"] <= BROADCAST_ROWS else lambda df: df
    low = docs.select("id", F.explode_outer(F.filter(hashes(words(F.col("text")), *widths), lambda h: h <= bound["top"])).alias("hash"))
    hits = scratch.table(low.join(few(sketch), "hash").select("id", "item").distinct(), "hits")
    # Verification on the words of the candidates.
    own = docs.join(hits.select(F.col("id").alias("hit")).distinct(), F.col("id").eqNullSafe(F.col("hit")), "left_semi")
    few = F.broadcast if of_item.count() <= BROADCAST_ROWS else lambda df: df
    found = own.select("id", F.explode_outer(F.array_distinct(shingles(words(F.col("text")), *widths))).alias("shingle"))
    found = found.join(few(of_item.select("shingle").distinct()), "shingle", "left_semi").distinct()
    asked = hits.join(few(of_item.select("item", "shingle", "n")), "item")
    same = (asked["shingle"] == found["shingle"]) & asked["id"].eqNullSafe(found["id"])
    shared = asked.join(found, same, "left_semi").groupBy("id", "item", "n").agg(F.count("*").alias("n_shared"))
    return shared.filter(100 * F.col("n_shared") >= percent * F.col("n")).select("id", "item", F.col("n").alias("n_item"), "n_shared")


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", **named) -> DataFrame:
    """The rows of ``docs`` whose document contains no item; null ids are one document. Other columns stay, whatever their names."""
    (leak,) = free_names(docs.columns, "leak")
    leaks = leaked_items(docs, items, text, id_col, **named).select(F.col("id").alias(leak)).distinct()
    leaks = Scratch(docs.sparkSession, "leaks").table(leaks, "leaks")
    return docs.join(leaks, F.col(id_col).eqNullSafe(F.col(leak)), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each test item that it contains."""
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_item", "n_shared")


SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), w AS (
  SELECT kind, id, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS w FROM t
), m AS (
  SELECT DISTINCT least(len(w), 5) AS m FROM w WHERE kind = 'i' AND len(w) > 0 UNION SELECT 5
), sh AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - m + 1, 1) + 1), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS x
  FROM w, m WHERE len(w) > 0 AND (kind = 'd' OR m = 5)
), n AS (
  SELECT id AS item_id, count(*) AS n FROM sh WHERE kind = 'i' GROUP BY id
), c AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS k FROM sh d JOIN sh i ON d.x = i.x AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL
)
SELECT c.doc_id, c.item_id, n.n AS n_item, c.k AS n_shared FROM c JOIN n USING (item_id) WHERE 100 * c.k >= 80 * n.n
"""
