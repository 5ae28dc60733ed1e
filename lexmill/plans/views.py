"""Corpus-shaped views over the driver tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.block_index import BlockIndex
from lexmill.operators.ordered import OrderedTable
from lexmill.session import Scratch, table, tasks_for


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, court, region, title, date, authority, text of ``documents``."""
    d = F.col("doc_id")
    date = F.when(d % 17 != 0, F.format_string("%04d-%02d-%02d", 1990 + d % 35, 1 + d % 12, 1 + d % 28))
    return table(spark, sf_dir, "documents").select(
        d.alias("id"), F.upper("source").alias("court"), F.upper("lang").alias("region"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        date.alias("date"), ((d % 100) / 100.0).alias("authority"), "text",
    )


def citation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, idx, text: prose with citations in it, written from ``orders``."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    year = 1990 + k % 35
    text = (
        F.when(k % 4 == 0, F.format_string("as held in [%d] ZACC %d at para %d", year, 1 + c % 50, 1 + k % 90))
        .when(k % 4 == 1, F.format_string("see %d (%d) SA %d (SCA)", year, 1 + k % 6, 1 + c % 900))
        .when(k % 4 == 2, F.format_string("compare %d AD %d", year, 1 + c % 500))
        .otherwise(F.format_string("Case CCT %d/%02d was heard", 1 + c % 300, k % 100))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (k % 10).cast("int").alias("idx"), text.alias("text"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_doc, from_para, citation_key: line items citing parts by key; every seventh key has no claim."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 500).alias("from_doc"), F.col("l_linenumber").alias("from_para"), F.concat(F.lit("neutral:"), F.col("l_partkey") % 700).alias("citation_key"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """citation_key, doc_id: what parts claim to be; several parts claim one key, some keys nobody."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(p % 7 != 0).select(F.concat(F.lit("neutral:"), p % 700).alias("citation_key"), (p % 500).alias("doc_id"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tier of ``part``."""
    names = ["apex", "appellate", "specialist_appellate", "high_court", "specialist_high", "tribunal", "lower"]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_size") % 7 + 1).cast("int")).alias("tier"))


def _follows(li: DataFrame) -> DataFrame:
    tasks = tasks_for(li.sparkSession, li.count())
    step = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    pairs = li.repartition(tasks, "l_orderkey").select("l_orderkey", F.col("l_partkey").alias("src"), step.alias("dst")).filter("dst is not null and src <> dst")
    once = pairs.distinct().select("src", "dst")  # in the tasks of their orders
    return once.repartition(tasks, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("paragraph_count"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, paragraph_count: parts that follow each other in orders, of all line items."""
    return _follows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))


def attestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, from_doc, to_doc, treatment, signer, signature, created_at of ``events``; signatures repeat."""
    e = F.col("event_id")
    names = F.array(*[F.lit(x) for x in ("followed", "applied", "distinguished", "criticised", "overruled")])
    return table(spark, sf_dir, "events").select(
        e.alias("id"), (e % 97).alias("from_doc"), (e % 41).alias("to_doc"), F.element_at(names, ((e + F.length("event_type")) % 5 + 1).cast("int")).alias("treatment"),
        F.concat(F.lit("K"), F.col("user_id") % 50).alias("signer"), (e % 5000).cast("string").alias("signature"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


def witness_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, witness, raw_hash, fetched_at of ``lineitem``."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("w"), F.col("l_suppkey") % 5).alias("witness"),
        F.concat(F.lit("h"), F.col("l_partkey") % 3).alias("raw_hash"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("fetched_at"),
    )


_INDEXES: dict[tuple[str, str], BlockIndex] = {}


def corpus_index(spark: SparkSession, sf_dir: str) -> BlockIndex:
    """The search index over ``judgments`` of a data folder: built at its first use in an application, then opened."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = BlockIndex(spark, Scratch(spark, "search-index").root).build(judgments(spark, sf_dir))
    return _INDEXES[key]


_ORDERS: dict[tuple[str, str], OrderedTable] = {}


def corpus_order(spark: SparkSession, sf_dir: str) -> OrderedTable:
    """id, authority of ``judgments`` in the order of authority, without their texts: built at its first use in an application, then opened."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ORDERS:
        _ORDERS[key] = OrderedTable(spark, Scratch(spark, "corpus-order").root).build(judgments(spark, sf_dir).select("id", "authority"), F.desc("authority"), "id")
    return _ORDERS[key]


#: The views as common table expressions.
SQL = {
    "j": """SELECT doc_id AS id, upper(source) AS court, upper(lang) AS region, split_part(text, chr(10), 1) AS title,
        CASE WHEN doc_id % 17 <> 0 THEN printf('%04d-%02d-%02d', 1990 + doc_id % 35, 1 + doc_id % 12, 1 + doc_id % 28) END AS date,
        (doc_id % 100) / 100.0::DOUBLE AS authority, text FROM documents""",
    "ct": """SELECT o_custkey AS id, (o_orderkey % 10)::INTEGER AS idx, 1990 + o_orderkey % 35 AS year, o_orderkey AS k, o_custkey AS c FROM orders""",
    "c": """SELECT l_orderkey % 500 AS from_doc, l_linenumber AS from_para, 'neutral:' || (l_partkey % 700) AS citation_key FROM lineitem""",
    "cl": """SELECT 'neutral:' || (p_partkey % 700) AS citation_key, p_partkey % 500 AS doc_id FROM part WHERE p_partkey % 7 <> 0""",
    "own": """SELECT citation_key, min(doc_id) AS to_doc FROM cl GROUP BY 1""",
    "linked": """SELECT c.*, own.to_doc FROM c LEFT JOIN own USING (citation_key)""",
    "n": """SELECT p_partkey AS id, ['apex', 'appellate', 'specialist_appellate', 'high_court', 'specialist_high', 'tribunal', 'lower'][p_size % 7 + 1] AS tier FROM part""",
    "e": """SELECT src, dst, count(DISTINCT l_orderkey) AS paragraph_count FROM (
        SELECT l_orderkey, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem)
        WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2""",
    "we": """SELECT src, dst, CASE tier WHEN 'apex' THEN 1.0 WHEN 'appellate' THEN 0.8 WHEN 'specialist_appellate' THEN 0.65 WHEN 'high_court' THEN 0.5
        WHEN 'specialist_high' THEN 0.45 WHEN 'tribunal' THEN 0.2 ELSE 0.1 END::DOUBLE * (1 + 0.25 * least(greatest(paragraph_count - 1, 0), 4))::DOUBLE AS weight
        FROM e JOIN n ON n.id = e.src WHERE e.dst IN (SELECT id FROM n)""",
    "a": """SELECT event_id AS id, event_id % 97 AS from_doc, event_id % 41 AS to_doc,
        ['followed', 'applied', 'distinguished', 'criticised', 'overruled'][(event_id + length(event_type)) % 5 + 1] AS treatment,
        'K' || (user_id % 50) AS signer, (event_id % 5000)::VARCHAR AS signature, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events""",
    "w": """SELECT l_orderkey AS doc_id, 'w' || (l_suppkey % 5) AS witness, 'h' || (l_partkey % 3) AS raw_hash, strftime(l_shipdate, '%Y-%m-%d') AS fetched_at FROM lineitem""",
    "p": """SELECT id AS doc_id, (i - 1)::INTEGER AS para_index, lines[i] AS text FROM (SELECT id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents))
        WHERE NOT regexp_matches(lines[i], '^\\s*$')""",
}
_NEEDS = {"own": ["cl"], "linked": ["c", "own"], "we": ["e", "n"]}


def with_views(names: str, body: str) -> str:
    """``body`` under the named views and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + f"\n{body}"  # a body may add views: ", x AS (...) SELECT ..."
