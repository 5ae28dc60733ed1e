"""More registered queries: lookups, ordered listings, search hits, described indexes, re-extraction, releases, titles, crawl rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import citations as cite
from lexmill.functions import crawl, titles
from lexmill.functions import text as tx
from lexmill.operators import attest, corpus, graph, listing, rag, release, retrieval, search
from lexmill.operators.block_index import BlockIndex, hits_page
from lexmill.operators.metric_index import MetricIndex
from lexmill.plans import views
from lexmill.plans.catalog import _HOPS, _linked, _query
from lexmill.plans.views import with_views
from lexmill.session import Scratch, table
from lexmill.sources import bundles, registry

# --- lookups and listings ------------------------------------------------------------------------------------------


def _counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    linked = _linked(spark, sf_dir)
    return corpus.cited_by_count(linked), corpus.cites_count(linked)


@_query(with_views("j linked w", """, p AS (SELECT doc_id AS id, CASE WHEN count(DISTINCT witness) >= 2 THEN 'corroborated' ELSE 'single' END AS k FROM w GROUP BY 1),
    b AS (SELECT to_doc AS id, count(DISTINCT from_doc) AS n FROM linked WHERE from_doc <> to_doc GROUP BY 1), o AS (SELECT from_doc AS id, count(*) AS n FROM linked GROUP BY 1)
    SELECT j.id, court, region, date, coalesce(authority, 0.0) AS authority, coalesce(k, 'manual') AS provenance_class, coalesce(b.n, 0) AS cited_by_count, coalesce(o.n, 0) AS cites_count
    FROM j LEFT JOIN p USING (id) LEFT JOIN b USING (id) LEFT JOIN o USING (id) WHERE j.id = 42"""))  # fmt: skip
def case_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document with its class and counts (SRC-19, PRJ-3)."""
    cited, cites = _counts(spark, sf_dir)
    return listing.case(views.judgments(spark, sf_dir), corpus.witness_classes(views.witness_records(spark, sf_dir)), cited, cites, 42)


@_query(with_views("linked", "SELECT from_doc, from_para, citation_key, coalesce(to_doc, -1) AS to_doc, row_number() OVER (PARTITION BY from_doc ORDER BY from_para NULLS FIRST, citation_key) AS place FROM linked"))
def citations_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document cites, in order (ORD-3, GRA-8)."""
    rows = listing.placed(_linked(spark, sf_dir).withColumn("id", F.col("citation_key")), "from_doc", listing.CITATIONS_FROM)
    return rows.select("from_doc", "from_para", "citation_key", F.coalesce("to_doc", F.lit(-1)).alias("to_doc"), "place")


@_query(with_views("linked j", """SELECT l.to_doc, l.from_doc, l.from_para, j.date, row_number() OVER (PARTITION BY l.to_doc ORDER BY j.date DESC NULLS LAST, l.from_doc, l.from_para NULLS FIRST) AS place
    FROM linked l JOIN j ON j.id = l.from_doc WHERE l.from_doc <> l.to_doc"""))  # fmt: skip
def cited_by_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who cites every document, in order (ORD-4)."""
    rows = corpus.cited_by(_linked(spark, sf_dir), views.judgments(spark, sf_dir))
    return listing.placed(rows, "to_doc", listing.CITED_BY).select("to_doc", "from_doc", "from_para", "date", "place")


@_query(with_views("w", "SELECT doc_id, witness, raw_hash || '/' || fetched_at AS source_url, row_number() OVER (PARTITION BY doc_id ORDER BY witness, raw_hash || '/' || fetched_at) AS place FROM w"))
def provenance_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's records in order (ORD-5)."""
    rows = views.witness_records(spark, sf_dir).withColumn("source_url", F.concat("raw_hash", F.lit("/"), "fetched_at"))
    return listing.placed(rows, "doc_id", listing.PROVENANCE).select("doc_id", "witness", "source_url", "place")


@_query(with_views("a", "SELECT to_doc, id, row_number() OVER (PARTITION BY to_doc ORDER BY created_at, signer, from_doc, treatment, signature) AS place FROM a"))
def attestations_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims about every document in order (SRC-26, ORD-6)."""
    return listing.placed(views.attestations(spark, sf_dir), "to_doc", listing.ATTESTATIONS).select("to_doc", "id", "place")


@_query(with_views("a", "SELECT count(*) AS attestations, count(DISTINCT signer) AS signers FROM (SELECT DISTINCT signer, signature FROM a)"))
def attestation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and signers that are held (AGG-8)."""
    return listing.attestation_stats(attest.distinct_claims(views.attestations(spark, sf_dir)))


@_query(with_views("a", """SELECT a.to_doc, a.from_doc, a.id, a.treatment, a.signer FROM a JOIN (SELECT to_doc, from_doc FROM a GROUP BY 1, 2 HAVING count(DISTINCT treatment) > 1) USING (to_doc, from_doc)"""))
def conflict_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims of pairs whose claims disagree, in the order of pairs (AGG-14, ORD-15)."""
    claims = views.attestations(spark, sf_dir)
    rows = listing.conflicting_claims(claims, attest.conflicts(claims))
    return rows.select("to_doc", "from_doc", "id", "treatment", "signer").orderBy(*listing.order(listing.CONFLICTS), "id")


@_query(with_views("e", _HOPS.format(hops=3) + " SELECT id, depth FROM best"))
def khop_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps around one node, nearest first (GRA-4, ORD-13)."""
    return graph.neighbourhood(views.graph_edges(spark, sf_dir), 1, 3).orderBy(*listing.order(listing.NEIGHBOURHOOD))


@_query(with_views("j w", """, p AS (SELECT doc_id AS id, count(DISTINCT witness) AS n FROM w GROUP BY 1)
    SELECT count(*) FILTER (n >= 2) AS corroborated, count(*) FILTER (n = 1) AS single, count(*) FILTER (n IS NULL) AS manual FROM j LEFT JOIN p USING (id)"""))  # fmt: skip
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by provenance class (AGG-5)."""
    return corpus.class_counts(views.judgments(spark, sf_dir), corpus.witness_classes(views.witness_records(spark, sf_dir)))


@_query()
def authority_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the PageRank of their citations as authority (SNK-6)."""
    docs = views.judgments(spark, sf_dir).drop("text")
    tier = F.when(F.col("id") % 3 == 0, "apex").when(F.col("id") % 3 == 1, "high_court")
    nodes = docs.select("id", tier.alias("tier"))
    edges = corpus.resolved_edges(_linked(spark, sf_dir)).select(F.col("from_doc").alias("src"), F.col("to_doc").alias("dst"), "paragraph_count")
    return listing.write_authority(docs, graph.pagerank(nodes, graph.weighted_edges(nodes, edges)))


# --- search and retrieval ------------------------------------------------------------------------------------------


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("id")
    docs = views.judgments(spark, sf_dir).withColumns({"neutral_citation": F.format_string("[%d] ZACC %d", 1990 + d % 35, d), "reported": F.lit(None).cast("string"), "case_numbers": F.format_string("CCT %d/%02d", d, d % 100)})
    return search.fts_documents(docs)


_FTS = r""", f AS (SELECT id, title, court, authority, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*$')), chr(10) || chr(10)) AS text,
    printf('[%d] ZACC %d', 1990 + id % 35, id) || ' ' || printf('CCT %d/%02d', id, id % 100) AS citation FROM j)"""


@_query(with_views("j", _FTS + " SELECT id, title, text, citation FROM f"))
def fts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search sees them (PRJ-5)."""
    return _described(spark, sf_dir).select("id", "title", "text", "citation")


def _courts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("SRC"), "n_nationkey").alias("code"), F.col("n_name").alias("name")).filter("code <> 'SRC3'")


_WORDS = "regexp_extract_all(lower(strip_accents({})), '[\\p{{L}}\\p{{N}}]+')"


def _bm25(rows: str, words: str, first: str, second: str) -> str:
    """s(id, bm25): the relevance of two words over ``words``."""
    return f""", t AS (SELECT id, {words} AS w FROM {rows}), u AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: x = '{first}')) AS t1, len(list_filter(w, lambda x: x = '{second}')) AS t2 FROM t),
    g AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM u),
    s AS (SELECT id, -(greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / m)) + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * dl / m))) AS bm25
      FROM u, g WHERE t1 > 0 AND t2 > 0)"""


_ALL_WORDS = f"list_concat(list_concat({_WORDS.format('title')}, {_WORDS.format('text')}), {_WORDS.format('citation')})"


@_query(with_views("j linked", _FTS + _bm25("f", _ALL_WORDS, "the", "2007") + """, b AS (SELECT to_doc AS id, count(DISTINCT from_doc) AS n FROM linked WHERE to_doc IS NOT NULL GROUP BY 1),
    cn AS (SELECT 'SRC' || n_nationkey AS code, n_name AS name FROM nation WHERE n_nationkey <> 3)
    SELECT f.id, f.citation, coalesce(cn.name, f.court) AS court_name, round(s.bm25, 6) AS bm25, coalesce(b.n, 0) AS cited_by_count
    FROM s JOIN f USING (id) LEFT JOIN cn ON cn.code = f.court LEFT JOIN b USING (id) ORDER BY s.bm25 - 2.0 * f.authority, f.id LIMIT 20"""))  # fmt: skip
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page over titles, texts and citations, with court names and citing documents (PRJ-1, TXT-3, JN-5)."""
    page = search.search(_described(spark, sf_dir), "The 2007", text=("title", "text", "citation"))
    cited = corpus.cited_by_count(_linked(spark, sf_dir), with_self=True).withColumnRenamed("to_doc", "id")
    hits = registry.with_court_names(page, _courts(spark, sf_dir)).join(cited, "id", "left")
    return hits.select("id", "citation", "court_name", F.round("bm25", 6).alias("bm25"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"))


@_query(with_views("j", _bm25("j", _WORDS.format("text"), "the", "with") + " SELECT id, round(bm25, 6) AS bm25 FROM s"))
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance from an index of postings that is written first and then read by the query's terms (TXT-2, TXT-4)."""
    index = BlockIndex(spark, Scratch(spark, "postings").root).build(views.judgments(spark, sf_dir))
    return index.scores("the with").select("id", F.round("bm25", 6).alias("bm25"))


def _chunk_id(doc: str = "doc_id", para: str = "para_index"):
    return (F.col(doc) * 100000 + F.col(para)).alias("chunk_id")


_DIMENSION = 16
_HASHED = """SELECT {key}, ('0x' || substr(h, 1, 7))::BIGINT % 16 AS b, sum(CASE WHEN ('0x' || substr(h, 8, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v
    FROM (SELECT {key}, sha256(unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))) AS h FROM {rows}) GROUP BY ALL"""


@_query(with_views("p j", ", k AS (SELECT doc_id * 100000 + para_index AS id, doc_id, para_index, text FROM p)" + _bm25("k", _WORDS.format("text"), "the", "with") + f""",
    cv AS ({_HASHED.format(key="id", text="text", rows="k")}), qv AS ({_HASHED.format(key="x", text="x", rows="(SELECT 'the with' AS x)")}),
    sim AS (SELECT k.id, round(coalesce(d, 0.0) / sqrt(greatest(coalesce(nn, 1), 1e-300)) / (SELECT sqrt(sum(v * v)) FROM qv), 9) AS s FROM k
      LEFT JOIN (SELECT id, sum(v * v) AS nn FROM cv GROUP BY 1) USING (id) LEFT JOIN (SELECT id, sum(cv.v * qv.v) AS d FROM cv JOIN qv USING (b) GROUP BY 1) USING (id)),
    kw AS (SELECT id, row_number() OVER (ORDER BY round(bm25, 9), id) AS kr FROM s QUALIFY kr <= 64), vc AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS vr FROM sim QUALIFY vr <= 64),
    fused AS (SELECT id, coalesce(kr, 0) AS keyword_rank, coalesce(vr, 0) AS vector_rank, coalesce(1.0 / (60 + kr), 0) + coalesce(1.0 / (60 + vr), 0) AS score FROM kw FULL JOIN vc USING (id) ORDER BY score DESC, id LIMIT 8),
    c AS (SELECT 'SRC' || n_nationkey AS code, n_name AS name FROM nation WHERE n_nationkey <> 3)
    SELECT k.id AS chunk_id, k.doc_id, k.para_index, k.text, keyword_rank, vector_rank, round(score, 9) AS score, j.title, j.date, coalesce(c.name, j.court) AS court_name
    FROM fused JOIN k USING (id) LEFT JOIN j ON j.id = k.doc_id LEFT JOIN c ON c.code = j.court"""))  # fmt: skip
def rag_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid hits of one descriptor's chunks with the metadata of their documents (VEC-9, FLT-6, JN-14, JN-15, PRJ-2)."""
    docs = views.judgments(spark, sf_dir)
    chunks = retrieval.chunks(docs).select(_chunk_id(), "doc_id", "para_index", "text")
    index = Scratch(spark, "index").table(rag.build_index(chunks, "hash-16", _DIMENSION, lambda text: retrieval.hashed_embedding(text, _DIMENSION)), "vectors")
    vectors = index.filter("descriptor_id = 'hash-16'").select(_chunk_id(), "vector")
    hits = rag.hybrid_hits(chunks, vectors, "the with", retrieval.hashed_embedding(F.lit("the with"), _DIMENSION), docs, _courts(spark, sf_dir), 8)
    return hits.select("chunk_id", "doc_id", "para_index", "text", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("keyword_rank", "vector_rank")], F.round("score", 9).alias("score"), "title", "date", "court_name")


@_query("""WITH d AS (SELECT label, count(*) AS chunk_count, max(vec_id) AS built_at, label % 2 AS model, 'root' || (label % 2) AS corpus_root FROM embeddings GROUP BY label),
    n AS (SELECT *, sha256('4:hash' || strlen('v' || label) || ':v' || label || '2:64') AS descriptor_id FROM d)
    SELECT descriptor_id, label, chunk_count, row_number() OVER (PARTITION BY model ORDER BY built_at DESC, descriptor_id DESC) = 1 AS latest, corpus_root <> 'root' || (SELECT max(label) % 2 FROM d) AS stale FROM n""")  # fmt: skip
def descriptor_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes with their sizes, the latest of each model, and whether their corpus is out of date (AGG-22, WIN-6, VEC-7, ST-6)."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("descriptor_id", rag.descriptor_id(F.lit("hash"), F.concat(F.lit("v"), "label"), F.lit(64)))
    about = vectors.groupBy("descriptor_id", "label").agg(F.max("vec_id").alias("built_at")).withColumns({"model": F.col("label") % 2, "corpus_root": F.concat(F.lit("root"), F.col("label") % 2)})
    now = about.agg(F.concat(F.lit("root"), F.max("label") % 2).alias("root"))
    rows = rag.with_staleness(rag.with_latest(about), now).join(rag.chunk_counts(vectors), "descriptor_id")
    return rows.select("descriptor_id", "label", "chunk_count", "latest", "stale")


# --- re-extraction and releases ------------------------------------------------------------------------------------

_KEYS = """, keys AS (SELECT id, idx, CASE k % 4 WHEN 0 THEN 'neutral:' || year || ':ZACC:' || (1 + c % 50) WHEN 1 THEN 'reported:' || year || ':' || (1 + k % 6) || ':SA:' || (1 + c % 900)
      WHEN 2 THEN 'reported:' || year || '::AD:' || (1 + c % 500) ELSE 'caseno:CCT:' || (1 + c % 300) || '/' || printf('%02d', k % 100) END AS citation_key FROM ct),
    own AS (SELECT citation_key, min(id) AS to_doc FROM keys GROUP BY 1),
    x AS (SELECT id AS from_doc, to_doc, count(DISTINCT idx) AS paragraph_count FROM keys JOIN own USING (citation_key) WHERE id <> to_doc GROUP BY 1, 2)"""


def _reextracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cite.extract_citations(views.citation_texts(spark, sf_dir))
    owners = found.groupBy("citation_key").agg(F.min("id").alias("doc_id"))
    return graph.reextracted_edges(found, owners)


@_query(with_views("ct", _KEYS + " SELECT from_doc, to_doc, paragraph_count FROM x"))
def reextracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges found anew in stored text: keys resolved to their owners, citing paragraphs counted (GRA-7, AGG-17, JN-21, GRA-6)."""
    return _reextracted(spark, sf_dir)


@_query(with_views("ct", _KEYS + """, st AS (SELECT from_doc, to_doc, paragraph_count + (from_doc % 5 = 0)::INTEGER AS paragraph_count FROM x WHERE (from_doc + to_doc) % 7 <> 0)
    SELECT *, 'stored' AS side FROM (SELECT * FROM st EXCEPT ALL SELECT from_doc, to_doc, paragraph_count FROM x) UNION ALL SELECT *, 'recomputed' FROM (SELECT from_doc, to_doc, paragraph_count FROM x EXCEPT ALL SELECT * FROM st)"""))  # fmt: skip
def edges_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a stored graph that lost and altered edges differs from the one in the text (SET-7)."""
    found = _reextracted(spark, sf_dir)
    stored = found.filter("(from_doc + to_doc) % 7 <> 0").withColumn("paragraph_count", F.col("paragraph_count") + (F.col("from_doc") % 5 == 0).cast("long"))
    return release.same_rows(stored, found)


@_query("""SELECT l_partkey AS src, l_suppkey AS dst, max(l_linenumber - 1)::INTEGER AS paragraph_count FROM lineitem WHERE l_linenumber > 1 AND l_partkey <> l_suppkey GROUP BY 1, 2""")
def encoded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph file's edges: no self edges, no empty ones, the largest count of each pair (FLT-10, AGG-13)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_linenumber") - 1).alias("paragraph_count"))
    return graph.encoded_edges(rows)


@_query("""WITH o AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT DISTINCT sha256(text) AS hash, octet_length(encode(text)) AS size FROM documents WHERE doc_id % 7 <> 0)
    SELECT count(*) AS added_files, coalesce(sum(size), 0)::BIGINT AS added_bytes FROM n WHERE hash NOT IN (SELECT hash FROM o)""")  # fmt: skip
def delta_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync from one snapshot to the next has to fetch (AGG-18)."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id", F.octet_length("text").alias("size"))
    old, new = docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 7 <> 0")
    return corpus.added_bytes(corpus.snapshot_delta(old, new), new)


@_query("""WITH d AS (SELECT sha256(text) AS id, min(doc_id) AS d FROM documents GROUP BY 1), e AS (SELECT a.id AS f, b.id AS t, a.d FROM d a JOIN d b ON b.d = a.d + 1),
    gone AS (SELECT id FROM d WHERE d % 4 = 1), k AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM gone) AS g, (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM e WHERE d % 6 = 0) AS x,
      (SELECT count(*) FROM (SELECT f AS id FROM e UNION SELECT t FROM e) WHERE id IN (SELECT id FROM gone)) AS open)
    SELECT 1 AS number, 'file set' AS name, CASE WHEN g > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS examined, g AS faults FROM k
    UNION ALL SELECT 2, 'document hashes', 'PASS', n - g, 0 FROM k UNION ALL SELECT 3, 'corpus root', CASE WHEN g > 0 THEN 'FAIL' ELSE 'PASS' END, n - g, (g > 0)::INTEGER FROM k
    UNION ALL SELECT 4, 'closed references', CASE WHEN open > 0 THEN 'FAIL' ELSE 'PASS' END, m, open FROM k UNION ALL SELECT 5, 'graph root', 'PASS', m, 0 FROM k
    UNION ALL SELECT 6, 're-extraction', CASE WHEN x > 0 THEN 'FAIL' ELSE 'PASS' END, m - x, x FROM k UNION ALL SELECT 7, 'chain', 'SKIP', 0, 0 FROM k""")  # fmt: skip
def release_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of a release that lost a quarter of its documents and some of its edges' citations (REL-6, REL-9)."""
    docs = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("id")).agg(F.min("doc_id").alias("d"), F.min("text").alias("text"))
    files = release.file_index(docs)
    held = docs.filter("d % 4 <> 1").select("id", "d", "text", F.concat(F.lit("documents/"), "id").alias("path"))
    after = docs.select(F.col("id").alias("to_doc"), (F.col("d") - 1).alias("d"))
    edges = docs.select(F.col("id").alias("from_doc"), "d").join(after, "d").select("from_doc", "to_doc", F.lit(1).cast("long").alias("paragraph_count"), "d")
    roots = corpus.sorted_root(docs, "id").withColumnRenamed("root", "corpus_root").crossJoin(corpus.sorted_root(edges, "from_doc", "to_doc", "paragraph_count").withColumnRenamed("root", "graph_root"))
    manifest = roots.withColumn("previous", F.lit(None).cast("string"))
    return release.verify(files, held, edges.drop("d"), edges.filter("d % 6 <> 0").drop("d"), manifest, None)


# --- claims --------------------------------------------------------------------------------------------------------


@_query("""WITH e AS (SELECT event_id AS i, sha256('s' || (event_id % 5000)) AS s, event_id % 50 AS u FROM events),
    r AS (SELECT *, CASE WHEN i % 11 = 0 THEN 'malformed' WHEN i % 17 = 0 OR i % 13 = 0 THEN 'rejected' ELSE 'ok' END AS k,
      CASE WHEN i % 11 = 0 THEN 'no from_doc' WHEN i % 13 = 0 THEN 'treatment' WHEN i % 17 = 0 THEN 'signer wrong_length' ELSE '' END AS reason FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY k, s, u ORDER BY i) AS m FROM r)
    SELECT CASE WHEN k <> 'ok' THEN k WHEN m = 1 THEN 'new' ELSE 'duplicate' END AS status, reason, count(*) AS n FROM n GROUP BY 1, 2""")  # fmt: skip
def bundle_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the lines of a bundle that Spark writes from all events: each line is parsed and judged (SRC-20, CR-9, FLT-12)."""
    e = F.col("event_id")
    names = F.array(*[F.lit(x) for x in attest.TREATMENTS])
    half = F.sha2(F.concat(F.lit("s"), e % 5000), 256)
    fields = F.struct(
        F.sha2(F.concat(F.lit("d"), e % 97), 256).alias("from_doc"), F.sha2(F.concat(F.lit("d"), e % 41), 256).alias("to_doc"),
        F.when(e % 13 == 0, "praised").otherwise(F.element_at(names, (e % 5 + 1).cast("int"))).alias("treatment"),
        F.when(e % 17 == 0, F.lit("abc")).otherwise(F.sha2(F.concat(F.lit("k"), e % 50), 256)).alias("signer"), F.concat(half, half).alias("signature"), F.lit("2024-01-01").alias("created_at"),
    )
    lines = table(spark, sf_dir, "events").select(F.lit("events").alias("path"), e.alias("line"), F.when(e % 11 == 0, F.lit('{"from_doc": ')).otherwise(F.to_json(fields)).alias("value"))
    return bundles.parse_lines(lines).groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


_FIELD = "unhex(lpad(hex(strlen({0})), 16, '0')) || encode({0})"


@_query(with_views("a", f", f AS (SELECT id, from_doc::VARCHAR AS a, to_doc::VARCHAR AS b, treatment AS c, signer AS d FROM a) SELECT id, sha256(encode('claim-v1' || chr(10)) || {' || '.join(_FIELD.format(x) for x in 'abcd')}) AS digest FROM f"))
def claim_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what each claim's signature covers (CR-1)."""
    claims = views.attestations(spark, sf_dir)
    return claims.select("id", F.sha2(attest.signing_bytes("claim-v1", *[F.col(c) for c in ("from_doc", "to_doc", "treatment", "signer")]), 256).alias("digest"))


# --- titles, addresses, crawl rules --------------------------------------------------------------------------------


@_query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A' || doc_id || ' (NIG) LTD v B' WHEN 1 THEN 'A' || doc_id || ' v B' WHEN 2 THEN 'In re C' || doc_id ELSE 'D' || doc_id || ' v E' END AS parties,
    CASE doc_id % 4 WHEN 0 THEN 'Case CCT ' || doc_id || '/20' WHEN 3 THEN 'Case 5' END AS description, CASE doc_id % 4 WHEN 0 THEN 'Ruling' WHEN 3 THEN 'Judgment' END AS kind,
    CASE doc_id % 4 WHEN 0 THEN '2020-05-05' WHEN 1 THEN '2019-06-01' END AS date FROM documents""")  # fmt: skip
def title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties, description, kind and date of titles that Spark writes for all documents (SC-17, SC-18, SC-19)."""
    d = F.col("doc_id")
    title = (
        F.when(d % 4 == 0, F.format_string("A%d (NIG) LTD v B (Case CCT %d/20) [2020] ZACC %d (5 May 2020) (Ruling)", d, d, d)).when(d % 4 == 1, F.format_string("A%d v B [2019] ZASCA %d (1 June 2019)", d, d))
        .when(d % 4 == 2, F.format_string("In re C%d (Pty) (Urgent Order Now Please)", d)).otherwise(F.format_string("D%d v E (Case 5) [2021] KECA %d (Judgment)", d, d))
    )
    return table(spark, sf_dir, "documents").select("doc_id", titles.parties(title).alias("parties"), titles.case_description(title).alias("description"), titles.decision_type(title).alias("kind"), tx.iso_date(title).alias("date"))


@_query(r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', '', 'g'), '>', ''), '(?s)<.*$', ''),
    '&nbsp;', ' '), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title FROM pages""")  # fmt: skip
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best title of every page: for sharing, else its main heading (SC-16, SC-15)."""
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(titles.og_title(F.col("html")), titles.h1_title(F.col("html"))).alias("title"))


@_query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN upper(lang) END AS country, upper(source) AS court, 1990 + doc_id % 35 AS year, doc_id AS number,
    printf('[%d] %s %d', 1990 + doc_id % 35, upper(source), doc_id) AS citation FROM documents""")  # fmt: skip
def akn_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country, court, year and number of addresses that Spark writes for all documents (SC-20)."""
    d = F.col("doc_id")
    front = F.when(d % 5 == 0, "https://h.example/x").otherwise(F.concat(F.lit("https://h.example/akn/"), "lang"))
    url = F.concat(front, F.lit("/judgment/"), "source", F.format_string("/%d/%d/eng@2020-01-01?x=1", 1990 + d % 35, d))
    parts = titles.frbr_parts(url)
    return table(spark, sf_dir, "documents").select("doc_id", titles.akn_country(url).alias("country"), parts["court"].alias("court"), parts["year"].alias("year"), parts["number"].alias("number"), titles.neutral_citation(url).alias("citation"))


@_query(r"""SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]+') || link AS link FROM (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)) AS link FROM pages)""")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole addresses of every page's links (SC-21)."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(tx.html_links(F.col("html"))).alias("href"))
    return rows.select("page_id", titles.resolve_url(F.col("url"), F.col("href")).alias("link"))


@_query(r"""WITH u AS (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, split_part(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/', 2) AS first FROM pages),
    h AS (SELECT host, '/' || min(first) AS path, count(*)::DOUBLE AS pages FROM u GROUP BY host)
    SELECT host, '*' AS agent, path AS pattern, false AS allow, NULL::DOUBLE AS crawl_delay, NULL AS signal FROM h UNION ALL SELECT host, '*', path || '/1', true, NULL, NULL FROM h
    UNION ALL SELECT host, a, '/', false, NULL, NULL FROM h, (VALUES ('goodbot'), ('other')) v(a) UNION ALL SELECT host, a, NULL, NULL, pages, NULL FROM h, (VALUES ('goodbot'), ('other')) v(a)
    UNION ALL SELECT host, '*', NULL, NULL, NULL, 'ai-train=no' FROM h UNION ALL SELECT host, 'last', NULL, NULL, NULL, NULL FROM h""")  # fmt: skip
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl rules parsed from the files that Spark writes for every host, of its own pages' paths and number (SC-22, SC-23)."""
    pages = table(spark, sf_dir, "pages").select(tx.url_part(F.col("url"), "host").alias("host"), tx.url_part(F.col("url"), "country").alias("first"))
    hosts = pages.groupBy("host").agg(F.min("first").alias("path"), F.count("*").cast("string").alias("pages"))
    lines = ["Disallow: /lost", "User-agent: *", "Disallow: /{path}", "Allow: /{path}/1 # but these", "Disallow:", "", "no directive", "User-Agent: GoodBot/1.2", "user-agent: other", "Disallow: /", "Crawl-delay: {pages}", "Content-Signal: AI-train=no", "User-agent: last", ""]
    body = F.replace(F.replace(F.lit("\n".join(lines)), F.lit("{path}"), F.col("path")), F.lit("{pages}"), F.col("pages"))
    return crawl.robots_groups(hosts.select("host", body.alias("body"))).select("host", "agent", "pattern", "allow", "crawl_delay", "signal")


@_query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages), s(ord, source_id, h) AS (VALUES (1, 'deep', 'x.blog.example.org'), (2, 'org', 'example.org'), (3, 'com', 'Example.com'))
    SELECT page_id, host, (SELECT min_by(source_id, ord) FROM s WHERE p.host <> '' AND (p.host = lower(h) OR suffix(p.host, '.' || lower(h)) OR suffix(lower(h), '.' || p.host))) AS source_id FROM p""")  # fmt: skip
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of every page's host (SRC-14, JN-24)."""
    pages = table(spark, sf_dir, "pages").select("page_id", tx.url_part(F.col("url"), "host").alias("host"))
    sources = spark.createDataFrame([(1, "deep", "x.blog.example.org"), (2, "org", "example.org"), (3, "com", "Example.com")], "ord int, source_id string, source_host string")
    return registry.sources_of_hosts(pages, sources)


@_query("""SELECT doc_id, 'caseno:CCT:' || (1 + doc_id % 900) || '/20,neutral:' || (1990 + doc_id % 35) || ':ZACC:' || (1 + doc_id % 900) || ',reported:2020:3:SA:' || (1 + doc_id % 900) AS keys FROM documents""")
def own_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that every document's own identifiers claim, sorted, each once (CT-9, SET-5)."""
    d, n = F.col("doc_id"), 1 + F.col("doc_id") % 900
    own = F.array(F.format_string("[%d] ZACC %d", 1990 + d % 35, n), F.format_string("2020 (3) SA %d (SCA)", n), F.format_string("CCT %d/20", n), F.format_string("2020 (3) SA %d", n))
    found = cite.extract_citations(table(spark, sf_dir, "documents").select("doc_id", F.explode(own).alias("text")))
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("citation_key")), ",").alias("keys"))


@_query(with_views("j linked", _bm25("j", _WORDS.format("text"), "the", "with") + """, b AS (SELECT to_doc AS id, count(DISTINCT from_doc) AS n FROM linked WHERE from_doc <> to_doc GROUP BY 1),
    m AS (SELECT s.id, s.bm25, title, court, date, region, authority FROM s JOIN j USING (id) WHERE substr(date, 1, 4) >= '2000')
    SELECT (SELECT count(*) FROM m) AS total, m.id, title, court, coalesce(date, '') AS date, region, authority, round(bm25, 6) AS bm25, coalesce(b.n, 0) AS cited_by_count FROM m LEFT JOIN b USING (id) ORDER BY m.bm25 - 2.0 * authority, m.id LIMIT 20 OFFSET 5"""))  # fmt: skip
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later page of a filtered search: the total, and hits with all that a result shows (ORD-1, AGG-1, PRJ-1, FLT-15)."""
    cites = views.citations(spark, sf_dir).select("from_doc", "citation_key").distinct()  # places do not count: what repeats goes before rows travel
    cited = corpus.cited_by_count(corpus.link(cites, corpus.key_owners(views.claims(spark, sf_dir))))
    page = hits_page(views.corpus_index(spark, sf_dir), views.judgments(spark, sf_dir), "the with", corpus.filters(year_from=2000), 20, 5, cited)
    return page.select("total", "id", "title", "court", F.coalesce("date", F.lit("")).alias("date"), "region", "authority", F.round("bm25", 6).alias("bm25"), "cited_by_count")


@_query("""WITH r AS (SELECT upper(lang) || '-' || upper(source) AS code FROM documents), c AS (SELECT code, count(*) AS documents FROM r GROUP BY 1),
    k AS (SELECT DISTINCT ON (code) code, ['apex', 'appellate', 'high_court', 'tribunal'][1 + length(code) % 4] AS tier FROM c WHERE code NOT LIKE 'FR%')
    SELECT code, coalesce('Court ' || k.code, c.code) AS name, coalesce(tier, 'unknown') AS tier, documents FROM c LEFT JOIN k USING (code)""")
def courts_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courts with names, tiers and documents, by the rank of their tier; some are not in the registry (AGG-3, ORD-8)."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.upper("lang"), F.lit("-"), F.upper("source")).alias("court"))
    tiers = F.array(*[F.lit(t) for t in ("apex", "appellate", "high_court", "tribunal")])
    known = docs.select(F.col("court").alias("code")).distinct().filter("code not like 'FR%'").withColumns({"name": F.concat(F.lit("Court "), "code"), "tier": F.element_at(tiers, (1 + F.length("code") % 4).cast("int"))})
    return corpus.courts_listing(docs, known)


@_query(with_views("w", """, v AS (SELECT *, NOT starts_with(sha256(witness || ':' || doc_id::VARCHAR), '0') AS good FROM w WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)),
    f AS (SELECT doc_id, witness, raw_hash, row_number() OVER (PARTITION BY doc_id, witness ORDER BY fetched_at, raw_hash) AS r FROM v WHERE good), s AS (SELECT doc_id, raw_hash, count(*) AS n FROM f WHERE r = 1 GROUP BY 1, 2),
    b AS (SELECT doc_id, raw_hash, n FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, raw_hash) = 1)
    SELECT o.o_orderkey AS id, CASE WHEN coalesce(b.n, 0) >= 2 THEN 'corroborated' WHEN b.n = 1 THEN 'single' ELSE 'manual' END AS provenance_class, coalesce(b.raw_hash, '') AS raw_hash,
      coalesce((SELECT string_agg(witness, ',' ORDER BY witness) FROM f WHERE f.doc_id = o.o_orderkey AND r = 1 AND f.raw_hash = b.raw_hash), '') AS agreeing,
      coalesce((SELECT string_agg(witness || '=' || f.raw_hash, ',' ORDER BY witness) FROM f WHERE f.doc_id = o.o_orderkey AND r = 1 AND f.raw_hash <> b.raw_hash), '') AS conflicting,
      (SELECT count(*) FROM v WHERE v.doc_id = o.o_orderkey AND NOT good) AS rejected FROM orders o LEFT JOIN b ON b.doc_id = o.o_orderkey WHERE o.o_orderkey % 3 = 0"""))  # fmt: skip
def corroboration_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence for given documents: who agrees, who does not, and how many records were refused (AGG-10)."""
    documents = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    good = ~F.startswith(F.sha2(F.concat("witness", F.lit(":"), F.col("doc_id").cast("string")), 256), F.lit("0"))
    found = corpus.corroboration_report(documents, views.witness_records(spark, sf_dir), good)
    pairs = F.transform("conflicting", lambda c: F.concat(c["witness"], F.lit("="), c["raw_hash"]))
    return found.select("id", "provenance_class", F.coalesce("raw_hash", F.lit("")).alias("raw_hash"), F.array_join("agreeing", ",").alias("agreeing"), F.array_join(pairs, ",").alias("conflicting"), "rejected")


@_query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, u.vec_id AS chunk_id, list_sum(list_transform(range(1, len(u.v) + 1), lambda i: u.v[i] * q.v[i])) / u.n / q.n AS similarity FROM u, u AS q WHERE q.vec_id % 100 = 0)
    SELECT query_id, rank::INTEGER AS rank, chunk_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def cosine_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar vectors of a batch of queries, from groups around pivots (VEC-3, ORD-11)."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    queries = vectors.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    found = MetricIndex(spark, Scratch(spark, "metric-index").root).build(vectors).search(queries, 10)
    return found.select("query_id", "rank", F.col("id").alias("chunk_id"), F.round("similarity", 6).alias("similarity"))
