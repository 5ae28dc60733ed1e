"""The registered queries of the engine and their SQL. Each pair has the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import citations as cite
from lexmill.functions import crawl
from lexmill.functions import text as tx
from lexmill.operators import attest, corpus, graph, release, retrieval, search
from lexmill.plans import views
from lexmill.plans.views import with_views
from lexmill.session import table, tasks_for

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict:
    from lexmill.plans import changes, lookups, markup  # noqa: F401  add their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# --- listings, filters, counts -------------------------------------------------------------------------------------


@_query(with_views("j", "SELECT id, court, region, date, authority FROM j ORDER BY authority DESC, id LIMIT 20"))
def browse_by_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of all documents (ORD-2)."""
    return corpus.browse(views.judgments(spark, sf_dir)).select("id", "court", "region", "date", "authority")


@_query(with_views("j", "SELECT id, court, region, date FROM j WHERE court = 'SRC3' AND region = 'EN' AND substr(date, 1, 4) >= '1995' AND substr(date, 1, 4) <= '2010'"))
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four listing filters (FLT-1 to FLT-4)."""
    where = corpus.filters("src3", " en ", 1995, 2010)
    return views.judgments(spark, sf_dir).filter(where).select("id", "court", "region", "date")


@_query(with_views("j", "SELECT court, count(*) AS n FROM j GROUP BY 1"))
def courts_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by court (AGG-3)."""
    return corpus.count_by(views.judgments(spark, sf_dir), "court")


@_query(with_views("j", "SELECT region, count(*) AS n FROM j GROUP BY 1"))
def regions_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by region (AGG-4)."""
    return corpus.count_by(views.judgments(spark, sf_dir), "region")


@_query(with_views("n", """SELECT tier, count(*) AS n, CASE tier WHEN 'apex' THEN 0 WHEN 'appellate' THEN 1 WHEN 'specialist_appellate' THEN 2 WHEN 'high_court' THEN 3
    WHEN 'specialist_high' THEN 4 WHEN 'tribunal' THEN 5 WHEN 'lower' THEN 6 ELSE 7 END AS tier_rank FROM n GROUP BY 1"""))  # fmt: skip
def court_tier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courts by tier with the tier's rank (ORD-8, NUM-5)."""
    return corpus.count_by(views.graph_nodes(spark, sf_dir), "tier").withColumn("tier_rank", graph.tier_rank(F.col("tier")))


@_query(with_views("j linked", """SELECT (SELECT count(*) FROM j) AS documents, (SELECT count(DISTINCT court) FROM j) AS courts,
    (SELECT count(*) FROM (SELECT DISTINCT from_doc, to_doc FROM linked WHERE to_doc IS NOT NULL AND to_doc <> from_doc)) AS edges,
    (SELECT count(*) FROM linked WHERE to_doc IS NULL) AS unresolved"""))  # fmt: skip
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's counts (AGG-5)."""
    return corpus.stats(views.judgments(spark, sf_dir), _linked(spark, sf_dir))


# --- keys, links, edges --------------------------------------------------------------------------------------------


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.link(views.citations(spark, sf_dir), corpus.key_owners(views.claims(spark, sf_dir)))


@_query(with_views("cl", "SELECT citation_key, min(doc_id) AS doc_id FROM cl GROUP BY 1"))
def key_owner_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of every key (SNK-3, AGG-11)."""
    return corpus.key_owners(views.claims(spark, sf_dir))


@_query(with_views("linked", "SELECT from_doc, from_para, citation_key, coalesce(to_doc, -1) AS to_doc FROM linked"))
def resolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation with its target (JN-3)."""
    return _linked(spark, sf_dir).select("from_doc", "from_para", "citation_key", F.coalesce("to_doc", F.lit(-1)).alias("to_doc"))


@_query(with_views("c cl", """, early AS (SELECT citation_key, min(doc_id) AS old_doc FROM cl WHERE doc_id > 100 GROUP BY 1), late AS (SELECT citation_key, min(doc_id) AS to_doc FROM cl GROUP BY 1)
    SELECT from_doc, from_para, citation_key, coalesce(to_doc, -1) AS to_doc, old_doc IS DISTINCT FROM to_doc AS changed FROM c LEFT JOIN early USING (citation_key) LEFT JOIN late USING (citation_key)"""))  # fmt: skip
def relink_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What relinking changes once documents up to 100 have arrived (SNK-5, JN-4, ST-2)."""
    claims = views.claims(spark, sf_dir)
    before = corpus.link(views.citations(spark, sf_dir), corpus.key_owners(claims.filter("doc_id > 100")))
    return corpus.relink(before, corpus.key_owners(claims)).select("from_doc", "from_para", "citation_key", F.coalesce("to_doc", F.lit(-1)).alias("to_doc"), "changed")


@_query(with_views("linked", """SELECT from_doc, to_doc, greatest(count(DISTINCT coalesce(from_para, -1)), 1) AS paragraph_count
    FROM linked WHERE to_doc IS NOT NULL AND to_doc <> from_doc GROUP BY 1, 2"""))  # fmt: skip
def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with their citing paragraphs (AGG-2)."""
    return corpus.resolved_edges(_linked(spark, sf_dir))


@_query(with_views("linked", "SELECT citation_key, count(*) AS n FROM linked WHERE to_doc IS NULL GROUP BY 1"))
def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that nobody claims (FLT-8)."""
    return _linked(spark, sf_dir).filter("to_doc is null").groupBy("citation_key").agg(F.count("*").alias("n"))


@_query(with_views("linked", "SELECT to_doc, count(DISTINCT from_doc) AS cited_by_count FROM linked WHERE to_doc IS NOT NULL AND from_doc <> to_doc GROUP BY 1"))
def cited_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citing documents of each, without itself (AGG-6)."""
    return corpus.cited_by_count(_linked(spark, sf_dir))


@_query(with_views("linked", "SELECT to_doc, count(DISTINCT from_doc) AS cited_by_count FROM linked WHERE to_doc IS NOT NULL GROUP BY 1"))
def cited_by_count_incl_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citing documents of each as search counts them (JN-5)."""
    return corpus.cited_by_count(_linked(spark, sf_dir), with_self=True)


@_query(with_views("c", "SELECT from_doc, count(*) AS cites_count FROM c GROUP BY 1"))
def cites_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbound citations of each document (AGG-7)."""
    return corpus.cites_count(views.citations(spark, sf_dir))


@_query(with_views("linked j", "SELECT l.to_doc, l.from_doc, l.from_para, j.date, j.court FROM linked l JOIN j ON j.id = l.from_doc WHERE l.from_doc <> l.to_doc"))
def cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbound citations with the citing document (JN-2, GRA-8)."""
    rows = corpus.cited_by(_linked(spark, sf_dir), views.judgments(spark, sf_dir))
    return rows.select("to_doc", "from_doc", "from_para", "date", "court")


# --- citations in text ---------------------------------------------------------------------------------------------


@_query(with_views("ct", """SELECT id, idx,
    CASE k % 4 WHEN 0 THEN 'neutral' WHEN 3 THEN 'caseno' ELSE 'reported' END AS kind,
    CASE k % 4 WHEN 0 THEN 'neutral:' || year || ':ZACC:' || (1 + c % 50) WHEN 1 THEN 'reported:' || year || ':' || (1 + k % 6) || ':SA:' || (1 + c % 900)
      WHEN 2 THEN 'reported:' || year || '::AD:' || (1 + c % 500) ELSE 'caseno:CCT:' || (1 + c % 300) || '/' || printf('%02d', k % 100) END AS citation_key,
    (CASE k % 4 WHEN 0 THEN 1 + k % 90 ELSE 0 END)::INTEGER AS paragraph FROM ct"""))  # fmt: skip
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of prose with key and paragraph (CT-0 to CT-8)."""
    found = cite.extract_citations(views.citation_texts(spark, sf_dir))
    return found.select("id", "idx", "kind", "citation_key", F.coalesce("pinpoint.start", F.lit(0)).alias("paragraph"))


@_query(with_views("ct", """, keys AS (SELECT id, CASE k % 4 WHEN 0 THEN 'neutral:' || year || ':ZACC:' || (1 + c % 50) WHEN 1 THEN 'reported:' || year || ':' || (1 + k % 6) || ':SA:' || (1 + c % 900)
      WHEN 2 THEN 'reported:' || year || '::AD:' || (1 + c % 500) ELSE 'caseno:CCT:' || (1 + c % 300) || '/' || printf('%02d', k % 100) END AS citation_key FROM ct)
    SELECT citation_key, min(id) AS doc_id, count(*) AS n FROM keys GROUP BY 1"""))  # fmt: skip
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted keys with their smallest citing document (CT-9, GRA-6)."""
    found = cite.extract_citations(views.citation_texts(spark, sf_dir))
    return found.groupBy("citation_key").agg(F.min("id").alias("doc_id"), F.count("*").alias("n"))


# --- graph ---------------------------------------------------------------------------------------------------------


@_query(with_views("we", "SELECT src, dst, round(weight, 9) AS weight FROM we"))
def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge weights from tier and depth (GRA-1, NUM-1, NUM-2)."""
    edges = graph.weighted_edges(views.graph_nodes(spark, sf_dir), views.graph_edges(spark, sf_dir))
    return edges.select("src", "dst", F.round("weight", 9).alias("weight"))


@_query(with_views("we n", """, ow AS (SELECT src, sum(weight) AS w FROM we GROUP BY 1), cnt AS (SELECT count(*)::DOUBLE AS n FROM n),
    pr(i, id, score) AS (
      SELECT 0, id, 1.0::DOUBLE / (SELECT n FROM cnt) FROM n
      UNION ALL
      SELECT * FROM (
        WITH cur AS (SELECT i, id, score FROM pr WHERE i < 50),
        loose AS (SELECT coalesce(sum(score), 0.0) AS s FROM cur WHERE id NOT IN (SELECT src FROM ow)),
        got AS (SELECT we.dst AS id, sum(cur.score * we.weight / ow.w) AS g FROM we JOIN ow USING (src) JOIN cur ON cur.id = we.src GROUP BY 1)
        SELECT cur.i + 1, cur.id, 0.15 / (SELECT n FROM cnt) + 0.85 * (coalesce(got.g, 0.0) + (SELECT s FROM loose) / (SELECT n FROM cnt)) FROM cur LEFT JOIN got USING (id)
      )
    )
    SELECT id, round(score / (SELECT max(score) FROM pr WHERE i = 50), 6) AS score FROM pr WHERE i = 50"""))  # fmt: skip
def pagerank_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty iterations of weighted PageRank, the best score one (GRA-2)."""
    nodes = views.graph_nodes(spark, sf_dir)
    scores = graph.pagerank(nodes, graph.weighted_edges(nodes, views.graph_edges(spark, sf_dir)))
    return scores.select("id", F.round("score", 6).alias("score"))


_HOPS = """, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, depth) AS (
      SELECT DISTINCT src, 0 FROM u WHERE src = 1 UNION SELECT u.dst, r.depth + 1 FROM r JOIN u ON u.src = r.id WHERE r.depth < {hops}), best AS (SELECT id, min(depth) AS depth FROM r GROUP BY 1)"""


def _near(spark: SparkSession, sf_dir: str, hops: int) -> DataFrame:
    return graph.neighbourhood(views.graph_edges(spark, sf_dir), 1, hops)


@_query(with_views("e", _HOPS.format(hops=1) + " SELECT id, depth FROM best"))
def khop_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one node (GRA-4)."""
    return _near(spark, sf_dir, 1)


@_query(with_views("e", _HOPS.format(hops=2) + " SELECT id, depth FROM best"))
def khop_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps around one node (GRA-4)."""
    return _near(spark, sf_dir, 2)


@_query(with_views("e", _HOPS.format(hops=2) + " SELECT src, dst, paragraph_count FROM e WHERE src IN (SELECT id FROM best) AND dst IN (SELECT id FROM best)"))
def khop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges within two steps (JN-11)."""
    return graph.induced_edges(views.graph_edges(spark, sf_dir), _near(spark, sf_dir, 2))


# --- full text -----------------------------------------------------------------------------------------------------

_TOKENS = ", tok AS (SELECT id, region, authority, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS w FROM j)"


@_query(with_views("j", _TOKENS + " SELECT id FROM tok WHERE list_contains(w, 'the') AND list_contains(w, 'of') AND region = 'EN'"))
def search_term_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a region with two words (TXT-1, TXT-3)."""
    return search.matches(views.judgments(spark, sf_dir), "the (of)", where=F.col("region") == "EN").select("id")


@_query(with_views("j", _TOKENS + " SELECT id FROM tok WHERE len(list_filter(w, lambda x: starts_with(x, 'tion'))) > 0"))
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a word that starts so (TXT-3)."""
    return search.matches(views.judgments(spark, sf_dir), "tion*").select("id")


@_query(with_views("j", _TOKENS + " SELECT id FROM tok WHERE ' ' || array_to_string(w, ' ') || ' ' LIKE '% of the %'"))
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two words in a row (TXT-3)."""
    return search.matches(views.judgments(spark, sf_dir), '"of the"').select("id")


_BM25 = (
    _TOKENS
    + """, f AS (SELECT *, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS t1, len(list_filter(w, lambda x: x = 'with')) AS t2 FROM tok),
    g AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM f),
    s AS (SELECT id, authority, -(greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / m))
      + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * dl / m))) AS bm25 FROM f, g WHERE t1 > 0 AND t2 > 0)"""
)


@_query(with_views("j", _BM25 + " SELECT id, round(bm25, 6) AS bm25 FROM s"))
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relevance of all matches (TXT-4), from the postings of the query's words."""
    return views.corpus_index(spark, sf_dir).scores("the with").select("id", F.round("bm25", 6).alias("bm25"))


@_query(with_views("j", _BM25 + " SELECT id, round(bm25, 6) AS bm25, authority FROM s ORDER BY s.bm25 - 2.0 * authority, id LIMIT 20"))
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page by relevance and authority (ORD-1), from posting blocks in the order of their bounds."""
    return views.corpus_index(spark, sf_dir).search("the with").hits.select("id", F.round("bm25", 6).alias("bm25"), "authority")


@_query(with_views("j", _TOKENS + " SELECT count(*) AS n FROM tok WHERE list_contains(w, 'the') AND list_contains(w, 'with')"))
def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents match (AGG-1)."""
    return views.corpus_index(spark, sf_dir).scores("the with").agg(F.count("*").alias("n"))


_SNIPPETS = r""", sp AS (SELECT id, string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS ws FROM j),
    bw AS (SELECT id, ws, list_transform(ws, lambda w: regexp_replace(lower(strip_accents(w)), '[^\p{L}\p{N}]', '', 'g')) AS b FROM sp),
    m AS (SELECT id, ws, b FROM bw JOIN (SELECT id FROM tok WHERE list_contains(w, 'the') AND list_contains(w, 'with')) USING (id)),
    h AS (SELECT id, i, b[i] AS k FROM (SELECT id, b, unnest(range(1, len(b) + 1)) AS i FROM m) WHERE b[i] IN ('the', 'with')),
    l AS (SELECT id, i, max(CASE WHEN k = 'the' THEN i END) OVER w AS t, max(CASE WHEN k = 'with' THEN i END) OVER w AS v FROM h WINDOW w AS (PARTITION BY id ORDER BY i)),
    s AS (SELECT id, i, (coalesce(t > i - 18, false))::INTEGER + (coalesce(v > i - 18, false))::INTEGER AS hits, least(CASE WHEN t > i - 18 THEN t END, CASE WHEN v > i - 18 THEN v END) AS a FROM l),
    o AS (SELECT id, min_by((a, i), (-hits, i)) AS w FROM s GROUP BY id),
    c AS (SELECT m.id, ws, b, greatest(least(coalesce(w[1], 1) - least(greatest(18 - (coalesce(w[2], 1) - coalesce(w[1], 1) + 1), 0) // 2, 4), len(ws) - 17), 1) AS a FROM m LEFT JOIN o USING (id))
    SELECT id, CASE WHEN a > 1 THEN '…' ELSE '' END || array_to_string(list_transform(range(a, least(a + 18, len(ws) + 1)), lambda i: CASE WHEN b[i] IN ('the', 'with') THEN '<mark>' || ws[i] || '</mark>' ELSE ws[i] END), ' ')
      || CASE WHEN len(ws) > a + 17 THEN '…' ELSE '' END AS snippet FROM c"""


@_query(with_views("j", _TOKENS + _SNIPPETS))
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut of every match that holds most phrases, marked (TXT-5)."""
    found = search.matches(views.judgments(spark, sf_dir), "the with")
    return found.select("id", search.snippet(F.col("text"), "the with").alias("snippet"))


@_query(with_views("j", _TOKENS + ", x AS (SELECT id, unnest(w) AS term, len(w) AS doc_length FROM tok) SELECT id, term, doc_length, count(*) AS tf FROM x GROUP BY 1, 2, 3"))
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of all documents (TXT-2)."""
    return search.postings(views.judgments(spark, sf_dir)).select("id", "term", "doc_length", "tf")


@_query(with_views("j", _TOKENS + ", x AS (SELECT DISTINCT id, unnest(w) AS term FROM tok) SELECT term, count(*) AS df FROM x GROUP BY 1"))
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's dictionary: builds the index where the application has none yet (TXT-2)."""
    return views.corpus_index(spark, sf_dir).terms()


@_query(with_views("j", _TOKENS + ", x AS (SELECT DISTINCT id, unnest(w) AS term FROM tok) SELECT term, count(*) AS df FROM x WHERE starts_with(term, 'th') GROUP BY 1"))
def search_prefix_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a prefix stands for, from the ranges of the dictionary that can hold them (TXT-3, FLT-5)."""
    return views.corpus_index(spark, sf_dir).terms("th")


@_query(with_views("j", _TOKENS + """, f AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: starts_with(x, 'tion'))) AS t1,
      len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS t2 FROM tok),
    g AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM f)
    SELECT id, round(-(greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / m))
      + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * dl / m))), 6) AS bm25 FROM f, g WHERE t1 > 0 AND t2 > 0"""))  # fmt: skip
def search_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix and a phrase: both from places in posting blocks (TXT-3, TXT-4)."""
    return views.corpus_index(spark, sf_dir).scores('tion* "of the"').select("id", F.round("bm25", 6).alias("bm25"))


@_query(with_views("j", "SELECT id, authority, place FROM (SELECT id, authority, row_number() OVER (ORDER BY authority DESC, id) - 1 AS place FROM j) WHERE place BETWEEN 120 AND 144"))
def browse_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far down the order of authority: the ranges that hold it are read, nothing is sorted (ORD-2, PRJ-6)."""
    return views.corpus_order(spark, sf_dir).page(120, 25).select("id", "authority", "place")


# --- vectors -------------------------------------------------------------------------------------------------------


@_query(with_views("p", "SELECT doc_id, para_index, text FROM p"))
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph chunks of all documents (PRJ-4)."""
    return retrieval.chunks(views.judgments(spark, sf_dir)).select("doc_id", "para_index", "text")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    first = rows.filter("chunk_id = 0").select("vector").first()
    return rows, list(first[0]) if first else [1.0]


_SIM = """sim AS (SELECT e.vec_id AS chunk_id, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))
      / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS s
    FROM embeddings e, embeddings q WHERE q.vec_id = 0)"""


@_query(f"WITH {_SIM} SELECT chunk_id, round(s, 6) AS similarity FROM sim ORDER BY s DESC, chunk_id LIMIT 64")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector candidates of one query (VEC-3, ORD-11)."""
    rows, query = _vectors(spark, sf_dir)
    return retrieval.cosine_top(rows, query, retrieval.candidates(5)).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@_query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every vector (VEC-1)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(retrieval.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@_query(with_views("j", _BM25 + f""", {_SIM}, kw AS (SELECT id AS chunk_id, row_number() OVER (ORDER BY bm25, id) AS kr FROM s QUALIFY kr <= 64), vc AS (SELECT chunk_id, row_number() OVER (ORDER BY s DESC, chunk_id) AS vr FROM sim QUALIFY vr <= 64)
    SELECT chunk_id, coalesce(kr, 0) AS keyword_rank, coalesce(vr, 0) AS vector_rank, round(coalesce(1.0 / (60 + kr), 0) + coalesce(1.0 / (60 + vr), 0), 9) AS score
    FROM kw FULL JOIN vc USING (chunk_id) ORDER BY coalesce(1.0 / (60 + kr), 0) + coalesce(1.0 / (60 + vr), 0) DESC, chunk_id LIMIT 5"""))  # fmt: skip
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector lists fused by reciprocal ranks (VEC-9, WIN-1 to WIN-3)."""
    rows, query = _vectors(spark, sf_dir)
    k = retrieval.candidates(5)
    keyword = views.corpus_index(spark, sf_dir).scores("the with").select(F.col("id").alias("chunk_id"), "bm25").orderBy("bm25", "chunk_id").limit(k)
    vector = retrieval.cosine_top(rows, query, k)
    fused = retrieval.fuse(retrieval.ranks(keyword, "bm25", "chunk_id"), retrieval.ranks(vector, F.desc("similarity"), "chunk_id"), 5)
    return fused.select("chunk_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("keyword_rank", "vector_rank")], F.round("score", 9).alias("score"))


@_query(with_views("p", """, t AS (SELECT doc_id, para_index, sha256(unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS h FROM p)
    SELECT doc_id, para_index, (('0x' || substr(h, 1, 7))::BIGINT % 256)::INTEGER AS bucket, sum(CASE WHEN ('0x' || substr(h, 8, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS value
    FROM t GROUP BY 1, 2, 3 HAVING value <> 0"""))  # fmt: skip
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed embeddings of all chunks, in sparse form (VEC-4, SNK-8)."""
    return retrieval.embed_chunks(retrieval.chunks(views.judgments(spark, sf_dir)))


# --- text functions ------------------------------------------------------------------------------------------------

_CANON = (
    r"rtrim_lines AS (SELECT doc_id, regexp_replace(regexp_replace(translate(regexp_replace(text, '\r\n?', chr(10), 'g'), "
    "'‘’‛“”‟–—−' || chr(160) || chr(8199) || chr(8239) || chr(9), repeat(chr(39), 3) || repeat(chr(34), 3) || '---' || repeat(' ', 4)), ' {2,}', ' ', 'g'), "
    r"'(?m)[ \t\v\f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') AS t FROM documents)"
)


@_query(f"WITH {_CANON} SELECT doc_id, sha256(trim(t, chr(10)) || chr(10)) AS key FROM rtrim_lines")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's key, the hash of its canonical text (SC-1, SC-2)."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.document_id(F.col("text")).alias("key"))


@_query(f"WITH {_CANON} SELECT sha256(trim(t, chr(10)) || chr(10)) AS key, min(doc_id) AS doc_id, count(*) AS n FROM rtrim_lines GROUP BY 1")
def dedupe_identical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one canonical text are one document."""
    keys = table(spark, sf_dir, "documents").select("doc_id", tx.document_id(F.col("text")).alias("key"))
    return keys.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@_query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x{0085}\x{00a0}\v]+', ' ', 'g')) AS text FROM documents")
def normalise_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of white space as one space (SC-12)."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalise_space(F.col("text")).alias("text"))


@_query(r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'),
    '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title FROM pages""")  # fmt: skip
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of every page (SC-13, SC-11)."""
    return table(spark, sf_dir, "pages").select("page_id", tx.html_title(F.col("html")).alias("title"))


@_query(r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)) AS link FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page, each once (SRC-11)."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(tx.html_links(F.col("html"))).alias("link"))


@_query(r"""SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
    split_part(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/', 2) AS country FROM pages""")  # fmt: skip
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and country of every page's address (SC-20)."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", *[tx.url_part(url, p).alias(p) for p in ("host", "path", "country")])


# --- provenance and claims -----------------------------------------------------------------------------------------


@_query(with_views("w", """SELECT doc_id, count(DISTINCT witness) AS witnesses, CASE WHEN count(DISTINCT witness) >= 2 THEN 'corroborated' WHEN count(DISTINCT witness) >= 1 THEN 'single' ELSE 'manual' END AS provenance_class
    FROM w GROUP BY 1"""))  # fmt: skip
def provenance_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by witness names alone (AGG-9)."""
    return corpus.witness_classes(views.witness_records(spark, sf_dir))


@_query(with_views("w", """, f AS (SELECT doc_id, witness, raw_hash, row_number() OVER (PARTITION BY doc_id, witness ORDER BY fetched_at, raw_hash) AS r FROM w), s AS (SELECT doc_id, raw_hash, count(*) AS n FROM f WHERE r = 1 GROUP BY 1, 2),
    b AS (SELECT doc_id, raw_hash, n, sum(n) OVER (PARTITION BY doc_id) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, raw_hash) AS r FROM s)
    SELECT doc_id, raw_hash, n AS agreeing, (t - n)::BIGINT AS conflicting, CASE WHEN n >= 2 THEN 'corroborated' ELSE 'single' END AS provenance_class FROM b WHERE r = 1"""))  # fmt: skip
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-attested hash of each document (AGG-10)."""
    return corpus.corroborate(views.witness_records(spark, sf_dir))


@_query(with_views("a", "SELECT min(id) AS id, signer, signature FROM a GROUP BY signer, signature"))
def attestation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signed claim once (SNK-7, AGG-19)."""
    return attest.distinct_claims(views.attestations(spark, sf_dir)).select("id", "signer", "signature")


_ORDER = "['followed', 'applied', 'distinguished', 'criticised', 'overruled']"


@_query(with_views("a", f"""SELECT to_doc, from_doc, array_to_string(list_filter({_ORDER}, lambda t: list_contains(list(DISTINCT treatment), t)), ',') AS treatments, count(*) AS claims
    FROM a GROUP BY 1, 2 HAVING count(DISTINCT treatment) > 1"""))  # fmt: skip
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose claims disagree (AGG-14, TR-4)."""
    found = attest.conflicts(views.attestations(spark, sf_dir))
    return found.withColumn("treatments", F.array_join("treatments", ","))


def _weighted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = views.attestations(spark, sf_dir)
    signers = claims.select("signer").distinct()
    number = F.substring("signer", 2, 9).cast("int")
    policy = signers.filter(number % 3 == 0).select(number.alias("ord"), F.lower("signer").alias("key"), ((number % 8) / 4.0).alias("weight"))
    return attest.weighted(claims, policy, unlisted=0.0)


_WEIGHTED = "wa AS (SELECT *, CASE WHEN substr(signer, 2)::INTEGER % 3 = 0 THEN least((substr(signer, 2)::INTEGER % 8) / 4.0::DOUBLE, 1.0) ELSE 0.0 END AS weight FROM a)"


@_query(with_views("a", f", {_WEIGHTED} SELECT id, signer, weight::DOUBLE AS weight FROM wa"))
def trust_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with their reader's weight (JN-19, TR-3)."""
    return _weighted_claims(spark, sf_dir).select("id", "signer", "weight")


@_query(with_views("a", f""", {_WEIGHTED}, q AS (SELECT to_doc, from_doc, count(*) AS n, count(*) FILTER (treatment IN ('overruled', 'criticised')) AS ad, count(*) FILTER (treatment = 'overruled') AS o,
      sum(weight) AS w, sum(CASE WHEN treatment IN ('overruled', 'criticised') THEN weight ELSE 0 END) AS aw FROM wa GROUP BY 1, 2),
    t AS (SELECT to_doc, sum(n)::BIGINT AS claims, sum(ad)::BIGINT AS adverse, sum(o)::BIGINT AS overruled, round(sum(w), 6)::DOUBLE AS weight, round(sum(aw), 6)::DOUBLE AS adverse_weight, bool_or(ad > 0 AND ad < n) AS contested FROM q GROUP BY 1)
    SELECT t.*, (SELECT count(DISTINCT signer) FROM wa WHERE wa.to_doc = t.to_doc) AS signers,
      CASE WHEN adverse = 0 THEN 'no_adverse_attestation' WHEN adverse_weight > 0 THEN 'adverse_weighted' ELSE 'adverse_unweighted' END AS signal FROM t"""))  # fmt: skip
def currency_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The currency of every cited document (AGG-15, TR-5)."""
    return attest.currency(_weighted_claims(spark, sf_dir))


# --- snapshots -----------------------------------------------------------------------------------------------------


@_query("""WITH o AS (SELECT sha256(text) AS hash, doc_id FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT sha256(text) AS hash, doc_id FROM documents WHERE doc_id % 7 <> 0)
    SELECT hash, doc_id, 'added' AS change FROM n WHERE hash NOT IN (SELECT hash FROM o) UNION ALL SELECT hash, doc_id, 'removed' FROM o WHERE hash NOT IN (SELECT hash FROM n)""")  # fmt: skip
def release_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes between two overlapping snapshots of the documents (SET-1, JN-16)."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id")
    return corpus.snapshot_delta(docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 7 <> 0"))


def _tree(source: str, *fields: str) -> str:
    """The SQL of a hash tree over fields, each behind its length in bytes."""
    leaf = " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields)
    return f"""WITH r AS (SELECT sha256({leaf}) AS b FROM {source}), l AS (SELECT b, sha256(b || ':' || count(*)) AS h FROM r GROUP BY 1),
    a AS (SELECT substr(b, 1, 6) AS b, sha256(string_agg(b || h, '' ORDER BY b)) AS h FROM l GROUP BY 1),
    c AS (SELECT substr(b, 1, 3) AS b, sha256(string_agg(b || h, '' ORDER BY b)) AS h FROM a GROUP BY 1)
    SELECT sha256(string_agg(b || h, '' ORDER BY b)) AS root FROM c"""


@_query(_tree("documents", "doc_id", "text"))
def corpus_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of all documents (AGG-20)."""
    return corpus.sorted_root(table(spark, sf_dir, "documents"), "doc_id", "text")


@_query(_tree(f"({with_views('e', 'SELECT * FROM e')})", "src", "dst", "paragraph_count"))
def graph_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the graph (AGG-20, GRA-3)."""
    tasks = tasks_for(spark, table(spark, sf_dir, "lineitem").count())
    return corpus.sorted_root(views.graph_edges(spark, sf_dir), "src", "dst", "paragraph_count", tasks=tasks)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most authoritative nodes of the citation graph: edges, weights, PageRank, order (GRA-1, GRA-2, ORD-2)."""
    nodes = views.graph_nodes(spark, sf_dir)
    scores = graph.pagerank(nodes, graph.weighted_edges(nodes, views.graph_edges(spark, sf_dir)))
    return scores.join(nodes, "id").orderBy(F.desc("score"), "id").limit(100)


# --- crawl rules ---------------------------------------------------------------------------------------------------

#: What a page says of its use, by the language of its markup; pages of others say nothing.
_SIGNALS = {"en": "search=yes, ai-input=no", "fr": "use=reference search=no", "de": "ai-input=yes, use=reference", "es": "odd=1, AI-Input=NO, ai-input=yes"}
_ELIGIBLE = {"en": "search-only", "fr": "forbidden", "de": "rag-permitted", "es": "citation-only"}


@_query(f"""SELECT page_id, CASE l {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ELIGIBLE.items())} ELSE 'rag-permitted' END AS eligibility FROM (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS l FROM pages)""")
def page_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page permits under the content signal that its markup's language stands for (SC-25, FLT-16)."""
    language = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    signal = F.element_at(F.create_map(*[F.lit(x) for pair in _SIGNALS.items() for x in pair]), language)
    return table(spark, sf_dir, "pages").select("page_id", crawl.eligibility(signal).alias("eligibility"))


@_query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, host, path, CASE WHEN path LIKE '%.html' AND starts_with(path, '/') THEN false WHEN starts_with(path, '/en/1') THEN true WHEN starts_with(path, '/en') THEN false ELSE true END AS allowed FROM u""")  # fmt: skip
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under robots rules of their host: the longest fitting pattern decides (SC-24)."""
    url = F.col("url")
    paths = table(spark, sf_dir, "pages").select("page_id", tx.url_part(url, "host").alias("host"), tx.url_part(url, "path").alias("path"))
    rules = paths.select("host").distinct().select("host", F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(a).alias("allow")) for p, a in (("/en", False), ("/en/1", True), ("/*.html$", False))])).alias("r"))
    return crawl.allowed(paths, rules.select("host", "r.pattern", "r.allow"))


# --- releases, upserts, projections --------------------------------------------------------------------------------


@_query("""WITH i AS (SELECT DISTINCT sha256(text) AS hash, octet_length(encode(text)) AS size, min(doc_id) OVER (PARTITION BY text) AS d FROM documents)
    SELECT hash, 'documents/' || hash AS path, size, CASE d % 4 WHEN 1 THEN 'missing' WHEN 2 THEN 'wrong_size' WHEN 3 THEN 'wrong_hash' ELSE 'ok' END AS status FROM i WHERE size > 1""")  # fmt: skip
def release_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed hashes and sizes of a release some of whose files are missing, cut or altered (REL-5)."""
    docs = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("d")).filter(F.octet_length("text") > 1)
    kind = F.col("d") % 4
    altered = F.when(kind == 2, F.concat("text", F.lit("x"))).when(kind == 3, F.concat(F.lit("\u0001"), F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    # The altered first character is one byte as well: texts open with others only where their size differs too.
    blobs = docs.filter(kind != 1).select(F.concat(F.lit("documents/"), F.sha2("text", 256)).alias("path"), F.when((kind == 3) & (F.octet_length(F.substring("text", 1, 1)) == 2), F.concat(F.lit("\u0001"), altered)).otherwise(altered).alias("text"))
    return release.verify_files(release.file_index(docs), blobs)


@_query("""SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of every key (SNK-1, SNK-2, SNK-4)."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return corpus.latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value", "event_id")


@_query(with_views("linked j", """, b AS (SELECT to_doc AS id, count(DISTINCT from_doc) AS n FROM linked WHERE from_doc <> to_doc GROUP BY 1), o AS (SELECT from_doc AS id, count(*) AS n FROM linked GROUP BY 1)
    SELECT j.id, court, region, authority, coalesce(b.n, 0) AS cited_by_count, coalesce(o.n, 0) AS cites_count FROM j LEFT JOIN b USING (id) LEFT JOIN o USING (id)"""))  # fmt: skip
def case_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts (PRJ-3, JN-15)."""
    linked = _linked(spark, sf_dir)
    cited = corpus.cited_by_count(linked).withColumnRenamed("to_doc", "id")
    cites = corpus.cites_count(linked).withColumnRenamed("from_doc", "id")
    rows = views.judgments(spark, sf_dir).select("id", "court", "region", "authority").join(cited, "id", "left").join(cites, "id", "left")
    return rows.select("id", "court", "region", "authority", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cited_by_count", "cites_count")])


@_query(with_views("a e", """, k AS (SELECT src % 97 AS f, dst % 41 AS t FROM e GROUP BY 1, 2) SELECT a.id, CASE WHEN a.from_doc > 90 THEN 'citing_judgment_not_held' WHEN a.to_doc > 38 THEN 'cited_judgment_not_held'
    WHEN k.f IS NOT NULL THEN 'edge' ELSE 'no_edge_in_this_corpus' END AS support FROM a LEFT JOIN k ON k.f = a.from_doc AND k.t = a.to_doc"""))  # fmt: skip
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph holds of every claim's pair (JN-18)."""
    claims = views.attestations(spark, sf_dir)
    edges = views.graph_edges(spark, sf_dir).select((F.col("src") % 97).alias("from_doc"), (F.col("dst") % 41).alias("to_doc")).distinct()
    held = claims.select(F.col("from_doc").alias("id")).filter("id <= 90").union(claims.select("to_doc").filter("to_doc <= 38")).distinct()
    both = attest.mechanical_support(claims.filter("to_doc <= 38 or from_doc > 90"), edges, held)
    gone = claims.filter("to_doc > 38 and from_doc <= 90").withColumn("support", F.lit("cited_judgment_not_held"))
    return both.select("id", "support").union(gone.select("id", "support"))


@_query(with_views("a", """SELECT count(*) AS examined, count(*) FILTER (NOT bad AND NOT dim) AS verified, count(*) FILTER (bad) AS rejected, count(*) FILTER (dim AND NOT bad) AS unreadable
    FROM (SELECT starts_with(sha256(signer || ':' || signature), '0') AS bad, suffix(created_at, ':00') AS dim FROM a)"""))  # fmt: skip
def verification_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claims verify by the digest of signer and signature, fail, or have no readable second (AGG-16)."""
    bad = F.startswith(F.sha2(F.concat("signer", F.lit(":"), "signature"), 256), F.lit("0"))
    status = F.when(bad, "rejected").when(F.endswith("created_at", F.lit(":00")), "unreadable").otherwise("verified")
    return attest.tallies(views.attestations(spark, sf_dir).withColumn("status", status))
