"""Views of one document, policies of a request, sources and registries, and small helpers, on fixtures."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import attest, corpus, listing, rag, retrieval
from lexmill.plans import catalog, views
from lexmill.sources import adapters, registry
from lexmill.streaming import ingest

KEY, OTHER = "ab" * 32, "cd" * 32


def test_policy_of_a_request():
    node = ([(0, OTHER, 0.3)], 0.2)
    assert attest.request_policy(None, node=node) == (node[0], 0.2, "node")
    assert attest.request_policy(None) == ([], 0.0, "none")
    assert attest.request_policy(f"{KEY}:0.5", node=node) == ([(0, KEY, 0.5)], 0.0, "request")  # never merged
    assert attest.request_policy(f"{KEY}:0.5", "0.7", node) == ([(0, KEY, 0.5)], 0.7, "request")
    assert attest.request_policy("", "x", node) == ([], 0.0, "request")
    assert attest.request_policy(None, "0.9", node)[1] == 0.2  # heard with the request's own policy alone


def test_treatment_in_one_call(spark):
    schema = "from_doc string, to_doc string, treatment string, signer string, signature string, created_at string"
    claims = spark.createDataFrame([("a", "z", "overruled", KEY, "1", "2"), ("b", "z", "followed", OTHER, "2", "1"), ("c", "y", "followed", KEY, "3", "1")], schema)
    edges, nodes = spark.createDataFrame([("a", "z")], "from_doc string, to_doc string"), spark.createDataFrame([("a",), ("z",)], "id string")
    rows, summed = attest.treatment_report(claims, "z", attest.request_policy(f"{KEY.upper()}:0.5", 0.1), edges, nodes)
    assert [(r.from_doc, r.weight, r.listed, r.adverse, r.support) for r in rows.collect()] == [("b", 0.1, False, False, "citing_judgment_not_held"), ("a", 0.5, True, True, "edge")]
    one = summed.first()
    assert (one.claims, one.adverse, one.overruled, one.signers, one.signal, one.policy) == (2, 1, 1, 2, "adverse_weighted", "request")
    rows, summed = attest.treatment_report(claims, "x", attest.request_policy(None), edges, nodes)
    assert rows.count() == 0 and summed.first().signal == "none_about_this_judgment" and summed.first().policy == "none"


def test_embedder_of_a_descriptor(spark):
    embed = rag.query_embedder(rag.HASHED, 8)
    got, want = spark.range(1).select(embed(F.lit("a b")).alias("x"), retrieval.hashed_embedding(F.lit("a b"), 8).alias("y")).first()
    assert got == want and rag.query_embedder("unknown", 8) is None
    chunks = spark.createDataFrame([(1, 1, 0, "red house"), (2, 1, 1, "blue river"), (3, 2, 0, "red river")], "chunk_id long, doc_id long, para_index int, text string")
    vectors = chunks.select(F.lit("d1").alias("descriptor_id"), "chunk_id", retrieval.hashed_embedding(F.col("text"), 8).alias("vector"))
    nodes = spark.createDataFrame([(1, "T", "C", None)], "id long, title string, court string, date string")
    courts = spark.createDataFrame([("C", "Court")], "code string, name string")
    described = lambda model: spark.createDataFrame([("d0", model, 8, 1), ("d1", model, 8, 2)], "descriptor_id string, model string, dimension int, built_at int")
    hits, mode = rag.hits_of_latest(described(rag.HASHED), vectors, chunks, "red river", nodes, courts, 3)
    assert mode == "hybrid" and hits.orderBy(F.desc("score")).first().chunk_id == 3 and {r.title for r in hits.filter("doc_id = 1").collect()} == {"T"}
    hits, mode = rag.hits_of_latest(described("far-model"), vectors, chunks, "red river", nodes, courts, 3)
    assert mode == "keyword-only" and [r.chunk_id for r in hits.collect()] == [3]
    far = {"far-model": lambda n: lambda text: retrieval.hashed_embedding(text, n)}
    assert rag.hits_of_latest(described("far-model"), vectors, chunks, "zzz", nodes, courts, 3, remote=far)[1] == "vector-only"


def test_adapters(spark):
    body = "<la-akoma-ntoso><akn-p>" + "word " * 40 + "</akn-p></la-akoma-ntoso>"
    pages = spark.createDataFrame([(1, "https://h.org/akn/za/judgment/zacc/2020/7", body), (2, "https://h.org/about", body), (3, "https://k.org/doc/5", body), (4, None, None)], "id int, url string, html string")
    plain = adapters.SourceAdapter("plain", "za", lambda url: F.coalesce(F.contains(url, F.lit("/doc/")), F.lit(False)), lambda p: p.withColumns({"plan": F.lit("html"), **{c: F.lit(None).cast("string") for c in adapters.FIELDS[1:-1]}, "paragraphs": F.lit(None).cast("array<struct<number:string,text:string,raw:string>>")}))
    known = [adapters.portal_adapter("portal", "ZA"), plain, adapters.portal_adapter("other", "KE")]
    assert [a.source_id for a in adapters.for_region(known, " za ")] == ["portal", "plain"]
    got = {r.id: (r.source_id, r.plan, r.neutral_citation) for r in adapters.ingest(pages, known, "za").collect()}
    assert got == {1: ("portal", "html", "[2020] ZACC 7"), 2: (None, None, None), 3: ("plain", "html", None), 4: (None, None, None)}
    assert {r.source_id for r in adapters.ingest(pages, known, "xx").collect()} == {None}


def test_registries(spark):
    one = {"code": "ZA", "name": "x", "courts": [{"code": "Zacc", "name": "C", "tier": "apex"}], "series": [{"abbr": "SA", "name": "Reports"}, {"abbr": "sa", "no_volume": True}]}
    assert {(r.abbr, r.no_volume) for r in registry.series(spark, {"ZA": one}).filter("abbr = 'sa'").collect()} == {("sa", True)}
    assert registry.profile_of("za", {}, {"ZA": one}) is one and registry.profile_of("", {"ZA": one}) is one and registry.profile_of("KE", {"ZA": one}) is None
    assert registry.profile_of("ZA", {"ZA": {"own": 1}}, {"ZA": one}) == {"own": 1}
    rows = spark.createDataFrame([("za", "ZACC"), ("ZA", "XX"), ("KE", "ZACC"), (None, None)], "region string, court string")
    assert [r.known for r in registry.with_known_courts(rows, registry.courts(spark, {"ZA": one})).orderBy(F.desc("known")).collect()] == [True, False, False, False]
    regions = rows.select(registry.region_of_court(F.col("court"), {"ZA": one}, "GB").alias("r")).collect()
    assert [r.r for r in regions] == ["ZA", "GB", "ZA", "GB"]


def test_keys_columns_and_clamps(spark):
    faults = spark.createDataFrame([(k,) for k in ("a" * 64, "A" * 64, "a" * 62, "abc", "zz", "", None)], "k string").select(tx.document_id_fault(F.col("k")).alias("f")).collect()
    assert [r.f for r in faults] == [None, None, "wrong_length", "not_hex", "not_hex", "missing", "missing"]
    rows = spark.createDataFrame([(1, ["a", "b"], ("x", 2)), (2, None, None)], "id int, names array<string>, pin struct<kind:string,n:int>")
    flat = listing.json_columns(rows)
    assert flat.filter("id = 1").first()[1:] == ('["a","b"]', '{"kind":"x","n":2}') and flat.filter("id = 2").first()[1:] == (None, None)
    assert listing.nested_columns(flat, rows.schema).collect() == rows.collect()
    assert [r.id for r in listing.nodes_by_id(spark.createDataFrame([(3,), (1,), (2,)], "id int")).collect()] == [1, 2, 3]
    assert [corpus.clamp(v, 1, 100, 20) for v in (None, "x", 0, -5, 7, "8", 101)] == [20, 20, 1, 1, 7, 8, 100]
    blocks = spark.createDataFrame([(" one\n two \n\n \n\nthree\r\nfour", "a, b;;c ,")], "t string, l string").select(tx.split_blocks(F.col("t")).alias("b"), tx.split_list(F.col("l")).alias("l")).first()
    assert blocks.b == ["one two", "three four"] and blocks.l == ["a", "b", "c"]
    first = corpus.first_by(spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, v int"), "k", "v")
    assert {tuple(r) for r in first.collect()} == {("a", 1), ("b", 5)}


def test_windowed_counts(spark):
    events = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-01 10:59:59', 'a' UNION ALL SELECT timestamp'2024-01-01 11:00:00', 'a' UNION ALL SELECT timestamp'2024-01-01 10:30:00', 'b'")
    got = {(r.window.start.hour, r.event_type, r.n) for r in ingest.windowed_counts(events).collect()}
    assert len(got) == 3 and sorted(n for _, _, n in got) == [1, 1, 2]


def test_authority_equals_a_plain_rank(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.id: r.authority for r in catalog.queries()["authority_written"](spark, sf).collect()}
    tiers = {0: 1.0, 1: 0.5, 2: 0.1}
    ids = [r.id for r in views.judgments(spark, sf).select("id").collect()]
    linked = corpus.resolved_edges(catalog._linked(spark, sf)).collect()
    edges = [(r.from_doc, r.to_doc, tiers[r.from_doc % 3] * (1 + 0.25 * min(r.paragraph_count - 1, 4))) for r in linked if {r.from_doc, r.to_doc} <= set(ids)]
    out, score = {}, dict.fromkeys(ids, 1 / len(ids))
    for s, _, w in edges:
        out[s] = out.get(s, 0) + w
    for _ in range(50):
        fresh = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * sum(v for i, v in score.items() if i not in out) / len(ids))
        for s, d, w in edges:
            fresh[d] += 0.85 * score[s] * w / out[s]
        score = fresh
    top = max(score.values())
    held = {i: score[i] / top for i in got if i in score}
    assert held and all(got[i] == pytest.approx(v, abs=1e-6) for i, v in held.items())


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Line items are dealt to more tasks as they grow, so that no task's share of the graph or of a report grows with the table."""
    import re

    from lexmill import session
    from lexmill.operators import corpus
    from lexmill.plans import views

    def widest(frame):
        return max(int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", frame._jdf.queryExecution().executedPlan().toString()))

    folder = "/root/testdata/sf0.001"
    before = sorted(views.graph_edges(spark, folder).collect())
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    edges = views.graph_edges(spark, folder)
    assert widest(edges) >= 12 and sorted(edges.collect()) == before
    pairs = set()
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey").collect()
    rows = sorted((r.l_orderkey, r.l_linenumber, r.l_partkey) for r in rows)
    for (order, _, part), (other, _, after) in zip(rows, rows[1:], strict=False):
        if order == other and part != after:
            pairs.add((part, after, order))
    assert sum(r.paragraph_count for r in before) == len(pairs) and {(r.src, r.dst) for r in before} == {p[:2] for p in pairs}
    documents = spark.range(0, 7000, 3)
    report = corpus.corroboration_report(documents, views.witness_records(spark, folder))
    assert widest(report) >= 12 and report.count() == documents.count()


def test_leaves_of_a_root_meet_where_they_are_counted(spark):
    """Hashes are dealt once, to the given tasks; only the nodes above the leaves travel on."""
    from lexmill.operators import corpus

    rows = spark.range(5000).selectExpr("id % 3000 AS a", "cast(id % 7 AS string) AS b")
    dealt = corpus.sorted_root(rows, "a", "b", tasks=40)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 3 and plan.count(", 40)") == 1
    assert dealt.collect() == corpus.sorted_root(rows, "a", "b").collect() and dealt.count() == 1
    assert corpus.sorted_root(rows.limit(0), "a", "b", tasks=40).count() == 0
