"""What a query does for each row: no work is repeated for each number of a vector, no word is shuffled, no edge is sorted."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_vector_is_measured_once(spark):
    from lexmill.operators import retrieval

    vectors = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<float>")
    units = vectors.select(retrieval.unit(F.col("v")).alias("u"))
    assert [r.u for r in units.collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
    assert len(re.findall(r"sqrt", _plan(units), re.IGNORECASE)) == 1
    texts = ["the court the law", "", " - ", "Größe æon 42", "x " * 3000, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", retrieval.hashed_embedding(F.col("t"), 16).alias("v"))
    assert len(re.findall(r"filter\(", _plan(rows))) == 0  # no pass over the words for each number
    for i, found in rows.collect():
        if texts[i] is None:
            assert found == [None] * 16
            continue
        want = [0.0] * 16
        for w in re.findall(r"[^\W_]+", texts[i].lower()):
            h = hashlib.sha256(w.encode()).hexdigest()
            want[int(h[:7], 16) % 16] += 1 if int(h[7], 16) % 2 == 0 else -1
        norm = math.sqrt(sum(x * x for x in want)) or 1
        assert found == pytest.approx([x / norm for x in want], abs=1e-12)


def test_words_are_counted_where_they_are_read(spark):
    from lexmill.operators import search

    texts = [(1, "b a b"), (2, ""), (3, None), (4, "Ça a"), (5, "a a"), (5, "a b"), (5, "b"), (None, "x"), (None, "x")]

    def want(rows):
        out = {}
        for i, t in rows:
            words = re.findall(r"\w+", (t or "").lower().replace("ç", "c"))
            for p, w in enumerate(words):
                out.setdefault((i, w, len(words)), []).append(p)
        return {k: (sorted(v), len(v)) for k, v in out.items()}

    for rows in (texts[:5], texts):
        found = search.postings(spark.createDataFrame(rows, "id long, text string"))
        assert found.columns == ["id", "term", "doc_length", "positions", "tf"]
        got = found.collect()
        assert len({r[:3] for r in got}) == len(got) and {tuple(r[:3]): (r.positions, r.tf) for r in got} == want(rows)
    once = search.postings(spark.createDataFrame(texts[:5], "id long, text string"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()


def test_pagerank_computes_its_edges_once_and_sorts_none(spark, monkeypatch):
    from lexmill.operators import graph
    from lexmill.session import Scratch

    plans, write, bucketed = [], Scratch.write, Scratch.bucketed

    def seen(fn):
        def run(self, df, tag, *args):
            plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
            return fn(self, df, tag, *args)

        return run

    monkeypatch.setattr(Scratch, "write", seen(write))
    monkeypatch.setattr(Scratch, "bucketed", seen(bucketed))
    pairs = [(a, b, 1.0 + (a * b) % 3) for a in range(9) for b in range(12) if a != b and (a + b) % 4 < 2]  # 9 to 11 cite nothing
    made = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame(pairs, "src long, dst long, weight double").mapInArrow(noted, "src long, dst long, weight double")
    got = {r.id: r.score for r in graph.pagerank(spark.range(12), edges, iterations=3).collect()}
    out, score = {}, dict.fromkeys(range(12), 1 / 12)
    for s, _, w in pairs:
        out[s] = out.get(s, 0) + w
    for _ in range(3):
        fresh = dict.fromkeys(score, 0.15 / 12 + 0.85 * sum(v for i, v in score.items() if i not in out) / 12)
        for s, d, w in pairs:
            fresh[d] += 0.85 * score[s] * w / out[s]
        score = fresh
    top = max(score.values())
    assert got == pytest.approx({i: v / top for i, v in score.items()}, abs=1e-12)
    assert made.value == len(pairs)
    rounds = [plan for tag, plan in plans if tag in ("scores1", "scores2", "scores3")]
    assert len(rounds) == 3 and not any("SortMergeJoin" in plan for plan in rounds)


def test_a_page_by_authority_inverts_no_text(spark, tmp_path, monkeypatch):
    from lexmill.operators.block_index import BlockIndex
    from lexmill.plans import catalog, views

    ids = [(i,) for i in (*range(-40, 400), *range(1000, 1200, 7))]
    rows = spark.createDataFrame(ids, "doc_id long").selectExpr("doc_id", "'a text' AS text", "'en' AS lang", "'web' AS source")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(views, "_INDEXES", {})
    monkeypatch.setattr(BlockIndex, "build", lambda *_: pytest.fail("the index is built"))
    want = sorted(((r.authority, r.id) for r in views.judgments(spark, str(tmp_path)).collect()), key=lambda x: (-x[0], x[1]))
    got = catalog.browse_deep_page(spark, str(tmp_path))
    assert [(r.authority, r.id, r.place) for r in got.collect()] == [(*x, 120 + i) for i, x in enumerate(want[120:145])]
    held = views.corpus_order(spark, str(tmp_path))
    assert held._rows().columns == ["id", "authority", "place", "part_of"] and held is views.corpus_order(spark, str(tmp_path))


def test_degrees_meet_in_tasks_that_follow_the_ranges(spark):
    from lexmill.operators.adjacency import Adjacency
    from lexmill.session import Scratch

    pairs = {(a, b) for a in range(-3, 300) for b in range(0, 300, 1 + a % 60) if a != b} | {(1, b) for b in range(1000, 7000)}
    frame = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, paragraph_count long").repartition(3)
    graph = Adjacency(spark, Scratch(spark, "td").root).build(frame, range_edges=500)
    ranges = max(graph.ranges(way).count() for way in ("out", "in"))
    found = graph.degrees()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ranges > 10 and re.findall(r"hashpartitioning\(id#?\w*, (\d+)\)", plan) == [str(ranges)]
    nodes = {x for p in pairs for x in p}
    out, into = ({x: 0 for x in nodes} for _ in range(2))
    for a, b in pairs:
        out[a], into[b] = out[a] + 1, into[b] + 1
    rows = found.collect()
    assert len(rows) == len(nodes) and {r.id: (r.out_degree, r.in_degree) for r in rows} == {x: (out[x], into[x]) for x in nodes}
    assert found.columns == ["id", "out_degree", "in_degree"]
    assert graph.build(frame.limit(0)).degrees().count() == 0


def test_a_page_of_hits_links_each_citing_pair_once(spark, tmp_path, monkeypatch):
    from lexmill.operators import corpus
    from lexmill.plans import lookups

    places = [(500 * (i % 3) + i % 40, 700 * (i % 2) + i % 15, 1 + i % 7) for i in range(4000)]
    spark.createDataFrame(places, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, 1) for i in range(800)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    link, count, seen = corpus.link, corpus.cited_by_count, []
    monkeypatch.setattr(lookups.corpus, "link", lambda cites, owners: seen.append(cites) or link(cites, owners))
    monkeypatch.setattr(lookups.corpus, "cited_by_count", lambda rows: seen.append(count(rows)) or seen[-1])
    monkeypatch.setattr(lookups.views, "corpus_index", lambda *_: None)
    monkeypatch.setattr(lookups, "hits_page", lambda *_: spark.range(0).selectExpr(*(f"id AS {c}" for c in ("total", "id", "title", "court", "date", "region", "authority", "bm25", "cited_by_count"))))
    monkeypatch.setattr(lookups.views, "judgments", lambda *_: None)
    lookups.search_page(spark, str(tmp_path))
    pairs = {(o % 500, p % 700) for o, p, _ in places}
    assert len(seen) == 2 and seen[0].count() == len(pairs) < len(places) / 2
    owner = {p % 700: min(q % 500 for q in range(800) if q % 7 and q % 700 == p % 700) for p in range(800) if p % 7}
    want = {}
    for doc, key in pairs:
        if key in owner and owner[key] != doc:
            want.setdefault(owner[key], set()).add(doc)
    assert {r.to_doc: r.cited_by_count for r in seen[1].collect()} == {k: len(v) for k, v in want.items()}
