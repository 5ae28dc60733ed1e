"""Queries against their SQL on the smallest tables, and operators on small fixtures."""

import json
import math
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.functions import citations as cite
from lexmill.functions import crawl, markup, titles
from lexmill.functions import text as tx
from lexmill.operators import attest, block_index, corpus, graph, listing, rag, release, retrieval, search
from lexmill.plans import catalog
from lexmill.session import Scratch
from lexmill.sources import bundles, judgment_xml, readers, registry
from lexmill.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - {"pagerank_weighted"}))
def test_query_equals_its_sql(spark, duck, name):
    mine, theirs = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)


def test_pagerank_of_a_small_graph(spark):
    nodes = spark.createDataFrame([(1, "apex"), (2, "appellate"), (3, "high_court"), (4, None)], "id long, tier string")
    edges = spark.createDataFrame([(2, 1, 1), (3, 1, 3), (3, 2, 1), (3, 9, 1), (4, 4, 1)], "src long, dst long, paragraph_count long")
    weighted = graph.weighted_edges(nodes, edges)
    assert {(r.src, r.dst, round(r.weight, 6)) for r in weighted.collect()} == {(2, 1, 0.8), (3, 1, 0.75), (3, 2, 0.5)}
    got = {r.id: r.score for r in graph.pagerank(nodes, weighted, iterations=8).collect()}
    out = {2: {1: 0.8}, 3: {1: 0.75, 2: 0.5}}
    score = dict.fromkeys((1, 2, 3, 4), 0.25)
    for _ in range(8):
        loose = sum(s for i, s in score.items() if i not in out)
        score = {j: 0.15 / 4 + 0.85 * (loose / 4 + sum(score[i] * e[j] / sum(e.values()) for i, e in out.items() if j in e)) for j in score}
    assert all(abs(got[i] - score[i] / max(score.values())) < 1e-9 for i in score)


def test_pagerank_of_all_line_items(spark):
    items = pd.read_parquet(f"{SF}/lineitem.parquet").sort_values(["l_orderkey", "l_linenumber", "l_partkey"])
    parts = pd.read_parquet(f"{SF}/part.parquet")
    orders = {}
    for order, part in zip(items.l_orderkey, items.l_partkey, strict=True):
        orders.setdefault(order, []).append(part)
    met = {}
    for order, row in orders.items():
        for a, b in zip(row, row[1:], strict=False):
            if a != b:
                met.setdefault((a, b), set()).add(order)
    names = ["apex", "appellate", "specialist_appellate", "high_court", "specialist_high", "tribunal", "lower"]
    tier = dict(zip(names, (1.0, 0.8, 0.65, 0.5, 0.45, 0.2, 0.1), strict=True))
    own = {p: tier[names[z % 7]] for p, z in zip(parts.p_partkey, parts.p_size, strict=True)}
    out = {}
    for (a, b), seen in met.items():
        if a in own and b in own:
            out.setdefault(a, {})[b] = own[a] * (1 + 0.25 * min(len(seen) - 1, 4))
    n = len(own)
    score = dict.fromkeys(own, 1 / n)
    for _ in range(50):
        loose, got = sum(s for i, s in score.items() if i not in out), dict.fromkeys(own, 0.0)
        for a, row in out.items():
            total = sum(row.values())
            for b, w in row.items():
                got[b] += score[a] * w / total
        score = {i: 0.15 / n + 0.85 * (g + loose / n) for i, g in got.items()}
    best = max(score.values())
    whole = {r.id: r.score for r in catalog.queries()["pagerank_weighted"](spark, SF).collect()}
    top = {r.id: r.score for r in catalog.flagship(spark, SF).collect()}
    assert set(whole) == set(score) and len(top) == min(100, n)
    assert all(abs(whole[i] - s / best) < 2e-6 for i, s in score.items())
    assert all(abs(s - score[i] / best) < 1e-9 for i, s in top.items())


CITED = {
    "as held in … [1995] ZACC 3": ["neutral:1995:ZACC:3"],
    "2020 (3) SA 123 (SCA)": ["reported:2020:3:SA:123"],
    "2020 (3) SA 123": ["reported:2020:3:SA:123"],
    "… 1941 AD 43": ["reported:1941::AD:43"],
    "2011 (2) All SA 47 (SCA)": ["reported:2011:2:All SA:47"],
    "Case CCT 306/24 was heard": ["caseno:CCT:306/24"],
    "[2027] ZANEWHC 4": ["neutral:2027:ZANEWHC:4"],
    "[2019] Act 5": [],
    "section 3 (1) of Act 71 of 2008": [],
    "3/4/2019": [],
}


@pytest.mark.parametrize("text", CITED)
def test_citation_keys(text):
    assert [c["citation_key"] for c in cite.Grammar().extract(text)] == CITED[text]


def test_citation_details():
    grammar = cite.Grammar()
    assert grammar.extract("[2027] ZANEWHC 4")[0]["known_court"] is False
    pin = lambda t: grammar.extract(t)[0]["pinpoint"]
    assert (pin("[1995] ZACC 3 at paras 12-15")["start"], pin("[1995] ZACC 3 at paras 12-15")["stop"]) == (12, 15)
    assert pin("[1995] ZACC 3 at para [87]")["start"] == 87
    page = pin("1941 AD 43 at 47B-D")
    assert (page["kind"], page["page"], page["from_letter"], page["to_letter"]) == ("page", 47, "B", "D")
    assert cite.Grammar(series=(), without_volume=(), courts=()).extract("2020 (3) SA 123 (SCA)") == []
    assert grammar.extract("é [1995] ZACC 3")[0]["start"] == 3  # bytes


@pytest.mark.parametrize(("query", "phrases"), [
    ("unfair dismissal", [(("unfair",), False), (("dismissal",), False)]), ("NEAR(a b, 3)", [(("near",), False), (("a",), False), (("b",), False), (("3",), False)]),
    ('"s v makwanyane"', [(("s", "v", "makwanyane"), False)]), ("delict*", [(("delict",), True)]), ("***", []), ("", []), ("((((", []), ('"', []), ("a' OR 1=1 --", [(("a",), False), (("or",), False), (("1",), False), (("1",), False)]),
])
def test_query_sanitiser(query, phrases):
    assert [(p.words, p.prefix) for p in search.sanitise(query)] == phrases


@pytest.mark.parametrize(("text", "number"), [("[12] Text", "12"), ("(12) Text", "12"), ("12. Text", "12"), ("12.3 Text", None), ("R1.5 million", None), ("In 2019. The", None), ("[Editorial note]", None), ("(a) x", None)])
def test_paragraph_numbers(spark, text, number):
    assert spark.range(1).select(tx.leading_number(F.lit(text))).first()[0] == number


def test_canonical_text(spark):
    one = lambda t: spark.range(1).select(tx.canonicalise(F.lit(t))).first()[0]
    assert one("a\r\nb  c\t d \n\n") == "a\nb c d\n"
    assert one("‘x’ “y” – z") == "'x' \"y\" - z\n"
    assert one("") == "\n"
    assert one(one(" a   b\r")) == one(" a   b\r")


def test_depth_and_dates(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (1,), (2,), (5,), (500,)], "n int").select(graph.depth_factor(F.col("n"))).collect()]
    assert got == [1.0, 1.0, 1.25, 2.0, 2.0]
    dates = [r[0] for r in spark.createDataFrame([("given on 3 March 2020",), ("31 Sept 1999",), ("32 May 2000",), ("none",)], "t string").select(tx.iso_date(F.col("t"))).collect()]
    assert dates == ["2020-03-03", "1999-09-31", None, None]


def test_corroboration(spark):
    rows = [("d", "w1", "h2", "1"), ("d", "w2", "h1", "1"), ("d", "w2", "h2", "2"), ("d", "w3", "h1", "1"), ("e", "w1", "h", "1"), ("f", "w1", "b", "1"), ("f", "w2", "a", "1")]
    got = {r.doc_id: (r.raw_hash, r.agreeing, r.conflicting, r.provenance_class) for r in corpus.corroborate(spark.createDataFrame(rows, "doc_id string, witness string, raw_hash string, fetched_at string"), 1).collect()}
    assert got == {"d": ("h1", 2, 1, "corroborated"), "e": ("h", 1, 0, "single"), "f": ("a", 1, 1, "single")}


def test_claims(spark):
    rows = [(1, 5, 9, "followed", "A", "s1"), (2, 5, 9, "overruled", "B", "s2"), (3, 6, 9, "criticised", "B", "s3"), (4, 6, 8, "applied", "C", "s4"), (5, 5, 9, "followed", "A", "s1")]
    claims = attest.distinct_claims(spark.createDataFrame(rows, "id int, from_doc int, to_doc int, treatment string, signer string, signature string"))
    policy = spark.createDataFrame([(1, "a", 0.5), (2, "A", 1.0), (3, "b", float("nan"))], "ord int, key string, weight double")
    claims = attest.weighted(claims, policy, 0.25)
    assert {(r.id, r.weight) for r in claims.collect()} == {(1, 0.5), (2, 0.0), (3, 0.0), (4, 0.25)}
    got = {r.to_doc: (r.claims, r.adverse, r.contested, r.signal) for r in attest.currency(claims).collect()}
    assert got == {9: (3, 2, True, "adverse_unweighted"), 8: (1, 0, False, "no_adverse_attestation")}
    assert [(r.to_doc, r.from_doc, r.treatments) for r in attest.conflicts(claims).collect()] == [(9, 5, ["followed", "overruled"])]


def test_fusion_and_modes(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "chunk_id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "chunk_id string, rank int")
    assert [r.chunk_id for r in retrieval.fuse(a, b, 3).collect()] == ["y", "x", "z"]
    assert (retrieval.mode(0, True), retrieval.mode(3, True), retrieval.mode(3, False)) == ("vector-only", "hybrid", "keyword-only")
    dense = spark.createDataFrame([("the court the law",)], "t string").select(retrieval.hashed_embedding(F.col("t"), 16)).first()[0]
    assert abs(sum(x * x for x in dense) - 1) < 1e-9


def test_root_ignores_order(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id int, t string")
    assert corpus.sorted_root(rows, "id", "t").first() == corpus.sorted_root(rows.repartition(7).orderBy(F.desc("id")), "id", "t").first()
    assert corpus.sorted_root(rows, "id", "t").first() != corpus.sorted_root(rows.filter("id > 0"), "id", "t").first()


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"court":"zacc","title":"A v B","paragraphs":["[1] First","plain",{"text":"third"}]}\n\n{broken\n{"court":"","title":"x","text":"y"}\n{"court":"Q","title":"x","id":"ff","text":"y"}\n')
    (tmp_path / "a.csv").write_text("no record")
    numbered = readers.good_and_bad(readers.read_json_lines(spark, str(tmp_path), numbered=True))[1].collect()
    assert numbered and all(re.search(r"a\.jsonl:[0-9]+$", r.location) for r in numbered)
    good, bad = readers.good_and_bad(readers.read_json_lines(spark, str(tmp_path / "a.jsonl")))
    row = good.collect()
    assert len(row) == 1 and row[0].court == "ZACC" and row[0].region == "ZA"
    assert [(p.idx, p.number, p.text) for p in row[0].paragraphs] == [(0, "1", "First"), (1, None, "plain"), (2, None, "third")]
    assert sorted(r.reason for r in bad.collect()) == ["id does not match the text", "missing court", "not a record"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.txt").write_text("Title: C v D\nNeutral Citation: [2020] ZASCA 5\nJudges: X; Y, Z\nOdd: 1\n\nOne\ntwo\n\n[2] Three\n")
    (tmp_path / "t" / "c.txt").write_text("no header here\n\nbody")
    good, bad = readers.good_and_bad(readers.read_headed_text(spark, str(tmp_path / "t")))
    row = good.collect()
    assert len(row) == 1 and (row[0].court, row[0].judges) == ("ZASCA", ["X", "Y", "Z"])
    assert [(p.number, p.text) for p in row[0].paragraphs] == [(None, "One two"), ("2", "Three")]
    assert [r.reason for r in bad.collect()] == ["malformed header"]


def test_stream_adds_each_document_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1")], "id string, t string").coalesce(1).write.parquet(source)
    run = lambda: ingest.ingest_stream(spark, spark.readStream.schema("id string, t string").parquet(source), out, str(tmp_path / "c")).awaitTermination(60)
    run()
    spark.createDataFrame([("b", "2"), ("c", "3")], "id string, t string").coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert Path(__spark_entry__.HERE).exists()


@pytest.mark.parametrize(("pattern", "path", "fits"), [("/en", "/en/x", True), ("/en$", "/en/x", False), ("/*.html$", "/a/b.html", True), ("/*.html$", "/a/b.htmlx", False), ("/a*c", "/abxcd", True), ("", "/x", True), ("$", "/x", True), ("/a.b", "/axb", False), ("/q*", "/q", True)])
def test_robots_patterns(spark, pattern, path, fits):
    regex = spark.range(1).select(crawl.pattern_fits(F.lit(path), F.lit(pattern)).alias("r")).first()[0]
    assert regex == fits


@pytest.mark.parametrize(("signal", "want"), [("ai-input=no", "citation-only"), ("ai-input=no,search=yes", "search-only"), ("ai-input=no search=no", "forbidden"), ("use=reference", "citation-only"), ("ai-train=no", "rag-permitted"), ("ai-input=yes, use=reference", "rag-permitted"), ("x=1, y", "rag-permitted"), (None, "rag-permitted")])
def test_content_signals(spark, signal, want):
    assert spark.createDataFrame([(signal,)], "s string").select(crawl.eligibility(F.col("s"))).first()[0] == want


def test_release_report(spark):
    steps = lambda *s: spark.createDataFrame(list(enumerate(s)), "number int, status string")
    outcome = lambda *s: release.report(steps(*s)).first().outcome
    assert (outcome("PASS", "FAIL", "SKIP"), outcome("PASS", "SKIP"), outcome("PASS")) == ("failed", "incomplete", "verified")
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,)], "x int")
    assert [(r.x, r.side) for r in release.same_rows(a, b).collect()] == [(1, "stored")]
    chain = spark.createDataFrame([(1, None, "a"), (2, "a", "b"), (3, "x", "c")], "release int, previous string, hash string")
    assert {r.release: r.chained for r in corpus.chain_breaks(chain).collect()} == {1: True, 2: True, 3: False}


def test_judgment_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<akomaNtoso xmlns="http://x"><judgment><meta><identification><FRBRWork><FRBRthis value="/akn/za/judgment/zacc/2026/26/main"/><FRBRuri value="/other"/>'
        '<FRBRdate name="Hearing" date="2026-01-01"/><FRBRdate name="Judgment" date="2026-02-03"/><FRBRalias name="title" value="A v B"/></FRBRWork></identification>'
        '<references><TLCPerson eId="judge-x" showAs="X J"/><TLCPerson eId="party" showAs="P"/></references><proprietary><case number="CCT 1/26"/></proprietary></meta>'
        "<judgmentBody><p><num>[1]</num> One <i>two</i>\n three</p><p> </p><p>Plain</p></judgmentBody></judgment></akomaNtoso>"
    )
    (tmp_path / "b.xml").write_text("<broken")
    rows = {r.location[-5:]: r for r in judgment_xml.read_judgment_xml(spark, str(tmp_path)).collect()}
    a = rows["a.xml"]
    assert (a.court, a.title, a.date, a.judges, a.case_numbers, a.neutral_citation, a.region, a.reason) == ("ZACC", "A v B", "2026-02-03", ["X J"], ["CCT 1/26"], "[2026] ZACC 26", "ZA", None)
    assert [(p.number, p.text) for p in a.paragraphs] == [("1", "One two three"), (None, "Plain")]
    assert rows["b.xml"].reason == "not well-formed"


def test_profiles(spark):
    text = 'code = "xx"\nname = "X"\n[[courts]]\ncode = "XXSC"\nname = "Top"\ntier = "apex"\n[[series]]\nabbr = "XR"\nname = "X Reports"\n[[series]]\nabbr = "OLD"\nname = "Old"\nno_volume = true\n'
    profile = registry.parse_profile(text)
    found = registry.grammar(profile).extract("[2020] XXSC 4; 2001 (2) XR 33; 1950 OLD 7; 2001 (2) SA 3")
    assert [c["citation_key"] for c in found] == ["neutral:2020:XXSC:4", "reported:2001:2:XR:33", "reported:1950::OLD:7"]
    rows = registry.with_court_names(spark.createDataFrame([("xxsc",), ("zz",)], "court string"), registry.courts(spark, {"XX": profile}))
    assert {(r.court, r.court_name) for r in rows.collect()} == {("xxsc", "Top"), ("zz", "zz")}
    for bad in (text.replace("apex", "best"), text.replace('"xx"', '""'), text + '[[courts]]\ncode = "xxsc"\nname = "T"\ntier = "apex"\n'):
        with pytest.raises(ValueError):
            registry.parse_profile(bad)


# --- lookups, titles, crawl rules, bundles, releases ---


def test_roots_tell_fields_and_repeats_apart(spark):
    root = lambda rows: corpus.sorted_root(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()["root"]
    assert root([("x|y", "z")]) != root([("x", "y|z")]) and root([("x1:y", "z")]) != root([("x", "1:yz")])
    assert root([(None, "z")]) != root([("", "z")]) and root([("a", "b")]) != root([("a", "b"), ("a", "b")])
    assert root([("a", "b"), ("c", "d")]) == root([("c", "d"), ("a", "b")])


def test_titles_and_addresses(spark):
    one = lambda expr: spark.range(1).select(expr.alias("x")).first()["x"]
    lit = F.lit
    assert one(titles.og_title(lit('<meta property="og:title" content="A &amp; B"><meta name="twitter:title" content="C">'))) == "A & B"
    assert one(titles.og_title(lit('<META content="C" name="twitter:title">'))) == "C" and one(titles.og_title(lit("<title>x</title>"))) is None
    assert one(titles.h1_title(lit("<h1 class=x>A <b>v</b>\n B</h1><h1>second</h1>"))) == "A v B" and one(titles.h1_title(lit(""))) is None
    assert one(titles.decision_type(lit("A v B [2020] C 1 (5 May 2020)"))) is None and one(titles.decision_type(lit("A ([2020] X)"))) is None
    assert one(titles.parties(lit("No brackets"))) == "No brackets" and one(titles.case_description(lit("A [2020] B 1"))) is None
    assert one(titles.akn_path(lit("ftp://h/akn/ke/judgment/keca/2026/7?q"))) == "/akn/ke/judgment/keca/2026/7" and one(titles.akn_path(lit("x"))) is None
    assert one(titles.neutral_citation(lit("/akn/ke/judgment/keca/x/7"))) is None and one(titles.akn_country(lit("/akn/kenya/judgment"))) is None
    from urllib.parse import urljoin

    bases = ["https://h.org/a/b/c.html?x=1#y", "http://h.org", "https://h.org/"]
    hrefs = ["https://o.org/z", "//o.org/z", "/r/s?t", "d/e", "./d", "../d", "../../../d", "?q=2", "#f", "d/", "..", "a/./b/../c"]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string").select("b", "h", titles.resolve_url(F.col("b"), F.col("h")).alias("u")).collect()
    plain = lambda u: u.rstrip("/").removesuffix("#f") if "#f" in u else u.rstrip("/")
    assert [(r.b, r.h) for r in rows if plain(r.u) != plain(urljoin(r.b, r.h))] == []
    assert one(titles.resolve_url(lit("nowhere"), lit("/x"))) is None


def test_html_helpers(spark):
    one = lambda expr: spark.range(1).select(expr.alias("x")).first()["x"]
    page = "<head><title>t</title></head><script>var a='<p>';</script><p>1. First &amp; <b>bold</b></p><div>[2] second</div><p>  </p>third<style>p{}</style>"
    assert [p.raw for p in one(markup.numbered_paragraphs(F.lit(page)))] == ["1. First & bold", "[2] second", "third"]
    assert one(tx.strip_tags_lossy(F.lit("a<b>c</b> > d <unclosed"))) == "ac  d "
    key = one(tx.document_id(F.lit("some text")))
    assert one(tx.short_id(F.lit(key))) == key[:12] and one(tx.is_document_id(F.lit(key.upper()))) and not one(tx.is_document_id(F.lit(key[:-1]))) and not one(tx.is_document_id(F.lit(None).cast("string")))
    assert one(tx.fold(F.lit("Ünïcödé Ǖ ή ß ø é"))) == "unicode u η ß ø e"
    cut = one(search.snippet(F.lit("one two three four five six seven The eight " + "more " * 30), "the"))
    assert cut.startswith("…") and cut.endswith("…") and cut.count("<mark>") == 1 and len(cut.split()) <= 18


def test_search_over_columns(spark):
    rows = [(1, "Smith v Jones", "A long text about the café", "[2001] ZACC 1"), (2, "Other", "smith jones", "ZACC"), (3, None, "the cafe smith", None)]
    docs = spark.createDataFrame(rows, "id long, title string, text string, citation string")
    ids = lambda q: {r.id for r in search.matches(docs, q, ("title", "text", "citation")).collect()}
    assert ids("smith cafe") == {1, 3} and ids('"v jones"') == {1} and ids("jones a") == {1} and ids('"jones a"') == set() and ids("CAFÉ") == {1, 3} and ids("zac*") == {1, 2}
    index = block_index.BlockIndex(spark, Scratch(spark, "t").root).build(docs, ("title", "text", "citation"), authority=None)
    for q in ("smith cafe", '"v jones"', "zac*", '"jones a"', "smith smith"):
        want = {(r.id, round(r.bm25, 6)) for r in search.bm25(docs, q, ("title", "text", "citation")).collect()}
        assert {(r.id, round(r.bm25, 6)) for r in index.scores(q).collect()} == want


def test_robots_files(spark):
    body = "User-agent: a\nUser-agent: b/2 x\nDisallow: /x\r\nCrawl-delay: -1\nUser-agent: *\nDisallow:\nAllow: /y#z\n"
    groups = crawl.robots_groups(spark.createDataFrame([("h", body), ("empty", ""), ("none", None)], "host string, body string"))
    assert {(r.agent, r.pattern, r.allow) for r in groups.collect()} == {("a", "/x", False), ("b", "/x", False), ("*", "/y", True)}
    pick = lambda agent: {(r.pattern, r.allow) for r in crawl.rules_for(groups, agent).collect()}
    assert pick("B/9") == {("/x", False)} and pick("zz") == {("/y", True)}


def test_policies_and_claims(spark, tmp_path):
    key = "AB" * 32
    assert attest.parse_policy(f"{key}:0.5, {key}:x,short:1,{'c' * 64}, {'d' * 64}:7,{'e' * 64}:nan", 2) == ([(0, key.lower(), 0.5), (1, key.lower(), 1.0), (2, "c" * 64, 1.0), (3, "d" * 64, 1.0), (4, "e" * 64, 0.0)], 1.0)
    assert attest.parse_policy("") == ([], 0.0)
    claim = {"from_doc": "1" * 64, "to_doc": "2" * 64, "treatment": "Criticized", "signer": key, "signature": "f" * 128, "created_at": "2024"}
    lines = [json.dumps(claim), "", "{broken", json.dumps(claim | {"treatment": "liked"}), json.dumps(claim), json.dumps(claim | {"signer": "zz"}), json.dumps(claim | {"to_doc": "2"}), json.dumps({k: v for k, v in claim.items() if k != "signer"})]
    (tmp_path / "b.jsonl").write_text("\n".join(lines))
    got = bundles.read_bundle(spark, str(tmp_path / "b.jsonl"))
    assert {(r.line, r.status, r.reason) for r in got.collect()} == {(1, "new", None), (3, "malformed", "no from_doc"), (4, "rejected", "treatment"), (5, "duplicate", None), (6, "rejected", "signer not_hex"), (7, "rejected", "id"), (8, "malformed", "no signer")}
    assert bundles.bundle_tallies(got).first().asDict() == {"malformed": 2, "rejected": 3, "duplicate": 1, "new": 1}
    refused = bundles.parse_lines(spark.createDataFrame([("p", 1, lines[0])], "path string, line int, value string"), F.col("signer") == "x")
    assert refused.first().reason == "signature"
    raw = spark.range(1).select(attest.signing_bytes("d", F.lit("é"), F.lit(None)).alias("x")).first()["x"]
    assert bytes(raw) == b"d\n" + (2).to_bytes(8, "big") + "é".encode() + (0).to_bytes(8, "big")
    about = spark.createDataFrame([("a", "z", "followed", key, "s", "2024"), ("b", "y", "followed", key, "s", "2023")], "from_doc string, to_doc string, treatment string, signer string, signature string, created_at string")
    policy = spark.createDataFrame([(0, key.lower(), 0.5)], "ord int, key string, weight double")
    assert [(r.from_doc, r.weight) for r in attest.treatment_view(about, "z", policy).collect()] == [("a", 0.5)]
    assert [r.x for r in spark.createDataFrame([(" Applied ",), ("criticized",), ("odd",)], "t string").select(attest.treatment(F.col("t")).alias("x")).collect()] == ["applied", "criticised", None]
    assert attest.currency_of(spark.createDataFrame([("q",)], "to_doc string"), attest.currency(attest.weighted(about, policy)), True).first().signal == "none_about_this_judgment"


def test_upserts_indexes_and_files(spark):
    stored = spark.createDataFrame([(1, "a", 0.5, 1), (2, "b", 0.7, 1)], "id long, court string, authority double, ts int")
    new = spark.createDataFrame([(2, "c", 0.0, 2), (2, "d", 0.0, 3), (3, "e", 0.1, 1)], "id long, court string, authority double, ts int")
    assert {(r.id, r.court, r.authority) for r in listing.upsert(stored, new, ["ts"]).collect()} == {(1, "a", 0.5), (2, "d", 0.7), (3, "e", None)}
    chunks = spark.createDataFrame([(1, 0, "a b"), (2, 0, "c")], "doc_id long, para_index int, text string")
    built = rag.build_index(chunks, "x", 4, lambda t: retrieval.hashed_embedding(t, 4))
    assert built.count() == 2 and rag.replace_index(built, built.limit(1)).count() == 1
    with pytest.raises(Exception, match="not 5 numbers"):
        rag.build_index(chunks, "x", 5, lambda t: retrieval.hashed_embedding(t, 4)).collect()
    blob = spark.createDataFrame([(0, 1, 2), (1, 1, 3), (2, 1, 3), (3, 0, 9)], "ord int, src int, dst int")
    assert {r.ord for r in graph.unsorted_edges(blob).collect()} == {2, 3}
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 1)], "from_doc string, to_doc string, paragraph_count long")
    assert [r.id for r in release.open_references(edges, spark.createDataFrame([("a",), ("b",)], "id string")).collect()] == ["c"]
    children = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, v string")
    assert [r.v for r in corpus.drop_children(children, spark.createDataFrame([(1,)], "doc_id long")).collect()] == ["y"]
    assert [r.path for r in spark.createDataFrame([("ab" * 32,)], "k string").select(release.blob_path(F.col("k")).alias("path")).collect()] == ["objects/ab/" + "ab" * 31]
    hosts = registry.sources_of_hosts(spark.createDataFrame([("A.x.org",), ("org",), ("y.com",), ("",)], "host string"), spark.createDataFrame([(1, "s", "x.org")], "ord int, source_id string, source_host string"))
    assert {(r.host, r.source_id) for r in hosts.collect()} == {("A.x.org", "s"), ("org", "s"), ("y.com", None), ("", None)}


def test_authority_from_ranks(spark):
    rows = catalog.queries()["authority_written"](spark, SF).collect()
    assert len(rows) == 200 and max(r.authority for r in rows) == 1.0 and all(0 < r.authority <= 1 for r in rows)


def test_a_release_is_published_and_read(spark, tmp_path):
    grammar = cite.Grammar()
    assert grammar.fingerprint() == cite.Grammar().fingerprint() != cite.Grammar(courts=("X",)).fingerprint()
    texts = ["First, as held in [1995] ZACC 3.\n\nSee [1996] ZACC 4 and [1995] ZACC 3 again.\n", "Second.\n", "Third cites [1995] ZACC 3 and itself, [1997] ZACC 5.\n"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("id", tx.document_id(F.col("text")))
    ids = {r.text[:5]: r.id for r in docs.collect()}
    owners = spark.createDataFrame([("neutral:1995:ZACC:3", ids["Secon"]), ("neutral:1997:ZACC:5", ids["Third"])], "citation_key string, doc_id string")
    folder = str(tmp_path / "r1")
    steps = {r.name: r.status for r in release.publish(docs, grammar, owners, folder, 1).collect()}
    assert set(steps) == set(release.STEPS) and steps.pop("chain") == "SKIP" and set(steps.values()) == {"PASS"}
    held = release.read_release(spark, folder)
    assert {(r.from_doc, r.to_doc, r.paragraph_count) for r in held["graph"].collect()} == {(ids["First"], ids["Secon"], 2), (ids["Third"], ids["Secon"], 1)}
    assert held["manifest"].first().doc_count == 3 and held["index"].count() == 3
    with pytest.raises(ValueError, match="not that of its text"):
        release.publish(docs.withColumn("text", F.concat("text", F.lit("x"))), grammar, owners, folder, 2)
