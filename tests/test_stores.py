"""Encoded adjacency, extraction by change, line numbers and snippets against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions.citations import Grammar, extract_citations
from lexmill.operators import adjacency, graph, search
from lexmill.operators.extraction import Extraction
from lexmill.session import Scratch
from lexmill.sources.lines import numbered_lines


def test_payloads_round_trip_and_name_their_faults():
    r = np.random.default_rng(1)
    for low, high in ((0, 30), (-50, 50), (-(1 << 63), (1 << 63) - 1)):
        pairs = sorted({(int(a), int(b)) for a, b in zip(r.integers(low, high, 200), r.integers(low, high, 200), strict=True) if a != b})
        src, dst = (np.ascontiguousarray(x) for x in np.array(pairs, dtype=np.int64).T)
        counts = r.integers(1, 1 << 40, len(pairs))
        assert all((a == b).all() for a, b in zip(adjacency.decode(adjacency.encode(src, dst, counts)), (src, dst, counts), strict=True))
    signed = lambda body: body + zlib.crc32(body).to_bytes(4, "little")
    one = lambda *x: signed(bytes(x))
    good = adjacency.encode(np.array([1, 1]), np.array([2, 3]), np.array([4, 5]))
    assert good == one(1, 1, 2, 2, 2, 4, 1, 4, 5)
    cases = {
        good[:-1]: "checksum", b"": "checksum", one(2, 1, 2, 2, 2, 4, 1, 4, 5): "version", one(1, 1, 2, 2, 2, 4, 1, 4): "length", one(1, 1, 2, 2, 1, 4, 1, 4, 5): "degrees",
        one(1, 1, 2, 2, 2, 4, 1, 4, 0): "zero count", one(1, 1, 2, 2, 2, 4, 0, 4, 5): "order", one(1, 2, 2, 2, 0, 1, 1, 4, 4, 4, 5): "order", one(1, 1, 2, 2, 2, 2, 1, 4, 5): "self edge",
        one(1, 1, 2, 2, 2, 4, 129, 0, 4, 5): "number not in shortest form", one(1, 1, 2, 2, 2, 4, 1, 4, 133): "cut number", one(*[255] * 11, 1): "number too long",
    }
    for payload, fault in cases.items():
        with pytest.raises(ValueError, match=fault):
            adjacency.decode(payload)


def test_adjacency_equals_the_table(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    edges = [(0, r.randrange(2000), r.randrange(0, 3)) for _ in range(900)] + [(r.randrange(300), r.randrange(300), 1) for _ in range(900)] + [(5, 5, 1), (None, 1, 1), (-7, 3, 2)]
    frame = spark.createDataFrame(edges, "src long, dst long, paragraph_count long")
    held = adjacency.Adjacency(spark, str(tmp_path / "g")).build(frame, range_edges=300)
    want = sorted((a.src, a.dst, a.paragraph_count) for a in graph.encoded_edges(frame.dropna()).collect())
    assert sorted((a.src, a.dst, a.paragraph_count) for a in held.edges().collect()) == want
    assert held.faults().count() == 0 and held.faults("in").count() == 0 and held.ranges().count() >= 4
    got = held.node(7).collect()
    assert [(x.way, x.other) for x in got] == [("in", a) for a, b, _ in want if b == 7] + [("out", b) for a, b, _ in want if a == 7]
    reach = {(x.id, x.depth) for x in graph.neighbourhood(spark.createDataFrame(want, "src long, dst long, n long"), 7, 2).collect()}
    assert {(x.id, x.depth) for x in held.neighbourhood(7, 2).collect()} == reach
    assert held.neighbourhood(999_999, 2).count() == 0
    assert {(x.id, x.out_degree, x.in_degree) for x in held.degrees().filter("id = 7").collect()} == {(7, sum(a == 7 for a, _, _ in want), sum(b == 7 for _, b, _ in want))}
    rows = held.rows().withColumn("payload", F.when(F.col("first") == -7, F.lit(b"spoilt")).otherwise(F.col("payload")))
    rows.write.partitionBy("part_of").parquet(str(tmp_path / "bad/out"))
    held.ranges().write.parquet(str(tmp_path / "bad/out-ranges"))
    bad = adjacency.Adjacency(spark, str(tmp_path / "bad"))
    assert [(x.first, x.fault) for x in bad.faults().collect()] == [(-7, "checksum")]
    with pytest.raises(Exception, match="checksum"):
        bad.edges().collect()


def test_edges_by_change_equal_full_extraction(spark):
    cite = lambda n: f"as held in [1995] ZACC {n} at para 3"
    texts = {1: [cite(1), cite(1), cite(2)], 2: ["none", cite(3)], 3: [cite(1), cite(2) + " and " + cite(3)]}
    rows = lambda ids: spark.createDataFrame([(i, k, t) for i in ids for k, t in enumerate(texts[i])], "id long, idx int, text string")
    owner = lambda pairs: spark.createDataFrame([(f"neutral:1995:ZACC:{n}", d) for n, d in pairs], "citation_key string, doc_id long")
    key = lambda n: spark.createDataFrame([(f"neutral:1995:ZACC:{n}",)], "citation_key string")
    store = Extraction(spark, Scratch(spark, "x").root)
    full = lambda ids, owners: sorted(tuple(e) for e in graph.reextracted_edges(extract_citations(rows(ids)), owners).collect())
    now = lambda s: sorted(tuple(e) for e in s.edges().collect())
    first = owner([(1, 50), (2, 1), (3, 60)])
    assert store.apply(0, first, rows([1, 2])) == 4 and now(store) == full([1, 2], first)
    assert store.apply(1, first, rows([3])) == 1 and now(store) == full([1, 2, 3], first)  # one text is new, the other is held
    assert store.apply(1, first, rows([3])) == 0 and now(store) == full([1, 2, 3], first)  # the batch runs again
    moved = owner([(1, 40), (2, 1), (3, 60)])
    assert store.apply(2, moved, moved=key(1)) == 0 and now(store) == full([1, 2, 3], moved)
    assert store.apply(3, moved, withdrawn=spark.createDataFrame([(1,)], "id long")) == 0 and now(store) == full([2, 3], moved)
    texts[2] = [cite(2)]
    assert store.apply(4, moved, rows([2])) == 0 and now(store) == full([2, 3], moved)
    narrow = Extraction(spark, store.folder, Grammar(courts=("XYZ",)))
    assert narrow.version != store.version and narrow.found().count() == 0 and narrow.apply(0, moved, rows([2, 3])) == 3 and now(store) == full([2, 3], moved)


def test_line_numbers_of_split_files(spark, tmp_path):
    r = random.Random(4)
    wanted = []
    for name in ("a.txt", "b.txt", "empty.txt"):
        lines = [r.choice(["", "x" * r.randrange(60), f"line {i}"]) for i in range(0 if name[0] == "e" else 700)]
        (tmp_path / name).write_text("".join(x + r.choice(["\n", "\r\n"]) for x in lines), newline="")
        wanted += [(name, i + 1, x) for i, x in enumerate(lines)]
    (tmp_path / "skip.bin").write_text("no\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("997", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = numbered_lines(spark, str(tmp_path), "*.txt")
            assert size == before or got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
            assert sorted((x.file.rsplit("/", 1)[1], x.line, x.value) for x in got.collect()) == sorted(wanted)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def plain_snippet(text, phrases, size=18):
    words = text.split()
    bare = ["".join(c for c in w.lower() if c.isalnum()) for w in words]
    hits = [(i + len(p) - 1, i, n) for n, p in enumerate(phrases) for i in range(len(bare) - len(p) + 1) if bare[i : i + len(p)] == list(p)]
    best = (0, 0, 0)
    for end, _, _ in sorted(hits):
        inside = {}
        for stop, start, n in hits:
            if stop <= end and start > end - size:
                inside[n] = max(start, inside.get(n, -1))
        if len(inside) > best[0]:
            best = (len(inside), min(inside.values()), end)
    room = max(size - (best[2] - best[1] + 1), 0)
    start = max(min(best[1] - min(room // 2, 4), len(words) - size), 0)
    marked = {j for stop, begin, _ in hits for j in range(begin, stop + 1)}
    shown = [f"<mark>{w}</mark>" if i in marked else w for i, w in enumerate(words)][start : start + size]
    return best[0], ("…" if start > 0 else "") + " ".join(shown) + ("…" if len(words) > start + size else "")


def test_snippets_equal_brute_force(spark):
    r = random.Random(9)
    texts = [" ".join(r.choices(["the", "The,", "court", "held", "of", "law"] + [f"w{i}" for i in range(25)], k=r.randrange(1, 90))) for _ in range(150)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for query, phrases in (("the court", [("the",), ("court",)]), ('"of law" held the', [("of", "law"), ("held",), ("the",)]), ("missing", [("missing",)])):
        rows = frame.select("text", search.snippet(F.col("text"), query).alias("s")).collect()
        most = 0
        for x in rows:
            hits, want = plain_snippet(x.text, phrases)
            assert x.s == want, (x.text, x.s, want)
            most = max(most, hits)
        assert most == (0 if query == "missing" else len(phrases))
    assert spark.range(1).select(search.snippet(F.lit("a b"), "").alias("s")).first().s == "a b"
