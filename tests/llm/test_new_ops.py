"""Fill-in-the-middle, vantage-point trees and importance resampling against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import decontaminate, fill_middle, jaccard_join, language_id, packing, quality, resample, suffix_dedup, topk, vp_trees

SF = "/root/testdata/sf0.001"


# --- fill in the middle ---

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
ODD = ["", None, " ", "\t\n ", "a", " a", "a ", "é ü x y  zz\n", "x" * 5000, "a <P> b", "<S>", "<<S>> <M", "😀 " * 400 + "end", "one two three four five " * 3000, "\x00 \x1f a\x0b\x0cb"]


def expected(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    assert "".join(units) == text
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_skip_list_reaches_every_rank():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 8, 9, 700):
        widths = r.integers(0, 9, n)
        units = fill_middle.SkipList(widths)
        assert [units.seek(i) for i in range(n + 1)] == np.append(0, np.cumsum(widths)).tolist()
        assert n < 100 or len(units.lanes) > 2
    with pytest.raises(IndexError):
        units.seek(701)


def test_fill_in_middle_equals_plain_version(spark):
    rows = [(i, t, "kept", i % 3) for i, t in enumerate(ODD * 12)] + [(None, "a b c d", "x", 1), (7, "again again", "x", 2), (7, "again again", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, draws int").repartition(3)
    made = fill_middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "draws", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.text, r.draws, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, t or "", d, *expected(i, t)) for i, t, _, d in rows), key=key)
    assert all(r.back == r.text for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    all_of = fill_middle.fill_in_middle(docs, rate=100, spm_rate=0, seed=7).collect()
    assert {(r.doc_id, r.form, r.output) for r in all_of} == {(i, e[1], e[4]) for i, t, *_ in rows for e in [expected(i, t, 7, 100, 0)]}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


# --- vantage-point trees ---


def brute(vectors, queries, k):
    out = []
    for qid, q in queries:
        found = sorted((float(np.sqrt(np.square(np.array(q) - np.array(v)).sum())), i) for i, v in vectors if i != qid and len(v) == len(q))
        out += [(qid, rank + 1, i, d) for rank, (d, i) in enumerate(found[:k])]
    return sorted(out)


def good(rows):
    return [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]


def near(got, want):
    got, want = sorted(got), sorted(want)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12, atol=0)


def cloud(n, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + 0.3 * r.normal(size=6)).tolist()) for i in range(n)]
    return rows + [(n + i, [1.0] * 6) for i in range(n // 2)]  # a third of all rows is one vector


def test_factor_one_is_exact(spark):
    rows = cloud(900) + [(5000, [1.0, 2.0]), (5100, [1.0, 2.5]), (5200, [3.0]), (5101, None), (None, [1.0] * 6), (5102, [0.0] * 6), (5103, [float("nan")] * 6), (5104, [None] * 6), (5105, []), (5106, [float("inf")] * 6), (5300, [1e308] * 6)]
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "id long, vector array<double>, shard int, within double").repartition(4)
    got = vp_trees.neighbours(frame, frame.filter("id % 100 = 0"), 10, factor=1.0, shard_rows=100)
    with np.errstate(over="ignore"):
        want = brute(good(rows), [x for x in good(rows) if x[0] % 100 == 0], 10)
    near([tuple(r) for r in got.collect()], want)


def test_repeated_queries_and_few_candidates(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (100, [0.0, 2.0])]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    got = sorted(tuple(r) for r in vp_trees.neighbours(frame, frame.filter("id = 100"), 3, 1.0).collect())
    near(got, sorted(2 * [(100, 1, 1, 0.5), (100, 2, 2, 0.5)] + [(100, 1, 1, math.sqrt(3.25)), (100, 2, 2, math.sqrt(3.25))]))
    assert vp_trees.neighbours(frame.limit(0), frame, 3).count() == 0 and vp_trees.neighbours(frame, frame.limit(0), 3).count() == 0


def test_pruning_is_sound_and_relaxes():
    rows = cloud(3000)
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    tree = vp_trees.VpTree.unpacked(6, vp_trees.VpTree(ids, vectors).packed())
    queries, own = vectors[:200], ids[:200]
    far = [(vp_trees.distances(vectors, q), ids) for q in queries]
    want = [{int(i) for d, i in sorted((d, i) for d, i in zip(*x, strict=True) if i != own_id)[:10]} for x, own_id in zip(far, own, strict=True)]
    read = []
    for factor, least in ((1.0, 1.0), (1.5, 0.98), (2.0, 0.94), (8.0, 0.5)):
        _, found, compared = tree.search(own, queries, 10, factor)
        assert np.mean([len(set(row.tolist()) & w) / 10 for row, w in zip(found, want, strict=True)]) >= least
        read.append(compared.mean() / len(ids))
    assert read[0] < 0.3 and read == sorted(read, reverse=True)


def test_query_reaches_its_recall(spark):
    found = {(r.query_id, r.vec_id, r.score) for r in vp_trees.op12_vp_neighbours(spark, SF).collect()}
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, [x for x in rows if x[0] % 100 == 0], 10)
    assert len(found) == len(want) and len({x[:2] for x in found} & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)
    exact = {(i, v[0]): np.array(v) for i, v in rows}
    by_id = {i: v for (i, _), v in exact.items()}
    assert all(math.isclose(s, float(np.sqrt(np.square(by_id[q] - by_id[v]).sum())), rel_tol=1e-12) for q, v, s in found)


# --- importance resampling ---


def features(text, n):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + m]) for m in range(1, n + 1) for i in range(len(words) - m + 1)]


def resampled(rows, target, n=1, percent=10, buckets=10_000, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, n)[1]) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, text in rows:
        count, own = features(text, n)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, count])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], -1 if x[0] is None else x[0], x[1]))
    for rank, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = rank + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def test_hash_and_table():
    r = random.Random(1)
    spans = [bytes(r.randrange(256) for _ in range(r.randrange(45))) for _ in range(2000)] * 2
    data = np.frombuffer(b"".join(spans), dtype=np.uint8)
    sizes = np.array(list(map(len, spans)))
    starts = np.cumsum(sizes) - sizes
    assert resample.span_hashes(data, starts, sizes).tolist() == [xxhash.xxh64_intdigest(x) for x in spans]
    for hashes in (None, np.zeros(len(spans), dtype=np.uint64), np.array([zlib.crc32(x) % 7 for x in spans], dtype=np.uint64)):  # all collide, seven hashes
        found = resample.Interned(data, starts, sizes, 97, hashes)
        assert [int(found.counts[s]) for s in found.slots] == [Counter(spans)[x] for x in spans]
        assert found.buckets[found.slots].tolist() == [zlib.crc32(x) % 97 for x in spans] and len(found.taken) == len(set(spans))


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_plain_version(spark, n):
    r = random.Random(4)
    vocabulary = [a + b for a in "bcdfglmnprst" for b in ("a", "eo", "ini", "ur", "É")]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    rows = [(i, prose(r.randrange(0, 60))) for i in range(400)] + [(None, prose(30)), (None, None), (500, ""), (501, "  \n"), (502, "A-b'C 99 _x ÀÉ\x00z"), (503, prose(20000)), (504, "é" * 3000), (7, prose(40))] + 2 * [(505, "same words " * 20)]
    target = [prose(8) + " cini cini", None, ""]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, score int, place string").repartition(3)
    found = resample.importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n=n)
    assert found.columns == ["doc_id", "place", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(((x.doc_id, x.n_features, x.weight, x.score, x.rank) for x in found.collect()), key=str) == resampled(rows, target, n)
    assert resample.importance_resample(docs.limit(0), docs).count() == 0


def test_long_texts_are_taken_apart(monkeypatch):
    monkeypatch.setattr(resample, "PIECE_BYTES", 40)
    r = random.Random(8)
    for _ in range(200):
        text = "".join(r.choice("ab é-\n") for _ in range(r.randrange(400)))
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        for n in (1, 2, 4):
            found, carried, words, total = Counter(), b"", 0, 0
            for part, cuts, goes_on in resample._pieces(data, np.array([0, len(data)])):
                norm, starts, sizes, _, counts, carried, words = resample._grams(part, cuts, n, *((carried, words) if goes_on else ()))
                found.update(norm[a : a + k].tobytes().decode() for a, k in zip(starts, sizes, strict=True))
                total += int(counts.sum())
            assert (total, found) == (features(text, n)[0], Counter(features(text, n)[1]))


# --- names that clash, repeated queries, other levels of evidence ---

HOSTILE = ["__k1", "__k2", "k1", "k2", "__single", "single", "__found", "found", "__leak", "leak", "__bucket", "bucket", "own", "before", "place", "__host", "__declared", "__suffix", "__parent", "__text", "__letters",
           "spans", "root", "component_id", "id", "c0", "c1", "hash", "item", "shingle", "draws", "row", "part", "h", "v", "dims", "query", "token", "gid"]


@pytest.fixture(scope="module")
def hostile(spark):
    r = random.Random(12)
    rows = [(i, " ".join(r.choice(["the", "of", "and", "court", "house", "river", "über", "niño"]) for _ in range(30)), "en", "a.example.org") for i in range(12)]
    rows += [(20, rows[0][1], "en", "b"), (21, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(f"mine {c}") for c in HOSTILE})


def test_columns_keep_their_names_and_values(spark, hostile):
    items = spark.createDataFrame([(1, hostile.first()["text"])], "item_id long, text string").withColumns({c: F.lit("theirs") for c in ("id", "hash", "n", "leak")})
    mine = [f"mine {c}" for c in HOSTILE]

    def held(frame, n, gone=()):
        rows = frame.collect()
        assert len(rows) == n and all([r[c] for c in HOSTILE if c not in gone] == [m for m, c in zip(mine, HOSTILE, strict=True) if c not in gone] for r in rows)
        return rows

    assert {r.language for r in held(language_id.identify(hostile), 14)} <= {None, *language_id.LANGUAGES}
    held(jaccard_join.keep_one(hostile), 13)
    held(suffix_dedup.remove_repeats(hostile), 14)
    held(suffix_dedup.long_repeats(hostile), 14, ("spans",))
    assert {r.doc_id for r in held(decontaminate.drop_leaks(hostile, items), 12)} == {*range(1, 12), 21}
    held(fill_middle.fill_in_middle(hostile), 14)
    held(resample.importance_resample(hostile, items), 14)
    pieces = packing.token_pieces(hostile, packing.tokenizer_path()).withColumns({c: F.lit(f"mine {c}") for c in HOSTILE})
    held(packing.pack(pieces), 14)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, hostile, SF)
        assert kept.columns == hostile.columns, name
        held(kept, kept.count())
    vectors = spark.createDataFrame([(i, [i, 1], 1) for i in range(5)], "id long, vector array<long>, own int").withColumns({c: F.lit("x") for c in ("query", "block", "dims", "v", "copies")})
    assert topk.top_k(vectors, vectors, 2).count() == 10 and vp_trees.neighbours(vectors, vectors, 2).count() == 10


def test_repeated_queries_of_the_top(spark):
    rows = [(100, [1, 2]), (100, [1, 2]), (1, [1, 0]), (2, [1, 0]), (3, [0, 1]), (100, [5, 0])]
    frame = spark.createDataFrame(rows, "id long, vector array<long>")
    got = collections.Counter((r.query_id, r["rank"], r.id, r.score) for r in topk.top_k(frame, frame.filter("id = 100"), 3).collect())
    assert got == collections.Counter(2 * [(100, 1, 3, 2), (100, 2, 1, 1), (100, 3, 2, 1)] + [(100, 1, 1, 5), (100, 2, 2, 5), (100, 3, 3, 0)])


def test_short_items_in_sql(spark):
    docs = [(1, "a b c d e f"), (2, "x b c y"), (3, "b"), (4, None), (5, "B  C"), (6, "c b")]
    items = [(1, "b c"), (2, "b"), (3, "a b c d e"), (4, None), (5, "zz")]
    found = decontaminate.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = sorted(con.execute(decontaminate.SQL).fetchall())
    assert sorted((r.id, r["item"], r.n_item, r.n_shared) for r in found.collect()) == want and len(want) == 9


def test_suffix_speaks_once(spark):
    r = random.Random(3)
    texts = {"en": "the house of the river and the", "de": "der fluss und das haus von dem"}
    rows = [(i, " ".join(r.sample(texts[x].split(), 4)), x, s) for i in range(60) for x, s in [("en", "org") if i % 3 else ("de", "de")]] + [(99, "zq", None, "de"), (98, "zq", None, "org")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string")
    alone = {r.doc_id: r for r in language_id.identify(frame, declared="declared", host=None, suffix="suffix").collect()}
    as_host = {r.doc_id: r for r in language_id.identify(frame, declared="declared", host="suffix", suffix="suffix").collect()}
    assert alone[99].language == "de" and alone[98].language == "en"
    assert as_host[99].language == "de" and as_host[98].language == "en"


def test_the_sample_of_long_rows_is_bounded(spark):
    words = lambda seed, n: " ".join(f"w{seed}x{i}" for i in range(n))
    rows = [(i, words(i % 2, 30_000 + i), i % 2) for i in range(24)]
    frame = spark.createDataFrame(rows, "id long, text string, label int")
    sizes = []
    fit = quality.dual_coordinate_descent
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "dual_coordinate_descent", lambda own, *rest: sizes.append(sum(map(len, own))) or fit(own, *rest))
        few = quality.train(frame, features=6 * quality.BUCKETS)
        every = quality.train(frame)
    assert sizes[0] <= 6 * quality.BUCKETS < sizes[1]
    assert np.sign(few.weights[few.weights != 0]).size > 0 and every.scale.tolist() == few.scale.tolist()  # counts cover all rows
