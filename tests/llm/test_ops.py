"""Operators over training corpora: small fixtures with nulls, blanks, long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import backoff_lm, chat, components, decontaminate, jaccard_join, language_id, packing, quality, suffix_dedup, topk, url_filter
from lexmill.session import Scratch

SF = "/root/testdata/sf0.001"
VOCABULARY = [a + b for a in "bcdfglmnprst" for b in ("a", "eo", "ini", "ur")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


BASE = prose(1, 120)
PASSAGE = prose(2, 130)
DOCS = [
    (1, BASE, "en"), (2, BASE.upper(), "en"), (3, BASE + " extra words here", "fr"), (4, " ".join(BASE.split()[:100]), None), (5, None, "en"), (6, "", None), (7, "   \n\t ", "de"),
    (8, "one two three", "en"), (9, "One  two\tthree", "en"), (10, prose(3, 4000) + " " + PASSAGE, "es"), (11, "é" * 50 + " " + PASSAGE + " ü tail", "fr"), (12, prose(4, 5), None),
    (13, prose(4, 5), None), (13, prose(4, 5), None), (None, prose(5, 80), "en"), (14, "ab" * 700, "en"), (15, prose(6, 60) + " " + BASE, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "src", 1, "kept", 2) for i, t, s in DOCS], "doc_id long, text string, lang string, source string, k1 int, root string, spans int").repartition(3)


def empty(spark, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame([], schema)


# --- n-gram Jaccard join ---


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(s), min(least[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_near_duplicates_equal_brute_force(spark, docs):
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()), key=str)
    assert got == classes([(i, t) for i, t, _ in DOCS])


def test_near_duplicates_of_a_chain_and_a_family(spark):
    r = random.Random(9)
    base = [r.choice(VOCABULARY) + str(i) for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[i : i + 100])) for i in range(0, 50, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame, pivot_rounds=1).collect()), key=str)
    assert got == classes(rows)


def test_near_duplicates_of_isolated_pairs_of_unequal_size(spark):
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(0, 400, 2):
        w, more = fresh(104), fresh(r.randrange(14, 26))
        at = r.choice((0, 50, 104))
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:at] + more + w[at:]))]
    want = classes(rows)
    assert sum(i != c for i, _, c in want) > 100
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.id, x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(frame).collect()), key=str)
    assert got == want


def test_keep_one_and_empty(spark, docs):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 5, 6, 7, 8, 10, 11, 12, None, 14, 15, 4][: -1] + ([4] if (4, len(shingles(DOCS[3][1])), 4) in classes([(i, t) for i, t, _ in DOCS]) else []), key=str)
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 102), (100, 100), (100, 101)], "a long, b long")
    got = {r.node: r.root for r in components.components(links, Scratch(spark, "t")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and all(got[i] == 100 for i in (100, 101, 102))


def collide(n):
    """Two different words of 2**n letters that every polynomial hash modulo 2**64 takes for one, for n >= 11."""
    w = "a"
    for _ in range(n):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_long_words_are_told_apart(spark):
    one, two = collide(12)
    rows = [(1, one), (2, two), (3, one.upper()), (4, one[:64]), (5, two[:64]), (6, one[:65]), (7, one[:65] + " "), (8, "a" * 64), (9, "a" * 65)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame).collect())
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4), (5, 1, 5), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 9)]
    known = {r.doc_id: r.n_known for r in backoff_lm.score_texts(frame, F.col("doc_id") == 1).collect()}
    assert known[2] == 1 and known[3] == 2  # the end, and the word in capitals


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n, m, k in ((5, 5, 3), (100, 130, 60), (40, 2000, 40), (3000, 3100, 2900), (1, 1, 0), (64, 64, 64)):
        values = rng.integers(0, 1 << 63, n + m - k, dtype=np.uint64)
        one, two = np.sort(values[:n]), np.sort(values[n - k :])
        d = jaccard_join.differing(jaccard_join._sketch(one), jaccard_join._sketch(two))
        assert d <= n + m - 2 * k and (d > 0.6 * (n + m - 2 * k) or n * 8 < m or n + m == 2 * k or n < 10)


def test_copies_too_far_apart_to_link(spark):
    r = random.Random(12)
    base = [r.choice(VOCABULARY) + str(i) for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in r.sample(range(150), 2 if i % 3 else 5):
            w[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = classes(rows)
    assert 1 < len({c for _, _, c in want}) < 100
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((x.id, x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(frame).collect()), key=str) == want


# --- suffix arrays ---


def removed(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    starts = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        cover = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] > 1:
                cover[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(int), [0]])))
        out.append((i, [tuple(map(int, x)) for x in edge.reshape(-1, 2)]))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_rows", [20_000, 1])
def test_long_repeats_equal_brute_force(spark, docs, group_rows):
    found = suffix_dedup.long_repeats(docs, group_rows=group_rows)
    assert sorted(found.columns) == sorted(docs.columns)
    got = sorted(((r.doc_id, [(s.start, s.stop) for s in r.spans]) for r in found.collect()), key=str)
    assert got == removed([(i, t) for i, t, _ in DOCS], 400)


def test_family_of_arrays(spark):
    r = random.Random(6)
    grams = [bytes([r.randrange(3)] * 31) + bytes([r.randrange(40)]) for _ in range(300)]
    family, seen, every = suffix_dedup.SuffixFamily(Scratch(spark, "t"), 3), collections.Counter(), set()
    for i in range(0, 300, 50):
        fresh = collections.Counter(grams[i : i + 50])
        got = family.add(spark.createDataFrame([(bytearray(g),) for g in grams[i : i + 50]], "suffix binary"))
        want = {g for g, n in fresh.items() if n > 1 or seen[g]}
        assert {bytes(x.suffix) for x in got.collect()} == want
        seen += fresh
        every |= want
    assert [n for n, _ in family.levels] == [4, 1, 1]
    assert family.add(spark.createDataFrame([], "suffix binary")).count() == 0
    scan = family.levels[0][1].select("suffix").hint("merge").join(family.levels[-1][1].select("suffix").hint("merge"), "suffix", "left_semi")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # arrays are scanned as they lie
    assert [suffix_dedup.batch_count(x) for x in (0, 1 << 27, 1 << 30, 1 << 47)] == [1, 3, 6, 23]


def test_passages_of_many_documents(spark):
    rows = [(i, prose(100 + i, 30 + i) + " " + PASSAGE[i * 3 :] + " " + prose(200 + i, 40)) for i in range(12)]
    found = suffix_dedup.long_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batches=3)
    assert sorted(((r.doc_id, [(s.start, s.stop) for s in r.spans]) for r in found.collect()), key=str) == removed(rows, 400)


def test_removed_texts_stay_text(spark, docs):
    kept = suffix_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns and {(r.k1, r.root, r.spans) for r in kept.collect()} == {(1, "kept", 2)}
    got = {r.doc_id: r.text for r in kept.collect()}
    assert got[5] is None and got[6] == "" and PASSAGE not in got[10] and got[8] == "one two three" and got[11].startswith("é")
    assert suffix_dedup.long_repeats(empty(spark)).count() == 0


# --- decontamination ---


def test_leaks_equal_brute_force(spark, docs):
    items = [(1, " ".join(BASE.split()[10:60])), (2, prose(77, 30)), (3, None), (4, ""), (5, "one two three"), (6, " ".join(PASSAGE.split()[5:50]) + " changed end words"), (None, BASE), (6, " ".join(PASSAGE.split()[5:50]))]
    found = decontaminate.leaked_items(docs, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, hash int"))
    sets, mine = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            sets[i] |= shingles(t)
    for i, t, _ in DOCS:
        mine[i] |= shingles(t)
    want = {(d, i, len(s), len(s & own)) for d, own in mine.items() for i, s in sets.items() if s and 100 * len(s & own) >= 80 * len(s)}
    assert {tuple(r) for r in found.collect()} == want and len(want) >= 4
    kept = decontaminate.drop_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns and kept.count() == sum(d not in {w[0] for w in want} for d, _, _ in DOCS)
    assert decontaminate.leaked_items(docs, empty(spark, "item_id long, text string")).count() == 0
    assert decontaminate.leaked_items(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_short_items_are_found_inside_longer_documents(spark):
    texts = [(1, "alpha beta gamma"), (2, prose(21, 30) + " Alpha  beta\tgamma " + prose(22, 9)), (3, "alpha beta gamma delta"), (4, "alpha x beta gamma and more words"), (5, prose(23, 40) + " one"), (6, None), (7, ""), (8, prose(24, 50) + " " + BASE)]
    items = [(1, "alpha beta gamma"), (2, "ONE"), (3, "gamma delta"), (4, "nowhere to be found"), (5, " ".join(BASE.split()[10:60]))]
    got = decontaminate.leaked_items(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    places = lambda t, m: {tuple(words(t)[i : i + m]) for i in range(len(words(t)) - m + 1)}
    want = set()
    for i, item in items:
        m = min(5, len(words(item)))
        need = places(item, m)
        want |= {(d, i, len(need), len(need & places(t, m))) for d, t in texts if 100 * len(need & places(t, m)) >= 80 * len(need)}
    assert {tuple(r) for r in got.collect()} == want
    assert {w[:2] for w in want} == {(1, 1), (2, 1), (3, 1), (5, 2), (3, 3), (8, 5)}


def test_a_shingle_of_all_items(spark):
    head = "what is the answer to"
    items = [(i, f"{head} {prose(300 + i, 14)}") for i in range(40)] + [(40, head), (41, f"{head} this")]
    texts = [(i, f"{prose(400 + i, 20)} {head} {prose(300 + i, 14) if i % 3 else prose(900 + i, 14)}") for i in range(30)]
    got = decontaminate.leaked_items(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    sets = {i: shingles(t) for i, t in items}
    want = {(d, i, len(s), len(s & shingles(t))) for d, t in texts for i, s in sets.items() if 100 * len(s & shingles(t)) >= 80 * len(s)}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 50


# --- packing ---


def test_packing_places_everything(spark, docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    odd = [(20, "Ünï ÀÉ don't it's x1y2 <|endoftext|> <|ENDOFTEXT|> a,b. ... İstanbul ΣΑΣ é no break ​ 5½ ﬁ"), (21, "word, " * 9000)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = packing.pack(packing.token_pieces(frame, path)).collect()
    want = collections.Counter()
    for i, t in [(i, t) for i, t, _ in DOCS] + odd:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[start : start + 4096], "<u4")
            want[i, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.token_pieces(empty(spark), path)).count() == 0
    whole = packing.packed_sequences(frame, path).collect()
    assert sum(len(r.ids) for r in whole) == sum(r["length"] for r in rows) and max(len(r.ids) for r in whole) <= 4096


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_the_histogram_up(seed):
    r = random.Random(seed)
    histogram = collections.Counter(min(512, max(1, int(r.lognormvariate(4, 1)))) for _ in range(3000))
    used, sequences = collections.Counter(), 0
    for pattern, times in packing.plan(dict(histogram), 512):
        assert sum(length * k for length, k in pattern.items()) <= 512
        sequences += times
        for length, k in pattern.items():
            used[length] += k * times
    assert used == histogram
    assert sequences <= -(-sum(length * n for length, n in histogram.items()) // 512) * 1.01 + 1


# --- url filters ---


def test_url_rules_equal_brute_force(spark, monkeypatch):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.com", "", "block"), ("a.com", "", "allow"), ("", "/", "block"), (None, "/", "block")]
    urls = ["http://x.example.org/en/12", "http://EXAMPLE.org/en/2", "http://example.org", "https://b.a.com?x", "ftp://q.com/de/1#f", "http://com/fr/", "notexample.org/es/", "http://notexample.org/es/", None, "", "://", "http://a.b.c.com/fr/x?y=http://org/", "http://org:80/", "HTTP://q.org/é/中", "http://a.org/" + "x/" * 30_000, "http://example.org/en/1" + "y" * 50_000] * 2
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(4)

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host = re.match(r"[^/?#]*", rest)[0] if rest is not None else ""
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1] if rest is not None else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[3:] if fits else (None, "allow")))

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(empty(spark, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    for ranges in (1, 50):  # few and many keys in a range
        monkeypatch.setattr(url_filter, "RANGE_KEYS", ranges)
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()} == got
    none = url_filter.judge_urls(pages, empty(spark, "host string, path string, verdict string"))
    assert {r.verdict for r in none.collect()} == {"allow"}


# --- exact top-k ---


def test_top_k_with_ties(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(150)] + [(200 + i, [1, 1, 1, 1, 1, 1]) for i in range(40)] + [(500, None), (501, [1, None, 1, 1, 1, 1]), (None, [1] * 6), (3, [2] * 6), (600, [0] * 6)]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in vectors], "id long, vector array<long>, score double")
    queries = frame.filter("id % 50 = 0")
    got = collections.defaultdict(list)
    for r in topk.top_k(frame, queries, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    good = [(i, v) for i, v in vectors if i is not None and v is not None and None not in v]
    for q, v in good:
        if q % 50 == 0:
            want = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q))[:7]
            assert got[q] == [(i, -s) for s, i in want]
    assert topk.top_k(frame.limit(0), queries).count() == 0 and topk.top_k(frame, queries.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [0.5, float("nan")]), (2, [0.5, -0.5]), (3, None), (4, [None, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.id, r.vector) for r in topk.whole_numbers(odd).collect()] == [(2, [512, -512])]


def test_top_k_of_large_numbers_and_many_blocks(spark):
    big = (1 << 62) + 5
    rows = [(0, [big, big, 1]), (1, [big, big, 0]), (2, [big, -big, 0]), (3, [1, 2, 3]), (4, [big, big, -1]), (5, [-big, -big, 7]), (100, [0, 0, 0])]
    frame = spark.createDataFrame(rows, "id long, vector array<long>")
    product = lambda v, w: sum(a * b for a, b in zip(v, w, strict=True))
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    got = {(r.query_id, r.id): r.score for r in topk.top_k(frame, frame.filter("id = 0"), 6).collect()}
    assert got == {(0, i): clip(product(rows[0][1], v)) for i, v in rows[1:]}
    rng = np.random.default_rng(4)
    many = [(i, (rng.normal(size=4) * [900, 60, 5, 1]).astype(int).tolist()) for i in range(4000)]
    frame = spark.createDataFrame(many, "id long, vector array<long>")
    got = collections.defaultdict(list)
    found = topk.top_k(frame, frame.filter("id % 200 = 0"), 5).orderBy("query_id", "rank").collect()
    for r in found:
        got[r.query_id].append((r.id, r.score))
    for q in range(0, 4000, 200):
        want = sorted((-product(many[q][1], w), i) for i, w in many if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in want]
    large = spark.createDataFrame([(1, [1e300, -1e300])], "vec_id long, embedding array<double>")
    assert topk.whole_numbers(large).first().vector == [(1 << 63) - 1, -(1 << 63)]


# --- language model ---


def walk(texts):
    """(score, base) of each text by a dictionary automaton: states are tuples of words, failure arcs drop the first."""
    counts = [collections.Counter() for _ in range(3)]
    for _, t, learn in texts:
        w = [*words(t), "\n"]
        if learn:
            counts[0].update((x,) for x in w)
            counts[1].update(zip(["\n", *w[:-1]], w, strict=True))
            counts[2].update(zip(["\n", *w[:-2]], w[:-1], w[1:], strict=False))
    n, v = sum(counts[0].values()), len(counts[0])
    base = lambda x: (counts[0][(x,)] + 0.1) / (n + 0.1 * (v + 1))
    known = lambda h: not h or counts[len(h) - 1][h] > 0
    mass = lambda h: 1 + 2 * counts[len(h) - 1][h] ** 0.8
    fail = lambda h: mass(h) / (counts[len(h) - 1][h] + mass(h))

    def arc(h, x):
        if not h:
            return base(x)
        c = counts[len(h)][(*h, x)]
        return (c + mass(h) * (arc(h[1:], x) if counts[len(h) - 1][(*h[1:], x)] or len(h) == 1 else 0)) / (counts[len(h) - 1][h] + mass(h)) if c else None

    out, longest = [], 0
    for _, t, _ in texts:
        state, score = (("\n",) if known(("\n",)) else ()), 0.0
        w = [*words(t), "\n"]
        for x in w:
            fails = 0
            while (p := arc(state, x)) is None:
                score, state, fails = score + math.log10(fail(state)), state[1:], fails + 1
            longest = max(longest, fails)
            score += math.log10(p)
            state = (*state, x)[-2:]
            while not known(state):
                state = state[1:]
        out.append((len(w), sum(counts[0][(x,)] > 0 for x in w), n, round(sum(math.log10(base(x)) for x in w), 6), round(score, 6)))
    return out, longest


def test_scores_equal_a_walk(spark, docs, monkeypatch):
    train = F.col("doc_id") % 3 != 0
    rows = backoff_lm.score_texts(docs, train).collect()
    texts = [(i, t, i is not None and i % 3 != 0) for i, t, _ in DOCS]
    want, longest = walk(texts)
    assert longest == 2
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows]
    assert sorted(got, key=str) == sorted(((i, not learn, *w) for (i, _, learn), w in zip(texts, want, strict=True)), key=str)
    assert backoff_lm.score_texts(empty(spark), train).count() == 0
    assert {r.train_tokens for r in backoff_lm.score_texts(docs, F.lit(False)).collect()} == {0}


def test_tapes_and_probabilities():
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 2, 3, 255, 256, 257, 511, 700, 5)]
    texts += [" ".join(x) for n in (1, 2, 3) for x in itertools.product([*"abcdefgh", "zz"], repeat=n)]  # every n-gram
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    tok, at = backoff_lm.tokens(data, np.append(0, np.cumsum([len(t) for t in texts])))
    learn = np.arange(len(texts)) < 10
    counts = [backoff_lm.counted(g, np.repeat(learn, np.diff(at)))[1] for g in backoff_lm.grams(tok, at)]
    n, v = int(counts[0].sum()), int((counts[0] > 0).sum())
    machine = backoff_lm.Automaton(tok, at, counts, n, v)
    want, _ = walk([(i, t, i < 10) for i, t in enumerate(texts)])
    assert [round(x, 6) for x in machine.read(at)] == [w[-1] for w in want]
    # From every state that a text goes on from the known words, the end and one unknown word have all the probability.
    every = np.unique(machine.word)
    seen, fresh = set(), {0, int(machine.of_word[machine.end])}
    while fresh:
        state = fresh.pop()
        seen.add(state)
        log, to = machine.step(np.full(len(every), state), every)
        assert abs((10**log).sum() - 1) < 1e-9
        fresh |= set(to[every != machine.end].tolist()) - seen
    assert len(seen) > 60


def test_grams_round_trip():
    grams = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    assert (backoff_lm.unpack_grams(backoff_lm.pack_grams(grams)) == grams).all()
    counts = np.array([0, 1, 254, 255, 256, 10**9])
    assert (backoff_lm.unpack_counts(backoff_lm.pack_counts(counts), 6) == counts).all()


# --- language, quality, chats ---


def test_languages(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(frame).filter("kept").filter("language = lang").count()
    assert got >= 0.98 * frame.count()
    hidden = language_id.identify(frame.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang"))).withColumn("truth", F.lit(1)))
    truth = frame.select("doc_id", F.col("lang").alias("t"))
    assert hidden.filter("doc_id % 4 = 0").join(truth, "doc_id").filter("language = t").count() >= 0.95 * frame.filter("doc_id % 4 = 0").count()
    odd = {r.doc_id: (r.language, r.kept) for r in language_id.identify(docs.withColumn("kept", F.lit("x"))).collect()}
    assert odd[5] == odd[6] == odd[7] == (None, False) and odd[1][1]
    assert language_id.identify(empty(spark)).count() == 0
    pages = language_id.op4_language_id_pages(spark, SF)
    truth = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("t"))
    assert pages.join(truth, "page_id").filter("language = t").count() >= 0.95 * truth.count()


def identified(rows):
    """(language, posterior) by plain dictionaries. rows: (text, declared, host)."""
    names, logs = language_id.LANGUAGES, math.log

    def grams(text):
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        letter = [97 <= c <= 122 or c >= 0xC3 for c in b]
        out = [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(b) - 2) if letter[i + 1] and (letter[i] or letter[i + 2])]
        return out, sum(letter)

    found = [grams(t) for t, _, _ in rows]
    declared = [d if d in names else "" for _, d, _ in rows]
    counts = {x: collections.Counter() for x in names}
    for (g, _), d in zip(found, declared, strict=True):
        if d:
            counts[d].update(g)
    total = {x: sum(c.values()) + 0.5 * 2**14 for x, c in counts.items()}
    text = [[sum(logs((counts[x][b] + 0.5) / total[x]) for b in g) * min(len(g), 40) / max(len(g), 1) for x in names] for g, _ in found]

    def normal(v):
        top = [math.exp(x - max(v)) for x in v]
        return [x / sum(top) for x in top]

    said = [(normal(t), d, h) for t, d, (_, _, h), (_, n) in zip(text, declared, rows, found, strict=True) if n]
    chain = lambda h: [h, ".".join(h.split(".")[1:]) if len(h.split(".")) > 2 else h, h.split(".")[-1]]
    sums = lambda keep: [sum(n[i] for n, d, h in said if keep(d, h)) for i in range(len(names))]
    share = lambda n, up: [(x + 20 * u) / (sum(n) + 20) for x, u in zip(n, up, strict=True)]
    every = sums(lambda d, h: True)
    whole = [(x + 1) / (sum(every) + len(names)) for x in every]
    out = []
    values = {d for _, d, _ in said}
    for t, d, (_, _, h), (_, n) in zip(text, declared, rows, found, strict=True):
        if not n:
            out.append((None, 0.0))
            continue
        host, parent, suffix = chain(h)
        by_suffix = share(sums(lambda d, x: chain(x)[2] == suffix), whole)
        by_parent = share(sums(lambda d, x: chain(x)[1] == parent and chain(x)[2] == suffix), by_suffix)
        prior = share(sums(lambda d, x: x == host), by_parent)
        own = sums(lambda x, h, d=d: x == d)
        p = normal([t[i] + logs(prior[i]) + logs((own[i] + 1) / (every[i] + len(values))) for i in range(len(names))])
        out.append((names[p.index(max(p))], max(p)))
    return out


def test_languages_equal_brute_force(spark):
    base = {"en": "the cat and the dog went there", "fr": "le chat et la souris sont là", "de": "der Hund und die Katze für", "es": "el perro y la niña están aquí"}
    r = random.Random(8)
    rows = []
    for i in range(80):
        x = r.choice(list(base))
        text = " ".join(r.choice(base[x].split()) for _ in range(r.randrange(0, 30)))
        rows.append((text, x if i % 3 else r.choice(["it", "", "EN".lower()]), r.choice(["a.b.org", "c.b.org", "b.org", "x.de", "solo", ""])))
    rows += [(None, "en", "x.de"), ("123 456", "fr", "x.de"), ("é", "fr", "q.r.s.t"), ("the the", "en", "x.de"), ("the the", "en", "x.de"), ("wort " * 30_000, "de", "x.de")]
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id int, text string, lang string, source string").repartition(3)
    got = {x.doc_id: (x.language, round(x.posterior, 9), x.kept) for x in language_id.identify(frame).collect()}
    assert got == {i: (x, round(p, 9), x is not None and p >= 0.5) for i, (x, p) in enumerate(identified(rows))}


def test_quality_equals_a_plain_fit(spark):
    r = random.Random(4)
    good, bad = ["clear", "prose", "about", "things", "here"], ["BUY", "now!!!", "cheap", "$$$", "here"]
    texts = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(r.randrange(1, 12)))) for i in range(40)] + [(40, None), (41, ""), (42, "here " * 20_000), (7, "clear prose")]
    label = {i: i % 2 for i in range(0, 30)}
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*label.items(), (5, 1), (99, 1), (31, 3), (None, 1)], "doc_id long, quality int")
    train = lambda i: i % 5 != 0
    got = sorted(((x.id, round(x.score, 6), x.predicted) for x in quality.quality_scores(frame, labels, train).collect()), key=str)

    def features(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return sorted(set(quality._features(raw, np.array([0, len(raw)]))[0].tolist()))

    rows = [(features(t), y) for i, t in texts for j, y in [*label.items(), (5, 1)] if i == j and train(i)]
    sizes = [sum(y == c for _, y in rows) for c in (0, 1)]
    count = collections.Counter((f, y) for fs, y in rows for f in fs)
    ratio = {f: math.log((count[f, 1] + 1) / (sizes[1] + 2)) - math.log((count[f, 0] + 1) / (sizes[0] + 2)) for fs, _ in rows for f in fs}
    rows.sort(key=lambda x: (np.array(x[0], np.int32).tobytes(), x[1]))
    share = sum(y for _, y in rows) / len(rows)
    scaled = []
    for fs, _ in rows:
        v = {f: ratio[f] for f in fs}
        norm = max(1.0, math.sqrt(sum(x * x for x in v.values())))
        scaled.append({f: x / norm for f, x in v.items()})
    w, bias, alpha = collections.defaultdict(float), 0.0, [0.0] * len(rows)
    rng = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for i in rng.permutation(len(rows)):
            y = 1 if rows[i][1] else -1
            cost = quality.COST * 0.5 / (share if y > 0 else 1 - share)
            margin = sum(x * w[f] for f, x in scaled[i].items()) + bias
            new = min(max(alpha[i] - (y * margin - 1) / (sum(x * x for x in scaled[i].values()) + 1), 0), cost)
            for f, x in scaled[i].items():
                w[f] += (new - alpha[i]) * y * x
            bias += (new - alpha[i]) * y
            alpha[i] = new
    mean = sum(abs(x) for x in w.values()) / quality.BUCKETS
    w = {f: 0.9 * x + 0.1 * mean * ((x > 0) - (x < 0)) for f, x in w.items()}

    def margin_of(fs):
        v = [(ratio.get(f, 0.0), w.get(f, 0.0)) for f in fs]
        return sum(a * b for a, b in v) / max(1.0, math.sqrt(sum(a * a for a, _ in v))) + bias

    slope, offset = quality._curve(np.array([margin_of(fs) for fs, _ in rows]), np.array([float(y) for _, y in rows]))
    scores = [(i, 1 / (1 + math.exp(-(slope * margin_of(features(t)) + offset)))) for i, t in texts]
    assert got == sorted(((i, round(x, 6), int(x >= 0.3)) for i, x in scores), key=str)


def test_quality_on_held_out_rows(spark, docs):
    sf = "/root/testdata/sf0.01"
    rows = quality.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(a > b for a in good for b in bad) >= 0.93 * len(good) * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    labels = spark.createDataFrame([(1, 1), (3, None), (8, 7)], "doc_id long, quality int")
    one = quality.quality_scores(docs, labels, lambda i: i >= 0).collect()
    assert len(one) == len(DOCS) and len({round(r.score, 9) for r in one}) == 1
    assert quality.quality_scores(empty(spark), labels, lambda i: i >= 0).count() == 0


def test_chats(spark, monkeypatch):
    rows = [(1, 0, "user", "hi?"), (1, 1, "assistant", "hello there"), (1, 2, None, "and?"), (1, 2, None, "and?"), (2, 0, "Human", "User: q"), (2, 1, "bot", " a \n"), (3, 0, None, "Assistant: hey"), (None, 1, "user", "x"), (4, None, "system", None), (5, 0, "?", "")]
    long = [(9, i, ("user", "assistant")[i % 2] if i % 7 else None, f"line {i}" + "?" * (i % 2 == 0)) for i in range(700)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + long], "conv_id long, turn long, role string, text string, block string").repartition(4)
    out = chat.format_chats(frame).collect()
    assert len(out) == len(rows) + len(long)
    got = {(r.conv_id, r.turn): (r.role, r.rendered) for r in out}
    assert got[1, 2] == ("user", "<|user|>\nand?<|end|>") and got[2, 0] == ("user", "<|user|>\nq<|end|>")
    assert got[3, 0] == ("assistant", "<|assistant|>\nhey<|end|>") and got[4, None][0] == "system"
    assert sum(got[9, i][0] == ("user", "assistant")[i % 2] for i in range(700)) >= 690
    monkeypatch.setattr(chat, "BLOCK", 1 << 40)  # one block: the same path
    assert {(r.conv_id, r.turn): (r.role, r.rendered) for r in chat.format_chats(frame).collect()} == got
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_transcripts_in_one_text(spark):
    text = "User: can you help?\nwith this: a list\nof lines\n\nAssistant: yes\nhere: it is\nHuman: thanks\n[AI]: bye"
    rows = [(1, 0, None, text), (1, 1, "user", "one more\nQ: and this?\nA: " + "word " * 40_000), (2, 0, "system", "Note: no marker\nat all"), (3, 0, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn, r.part): (r.role, r.rendered.split("\n", 1)[1].removesuffix("<|end|>")) for r in chat.format_chats(frame).collect()}
    assert got[1, 0, 0] == ("user", "can you help?\nwith this: a list\nof lines\n") and got[1, 0, 1] == ("assistant", "yes\nhere: it is")
    assert got[1, 0, 2] == ("user", "thanks") and got[1, 0, 3] == ("assistant", "bye")
    assert got[1, 1, 0] == ("user", "one more") and got[1, 1, 1] == ("user", "and this?") and got[1, 1, 2] == ("assistant", ("word " * 40_000).strip())
    assert got[2, 0, 0] == ("system", "Note: no marker\nat all") and got[3, 0, 0] == ("user", "") and len(got) == 9


def test_one_turn_number_in_very_many_rows(spark, monkeypatch):
    rows = [(1, 3, ("user", "assistant", None)[i % 3], f"t{i}" + "?" * (i % 2)) for i in range(700)] + [(1, i, "user", f"s{i}") for i in range(0, 600, 7)] + [(2, 3, None, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(map(str, chat.format_chats(frame).collect()))
    monkeypatch.setattr(chat, "CROWDED", 32)
    assert sorted(map(str, chat.format_chats(frame).collect())) == want and len(want) == len(rows)


def test_transitions_across_blocks_are_learned(spark, monkeypatch):
    seen = []
    learn = chat._learn
    monkeypatch.setattr(chat, "_learn", lambda rows, edges: seen.append({(r.a, r.b): r.n for r in edges.collect()}) or learn(rows, edges))
    rows = [(1, i, ("user", "assistant", None)[i % 3], f"t{i}") for i in range(0, 2000, 3)] + [(2, 5, "system", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (256, 10, 1 << 40):
        monkeypatch.setattr(chat, "BLOCK", block)
        chat.format_chats(frame).count()
    want = collections.Counter(zip([None, *["user"] * 666], ["user"] * 667, strict=True)) + collections.Counter({(None, "system"): 1})
    assert seen == [dict(want)] * 3


def test_hidden_roles_are_recovered(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    hidden = turns.withColumn("role", F.when(F.col("conv_id") % 4 != 0, F.col("role")))
    both = chat.format_chats(hidden).join(turns.select("conv_id", "turn", F.col("role").alias("truth")), ["conv_id", "turn"]).filter("conv_id % 4 = 0")
    assert both.filter("role = truth").count() >= 0.9 * both.count()


def test_digest_query(spark):
    rows = suffix_dedup.op9_suffix_dedup(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = dict(removed(docs, 400))
    text = dict(docs)
    for r in rows:
        raw, at, kept = text[r.doc_id].encode(), 0, b""
        for a, b in want[r.doc_id]:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(raw) - len(kept), len(want[r.doc_id]), hashlib.sha256(kept).hexdigest())
