"""The pipeline's rows against a brute-force version of its stages, and its stages on odd tables."""

import collections
import re
import zlib

import numpy as np

import corpus_pipeline
from lexmill.llm import packing

from .test_ops import PASSAGE, classes, prose, removed, shingles

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def brute(docs, items):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t, *_ in docs if t and re.search(r"[^\W\d_]", t)]
    first = {c for _, n, c in classes(rows)}
    rows = [(i, t) for i, t in rows if i in first]
    spans = dict(removed(rows, 400))
    cut = []
    for i, t in rows:
        raw, at, kept = t.encode(), 0, b""
        for a, b in spans[i]:
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            kept, at = kept + raw[at:a], b
        cut.append((i, (kept + raw[at:]).decode()))
    sets = [shingles(t) for _, t in items]
    clean = [(i, t) for i, t in cut if not any(s and 100 * len(s & shingles(t)) >= 80 * len(s) for s in sets)]
    tokenizer, out = Tokenizer.from_file(packing.tokenizer_path()), collections.Counter()
    for i, t in clean:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[start : start + 4096], "<u4")
            out[i, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    return out


def test_rows_equal_brute_force(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 70").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    item = " ".join(prose(31, 40).split())
    docs += [(1000 + i, docs[i][1] + " one more end", docs[i][2], "x", 0) for i in range(0, 12, 3)]
    docs += [(2000 + i, prose(50 + i, 60) + " " + PASSAGE + " " + prose(80 + i, 50), "en", None, None) for i in range(3)]
    docs += [(3000, prose(5, 90) + " " + item + " " + prose(6, 90), "en", "y", 1), (3001, None, "en", "y", 1), (3002, "", None, None, None), (3003, "123 456", "de", "z", 7)]
    items = [(1, item), (2, prose(99, 30)), (3, None)]
    folder = write(spark, tmp_path, docs, items)
    got = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in got) == brute(docs, items)
    used = collections.Counter()
    for r in got:
        used[r.sequence_id] += r["length"]
    assert max(used.values()) <= 4096


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path, [], [])
    docs = spark.createDataFrame([], SCHEMA + ", kept int, k1 string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
