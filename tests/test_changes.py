"""Change-driven links and tree differences against full recomputation."""

import collections
import random

from pyspark.sql import functions as F

from lexmill.operators import corpus, hash_tree
from lexmill.session import Scratch
from lexmill.streaming import relink


def full_join(citations, claims):
    owners = {}
    for key, doc, sign in claims:
        owners.setdefault(key, {})[doc] = owners.get(key, {}).get(doc, 0) + sign
    least = {k: min((d for d, n in v.items() if n > 0), default=None) for k, v in owners.items()}
    return sorted(((d, p, k, least.get(k)) for d, p, k in citations), key=str)


def held(store):
    return sorted(((r.from_doc, r.from_para, r.citation_key, r.to_doc) for r in store.links().collect()), key=str)


def test_batches_in_every_order_equal_the_full_join(spark):
    cite = lambda rows: spark.createDataFrame(rows, "from_doc long, from_para int, citation_key string")
    claim = lambda rows: spark.createDataFrame(rows, "citation_key string, doc_id long, sign long")
    parts = [
        ([(1, 0, "a"), (1, 0, "a"), (2, None, "b"), (3, 1, None)], []),  # repeated, unresolved
        ([(4, 1, "a")], [("a", 9, 1), ("c", 5, 1)]),  # a late owner
        ([], [("a", 7, 1), ("b", 8, 1), ("c", 5, -1)]),  # a replaced owner, one that goes
    ]
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        store, seen_c, seen_k = relink.LinkStore(spark, Scratch(spark, "links").root, 4), [], []
        for number, i in enumerate(order):
            citations, claims = parts[i]
            store.apply(number, cite(citations), claim(claims))
            store.apply(number, cite(citations), claim(claims)) if number == 1 else None  # a batch that runs again
            seen_c, seen_k = seen_c + [c for c in citations if c[2] is not None], seen_k + claims
        assert held(store) == full_join(seen_c, seen_k), order
    small = store.compacted(Scratch(spark, "links").root)
    assert held(small) == held(store)
    small.apply(9, None, claim([("a", 7, -1)]))
    assert held(small) == full_join(seen_c, seen_k + [("a", 7, -1)])
    assert {r.citation_key for r in small.changes(9).collect()} == {"a"}


def test_a_stream_of_changes(spark, tmp_path):
    r = random.Random(7)
    events = []
    for _ in range(300):
        kind = r.choice(["citation", "citation", "claim"])
        events.append((kind, r.choice("abcdefgh"), r.randrange(40), r.randrange(5)))
    schema = "kind string, citation_key string, doc_id long, from_para int"
    for i in range(3):
        spark.createDataFrame(events[i * 100 : i * 100 + 100], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    relink.relink_stream(source, str(tmp_path / "store"), str(tmp_path / "point"), 4).awaitTermination()
    store = relink.LinkStore(spark, str(tmp_path / "store"))
    cited = [(d, p, k) for kind, k, d, p in events if kind == "citation"]
    assert held(store) == full_join(cited, [(k, d, 1) for kind, k, d, _ in events if kind == "claim"])
    assert store._read("links").select("batch").distinct().count() >= 2


def test_differences_equal_anti_joins(spark, tmp_path):
    rows = [(i, f"h{i % 997}", i % 50) for i in range(4000)]
    old = spark.createDataFrame(rows, "id int, hash string, size int")
    one = hash_tree.HashTree(spark, str(tmp_path / "one"), part_digits=1).build(old, "id", "hash", "size")
    assert one.root() == corpus.sorted_root(old, "id", "hash", "size").first().root
    for name, changed in (("few", [(4, "x", 1), (-1, "new", 70), (5, "h5", 5), (5, "h5", 5)]), ("none", []), ("many", [(i, "y", i) for i in range(2000)])):
        gone = {c[0] for c in changed} if name != "few" else {4}
        new_rows = [x for x in rows if x[0] not in gone] + changed
        new = spark.createDataFrame(new_rows, "id int, hash string, size int")
        two = hash_tree.HashTree(spark, str(tmp_path / name), part_digits=1).build(new, "id", "hash", "size")
        found = hash_tree.difference(one, two)
        got = sorted((r.id, r.hash, r["size"], r.copies, r.change) for r in found.rows.collect())
        before, after = collections.Counter(rows), collections.Counter(new_rows)
        want = sorted((*x, abs(after.get(x, 0) - before.get(x, 0)), "added" if after.get(x, 0) > before.get(x, 0) else "removed") for x in set(before) | set(after) if before.get(x, 0) != after.get(x, 0))
        assert got == want
        assert (found.read == 2) == (name == "none")
        if name == "few":
            assert found.read < 12_500  # the upper levels and a few leaves; the tables hold 8 000 rows and as many nodes
            leaves = found.read - 2 - sum(t.level(3).count() for t in (one, two))
            assert leaves < 60
        assert hash_tree.delta_bytes(found.rows).first().added_files == sum(x[4] == "added" for x in want)
    empty = hash_tree.HashTree(spark, str(tmp_path / "empty"), part_digits=1).build(old.limit(0), "id", "hash", "size")
    assert empty.root() is None and hash_tree.difference(empty, one).rows.count() == 4000 and hash_tree.difference(empty, empty).rows.count() == 0
