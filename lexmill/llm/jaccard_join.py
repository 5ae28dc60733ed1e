"""Near duplicates by a grouped prefix join on word shingles.

Tokens (hashes of word shingles) have one total order: those known as frequent last, the rest by hash. Two sets
that overlap in ``t`` tokens share at least ``k`` of their first ``n - t + k`` tokens; ``k`` grows with the size, so that
long texts do not meet by chance. Documents with the same set are one node; nodes with the same prefix and size are
one group, and groups, not documents, meet in the buckets of prefix tokens. Group pairs pass filters on sizes and
on the places of shared tokens, and must share ``k`` prefix tokens; then their members are verified on whole sets.

Components are wanted, not all links, so a bucket is first tried through a pivot: each group meets at most one
group, the one that is pivot of most of its buckets. Verified links are contracted, and buckets whose members have
come together go. What is left after the pivot rounds meets in full, all pairs of different components. There one
shared token makes a pair, among prefixes that are so much shorter, and a pair meets at its first shared token, not at all
of them: each row knows the tokens before its own, and does not meet a row that knows one of them too. Such pairs first compare
sketches, the parities of their tokens by bucket: sets whose sketches differ in d bits differ in d tokens at least, so
most pairs that do not link need not send their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.bytewords import segments_unique, shingle_hashes, text_chunks, word_hashes, words
from lexmill.llm.components import components
from lexmill.session import Scratch, free_names, table

WIDTH, PERCENT = 5, 80
#: Most tokens that have a rank as frequent, and the local count that makes a token a candidate. They only set an
#: order of tokens: results do not depend on them.
RANKED, LOCAL_COUNT = 1 << 18, 4
PIVOT_ROUNDS = 2
#: Partners of one pivot in one task.
PIVOT_ROWS = 256
#: A linked pair shares at least 2, and this part of the size, among the first tokens of either.
SHARED_PART = 20
#: Tokens before its own that a row of the last round knows. More spare more repeated meetings of a pair; results are the same.
KNOWN_BEFORE = 4

_SETS = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("sid", pa.binary()), ("n", pa.int64()), ("token", pa.int64()), ("df", pa.int64())])
_PREFIX = pa.schema([("sid", pa.binary()), ("gid", pa.int64()), ("n", pa.int32()), ("ranked", pa.list_(pa.int64())), ("plain", pa.list_(pa.int64()))])


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, offsets): each document's distinct tokens, ascending."""
    for a, _b, data, offsets in text_chunks(column):
        starts, ends, word_offsets = words(data, offsets)
        values, at = shingle_hashes(word_hashes(data, starts, ends), word_offsets, width)
        yield (a, *segments_unique(values, at))


def _shared(n: Column, percent: int) -> Column:
    """The prefix tokens that a set of ``n`` shares with each set that is similar enough (the smaller of a pair's two)."""
    return F.least(F.ceil(n * percent / 100), F.greatest(F.lit(2), 1 + F.floor(n / SHARED_PART)))


def _sid(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _describe(width: int):
    """A row for each document, and at the end the tokens that many different sets of this task hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        tokens, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            fresh = []
            for a, values, offsets in _sets(batch.column("text"), width):
                cuts = offsets.tolist()
                sids = [_sid(values[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
                for i, sid in enumerate(sids):
                    if sid is not None and sid not in seen:
                        seen.add(sid)
                        fresh.append(values[cuts[i] : cuts[i + 1]])
                m = len(sids)
                nulls = [None] * m
                yield pa.RecordBatch.from_arrays([batch.column("k1").slice(a, m), batch.column("k2").slice(a, m), pa.array(sids, pa.binary()), pa.array(np.diff(offsets)), pa.array(nulls, pa.int64()), pa.array(nulls, pa.int64())], schema=_SETS)
            if fresh:
                here, n = np.unique(np.concatenate(fresh), return_counts=True)
                both, inverse = np.unique(np.concatenate([tokens, here]), return_inverse=True)
                total = np.bincount(inverse, weights=np.concatenate([counts, n])).astype(np.int64)
                keep = total >= 2  # what stands once so far may be forgotten: counts only set an order
                tokens, counts = both[keep], total[keep]
        often = counts >= LOCAL_COUNT
        if often.any():
            m = int(often.sum())
            nulls = [None] * m
            yield pa.RecordBatch.from_arrays([pa.array(nulls, pa.int64()), pa.array(nulls, pa.int32()), pa.array(nulls, pa.binary()), pa.array(nulls, pa.int64()), pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], schema=_SETS)

    return run


def _prefixes(width: int, percent: int, ranked: np.ndarray, ranks: np.ndarray):
    """Each set's first tokens: ``ranked`` ones (frequent) and ``plain`` ones apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _a, values, offsets in _sets(batch.column("text"), width):
                if not len(values):
                    continue
                n = np.diff(offsets)
                owner = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(values), dtype=np.int64)
                if len(ranked):
                    at = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
                    rank = np.where(ranked[at] == values, ranks[at], 0)
                order = np.argsort((owner.astype(np.int64) << 32) | rank, kind="stable")
                values, rank = values[order], rank[order]
                need = -(-percent * n // 100)
                length = np.minimum(n, n - need + np.minimum(need, np.maximum(2, 1 + n // SHARED_PART)))
                rows = []
                for i in np.flatnonzero(n).tolist():
                    x, y = int(offsets[i]), int(offsets[i + 1])
                    sid = _sid(np.sort(values[x:y]))
                    if sid in seen:
                        continue
                    seen.add(sid)
                    first, r = values[x : x + int(length[i])], rank[x : x + int(length[i])]
                    gid = int.from_bytes(hashlib.blake2b(first.tobytes(), digest_size=8, salt=int(n[i]).to_bytes(8, "little")).digest(), "little", signed=True)
                    rows.append((sid, gid, int(n[i]), first[r > 0].view(np.int64), first[r == 0].view(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PREFIX, strict=True)], schema=_PREFIX)

    return run


def _shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, those whose token stands in another row too; a batch's last row waits for the next."""
    held, shared = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        token = whole.column("token").to_numpy()
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= shared
        held, shared = whole.slice(len(token) - 1, 1).combine_chunks().to_batches()[0], bool(keep[-1])
        keep[-1] = False
        yield from whole.filter(pa.array(keep)).to_batches()
    if shared:
        yield held


def _verify(percent: int):
    """Links among rows sorted by pivot: the pivot's set comes first, then its partners' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, b = [], []
            for p, x, blob in zip(batch.column("p").to_pylist(), batch.column("x").to_pylist(), batch.column("tokens"), strict=True):
                values = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                if x is None:
                    pivot, own = p, values.copy()
                    continue
                if p != pivot:
                    raise ValueError("a pair without its pivot's set")
                at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                common = int((own[at] == values).sum())
                if 100 * common >= percent * (len(own) + len(values) - common):
                    a.append(p)
                    b.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (p, x) whose sets are similar enough. A pivot with many partners is dealt to many tasks."""
    pairs, sets = scratch.table(pairs, "pairs"), sets.select("sid", "tokens")
    parts = pairs.groupBy("p").agg(F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("parts"))
    parts = scratch.table(parts, "parts")
    partner = pairs.join(parts, "p").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")).select("p", "part", "x").join(sets.withColumnRenamed("sid", "x"), "x").select("p", "part", "x", "tokens")
    pivot = parts.join(sets.withColumnRenamed("sid", "p"), "p").select("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("x"), "tokens")
    sent = partner.union(pivot).repartition("p", "part").sortWithinPartitions("p", "part", F.col("x").asc_nulls_first())
    return scratch.table(sent.mapInArrow(_verify(percent), "a binary, b binary"), "links")


def _need(percent: int) -> Column:
    """The overlap of similar sets of sizes n and pn, at least."""
    return F.ceil(percent * (F.col("n") + F.col("pn")) / (100 + percent))


def _pair_filters(percent: int, one: bool = False) -> tuple[Column, Column]:
    """(a filter of shared tokens, the least number of those that pass) for pairs of sets n, pn.

    Similar sets share ``need`` tokens, at least k of them among the first n - need + k of the one and among the
    first pn - need + k of the other: equal sizes need more, and so look at fewer tokens, than a set must keep for
    all its partners. Before a shared token come, of the overlap, only tokens that both prefixes share with others
    (``before``, ``pbefore`` in number), and behind it no more than what is left of either set. With ``one`` k is 1.
    """
    n, pn = F.col("n"), F.col("pn")
    need = _need(percent)
    k = F.lit(1) if one else F.least(_shared(n, percent), _shared(pn, percent))
    sizes = 100 * F.least(n, pn) >= percent * F.greatest(n, pn)
    most = F.least("before", "pbefore") + F.least(n - F.col("pos"), pn - F.col("ppos"))
    return sizes & (F.col("pos") < n - need + k) & (F.col("ppos") < pn - need + k) & (most >= need), k


def _pivot_pairs(rows: DataFrame, members: DataFrame, percent: int, seed: int) -> DataFrame:
    """(p, x): each group's members with the first member of one pivot group, or of their own group."""
    near, k = _pair_filters(percent)
    # The pivot of a bucket is a group with few tokens of its own: around a copied text it is the one nearest to it.
    # Later rounds are coarser about that and try others.
    own = F.floor(F.col("own") * (10 if seed else 1000) / F.col("n"))
    pivots = rows.groupBy("token").agg(F.min(F.struct(own.alias("own"), F.xxhash64("gid", F.lit(seed)).alias("h"), F.col("gid").alias("pgid"), F.col("n").alias("pn"), F.col("before").alias("pbefore"), F.col("pos").alias("ppos"))).alias("p")).select("token", "p.pgid", "p.pn", "p.pbefore", "p.ppos")
    met = rows.join(pivots, "token").filter("gid <> pgid").filter(near).groupBy("gid", "pgid", "n", "pn").agg(F.count("*").alias("c")).filter(F.col("c") >= k)
    best = met.groupBy("gid").agg(F.max(F.struct("c", F.xxhash64("pgid", F.lit(seed)), "pgid")).alias("b")).select("gid", F.col("b.pgid").alias("pgid"))
    first = members.groupBy("gid").agg(F.min("sid").alias("p"))
    across = members.join(best, "gid").join(first.withColumnRenamed("gid", "pgid"), "pgid").select("p", F.col("sid").alias("x"))
    within = members.join(first, "gid").filter("sid <> p").select("p", F.col("sid").alias("x"))
    return across.union(within).distinct()


def _all_pairs(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Every pair of nodes of different components that the filters leave: in one group, or in two."""
    near, _ = _pair_filters(percent, one=True)
    within = Window.partitionBy("gid", "n").orderBy("pos")
    known = [f"l{i}" for i in range(1, KNOWN_BEFORE + 1)]
    rows = rows.select("token", "gid", "n", "pos", "before", "root", *[F.lag("token", i).over(within).alias(c) for i, c in enumerate(known, 1)])
    rows = rows.filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100))  # the prefix for the smallest partner
    other = rows.select("token", *[F.col(c).alias(f"p{c}") for c in rows.columns if c != "token"])
    # A pair that links passes the filters at its first shared token, and has no other before it.
    later = F.lit(False)
    for mine in known:
        for theirs in known:
            later = later | F.coalesce(F.col(mine) == F.col(f"p{theirs}"), F.lit(False))
    met = rows.join(other, "token").filter("gid < pgid and (root is null or proot is null or root <> proot)").filter(near).filter(~later).select("gid", "pgid").distinct()
    same = members.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("gid", F.col("gid").alias("pgid"))
    groups = met.select("gid", "pgid").union(same)
    right = members.select(F.col("gid").alias("pgid"), F.col("sid").alias("p"), F.col("root").alias("proot"))
    return groups.join(members, "gid").join(right, "pgid").filter("root <> proot and (gid <> pgid or sid < p)").select("p", F.col("sid").alias("x")).distinct()


def _classes(docs: DataFrame, text: str, id_col: str, width: int, percent: int, pivot_rounds: int) -> DataFrame:
    """k1, k2, id, n_shingles and root of each row; the root, null without words, names the component."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"k1": F.xxhash64("id", "text"), "k2": F.hash("text", "id")})
    described = scratch.table(docs.select("k1", "k2", "text").mapInArrow(_describe(width), "k1 long, k2 int, sid binary, n long, token long, df long"), "described")
    often = described.filter("token is not null").groupBy("token").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "token").limit(RANKED).select("token").toPandas()
    tokens = often["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    ranks = (len(tokens) - np.arange(len(tokens)))[order]  # the most frequent has the highest rank
    told = spark.sparkContext.broadcast((tokens[order], ranks.astype(np.int64)))
    prefixes = docs.select("text").mapInArrow(lambda it: _prefixes(width, percent, *told.value)(it), "sid binary, gid long, n int, ranked array<long>, plain array<long>")
    prefixes = scratch.table(prefixes.dropDuplicates(["sid"]), "prefixes")
    groups = prefixes.dropDuplicates(["gid", "n", "ranked", "plain"])
    # Plain tokens are rare by their order: a shuffle by token leaves those that groups share. Frequent ones are taken as shared.
    plain = groups.select("gid", "n", F.posexplode("plain").alias("pos", "token")).repartition("token").sortWithinPartitions("token").mapInArrow(_shared_runs, "gid long, n int, pos int, token long")
    ranked = groups.select("gid", "n", F.size("plain").alias("before"), F.posexplode("ranked").alias("pos", "token")).select("gid", "n", "token", F.col("before") + F.col("pos"))
    both = plain.select("gid", "n", "token", "pos").union(ranked)
    # ``own``: how many prefix tokens no other prefix has. They may stand in a partner behind its prefix, and so only
    # guide the choice of pivots. ``before``: the shared ones before a token. Of the tokens before it an overlap
    # holds shared ones alone: what both sets have before a token that stands in both prefixes, both prefixes have.
    group = Window.partitionBy("gid", "n")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + _shared(F.col("n"), percent)
    rows = both.withColumn("before", F.row_number().over(group.orderBy("pos")) - 1).withColumn("own", length - F.count("*").over(group))
    rows = rows.filter(100 * (F.col("n") - F.col("pos") + F.col("before")) >= percent * F.col("n"))
    # A partner may be smaller, down to ``percent`` of the size, and share as little as that size asks for.
    smallest = F.ceil(F.col("n") * percent / 100)
    rows = rows.withColumn("c", F.count("*").over(group)).filter(F.col("c") >= _shared(smallest, percent)).drop("c")
    rows = scratch.table(rows, "rows")
    met = rows.select("gid").distinct()
    crowded = prefixes.groupBy("gid").agg(F.count("*").alias("c")).filter("c > 1").select("gid")
    members = prefixes.select("gid", "sid", "n").join(met.union(crowded).distinct(), "gid", "left_semi")
    members = scratch.table(members, "members")
    one = described.filter("sid is not null").groupBy("sid").agg(F.min(F.struct("k1", "k2")).alias("k")).join(members.select("sid"), "sid", "left_semi").select("k.k1", "k.k2")
    one = scratch.table(one, "one")
    sets = docs.select("k1", "k2", "text").join(one.hint("merge"), ["k1", "k2"], "left_semi").select("text").mapInArrow(lambda it: _token_sets(width)(it), "sid binary, tokens binary, sketch binary, n long")
    sets = scratch.table(sets, "sets")  # a set stands twice if a row is repeated as a whole: its links then do too

    links, roots = None, None
    for round_ in range(pivot_rounds + 1):
        if roots is None:
            state, live = members.withColumn("root", F.col("sid")), rows
        else:
            state = members.join(roots, F.col("sid") == F.col("node"), "left").select("gid", "sid", "n", F.coalesce("root", "sid").alias("root"))
            state = scratch.table(state, "state")
            # A group's root, null if its members have several; buckets of one root are done.
            of = state.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).select("gid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("root"))
            live = rows.join(of, "gid")
            rest = live.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count_if(F.col("root").isNull()).alias("mixed")).filter("lo <> hi or mixed > 0").select("token")
            live = scratch.table(live.join(rest, "token", "left_semi"), "live")
        if round_ < pivot_rounds:
            pairs = _pivot_pairs(live, state.select("gid", "sid"), percent, round_)
            if roots is not None:
                at = state.select("sid", "root")
                pairs = pairs.join(at.select(F.col("sid").alias("p"), F.col("root").alias("rp")), "p").join(at.select(F.col("sid").alias("x"), F.col("root").alias("rx")), "x").filter("rp <> rx").select("p", "x")
        else:
            pairs = _sketched(_all_pairs(live, state, percent), sets, percent)
        found = _verified(pairs, sets, percent, scratch)
        links = found if links is None else scratch.table(links.union(found), "all_links")
        roots = components(links, scratch)
    at = described.filter("token is null").select("k1", "k2", "sid", "n").dropDuplicates(["k1", "k2"])
    at = at.join(roots, F.col("sid") == F.col("node"), "left").select("k1", "k2", F.col("n").alias("n_shingles"), F.coalesce("root", "sid").alias("root"))
    at = docs.select("k1", "k2", "id").join(at, ["k1", "k2"])
    return scratch.table(at, "at")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """k1, k2, id, n_shingles and component_id of each row of ``docs``.

    Words are runs of bytes other than space and 0x09 to 0x0D, A-Z as a-z. A row's set holds its distinct shingles
    of ``width`` words; with fewer words the whole sequence is one. Rows link when 100 * intersection >= percent *
    union; component_id is the smallest id that links reach. Rows without words (null, empty, blank) have an empty
    set and only reach themselves. Repeated rows are alike; null ids never are the smallest, and a component of
    null ids has a null id. Other columns are left aside. k1 and k2 are hashes of id and text, for joining back.
    """
    at = _classes(docs, text, id_col, width, percent, pivot_rounds)
    least = at.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    return at.join(least, "root", "left").select("k1", "k2", "id", "n_shingles", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def _sketch(values: np.ndarray) -> bytes:
    """Whether an odd number of tokens falls into each of a power of two of buckets, two for each token at least."""
    buckets = 1 << max(6, (2 * len(values) - 1).bit_length())
    return np.packbits(np.bincount((values & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(one: bytes, two: bytes) -> int:
    """Tokens that only one of two sets has, at least; the larger sketch is folded to the size of the smaller."""
    a, b = (np.frombuffer(x, np.uint8) for x in (one, two))
    while len(a) != len(b):
        if len(a) > len(b):
            a, b = b, a
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _sketched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, x) that their sketches leave: similar sets differ in no more than both sizes less twice the overlap."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        most = (n + m) + 2 * (-percent * (n + m) // (100 + percent))
        return pd.Series([differing(x, y) for x, y in zip(a, b, strict=True)], dtype=np.int64) <= most.astype(np.int64)

    own = lambda c: sets.select(F.col("sid").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}")).dropDuplicates([c])
    both = pairs.select("p", "x").join(own("p"), "p").join(own("x"), "x")
    return both.filter(near("sp", "sx", "np", "nx")).select("p", "x")


def _token_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _a, values, offsets in _sets(batch.column("text"), width):
                cuts = offsets.tolist()
                own = [values[x:y] for x, y in zip(cuts, cuts[1:], strict=False) if y > x]
                columns = [pa.array([_sid(v) for v in own], pa.binary()), pa.array([v.tobytes() for v in own], pa.binary()), pa.array([_sketch(v) for v in own], pa.binary()), pa.array([len(v) for v in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["sid", "tokens", "sketch", "n"])

    return run


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id (then of the smallest hashes).

    Rows without words link with nothing and stay, also repeated ones. Other columns stay, whatever their names.
    """
    found = _classes(docs, text, id_col, width, percent, PIVOT_ROUNDS)
    k1, k2, single = free_names(docs.columns, "k1", "k2", "single")
    alone = found.filter("root is null").select("k1", "k2").distinct().withColumn(single, F.lit(False))
    first = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("m")).select("m.k1", "m.k2", F.lit(True).alias(single))
    keyed = docs.withColumns({k1: F.xxhash64(id_col, F.coalesce(F.col(text), F.lit(""))), k2: F.hash(F.coalesce(F.col(text), F.lit("")), F.col(id_col))})
    kept = keyed.join(first.union(alone).toDF(k1, k2, single), [k1, k2])
    one = kept.filter(F.col(single)).dropDuplicates([k1, k2])
    return one.union(kept.filter(~F.col(single))).select(docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL = None
