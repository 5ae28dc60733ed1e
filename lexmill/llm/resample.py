"""Target-distribution importance resampling over hashed n-grams.

Documents are drawn so that their n-grams come to lie like those of a target collection. N-grams go by buckets; a bucket's
gain compares its share of the target with its share of the corpus, and a document weighs the sum of the gains of its
n-grams. Adding a Gumbel draw that follows from its id to each weight and taking the highest scores is a draw without
replacement by weight.

In a task the n-grams of a batch are interned in an open-addressed table: their xxhash64 says where to look, a slot that
is taken by an n-gram of other bytes is passed (hashes and then bytes are compared), and the slot keeps the n-gram's
bucket and its count. Counting sums the slots' counts by bucket; weighing gathers the gain of each occurrence by its
slot. What tasks return is one sum for each bucket, or one row for each document; the table of gains is as long as there
are buckets. Ranks come from a histogram of scores and a range sort of the rows that can be drawn, so that no task holds
all of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.bytewords import text_chunks
from lexmill.session import Scratch, free_names, shuffle_partitions, table

BUCKETS, LEAST_WORDS = 10_000, 20
#: Bytes of a text that are taken apart at a time, about.
PIECE_BYTES = 512 << 10
#: Steps of the histogram of scores.
STEPS = 4096

_LETTER = np.ones(256, dtype=bool)
_LETTER[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_LETTER[ord("A") : ord("Z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Constants of the published hash.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of each span of bytes: those under 32 bytes length by length, the others one by one."""
    out = np.zeros(len(starts), dtype=np.uint64)
    order = np.argsort(np.minimum(sizes, 32), kind="stable")
    cuts = np.searchsorted(np.minimum(sizes, 32)[order], np.arange(34))
    for size in range(32):
        own = order[cuts[size] : cuts[size + 1]]
        if not len(own):
            continue
        rows = data[starts[own][:, None] + np.arange(size)]
        h, at = np.full(len(own), _P5 + np.uint64(size), dtype=np.uint64), 0
        for _ in range(size // 8):
            lane = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8")[:, 0]
            h = _rotated(h ^ (_rotated(lane * _P2, 31) * _P1), 27) * _P1 + _P4
            at += 8
        if size - at >= 4:
            lane = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)
            h = _rotated(h ^ (lane * _P1), 23) * _P2 + _P3
            at += 4
        for k in range(at, size):
            h = _rotated(h ^ (rows[:, k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[own] = h ^ (h >> np.uint64(32))
    for i in order[cuts[32] :].tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return out


class Interned:
    """An open-addressed table of the n-grams of one batch: hash, first occurrence, bucket and count of each slot."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, buckets: int, hashes: np.ndarray | None = None):
        """``hashes`` stand in for those of the spans (in tests of collisions)."""
        self.data, self.starts, self.sizes = data, starts, sizes
        hashes = span_hashes(data, starts, sizes) if hashes is None else hashes
        mask = (1 << max(4, int(2 * len(starts)).bit_length())) - 1
        first = np.full(mask + 1, -1, dtype=np.int64)  # an occurrence, by slot
        slots = (hashes & np.uint64(mask)).astype(np.int64)
        open_ = np.arange(len(starts))
        while len(open_):
            at = slots[open_]
            vacant = first[at] < 0
            first[at[vacant]] = open_[vacant]  # of several that meet in a slot one stays
            held = first[at]
            same = (held == open_) | ((hashes[held] == hashes[open_]) & (sizes[held] == sizes[open_]))
            same[same] = self._equal(held[same], open_[same])
            open_ = open_[~same]
            slots[open_] = (slots[open_] + 1) & mask
        taken = np.flatnonzero(first >= 0)
        #: slot of each occurrence, and bucket and count of each slot
        self.slots = slots
        self.counts = np.bincount(slots, minlength=mask + 1)
        self.buckets = np.zeros(mask + 1, dtype=np.int64)
        raw, held = data.tobytes(), first[taken]
        crc = zlib.crc32
        self.buckets[taken] = [crc(raw[a:b]) % buckets for a, b in zip(starts[held].tolist(), (starts + sizes)[held].tolist(), strict=True)]
        self.taken = taken

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of two spans of one size are the same."""
        out = np.ones(len(a), dtype=bool)
        check = np.flatnonzero((a != b) & (self.sizes[a] > 0))
        if len(check):
            size = self.sizes[a[check]]
            first = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(first, size)
            differs = self.data[place + np.repeat(self.starts[a[check]], size)] != self.data[place + np.repeat(self.starts[b[check]], size)]
            out[check] = ~np.logical_or.reduceat(differs, first)
        return out

    def bucket_counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.buckets[self.taken], weights=self.counts[self.taken], minlength=buckets).astype(np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(bytes, offsets, goes on) of texts; a long text alone is cut behind bytes of no word."""
    if len(offsets) > 2 or len(data) <= PIECE_BYTES:
        yield data, offsets, False
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        while end < len(data) and _LETTER[data[end - 1]]:
            ahead = np.flatnonzero(~_LETTER[data[end : end + PIECE_BYTES]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(len(data), end + PIECE_BYTES)
        yield data[at:end], np.array([0, end - at]), at > 0
        at = end


def _grams(data: np.ndarray, offsets: np.ndarray, n: int, carried: bytes = b"", carried_words: int = 0):
    """(normalised bytes, starts, sizes, owners, words by text, bytes to carry, words to carry) of all runs of 1 to n words.

    In the normalised bytes the words stand in lower case, each with one space behind it. Runs within carried words are not
    counted again.
    """
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:] = inside
    edge[offsets] = False
    starts = np.flatnonzero(inside & ~edge[:-1])
    edge[:-1], edge[-1] = inside, False
    edge[offsets] = False
    ends = np.flatnonzero(inside & ~edge[1:]) + 1
    sizes = ends - starts
    own = np.cumsum(sizes + 1) - sizes - 1
    norm = np.full(int(sizes.sum()) + len(sizes), 0x20, dtype=np.uint8)
    place = np.ones(len(norm), dtype=bool)
    place[own + sizes] = False
    norm[place] = _LOWER[data[inside]]
    by_text = np.searchsorted(starts, offsets)
    counts = np.diff(by_text)
    owners = np.repeat(np.arange(len(counts)), counts)
    if carried_words:
        before = np.frombuffer(carried, dtype=np.uint8)
        spaces = np.flatnonzero(before == 0x20)
        norm = np.concatenate([before, norm])
        own = np.concatenate([np.append(0, spaces[:-1] + 1), own + len(before)])
        sizes = np.concatenate([np.diff(spaces, prepend=-1) - 1, sizes])
        owners = np.concatenate([np.zeros(carried_words, dtype=owners.dtype), owners])
    spans, total = [], len(sizes)
    for m in range(1, n + 1):
        i = np.arange(max(0, carried_words - m + 1), max(0, total - m + 1))
        i = i[owners[i] == owners[i + m - 1]]
        spans.append((own[i], own[i + m - 1] + sizes[i + m - 1] - own[i], owners[i]))
    at, size, owner = (np.concatenate(x) for x in zip(*spans, strict=True))
    keep = min(n - 1, total)
    return norm, at, size, owner, counts, (norm[own[total - keep] :].tobytes() if keep else b""), keep


def _batches(batches: Iterator[pa.RecordBatch], text_col: str, n: int, buckets: int):
    """(batch, first row, row after the last, table, owners, words by text) of each piece."""
    for batch in batches:
        for first, last, data, offsets in text_chunks(batch.column(text_col), PIECE_BYTES):
            carried, words = b"", 0
            for part, cuts, goes_on in _pieces(data, offsets):
                norm, starts, sizes, owners, counts, carried, words = _grams(part, cuts, n, *((carried, words) if goes_on else ()))
                yield batch, first, last, goes_on, Interned(norm, starts, sizes, buckets), owners, counts


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket and count (of n-gram occurrences) of the buckets that occur in all texts; tasks return sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for *_, found, _, _ in _batches(batches, text_col, n, buckets):
            total += found.bucket_counts(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("count"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    all_source, all_target = float(sum(source.values())), float(sum(target.values()))
    out = [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (all_source + buckets) / ((source.get(b, 0) + 1.0) * (all_target + buckets)))) for b in range(buckets)]
    return np.array(out, dtype=np.int64)


def weighed(docs: DataFrame, table_of_gains: np.ndarray, text_col: str = "text", n: int = 1) -> DataFrame:
    """``docs`` without the text, with n_words, n_features and weight (the sum of gains over all occurrences); results replace columns of their names."""
    told = docs.sparkSession.sparkContext.broadcast(table_of_gains)
    stay = [c for c in docs.columns if c.lower() not in ("n_words", "n_features", "weight") and c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held) -> pa.RecordBatch:
            batch, first, last, sums = held
            kept = batch.select(stay).slice(first, last - first)
            return pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, sums)], names=[*stay, "n_words", "n_features", "weight"])

        held = None
        for batch, first, last, goes_on, found, owners, counts in _batches(batches, text_col, n, len(told.value)):
            gain = told.value[found.buckets][found.slots]  # of each occurrence, by its slot
            sums = [counts.astype(np.int64), np.bincount(owners, minlength=len(counts)), np.bincount(owners, weights=gain, minlength=len(counts)).astype(np.int64)]
            if goes_on:
                held = (*held[:3], [a + b for a, b in zip(held[3], sums, strict=True)])
                continue
            if held:
                yield row(held)
            held = (batch, first, last, sums)
        if held:
            yield row(held)

    fields = [docs.schema[c] for c in stay]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_words long, n_features long, weight long"])
    return docs.select(*(F.col(f"`{c}`") for c in stay), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def ranked(rows: DataFrame, able: Column, most: int, order: list, scratch: Scratch) -> DataFrame:
    """``rows`` with rank: the places, from 1, of the first ``most`` that are able, by descending score, then ``order``; null for all others.

    A histogram of the scores finds a score that ``most`` able rows reach; rows that reach it are sorted by ranges, and
    a row's place is the number of rows in the ranges before it and its own place in its range.
    """
    low, high = rows.filter(able).agg(F.min("score"), F.max("score")).first()
    if most < 1 or low is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    bin_ = ((F.lit(high) - F.col("score")) / max(1, -(-(high - low + 1) // STEPS))).cast("long")
    total, last = 0, 0
    for last, n in sorted(rows.filter(able).groupBy(bin_.alias("bin")).count().collect()):  # at most STEPS rows
        total += n
        if total >= most:
            break
    near = F.coalesce(able & (bin_ <= last), F.lit(False))
    place, part, before = free_names([*rows.columns, "rank"], "place", "part", "before")
    keys = [F.desc("score"), *order]
    top = rows.filter(near).repartitionByRange(max(shuffle_partitions(rows.sparkSession), total // 1_000_000), *keys).sortWithinPartitions(*keys)
    top = scratch.table(top.withColumn(place, F.monotonically_increasing_id()), "sorted").withColumn(part, F.shiftright(place, 33))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = top.groupBy(part).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(ahead), F.lit(0)))  # one row for each range
    at = F.col(before) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    top = top.join(F.broadcast(sizes), part).withColumn("rank", F.when(at <= most, at)).select(*rows.columns, "rank")
    return top.union(rows.filter(~near).withColumn("rank", F.lit(None).cast("long")))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_words, n_features, weight, score and rank (from 1; null if not drawn) of every document, and its other columns but the text.

    ``percent`` of a hundred documents of at least ``least_words`` words are drawn (rounded down), highest scores first, ties
    to smaller ids, null ids first; repeated rows are documents of their own. Null texts have no words. A null id draws as
    the empty string. Columns with names of results are replaced. An empty target has equal gains up to the
    corpus; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    source = {r["bucket"]: r["count"] for r in bucket_counts(docs, text_col, n, buckets).collect()}  # at most ``buckets`` rows
    wanted = {r["bucket"]: r["count"] for r in bucket_counts(target, text_col, n, buckets).collect()}
    rows = weighed(docs.drop("score", "rank"), gains(source, wanted, buckets), text_col, n)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = scratch.table(rows.withColumn("score", F.col("weight") + draw), "weighed")
    able = F.col("n_words") >= least_words
    return ranked(rows, able, percent * rows.filter(able).count() // 100, [F.asc_nulls_first(id_col), "n_features"], scratch)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of ``documents``, drawn towards ``benchmark``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = importance_resample(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


SQL = None
