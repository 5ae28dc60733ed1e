"""Packing of tokenised documents into sequences by pattern counts.

A histogram of piece lengths says everything that packing needs, and it has at most ``capacity`` rows. Patterns of a few
lengths that fill a sequence exactly are enumerated; how often each repeats is fitted to the histogram by
non-negative least squares (coordinate descent), rounded down and taken. What is left is packed by best fit: the
largest remaining length opens a pattern, the largest length that still fits is added until none does, and the
pattern repeats until one of its lengths is used up.

The plan is a list of runs (length, first rank, ...); each piece finds its place from its rank among pieces of its
length. Ranks come from counts by (length, bucket), so no task holds all pieces of one length. A plan has at most
``capacity`` residual patterns with fewer than sqrt(2 * capacity) different lengths each, and MOST_PATTERNS others, so
its size does not grow with the data.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import Scratch, free_names, shuffle_partitions, table

CAPACITY, END_ID = 4096, 1
#: Enumerated patterns, and sweeps of the fit.
MOST_PATTERNS, SWEEPS = 12_000, 60
#: Words whose ids a worker remembers before it starts anew.
CACHED_WORDS = 1_000_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids of texts, word by word.

    White space is a hard border for this tokenizer, and so is one between letters and punctuation; it lower-cases, and
    encodes each stretch of letters or of punctuation by itself. So words are remembered in lower case (A-Z only), and
    unknown words of Latin letters, with or without ASCII punctuation behind them, are put together from the ids of
    their stretches, which the tokenizer's model gives for their byte-level spelling. All other words go through the
    whole tokenizer.
    """

    #: Letters of which each lower-cases to one letter, then punctuation (no apostrophe: it can start a stretch).
    PLAIN = re.compile(r"([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Byte-level spelling: printable bytes stand for themselves, the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelling = {x: 256 + i for i, x in enumerate(x for x in range(256) if x not in plain)}
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.marks: dict[str, list[int]] = {"": []}
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _stretch(self, part: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(part.lower().encode().decode("latin-1").translate(self.spelling))]

    def _store(self, words: list[bytes], found: list[list[int]]) -> None:
        n = np.fromiter(map(len, found), np.int64, len(found))
        self.index.update(zip(words, range(len(self.count), len(self.count) + len(words)), strict=True))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(n) - n])
        self.count = np.concatenate([self.count, n])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))])

    def _add(self, fresh: list[bytes]) -> None:
        stems: dict[bytes, str] = {}
        built, whole = [], []  # (word, stem, punctuation); words for the whole tokenizer
        for raw in fresh:
            word = raw.decode()
            m = self.PLAIN.fullmatch(word)
            if m is None or "<|" in word:
                whole.append(raw)
                continue
            stem, mark = m.groups()
            key = stem.encode() if mark else raw
            if key not in self.index:
                stems[key] = stem
            if mark:
                built.append((raw, key, mark))
                if mark not in self.marks:
                    self.marks[mark] = self._stretch(mark)
        self._store(list(stems), [self._stretch(x) for x in stems.values()])
        self._store(whole, [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in whole], add_special_tokens=False)])
        at = [self.index[key] for _, key, _ in built]
        first, last = self.first[at].tolist(), (self.first[at] + self.count[at]).tolist()
        flat = self.flat
        self._store([w for w, _, _ in built], [flat[a:b].tolist() + self.marks[mark] for a, b, (_, _, mark) in zip(first, last, built, strict=True)])

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of each text its ids."""
        # Special tokens are matched with their case; bytes split at space and 0x09-0x0D.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            fresh = dict.fromkeys(words[i] for i in missing)
            if len(self.index) + len(fresh) > CACHED_WORDS and self.index:
                self.clear()
                return self.ids(texts)
            self._add(list(fresh))
            at[missing] = np.fromiter((self.index[words[i]] for i in missing), np.int64, len(missing))
        n = self.count[at]
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(self.first[at] - (ends - n), n) + np.arange(int(n.sum()))]
        cuts = np.append(0, ends)[np.cumsum([0, *map(len, split)])]
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_words: dict[str, WordIds] = {}


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list, list[np.ndarray]]]:
    """(type of ids, document ids, token ids with the end) of small runs of rows."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _words:
        _words[path] = WordIds(path)
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, (doc, value) in enumerate(zip(batch.column("doc_id"), batch.column("text"), strict=True)):
            raw = (value.as_py() or "").encode()
            ids.append(doc.as_py())
            texts.append(raw)
            size += len(raw)
            if size > 1 << 20 or i == batch.num_rows - 1:
                yield batch.schema.field("doc_id").type, ids, [np.append(x, np.uint32(END_ID)) for x in _words[path].ids(texts)]
                ids, texts, size = [], [], 0


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, docs, found in _encoded(path, batches):
            rows = []
            for doc, ids in zip(docs, found, strict=True):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity].astype("<u4")
                    row = (doc, piece, start, len(own), zlib.crc32(own.tobytes()))
                    rows.append((*row, own.astype(np.int32)) if keep_ids else row)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            kinds[0] = kind
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces; null texts are empty (the end id).

    doc_id keeps its type and may be null; a row that is repeated has its pieces as often as it stands; other columns are
    left aside. Very long texts are encoded whole and cut. An empty table gives an empty result.
    """
    schema = _PIECES.replace("doc_id long", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}") + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, keep_ids), schema)


def exact_patterns(lengths: np.ndarray, capacity: int, most: int = MOST_PATTERNS) -> list[tuple[int, ...]]:
    """Patterns of two to four of ``lengths`` (ascending) that fill the capacity, spread over the lengths."""
    present = np.zeros(capacity + 1, dtype=bool)
    present[lengths] = True
    out = [(int(a), int(capacity - a)) for a in lengths if a >= capacity - a > 0 and present[capacity - a]]
    each = max(1, (most - len(out)) // (2 * max(1, len(lengths))))
    for a in lengths[::-1].tolist():
        rest = capacity - a
        fit = lengths[(lengths <= min(a, rest - 1)) & (2 * lengths >= rest)]
        fit = fit[present[rest - fit]]
        picked = fit[np.unique(np.linspace(0, len(fit) - 1, min(each, len(fit))).astype(int))] if len(fit) else fit
        out += [(a, int(b), int(rest - b)) for b in picked]
        third = rest // 3
        near = lengths[np.searchsorted(lengths, [third], side="right") - 1] if len(lengths) else lengths
        for b in near.tolist():
            left = rest - b
            fit = lengths[(lengths <= min(a, left - 1)) & (2 * lengths >= left)] if 0 < b < rest else lengths[:0]
            fit = fit[present[left - fit]]
            picked = fit[np.unique(np.linspace(0, len(fit) - 1, min(each, len(fit))).astype(int))] if len(fit) else fit
            out += [tuple(sorted((a, b, int(c), int(left - c)), reverse=True)) for c in picked]
        if len(out) >= most:
            break
    return list(dict.fromkeys(out))[:most]


def fit_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths closest to the histogram, by coordinate descent."""
    columns = [(np.array(list(c)), np.array(list(c.values()), dtype=float)) for c in map(Counter, patterns)]
    norms = [float(w @ w) for _, w in columns]
    x, rest = np.zeros(len(patterns)), histogram.astype(float)
    for _ in range(sweeps):
        moved = 0.0
        for j, (rows, weights) in enumerate(columns):
            step = max(-x[j], float(weights @ rest[rows]) / norms[j])
            if step:
                x[j] += step
                rest[rows] -= step * weights
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern: length -> times, repeats) that use the histogram up."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        out.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0

    def take(pattern: dict[int, int], most: int | None = None) -> None:
        times = min(int(left[length]) // k for length, k in pattern.items())
        times = times if most is None else min(times, most)
        if times > 0:
            out.append((pattern, times))
            for length, k in pattern.items():
                left[length] -= times * k

    patterns = exact_patterns(np.flatnonzero(left), capacity)
    counts = fit_counts(patterns, left) if patterns else np.zeros(0)
    for j in np.argsort(-counts, kind="stable"):
        if counts[j] >= 1:
            take(dict(Counter(patterns[j])), int(counts[j]))
    lengths = np.flatnonzero(left).tolist()
    while lengths:
        pattern: Counter[int] = Counter()
        room = capacity
        while True:
            k = bisect_right(lengths, room) - 1
            while k >= 0 and left[lengths[k]] <= pattern[lengths[k]]:
                k -= 1
            if k < 0:
                break
            length = lengths[k]
            fits = max(1, min(room // length, int(left[length]) - pattern[length]))
            pattern[length] += fits
            room -= fits * length
        take(dict(pattern))
        lengths = [x for x in lengths if left[x]]
    return out


def _runs(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan by length and rank."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        at = 0
        for length, k in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], k, sequence, at))
            used[length] += k * times
            at += k * length
        sequence += times
    rows.sort()
    names = ("length", "rank", "times", "sequence", "offset")
    return dict(zip(names, (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)), strict=True)) if rows else {n: np.zeros(0, np.int64) for n in names}


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences of at most ``capacity``, each gapless from 0.

    pieces: a length (1 to ``capacity``) and columns that order pieces of one length (ties are interchangeable).
    Other columns stay; sequence_id and offset are replaced. Lengths beyond the capacity, null or under 1 are an
    error. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.table(pieces.drop("sequence_id", "offset"), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if any(x is None or not 1 <= x <= capacity for x in histogram):
        raise ValueError("a length outside 1 to the capacity")
    runs = _runs(plan(histogram, capacity))
    told = spark.sparkContext.broadcast(runs | {"key": runs["length"] << 40 | runs["rank"]})
    bucket, own_rank, before_rank, place_ = free_names([*pieces.columns, "sequence_id", "offset"], "bucket", "own", "before", "place")
    buckets = max(64, shuffle_partitions(spark))
    bucketed = pieces.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("length", bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(before_rank))
    own = Window.partitionBy("length", bucket).orderBy(*order)
    ranked = bucketed.withColumn(own_rank, F.row_number().over(own) - 1).join(counts, ["length", bucket])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        runs, length, rank = told.value, length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(runs["key"], length << 40 | rank, side="right") - 1
        k, times = rank - runs["rank"][at], runs["times"][at]
        return pd.DataFrame({"sequence_id": runs["sequence"][at] + k // times, "offset": runs["offset"][at] + k % times * length})

    placed = ranked.withColumn(place_, place("length", F.col(before_rank) + F.col(own_rank)))
    return placed.select(*pieces.columns, f"{place_}.sequence_id", f"{place_}.offset")


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids and doc_ids (with their offsets) of the packed sequences themselves."""
    placed = pack(token_pieces(docs, tokenizer, capacity, keep_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x.doc_id.alias("doc_id"), x.piece.alias("piece"), x.offset.alias("offset"))).alias("parts")
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 4096 tokens, and their places in sequences."""
    return pack(token_pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


SQL = None
