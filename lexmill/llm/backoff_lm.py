"""Language-model scores by a weighted backoff automaton over words, pairs and triples.

States are histories: the empty one, each word and each pair of words that training texts hold. A history's state has an arc
for every word that follows it there, to the state of the longest known history that then ends the text, and a failure
arc, with a backoff weight, to the history without its first word; the empty history has an arc for every word. A text is
read once from left to right: the state's arc for the next word is taken if there is one, else failure arcs are followed
until there is; log-probabilities and backoff weights add up on the way.

A word w has, after history h, probability (c(h w) + m(h) P(w | h')) / (c(h) + m(h)), where h' is h without its first word,
and m(h) = 1 + f c(h) ** 0.8, about the number of different words that follow a history of that count (Heaps' law). So the
failure arc weighs m(h) / (c(h) + m(h)), and P(w | empty) is the base model's. For every history the probabilities of
all words and of the unknown word sum to one.

The automaton grows with the corpus and is never whole in one place. Documents belong to splits of about
``SPLIT_BYTES`` of text; a split needs only the states and arcs that its own texts can meet. So each split sends
its distinct n-grams (with counts from training texts) to the partitions of their hashes, counts are summed there, and
what each split asked for comes back. N-grams travel as packed runs of sorted hashes (their differences, byte by byte);
counts come back alone, in the order of the hashes, which the split finds again from its texts. What travels is at
most one entry for each n-gram of a text, whatever the number of splits and partitions.

A split reads many tapes in step: pieces of its texts, each of which carries its own state. A piece that starts inside a
text first reads the two tokens before it, which is all of the past that a state knows.

N-grams go by 63-bit hashes of their words' 64-bit hashes; counts are exact but for chance collisions of those.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.bytewords import mix, text_chunks, word_hashes, words
from lexmill.session import Scratch, table

#: Pseudo-count of the base model; factors (by the history's length) and power of a state's weight for its failure arc.
BASE_PRIOR, STATE_FACTORS, STATE_POWER = 0.1, (2.0, 2.0), 0.8
#: Bytes of text of a split and of a partition of hashes, about.
SPLIT_BYTES, PART_BYTES, LEAST_PARTS = 8 << 20, 8 << 20, 16
#: Tokens that a task gathers before it sends their n-grams.
GATHERED = 5_000_000
#: Tokens of a tape, but for its first two.
TAPE = 256
END = np.uint64(0x1BD11BDAA9FC1A22)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)

#: Kinds of rows by the length of their n-grams, and the kind that carries a partition's totals.
ORDERS, TOTALS = (1, 2, 3), 0
_RUN = "split long, part int, kind int, grams binary, counts binary"
_RUN_ARROW = pa.schema([("split", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
_BACK = "split long, kind int, part int, counts binary, distinct_tokens long, all_tokens long"


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left + _STEP) * _STEP + right)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by document) of the tokens: words, A-Z as a-z, and the end."""
    starts, ends, at = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    out_at = at + np.arange(len(at))
    out = np.full(len(hashes) + len(at) - 1, END, dtype=np.uint64)
    place = np.arange(len(hashes)) + np.repeat(np.arange(len(at) - 1), np.diff(at))
    out[place] = hashes
    return out, out_at


def grams(tok: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Even hashes, at every token, of the word, the pair and the triple that it ends.

    The word before a text's first is the end; a first word ends no triple (0).
    """
    left = np.empty_like(tok)
    left[1:] = tok[:-1]
    left[at[:-1]] = END
    pair = pair_hashes(left, tok)
    triple = np.zeros_like(tok)
    triple[1:] = pair_hashes(pair[:-1] + _STEP, tok[1:])
    triple[at[:-1]] = 0
    return [x & ~_ONE for x in (tok, pair, triple)]


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> _ONE) % np.uint64(parts)).astype(np.int64)


def pack_grams(grams: np.ndarray) -> bytes:
    """Ascending hashes as the byte planes of their differences: high planes are nearly empty and compress."""
    steps = np.diff(grams, prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_grams(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as single bytes, followed by 8 bytes for each that is 255 or more; compressed, since most are 0 or 1."""
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes(), 1)


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return counts


def _firsts(values: np.ndarray) -> np.ndarray:
    """Places at which a sorted array has a new value."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def counted(grams: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct even hashes, ascending, and how often each stands where ``train`` holds; 0 is no n-gram."""
    marked = np.sort(grams | train.astype(np.uint64))
    marked = marked[np.searchsorted(marked, np.uint64(2)) :]
    first = _firsts(marked & ~_ONE)
    return marked[first] & ~_ONE, np.add.reduceat((marked & _ONE).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _send(split: int, kind: int, names: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    part = _part(names, parts)
    order = np.argsort(part, kind="stable")
    names, counts, part = names[order], counts[order], part[order]
    cuts = _firsts(part)
    rows = [(split, int(part[a]), kind, pack_grams(names[a:b]), pack_counts(counts[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(part)), strict=True)]
    columns = zip(*rows, strict=True) if rows else [[]] * len(_RUN_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RUN_ARROW, strict=True)], schema=_RUN_ARROW)


def _ask(parts: int):
    """A task's distinct n-grams by split."""

    def sent(held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        by_split = defaultdict(list)
        for split, *rest in held:
            by_split[split].append(rest)
        for split, runs in by_split.items():
            tok, sizes = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
            train = np.repeat(np.concatenate([r[2] for r in runs]), sizes)
            for kind, names in zip(ORDERS, grams(tok, np.append(0, np.cumsum(sizes))), strict=True):
                yield _send(split, kind, *counted(names, train), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # (split, tokens, tokens of each text, whether each text trains)
        for batch in batches:
            split, train = batch.column("split").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            order = np.argsort(split, kind="stable")
            split, train = split[order], train[order]
            for a, b, data, offsets in text_chunks(batch.column("text").take(pa.array(order))):
                tok, at = tokens(data, offsets)
                cuts = _firsts(split[a:b])
                for x, y in zip(cuts, np.append(cuts[1:], b - a), strict=True):
                    held.append((int(split[a + x]), tok[at[x] : at[y]], np.diff(at[x : y + 1]), train[a + x : a + y]))
                size += len(tok)
                if size > GATHERED:
                    yield from sent(held)
                    held, size = [], 0
        yield from sent(held)

    return run


def _count(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
    """One partition of hashes: total counts, sent back to each split for the hashes that it asked for, in order."""
    part, kind = int(key[0]), int(key[1])
    names = [unpack_grams(x) for x in asked["grams"]]
    counts = np.concatenate([unpack_counts(x, len(g)) for x, g in zip(asked["counts"], names, strict=True)])
    every = np.concatenate(names)
    order = np.argsort(every)
    every = every[order]
    first = _firsts(every)
    every, total = every[first], np.add.reduceat(counts[order], first)
    del order, counts
    by_split: dict[int, list[np.ndarray]] = defaultdict(list)
    for split, own in zip(asked["split"], names, strict=True):
        by_split[int(split)].append(own)
    rows = []
    for split, runs in by_split.items():
        own = runs[0] if len(runs) == 1 else np.unique(np.concatenate(runs))
        rows.append((split, kind, part, pack_counts(total[np.searchsorted(every, own)]), None, None))
    if kind == 1:
        rows.append((0, TOTALS, part, None, int((total > 0).sum()), int(total.sum())))
    out = pd.DataFrame(rows, columns=["split", "kind", "part", "counts", "distinct_tokens", "all_tokens"])
    return out.astype({"distinct_tokens": "Int64", "all_tokens": "Int64"})


class Automaton:
    """The part of the automaton that one split's texts can meet.

    State 0 is the empty history. Arcs are kept by state and word in one sorted table; those of state 0 by word alone.
    ``tok``, ``at``: the split's tokens and their offsets by document; ``counts``: totals of their words, pairs and triples,
    each in the ascending order of the distinct hashes.
    """

    def __init__(self, tok: np.ndarray, at: np.ndarray, counts: list[np.ndarray], n: int, v: int):
        names = grams(tok, at)
        # Words by number; pairs and triples by one place where they stand.
        order = np.argsort(names[0])
        first = _firsts(names[0][order])
        self.word = np.empty(len(tok), np.int32)
        self.word[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(tok))))
        self.word_counts, self.vocabulary = counts[0], len(first)
        self.end = int(self.word[at[1] - 1])  # every text ends with the end
        p1 = (self.word_counts + BASE_PRIOR) / (n + BASE_PRIOR * (v + 1))
        self.base = np.log10(p1)

        order = np.argsort(names[1])
        first = _firsts(names[1][order])
        pair = np.empty(len(tok), np.int32)
        pair[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(tok))))
        place = order[first]
        left = np.where(np.isin(place, at[:-1]), self.end, self.word[place - 1])
        c2, right = counts[1], self.word[place]
        self.of_word = np.where(self.word_counts > 0, np.cumsum(self.word_counts > 0), 0)
        words_known = int((self.word_counts > 0).sum())
        of_pair = np.where(c2 > 0, words_known + np.cumsum(c2 > 0), 0)
        p2, fail1 = self._arcs(c2, self.word_counts[left], p1[right], 0)

        order = np.argsort(names[2])
        order = order[np.searchsorted(names[2], np.uint64(2), sorter=order) :]
        place = order[_firsts(names[2][order])]
        c3, history, last = counts[2], pair[place - 1], pair[place]
        p3, _ = self._arcs(c3, c2[history], p2[last], 1)

        known2, known3 = np.flatnonzero(c2 > 0), np.flatnonzero(c3 > 0)
        key = np.concatenate([self.of_word[left[known2]] * self.vocabulary + right[known2], of_pair[history[known3]] * self.vocabulary + right[last[known3]]])
        order = np.argsort(key)
        self.key = key[order]
        self.to = np.concatenate([of_pair[known2], of_pair[last[known3]]])[order]
        self.log = np.log10(np.concatenate([p2[known2], p3[known3]]))[order]
        # Failure arcs: of a pair's state to its second word's, of a word's state to 0.
        states = 1 + words_known + len(known2)
        self.fail_to, self.fail_log = np.zeros(states, np.int64), np.zeros(states)
        self.fail_log[self.of_word] = np.log10(self._weight(self.word_counts, 0))
        self.fail_to[of_pair[known2]] = self.of_word[right[known2]]
        self.fail_log[of_pair[known2]] = np.log10(self._weight(c2[known2], 1))

    @staticmethod
    def _mass(c: np.ndarray, length: int) -> np.ndarray:
        return 1.0 + STATE_FACTORS[length] * c.astype(float) ** STATE_POWER

    def _weight(self, c: np.ndarray, length: int) -> np.ndarray:
        return self._mass(c, length) / (c + self._mass(c, length))

    def _arcs(self, c: np.ndarray, of_history: np.ndarray, lower: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of words after histories, histories' failure weights)."""
        mass = self._mass(of_history, length)
        return (c + mass * lower) / (of_history + mass), mass / (of_history + mass)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of the ways, next states) of tapes in ``state`` that read ``word``."""
        log, out = np.zeros(len(state)), np.empty(len(state), np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            now, read = state[open_], word[open_]
            root = now == 0
            done = open_[root]
            log[done] += self.base[read[root]]
            out[done] = self.of_word[read[root]]
            open_, now, read = open_[~root], now[~root], read[~root]
            if not len(open_):
                break
            key = now * self.vocabulary + read
            at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
            hit = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
            done = open_[hit]
            log[done] += self.log[at[hit]]
            out[done] = self.to[at[hit]]
            open_, now = open_[~hit], now[~hit]
            log[open_] += self.fail_log[now]
            state = state.copy()
            state[open_] = self.fail_to[now]
        return log, out

    def read(self, at: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        n = np.diff(at)
        tapes = -(-n // TAPE)
        doc = np.repeat(np.arange(len(n)), tapes)
        start = at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(tapes) - tapes, tapes)) * TAPE
        stop = np.minimum(start + TAPE, at[doc + 1])
        inside = start > at[doc]
        state = np.where(inside, 0, self.of_word[self.end])
        for back in (2, 1):
            own = np.flatnonzero(inside)
            state[own] = self.step(state[own], self.word[start[own] - back])[1]
        order = np.argsort(start - stop, kind="stable")  # longest first
        start, size, state = start[order], (stop - start)[order], state[order]
        total = np.zeros(len(doc))
        active = np.searchsorted(-size, -np.arange(TAPE), side="left")  # tapes longer than each depth
        for depth in range(int(size[0]) if len(size) else 0):
            k = active[depth]
            log, state[:k] = self.step(state[:k], self.word[start[:k] + depth])
            total[:k] += log
        return np.bincount(doc[order], weights=total, minlength=len(n))


def _score(n: int, v: int, parts: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        train = docs.column("train").to_numpy()
        runs = [tokens(data, offsets) for _a, _b, data, offsets in text_chunks(docs.column("text"))]
        tok = np.concatenate([t for t, _ in runs]) if runs else np.zeros(0, np.uint64)
        at = np.append(0, np.cumsum(np.concatenate([np.diff(a) for _, a in runs]))) if runs else np.zeros(1, np.int64)
        del runs
        counts = []
        for kind, names in zip(ORDERS, grams(tok, at), strict=True):
            names, _ = counted(names, np.zeros(len(names), bool))
            # Counts came back by partition, within it by hash.
            part = _part(names, parts)
            sizes = np.bincount(part, minlength=parts)
            own = back.filter(pa.compute.equal(back.column("kind"), kind)).sort_by("part")
            got = [unpack_counts(c.as_py(), sizes[p]) for p, c in zip(own.column("part").to_pylist(), own.column("counts"), strict=True)]
            found = np.zeros(len(names), np.int64)
            found[np.argsort(part, kind="stable")] = np.concatenate(got) if got else 0
            counts.append(found)
        columns = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        if docs.num_rows:
            automaton = Automaton(tok, at, counts, n, v)
            known = automaton.word_counts[automaton.word] > 0
            columns = [np.diff(at), np.add.reduceat(known.astype(np.int64), at[:-1]), np.add.reduceat(automaton.base[automaton.word], at[:-1]), automaton.read(at)]
        arrays = [docs.column("doc_id"), pa.array(~train), pa.array(columns[0]), pa.array(columns[1]), pa.array(np.full(docs.num_rows, n)), pa.array(columns[2]), pa.array(columns[3])]
        return pa.table(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, train, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    train: a boolean column of ``docs`` that marks the rows to learn from (null: not). Tokens are words, runs of bytes other
    than space and 0x09 to 0x0D with A-Z as a-z, and one end for each text; null and empty texts are the end alone.
    base_score and score are log10 probabilities of the text under the base (words alone) and the automaton. Repeated
    rows count as often as they stand. Without training rows every word is unknown. Other columns are left aside. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.input_file_name().alias("file"), F.input_file_block_start().alias("block"))
    # A split: a share of the rows of one block of a file; where there is no file, a share of all rows.
    sizes = docs.groupBy("file", "block").agg(F.sum(F.octet_length("text")).alias("size")).agg(F.max("size").alias("largest"), F.sum("size").alias("all")).first()
    shares = max(1, -(-(sizes["largest"] or 0) // SPLIT_BYTES))
    parts = max(LEAST_PARTS, -(-(sizes["all"] or 0) // PART_BYTES))
    share = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(shares))
    docs = docs.select("doc_id", "text", "train", F.xxhash64("file", "block", share).alias("split"))
    asked = docs.select("split", "train", "text").mapInArrow(_ask(parts), _RUN)
    back = scratch.table(asked.groupBy("part", "kind").applyInPandas(_count, _BACK), "back")
    totals = back.filter(F.col("kind") == TOTALS).agg(F.sum("distinct_tokens").alias("v"), F.sum("all_tokens").alias("n")).first()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    own = back.filter(F.col("kind") != TOTALS).select("split", "kind", "part", "counts")
    return docs.groupBy("split").cogroup(own.groupBy("split")).applyInArrow(_score(totals["n"] or 0, totals["v"] or 0, parts), schema)


def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; every tenth by its id's checksum is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return score_texts(docs, ~F.coalesce(held, F.lit(False)))


SQL = None
