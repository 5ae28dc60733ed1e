"""Long repeats by a logarithmic family of suffix arrays.

Documents come in batches. A batch's suffix array holds its sampled suffixes (anchors.py: every window of
``length`` bytes contains the start of one, at a place that depends on the window alone) by their first K bytes, in parts
by a hash of these and in order within a part. It is merge-scanned against the array of every existing level, part by part, as
both lie: suffixes that agree in K bytes, of which one is new, are places where a long match can be. The new array then
becomes a level, and levels of one size merge pairwise into the next size, so a suffix is rewritten a logarithmic number
of times. A scan reads every level, so the number of batches grows with the logarithm of the input: the scans of n
batches read the input n / 2 times.

The matches are settled exactly, whatever the number of copies:

* The context of a sampled suffix is everything its run of windows covers. Contexts are collapsed by a 128-bit
  digest; where a context occurs twice or more, its whole run repeats.
* A context that occurs once can still share some of its windows with other contexts of that suffix. Its windows
  are cut into blocks of 16 by their distance from the anchor. The bytes common to a block's windows are
  digested, and only blocks with one digest meet; they differ in at most 15 bytes at each end, which decide each
  of the 16 windows. Groups of one digest larger than ``group_rows`` are settled by a shuffle of single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.anchors import K, anchor_runs
from lexmill.llm.bytewords import mix, text_chunks
from lexmill.session import Scratch, free_names, shuffle_partitions, table

LENGTH = 400
#: Join keys of one suffix: contexts of a suffix that very many texts hold are dealt to so many tasks.
SALTS = 16
#: Windows of a block.
BLOCK = 16
#: Larger groups of one block digest go through the shuffle of single windows.
GROUP_ROWS = 20_000

_ENTRY = "k1 long, k2 int, pos int, lo int, hi int, suffix binary, context binary"
_ENTRY_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("suffix", pa.binary()), ("context", pa.binary())])
_BLOCK = "digest binary, k1 long, k2 int, pos int, u int, low int, high int, once boolean, left binary, right binary"
_BLOCK_ARROW = pa.schema([("digest", pa.binary()), ("k1", pa.int64()), ("k2", pa.int32()), ("pos", pa.int32()), ("u", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("once", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])
_MARK = "k1 long, k2 int, start int, stop int"


def _entries(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for a, _b, data, offsets in text_chunks(batch.column("text")):
                owner, anchor, lo, hi = anchor_runs(data, offsets, length)
                if not len(owner):
                    continue
                raw, base = data.tobytes(), offsets[owner]
                suffix = [raw[x : x + K] for x in anchor.tolist()]
                digest = hashlib.blake2b
                context = [digest(raw[p : q + length], digest_size=16, salt=(x - p).to_bytes(4, "little")).digest() for x, p, q in zip(anchor.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[a + owner]), pa.array(k2[a + owner]), *(pa.array((v - base).astype(np.int32)) for v in (anchor, lo, hi)), pa.array(suffix, pa.binary()), pa.array(context, pa.binary())],
                    schema=_ENTRY_ARROW,
                )

    return run


def _blocks(length: int):
    """The blocks of the wanted runs of each document."""
    common = length - BLOCK + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                raw = (batch.column("text")[i].as_py() or "").encode()
                k1, k2 = batch.column("k1")[i].as_py(), batch.column("k2")[i].as_py()
                for want in batch.column("wants")[i].as_py():
                    a, lo, hi, once = want["pos"], want["lo"], want["hi"], want["once"]
                    for u in range((a - hi) // BLOCK, (a - lo) // BLOCK + 1):
                        at = a - BLOCK * u  # the first byte that all windows of the block hold
                        low, high = max(0, a - hi - BLOCK * u), min(BLOCK - 1, a - lo - BLOCK * u)
                        key = hashlib.blake2b(raw[at : at + common], digest_size=16, salt=u.to_bytes(4, "little")).digest()
                        rows.append((key, k1, k2, a, u, low, high, once, raw[max(0, at - BLOCK + 1) : at], raw[at + common : at + length]))
                if len(rows) > 20_000:
                    yield _block_batch(rows)
                    rows = []
        if rows:
            yield _block_batch(rows)

    return run


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCK_ARROW, strict=True)], schema=_BLOCK_ARROW)


def _edges(values: list[bytes], from_end: bool) -> np.ndarray:
    """Hashes of the first 0..15 bytes of each value (of the last ones, if ``from_end``)."""
    width = BLOCK - 1
    flat = b"".join(v.rjust(width, b"\0") if from_end else v.ljust(width, b"\0") for v in values)
    grid = np.frombuffer(flat, dtype=np.uint8).reshape(len(values), width).astype(np.uint64)
    if from_end:
        grid = grid[:, ::-1]
    out = np.zeros((len(values), BLOCK), dtype=np.uint64)
    for j in range(width):
        out[:, j + 1] = mix(out[:, j] + grid[:, j] + np.uint64(0x9E3779B97F4A7C15))
    return out


def _windows(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, valid), one column for each of a block's windows; equal keys in a group are equal windows."""
    left, right = _edges(frame["left"].tolist(), True), _edges(frame["right"].tolist(), False)
    e = np.arange(BLOCK)
    keys = mix(left * np.uint64(0x9E3779B97F4A7C15) + right[:, ::-1] + e.astype(np.uint64))
    return keys, (e >= frame["low"].to_numpy()[:, None]) & (e <= frame["high"].to_numpy()[:, None])


def _settle(length: int):
    """Marks from rows sorted by digest; a group that is cut by the end of a batch waits for the next."""

    def groups(frame: pd.DataFrame) -> pd.DataFrame:
        code = pd.factorize(pd.Series(frame["digest"].to_numpy()))[0].astype(np.uint64)
        sizes = np.bincount(code.astype(np.int64))
        frame, code = frame[sizes[code.astype(np.int64)] > 1], code[sizes[code.astype(np.int64)] > 1]
        if not len(frame):
            return pd.DataFrame({"k1": [], "k2": [], "start": [], "stop": []})
        keys, valid = _windows(frame)
        keys = mix(keys + code[:, None] * np.uint64(0xD1B54A32D192ED03))
        _, inverse, counts = np.unique(keys[valid], return_inverse=True, return_counts=True)
        again = np.zeros(keys.shape, dtype=bool)
        again[valid] = counts[inverse] > 1
        hit = again.any(axis=1) & frame["once"].to_numpy(dtype=bool)
        low = again.argmax(axis=1)[hit]
        high = BLOCK - 1 - again[:, ::-1].argmax(axis=1)[hit]
        mine = frame[hit]
        at = (mine["pos"] - BLOCK * mine["u"]).to_numpy()
        return pd.DataFrame({"k1": mine["k1"].to_numpy(), "k2": mine["k2"].to_numpy(), "start": (at - high).astype(np.int32), "stop": (at - low + length).astype(np.int32)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            last = frame["digest"].iloc[-1]
            own = (frame["digest"] == last).to_numpy()
            if own.all() and held and held[-1]["digest"].iloc[-1] == last:
                held.append(frame)
                continue
            yield groups(pd.concat([*held, frame[~own]], ignore_index=True))
            held = [frame[own]]
        if held:
            yield groups(pd.concat(held, ignore_index=True))

    return run


def _single_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keys, valid = _windows(frame)
        row, e = np.nonzero(valid)
        out = frame.iloc[row][["digest", "k1", "k2", "pos", "u", "once"]].reset_index(drop=True)
        out["window"], out["e"] = keys[row, e].view(np.int64), e.astype(np.int32)
        yield out


def suffix_entries(docs: DataFrame, length: int) -> DataFrame:
    """The sampled suffixes of ``docs`` (k1, k2, text)."""
    return docs.select("k1", "k2", "text").mapInArrow(_entries(length), _ENTRY)


def batch_count(size: int) -> int:
    """Batches for ``size`` bytes of text: one up to 32 MB, and one more for each doubling."""
    return max(1, size.bit_length() - 25)


class SuffixFamily:
    """Sorted arrays of suffixes (first K bytes, and how many suffixes begin with them), of sizes that double.

    An array lies in a fixed number of parts, by a hash of the suffix, each sorted. So a new batch and a level are scanned
    side by side, part by part, as they lie: a merge join without a shuffle or a sort.
    """

    def __init__(self, scratch: Scratch, parts: int):
        self.scratch, self.parts = scratch, parts
        self.levels: list[tuple[int, DataFrame]] = []  # (batches that it holds, its table), larger ones first

    def _written(self, counted: DataFrame, tag: str) -> DataFrame:
        return self.scratch.bucketed(counted.repartition(self.parts, "suffix"), tag, "suffix", self.parts)

    def add(self, suffixes: DataFrame) -> DataFrame:
        """The suffixes of a new batch that stand twice in it or in a level too; the batch is a level from now on."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:  # equal levels merge
            (n, one), (_, two) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, self._written(one.union(two).groupBy("suffix").agg(F.sum("n").alias("n")), f"level{2 * n}")))
        new = self._written(suffixes.groupBy("suffix").agg(F.count("*").alias("n")), "batch")
        hits = new.filter("n > 1").select("suffix")
        for _, level in self.levels:
            hits = hits.union(new.select("suffix").hint("merge").join(level.select("suffix").hint("merge"), "suffix", "left_semi"))
        self.levels.append((1, new))
        return self.scratch.table(hits, "hits")


def repeated_suffixes(entries: DataFrame, scratch: Scratch, batches: int) -> DataFrame:
    """The K-byte suffix starts that occur more than once, through the family of arrays."""
    family, every = SuffixFamily(scratch, shuffle_partitions(entries.sparkSession)), None
    for b in range(batches):
        hits = family.add(entries.filter(F.col("batch") == b).select("suffix"))
        every = hits if every is None else every.union(hits)
    found = scratch.table(every.distinct(), "repeated")
    scratch.forget()
    return found


def repeat_marks(docs: DataFrame, scratch: Scratch, length: int = LENGTH, batches: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """k1, k2, start, stop: byte ranges of ``docs`` (k1, k2, text) that repeated windows cover; ranges can overlap."""
    batches = batches or batch_count(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    entries = suffix_entries(docs, length).withColumn("batch", F.pmod("k1", F.lit(batches)).cast("int"))
    entries = scratch.read(scratch.write(entries, "entries", partition_by=["batch"]), entries.schema)
    hits = repeated_suffixes(entries, scratch, batches)
    # Sampled suffixes that a long match can hold, and their distinct contexts.
    held = scratch.table(
        entries.join(hits, "suffix", "left_semi").select("k1", "k2", "pos", "lo", "hi", F.xxhash64("suffix").alias("gram"), "context"), "held"
    )
    contexts = scratch.table(
        held.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos", "lo", "hi")).alias("at")), "contexts"
    )
    whole = held.join(contexts.filter("n > 1").select("gram", "context"), ["gram", "context"], "left_semi").select("k1", "k2", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))
    open_grams = contexts.groupBy("gram").agg(F.count("*").alias("c"), F.min("n").alias("least")).filter("c > 1 and least = 1").select("gram")
    salted = contexts.withColumn("salt", F.pmod(F.xxhash64("context"), F.lit(SALTS)).cast("int"))
    every_salt = open_grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    wanted = (
        salted.join(every_salt, ["gram", "salt"], "left_semi").select("at.*", (F.col("n") == 1).alias("once"))
        .groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "lo", "hi", "once")).alias("wants"))
    )
    wanted = scratch.table(wanted, "wanted")
    # A row that is repeated as a whole stands once here: its contexts have n > 1, and their windows are alike.
    own = docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"])
    blocks = scratch.table(own.mapInArrow(_blocks(length), _BLOCK), "blocks")
    sizes = blocks.groupBy("digest").agg(F.count("*").alias("c")).filter("c > 1")
    sizes = scratch.table(sizes, "sizes")
    small = blocks.join(sizes.filter(F.col("c") <= group_rows).select("digest"), "digest", "left_semi")
    settled = small.repartition("digest").sortWithinPartitions("digest").mapInPandas(_settle(length), _MARK)
    large = blocks.join(sizes.filter(F.col("c") > group_rows).select("digest"), "digest", "left_semi")
    single = large.mapInPandas(_single_windows, "digest binary, k1 long, k2 int, pos int, u int, once boolean, window long, e int")
    single = scratch.table(single, "single")
    again = single.groupBy("digest", "e", "window").agg(F.count("*").alias("c")).filter("c > 1").select("digest", "e", "window")
    at = F.col("pos") - BLOCK * F.col("u") - F.col("e")
    more = single.filter("once").join(again, ["digest", "e", "window"], "left_semi").select("k1", "k2", at.cast("int").alias("start"), (at + length).cast("int").alias("stop"))
    # Rows that are repeated as a whole have the same marks.
    return scratch.table(whole.union(settled).union(more).distinct(), "marks")


def _merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union; touching ranges are one run."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), stops[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def long_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, batches: int | None = None, group_rows: int = GROUP_ROWS, spans: str = "spans") -> DataFrame:
    """``docs`` with ``spans``: the byte ranges (start, stop) of the text, as UTF-8, that longer repeats cover.

    A byte is covered if some string of ``length`` bytes over it also starts at another place, in the same or in
    another document (overlapping places count); spans are the maximal runs. Null and short texts have none. Rows
    with the same id and text are documents of their own, so each covers the other. Null ids are ids like others.
    Other columns stay; one of the name ``spans`` is replaced. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = docs.drop(spans)
    k1, k2, own = free_names([*docs.columns, spans], "k1", "k2", "own")
    keys = {k1: F.xxhash64(id_col, text), k2: F.hash(text, id_col)}
    marks = repeat_marks(docs.select(keys[k1].alias("k1"), keys[k2].alias("k2"), F.coalesce(F.col(text), F.lit("")).alias("text")), scratch, length, batches, group_rows)
    ranges = marks.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def merged(ranges: pd.Series) -> pd.Series:
        return ranges.map(lambda found: [{"start": a, "stop": b} for a, b in _merged(np.array([x["start"] for x in found]), np.array([x["stop"] for x in found]))])

    ranges = ranges.select(F.col("k1").alias(k1), F.col("k2").alias(k2), merged("ranges").alias(own))
    none = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    found = docs.withColumns(keys).join(ranges, [k1, k2], "left")
    return found.withColumn(spans, F.coalesce(own, none)).drop(k1, k2, own)


def _kept(raw: bytes, spans) -> bytes:
    parts, at = [], 0
    for span in spans:
        parts.append(raw[at : span["start"]])
        at = span["stop"]
    return b"".join([*parts, raw[at:]])


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``docs`` whose texts have lost their long repeats; null texts stay null.

    A span's end inside a character moves so that the character stays whole: it is kept. Other columns stay as they
    are, whatever their names.
    """

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(value, found):
            if value is None or not len(found):
                return value
            raw, whole = value.encode(), []
            for span in found:
                a, b = span["start"], span["stop"]
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                whole.append({"start": a, "stop": b})
            return _kept(raw, whole).decode()

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    (found,) = free_names(docs.columns, "found")
    return long_repeats(docs, text, id_col, length, spans=found).withColumn(text, kept(text, found)).select(docs.columns)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the repeats of 400 bytes leave of every document; n_kept and n_chars are its bytes and characters then."""
    found = long_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw, spans = (value.as_py() or "").encode(), spans.as_py()
                kept = _kept(raw, spans)
                chars = len(kept) - int(np.count_nonzero(np.frombuffer(kept, np.uint8) & 0xC0 == 0x80))
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(kept), chars))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "n_chars"])

    return found.select("doc_id", "text", "spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, n_chars long")


SQL = None
