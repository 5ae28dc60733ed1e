"""Fill-in-the-middle transformation over an indexable skip list.

A text is cut into units (white space and the word behind it, or white space at the end). The units of one text are the
nodes of a skip list: a node's height follows from its place, each lane holds the nodes that are high enough, and every
link carries its width in units and in code points. To find where the first ``r`` units end, a walk starts on the
fastest lane and takes each link that doesn't pass ``r``, adding both widths, then goes a lane down; on the lowest lane
it stands behind exactly ``r`` units, and the added code points are the place of the cut.

Which texts are rearranged, how, and where they are cut follows from a digest of the document's id alone, so that a task
that runs again gives the same rows. The output of a rearranged text holds each marker once, hence its form and itself
give the text back (``restored``, a column expression).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.bytewords import mix, text_chunks, words
from lexmill.session import SETTINGS, free_names, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A node is in the next lane for one of so many places.
FANOUT = 8
ADDED = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


class SkipList:
    """Units of a text by their widths in code points."""

    def __init__(self, widths: np.ndarray):
        """One link for each unit on the lowest lane; a lane's link i leads to its tower i."""
        n = len(widths)
        places = np.arange(1, n + 1, dtype=np.int64)  # units up to each tower
        chars = np.cumsum(widths)
        draws = mix(places.astype(np.uint64))
        towers, below = np.arange(n), None
        #: (units, code points, link of the lane below that leaves the same tower) of each link, slowest lane first
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            units, points = np.diff(places[towers], prepend=0), np.diff(chars[towers], prepend=0)
            down = np.zeros(len(towers) + 1, dtype=np.int64)
            down[1:] = np.arange(1, len(towers) + 1) if below is None else below + 1
            self.lanes.append((units, points, down))
            below = np.flatnonzero(draws[towers] % np.uint64(FANOUT) == 0)
            if not len(below):
                break
            towers, draws = towers[below], draws // np.uint64(FANOUT)  # one digit of a node's draw for each lane

    def seek(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        link = units = points = 0
        for own_units, own_points, down in reversed(self.lanes):
            while link < len(own_units) and units + own_units[link] <= rank:
                units += int(own_units[link])
                points += int(own_points[link])
                link += 1
            link = int(down[link])
        if units != rank:
            raise IndexError(rank)
        return points


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends of the units in code points of their text, unit offsets by text, code points of each text) of UTF-8 texts."""
    _, ends, by_text = words(data, offsets)
    counts = np.diff(by_text)
    last = np.full(len(counts), -1, dtype=np.int64)
    last[counts > 0] = ends[by_text[1:][counts > 0] - 1]
    tail = offsets[1:] > np.maximum(last, offsets[:-1])  # white space behind the last word
    unit_offsets = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(counts + tail, out=unit_offsets[1:])
    out = np.empty(int(unit_offsets[-1]), dtype=np.int64)
    closing = np.zeros(len(out), dtype=bool)
    closing[unit_offsets[1:][tail] - 1] = True
    out[closing], out[~closing] = offsets[1:][tail], ends
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    starts = points[offsets[:-1]]
    return points[out] - np.repeat(starts, np.diff(unit_offsets)), unit_offsets, points[offsets[1:]] - starts


def _rearranged(text: str, form: str, a: int, b: int) -> str:
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def _transform(text_col: str, draws: str, rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            drawn = batch.column(draws).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            for first, last, data, offsets in text_chunks(texts):
                ends, unit_offsets, _ = unit_ends(data, offsets)
                rows = []
                for i in range(first, last):
                    own = ends[unit_offsets[i - first] : unit_offsets[i - first + 1]]
                    n, (h1, h2, h3, h4) = len(own), drawn[i].tolist()
                    text = texts[i].as_py() or ""
                    if not n or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                        rows.append((n, "plain", None, None, text))
                        continue
                    form = "spm" if h4 % 100 < spm_rate else "psm"
                    units = SkipList(np.diff(own, prepend=0))
                    a, b = map(units.seek, sorted((h1 % (n + 1), h2 % (n + 1))))
                    rows.append((n, form, a, b - a, _rearranged(text, form, a, b)))
                kept = batch.slice(first, last - first).drop_columns([draws])
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, *ADDED])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    ``rate`` of a hundred texts are rearranged, ``spm_rate`` of a hundred of those with the suffix first; the draws are
    groups of the SHA-256 of ``<seed>:<id>``, with nothing behind the colon for a null id. Null texts are empty. Empty texts
    and texts that hold a marker stay plain, their output is the text. Repeated rows have equal results. Columns of ``docs``
    with the names of results are replaced, others stay whatever their names. An empty table gives an empty result.
    """
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        docs.sparkSession.conf.set(key, SETTINGS[key])
    docs = docs.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    stay = [c for c in docs.columns if c.lower() not in ADDED or c in (id_col, text_col)]
    if {id_col.lower(), text_col.lower()} & set(ADDED):
        raise ValueError("the id or text column has the name of a result")
    (draws,) = free_names([*docs.columns, *ADDED], "draws")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    four = F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))
    source = docs.select(*(F.col(f"`{c}`") for c in stay), four.alias(draws))
    schema = T.StructType([*source.drop(draws).schema.fields, *(T.StructField(c, k) for c, k in ADDED.items())])
    return source.mapInArrow(_transform(text_col, draws, rate, spm_rate), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: a rearranged one holds each marker once, at the borders of its parts."""
    parts = lambda marks: F.split(F.substring(output, len(PREFIX) + 1, 1 << 30), marks)
    psm, spm = parts(f"{SUFFIX}|{MIDDLE}"), parts(f"{PREFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, half of them rearranged, four of five of those with the suffix first."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), h AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    list_transform(range(0, 4), lambda k: CAST('0x' || substr(digest, 8 * k + 1, 8) AS BIGINT)) AS h
  FROM d
), c AS (
  SELECT doc_id, text, units, len(units) AS n,
    least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
      WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
