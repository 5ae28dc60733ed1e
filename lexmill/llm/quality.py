"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: words, word pairs, and byte trigrams with a mark. Each is scaled by the log-ratio of
its smoothed counts in the two classes, counted over all training rows by grouped aggregation. On the scaled
indicators a linear hinge-loss model is fitted by dual coordinate descent, on at most ``SAMPLE`` rows of each class (those
with the smallest hashes of their ids, the same at any partitioning). The weights mix with their mean size, as
usual for this model. A logistic curve, fitted on the margins of the sample, makes scores of margins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.bytewords import _LOWER, mix, text_chunks, word_hashes, words
from lexmill.session import Scratch, table

#: Hash buckets of features; most sampled rows of each class for the fit; features' pseudo-count; share of the fitted weights.
BUCKETS, SAMPLE, ALPHA, MIXED = 1 << 17, 4096, 1.0, 0.9
#: Features of the sample in all, four bytes each where the model is fitted.
SAMPLE_FEATURES = 1 << 26
COST, EPOCHS = 0.1, 12
THRESHOLD = 0.3
_STEP = np.uint64(0x9E3779B97F4A7C15)

_is_mark = np.ones(256, dtype=bool)
_is_mark[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("0"), ord("9") + 1), 9, 10, 11, 12, 13, 32, *range(128, 256)]] = False
_is_capital = np.zeros(256, dtype=bool)
_is_capital[ord("A") : ord("Z") + 1] = True


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document), distinct and sorted by document."""
    starts, ends, at = words(data, offsets)
    h = word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    pair = mix(h[:-1] * _STEP + h[1:]) if len(h) > 1 else h[:0]
    same = owner[:-1] == owner[1:] if len(h) > 1 else np.zeros(0, dtype=bool)
    parts = [(h, owner), (pair[same], owner[1:][same] if len(h) > 1 else owner[:0])]
    if len(data) >= 3:
        low = _LOWER[data].astype(np.uint64)
        # A trigram's letters stand for their kind only: marks and capitals matter here, words have features of their own.
        kind = np.where(_is_mark[data], low, np.where(_is_capital[data], 1, np.where(low <= 32, 2, np.where(low >= 128, 3, np.where((low >= 48) & (low < 58), 4, 5))))).astype(np.uint64)
        code = (kind[:-2] << np.uint64(16)) | (kind[1:-1] << np.uint64(8)) | kind[2:]
        doc = np.searchsorted(offsets, np.arange(len(code)), side="right") - 1
        inside = np.arange(len(code)) + 3 <= offsets[doc + 1]
        parts.append((mix(code[inside] + np.uint64(77)), doc[inside]))
    feature = np.concatenate([(p % np.uint64(BUCKETS)).astype(np.int64) for p, _ in parts])
    key = np.unique(np.concatenate([o for _, o in parts]).astype(np.int64) * BUCKETS + feature)
    return key % BUCKETS, key // BUCKETS


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's document counts by class and feature, and the numbers of documents (feature -1)."""
    total = np.zeros((2, BUCKETS), dtype=np.int64)
    rows = np.zeros(2, dtype=np.int64)
    for batch in batches:
        label = batch.column("label").to_numpy()
        rows += np.bincount(label, minlength=2)
        for a, _b, data, offsets in text_chunks(batch.column("text")):
            feature, doc = _features(data, offsets)
            for c in (0, 1):
                total[c] += np.bincount(feature[label[a + doc] == c], minlength=BUCKETS)
    used = np.flatnonzero(total.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, used).astype(np.int32)), *(pa.array(np.append(rows[c], total[c][used])) for c in (0, 1))], names=["feature", "n0", "n1"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_chunks(batch.column("text")):
            feature, doc = _features(data, offsets)
            cuts = np.searchsorted(doc, np.arange(b - a + 1))
            blobs = [feature[x:y].astype(np.int32).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(blobs, pa.binary())], names=["label", "features"])


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L1-loss linear support vector machine on rows of scaled indicators."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] / max(1.0, np.linalg.norm(scale[r])) for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            gradient = y[i] * (values[i] @ w[rows[i]] + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve of the margins, by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(p - y) @ margin + 1e-2 * a, (p - y).sum()])
        s = p * (1 - p) + 1e-9
        hess = np.array([[(s * margin * margin).sum() + 1e-2, (s * margin).sum()], [(s * margin).sum(), s.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


class Model:
    """Weights by feature, for texts' margins scaled by the norm of their ratios."""

    def __init__(self, scale: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.scale, self.weights, self.bias, self.slope, self.offset = scale, weights, bias, slope, offset

    def margins(self, feature: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        r = self.scale[feature]
        norm = np.sqrt(np.bincount(doc, weights=r * r, minlength=n))
        return np.bincount(doc, weights=r * self.weights[feature], minlength=n) / np.maximum(norm, 1.0) + self.bias

    def scores(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def train(rows: DataFrame, sample: int = SAMPLE, features: int = SAMPLE_FEATURES) -> Model:
    """A model from rows (id, text, label 0 or 1), fitted on ``sample`` rows of each class and ``features`` features at most. Without rows of both classes every score is the share of ones."""
    counts = rows.select("label", "text").mapInArrow(_class_counts, "feature int, n0 long, n1 long")
    counts = counts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # at most BUCKETS + 1 rows
    sizes = counts[counts["feature"] == -1][["n0", "n1"]].sum().to_numpy(dtype=float)
    if sizes.min() == 0:
        share = (sizes[1] + 0.5) / (sizes.sum() + 1)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    own = counts[counts["feature"] >= 0]
    n = np.zeros((2, BUCKETS))
    n[:, own["feature"].to_numpy()] = own[["n0", "n1"]].to_numpy(dtype=float).T
    p = (n + ALPHA) / (sizes[:, None] + 2 * ALPHA)
    scale = np.where(n.sum(axis=0) > 0, np.log(p[1] / p[0]), 0.0)
    order = [F.xxhash64("id"), F.xxhash64("text")]
    # The bounded sample: ``sample`` ids of each class, fewer if their features (a text has no more than bytes) pass ``features``.
    ids, room = None, Window.orderBy("h0", "h1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in (0, 1):
        mine = rows.filter(F.col("label") == c).select("id", "label", F.least(F.octet_length("text"), F.lit(BUCKETS)).cast("long").alias("size"), *[o.alias(f"h{i}") for i, o in enumerate(order)])
        mine = mine.orderBy("h0", "h1").limit(sample).withColumn("used", F.sum("size").over(room)).filter(F.col("used") <= max(features // 2, BUCKETS)).drop("size", "used")
        ids = mine if ids is None else ids.union(mine)
    keys = ids.select(F.xxhash64("id", "label").alias("key"), "h1").distinct()
    picked = rows.withColumns({"key": F.xxhash64("id", "label"), "h1": order[1]}).join(F.broadcast(keys), ["key", "h1"], "left_semi")
    # Repeated rows stand once in the sample, which so has 2 * sample rows at most; the counts above have them all.
    found = picked.dropDuplicates(["key", "h1"]).select("label", "text").mapInArrow(_sampled, "label int, features binary").toPandas()
    own = [np.frombuffer(x, np.int32) for x in found["features"]]
    label = found["label"].to_numpy(dtype=float)
    order = sorted(range(len(own)), key=lambda i: (own[i].tobytes(), label[i]))  # the same fit at any partitioning
    own, label = [own[i] for i in order], label[order]
    share = label.mean()
    cost = COST * np.where(label > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    w, bias = dual_coordinate_descent(own, scale, np.where(label > 0, 1.0, -1.0), cost)
    w = MIXED * w + (1 - MIXED) * np.abs(w).mean() * np.sign(w)
    model = Model(scale, w, bias, 1.0, 0.0)
    margin = np.array([model.margins(f.astype(np.int64), np.zeros(len(f), np.int64), 1)[0] for f in own])
    model.slope, model.offset = _curve(margin, label)
    # The sample has its own share of ones; the scores are for all rows' share.
    prior = sizes[1] / sizes.sum()
    model.offset += float(np.log(prior / (1 - prior)) - np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, train_on, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """id, score (0 to 1) and predicted (score >= 0.3) of every row of ``docs``.

    labels: the id and a label; each labelled row with label 0 or 1 whose ``docs`` row satisfies ``train_on`` is a training row,
    also repeated or contradicting ones. Other labels are left out. Null and empty texts have no features and get
    the score of the bias. Scores depend on the text alone; other columns are left aside. Empty tables give an empty
    result; without training rows of both classes all scores are one prior.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    labels = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    # Labels grow with the documents: the join is by a sort at every size.
    rows = scratch.table(docs.filter(train_on(F.col("id"))).join(labels.hint("merge"), "id"), "train")
    told = spark.sparkContext.broadcast(train(rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, offsets in text_chunks(batch.column("text")):
                out[a:b] = told.value.scores(told.value.margins(*_features(data, offsets), b - a))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], names=["id", "score", "predicted"])

    return docs.mapInArrow(score, f"id {docs.schema['id'].dataType.simpleString()}, score double, predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; every fifth by its id's checksum is held out."""
    held = lambda i: F.coalesce(F.crc32(i.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda i: ~held(i))
    return found.select(F.col("id").alias("doc_id"), held(F.col("id")).alias("held_out"), "score", "predicted")


SQL = None
