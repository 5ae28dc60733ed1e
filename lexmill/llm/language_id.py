"""Language identification by Bayesian fusion of evidence.

Four sources speak for a language: the text (byte trigrams), the language that the markup or the record declares,
the suffix of the address, and the host. Each has a likelihood or prior learned by grouped counts over the whole
table:

* text: multinomial log-likelihoods of hashed byte trigrams, from rows whose declared language is a target. Trigrams
  of one text are far from independent, so their sum is tempered: it counts as at most ``TEXT_WEIGHT`` trigrams.
* declared language and suffix: smoothed P(value | language), counted against what the texts alone say.
* host: P(language | host), smoothed towards its parent domain, that towards its suffix, that towards all rows.

The models are tables of bounded size (languages times hash buckets), but for the host priors, which are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.bytewords import _LOWER, text_chunks
from lexmill.session import Scratch, table

LANGUAGES = ("en", "fr", "de", "es")
BUCKETS = 1 << 14
#: Trigrams that a text speaks with at most; pseudo-counts of a trigram, of a declared value and of a parent prior.
TEXT_WEIGHT, TRIGRAM_PRIOR, VALUE_PRIOR, HOST_PRIOR = 40.0, 0.5, 1.0, 20.0
#: A row is kept if its best language has this posterior, and its text at least one letter.
LEAST_POSTERIOR = 0.5
#: Hosts whose priors are broadcast; those of more hosts are joined by a sort.
BROADCAST_HOSTS = 50_000

_is_letter = np.zeros(256, dtype=bool)
_is_letter[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0xC3, 0x100)]] = True


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document) of each trigram of bytes that holds a letter and lies in one document, and letters by document."""
    letters = np.add.reduceat(np.append(_is_letter[data], False), np.minimum(offsets[:-1], len(data))) * (np.diff(offsets) > 0)
    if len(data) < 3:
        none = np.zeros(0, dtype=np.int64)
        return none, none, letters
    low = _LOWER[data].astype(np.uint32)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    letter = _is_letter[data]
    ok = letter[1:-1] & (letter[:-2] | letter[2:])
    cut = offsets[1:-1]
    for edge in (cut - 1, cut - 2):
        edge = edge[(edge >= 0) & (edge < len(ok))]
        ok[edge] = False
    at = np.flatnonzero(ok)
    return bucket[at], np.searchsorted(offsets, at, side="right") - 1, letters


def _count_trigrams(languages: tuple[str, ...]):
    """This task's counts, a row for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        at = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            own = np.array([at.get(x, -1) for x in batch.column("declared").to_pylist()])
            for a, b, data, offsets in text_chunks(batch.column("text")):
                bucket, doc, _ = _trigrams(data, offsets)
                which = own[a:b][doc]
                for i in range(len(languages)):
                    total[i] += np.bincount(bucket[which == i], minlength=BUCKETS)
        for i, language in enumerate(languages):
            used = np.flatnonzero(total[i])
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[i][used])], names=["language", "bucket", "n"])

    return run


def _speak(told, languages: tuple[str, ...], keep: list[str]):
    """Adds the tempered log-likelihoods of the text and its number of letters to the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value  # bucket x language
        for batch in batches:
            out, letters = np.zeros((batch.num_rows, len(languages))), np.zeros(batch.num_rows, dtype=np.int64)
            for a, b, data, offsets in text_chunks(batch.column("text")):
                bucket, doc, found = _trigrams(data, offsets)
                letters[a:b] = found
                n = np.bincount(doc, minlength=b - a)
                for i in range(len(languages)):
                    out[a:b, i] = np.bincount(doc, weights=model[bucket, i], minlength=b - a)
                out[a:b] *= (np.minimum(n, TEXT_WEIGHT) / np.maximum(n, 1))[:, None]
            scores = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(languages), dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores, pa.array(letters)], names=[*keep, "__text", "__letters"])

    return run


def _shares(counts: DataFrame, by: list[str], parent: DataFrame | None, parent_by: list[str], languages: tuple[str, ...]) -> DataFrame:
    """``by`` and p: counts of languages smoothed towards the parent's shares."""
    n = [F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(len(languages))]
    own = counts.groupBy(*by, *[c for c in parent_by if c not in by]).agg(*n) if by or parent_by else counts.agg(*n)
    total = sum((F.coalesce(F.col(f"n{i}"), F.lit(0.0)) for i in range(len(languages))), F.lit(0.0))
    if parent is None:
        return own.select(*by, F.array(*[(F.coalesce(F.col(f"n{i}"), F.lit(0.0)) + 1) / (total + len(languages)) for i in range(len(languages))]).alias("p"))
    own = own.join(parent.withColumnRenamed("p", "up"), parent_by) if parent_by else own.crossJoin(parent.withColumnRenamed("p", "up"))
    return own.select(*by, F.array(*[(F.col(f"n{i}") + HOST_PRIOR * F.col("up")[i]) / (total + HOST_PRIOR) for i in range(len(languages))]).alias("p"))


def _value_likelihood(rows: DataFrame, value: str, languages: tuple[str, ...], name: str) -> DataFrame:
    """value and log P(value | language), add-one smoothed over the values met."""
    counts = rows.groupBy(value).agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(len(languages))])
    totals = counts.agg(F.count("*").alias("values"), *[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(languages))])
    smoothed = [F.log((F.col(f"n{i}") + VALUE_PRIOR) / (F.col(f"t{i}") + VALUE_PRIOR * F.col("values"))) for i in range(len(languages))]
    return counts.crossJoin(F.broadcast(totals)).select(value, F.array(*smoothed).alias(name))  # totals: one row


def identify(rows: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source", suffix: str | None = None, languages: tuple[str, ...] = LANGUAGES, carry: list[str] | None = None) -> DataFrame:
    """``rows`` (or their columns ``carry``) with language, posterior and kept.

    declared, host and suffix name string columns, or None where a table has none. Missing values (null, and
    declared languages that are no target) are values of their own and are learned like others. A text without letters (null, empty,
    digits only) says nothing: its language is null and it is not kept, whatever is declared. Other rows are kept if the best
    language has a posterior of at least 0.5; ties go to the language named first. Repeated rows are judged alike;
    columns named language, posterior or kept are replaced, other columns stay. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "language")
    rows = rows.drop("language", "posterior", "kept")
    named = rows.columns if carry is None else carry
    # The table's own columns go under numbers, so that no name of theirs meets one from here.
    number = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    rows = rows.toDF(*number.values())
    columns, text, declared, host, suffix = [number[c] for c in named], number[text], number.get(declared), number.get(host), number.get(suffix)
    value = lambda c: F.lower(F.trim(F.col(c).cast("string"))) if c else F.lit(None).cast("string")
    host_c = F.coalesce(value(host), F.lit(""))
    # A parent drops the first label; a host of one label is its own suffix.
    labels = F.split(host_c, "[.]")
    parent_c = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, 2, F.size(labels)), ".")).otherwise(host_c)
    suffix_c = F.coalesce(value(suffix), F.element_at(labels, -1))
    marked = rows.withColumns({"__declared": F.coalesce(F.when(value(declared).isin(*languages), value(declared)), F.lit("")), "__host": host_c, "__parent": parent_c, "__suffix": suffix_c})
    seen = marked.select(F.col("__declared").alias("declared"), F.col(text).alias("text"))
    counted = seen.filter("declared <> ''").mapInArrow(_count_trigrams(languages), "language string, bucket int, n long")
    found = counted.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages x buckets rows
    model = np.full((BUCKETS, len(languages)), TRIGRAM_PRIOR)
    for i, language in enumerate(languages):
        own = found[found["language"] == language]
        model[own["bucket"].to_numpy(np.int64), i] += own["n"].to_numpy(np.float64)
    told = spark.sparkContext.broadcast(np.log(model / model.sum(axis=0)))

    def spoken(df: DataFrame, keep: list[str]) -> DataFrame:
        taken = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
        names = [f"k{i}" for i in range(len(keep))]
        schema = ", ".join([*(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), "__text array<double>", "__letters long"])
        return taken.mapInArrow(lambda it: _speak(told, languages, names)(it), schema).withColumnsRenamed(dict(zip(names, keep, strict=True)))

    def posteriors(logs: Column) -> Column:
        top = F.array_max(logs)
        raw = F.transform(logs, lambda x: F.exp(x - top))
        total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
        return F.transform(raw, lambda x: x / total)

    # What the texts alone say, counted by the other evidence.
    keys = ["__declared", "__host", "__parent", "__suffix"]
    said = spoken(marked, keys).filter("__letters > 0").withColumn("n", posteriors(F.col("__text")))
    said = said.groupBy(*keys).agg(F.array(*[F.sum(F.col("n")[i]) for i in range(len(languages))]).alias("n"))
    said = scratch.table(said, "said")
    whole = _shares(said, [], None, [], languages)
    # The suffix speaks once, as the topmost level of the hosts' priors, and by itself where no host is named.
    by_suffix = _shares(said, ["__suffix"], whole, [], languages)
    by_parent = _shares(said, ["__parent"], by_suffix, ["__suffix"], languages) if host else None
    prior = _shares(said, ["__host"], by_parent, ["__parent"], languages) if host else None
    # One value for each language and one for all others.
    declared_l = F.broadcast(_value_likelihood(said, "__declared", languages, "__declared_l"))
    few = F.broadcast if host and said.select("__host").distinct().count() <= BROADCAST_HOSTS else lambda df: df
    out = spoken(marked, [*columns, "__declared", "__host", "__suffix"])
    if host:
        out = out.join(few(prior.select("__host", F.col("p").alias("__prior"))), "__host", "left")
    elif suffix:
        few = F.broadcast if by_suffix.count() <= BROADCAST_HOSTS else few
        out = out.join(few(by_suffix.select("__suffix", F.col("p").alias("__prior"))), "__suffix", "left")
    else:
        out = out.crossJoin(F.broadcast(whole.select(F.col("p").alias("__prior"))))  # one row
    out = out.join(declared_l, "__declared", "left")
    parts = [F.col("__text"), F.transform(F.coalesce("__prior", F.array(*[F.lit(1.0)] * len(languages))), lambda p: F.log(p)), F.coalesce("__declared_l", F.array(*[F.lit(0.0)] * len(languages)))]
    logs = F.array(*[sum((p[i] for p in parts[1:]), parts[0][i]) for i in range(len(languages))])
    out = out.withColumn("__p", posteriors(logs))
    best = F.array_max("__p")
    names = F.array(*[F.lit(x) for x in languages])
    silent = F.col("__letters") == 0
    language = F.when(~silent, F.element_at(names, F.array_position("__p", best).cast("int")))
    posterior = F.when(~silent, best).otherwise(F.lit(0.0))
    return out.withColumns({"language": language, "posterior": posterior, "kept": ~silent & (best >= LEAST_POSTERIOR)}).select(*[F.col(number[c]).alias(c) for c in named], "language", "posterior", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language: its text, the declared ``lang``, and its ``source`` as host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return identify(docs, carry=["doc_id"]).select("doc_id", "language", "posterior", "kept")


def op4_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's language: its visible text, the markup's ``lang``, the address's suffix and its host."""
    html = F.col("html")
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1))
    pages = table(spark, sf_dir, "pages").select(
        "page_id", body.alias("text"), F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang=["']?([A-Za-z]+)""", 1).alias("declared"),
        host.alias("host"), F.element_at(F.split(host, "[.]"), -1).alias("suffix"),
    )
    return identify(pages, declared="declared", host="host", suffix="suffix", carry=["page_id"]).select("page_id", "language", "posterior", "kept")


SQL = None
