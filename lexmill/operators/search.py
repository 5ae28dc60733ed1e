"""Full-text search: a sanitised query, postings with positions, conjunctive matching, BM25 and authority."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import fold, search_tokens
from lexmill.operators.corpus import clamp
from lexmill.session import apply_settings, free_names

# BM25 and the weight of authority in the rank.
K1, B, AUTHORITY_WEIGHT = 1.2, 0.75, 2.0
SNIPPET_TOKENS = 18
#: Words before the first hit of a snippet, at most.
SNIPPET_LEAD = 4


@dataclass(frozen=True)
class Phrase:
    """Words in a row; the last may be a prefix."""

    words: tuple[str, ...]
    prefix: bool = False


def sanitise(query: str) -> list[Phrase]:
    """Quoted runs are phrases, alphanumeric runs are words, a star behind one makes a prefix; all else goes (TXT-1)."""
    out = []
    for m in re.finditer(r'"([^"]*)"?(\*?)|([^\W_]+)(\*?)', query):
        plain = "".join(c for c in unicodedata.normalize("NFD", m[1] if m[1] is not None else m[3]) if not unicodedata.combining(c))
        words = tuple(re.findall(r"[^\W_]+", plain.lower()))
        if words:
            out.append(Phrase(words, bool(m[2] or m[4])))
    return out


def _words(text: str | tuple[str, ...]) -> Column:
    """The words of one column, or of several: then with an empty word between them, which no phrase spans (TXT-3)."""
    if isinstance(text, str):
        return search_tokens(F.col(text))
    parts = [F.coalesce(search_tokens(F.col(c)), F.expr("cast(array() as array<string>)")) for c in text]
    return F.concat(parts[0], *[x for p in parts[1:] for x in (F.array(F.lit("")), p)])


def _length(words: Column, text: str | tuple[str, ...]) -> Column:
    return F.size(words) - (0 if isinstance(text, str) else len(text) - 1)


def _folded(text: str | tuple[str, ...]) -> Column:
    return fold(F.col(text)) if isinstance(text, str) else fold(F.concat_ws(" ", *text))


def fts_documents(judgments: DataFrame, blank: str = r"^(?U)\s*$") -> DataFrame:
    """id, title, text, citation of each document as search sees it (PRJ-5): paragraphs joined by blank lines, and the neutral
    citation, reported ones and case numbers in one line. judgments: also neutral_citation, reported, case_numbers."""
    paragraphs = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(blank))
    citation = F.concat_ws(" ", "neutral_citation", "reported", "case_numbers")
    return judgments.withColumns({"text": F.array_join(paragraphs, "\n\n"), "citation": citation})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of each row's words, by row and then by word."""
    for batch in batches:
        lists = batch.column("w")
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        row, code = np.repeat(np.arange(len(sizes)), sizes), words.indices.to_numpy()
        pos = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        by = np.lexsort((code, row))  # stable: of a row's word, places stand in order
        row, code, pos = row[by], code[by], pos[by]
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
        tf = np.diff(np.append(first, len(code)))
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(pos.astype(np.int32)))
        columns = [batch.column("id").take(pa.array(row[first])), words.dictionary.take(pa.array(code[first])), pa.array(sizes[row[first]].astype(np.int32)), places, pa.array(tf)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "term", "doc_length", "positions", "tf"])


def postings(docs: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """id, term, doc_length, positions, tf: one row for each word of each document (TXT-2).

    A text's words are counted where it is read, so none is shuffled; only rows whose id stands more than once meet by it.
    """
    apply_settings(docs.sparkSession)
    tokens = docs.select(F.col(id_col).alias("id"), search_tokens(F.col(text)).alias("w"))
    kind = T.StructType([docs.select(F.col(id_col).alias("id")).schema[0], *T.StructType.fromDDL("term string, doc_length int, positions array<int>, tf long").fields])
    again = docs.groupBy(F.col(id_col).alias("again")).agg(F.count("*").alias("c")).filter("c > 1").select("again")
    if again.isEmpty():
        return tokens.mapInArrow(_counted, kind)
    same = F.col("id").eqNullSafe(F.col("again"))
    once = tokens.join(again, same, "left_anti").mapInArrow(_counted, kind)
    more = tokens.join(again, same, "left_semi").mapInArrow(_counted, kind).groupBy("id", "term", "doc_length")
    return once.unionByName(more.agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"), F.sum("tf").alias("tf")))


def _hits(tokens: Column, phrase: Phrase) -> Column:
    """How often a phrase stands in an array of words (TXT-3)."""
    k = len(phrase.words)
    if k == 1:  # no places to compare
        word = phrase.words[0]
        return F.coalesce(F.size(F.filter(tokens, lambda t: t.startswith(word) if phrase.prefix else t == word)), F.lit(0))

    def here(i: Column) -> Column:
        parts = [F.get(tokens, i + j) == w for j, w in enumerate(phrase.words[:-1])]
        last = F.get(tokens, i + k - 1)
        parts.append(last.startswith(phrase.words[-1]) if phrase.prefix else last == phrase.words[-1])
        return reduce(lambda a, b: a & b, parts)

    places = F.sequence(F.lit(0), F.greatest(F.size(tokens) - k, F.lit(0)))
    return F.size(F.filter(places, lambda i: F.coalesce(here(i), F.lit(False))))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(docs: DataFrame, query: str, text: str | tuple[str, ...] = "text", where: Column | None = None) -> DataFrame:
    """``docs`` that hold every phrase (FLT-5), with ``tf`` (an array, one count for each phrase) and ``doc_length``.

    A cheap containment test on the lower-cased text runs first; words are only split where it passes.
    """
    phrases = sanitise(query)
    rows = docs if where is None else docs.filter(where)
    words = sorted({w for p in phrases for w in p.words})
    if words:
        rows = rows.filter(_bound(_folded(text), lambda low: reduce(lambda a, b: a & b, [low.contains(w) for w in words])))
    (found,) = free_names(rows.columns, "found")
    counted = _bound(_words(text), lambda w: F.struct(F.array(*[_hits(w, p) for p in phrases]).alias("tf"), _length(w, text).alias("doc_length")))
    kept = rows.withColumn(found, counted).filter(F.forall(F.col(found)["tf"], lambda x: x > 0))
    return kept.withColumns({"tf": F.col(found)["tf"], "doc_length": F.col(found)["doc_length"]}).drop(found)


def _statistics(docs: DataFrame, query: str, text: str | tuple[str, ...]) -> DataFrame:
    """One row: n_docs, mean_length, and df, for each phrase the number of documents that hold it; every text is split once."""
    phrases = sanitise(query)
    told = _bound(_words(text), lambda w: F.struct(_length(w, text).alias("n"), F.array(*[(_hits(w, p) > 0).cast("int") for p in phrases]).alias("has")))
    has = [F.coalesce(F.sum(F.col("t.has")[i]), F.lit(0)) for i in range(len(phrases))]
    return docs.select(told.alias("t")).agg(F.count("*").alias("n_docs"), F.avg(F.coalesce("t.n", F.lit(0))).alias("mean_length"), F.array(*has).alias("df"))


def bm25(docs: DataFrame, query: str, text: str | tuple[str, ...] = "text", where: Column | None = None) -> DataFrame:
    """The matching documents with ``bm25``, negative, lower is better (TXT-4). Statistics cover all of ``docs``."""
    found = matches(docs, query, text)
    rows = (found if where is None else found.filter(where)).crossJoin(F.broadcast(_statistics(docs, query, text)))  # one row
    score = F.lit(0.0)
    for i in range(len(sanitise(query))):
        tf, df = F.col("tf")[i], F.col("df")[i]
        idf = F.greatest(F.log((F.col("n_docs") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_length") / F.col("mean_length")))
    return rows.withColumn("bm25", -score).drop("n_docs", "mean_length", "df")


def search(docs: DataFrame, query: str, where: Column | None = None, limit: int | None = 20, offset: int = 0, text: str | tuple[str, ...] = "text") -> DataFrame:
    """A page of matches by relevance less twice the authority, then id (ORD-1); a query without words browses (ORD-2)."""
    if not sanitise(query):
        rows = (docs if where is None else docs.filter(where)).withColumn("bm25", F.lit(None).cast("double")).orderBy(F.desc("authority"), "id")
    else:
        rows = bm25(docs, query, text, where).orderBy(F.col("bm25") - F.lit(AUTHORITY_WEIGHT) * F.col("authority"), "id")
    return rows.offset(offset).limit(clamp(limit, 1, 100, 20))


def snippet(text: Column, query: str) -> Column:
    """Up to 18 words of a text, chosen to hold as many distinct phrases of the query as one cut can; hits are marked (TXT-5).

    Of equally good cuts it is the one whose hits end first; half the room that they leave stands before them, four words at most. Words are runs
    between white space; a text without hits is cut at its start. Hits are read once in the order of their ends, with the last
    start of each phrase so far, so the work follows the words and phrases, not pairs of hits.
    """
    phrases = sanitise(query)
    plain = F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")

    def bare(w: Column) -> Column:
        return F.regexp_replace(fold(w), r"[^\p{L}\p{N}]", "")

    def at(ws: Column, phrase: Phrase, i: Column) -> Column:
        """Whether the phrase ends at word i."""
        k = len(phrase.words)
        parts = [F.get(ws, i - (k - 1 - j)) == w for j, w in enumerate(phrase.words[:-1])]
        last = F.get(ws, i)
        parts.append(last.startswith(phrase.words[-1]) if phrase.prefix else last == phrase.words[-1])
        return F.coalesce((i >= k - 1) & reduce(lambda a, b: a & b, parts), F.lit(False))

    kind = "struct<last:array<int>,hits:int,start:int,stop:int,i:int>"
    begin = F.expr(f"cast(named_struct('last', array_repeat(-1, {max(len(phrases), 1)}), 'hits', 0, 'start', 0, 'stop', 0, 'i', 0) as {kind})")

    def step(s: Column, ends: Column) -> Column:
        i = s["i"]
        last = F.array(*[F.when(ends[j], i - (len(p.words) - 1)).otherwise(s["last"][j]) for j, p in enumerate(phrases)])

        def judged(last: Column) -> Column:
            inside = F.filter(last, lambda x: (x >= 0) & (x > i - SNIPPET_TOKENS))
            better = F.exists(ends, lambda x: x) & (F.size(inside) > s["hits"])
            return F.struct(
                last.alias("last"), F.when(better, F.size(inside)).otherwise(s["hits"]).alias("hits"), F.when(better, F.array_min(inside)).otherwise(s["start"]).alias("start"),
                F.when(better, i).otherwise(s["stop"]).alias("stop"), (i + 1).alias("i"),
            ).cast(kind)

        return F.get(F.transform(F.array(last), judged), F.lit(0))

    def cut(ws: Column) -> Column:
        def shown(x: Column) -> Column:
            """x: the bare words and, for each, which phrases end there."""
            def window(best: Column) -> Column:
                room = F.greatest(F.lit(SNIPPET_TOKENS) - (best["stop"] - best["start"] + 1), F.lit(0))
                start = F.greatest(F.least(best["start"] - F.least(F.floor(room / 2).cast("int"), F.lit(SNIPPET_LEAD)), F.size(ws) - SNIPPET_TOKENS), F.lit(0))

                def word(w: Column, j: Column) -> Column:
                    i = start + j
                    ends_by = lambda n: lambda e: e[n]
                    covered = [F.coalesce(F.exists(F.slice(x["ends"], i + 1, len(p.words)), ends_by(n)), F.lit(False)) for n, p in enumerate(phrases)]
                    return F.when(reduce(lambda a, b: a | b, covered), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)

                marked = F.transform(F.slice(ws, start + 1, SNIPPET_TOKENS), word)
                return F.concat(F.when(start > 0, "…").otherwise(""), F.array_join(marked, " "), F.when(F.size(ws) > start + SNIPPET_TOKENS, "…").otherwise(""))

            return F.get(F.transform(F.array(F.aggregate(x["ends"], begin, step)), window), F.lit(0))

        own = F.transform(ws, bare)
        ends = F.get(F.transform(F.array(own), lambda b: F.transform(b, lambda w, i: F.array(*[at(b, p, i) for p in phrases]))), F.lit(0))
        return F.get(F.transform(F.array(F.struct(ends.alias("ends"))), shown), F.lit(0))

    if not phrases:
        return F.array_join(F.slice(plain, 1, SNIPPET_TOKENS), " ")
    return F.get(F.transform(F.array(plain), cut), F.lit(0))
