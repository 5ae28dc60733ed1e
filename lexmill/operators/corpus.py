"""The corpus's tables: latest versions, citation keys, links, counts, provenance and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import tasks_for


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order`` (SNK-1, SNK-2, SNK-4): partial aggregates, no window."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in [*order, *rest]]).select(rows.columns)


def key_owners(claims: DataFrame) -> DataFrame:
    """citation_key and doc_id: the smallest claiming document owns a key (SNK-3, AGG-11)."""
    return claims.groupBy("citation_key").agg(F.min("doc_id").alias("doc_id"))


def link(citations: DataFrame, owners: DataFrame) -> DataFrame:
    """``citations`` with ``to_doc``, the owner of their key, null while nobody claims it (JN-3)."""
    return citations.drop("to_doc").join(owners.withColumnRenamed("doc_id", "to_doc"), "citation_key", "left")


def relink(citations: DataFrame, owners: DataFrame) -> DataFrame:
    """``citations`` with the present owner, and ``changed`` where it differs, nulls included (SNK-5, JN-4)."""
    now = citations.withColumnRenamed("to_doc", "old_doc").join(owners.withColumnRenamed("doc_id", "to_doc"), "citation_key", "left")
    return now.withColumn("changed", ~F.col("old_doc").eqNullSafe(F.col("to_doc"))).drop("old_doc")


def resolved_edges(citations: DataFrame) -> DataFrame:
    """from_doc, to_doc, paragraph_count of resolved citations that are not of the document itself (AGG-2, FLT-7)."""
    real = citations.filter("to_doc is not null and to_doc <> from_doc")
    return real.groupBy("from_doc", "to_doc").agg(F.greatest(F.count_distinct(F.coalesce("from_para", F.lit(-1))), F.lit(1).cast("long")).alias("paragraph_count"))


def cited_by_count(citations: DataFrame, with_self: bool = False) -> DataFrame:
    """to_doc, cited_by_count: distinct citing documents; without itself (AGG-6), or as search counts (JN-5)."""
    rows = citations.filter("to_doc is not null")
    return (rows if with_self else rows.filter("from_doc <> to_doc")).groupBy("to_doc").agg(F.count_distinct("from_doc").alias("cited_by_count"))


def cites_count(citations: DataFrame) -> DataFrame:
    """from_doc, cites_count: all outbound citations (AGG-7)."""
    return citations.groupBy("from_doc").agg(F.count("*").alias("cites_count"))


def cited_by(citations: DataFrame, judgments: DataFrame) -> DataFrame:
    """Citing rows with the citing document's date (JN-2), without self-citations."""
    return citations.filter("from_doc <> to_doc").join(judgments.select(F.col("id").alias("from_doc"), "date", "court"), "from_doc")


def stats(judgments: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: documents, distinct courts, distinct resolved edges, unresolved citations (AGG-5); class counts are class_counts()."""
    docs = judgments.agg(F.count("*").alias("documents"), F.count_distinct("court").alias("courts"))
    edges = citations.filter("to_doc is not null and to_doc <> from_doc").select("from_doc", "to_doc").distinct().agg(F.count("*").alias("edges"))
    open_ = citations.agg(F.count_if(F.col("to_doc").isNull()).alias("unresolved"))
    return docs.crossJoin(edges).crossJoin(open_)  # three single rows


def count_by(judgments: DataFrame, column: str) -> DataFrame:
    """Documents for each court (AGG-3) or region (AGG-4)."""
    return judgments.groupBy(column).agg(F.count("*").alias("n"))


def provenance_class(witnesses: Column, threshold: int = 2) -> Column:
    """corroborated, single or manual, from a number of distinct witnesses (AGG-9)."""
    return F.when(witnesses >= max(2, threshold), "corroborated").when(witnesses >= 1, "single").otherwise("manual")


def witness_classes(provenance: DataFrame, threshold: int = 2) -> DataFrame:
    """doc_id, witnesses, provenance_class: names are counted, nothing is verified."""
    n = provenance.groupBy("doc_id").agg(F.count_distinct("witness").alias("witnesses"))
    return n.withColumn("provenance_class", provenance_class(F.col("witnesses"), threshold))


def class_counts(judgments: DataFrame, classes: DataFrame) -> DataFrame:
    """One row: documents that are corroborated, single and manual; those without any record are manual (AGG-5)."""
    kind = F.coalesce("provenance_class", F.lit("manual"))
    rows = judgments.select(F.col("id").alias("doc_id")).join(classes.select("doc_id", "provenance_class"), "doc_id", "left")
    return rows.agg(*[F.count_if(kind == c).alias(c) for c in ("corroborated", "single", "manual")])


def corroborate(provenance: DataFrame, threshold: int = 2) -> DataFrame:
    """doc_id, raw_hash, agreeing, conflicting, provenance_class (AGG-10, WIN-5, WIN-7).

    Each witness speaks once, by its first record (``fetched_at``, then hash); the hash with most witnesses wins, the smaller
    of tied ones; ``conflicting`` counts the witnesses of other hashes.
    """
    first = provenance.groupBy("doc_id", "witness").agg(F.min(F.struct("fetched_at", "raw_hash")).alias("f")).select("doc_id", "f.raw_hash")
    sizes = first.groupBy("doc_id", "raw_hash").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("doc_id").agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("minus"), "raw_hash")).alias("b"))
    agreeing = -F.col("b.minus")
    return whole.select("doc_id", F.col("b.raw_hash").alias("raw_hash"), agreeing.alias("agreeing"), (F.col("all") - agreeing).alias("conflicting"), provenance_class(agreeing, threshold).alias("provenance_class"))


def corroboration_report(documents: DataFrame, provenance: DataFrame, valid: Column | None = None, threshold: int = 2) -> DataFrame:
    """id, provenance_class, raw_hash, agreeing, conflicting, rejected of given documents (AGG-10).

    documents: id. provenance: doc_id, witness, raw_hash, fetched_at; rows of other documents are left out. Rows that ``valid``
    (a boolean column over them; all are without one) doesn't hold for are counted as rejected before anything else and have
    no weight. A witness counts once, by its first record; the hash of most witnesses wins, the smaller of tied ones. agreeing: its
    witnesses in order; conflicting: (witness, raw_hash) of the others. A document without a valid record is manual.
    """
    # Records are dealt once, by document; all groups and joins below stay in these tasks.
    tasks = tasks_for(provenance.sparkSession, provenance.count())
    ids = documents.select("id").repartition(tasks, "id").distinct()
    own = provenance.repartition(tasks, "doc_id").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").withColumn("good", F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True))
    bad = own.groupBy("doc_id").agg(F.count_if(~F.col("good")).alias("rejected"))
    first = own.filter("good").groupBy("doc_id", "witness").agg(F.min(F.struct("fetched_at", "raw_hash")).alias("f")).select("doc_id", "witness", "f.raw_hash")
    best = first.groupBy("doc_id", "raw_hash").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("minus"), "raw_hash")).alias("b")).select("doc_id", F.col("b.raw_hash").alias("best"))
    sides = first.join(best, "doc_id").groupBy("doc_id").agg(
        F.first("best").alias("raw_hash"), F.array_sort(F.collect_list(F.when(F.col("raw_hash") == F.col("best"), F.col("witness")))).alias("agreeing"),
        F.array_sort(F.collect_list(F.when(F.col("raw_hash") != F.col("best"), F.struct("witness", "raw_hash")))).alias("conflicting"),
    )
    rows = ids.join(sides.withColumnRenamed("doc_id", "id"), "id", "left").join(bad.withColumnRenamed("doc_id", "id"), "id", "left")
    agreeing = F.coalesce("agreeing", F.expr("cast(array() as array<string>)"))
    kind = "array<struct<witness:string,raw_hash:string>>"
    return rows.select("id", provenance_class(F.size(agreeing), threshold).alias("provenance_class"), "raw_hash", agreeing.alias("agreeing"), F.coalesce(F.col("conflicting").cast(kind), F.expr(f"cast(array() as {kind})")).alias("conflicting"), F.coalesce("rejected", F.lit(0)).alias("rejected"))


def courts_listing(judgments: DataFrame, registry: DataFrame) -> DataFrame:
    """code, name, tier, documents of every court that has documents, by the tier's rank and the code (AGG-3, ORD-8).

    registry: code, name, tier. A court that it doesn't know has its code as its name and the tier ``unknown``, which comes last.
    """
    from lexmill.operators.graph import tier_rank

    counted = judgments.groupBy(F.col("court").alias("code")).agg(F.count("*").alias("documents"))
    named = counted.join(registry.select(F.upper("code").alias("known"), "name", "tier").dropDuplicates(["known"]), F.upper("code") == F.col("known"), "left")
    out = named.select("code", F.coalesce("name", "code").alias("name"), F.coalesce("tier", F.lit("unknown")).alias("tier"), "documents")
    return out.orderBy(tier_rank(F.col("tier")), "code")


def filters(court: str | None = None, region: str | None = None, year_from: int | None = None, year_to: int | None = None) -> Column:
    """The listing filters, each optional (FLT-1 to FLT-4, FLT-15); years are compared as text and refuse null dates."""
    parts = [F.lit(True)]
    if court is not None:
        parts.append(F.upper("court") == court.upper())
    if region is not None:
        parts.append(F.upper("region") == normalise_region(region))
    year = F.substring("date", 1, 4)
    if year_from is not None:
        parts.append(year >= f"{year_from:04d}")
    if year_to is not None:
        parts.append(year <= f"{year_to:04d}")
    return reduce(lambda a, b: a & b, parts)


def normalise_region(region: str, default: str = "ZA") -> str:
    """Trimmed upper case; empty is the default region (FLT-2)."""
    return region.strip().upper() or default


def clamp(value, low: int, high: int, default: int) -> int:
    """A page size, result count or depth from a request: wrong values fall back, none is an error (PRJ-6)."""
    try:
        return min(max(int(value), low), high)
    except (TypeError, ValueError):
        return default


def browse(judgments: DataFrame, where: Column | None = None, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """A page of documents by authority, then id (ORD-2)."""
    rows = (judgments if where is None else judgments.filter(where)).orderBy(F.desc("authority"), "id")
    return rows.offset(offset).limit(clamp(limit, 1, 100, 20))


def drop_children(children: DataFrame, removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose parent stays (JN-22)."""
    return children.join(removed.select(key).distinct(), key, "left_anti")


def length_prefixed(*fields: Column) -> Column:
    """Fields as text, each behind its length in bytes, null as a dash: no two lists of fields read alike."""
    text = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def sorted_root(rows: DataFrame, *columns: str, tasks: int | None = None) -> DataFrame:
    """One row, ``root``: a digest of all rows, repeated ones included, that does not depend on their order (AGG-20, CR-8).

    A hash tree over the sorted row hashes, each with how often it stands: leaves meet by six hex digits, these by
    three, these in the root. A node of the upper levels has at most 4096 children, so no task and no driver holds
    all rows; equal tables, equal roots. ``tasks``: how many tasks the hashes are dealt to, for large tables: by six digits,
    so that leaves are counted and meet where they lie.
    """
    hashes = rows.select(F.sha2(length_prefixed(*[F.col(c) for c in columns]), 256).alias("h"))
    hashes = hashes.withColumn("p", F.substring("h", 1, 6))
    own = (hashes.repartition(tasks, "p") if tasks else hashes).groupBy("p", "h").agg(F.count("*").alias("n"))
    level = own.select("p", F.col("h").alias("b"), F.sha2(F.concat("h", F.lit(":"), F.col("n").cast("string")), 256).alias("h"))
    for digits in (6, 3, 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: F.concat(x.b, x.h)), "")
        level = level.groupBy("p").agg(F.sha2(joined, 256).alias("h")).withColumnRenamed("p", "b").withColumn("p", F.substring("b", 1, max(digits - 3, 0)))
    return level.select(F.col("h").alias("root"))


def snapshot_delta(old: DataFrame, new: DataFrame, key: str = "hash") -> DataFrame:
    """Rows added to and removed from a snapshot, by their hash (SET-1, JN-16, ST-5)."""
    added = new.join(old.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.join(new.select(key), key, "left_anti").withColumn("change", F.lit("removed")))


def added_bytes(delta: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: the files and bytes that a delta's additions bring (AGG-18). sizes: hash, size."""
    added = delta.filter("change = 'added'").select("hash").distinct().join(sizes.select("hash", "size").dropDuplicates(["hash"]), "hash")
    return added.agg(F.count("*").alias("added_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("added_bytes"))


def chain_breaks(releases: DataFrame) -> DataFrame:
    """release, chained: whether each release names the hash of the one before (WIN-8, REL-4).

    Joined by number, so no window gathers all releases.
    """
    before = releases.select((F.col("release") + 1).alias("release"), F.col("hash").alias("expected"))
    return releases.join(before, "release", "left").select("release", F.coalesce(F.col("previous") == F.col("expected"), F.col("previous").isNull() & F.col("expected").isNull()).alias("chained"))


def first_by(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in a given order (WIN-5)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
