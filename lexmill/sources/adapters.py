"""Sources as an extension point: what a source is called, where it belongs, which addresses are its own, and how its pages are read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import titles
from lexmill.session import free_names
from lexmill.sources import portal


@dataclass(frozen=True)
class SourceAdapter:
    """source_id names it in reports. owns: whether an address (a column) is a document of the source, and no navigation. parse:
    pages (url, html and more) to records, one row a page, with the columns of ``FIELDS``."""

    source_id: str
    region: str
    owns: Callable[[Column], Column]
    parse: Callable[[DataFrame], DataFrame]


#: What every adapter returns beside the page's own columns.
FIELDS = ("plan", "address", "court", "title", "date", "neutral_citation", "paragraphs")


def portal_adapter(source_id: str, region: str, **where) -> SourceAdapter:
    """A legal portal: its documents lie under ``/akn/<country>/judgment/``; ``where`` as in ``markup.body_slice``."""

    def owns(url: Column) -> Column:
        return F.coalesce(titles.akn_path(url).rlike("/akn/[^/]+/judgment/"), F.lit(False))

    return SourceAdapter(source_id, region.upper(), owns, lambda pages: portal.portal_pages(pages, **where))


def for_region(adapters: list[SourceAdapter], region: str) -> list[SourceAdapter]:
    """The adapters of a region, whatever its case, in their order."""
    return [a for a in adapters if a.region.upper() == region.strip().upper()]


def ingest(pages: DataFrame, adapters: list[SourceAdapter], region: str, url: str = "url") -> DataFrame:
    """``pages`` with source_id and the fields of the first adapter of the region that owns their address; nulls where none does."""
    found = for_region(adapters, region)
    (which,) = free_names([*pages.columns, "source_id", *FIELDS], "which")
    number = F.coalesce(*[F.when(a.owns(F.col(url)), i) for i, a in enumerate(found)], F.lit(-1))
    own = [c for c in pages.columns if c not in ("source_id", *FIELDS)]
    marked = pages.select(*own).withColumn(which, number)
    columns = [*own, F.col("source_id"), *FIELDS]
    parts = [a.parse(marked.filter(F.col(which) == i)).withColumn("source_id", F.lit(a.source_id)).select(*columns) for i, a in enumerate(found)]
    if not parts:
        paragraphs = "array<struct<number:string,text:string,raw:string>>"
        return marked.withColumns({"source_id": F.lit(None).cast("string"), **{f: F.lit(None).cast(paragraphs if f == "paragraphs" else "string") for f in FIELDS}}).select(*columns)
    parsed = reduce(DataFrame.unionByName, parts)
    return parsed.unionByName(marked.filter(F.col(which) == -1).select(*own), allowMissingColumns=True)
