"""Pages of legal portals: metadata from the address and the title, the body from the page or a second fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import citations as cite
from lexmill.functions import markup, titles
from lexmill.functions import text as tx
from lexmill.session import free_names


def portal_pages(pages: DataFrame, url: str = "url", html: str = "html", **where) -> DataFrame:
    """``pages`` with what their markup says (SRC-9): plan, address of a second fetch, court, title, date, decision_type, neutral_citation,
    case_description, title_line and paragraphs (number, text, raw).

    Court and citation follow from the path that the page names as its work, else from its address; a page whose path
    says neither has the plan ``no path``. A page that shows a file has an address and no paragraphs; one with neither has the plan
    ``none``. Null markup has a null plan. Columns of these names are replaced.
    """
    h = F.col(html)
    work = F.regexp_extract(h, r"(?is)data-work-frbr-uri\s*=\s*[\"']([^\"']*)[\"']", 1)
    path = F.coalesce(*[F.when(titles.frbr_parts(c).isNotNull(), c) for c in (work, F.col(url))])
    line = F.coalesce(titles.og_title(h), titles.h1_title(h), F.lit(""))
    (plan,) = free_names([*pages.columns, "plan"], "found")
    rows = pages.withColumns({plan: markup.body_plan(h, F.col(url), **where), "title_line": line, "path": path})
    body = markup.legal_blocks(F.col(plan)["body"])
    return rows.withColumns({
        "plan": F.when(F.col("path").isNull() & h.isNotNull(), "no path").otherwise(F.col(plan)["plan"]), "address": F.col(plan)["address"],
        "court": titles.frbr_parts(F.col("path"))["court"], "title": titles.parties(F.col("title_line")), "date": tx.iso_date(F.col("title_line")),
        "decision_type": titles.decision_type(F.col("title_line")), "neutral_citation": titles.neutral_citation(F.col("path")),
        "case_description": titles.case_description(F.col("title_line")), "paragraphs": markup.numbered_paragraphs(body),
    }).drop(plan, "path")


def with_citations(pages: DataFrame, grammar: cite.Grammar | None = None) -> DataFrame:
    """Portal pages with neutral_citation, reported and case_numbers as their titles print them (SRC-9).

    A printed neutral citation stands before that of the path; the case description stands in where no case number is printed.
    """
    (found,) = free_names(pages.columns, "found")
    rows = pages.withColumn(found, cite.citations_of(F.col("title_line"), grammar))
    of = lambda kind: F.transform(F.filter(F.col(found), lambda c: c["kind"] == kind), lambda c: c["canonical"])
    described = F.when(F.col("case_description").isNotNull(), F.array("case_description")).otherwise(F.expr("cast(array() as array<string>)"))
    return rows.withColumns({
        "neutral_citation": F.coalesce(F.get(of("neutral"), F.lit(0)), "neutral_citation"), "reported": F.array_distinct(of("reported")),
        "case_numbers": F.when(F.size(of("caseno")) > 0, F.array_distinct(of("caseno"))).otherwise(described),
    }).drop(found)


def overlaid(body: DataFrame, meta: DataFrame, id_col: str = "id") -> DataFrame:
    """Records read from bodies, with what their pages say laid over them (SRC-10): court and citation from the page, a title unless
    it is empty, a date where the body has none, numbers and reported citations merged (SET-8). The key, which follows from the
    paragraphs, stays."""
    fields = ("court", "title", "date", "neutral_citation", "reported", "case_numbers")
    joined = body.join(meta.select(id_col, F.struct(*fields).alias("said")), id_col, "left")
    said = F.col("said")
    return joined.withColumns({
        "court": F.coalesce(said["court"], "court"), "title": F.coalesce(F.when(said["title"] != "", said["title"]), "title"), "date": F.coalesce("date", said["date"]),
        "neutral_citation": F.coalesce(said["neutral_citation"], "neutral_citation"),
        "reported": markup.merged(F.col("reported"), said["reported"]), "case_numbers": markup.merged(F.col("case_numbers"), said["case_numbers"]),
    }).drop("said")
