"""Titles of published pages and the parts of legal addresses, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import decode_entities, iso_date, normalise_space, strip_tags_lossy

_CITE = r"\[[0-9]{4}\]"


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def og_title(html: Column) -> Column:
    """The title that a page gives for sharing: the og tag, else the twitter tag; decoded, null without one (SC-16)."""
    out = F.lit(None).cast("string")
    for name in ("twitter:title", "og:title"):
        tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b(?:property|name)=[\"']{name}[\"'][^>]*>", 0)
        content = F.regexp_extract(tag, r"(?is)\bcontent=(?:\"([^\"]*)\"|'[^']*')", 1)
        out = F.coalesce(_or_null(F.trim(decode_entities(content))), out)
    return out


def h1_title(html: Column) -> Column:
    """The first main heading, without tags, decoded; null without one (SC-16)."""
    inner = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)
    return _or_null(normalise_space(decode_entities(strip_tags_lossy(inner))))


def decision_type(title: Column) -> Column:
    """The last group in parentheses if it is a tag of at most three words, no date and no citation (SC-18); else null."""
    last = F.trim(F.regexp_extract(title, r"(?s)^.*\(([^()]*)\)", 1))
    short = (F.size(F.split(normalise_space(last), " ")) <= 3) & last.rlike("^[A-Za-z]") & ~F.contains(last, F.lit("["))
    return F.when(short & iso_date(last).isNull(), last)


def _head(title: Column) -> Column:
    return F.trim(F.regexp_extract(title, rf"(?s)^(.*?){_CITE}", 1))


_LAST_GROUP = r"(?s)^(.*)\(([^(]*)\)$"


def parties(title: Column) -> Column:
    """Who the case is between: what stands before the cited year, less a closing group in parentheses; without a cited year
    what stands before the first parenthesis (SC-17)."""
    head = _head(title)
    front = F.trim(F.regexp_extract(head, _LAST_GROUP, 1))
    cited = F.when(head.rlike(_LAST_GROUP) & (front != ""), front).otherwise(head)
    return F.when(title.rlike(_CITE), cited).otherwise(F.trim(F.split_part(title, F.lit("("), F.lit(1))))


def case_description(title: Column) -> Column:
    """The closing group in parentheses before the cited year (SC-17); null without one."""
    return F.when(title.rlike(_CITE), _or_null(F.trim(F.regexp_extract(_head(title), _LAST_GROUP, 2))))


def akn_path(url: Column) -> Column:
    """The path of an address under ``/akn/``; null for others (SC-20)."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(path, F.lit("/akn/")), path)


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(akn_path(url), url), "/"), lambda s: s != "")


def akn_country(url: Column) -> Column:
    """The country code behind ``akn``, upper case (SC-20)."""
    found = F.try_element_at(_segments(url), (F.array_position(_segments(url), "akn") + 1).cast("int"))
    return F.when(F.array_contains(_segments(url), "akn") & found.rlike("^[A-Za-z]{2}$"), F.upper(found))


def frbr_parts(url: Column) -> Column:
    """court, year, number behind ``judgment``; null where one is missing or no number (SC-20)."""
    parts = _segments(url)
    at = F.array_position(parts, "judgment").cast("int")
    court, year, number = (F.try_element_at(parts, at + i) for i in (1, 2, 3))
    year, number = year.try_cast("int"), number.try_cast("long")
    good = (at > 0) & court.isNotNull() & year.between(0, 65535) & number.between(0, (1 << 32) - 1)
    return F.when(good, F.struct(F.upper(court).alias("court"), year.alias("year"), number.alias("number")))


def neutral_citation(url: Column) -> Column:
    """The citation that an address implies; null where it implies none (SC-20)."""
    p = frbr_parts(url)
    return F.when(p.isNotNull(), F.format_string("[%d] %s %d", p["year"], p["court"], p["number"]))


def resolve_url(base: Column, href: Column) -> Column:
    """An address seen from a page (SC-21): whole ones stay, ``//`` keeps the scheme, ``/`` the host, ``?`` and ``#`` the page.

    Others are looked up beside the page; ``.`` and ``..`` are walked. Null for a base without a host.
    """
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    bare, tail = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    joined = F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(F.regexp_extract(F.when(path == "", "/").otherwise(path), r"^(.*/)", 1), bare))
    whole = F.aggregate(
        F.split(joined, "/"), F.expr("cast(array() as array<string>)"),
        lambda seen, x: F.when(x == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(1)))).when(x == ".", seen).otherwise(F.concat(seen, F.array(x))),
    )
    closed = F.concat(F.array_join(whole, "/"), F.when(joined.rlike(r"/\.{1,2}$"), "/").otherwise(""))
    return (
        F.when(href.rlike("^https?://"), href).when(root == "", None).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(root, "^[^:]*:", 0), href))
        .when(href == "", F.concat(root, path, query)).when(F.startswith(href, F.lit("?")), F.concat(root, path, href)).when(F.startswith(href, F.lit("#")), F.concat(root, path, query, href))
        .otherwise(F.concat(root, closed, tail))
    )
