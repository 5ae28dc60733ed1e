"""Markup as a stream of tags: text of pages, outermost stretches of an element, bodies of portal pages. All built-in expressions.

A page is taken apart into tags and the pieces between them once, and one pass over the tags carries the state: the
element whose content is skipped, or a place and a depth. What a pass keeps is a few places, never text, so its work
follows the length of the page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import decode_entities, normalise_space, strip_tags_lossy
from lexmill.functions.titles import resolve_url

# Elements that break blocks, elements whose content is no text, block elements of legal markup, words of a body.
BLOCKS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article")
SKIPPED = ("script", "style", "head")
LEGAL_BLOCKS = (
    "p", "block", "blockList", "item", "listIntroduction", "heading", "subheading", "crossHeading", "intro", "wrapUp",
    "paragraph", "subparagraph", "section", "article", "hcontainer", "division", "tr",
)
BODY_WORDS = 40
PARAGRAPH_NUMBER = r"^\[?([0-9]{1,4})\]?[.)]?\s+"

_ANY_TAG = r"(?s)<[^>]*(?:>|\z)"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_markup(html: Column) -> Column:
    """Text of markup (SC-10): block tags are blank lines, others nothing; script, style and head go up to their own closing tag.

    A tag ends at the next ``>``, also within a comment, and an open one at the end of the page. Skipped content that is never
    closed runs to the end. Null stays null.
    """
    kind = "struct<skip:string,since:int,gaps:array<struct<since:int,upto:int>>>"
    start = F.lit(None).cast(kind)
    empty = F.expr("cast(array() as array<struct<since:int,upto:int>>)")

    def told(tag: Column, at: Column) -> Column:
        name = F.when(F.endswith(tag, F.lit(">")), F.lower(F.regexp_extract(tag, r"(?U)^<\s*/*([^\s/>]*)", 1))).otherwise("")
        return F.struct(name.alias("name"), tag.rlike(r"(?U)^<\s*/").alias("closes"), at.cast("int").alias("at"))

    def step(state: Column, tag: Column) -> Column:
        opens = state["skip"].isNull() & ~tag["closes"] & tag["name"].isin(*SKIPPED)
        ends = F.coalesce(tag["closes"] & (tag["name"] == state["skip"]), F.lit(False))
        skip = F.when(opens, tag["name"]).when(~ends, state["skip"])
        gap = F.struct(state["since"].alias("since"), tag["at"].alias("upto"))
        gaps = F.when(ends, F.array_append(F.coalesce(state["gaps"], empty), gap)).otherwise(F.coalesce(state["gaps"], empty))
        return F.struct(skip.alias("skip"), F.when(opens, tag["at"]).otherwise(state["since"]).alias("since"), gaps.alias("gaps")).cast(kind)

    def closed(state: Column) -> Column:
        gaps = F.coalesce(state["gaps"], empty)
        return F.when(state["skip"].isNotNull(), F.array_append(gaps, F.struct(state["since"].alias("since"), F.lit((1 << 31) - 1).alias("upto")))).otherwise(gaps)

    def joined(page: Column) -> Column:
        """Each piece, behind the break of the tag before it, where no gap holds them."""
        def piece(text: Column, i: Column) -> Column:
            tag = F.get(page["tags"], i - 1)
            kept = F.when(~F.exists(page["gaps"], lambda g: (i > g["since"]) & (i <= g["upto"])), text).otherwise("")
            shown = ~F.exists(page["gaps"], lambda g: (i - 1 >= g["since"]) & (i - 1 <= g["upto"]))
            return F.concat(F.when((i > 0) & F.coalesce(tag["name"].isin(*BLOCKS), F.lit(False)) & shown, "\n\n").otherwise(""), kept)

        return F.array_join(F.transform(page["pieces"], piece), "")

    parts = F.struct(F.split(html, _ANY_TAG).alias("pieces"), F.transform(F.regexp_extract_all(html, F.lit(_ANY_TAG), F.lit(0)), told).alias("tags"))
    text = bound(parts, lambda x: bound(F.struct(x["pieces"].alias("pieces"), x["tags"].alias("tags"), F.aggregate(x["tags"], start, step, closed).alias("gaps")), joined))
    return F.when(html.isNotNull(), text)


def numbered_paragraphs(html: Column) -> Column:
    """Array of (number, text, raw) of a page's paragraphs (SC-14): text between blank lines, its printed number taken off."""
    raw = F.filter(F.transform(F.split(decode_entities(strip_markup(html)), "\n\n"), normalise_space), lambda x: x != "")

    def cut(x: Column) -> Column:
        number = F.regexp_extract(x, PARAGRAPH_NUMBER, 1)
        return F.struct(F.when(number != "", number).alias("number"), F.trim(F.regexp_replace(x, PARAGRAPH_NUMBER, "")).alias("text"), x.alias("raw"))

    return F.transform(raw, cut)


def element_scan(html: Column, name: str) -> Column:
    """The stretches of an element by the depth of its tags: stretches (array of start, stop, deepest, closed), first_open, last_close.

    Places are 0-based counts of characters. A stretch goes from a tag that opens the element outside of any to the tag that
    brings the depth back to zero, or to the end of the page (closed is false). Closing tags outside of a stretch are
    passed over; tags that close themselves, and those in comments, scripts and styles, don't count. ``last_close`` is the
    end of the last closing tag, or null.
    """
    pattern = rf"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|</?{name}(?![\w-])[^>]*>"
    stretch = "array<struct<start:int,stop:int,deepest:int,closed:boolean>>"
    kind = f"struct<at:int,depth:int,start:int,deepest:int,last_close:int,found:{stretch}>"
    zero = F.expr(f"cast(named_struct('at', 0, 'depth', 0, 'start', 0, 'deepest', 0, 'last_close', null, 'found', cast(array() as {stretch})) as {kind})")

    def step(s: Column, t: Column) -> Column:
        at = s["at"] + t["before"]
        stop = at + F.length(t["tag"])
        own = F.lower(F.left(t["tag"], F.lit(len(name) + 2)))
        closes = own == f"</{name.lower()}"
        opens = F.startswith(own, F.lit(f"<{name.lower()}")) & ~F.endswith(t["tag"], F.lit("/>"))
        depth = F.when(opens, s["depth"] + 1).when(closes, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        begins, ends = opens & (s["depth"] == 0), closes & (s["depth"] == 1)
        done = F.struct(s["start"].alias("start"), stop.alias("stop"), s["deepest"].alias("deepest"), F.lit(True).alias("closed"))
        return F.struct(
            stop.alias("at"), depth.alias("depth"), F.when(begins, at).otherwise(s["start"]).alias("start"),
            F.when(begins, 1).otherwise(F.greatest(s["deepest"], depth)).alias("deepest"), F.when(closes, stop).otherwise(s["last_close"]).alias("last_close"),
            F.when(ends, F.array_append(s["found"], done)).otherwise(s["found"]).alias("found"),
        ).cast(kind)

    def finish(s: Column) -> Column:
        rest = F.struct(s["start"].alias("start"), F.length(html).alias("stop"), s["deepest"].alias("deepest"), F.lit(False).alias("closed"))
        found = F.when(s["depth"] > 0, F.array_append(s["found"], rest)).otherwise(s["found"])
        return F.struct(found.alias("stretches"), F.get(found, F.lit(0))["start"].alias("first_open"), s["last_close"].alias("last_close"))

    tags = F.struct(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)).alias("tags"), F.split(html, pattern).alias("pieces"))
    zipped = bound(tags, lambda x: F.zip_with(x["tags"], F.slice(x["pieces"], 1, F.size(x["tags"])), lambda tag, piece: F.struct(F.length(piece).alias("before"), tag.alias("tag"))))
    return F.when(html.isNotNull(), F.aggregate(zipped, zero, step, finish))


def has_body_text(body: Column) -> Column:
    """Whether a stretch of markup holds a body's worth of words, and not a placeholder."""
    words = normalise_space(strip_tags_lossy(body))
    return F.coalesce((words != "") & (F.size(F.split(words, " ")) >= BODY_WORDS), F.lit(False))


def element_body(html: Column, element: str) -> Column:
    """From the first opening tag of an element to its last closing tag, whatever lies between; null where either is missing."""
    return bound(element_scan(html, element), lambda s: F.when(s["last_close"] > s["first_open"], F.substring(html, s["first_open"] + 1, s["last_close"] - s["first_open"])))


def container_body(html: Column, markers: tuple[str, ...], ends: tuple[str, ...]) -> Column:
    """From the ``<div`` before the first marker that the page holds to the first of ``ends`` that it holds, or its end; null without one."""
    place = F.coalesce(*[F.when(F.contains(html, F.lit(m)), F.locate(m, html)) for m in markers])
    before = F.left(html, place - 1)
    start = F.when(F.contains(before, F.lit("<div")), F.length(before) - F.length(F.substring_index(before, "<div", -1)) - 3)

    def cut(rest: Column) -> Column:
        stops = [F.when(F.contains(rest, F.lit(x)), F.substring_index(rest, x, 1)) for x in ends]
        return F.coalesce(*stops, rest)

    return bound(F.substring(html, start, F.length(html)), cut)


def body_slice(html: Column, element: str = "la-akoma-ntoso", markers: tuple[str, ...] = ("content content__html", "content__html"), ends: tuple[str, ...] = ("<la-gutter", "</article")) -> Column:
    """The body of a portal page: the element's if it has text, else the container's (SRC-10)."""
    def choose(own: Column) -> Column:
        return F.when(has_body_text(own), own).otherwise(container_body(html, markers, ends))

    return bound(element_body(html, element), choose)


def legal_blocks(body: Column) -> Column:
    """Block elements of legal markup as plain blocks; inline ones stay, so that no reference becomes a paragraph (SRC-10)."""
    names = "|".join(LEGAL_BLOCKS)
    return F.regexp_replace(F.regexp_replace(body, rf"(?is)<akn-(?:{names})\b[^>]*>", "<div>"), rf"(?is)</akn-(?:{names})>", "</div>")


def body_plan(html: Column, url: Column, **where) -> Column:
    """Where a page's body is (SRC-9): (plan, body, address). plan is html with the body, pdf with the address of a second fetch, or none.

    A page that shows a file has no body of its own. ``where`` names the element, markers and ends of ``body_slice``.
    """
    filed = F.contains(html, F.lit("content__pdf")) | F.contains(html, F.lit('data-display-type="pdf"')) | F.contains(html, F.lit("data-display-type='pdf'"))
    link = F.regexp_extract(html, r'(?is)href\s*=\s*"([^"]*?/source\.pdf)"', 1)
    address = F.when(link != "", resolve_url(url, link))

    def plan(body: Column) -> Column:
        good = has_body_text(body)
        kind = F.when(good, "html").when(address.isNotNull(), "pdf").otherwise("none")
        return F.struct(kind.alias("plan"), F.when(good, body).alias("body"), F.when(~good, address).alias("address"))

    return F.when(html.isNotNull(), bound(F.when(~filed, body_slice(html, **where)), plan))


def merged(first: Column, more: Column) -> Column:
    """``first``, then what ``more`` holds beyond it, each once, in order (SET-8)."""
    none = F.expr("cast(array() as array<string>)")
    return bound(F.coalesce(first, none), lambda own: F.concat(own, F.filter(F.array_distinct(F.coalesce(more, none)), lambda x: ~F.array_contains(own, x))))
