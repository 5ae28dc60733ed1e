"""Text columns: canonical form, blocks, numbering, markup and addresses. All built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of the canonical form, and the entities of the markup decoder in their order.
SINGLE_QUOTES = "‘’‛"
DOUBLE_QUOTES = "“”‟"
DASHES = "–—−"
SPACES = "\u00a0\u2007\u202f\t"  # no-break, figure and narrow no-break space, tab
ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def canonicalise(text: Column) -> Column:
    """One line ending, straight quotes and dashes, single spaces, no blanks at line ends, one final line break (SC-1)."""
    source = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + SPACES
    target = "'" * 3 + '"' * 3 + "-" * 3 + " " * 4
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    plain = F.regexp_replace(F.translate(lines, source, target), " {2,}", " ")
    trimmed = F.regexp_replace(plain, r"(?mU)[^\S\n]+$", "")
    return F.concat(F.regexp_replace(trimmed, r"^\n+|\n+\z", ""), F.lit("\n"))


def split_blocks(text: Column) -> Column:
    """Blocks between blank lines; a block's lines are trimmed and joined by a space (SC-6)."""
    blocks = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\s*\n")
    joined = F.transform(blocks, lambda b: F.trim(F.array_join(F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")))
    return F.filter(joined, lambda b: b != "")


_NUMBERED = r"^\s*(?:\[([0-9.]{1,6})\]|\(([0-9.]{1,6})\)|([0-9]{1,6})\.(?=\s))\s*(.+)$"


def leading_number(text: Column) -> Column:
    """The paragraph number that opens a text: ``[n]``, ``(n)`` or ``n. ``; null without one (SC-7, SC-8)."""
    found = F.concat(*[F.regexp_extract(text, "(?s)" + _NUMBERED, i) for i in (1, 2, 3)])
    return F.when(found.rlike(r"[0-9]"), found)


def without_number(text: Column) -> Column:
    return F.when(leading_number(text).isNotNull(), F.trim(F.regexp_extract(text, "(?s)" + _NUMBERED, 4))).otherwise(F.trim(text))


def split_list(text: Column) -> Column:
    """Parts between commas and semicolons, trimmed, none empty (SC-9)."""
    return F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def normalise_space(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends (SC-12)."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def decode_entities(text: Column) -> Column:
    """Seven entities, the ampersand last (SC-11)."""
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def strip_tags_lossy(html: Column) -> Column:
    """Tags, then stray ``>``, then everything behind an unclosed ``<`` (SC-15)."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", ""), ">", ""), r"(?s)<.*$", "")


def html_title(html: Column) -> Column:
    """The first title, without tags, decoded (SC-13); null without one."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    title = normalise_space(decode_entities(F.regexp_replace(raw, r"<[^>]*>", "")))
    return F.when(title != "", title)


def html_links(html: Column) -> Column:
    """Addresses of links, in order, each once (SRC-11)."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1)))


def iso_date(text: Column) -> Column:
    """``D Month YYYY`` as an ISO date; a month by three letters or more, a day from 1 to 31 (SC-19); else null."""
    pattern = r"(?i)\b([0-9]{1,2})\s+([a-z]{3,9})\.?\s+([0-9]{4})\b"
    day, name, year = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    month = F.lit(None).cast("int")
    for i, full in enumerate(MONTHS, 1):
        month = F.when((F.length(name) >= 3) & F.lit(full).startswith(F.lower(name)), i).otherwise(month)
    good = month.isNotNull() & F.coalesce(day.try_cast("int").between(1, 31), F.lit(False))
    return F.when(good, F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")))


def url_part(url: Column, part: str) -> Column:
    """host (lower case), path, country (first path segment) of an address (SC-20)."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    if part == "host":
        return F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return path if part == "path" else F.split_part(path, F.lit("/"), F.lit(2))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, diacritics kept, for embeddings (TXT-6)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _marked_letters() -> tuple[str, str]:
    """Letters that are a base letter with marks, and their base letters; then the marks themselves, which go."""
    source, target = [], []
    for cp in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(cp))
        if marks and all(unicodedata.combining(m) for m in marks):
            source.append(chr(cp))
            target.append(base)
    return "".join([*source, *map(chr, range(0x300, 0x370))]), "".join(target)


MARKED, BARE = _marked_letters()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(text, MARKED, BARE))


def search_tokens(text: Column) -> Column:
    """Runs of letters and digits for search: lower case, without diacritics (TXT-2)."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def document_id(text: Column) -> Column:
    """A document's key: the hash of its canonical text (SC-2, with SHA-256 as the hash)."""
    return F.sha2(canonicalise(text), 256)


def short_id(key: Column) -> Column:
    """The first six bytes of a key (SC-3)."""
    return F.substring(key, 1, 12)


def document_id_fault(key: Column) -> Column:
    """Why a text is no document key (SC-4): missing, not_hex (also an odd number of digits) or wrong_length; null for a good one."""
    odd = F.length(key) % 2 == 1
    return F.when(key.isNull() | (key == ""), "missing").when(odd | ~key.rlike("^[0-9a-fA-F]*$"), "not_hex").when(F.length(key) != 64, "wrong_length")


def is_document_id(key: Column) -> Column:
    """64 hex digits (SC-4)."""
    return F.coalesce(key.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
