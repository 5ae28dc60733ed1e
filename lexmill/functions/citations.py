"""Citations in prose: neutral, reported and case-number forms, with greedy choice among overlapping matches.

The choice is sequential within a text (earliest, then longest), so extraction is a small Python table function over one
text at a time; resolving, keys and edges are DataFrame work.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default registry's report series (those without volumes apart) and its court codes.
SERIES = ("All SA", "SACR", "SATC", "SALLR", "SA", "BCLR", "BLLR", "BPIR", "ILJ", "JOL", "JDR", "NR", "BLR", "LLR")
SERIES_WITHOUT_VOLUME = ("AD", "CPD", "TPD", "WLD", "NPD", "OPD", "EDL", "GWL", "SR", "PH")
COURTS = (
    "ZACC", "ZASCA", "ZALAC", "ZACAC", "ZAGPPHC", "ZAGPJHC", "ZAWCHC", "ZAKZDHC", "ZAKZPHC", "ZAECGHC", "ZAECPEHC", "ZAECBHC", "ZAECMHC", "ZAFSHC",
    "ZANWHC", "ZANCHC", "ZALMPPHC", "ZALMPTHC", "ZAMPMBHC", "ZAMPMHC", "ZALC", "ZALCJHB", "ZALCCT", "ZALCD", "ZALCPE", "ZALCC", "ZATC", "ZAEC",
    "ZACT", "ZAWT", "ZACGSO", "ZAICT",
)

#: Grows with every change of what is extracted.
EXTRACTOR_VERSION = 1

# The patterns that define the keys.
NEUTRAL = r"\[(\d{4})\]\s+([A-Z][A-Za-z]{1,11})\s+(\d{1,5})"
CASE_NUMBER = r"\b([A-Z]{1,5})\s?(\d{1,6}/\d{2,4})\b"
PARAGRAPH = r"\s*,?\s*at\s+paras?\.?\s*\[?(\d{1,4})\]?(?:\s*[-–]\s*\[?(\d{1,4})\]?)?"
PAGE = r"\s*,?\s*at\s+(\d{1,4})\s*([A-J])?(?:\s*[-–]\s*([A-J]))?"

SCHEMA = (
    "ord int, kind string, citation_key string, canonical string, as_written string, start int, stop int, known_court boolean, "
    "pinpoint struct<kind:string,start:int,stop:int,page:int,from_letter:string,to_letter:string>"
)


class Grammar:
    """A region's patterns: its series and courts are data. No series: no reported citations."""

    def __init__(self, series=SERIES, without_volume=SERIES_WITHOUT_VOLUME, courts=COURTS):
        choice = lambda names: "|".join(re.escape(s) for s in sorted(names, key=len, reverse=True))  # noqa: E731  stable among equals
        court = r"(?:\s*\(([A-Za-z]{1,8})\))?"
        self.courts = {c.upper() for c in courts}
        self.neutral, self.case = re.compile(NEUTRAL), re.compile(CASE_NUMBER)
        self.modern = re.compile(rf"(\d{{4}})\s*\((\d{{1,3}})\)\s*({choice(series)})\s+(\d{{1,4}}){court}") if series else None
        self.old = re.compile(rf"(\d{{4}})\s+({choice(without_volume)})\s+(\d{{1,4}}){court}") if without_volume else None
        self.paragraph, self.page = re.compile(PARAGRAPH), re.compile(PAGE)
        self._bound = [sorted(self.courts), list(series), list(without_volume)]

    def fingerprint(self) -> str:
        """A hash of the extractor's version and of the profile that it is bound to (CT-12): equal ones extract alike."""
        parts = [str(EXTRACTOR_VERSION), *(x for names in self._bound for x in (str(len(names)), *names))]
        return hashlib.sha256(b"".join(len(x.encode()).to_bytes(8, "big") + x.encode() for x in parts)).hexdigest()

    def found(self, text: str) -> Iterator[tuple]:
        """(start, stop, kind, key, canonical, known court) of every match."""
        for m in self.neutral.finditer(text):
            code = m[2].upper()
            if code in self.courts or re.fullmatch("[A-Z]{3,}", m[2]):
                yield m.start(), m.end(), "neutral", f"neutral:{int(m[1])}:{code}:{int(m[3])}", f"[{int(m[1])}] {code} {int(m[3])}", code in self.courts
        if self.modern:
            for m in self.modern.finditer(text):
                tail = f" ({m[5]})" if m[5] else ""
                yield m.start(), m.end(), "reported", f"reported:{int(m[1])}:{int(m[2])}:{m[3]}:{int(m[4])}", f"{int(m[1])} ({int(m[2])}) {m[3]} {int(m[4])}{tail}", True
        if self.old:
            for m in self.old.finditer(text):
                tail = f" ({m[4]})" if m[4] else ""
                yield m.start(), m.end(), "reported", f"reported:{int(m[1])}::{m[2]}:{int(m[3])}", f"{int(m[1])} {m[2]} {int(m[3])}{tail}", True
        for m in self.case.finditer(text):
            yield m.start(), m.end(), "caseno", f"caseno:{m[1]}:{m[2]}", f"{m[1]} {m[2]}", True

    def pinpoint(self, text: str, at: int) -> dict | None:
        none = dict.fromkeys(("start", "stop", "page", "from_letter", "to_letter"))
        if m := self.paragraph.match(text, at):
            return none | {"kind": "paragraph", "start": int(m[1]), "stop": int(m[2]) if m[2] else None}
        if m := self.page.match(text, at):
            return none | {"kind": "page", "page": int(m[1]), "from_letter": m[2], "to_letter": m[3]}
        return None

    def extract(self, text: str) -> list[dict]:
        """The matches that remain: earliest first, the longest of those, none over another."""
        out, at = [], 0
        for start, stop, kind, key, canonical, known in sorted(self.found(text), key=lambda m: (m[0], m[0] - m[1], m[4])):
            if start < at:
                continue
            at = stop
            byte = len(text[:start].encode())  # spans are byte offsets
            written = text[start:stop]
            pin = None if kind == "caseno" else self.pinpoint(text, stop)
            out.append({"ord": len(out), "kind": kind, "citation_key": key, "canonical": canonical, "as_written": written, "start": byte, "stop": byte + len(written.encode()), "known_court": known, "pinpoint": pin})
        return out


def citations_of(text: Column, grammar: Grammar | None = None) -> Column:
    """The citations of a text in order, as an array of structs (CT-0 to CT-8); null texts have none."""
    grammar = grammar or Grammar()

    @F.pandas_udf(f"array<struct<{SCHEMA.replace(' struct<', ':struct<').replace(' int', ':int').replace(' string', ':string').replace(' boolean', ':boolean')}>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: grammar.extract(t) if isinstance(t, str) else [])

    return found(text)


def extract_citations(paragraphs: DataFrame, text: str = "text", grammar: Grammar | None = None) -> DataFrame:
    """``paragraphs`` with one row for each citation in ``text``."""
    keep = [c for c in paragraphs.columns if c != text]
    return paragraphs.select(*keep, F.explode(citations_of(F.col(text), grammar)).alias("c")).select(*keep, "c.*")
