"""Readers of the corpus's interchange formats. Bad records become rows of their own; nothing aborts a read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions.markup import numbered_paragraphs
from lexmill.sources.lines import numbered_lines

RECORD = (
    "id string, region string, neutral_citation string, date string, court string, title string, case_numbers array<string>, judges array<string>, "
    "reported_citations array<string>, paragraphs array<string>, text string, "
    "provenance array<struct<source_url:string,fetched_at:string,raw_hash:string,witness:string,signature:string>>"
)

# Header names of the plain-text format, as folded to lower-case letters and digits.
HEADERS = {
    "court": ("court",),
    "title": ("title", "case", "styleofcause", "parties"),
    "neutral_citation": ("neutralcitation", "neutral", "citation"),
    "date": ("date", "dateofjudgment"),
    "case_numbers": ("casenumber", "casenumbers", "caseno"),
    "judges": ("judge", "judges", "coram"),
    "reported_citations": ("reported", "reportedcitations", "parallel"),
    "region": ("region", "jurisdiction", "country"),
}
LISTS = ("case_numbers", "judges", "reported_citations")


def _blank(value: Column) -> Column:
    return F.when(F.trim(value) != "", F.trim(value))


def build_records(raw: DataFrame) -> DataFrame:
    """Validated records (SRC-3): court and region in upper case, paragraphs with their numbers taken off, id and reason.

    raw: the fields of RECORD and ``location``. ``reason`` is null for a good record; else it names the first fault.
    """
    none = F.array().cast("array<string>")
    pieces = F.concat(F.coalesce("paragraphs", none), F.when(F.col("text").isNotNull(), tx.split_blocks(F.col("text"))).otherwise(none))
    rows = raw.withColumns({
        "court": F.upper(_blank(F.col("court"))), "title": _blank(F.col("title")), "region": F.coalesce(F.upper(_blank(F.col("region"))), F.lit("ZA")),
        "date": _blank(F.col("date")), "neutral_citation": _blank(F.col("neutral_citation")),
        "pieces": F.filter(pieces, lambda p: F.trim(p) != ""), "claimed": F.lower(_blank(F.col("id"))),
        **{c: F.coalesce(c, none) for c in LISTS},
    })
    numbered = F.transform("pieces", lambda p, i: F.struct(i.alias("idx"), tx.leading_number(p).alias("number"), tx.without_number(p).alias("text")))
    rows = rows.withColumn("paragraphs", numbered)
    whole = F.array_join(F.transform("paragraphs", lambda p: p.text), "\n\n")
    rows = rows.withColumn("id", tx.document_id(whole))
    reason = (
        F.when(F.col("court").isNull(), "missing court").when(F.col("title").isNull(), "missing title").when(F.size("paragraphs") == 0, "no text")
        .when(F.col("claimed").isNotNull() & (F.col("claimed") != F.col("id")), "id does not match the text")
    )
    return rows.withColumn("reason", reason).drop("pieces", "claimed", "text")


def read_json_lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Records of the JSON lines of ``*.jsonl`` and ``*.ndjson`` files (SRC-1, SRC-4): blank lines are skipped, unreadable ones
    carry the reason ``not a record``.

    ``paragraphs`` may hold strings or objects with a text; both are read. The location is the file, and with
    ``numbered`` the file and the physical line, which are counted split by split.
    """
    glob = "*.{jsonl,ndjson}"
    if numbered:
        lines = numbered_lines(spark, path, glob).select("value", F.concat("file", F.lit(":"), "line").alias("location"))
    else:
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path).withColumn("location", F.col("_metadata.file_path"))
    lines = lines.filter("trim(value) <> ''")
    plain = F.from_json(F.get_json_object("value", "$.paragraphs"), "array<string>")  # an object comes as its JSON text
    texts = F.transform(plain, lambda p: F.coalesce(F.when(p.startswith("{"), F.get_json_object(p, "$.text")), p))
    parsed = lines.withColumn("r", F.from_json("value", RECORD.replace("paragraphs array<string>, ", "") + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    fields = [f.split()[0] for f in ("id s", "region s", "neutral_citation s", "date s", "court s", "title s", "case_numbers s", "judges s", "reported_citations s", "text s", "provenance s")]
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    rows = build_records(parsed.select("location", bad.alias("__bad"), texts.alias("paragraphs"), *[F.col(f"r.{c}").alias(c) for c in fields]))
    return rows.withColumn("reason", F.when(F.col("__bad"), "not a record").otherwise(F.col("reason"))).drop("__bad")


def read_headed_text(spark: SparkSession, path: str) -> DataFrame:
    """Records of plain text files (SRC-2): ``Key: Value`` headers, a blank line, the body. A file is a record.

    Keys fold to lower-case letters and digits; unknown keys are ignored; lists split at commas and semicolons. A missing
    court is taken from the neutral citation.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("location"), F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
    cut = F.split("value", r"\n\s*\n", 2)
    lines = F.filter(F.split(F.get(cut, F.lit(0)), "\n"), lambda x: F.trim(x) != "")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_replace(F.lower(F.split_part(x, F.lit(":"), F.lit(1))), "[^a-z0-9]", "").alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"), F.contains(x, F.lit(":")).alias("ok")))
    rows = files.select("location", pairs.alias("h"), F.get(cut, F.lit(1)).alias("text"))

    def header(names: tuple[str, ...]) -> Column:
        found = F.filter("h", lambda p: p.k.isin(*names))
        return F.transform(found, lambda p: p.v)

    fields = {}
    for field, names in HEADERS.items():
        values = header(names)
        fields[field] = F.flatten(F.transform(values, lambda v: tx.split_list(v))) if field in LISTS else F.get(values, F.lit(0))
    named = rows.select("location", F.exists("h", lambda p: ~p.ok).alias("__bad"), "text", *[c.alias(n) for n, c in fields.items()])
    from_citation = F.regexp_extract("neutral_citation", r"\[\d{4}\]\s+([A-Za-z]{2,12})\s+\d+", 1)
    named = named.withColumns({"court": F.coalesce(_blank(F.col("court")), _blank(from_citation)), "id": F.lit(None).cast("string"), "paragraphs": F.lit(None).cast("array<string>")})
    out = build_records(named)
    return out.withColumn("reason", F.when(F.col("__bad"), "malformed header").otherwise(F.col("reason"))).drop("__bad")


def good_and_bad(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records to keep, and location and reason of the others."""
    return records.filter("reason is null").drop("reason"), records.filter("reason is not null").select("location", "reason")


def paragraphs(records: DataFrame) -> DataFrame:
    """doc_id, idx, number, text of all paragraphs (SRC-17, WIN-4)."""
    return records.select(F.col("id").alias("doc_id"), F.explode("paragraphs").alias("p")).select("doc_id", "p.*")


def html_records(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """title, country and paragraphs of markup pages (SRC-7)."""
    return pages.withColumns({"title": tx.html_title(F.col(html)), "country": tx.url_part(F.col(url), "country"), "paragraphs": F.transform(numbered_paragraphs(F.col(html)), lambda p: p["raw"])})
