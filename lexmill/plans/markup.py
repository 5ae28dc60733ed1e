"""Queries over the markup of ``pages``: stretches of elements, bodies, paragraphs, portal records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import markup
from lexmill.plans.catalog import _query
from lexmill.session import table
from lexmill.sources import portal

ELEMENTS = ("article", "p", "li", "b")
#: Tags of an element with their places, and its depth after each: the sum of opening and closing tags above the lowest sum so far.
_STRETCHES = r"""WITH t AS (SELECT page_id, html, e AS element, regexp_extract_all(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?' || e || '(?:[^\w>-][^>]*)?>') AS tags,
      string_split_regex(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?' || e || '(?:[^\w>-][^>]*)?>') AS pieces FROM pages, (VALUES ('article'), ('p'), ('li'), ('b')) v(e)),
    x AS (SELECT page_id, element, length(html) AS size, unnest(range(1, len(tags) + 1)) AS i, tags, pieces FROM t),
    y AS (SELECT page_id, element, size, i, length(tags[i]) AS n, sum(length(pieces[i]) + length(tags[i])) OVER w AS stop,
        CASE WHEN starts_with(lower(tags[i]), '</' || element) THEN -1 WHEN starts_with(lower(tags[i]), '<' || element) AND NOT suffix(tags[i], '/>') THEN 1 ELSE 0 END AS d FROM x WINDOW w AS (PARTITION BY page_id, element ORDER BY i)),
    z AS (SELECT *, sum(d) OVER (PARTITION BY page_id, element ORDER BY i) AS s FROM y WHERE d <> 0),
    r AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id, element ORDER BY i)) AS depth FROM z),
    q AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY page_id, element ORDER BY i), 0) AS before FROM r),
    k AS (SELECT *, sum(CASE WHEN before = 0 AND depth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, element ORDER BY i) AS k FROM q WHERE NOT (before = 0 AND depth = 0))
    SELECT page_id, element, (k - 1)::INTEGER AS place, min(stop - n)::INTEGER AS start, (CASE WHEN min_by(depth, -i) = 0 THEN max(stop) ELSE max(size) END)::INTEGER AS stop, max(depth)::INTEGER AS deepest, min_by(depth, -i) = 0 AS closed
    FROM k GROUP BY page_id, element, k"""


@_query(_STRETCHES)
def page_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost stretches of four elements on every page, nested and unclosed ones among them (SRC-10)."""
    rows = table(spark, sf_dir, "pages").select("page_id", "html")
    scans = F.array(*[F.struct(F.lit(e).alias("element"), markup.element_scan(F.col("html"), e)["stretches"].alias("found")) for e in ELEMENTS])
    found = rows.select("page_id", F.explode(scans).alias("s")).select("page_id", "s.element", F.posexplode("s.found").alias("place", "f"))
    return found.select("page_id", "element", "place", "f.start", "f.stop", "f.deepest", "f.closed")


_WORDS = r"len(list_filter(string_split_regex(replace(regexp_replace(regexp_replace(body, '<[^>]*>', '', 'g'), '(?s)<.*$', ''), '>', ''), '\s+'), lambda x: x <> '')) >= 40"


@_query(rf"""WITH a AS (SELECT page_id, html, CASE WHEN regexp_matches(html, '(?is)<article\b.*</article>') THEN regexp_extract(html, '(?is)<article\b.*</article>') END AS own FROM pages),
    b AS (SELECT page_id, own AS body, {_WORDS.replace("body", "own")} AS good, html FROM a),
    c AS (SELECT page_id, CASE WHEN good THEN body WHEN contains(html, 'class="ad"') THEN regexp_extract(regexp_replace(html, '(?s)^.*(<div[^>]*class="ad")', '\1'), '(?s)^(.*?)(?:<footer|$)', 1) END AS body FROM b)
    SELECT page_id, CASE WHEN {_WORDS} THEN 'html' ELSE 'none' END AS plan, CASE WHEN {_WORDS} THEN length(body) ELSE 0 END::INTEGER AS n_chars, CASE WHEN {_WORDS} THEN sha256(body) END AS body_sha256 FROM c""")  # fmt: skip
def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of every page: its article if that has text, else from the block that is marked to the footer (SRC-9, SRC-10)."""
    plan = markup.body_plan(F.col("html"), F.col("url"), element="article", markers=('class="ad"',), ends=("<footer",))
    rows = table(spark, sf_dir, "pages").select("page_id", plan.alias("p"))
    return rows.select("page_id", "p.plan", F.coalesce(F.length("p.body"), F.lit(0)).alias("n_chars"), F.sha2("p.body", 256).alias("body_sha256"))


_PARAGRAPHS = r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head\s*>', '', 'g'), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</?(?:p|div|br|li|h[1-6]|tr|section|article)(?:[\s/][^>]*)?>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS t FROM b),
    d AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM c),
    e AS (SELECT page_id, unnest(range(0, len(p)))::INTEGER AS idx, p FROM d)
    SELECT page_id, idx, nullif(regexp_extract(p[idx + 1], '^\[?([0-9]{1,4})\]?[.)]?\s+', 1), '') AS number, trim(regexp_replace(p[idx + 1], '^\[?([0-9]{1,4})\]?[.)]?\s+', '')) AS text FROM e"""


@_query(_PARAGRAPHS)
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of every page, with their numbers taken off (SRC-7, SC-10, SC-14)."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(markup.numbered_paragraphs(F.col("html"))).alias("idx", "p"))
    return rows.select("page_id", "idx", "p.number", "p.text")


#: The path of a page's work: its country, the court that its host stands for, its number.
_WORK = r"""WITH u AS (SELECT page_id, html, regexp_extract(url, '://([^/?#]*)', 1) AS host, coalesce(nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), ''), 'xx') AS lang FROM pages),
    w AS (SELECT page_id, html, upper(split_part(host, '.', 2)) AS court, 1990 + length(host) AS year, page_id AS number, lang FROM u),
    t AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', '', 'g'), '>', ''), '(?s)<.*$', ''), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS line FROM w)
    SELECT page_id, 'html' AS plan, court, trim(split_part(line, '(', 1)) AS title, '[' || year || '] ' || court || ' ' || number AS neutral_citation FROM t WHERE court <> ''"""


@_query(_WORK)
def portal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a portal would show it: its body in the portal's element, its work named by host and number (SRC-9)."""
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    court = F.split_part(host, F.lit("."), F.lit(2))
    work = F.concat(F.lit("/akn/xx/judgment/"), court, F.format_string("/%d/%d", 1990 + F.length(host), F.col("page_id")))
    shown = F.concat(F.lit('<html data-work-frbr-uri="'), work, F.lit('">'), "html", F.lit(f"<la-akoma-ntoso><akn-p>{'word ' * markup.BODY_WORDS}</akn-p></la-akoma-ntoso>"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", shown.alias("html"), court.alias("c")).filter("c <> ''")
    return portal.with_citations(portal.portal_pages(pages)).select("page_id", "plan", "court", "title", "neutral_citation")
