"""URL filters by a sort-merge range join.

A rule (host, path prefix) fits its host and every subdomain. A url therefore has one key for each of its
host's suffixes: the labels reversed and closed with a separator, then the path. A rule's key is built alike, and
the keys that start with it are one interval of the sorted keys. Distinct keys and rule intervals are dealt to the
same ranges (a rule to every range that its interval meets), and in each range one sorted sweep reads them as they
come and keeps the stack of the nested rules that are open. Only keys that a rule fits go back to their urls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.session import Scratch, shuffle_partitions, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"
#: Sampled keys for each range; they only set the borders of ranges.
SAMPLE_PER_RANGE = 32
#: Distinct keys of a range, about.
RANGE_KEYS = 250_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "\x02"), F.lit("\x02\x01"), path)


def _borders(keys: DataFrame, ranges: int) -> list[str]:
    """Borders from a bounded sample, the same whenever it is taken: the keys with the smallest hashes."""
    rows = keys.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_PER_RANGE * ranges).select("key").collect()
    sample = sorted(r[0] for r in rows)
    return sample[SAMPLE_PER_RANGE // 2 :: SAMPLE_PER_RANGE]


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The innermost open rule of each key, from keys and rules sorted by range, key and rank; rules stand before equal keys."""
    columns = ["cell", "key", "rank", "rule", "verdict", "host_length"]
    at, stack = None, []  # the rules that are open in this range, outer ones first
    for frame in frames:
        found = []
        for cell, key, *rule in zip(*(frame[c].tolist() for c in columns), strict=True):
            if cell != at:
                at, stack = cell, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not pd.isna(rule[1]):
                stack.append((key, *rule))
            elif stack:
                found.append((key, *stack[-1][1:]))
        yield pd.DataFrame(found, columns=columns[1:])


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    rules: host, path, verdict. The longest rule text that fits wins; of equally long ones the longer host; of
    the same rule with both verdicts, ``block``. Urls that no rule fits get ``default`` and a null rule. Null
    urls and urls without ``://`` have empty host and path and fit nothing. Rules with a null field or an empty
    host are ignored. Repeated pages stay repeated; columns of ``pages`` named host, path, rule or verdict are
    replaced. Empty inputs give empty or rule-free results.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    labels = F.split("host", "[.]")
    keys = (
        pages.filter("host <> ''").select("host", "path").distinct()
        .withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(labels))))
        .select("host", "path", _key(F.slice(labels, F.size(labels) - F.col("depth") + 1, F.col("depth")), F.col("path")).alias("key"))
    )
    single = scratch.table(keys.select("key").distinct(), "keys")
    ranges = max(shuffle_partitions(spark), -(-single.count() // RANGE_KEYS))
    borders = _borders(single, ranges)

    @F.pandas_udf(T.IntegerType())
    def cell(keys: pd.Series) -> pd.Series:
        if not borders:
            return pd.Series(np.zeros(len(keys), dtype=np.int32))
        return pd.Series(np.searchsorted(np.array(borders, dtype=object), keys.to_numpy(dtype=object), side="right").astype(np.int32))

    host = F.translate("host", UPPER, LOWER)
    rules = (
        rules.select(host.alias("host"), "path", "verdict").dropna().filter("host <> ''").distinct()
        .select(
            _key(F.split("host", "[.]"), F.col("path")).alias("key"), F.when(F.col("verdict") == "block", 1).otherwise(0).alias("rank"),
            F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"),
        )
        .withColumn("cell", F.explode(F.sequence(cell("key"), cell(F.concat("key", F.lit(LAST))))))
    )
    asked = single.select("key", F.lit(2).alias("rank"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("host_length"), cell("key").alias("cell"))
    swept = rules.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "key", "rank", "verdict")
    swept = swept.mapInPandas(_sweep, "key string, rank int, rule string, verdict string, host_length int")
    found = keys.join(swept, "key")
    size = F.struct(F.length("rule"), "host_length", "rank", "rule", "verdict")
    best = found.groupBy("host", "path").agg(F.max(size).alias("b")).select("host", "path", "b.rule", "b.verdict")
    return pages.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


#: The rules of the query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` under RULES; what no rule fits is allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), found AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR suffix(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM found WHERE k = 1
"""
