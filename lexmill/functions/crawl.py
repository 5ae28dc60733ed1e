"""Crawl rules as columns and joins: content signals, their eligibility, and robots patterns over (rule, path) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The keys of a content signal and the eligibilities.
SIGNAL_KEYS = ("ai-input", "ai-train", "search")
RAG, SEARCH_ONLY, CITATION_ONLY, FORBIDDEN = "rag-permitted", "search-only", "citation-only", "forbidden"


def _tokens(signal: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(signal), r"[,\s]+"), lambda t: F.contains(t, F.lit("="))), lambda t: F.struct(F.split_part(t, F.lit("="), F.lit(1)).alias("k"), F.regexp_replace(t, "^[^=]*=", "").alias("v")))


def signal_value(signal: Column, key: str) -> Column:
    """true, false or null of one key; a no outweighs every yes (SC-25)."""
    values = F.transform(F.filter(_tokens(signal), lambda t: t.k == key), lambda t: t.v)
    return F.when(F.array_contains(values, "no"), False).when(F.array_contains(values, "yes"), True)


def use_limited(signal: Column) -> Column:
    """Whether any ``use`` directive limits the purpose."""
    return F.exists(_tokens(signal), lambda t: (t.k == "use") & (t.v != ""))


def eligibility(signal: Column) -> Column:
    """What a source permits (SC-25, FLT-16): an explicit permission of input comes before all limits."""
    given, found = signal_value(signal, "ai-input"), signal_value(signal, "search")
    limited = F.coalesce(~given, F.lit(False)) | use_limited(signal)
    rest = F.when(found, SEARCH_ONLY).when(~found, FORBIDDEN).otherwise(CITATION_ONLY)
    return F.when(signal.isNull() | F.coalesce(given, F.lit(False)) | ~limited, RAG).otherwise(rest)


def signal_text(signal: Column) -> Column:
    """A signal printed in one order; ``none`` without any known part."""
    parts = [F.when(signal_value(signal, k).isNotNull(), F.concat(F.lit(f"{k}="), F.when(signal_value(signal, k), "yes").otherwise("no"))) for k in SIGNAL_KEYS]
    text = F.concat_ws(", ", *parts, F.when(use_limited(signal), "use=reference"))
    return F.when(text != "", text).otherwise("none")


def product_token(agent: Column) -> Column:
    """The name of a crawler without its version: what stands before the first slash or blank, lower case (SC-22)."""
    return F.lower(F.regexp_extract(F.trim(agent), r"^[^/\s]*", 0))


def robots_lines(files: DataFrame, body: str = "body", key: str = "host") -> DataFrame:
    """key, line, field, value of each directive: comments go, lines without a colon are none (SC-22)."""
    lines = files.select(key, F.posexplode(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n")).alias("line", "raw"))
    text = F.trim(F.regexp_replace("raw", "#.*$", ""))
    return lines.filter(F.contains(text, F.lit(":"))).select(key, "line", F.lower(F.trim(F.split_part(text, F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_replace(text, "^[^:]*:", "")).alias("value"))


def robots_groups(files: DataFrame, body: str = "body", key: str = "host") -> DataFrame:
    """key, group, agent, line, pattern, allow, crawl_delay, signal: a row for each agent of a group and each of its directives (SC-23).

    Agents in a row share one group; a directive before any agent belongs to none and goes, but for content signals,
    which hold for all (agent ``*``). Rules without a pattern forbid nothing and go. A group with agents alone is one
    row without a directive. The window sees the lines of one file.
    """
    lines = robots_lines(files, body, key).filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay", "content-signal"))
    within = Window.partitionBy(key).orderBy("line")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(within), F.lit("")) != "user-agent")
    lines = lines.withColumn("group", F.sum(opens.cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    agents = lines.filter("field = 'user-agent'").select(key, "group", product_token(F.col("value")).alias("agent")).distinct()
    signals = lines.filter("field = 'content-signal'").select(key, F.lit(0).alias("group"), F.lit("*").alias("agent"), "line", F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("boolean").alias("allow"), F.lit(None).cast("double").alias("crawl_delay"), F.lower("value").alias("signal"))
    delay = F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))
    rules = lines.filter("field in ('allow', 'disallow', 'crawl-delay') and value <> ''").filter((F.col("field") != "crawl-delay") | (delay >= 0)).select(
        key, "group", "line", F.when(F.col("field") != "crawl-delay", F.col("value")).alias("pattern"), F.when(F.col("field") != "crawl-delay", F.col("field") == "allow").alias("allow"), delay.alias("crawl_delay"),
    )
    owned = agents.join(rules, [key, "group"], "left").select(key, "group", "agent", "line", "pattern", "allow", "crawl_delay", F.lit(None).cast("string").alias("signal"))
    return owned.union(signals)


def rules_for(groups: DataFrame, agent: str, key: str = "host") -> DataFrame:
    """key, pattern, allow for one crawler: the groups that name it, else those for all."""
    token = agent.split("/")[0].split(" ")[0].lower()
    named = groups.filter(F.col("signal").isNull() & F.col("agent").isin(token, "*"))
    own = named.groupBy(key).agg(F.max(F.col("agent") == token).alias("named"))
    mine = named.join(own, key).filter(F.col("agent") == F.when(F.col("named"), token).otherwise("*"))
    return mine.filter("pattern is not null").select(key, "pattern", "allow").distinct()


def pattern_fits(path: Column, pattern: Column) -> Column:
    """Whether a robots pattern fits a path (SC-24): its parts between stars stand in the path in order, the first at its start.

    With ``$`` the last part ends the path; else what follows the last part is free. A pattern of ``$`` alone, or none, fits
    every path. The parts are looked up as they are, so nothing is compiled for a row.
    """
    anchored = F.endswith(pattern, F.lit("$"))
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    parts = F.transform(F.split(body, r"\*"), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    final = F.when(anchored, F.size(F.split(body, r"\*")) - 1).otherwise(-1)  # the part that must end the path

    def step(at: Column, part: Column) -> Column:
        """Where the part found ends, from the end of the one before; -1 for none."""
        p, size = part["p"], F.length(part["p"])
        here = F.when(part["i"] == 0, F.when(F.startswith(path, p), 1).otherwise(0)).when(p == "", at + 1).otherwise(F.call_function("locate", p, path, at + 1))
        ended = F.endswith(path, p) & (F.length(path) - size >= at) & ((part["i"] > 0) | (path == p))
        ends = (part["i"] == final) & ((p != "") | (part["i"] == 0))
        return F.when(at < 0, -1).when(ends, F.when(ended, F.length(path)).otherwise(-1)).when(here > 0, here - 1 + size).otherwise(-1)

    return (body == "") | (F.aggregate(parts, F.lit(0), step) >= 0)


def allowed(paths: DataFrame, rules: DataFrame, path: str = "path", key: str = "host") -> DataFrame:
    """``paths`` with ``allowed``: the longest fitting rule of their host decides, allow among equals; none allows.

    rules: ``key``, pattern, allow. The join is by host, so work grows with the rules of the hosts at hand.
    """
    pairs = paths.select(key, path).distinct().join(rules, key)
    hits = pairs.filter(pattern_fits(F.col(path), F.col("pattern")))
    best = hits.groupBy(key, path).agg(F.max(F.struct(F.octet_length("pattern"), "allow")).alias("b")).select(key, path, F.col("b.allow").alias("__allow"))
    return paths.join(best, [key, path], "left").withColumn("allowed", F.coalesce("__allow", F.lit(True))).drop("__allow")
