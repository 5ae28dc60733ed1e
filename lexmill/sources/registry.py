"""Region profiles: courts and report series as data, read from TOML and used as small dimension tables."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.citations import Grammar
from lexmill.operators.graph import TIERS

# Fixed value: the most entries of a profile.
MOST_ENTRIES = 4096


def parse_profile(text: str) -> dict:
    """A checked profile (SRC-16): code, name, courts (code, name, tier, seat) and series (abbr, name, no_volume)."""
    raw = tomllib.loads(text)
    profile = {"code": raw.get("code", "").strip().upper(), "name": raw.get("name", "").strip(), "courts": raw.get("courts", []), "series": raw.get("series", [])}
    if not profile["code"] or not profile["name"]:
        raise ValueError("a profile needs a code and a name")
    for kind, key in (("courts", "code"), ("series", "abbr")):
        names = [x.get(key, "") for x in profile[kind]]
        if len(names) > MOST_ENTRIES:
            raise ValueError(f"more than {MOST_ENTRIES} {kind}")
        if any(not 1 <= len(n.encode()) <= 64 or n != n.strip() for n in names):
            raise ValueError(f"an empty, padded or too long name among the {kind}")
        if len({n.upper() if kind == "courts" else n for n in names}) < len(names):
            raise ValueError(f"a name stands twice among the {kind}")
    if unknown := {c.get("tier") for c in profile["courts"]} - set(TIERS):
        raise ValueError(f"unknown tiers: {sorted(map(str, unknown))}")
    return profile


def load_profiles(folder: str) -> dict[str, dict]:
    """The profiles of a folder of the driver, in the order of their file names; later ones replace earlier ones of a code."""
    found = [parse_profile(p.read_text()) for p in sorted(Path(folder).glob("*.toml"))]
    return {p["code"]: p for p in found}


def grammar(profile: dict) -> Grammar:
    """The citation grammar of a profile (CT-11)."""
    series = profile["series"]
    return Grammar([s["abbr"] for s in series if not s.get("no_volume")], [s["abbr"] for s in series if s.get("no_volume")], [c["code"] for c in profile["courts"]])


def courts(spark: SparkSession, profiles: dict[str, dict]) -> DataFrame:
    """region, code, name, tier of all courts (SRC-27): at most MOST_ENTRIES rows a profile."""
    rows = [(p["code"], c["code"].upper(), c.get("name"), c["tier"]) for p in profiles.values() for c in p["courts"]]
    return spark.createDataFrame(rows, "region string, code string, name string, tier string")


def series(spark: SparkSession, profiles: dict[str, dict]) -> DataFrame:
    """region, abbr, name, no_volume of all report series (SRC-27); their names are told apart by case."""
    rows = [(p["code"], s["abbr"], s.get("name"), bool(s.get("no_volume"))) for p in profiles.values() for s in p["series"]]
    return spark.createDataFrame(rows, "region string, abbr string, name string, no_volume boolean")


def profile_of(code: str, loaded: dict[str, dict], built_in: dict[str, dict] | None = None, default: str = "ZA") -> dict | None:
    """The profile of a region (SRC-27): a loaded one before a built-in one, whatever the case; of an empty code that of the default."""
    code = code.strip().upper() or default
    return loaded.get(code) or (built_in or {}).get(code)


def region_of_court(court: Column, profiles: dict[str, dict], default: str) -> Column:
    """The region that a court's first two letters name, if there is a profile of it; else the default (SRC-6)."""
    code = F.upper(F.substring(court, 1, 2))
    return F.when(code.isin(sorted(profiles)), code).otherwise(default)


def with_known_courts(rows: DataFrame, known: DataFrame, court: str = "court", region: str = "region") -> DataFrame:
    """``rows`` with known: whether their region's profile lists their court, whatever the case (SRC-27, FLT-11)."""
    listed = known.select(F.upper("region").alias("listed_region"), F.upper("code").alias("listed_code")).distinct().withColumn("known", F.lit(True))
    on = (F.upper(region) == F.col("listed_region")) & (F.upper(court) == F.col("listed_code"))
    return rows.join(F.broadcast(listed), on, "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("listed_region", "listed_code")  # MOST_ENTRIES a profile


def with_court_names(rows: DataFrame, known: DataFrame, court: str = "court") -> DataFrame:
    """``rows`` with court_name, the code where the registry has no name (PRJ-1)."""
    names = known.select(F.col("code").alias("__code"), F.col("name").alias("__name")).dropDuplicates(["__code"])
    return rows.join(names, F.upper(court) == F.col("__code"), "left").withColumn("court_name", F.coalesce("__name", court)).drop("__code", "__name")


def sources_of_hosts(pages: DataFrame, sources: DataFrame, host: str = "host") -> DataFrame:
    """``pages`` with the source of their host (SRC-14, JN-24): a source's host fits itself, its subdomains and its parents.

    sources: ord, source_id, source_host; the first fitting one counts. Both sides are turned into their suffixes,
    so the lookup is two equi-joins and no pairwise comparison.
    """

    def suffixes(rows: DataFrame, column: str) -> DataFrame:
        labels = F.split(F.lower(column), "[.]")
        at = F.explode(F.sequence(F.lit(1), F.size(labels)))
        return rows.withColumn("__at", at).withColumn("__suffix", F.array_join(F.slice(labels, F.col("__at"), F.size(labels)), ".")).drop("__at")

    hosts = pages.select(host).filter(F.col(host) != "").distinct()
    below = suffixes(hosts, host).join(sources.select("ord", "source_id", F.lower("source_host").alias("__suffix")), "__suffix")
    above = suffixes(sources, "source_host").join(hosts.select(F.lower(host).alias("__suffix"), host), "__suffix")
    fits = below.select(host, "ord", "source_id").union(above.select(host, "ord", "source_id"))
    first = fits.groupBy(host).agg(F.min_by("source_id", "ord").alias("source_id"))
    return pages.join(first, host, "left")


def source_of_region(sources: DataFrame, region: str) -> DataFrame:
    """The first source of a region, whatever its case (SRC-14)."""
    return sources.filter(F.upper("region") == region.strip().upper()).orderBy("ord").limit(1)
