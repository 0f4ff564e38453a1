"""The same people and teams across two identifier systems."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSES = ("exact", "suffix", "initial")
# Generational suffixes, and team codes that the two sources write differently.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
TEAM_CODES = {"GSW": "GS", "NOP": "NO", "NYK": "NY", "SAS": "SA", "UTA": "UTAH", "WAS": "WSH"}


def _stripped(names: pd.Series) -> pd.Series:
    strip = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return names.map(strip, na_action="ignore")


def without_accents(name: Column) -> Column:
    """Spark has no function for Unicode's compatibility decomposition."""
    return F.pandas_udf(_stripped, "string")(name)


def normalise(name: Column, strip_suffix: bool = False) -> Column:
    """Comparable form of a name: no accents, lower case, no dots or apostrophes, hyphens as spaces."""
    text = F.translate(F.lower(without_accents(name)), "-.'", " ")
    if strip_suffix:
        text = F.regexp_replace(text, r"\b(" + "|".join(map(re.escape, SUFFIXES)) + r")\b", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def initial_key(bare: Column) -> Column:
    """Last name and first initial of a suffix-free normalised name; a single word stays."""
    parts = F.split(bare, " ")
    return F.when(F.size(parts) < 2, bare).otherwise(F.concat(F.element_at(parts, -1), F.lit(" "), F.substring(bare, 1, 1)))


def _keyed(people: DataFrame, name: str, *carry: str) -> DataFrame:
    """(carry..., pass, key): each person's three keys."""
    keys = people.select(*carry, normalise(F.col(name)).alias("k0"), normalise(F.col(name), strip_suffix=True).alias("k1"))
    both = F.array(
        F.struct(F.lit(0).alias("pass"), F.col("k0").alias("key")),
        F.struct(F.lit(1).alias("pass"), F.col("k1").alias("key")),
        F.struct(F.lit(2).alias("pass"), initial_key(F.col("k1")).alias("key")),
    )
    return keys.select(*carry, F.explode(both).alias("_k")).select(*carry, "_k.pass", "_k.key")


def crosswalk(people: DataFrame, known: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., athlete_id, name, nba_id, pass, status): matched, ambiguous or unmatched.

    people: within..., athlete_id, athlete_display_name. known: nba_id, name, played (and within...
    where who played differs). A pass accepts a person only when exactly one candidate of its key
    played; the first accepting pass wins. Without any candidate in any pass a person is unmatched,
    otherwise ambiguous; nothing is guessed.
    """
    own = [*within, "athlete_id"]
    left = _keyed(people, "athlete_display_name", *own)
    # a key's candidates are one row, so the join is one to many however common a name is
    right = (
        _keyed(known, "name", "nba_id", "played")
        .groupBy("pass", "key")
        .agg(F.count(F.when(F.col("played"), 1)).alias("here"), F.min(F.when(F.col("played"), F.col("nba_id"))).alias("nba_id"))
    )
    found = left.join(right, ["pass", "key"])
    best = found.groupBy(*own).agg(F.min(F.when(F.col("here") == 1, F.struct("pass", "nba_id"))).alias("m"), F.lit(True).alias("seen"))
    return people.join(best, own, "left").select(
        *own,
        F.col("athlete_display_name").alias("name"),
        F.col("m.nba_id").alias("nba_id"),
        F.when(F.col("m").isNotNull(), F.element_at(F.array(*map(F.lit, PASSES)), F.col("m.pass") + 1)).alias("pass"),
        F.when(F.col("m").isNotNull(), "matched").when(F.col("seen"), "ambiguous").otherwise("unmatched").alias("status"),
    )


def match_rates(resolved: DataFrame) -> DataFrame:
    """People, matches and match rate, and matches by pass."""
    return resolved.agg(
        F.count("*").alias("people"),
        F.count(F.when(F.col("status") == "matched", 1)).alias("matched"),
        *[F.count(F.when(F.col("pass") == p, 1)).alias(p) for p in PASSES],
        F.count(F.when(F.col("status") == "ambiguous", 1)).alias("ambiguous"),
        F.count(F.when(F.col("status") == "unmatched", 1)).alias("unmatched"),
    ).withColumn("match_rate", F.try_divide("matched", "people"))


def window_crosswalk(resolved: DataFrame, season: str = "season") -> DataFrame:
    """One mapping a person over several seasons; the later season wins."""
    return resolved.where("status = 'matched'").groupBy("athlete_id").agg(F.max_by("nba_id", season).alias("nba_id"))


def team_code(code: Column) -> Column:
    """The other source's code of a team."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TEAM_CODES.items() for x in pair]), code), code)


def team_crosswalk(teams: DataFrame, other: DataFrame) -> DataFrame:
    """(id, other_id) of teams (id, code) found in other (other_id, code) under its spelling."""
    return teams.withColumn("code", team_code(F.col("code"))).join(other, "code").select("id", "other_id")


def season_end(start: Column) -> Column:
    return start + 1


def season_label(start: Column) -> Column:
    """``2015-16`` of a season's first year."""
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))
