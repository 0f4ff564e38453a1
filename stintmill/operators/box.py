"""Box-score rows to totals and metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = (
    "minutes", "field_goals_made", "field_goals_attempted", "three_point_field_goals_made", "three_point_field_goals_attempted",
    "free_throws_made", "free_throws_attempted", "offensive_rebounds", "defensive_rebounds", "rebounds", "assists", "steals",
    "blocks", "turnovers", "fouls", "points",
)
POOLED_COEFFICIENT = 0.4178


def _with_least(pairs: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """pairs plus the least id of their name, by partial minima, since one name may be that of many ids."""
    name = [*within, "athlete_display_name"]
    least = pairs.groupBy(*[F.col(c).alias(f"_{c}") for c in name]).agg(F.min("athlete_id").alias("_to"))
    return pairs.join(least, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in name]).drop(*[f"_{c}" for c in name])


def merge_people(rows: DataFrame, within: tuple[str, ...] = ("season",)) -> DataFrame:
    """athlete_id becomes the least id that shares a display name in the same season; unnamed rows keep theirs.

    An id that goes by two names takes the smaller of its two mappings, so all its rows move together.
    """
    pairs = rows.select(*within, "athlete_id", "athlete_display_name").where("athlete_display_name is not null").distinct()
    least = _with_least(pairs, within).groupBy(*within, "athlete_id").agg(F.min("_to").alias("_to"))
    moved = rows.join(least, [*within, "athlete_id"], "left")
    return moved.withColumn("athlete_id", F.coalesce("_to", "athlete_id")).drop("_to").select(*rows.columns)


def merged_ids(rows: DataFrame, within: tuple[str, ...] = ("season",)) -> DataFrame:
    """How many (id, name) pairs a season's merge rewrites."""
    pairs = rows.select(*within, "athlete_id", "athlete_display_name").where("athlete_display_name is not null").distinct()
    return _with_least(pairs, within).groupBy(*within).agg(F.count(F.when(F.col("_to") != F.col("athlete_id"), 1)).alias("merged"))


def eligible_rows(box: DataFrame, least_team_games: int = 40, within: tuple[str, ...] = ("season",), merge: bool = True) -> DataFrame:
    """Regular-season rows of people who played, in teams with enough games; ids of one person merged.

    Team games are counted before the played filter; an unknown did_not_play means did not play.
    """
    missing = {"season_type", "game_id", "team_id", "athlete_id", "minutes", "did_not_play"} - set(box.columns)
    if missing:
        raise ValueError(f"box score lacks columns: {sorted(missing)}")
    regular = box.where("season_type = 2")
    teams = regular.groupBy(*within, "team_id").agg(F.countDistinct("game_id").alias("n")).where(F.col("n") >= least_team_games)
    # teams of seasons, few by nature: the rows are not shuffled for them
    played = regular.join(F.broadcast(teams.drop("n")), [*within, "team_id"], "left_semi").where(~F.coalesce("did_not_play", F.lit(True)) & (F.coalesce("minutes", F.lit(0)) > 0))
    played = played.select(*box.columns)
    return merge_people(played, within) if merge and "athlete_display_name" in box.columns else played


def added_up(rows: DataFrame, names: tuple[str, ...], merge: bool = True) -> DataFrame:
    """(season, athlete_id, team_id, the counts of metrics ``names`` and minutes): eligible rows, unmerged, added up before ids are merged.

    A merge asks for a person's names alone, so the rows that meet the mapping are people of teams and not games.
    """
    named = merge and "athlete_display_name" in rows.columns
    keys = ["season", "athlete_id", "team_id"]
    have = [c for c in COUNTS if c in {"minutes", *counts_of(names)}]
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in have]
    each = rows.groupBy(*keys, *(["athlete_display_name"] if named else [])).agg(*sums)
    return merge_people(each).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in have]) if named else each


def totals(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Sums of the counting columns (all null: 0), distinct games and teams."""
    have = [c for c in COUNTS if c in rows.columns]
    return rows.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in have],
        F.countDistinct("game_id").alias("games"),
        F.countDistinct("team_id").alias("teams"),
    )


@dataclass(frozen=True)
class Metric:
    """A share of two numbers from summed counts, with the count that must reach a least value.

    ``parts`` takes what stands for a count by its name, a Column or an array, and the coefficient: (numerator, denominator).
    """

    name: str
    parts: Callable[[Callable[[str], Any], Any], tuple[Any, Any]]
    evidence: str
    least: float

    def value(self, c: Column) -> Column:
        return F.try_divide(*self.parts(F.col, c))


def _per_36(count: str) -> Callable[[Callable[[str], Any], Any], tuple[Any, Any]]:
    return lambda of, c: (36 * of(count), of("minutes"))


def metrics() -> tuple[Metric, ...]:
    """The registry."""
    per_36 = {
        "points_per_36": "points", "rebounds_per_36": "rebounds", "assists_per_36": "assists", "steals_per_36": "steals", "blocks_per_36": "blocks",
        "turnovers_per_36": "turnovers", "fouls_per_36": "fouls", "offensive_rebounds_per_36": "offensive_rebounds",
        "defensive_rebounds_per_36": "defensive_rebounds",
    }
    fga, fta = "field_goals_attempted", "free_throws_attempted"
    return (
        *[Metric(name, _per_36(count), "minutes", 100) for name, count in per_36.items()],
        Metric("usage_proxy", lambda of, c: (36 * (of(fga) + c * of(fta) + of("turnovers")), of("minutes")), "minutes", 100),
        Metric("true_shooting", lambda of, c: (of("points"), 2 * (of(fga) + c * of(fta))), fga, 50),
        Metric("effective_fg", lambda of, c: (of("field_goals_made") + 0.5 * of("three_point_field_goals_made"), of(fga)), fga, 50),
        Metric("free_throw_rate", lambda of, c: (of(fta), of(fga)), fga, 50),
        Metric("three_point_rate", lambda of, c: (of("three_point_field_goals_attempted"), of(fga)), fga, 50),
        Metric("free_throw_pct", lambda of, c: (of("free_throws_made"), of(fta)), fta, 25),
    )


def counts_of(names: tuple[str, ...]) -> tuple[str, ...]:
    """The counts that metrics are made of."""
    used = set()
    for m in metrics():
        if m.name in names:
            m.parts(lambda n: used.add(n) or 1.0, 1.0)
            used.add(m.evidence)
    return tuple(c for c in COUNTS if c in used)


def metric_arrays(counts: dict[str, np.ndarray], names: tuple[str, ...], c: float = POOLED_COEFFICIENT) -> list[np.ndarray]:
    """``with_metrics`` of arrays of counts: an array a name, not a number where the metric is null."""
    known, out = {m.name: m for m in metrics()}, []
    for m in (known[n] for n in names):
        above, below = m.parts(counts.__getitem__, c)
        with np.errstate(invalid="ignore", divide="ignore"):
            out.append(np.where((counts[m.evidence] >= m.least) & (below != 0), above / below, np.nan))
    return out


def with_metrics(summed: DataFrame, coefficient: Column | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """summed plus one column a metric, null where the evidence is too small or the value not finite."""
    c = F.lit(POOLED_COEFFICIENT) if coefficient is None else coefficient
    chosen = [m for m in metrics() if only is None or m.name in only]
    return summed.withColumns({m.name: F.when(F.col(m.evidence) >= m.least, m.value(c)) for m in chosen})


def long_metrics(wide: DataFrame, keys: tuple[str, ...], names: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, metric, value) with a row a metric."""
    names = names or tuple(m.name for m in metrics())
    return wide.unpivot(list(keys), list(names), "metric", "value")


def pooled_totals(rows: DataFrame, window: int, by: str = "athlete_id", season: str = "season") -> DataFrame:
    """Totals of every run of ``window`` consecutive seasons, summed once over the pooled rows."""
    spans = spread_windows(rows, window, season)
    return totals(spans, ("window_end", by))


def spread_windows(rows: DataFrame, window: int, season: str = "season") -> DataFrame:
    """Each row once for every complete window of seasons that holds it, as window_end."""
    ends = rows.agg(F.min(season).alias("_lo"), F.max(season).alias("_hi"))
    each = rows.withColumn("window_end", F.explode(F.sequence(F.col(season), F.col(season) + window - 1)))
    return each.join(F.broadcast(ends)).where("window_end <= _hi").where(F.col("window_end") - window + 1 >= F.col("_lo")).drop("_lo", "_hi")


def primary_team(rows: DataFrame, by: tuple[str, ...] = ("season", "athlete_id")) -> DataFrame:
    """The team of most minutes of each person; ties to the least team_id."""
    spent = rows.groupBy(*by, "team_id").agg(F.sum("minutes").alias("minutes"))
    best = spent.groupBy(*by).agg(F.max_by(F.struct("team_id", "minutes"), F.struct("minutes", -F.col("team_id"))).alias("_t"))
    return best.select(*by, "_t.team_id", "_t.minutes")


def weighted_mean(rows: DataFrame, value: str, by: tuple[str, ...], weight: str = "minutes", least: float = 200.0) -> DataFrame:
    """Mean of value weighted by minutes, of rows with a value and enough minutes."""
    used = rows.where(F.col(value).isNotNull() & (F.col(weight) >= least))
    return used.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(value), F.count("*").alias("people"))


def weighted_means(rows: DataFrame, values: tuple[str, ...], by: tuple[str, ...], weight: str = "minutes", least: float = 200.0) -> DataFrame:
    """``weighted_mean`` of several values in one pass; groups without any value are left out."""
    used = rows.where(F.col(weight) >= least)
    has = lambda v: F.col(v).isNotNull()
    means = [F.try_divide(F.sum(F.col(v) * F.col(weight)), F.sum(F.when(has(v), F.col(weight)))).alias(v) for v in values]
    return used.groupBy(*by).agg(*means).dropna(how="all", subset=list(values))
