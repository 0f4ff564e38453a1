"""Rolling windows: pooled metrics, ridge and fused ratings of every window in one plan, and the team panel over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import written
from . import box, fusion, panel, ridge, stints
from .tables import with_coefficient


def window_metrics(eligible: DataFrame, window: int = 3, measured: DataFrame | None = None, added: bool = False) -> DataFrame:
    """(window_end, athlete_id, totals, metrics): metrics of pooled totals, with the coefficient of the window's last season.

    measured: (season, coefficient); a season without one takes the pooled coefficient. added: the rows are those of
    ``box.added_up``, of which games cannot be counted, and totals are counts alone.
    """
    if added:
        counts = [c for c in eligible.columns if c in box.COUNTS]
        people = eligible.groupBy("season", "athlete_id").agg(*[F.sum(c).alias(c) for c in counts])
        pooled = box.spread_windows(people, window).groupBy("window_end", "athlete_id").agg(*[F.sum(c).alias(c) for c in counts])
    else:
        pooled = box.pooled_totals(eligible, window)
    if measured is None:
        return box.with_metrics(pooled)
    return box.with_metrics(with_coefficient(pooled, F.broadcast(measured), "window_end"), F.col("coefficient")).drop("coefficient")  # a row a season


def window_players(rows: DataFrame, window: int = 3, possession_floor: float = 2000.0) -> DataFrame:
    """(window_end, player_id) of players over the floor of possessions in a window."""
    return _players(ridge.line_up_sums(rows, 1.0, "season"), window, possession_floor)


def _players(sums: DataFrame, window: int, possession_floor: float) -> DataFrame:
    by_season = stints.possessions_by_player(sums.withColumnRenamed("w", "possessions"), ("season",))
    played = box.spread_windows(by_season, window).groupBy("window_end", "player_id").agg(F.sum("possessions").alias("possessions"))
    return played.where(F.col("possessions") >= possession_floor).select("window_end", "player_id")


def window_ratings(rows: DataFrame, alpha: float, window: int = 3, possession_floor: float = 2000.0) -> DataFrame:
    """(window_end, player_id, offensive, defensive, total) of players over the floor in a window.

    The sums of a season are added once and then go to each of its windows, so stints are not repeated; they are read once,
    since the line-ups' sums are written.
    """
    added = written(ridge.line_up_sums(rows, 1.0, "season"), "line-ups")
    by_season = ridge.gram_of_line_ups(added, "season")
    sums = box.spread_windows(by_season, window).groupBy("window_end", "i", "j").agg(F.sum("s").alias("s"))
    return ridge.solve_groups(sums, alpha, "window_end").join(_players(added, window, possession_floor), ["window_end", "player_id"], "left_semi")


def fusion_people(metrics: DataFrame, ratings: DataFrame, names: tuple[str, ...], crosswalk: DataFrame | None = None, minutes_floor: float = 1000.0) -> DataFrame:
    """(window_end, player_id, names..., rating), standardised within each window: people over the floor in both sources.

    crosswalk: (athlete_id, player_id), without which the two are the same. Two athletes of one player are one person: the
    one with more minutes, then the lesser id.
    """
    ids = metrics.withColumn("player_id", F.col("athlete_id")) if crosswalk is None else metrics.join(crosswalk, "athlete_id")
    best = ids.where(F.col("minutes") >= minutes_floor).groupBy("window_end", "player_id").agg(F.max_by(F.struct(*names), F.struct("minutes", -F.col("athlete_id"))).alias("m"))
    both = best.select("window_end", "player_id", "m.*").join(ratings.select("window_end", "player_id", F.col("total").alias("rating")), ["window_end", "player_id"])
    return fusion.standardise(both, (*names, "rating"), ("window_end",))


def fused(people: DataFrame, names: tuple[str, ...], reliability: dict[str, float], **options) -> DataFrame:
    """(window_end, player_id, fused): every window's factor model in the same passes over people (stage them)."""
    ends = [r.window_end for r in people.select("window_end").distinct().orderBy("window_end").collect()]  # a few seasons
    keys = [(e, None, 20260910) for e in ends]
    models = fusion.fit_many(people, names, reliability, "rating", keys, group="window_end", **options)
    rated = fusion.group_scores(people, "window_end", "player_id", names, {key[0]: m for key, m in models.items()})
    return rated.select("window_end", "player_id", F.col("rating").alias("fused"))


def team_panel(people: DataFrame, eligible: DataFrame, rows: DataFrame, names: tuple[str, ...], crosswalk: DataFrame | None = None) -> DataFrame:
    """(season, team_id, names..., target): each candidate's mean by the minutes of the window's last season, of people
    placed with the team they played most for, beside the team's net rating of the following season."""
    placed = box.primary_team(eligible)
    placed = placed.withColumn("player_id", F.col("athlete_id")) if crosswalk is None else placed.join(crosswalk, "athlete_id")
    placed = placed.groupBy("season", "player_id").agg(F.max_by(F.struct("team_id", "minutes"), F.struct("minutes", -F.col("athlete_id"))).alias("p")).select("season", "player_id", "p.*")
    joined = people.withColumnRenamed("window_end", "season").join(placed, ["season", "player_id"])
    means = box.weighted_means(joined, names, ("season", "team_id"))
    return panel.next_season_target(means, stints.team_ratings(rows), "net")
