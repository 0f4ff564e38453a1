"""Possessions to stints, and what is read off stints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .box import spread_windows

STINT = ("game_id", "offense_team_id", "defense_team_id", "offense_lineup", "defense_lineup")


def possessions(stats: DataFrame) -> DataFrame:
    """One row a counted possession: teams and line-ups of its first OffPoss, points by who scored.

    Points are stated once for each player of a line-up pairing; the last statement of a pairing
    counts, and pairings add up, so a substitution inside a possession loses nothing.
    """
    key = ["game_id", "possession_no"]
    first = (
        stats.where("stat_key = 'OffPoss'")
        .groupBy(*key)
        .agg(F.min_by(F.struct("team_id", "opponent_team_id", "lineup_id", "opponent_lineup_id"), "stat_no").alias("o"))
        .select(
            *key,
            F.col("o.team_id").alias("offense_team_id"),
            F.col("o.opponent_team_id").alias("defense_team_id"),
            F.col("o.lineup_id").alias("offense_lineup"),
            F.col("o.opponent_lineup_id").alias("defense_lineup"),
        )
    )
    scored = (
        stats.where("stat_key = 'OpponentPoints'")
        .groupBy(*key, F.col("opponent_team_id").alias("scorer"), "lineup_id", "opponent_lineup_id")
        .agg(F.max_by("stat_value", "stat_no").alias("points"))
        .groupBy(*key, "scorer")
        .agg(F.sum("points").alias("points"))
    )
    own = F.col("scorer") == F.col("offense_team_id")
    return (
        first.join(scored, key, "left")
        .groupBy(*key, *STINT[1:])
        .agg(
            F.coalesce(F.sum(F.when(own, F.col("points"))), F.lit(0)).alias("points"),
            F.coalesce(F.sum(F.when(~own, F.col("points"))), F.lit(0)).alias("opponent_points"),
        )
    )


def stints(possession_rows: DataFrame) -> DataFrame:
    """Possessions, points and opponent points of each line-up pairing of a game."""
    return possession_rows.groupBy(*STINT).agg(
        F.count("*").cast("double").alias("possessions"),
        F.sum("points").cast("double").alias("points"),
        F.sum("opponent_points").cast("double").alias("opponent_points"),
    )


def failed_games(stats: DataFrame) -> DataFrame:
    """Games that yield no counted possession, with how many rows they had."""
    return stats.groupBy("game_id").agg(F.count("*").alias("rows"), F.count(F.when(F.col("stat_key") == "OffPoss", 1)).alias("counted")).where("counted = 0").drop("counted")


# The shape of a game's payload: possessions, each with its stats.
PAYLOAD = (
    "possessions array<struct<possession_no: bigint, stats: array<struct<stat_no: bigint, stat_key: string, stat_value: bigint, "
    "team_id: bigint, opponent_team_id: bigint, lineup_id: string, opponent_lineup_id: string>>>>, _corrupt string"
)
STAT = ("stat_no", "stat_key", "stat_value", "team_id", "opponent_team_id", "lineup_id", "opponent_lineup_id")


def season_stints(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stints, failures) of games (game_id, json): a game that cannot be read is told with its reason, and costs no other.

    failures: game_id, reason, detail. Payloads are read permissively with the unreadable text kept; the first of
    these reasons counts: corrupt (not JSON, or a value of another type), empty (no possessions), unkeyed (a
    possession without a number, or two of one number), unattributed (a counted possession without both teams), uncounted
    (no possession is counted). A game's possessions go on only if it has no failure. Repeated game_ids fail as repeated.
    """
    # one row a game: of repeated ones any text will do, since they fail whatever they say. Read inside the aggregate, a
    # text is read once: a filter that goes below a projection would read it for each mention of what it says
    text = F.max("json")
    parsed = F.from_json(text, PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = payloads.where("game_id is not null").groupBy("game_id").agg(text.alias("json"), parsed.alias("_g"), F.count("*").alias("_copies"))
    counted = F.expr("flatten(transform(coalesce(_g.possessions, array()), p -> filter(coalesce(p.stats, array()), x -> x.stat_key = 'OffPoss')))")
    numbers = F.expr("transform(coalesce(_g.possessions, array()), p -> p.possession_no)")
    reason = (
        F.when(F.col("_copies") > 1, "repeated")
        .when(F.col("json").isNull() | F.col("_g").isNull() | F.col("_g._corrupt").isNotNull(), "corrupt")
        .when(F.coalesce(F.size("_g.possessions"), F.lit(0)) <= 0, "empty")
        .when(F.exists(numbers, lambda n: n.isNull()) | (F.size(F.array_distinct(numbers)) < F.size(numbers)), "unkeyed")
        .when(F.exists(counted, lambda x: x["team_id"].isNull() | x["opponent_team_id"].isNull()), "unattributed")
        .when(F.size(counted) == 0, "uncounted")
    )
    judged = read.withColumn("reason", reason)
    detail = F.when(F.col("reason") == "corrupt", F.left(F.coalesce("json", F.lit("")), F.lit(60))).otherwise(F.lit(""))
    failures = judged.where("reason is not null").select("game_id", "reason", detail.alias("detail"))
    each = judged.where("reason is null").select("game_id", F.explode("_g.possessions").alias("p")).select("game_id", F.coalesce("p.stats", F.array()).alias("stats"))
    return stints(told_possessions(each)), failures


def told_possessions(each: DataFrame) -> DataFrame:
    """``possessions`` of rows that each hold all stats of one possession (game_id, stats), with no other row read or held."""
    of = lambda key: F.filter("stats", lambda x: x["stat_key"] == key)
    placed = lambda rows: F.filter(rows, lambda x: x["stat_no"].isNotNull())
    first = F.array_min(F.transform(placed(of("OffPoss")), lambda x: F.struct(*[x[c].alias(c) for c in ("stat_no", "team_id", "opponent_team_id", "lineup_id", "opponent_lineup_id")])))
    pairing = ("opponent_team_id", "lineup_id", "opponent_lineup_id")
    said = F.sort_array(F.transform(placed(of("OpponentPoints")), lambda x: F.struct(*[x[c].alias(c) for c in (*pairing, "stat_no", "stat_value")])))
    rows = each.where(F.size(of("OffPoss")) > 0).select("game_id", first.alias("o"), said.alias("said"))

    def is_last(x, i):  # of its pairing, in the order of said
        following = F.get("said", i + 1)
        return (i + 1 == F.size("said")) | ~F.struct(*[x[c] for c in pairing]).eqNullSafe(F.struct(*[following[c] for c in pairing]))

    def points(own: bool):
        counts = lambda x: (x["opponent_team_id"] == F.col("o.team_id")) if own else (x["opponent_team_id"] != F.col("o.team_id"))
        return F.aggregate("last", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.coalesce(F.when(counts(x), x["stat_value"]), F.lit(0)))

    return rows.withColumn("last", F.filter("said", is_last)).select(
        "game_id",
        F.col("o.team_id").alias("offense_team_id"),
        F.col("o.opponent_team_id").alias("defense_team_id"),
        F.col("o.lineup_id").alias("offense_lineup"),
        F.col("o.opponent_lineup_id").alias("defense_lineup"),
        points(True).alias("points"),
        points(False).alias("opponent_points"),
    )


def season_summary(found: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: games and stints read, possessions, and games that failed."""
    told = found.agg(F.countDistinct("game_id").alias("games"), F.count("*").alias("stints"), F.coalesce(F.sum("possessions"), F.lit(0.0)).alias("possessions"))
    return told.join(failures.agg(F.count("*").alias("failed")))


def points_by_team(rows: DataFrame, by: tuple[str, ...] = ("game_id",)) -> DataFrame:
    """Points on offence plus points scored while defending."""
    own = rows.select(*by, F.col("offense_team_id").alias("team_id"), "points")
    other = rows.select(*by, F.col("defense_team_id").alias("team_id"), F.col("opponent_points").alias("points"))
    return own.unionByName(other).groupBy(*by, "team_id").agg(F.sum("points").alias("points"))


def reconcile_points(derived: DataFrame, reference: DataFrame, by: tuple[str, ...] = ("game_id",)) -> DataFrame:
    """Derived beside reference points of every team of either side, and whether they agree."""
    keys = [*by, "team_id"]
    return (
        derived.withColumnRenamed("points", "derived")
        .join(reference.select(*keys, F.col("points").alias("reference")), keys, "full_outer")
        .withColumn("agrees", F.col("derived").eqNullSafe(F.col("reference")))
    )


def has_valid_lineups() -> F.Column:
    """Both line-ups hold exactly five ids."""
    five = lambda c: F.size(F.split(c, "-")) == 5
    return five("offense_lineup") & five("defense_lineup")


def usable_stints(rows: DataFrame, least_possessions: float = 1.0) -> DataFrame:
    """Stints over the possession floor with valid line-ups."""
    return rows.where(F.col("possessions") >= least_possessions).where(has_valid_lineups())


def required_stints(rows: DataFrame, least_possessions: float = 1.0) -> DataFrame:
    """Usable stints; a ValueError where there are none to rate anyone by."""
    usable = usable_stints(rows, least_possessions)
    if usable.isEmpty():
        raise ValueError(f"no stint of {least_possessions:g} possessions or more has two line-ups of five")
    return usable


def dropped_stints(rows: DataFrame, least_possessions: float = 1.0) -> DataFrame:
    """How many stints each rule drops, the floor first."""
    kept = F.col("possessions") >= least_possessions
    return rows.agg(
        F.count("*").alias("stints"),
        F.count(F.when(~kept, 1)).alias("below_floor"),
        F.count(F.when(kept & ~has_valid_lineups(), 1)).alias("bad_lineup"),
        F.count(F.when(kept & has_valid_lineups(), 1)).alias("usable"),
    )


def exploded_players(rows: DataFrame, *carry: str) -> DataFrame:
    """(carry..., player_id, side): each stint's players, offence and defence."""
    ids = lambda c: F.transform(F.split(c, "-"), lambda x: x.cast("long"))
    both = F.concat(
        F.transform(ids("offense_lineup"), lambda p: F.struct(p.alias("player_id"), F.lit("offense").alias("side"))),
        F.transform(ids("defense_lineup"), lambda p: F.struct(p.alias("player_id"), F.lit("defense").alias("side"))),
    )
    return rows.select(*carry, F.explode(both).alias("_p")).select(*carry, "_p.player_id", "_p.side")


def possessions_by_player(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every stint credits its possessions to each of its players."""
    return exploded_players(rows.where(has_valid_lineups()), *by, "possessions").groupBy(*by, "player_id").agg(F.sum("possessions").alias("possessions"))


def external_stints(rows: DataFrame) -> DataFrame:
    """Home and away sides of a foreign stint as two rows of half its possessions each."""
    line = lambda c: F.replace(F.col(c), F.lit("_"), F.lit("-"))
    side = lambda one, two: rows.select(
        "game_id",
        F.lit(1 if one == "home" else 2).cast("long").alias("offense_team_id"),
        F.lit(2 if one == "home" else 1).cast("long").alias("defense_team_id"),
        line(f"{one}_lineup").alias("offense_lineup"),
        line(f"{two}_lineup").alias("defense_lineup"),
        (F.col("n_pos") / 2).alias("possessions"),
        F.col(f"{one}_points").cast("double").alias("points"),
        F.lit(0.0).alias("opponent_points"),
    )
    return side("home", "away").unionByName(side("away", "home"))


def tenure(rows: DataFrame, window: int = 3) -> DataFrame:
    """First and last season, and seasons with possessions, of each player in each window."""
    played = possessions_by_player(rows, ("season",)).where("possessions > 0")
    return (
        spread_windows(played, window)
        .groupBy("window_end", "player_id")
        .agg(
            F.min("season").alias("first_season"),
            F.max("season").alias("last_season"),
            F.countDistinct("season").alias("seasons_played"),
            F.sum("possessions").alias("possessions"),
        )
    )


def tenure_mismatches(shipped: DataFrame, derived: DataFrame) -> DataFrame:
    """Players and windows whose possessions differ; tenure is written only when there is none."""
    keys = ["window_end", "player_id"]
    both = shipped.select(*keys, F.col("possessions").alias("shipped")).join(derived.select(*keys, F.col("possessions").alias("derived")), keys, "full_outer")
    return both.where(~F.col("shipped").eqNullSafe(F.col("derived")))


def team_ratings(rows: DataFrame) -> DataFrame:
    """Points per 100 possessions for and against, and their difference, by season and team."""
    for_ = rows.groupBy("season", F.col("offense_team_id").alias("team_id")).agg(F.sum("points").alias("p"), F.sum("possessions").alias("n"))
    against = rows.groupBy("season", F.col("defense_team_id").alias("team_id")).agg(F.sum("points").alias("q"), F.sum("possessions").alias("m"))
    return for_.join(against, ["season", "team_id"]).select(
        "season",
        "team_id",
        F.try_divide(100 * F.col("p"), F.col("n")).alias("offense"),
        F.try_divide(100 * F.col("q"), F.col("m")).alias("defense"),
        (F.try_divide(100 * F.col("p"), F.col("n")) - F.try_divide(100 * F.col("q"), F.col("m"))).alias("net"),
        (F.col("n") + F.col("m")).alias("possessions"),
    )


def league_spread(ratings: DataFrame) -> DataFrame:
    """Least, greatest and standard deviation of the teams' net rating, by season."""
    return ratings.groupBy("season").agg(F.min("net").alias("least"), F.max("net").alias("greatest"), F.stddev("net").alias("sd"), F.count("*").alias("teams"))
