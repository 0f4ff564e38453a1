"""Schema rules within a table and checks between tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHOWN = 10


@dataclass(frozen=True)
class Rule:
    """A condition that a row must meet; null passes."""

    column: str
    name: str
    condition: str


@dataclass(frozen=True)
class Schema:
    """Declared columns with types and nullability, range and row rules, and a natural key."""

    columns: dict[str, tuple[str, bool]]
    rules: tuple[Rule, ...] = ()
    key: tuple[str, ...] = ()


def between(column: str, low: float | None = None, high: float | None = None) -> Rule:
    parts = ([f"{column} >= {low}"] if low is not None else []) + ([f"{column} <= {high}"] if high is not None else [])
    return Rule(column, f"in_range({low},{high})", " and ".join(parts))


MADE = Rule("field_goals_made", "made_at_most_attempted", "coalesce(field_goals_made, 0) <= coalesce(field_goals_attempted, 0)")
# The columns of an event log by type, those of a side with each side's name before them, and the ones that are never null.
EVENT_COLUMNS = {
    "bigint": ("game_id", "period", "period_number", "clock_minutes", "type_id", "team_id", "athlete_id_1", "athlete_id_2", "athlete_id_3"),
    "string": ("period_display_value", "clock_display_value", "wallclock", "athlete_name_1", "athlete_name_2", "athlete_name_3"),
    "double": ("clock_seconds", "coordinate_x", "coordinate_y", "coordinate_x_raw", "coordinate_y_raw", "home_team_spread"),
}
SIDE_COLUMNS = {"bigint": ("team_id",), "string": ("team_name", "team_mascot", "team_abbrev", "team_name_alt")}
NEVER_NULL = ("game_id", "period", "period_number", "type_id", *(f"{side}_{c}" for side in ("home", "away") for c in ("team_id", "team_name", "team_abbrev")))


def _event_columns() -> dict[str, tuple[str, bool]]:
    own = [(c, kind) for kind, names in EVENT_COLUMNS.items() for c in names]
    sides = [(f"{side}_{c}", kind) for side in ("home", "away") for kind, names in SIDE_COLUMNS.items() for c in names]
    return {c: (kind, c not in NEVER_NULL) for c, kind in own + sides}


# The ranges and keys of the four datasets.
SCHEMAS = {
    "play_by_play": Schema(_event_columns(), (between("period", 1), between("period_number", 1), between("clock_minutes", 0, 12), between("clock_seconds", 0, 60))),
    "player_box": Schema(
        {"game_id": ("bigint", False), "season": ("bigint", False), "athlete_id": ("bigint", False), "team_id": ("bigint", False), "minutes": ("double", True),
         "field_goals_made": ("double", True), "field_goals_attempted": ("double", True)},
        (between("season", 1946, 2100), between("minutes", 0), between("field_goals_made", 0), between("field_goals_attempted", 0), MADE),
        ("game_id", "athlete_id"),
    ),
    "team_box": Schema(
        {"game_id": ("bigint", False), "season": ("bigint", False), "team_id": ("bigint", False), "field_goals_made": ("double", True),
         "field_goals_attempted": ("double", True), "field_goal_pct": ("double", True)},
        (between("season", 1946, 2100), between("field_goals_made", 0), between("field_goals_attempted", 0), between("field_goal_pct", 0, 100), MADE),
        ("game_id", "team_id"),
    ),
    "schedules": Schema(
        {"game_id": ("bigint", False), "season": ("bigint", False), "game_date": ("string", True), "home_id": ("bigint", False), "away_id": ("bigint", False)},
        (between("season", 1946, 2100), Rule("home_id", "distinct_teams", "home_id <> away_id")),
        ("game_id",),
    ),
}


def validate(frame: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(clean, violations): declared columns cast, extras passed through; every failure of every row.

    violations has (column_name, rule, value) and one row for each failing row and rule; a missing
    column is one violation. One pass over the table; where a key is declared, its columns are counted
    and joined beside it, so no task holds all rows of one key and wide rows are not shuffled.
    """
    if dataset not in SCHEMAS:
        raise KeyError(f"unknown dataset {dataset!r}; known: {sorted(SCHEMAS)}")
    schema = SCHEMAS[dataset]
    missing = [c for c in schema.columns if c not in frame.columns]
    have = {c: t for c, t in schema.columns.items() if c in frame.columns}
    held = frame.withColumns({f"_raw_{c}": F.col(c).cast("string") for c in have} | {c: F.expr(f"try_cast(`{c}` as {t[0]})") for c, t in have.items()})
    fails: list[Column] = []

    def fail(column: str, rule: str, bad: Column, value: Column) -> None:
        fails.append(F.when(bad, F.struct(F.lit(column).alias("column_name"), F.lit(rule).alias("rule"), value.cast("string").alias("value"))))

    for c, (kind, nullable) in have.items():
        fail(c, f"type({kind})", F.col(c).isNull() & F.col(f"_raw_{c}").isNotNull(), F.col(f"_raw_{c}"))
        if not nullable:
            fail(c, "not_null", F.col(f"_raw_{c}").isNull(), F.lit(None))
    for r in schema.rules:
        if all(c in frame.columns for c in schema.columns if c in r.condition):
            fail(r.column, r.name, ~F.coalesce(F.expr(r.condition), F.lit(True)), F.col(r.column))
    found = held.select(F.explode(F.filter(F.array(*fails), lambda x: x.isNotNull())).alias("f")).select("f.*")
    if schema.key and not set(schema.key) & set(missing):
        keys = held.select(*schema.key)
        shared = keys.groupBy(*schema.key).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in schema.key])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in schema.key]
        value = F.concat_ws(",", *schema.key).alias("value")
        found = found.unionByName(keys.join(shared, same, "left_semi").select(F.lit("+".join(schema.key)).alias("column_name"), F.lit("unique").alias("rule"), value))
    if missing:
        absent = frame.sparkSession.createDataFrame([(c, "present", None) for c in missing], "column_name string, rule string, value string")
        found = found.unionByName(absent)
    return held.select(*frame.columns), found


def report(violations: DataFrame) -> DataFrame:
    """Equal failures once, with how often they occur."""
    return violations.groupBy("column_name", "rule", "value").agg(F.count("*").alias("times"))


def duplicate_rows(frame: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows that share a natural key with another, all copies counted."""
    return frame.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def _named(ids: DataFrame, col: str) -> DataFrame:
    """One row: how many, and up to ten in order followed by how many more."""
    first = F.slice(F.sort_array(F.collect_list(F.col(col))), 1, SHOWN)
    few = ids.select(col).distinct().orderBy(col).limit(SHOWN).agg(F.array_join(first.cast("array<string>"), ", ").alias("text"))
    total = ids.select(col).distinct().agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > SHOWN, F.concat(F.col("text"), F.lit(" and "), (F.col("n") - SHOWN).cast("string"), F.lit(" more"))).otherwise(F.col("text"))
    return total.join(few).select("n", more.alias("detail"))


def _result(check: str, bad: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(check, status, n, detail): skipped when nothing could be looked at, else failed or passed."""
    looked = F.lit(True) if seen is None else F.col("_seen") > 0
    row = bad if seen is None else bad.join(seen.agg(F.count("*").alias("_seen")))
    status = F.when(~looked, "skipped").when(F.col("n") > 0, "failed").otherwise("passed")
    return row.select(F.lit(check).alias("check"), status.alias("status"), "n", F.when(status == "failed", F.col("detail")).otherwise("").alias("detail"))


def skipped(spark: SparkSession, check: str, why: str) -> DataFrame:
    return spark.createDataFrame([(check, "skipped", 0, why)], "check string, status string, n long, detail string")


def coverage(schedule: DataFrame, pbp: DataFrame) -> DataFrame:
    """Completed games without events and games with events that are not scheduled: two results."""
    done = schedule
    if "status_type_completed" in schedule.columns:
        done = schedule.where(F.coalesce("status_type_completed", F.lit(False)))
    with_events = pbp.select("game_id").distinct()
    silent = done.select("game_id").distinct().join(with_events, "game_id", "left_anti")
    stray = with_events.join(schedule.select("game_id").distinct(), "game_id", "left_anti")
    return _result("scheduled_without_events", _named(silent, "game_id")).unionByName(_result("events_without_schedule", _named(stray, "game_id")))


def no_duplicates(frame: DataFrame, dataset: str) -> DataFrame:
    """Rows that are repeated on the dataset's natural key; skipped where it has none."""
    key = SCHEMAS[dataset].key if dataset in SCHEMAS else ()
    name = f"no_duplicates_{dataset}"
    if not key or set(key) - set(frame.columns):
        return skipped(frame.sparkSession, name, "no natural key")
    copies = duplicate_rows(frame, key)
    return _result(name, copies.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).withColumn("detail", F.concat(F.col("n").cast("string"), F.lit(" rows"))))


def teams_match(schedule: DataFrame, pbp: DataFrame) -> DataFrame:
    """Games whose first stated teams differ from the schedule's; skipped where no game is shared."""
    if not {"home_team_id", "away_team_id", "game_play_number"} <= set(pbp.columns):
        return skipped(pbp.sparkSession, "teams_match", "no team or order column")
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("game_play_number"))).alias(c)
    teams = pbp.groupBy("game_id").agg(first("home_team_id"), first("away_team_id"))
    shared = schedule.select("game_id", "home_id", "away_id").join(teams, "game_id")
    differs = F.coalesce(F.col("home_id") != F.col("home_team_id"), F.lit(False)) | F.coalesce(F.col("away_id") != F.col("away_team_id"), F.lit(False))
    return _result("teams_match", _named(shared.where(differs), "game_id"), shared)


def events_in_order(pbp: DataFrame) -> DataFrame:
    """Games in which the period falls from one event to the next."""
    if "game_play_number" not in pbp.columns:
        return skipped(pbp.sparkSession, "events_in_order", "no order column")
    before = F.lag("period").over(Window.partitionBy("game_id").orderBy("game_play_number"))
    return _result("events_in_order", _named(pbp.withColumn("_before", before).where("period < _before"), "game_id"), pbp)


def dates_in_season(schedule: DataFrame) -> DataFrame:
    """Games outside 1 August of the year before to 30 September of the season; unparsed dates are ignored."""
    day = F.expr("cast(try_to_timestamp(game_date) as date)")
    dated = schedule.withColumn("_day", day).where("_day is not null")
    low, high = F.make_date(F.col("season").cast("int") - 1, F.lit(8), F.lit(1)), F.make_date(F.col("season").cast("int"), F.lit(9), F.lit(30))
    return _result("dates_in_season", _named(dated.where(~F.col("_day").between(low, high)), "game_id"), dated)


def agreement(schedule: DataFrame, pbp: DataFrame) -> DataFrame:
    """``coverage`` as one result: how many games miss on either side, and which."""
    both = coverage(schedule, pbp)
    text = F.array_join(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.concat(F.replace("check", F.lit("_"), F.lit(" ")), F.lit(": "), "detail")))), "; ")
    return _result("schedule_and_events_agree", both.agg(F.sum("n").alias("n"), text.alias("detail")))


DUPLICATE_CHECKED = ("schedules", "player_box", "team_box")


def validate_season(spark: SparkSession, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """The seven results of a season, (check, status, n, detail), in their order as ``place``.

    tables: by dataset, schedules, play_by_play, player_box and team_box. A check whose table is absent or None, or lacks a column
    that it reads, is skipped, which is not passed; all others run, also after one fails.
    """
    results = []

    def check(name: str, run, **needs: tuple[str, ...]) -> None:
        given = {d: tables.get(d) for d in needs}
        absent = [d for d, t in given.items() if t is None]
        lacking = [f"{d}.{c}" for d, t in given.items() if t is not None for c in needs[d] if c not in t.columns]
        if absent:
            results.append(skipped(spark, name, f"{' and '.join(absent)} not given"))
        elif lacking:
            results.append(skipped(spark, name, f"no column {', '.join(lacking)}"))
        else:
            results.append(run(*given.values()))

    check("schedule_and_events_agree", agreement, schedules=("game_id",), play_by_play=("game_id",))
    check("teams_match", teams_match, schedules=("game_id", "home_id", "away_id"), play_by_play=("game_id", "home_team_id", "away_team_id", "game_play_number"))
    check("events_in_order", events_in_order, play_by_play=("game_id", "period", "game_play_number"))
    check("dates_in_season", dates_in_season, schedules=("game_id", "game_date", "season"))
    for dataset in DUPLICATE_CHECKED:
        check(f"no_duplicates_{dataset}", lambda t, d=dataset: no_duplicates(t, d), **{dataset: SCHEMAS[dataset].key})
    return reduce(DataFrame.unionByName, [r.withColumn("place", F.lit(k)) for k, r in enumerate(results)])


def summarise(results: DataFrame) -> DataFrame:
    """How many checks passed, failed and were skipped; skipped is not passed."""
    return results.groupBy("status").agg(F.count("*").alias("checks"))


def summary_text(results: DataFrame) -> str:
    """A line of counts, then one line a check in their order."""
    rows = results.orderBy("place").collect()  # a row a check
    counts = [f"{n} {status}" for status in ("passed", "failed", "skipped") if (n := sum(r.status == status for r in rows))]
    return "\n".join([f"{len(rows)} checks: {', '.join(counts)}", *[f"  [{r.status:7s}] {r.check}: {r.detail}".rstrip(": ") for r in rows]])
