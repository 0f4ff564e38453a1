"""Queries over box scores, and the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import box, checks
from ..sources.views import ctes, view

NAMES = (
    "points_per_36", "rebounds_per_36", "assists_per_36", "steals_per_36", "blocks_per_36", "turnovers_per_36", "fouls_per_36",
    "offensive_rebounds_per_36", "defensive_rebounds_per_36", "usage_proxy", "true_shooting", "effective_fg", "free_throw_rate",
    "three_point_rate", "free_throw_pct",
)


def _eligible(spark, sf):
    return box.eligible_rows(view(spark, sf, "box"))


def _totals(spark, sf):
    return box.totals(_eligible(spark, sf), ("season", "athlete_id"))


def _metric(name):
    return lambda s, d: box.with_metrics(_totals(s, d), only=(name,)).select("season", "athlete_id", F.round(name, 9).alias(name))


def _team_box(spark, sf):
    by_team = view(spark, sf, "box").groupBy("game_id", "season", "team_id").agg(F.sum("field_goals_made").alias("field_goals_made"), F.sum("field_goals_attempted").alias("field_goals_attempted"))
    return by_team.withColumn("field_goal_pct", 100 * F.col("field_goals_made") / F.col("field_goals_attempted"))


def _season(spark, sf):
    return {"schedules": view(spark, sf, "sched"), "play_by_play": view(spark, sf, "pbp"), "player_box": view(spark, sf, "box"), "team_box": _team_box(spark, sf)}


def _violations(dataset, frame):
    return lambda s, d: checks.report(checks.validate(frame(s, d), dataset)[1])


def _weighted(spark, sf):
    people = box.with_metrics(_totals(spark, sf), only=("points_per_36",)).withColumnRenamed("points_per_36", "value")
    teams = box.primary_team(_eligible(spark, sf)).select("season", "athlete_id", "team_id")
    out = box.weighted_mean(people.join(teams, ["season", "athlete_id"]), "value", ("season", "team_id"))
    return out.withColumn("value", F.round("value", 6))


QUERIES = {
    "eligible_rows": lambda s, d: _eligible(s, d).select("season", "game_id", "athlete_id", "team_id", "line", "part", "minutes"),
    "merged_ids": lambda s, d: box.merged_ids(box.eligible_rows(view(s, d, "box"), merge=False)),
    "athlete_totals": lambda s, d: _totals(s, d),
    "pooled_window_totals": lambda s, d: box.pooled_totals(_eligible(s, d), 3).select("window_end", "athlete_id", "minutes", "points", "games", "teams"),
    "pooled_window_metrics": lambda s, d: box.with_metrics(box.pooled_totals(_eligible(s, d), 3), only=("true_shooting", "usage_proxy")).select(
        "window_end", "athlete_id", F.round("true_shooting", 9).alias("true_shooting"), F.round("usage_proxy", 9).alias("usage_proxy")
    ),
    "long_metrics": lambda s, d: box.long_metrics(box.with_metrics(_totals(s, d)), ("season", "athlete_id")).groupBy("season", "metric").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean")
    ),
    "primary_team": lambda s, d: box.primary_team(_eligible(s, d)),
    "minutes_weighted_mean": _weighted,
    **{f"metric_{n}": _metric(n) for n in NAMES},
    "schema_play_by_play": _violations("play_by_play", lambda s, d: view(s, d, "event_feed")),
    "schema_player_box": _violations("player_box", lambda s, d: view(s, d, "box")),
    "schema_team_box": _violations("team_box", _team_box),
    "schema_schedules": _violations("schedules", lambda s, d: view(s, d, "sched")),
    "check_coverage": lambda s, d: checks.coverage(view(s, d, "sched"), view(s, d, "pbp")),
    "check_duplicates": lambda s, d: checks.no_duplicates(view(s, d, "box"), "player_box").unionByName(checks.no_duplicates(view(s, d, "sched"), "schedules")),
    "duplicate_rows": lambda s, d: checks.duplicate_rows(view(s, d, "box"), ("game_id", "athlete_id")),
    "check_teams_match": lambda s, d: checks.teams_match(view(s, d, "sched"), view(s, d, "pbp")),
    "check_event_order": lambda s, d: checks.events_in_order(view(s, d, "pbp")),
    "check_season_dates": lambda s, d: checks.dates_in_season(view(s, d, "sched")),
    "check_season": lambda s, d: checks.validate_season(s, _season(s, d)),
    "check_season_without_events": lambda s, d: checks.validate_season(s, {**_season(s, d), "play_by_play": None, "team_box": None}),
    "check_summary": lambda s, d: checks.summarise(checks.validate_season(s, _season(s, d))),
}

_COUNTS = box.COUNTS
ELIGIBLE = """
rg AS (SELECT * FROM box WHERE season_type = 2),
tg AS (SELECT season, team_id FROM rg GROUP BY ALL HAVING count(DISTINCT game_id) >= 40),
pd AS (SELECT rg.* FROM rg SEMI JOIN tg USING (season, team_id) WHERE NOT coalesce(did_not_play, true) AND coalesce(minutes, 0) > 0),
pr AS (SELECT *, min(athlete_id) OVER (PARTITION BY season, athlete_display_name) AS least FROM (SELECT DISTINCT season, athlete_id, athlete_display_name FROM pd)),
el AS (SELECT pd.* REPLACE (pr.least AS athlete_id) FROM pd JOIN pr USING (season, athlete_id, athlete_display_name))"""
_T = f"""{ELIGIBLE},
tt AS (SELECT season, athlete_id, {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in _COUNTS)}, count(DISTINCT game_id) AS games, count(DISTINCT team_id) AS teams FROM el GROUP BY ALL)"""
_C = "0.4178::DOUBLE"
FORMULAS = {
    **{n: (f"36 * {n[:-7]} / minutes", "minutes", 100) for n in NAMES[:9]},
    "usage_proxy": (f"36 * (field_goals_attempted + {_C} * free_throws_attempted + turnovers) / minutes", "minutes", 100),
    "true_shooting": (f"points / (2 * (field_goals_attempted + {_C} * free_throws_attempted))", "field_goals_attempted", 50),
    "effective_fg": ("(field_goals_made + 0.5::DOUBLE * three_point_field_goals_made) / field_goals_attempted", "field_goals_attempted", 50),
    "free_throw_rate": ("free_throws_attempted / field_goals_attempted", "field_goals_attempted", 50),
    "three_point_rate": ("three_point_field_goals_attempted / field_goals_attempted", "field_goals_attempted", 50),
    "free_throw_pct": ("free_throws_made / free_throws_attempted", "free_throws_attempted", 25),
}


def metric_sql(name):
    value, evidence, least = FORMULAS[name]
    return f"CASE WHEN {evidence} >= {least} THEN {value} END"


_W = f"""{ELIGIBLE}, bw AS (SELECT *, unnest([season, season + 1, season + 2]) AS window_end FROM el),
pw AS (SELECT window_end, athlete_id, {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in _COUNTS)}, count(DISTINCT game_id) AS games, count(DISTINCT team_id) AS teams
  FROM bw WHERE window_end <= (SELECT max(season) FROM el) AND window_end - 2 >= (SELECT min(season) FROM el) GROUP BY ALL)"""
_PT = f"""{ELIGIBLE}, mt AS (SELECT season, athlete_id, team_id, sum(minutes) AS minutes FROM el GROUP BY ALL),
pt AS (SELECT season, athlete_id, team_id, minutes FROM mt QUALIFY row_number() OVER (PARTITION BY season, athlete_id ORDER BY minutes DESC, team_id) = 1)"""


def _v(parts, source):
    return f"WITH {source} SELECT column_name, rule, value, count(*) AS times FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def _bad(table, column, rule, condition):
    return f"SELECT '{column}' AS column_name, '{rule}' AS rule, CAST({column} AS VARCHAR) AS value FROM {table} WHERE NOT coalesce({condition}, true)"


def _range(table, column, low=None, high=None):
    parts = ([f"{column} >= {low}"] if low is not None else []) + ([f"{column} <= {high}"] if high is not None else [])
    return _bad(table, column, f"in_range({low},{high})", " AND ".join(parts))


def _unique(table, key):
    text = " || ',' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"SELECT '{'+'.join(key)}', 'unique', {text} FROM (SELECT *, count(*) OVER (PARTITION BY {', '.join(key)}) AS n FROM {table}) WHERE n > 1"


_MADE = "coalesce(field_goals_made, 0) <= coalesce(field_goals_attempted, 0)"
_TB = """tb AS (SELECT game_id, season, team_id, sum(field_goals_made) AS field_goals_made, sum(field_goals_attempted) AS field_goals_attempted,
  100 * sum(field_goals_made) / sum(field_goals_attempted) AS field_goal_pct FROM box GROUP BY ALL)"""


def _list(ids, col="game_id"):
    """n and detail of a set of ids."""
    return f"""(SELECT count(*) AS n, array_to_string(list_slice(list(CAST(x AS VARCHAR) ORDER BY x), 1, 10), ', ')
        || CASE WHEN count(*) > 10 THEN ' and ' || CAST(count(*) - 10 AS VARCHAR) || ' more' ELSE '' END AS detail FROM (SELECT DISTINCT {col} AS x FROM {ids}))"""


def _check(name, ids, seen="(SELECT 1)"):
    return f"""SELECT '{name}' AS "check", CASE WHEN (SELECT count(*) FROM {seen}) = 0 THEN 'skipped' WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status, n,
        CASE WHEN n > 0 THEN detail ELSE '' END AS detail FROM {_list(ids)}"""


_SILENT = "(SELECT game_id FROM sched WHERE coalesce(status_type_completed, false) AND game_id NOT IN (SELECT game_id FROM pbp))"
_STRAY = "(SELECT game_id FROM pbp WHERE game_id NOT IN (SELECT game_id FROM sched))"
_FT = "ft AS (SELECT game_id, arg_min(home_team_id, game_play_number) AS h, arg_min(away_team_id, game_play_number) AS a FROM pbp GROUP BY ALL)"
_DIFF = "(SELECT game_id FROM sched JOIN ft USING (game_id) WHERE home_id <> h OR away_id <> a)"
_FALLS = "(SELECT game_id FROM (SELECT game_id, period, lag(period) OVER (PARTITION BY game_id ORDER BY game_play_number) AS b FROM pbp) WHERE period < b)"
_DAYS = "dd AS (SELECT *, TRY_CAST(game_date AS DATE) AS day FROM sched WHERE TRY_CAST(game_date AS DATE) IS NOT NULL)"
_OUT = "(SELECT game_id FROM dd WHERE NOT day BETWEEN make_date(season - 1, 8, 1) AND make_date(season, 9, 30))"


def _dups(name, table, key):
    return f"""SELECT '{name}' AS "check", CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status, CAST(n AS BIGINT) AS n, CASE WHEN n > 0 THEN CAST(CAST(n AS BIGINT) AS VARCHAR) || ' rows' ELSE '' END AS detail
        FROM (SELECT coalesce(sum(c), 0) AS n FROM (SELECT count(*) AS c FROM {table} GROUP BY {key} HAVING count(*) > 1))"""


_AGREE = f"""SELECT 'schedule_and_events_agree' AS "check", CASE WHEN a.n + b.n > 0 THEN 'failed' ELSE 'passed' END AS status, a.n + b.n AS n,
  CASE WHEN a.n + b.n > 0 THEN concat_ws('; ', CASE WHEN a.n > 0 THEN 'events without schedule: ' || a.detail END, CASE WHEN b.n > 0 THEN 'scheduled without events: ' || b.detail END) ELSE '' END AS detail
  FROM {_list(_STRAY)} a CROSS JOIN {_list(_SILENT)} b"""
_SKIP = lambda name, why: f"SELECT '{name}' AS \"check\", 'skipped' AS status, 0 AS n, '{why}' AS detail"
_SEVEN = [
    _AGREE,
    _check("teams_match", _DIFF, "(SELECT 1 FROM sched JOIN ft USING (game_id))"),
    _check("events_in_order", _FALLS, "pbp"),
    _check("dates_in_season", _OUT, "dd"),
    _dups("no_duplicates_schedules", "sched", "game_id"),
    _dups("no_duplicates_player_box", "box", "game_id, athlete_id"),
    _dups("no_duplicates_team_box", "tb", "game_id, team_id"),
]
_WITHOUT = [
    _SKIP("schedule_and_events_agree", "play_by_play not given"), _SKIP("teams_match", "play_by_play not given"), _SKIP("events_in_order", "play_by_play not given"),
    *_SEVEN[3:6], _SKIP("no_duplicates_team_box", "team_box not given"),
]
_IN_ORDER = lambda parts: " UNION ALL ".join(f'SELECT *, {k} AS place FROM ({p})' for k, p in enumerate(parts))
_ALL = _IN_ORDER(_SEVEN)
_SEASON = f"{ctes('sched', 'pbp', 'box')}, {_FT}, {_DAYS}, {_TB}"


def _typed(table, columns):
    """What fails to be of its type, or is null and must not be."""
    sql = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    out = []
    for c, (kind, nullable) in columns.items():
        out.append(f"SELECT '{c}' AS column_name, 'type({kind})' AS rule, CAST({c} AS VARCHAR) AS value FROM {table} WHERE TRY_CAST({c} AS {sql[kind]}) IS NULL AND {c} IS NOT NULL")
        out += [] if nullable else [f"SELECT '{c}', 'not_null', NULL FROM {table} WHERE {c} IS NULL"]
    return out


SQL = {
    "eligible_rows": f"WITH {ctes('box')}, {ELIGIBLE} SELECT season, game_id, athlete_id, team_id, line, part, minutes FROM el",
    "merged_ids": f"WITH {ctes('box')}, {ELIGIBLE} SELECT season, count(*) FILTER (least <> athlete_id) AS merged FROM pr GROUP BY ALL",
    "athlete_totals": f"WITH {ctes('box')}, {_T} SELECT * FROM tt",
    "pooled_window_totals": f"WITH {ctes('box')}, {_W} SELECT window_end, athlete_id, minutes, points, games, teams FROM pw",
    "pooled_window_metrics": f"""WITH {ctes('box')}, {_W} SELECT window_end, athlete_id, round({metric_sql('true_shooting')}, 9) AS true_shooting,
        round({metric_sql('usage_proxy')}, 9) AS usage_proxy FROM pw""",
    "long_metrics": f"WITH {ctes('box')}, {_T}, lm AS ({' UNION ALL '.join(f'''SELECT season, '{n}' AS metric, {metric_sql(n)} AS value FROM tt''' for n in NAMES)}) SELECT season, metric, count(value) AS n, round(avg(value), 6) AS mean FROM lm GROUP BY ALL",
    "primary_team": f"WITH {ctes('box')}, {_PT} SELECT * FROM pt",
    "minutes_weighted_mean": f"""WITH {ctes('box')}, {_T}, mt AS (SELECT season, athlete_id, team_id, sum(minutes) AS minutes FROM el GROUP BY ALL),
        pt AS (SELECT season, athlete_id, team_id FROM mt QUALIFY row_number() OVER (PARTITION BY season, athlete_id ORDER BY minutes DESC, team_id) = 1)
        SELECT season, team_id, round(sum(v * minutes) / sum(minutes), 6) AS value, count(*) AS people
        FROM (SELECT tt.season, pt.team_id, tt.minutes, {metric_sql('points_per_36')} AS v FROM tt JOIN pt USING (season, athlete_id)) WHERE v IS NOT NULL AND minutes >= 200 GROUP BY ALL""",
    **{f"metric_{n}": f"WITH {ctes('box')}, {_T} SELECT season, athlete_id, round({metric_sql(n)}, 9) AS {n} FROM tt" for n in NAMES},
    "schema_play_by_play": _v(
        [*_typed("event_feed", checks.SCHEMAS["play_by_play"].columns), _range("event_feed", "period", 1), _range("event_feed", "TRY_CAST(period_number AS BIGINT)", 1).replace("'TRY_CAST(period_number AS BIGINT)'", "'period_number'"),
         _range("event_feed", "clock_minutes", 0, 12), _range("event_feed", "clock_seconds", 0, 60)],
        ctes("event_feed"),
    ),
    "schema_player_box": _v(
        [_range("box", "season", 1946, 2100), *[_range("box", c, 0) for c in ("minutes", "field_goals_made", "field_goals_attempted")], _bad("box", "field_goals_made", "made_at_most_attempted", _MADE), _unique("box", ("game_id", "athlete_id"))],
        ctes("box"),
    ),
    "schema_team_box": _v(
        [_range("tb", "season", 1946, 2100), _range("tb", "field_goals_made", 0), _range("tb", "field_goals_attempted", 0), _range("tb", "field_goal_pct", 0, 100), _bad("tb", "field_goals_made", "made_at_most_attempted", _MADE), _unique("tb", ("game_id", "team_id"))],
        f"{ctes('box')}, {_TB}",
    ),
    "schema_schedules": _v([_range("sched", "season", 1946, 2100), _bad("sched", "home_id", "distinct_teams", "home_id <> away_id"), _unique("sched", ("game_id",))], ctes("sched")),
    "check_coverage": f"WITH {ctes('sched', 'pbp')} {_check('scheduled_without_events', _SILENT)} UNION ALL {_check('events_without_schedule', _STRAY)}",
    "check_duplicates": f"WITH {ctes('sched', 'box')} {_dups('no_duplicates_player_box', 'box', 'game_id, athlete_id')} UNION ALL {_dups('no_duplicates_schedules', 'sched', 'game_id')}",
    "duplicate_rows": f"WITH {ctes('box')} SELECT game_id, athlete_id, count(*) AS copies FROM box GROUP BY ALL HAVING count(*) > 1",
    "check_teams_match": f"WITH {ctes('sched', 'pbp')}, {_FT} {_check('teams_match', _DIFF, '(SELECT 1 FROM sched JOIN ft USING (game_id))')}",
    "check_event_order": f"WITH {ctes('pbp')} {_check('events_in_order', _FALLS, 'pbp')}",
    "check_season_dates": f"WITH {ctes('sched')}, {_DAYS} {_check('dates_in_season', _OUT, 'dd')}",
    "check_season": f"WITH {_SEASON} {_ALL}",
    "check_season_without_events": f"WITH {_SEASON} {_IN_ORDER(_WITHOUT)}",
    "check_summary": f"WITH {_SEASON} SELECT status, count(*) AS checks FROM ({_ALL}) GROUP BY ALL",
}
