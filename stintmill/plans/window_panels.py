"""Queries over rolling windows: pooled metrics, ratings of every window, and the team panel that the claim is tested on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.staging import written
from ..operators import box, events, panel, windows
from ..operators.tables import rounded
from ..sources.views import ctes, view
from .boxes_and_checks import ELIGIBLE, NAMES, metric_sql
from .events_and_stints import TOLD

# The window, the penalty, and the floors of minutes and possessions.
WINDOW, ALPHA, MINUTES, POSSESSIONS = 3, 3000.0, 1000.0, 2000.0
RELIABILITY = {n: 0.9 for n in NAMES} | {"true_shooting": 0.7, "effective_fg": 0.7, "free_throw_pct": 0.75, "rating": 0.796}
SHIFT = 4  # the event logs' seasons, 2000 to 2004, stand for the box scores' 1996 to 2000


def _eligible(s, d):
    return box.eligible_rows(view(s, d, "box"))


def _measured(s, d):
    """Coefficients of the event logs under the box scores' seasons; the first and the last have none and take the pooled one."""
    found = events.coefficients(events.classify_free_throws(view(s, d, "pbp")))
    return found.select((F.col("season") - SHIFT).alias("season"), "coefficient")


def _named(s, d):
    """The metrics of every window, without games and teams: people's seasons are added up before they go to windows."""
    rows = box.added_up(box.eligible_rows(view(s, d, "box"), merge=False), NAMES)
    return windows.window_metrics(rows, WINDOW, _measured(s, d), added=True)


def _people(s, d):
    rated = windows.window_ratings(view(s, d, "stints"), ALPHA, WINDOW, POSSESSIONS)
    return windows.fusion_people(_named(s, d), rated, NAMES, minutes_floor=MINUTES)


def _box_panel(s, d):
    """The panel of box-score candidates, of everyone over the floors: nobody's rating need be known."""
    rated = windows.window_players(view(s, d, "stints"), WINDOW, POSSESSIONS).withColumn("total", F.lit(0.0))
    people = windows.fusion_people(_named(s, d), rated, NAMES, minutes_floor=MINUTES)
    return windows.team_panel(people, _eligible(s, d), view(s, d, "stints"), NAMES)


def _panel(s, d):
    """All seventeen candidates, written: what follows reads them many times."""
    people = written(_people(s, d), "window-people")
    each = people.join(windows.fused(people, (*NAMES, "rating"), RELIABILITY), ["window_end", "player_id"])
    return written(windows.team_panel(each, _eligible(s, d), view(s, d, "stints"), (*NAMES, "rating", "fused")), "window-panel")


QUERIES = {
    "window_metrics": lambda s, d: rounded(_named(s, d).select("window_end", "athlete_id", *NAMES), 9, *NAMES),
    "window_ratings": lambda s, d: windows.window_ratings(view(s, d, "stints"), ALPHA, WINDOW, POSSESSIONS),
    "window_people": lambda s, d: _people(s, d),
    "window_panel": lambda s, d: rounded(_box_panel(s, d), 6, *NAMES, "target"),
    "window_panel_rated": _panel,
    "claim_report": lambda s, d: panel.claim_report(_panel(s, d), (*NAMES, "rating", "fused"), ("rating", "fused"), ("fused", "true_shooting", "points_per_36")),
}

_METRIC = lambda n: metric_sql(n).replace("0.4178::DOUBLE", "coefficient")
_WM = f"""{ELIGIBLE}, {TOLD}, bw AS (SELECT *, unnest([{', '.join(f'season + {k}' for k in range(WINDOW))}]) AS window_end FROM el),
pw AS (SELECT window_end, athlete_id, {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in box.COUNTS)}
  FROM bw WHERE window_end <= (SELECT max(season) FROM el) AND window_end - {WINDOW - 1} >= (SELECT min(season) FROM el) GROUP BY ALL),
pc AS (SELECT pw.*, coalesce(cf.coefficient, 0.4178::DOUBLE) AS coefficient FROM pw LEFT JOIN cf ON cf.season - {SHIFT} = pw.window_end),
wm AS (SELECT window_end, athlete_id, minutes AS pooled_minutes, {', '.join(f'{_METRIC(n)} AS {n}' for n in NAMES)} FROM pc)"""
_WP = f"""{_WM},
us AS (SELECT * FROM stints WHERE possessions >= 1 AND len(string_split(offense_lineup, '-')) = 5 AND len(string_split(defense_lineup, '-')) = 5),
pl AS (SELECT season, possessions, CAST(unnest(string_split(offense_lineup || '-' || defense_lineup, '-')) AS BIGINT) AS player_id FROM us),
pe AS (SELECT window_end, player_id FROM (SELECT player_id, possessions, unnest([{', '.join(f'season + {k}' for k in range(WINDOW))}]) AS window_end FROM pl)
  WHERE window_end <= (SELECT max(season) FROM pl) AND window_end - {WINDOW - 1} >= (SELECT min(season) FROM pl) GROUP BY ALL HAVING sum(possessions) >= {POSSESSIONS:g}),
fm AS (SELECT window_end, player_id, {', '.join(NAMES)} FROM wm JOIN pe USING (window_end) WHERE wm.athlete_id = pe.player_id AND pooled_minutes >= {MINUTES:g}),
fs AS (SELECT window_end, player_id, {', '.join(f'({n} - avg({n}) OVER w) / nullif(stddev_pop({n}) OVER w, 0) AS {n}' for n in NAMES)} FROM fm WINDOW w AS (PARTITION BY window_end)),
mt AS (SELECT season, athlete_id, team_id, sum(minutes) AS minutes FROM el GROUP BY ALL),
pt AS (SELECT season, athlete_id AS player_id, team_id, minutes FROM mt QUALIFY row_number() OVER (PARTITION BY season, athlete_id ORDER BY minutes DESC, team_id) = 1),
jn AS (SELECT fs.*, pt.team_id, pt.minutes FROM fs JOIN pt ON fs.window_end = pt.season AND fs.player_id = pt.player_id WHERE minutes >= 200),
mn AS (SELECT window_end AS season, team_id, {', '.join(f'sum({n} * minutes) / sum(minutes) FILTER ({n} IS NOT NULL) AS {n}' for n in NAMES)} FROM jn GROUP BY ALL),
fo AS (SELECT season, offense_team_id AS team_id, sum(points) AS p, sum(possessions) AS n FROM stints GROUP BY ALL),
ag AS (SELECT season, defense_team_id AS team_id, sum(points) AS q, sum(possessions) AS m FROM stints GROUP BY ALL),
nt AS (SELECT season, team_id, 100 * p / nullif(n, 0) - 100 * q / nullif(m, 0) AS net FROM fo JOIN ag USING (season, team_id))"""

SQL = {
    "window_metrics": f"WITH {ctes('box', 'pbp')}, {_WM} SELECT window_end, athlete_id, {', '.join(f'round({n}, 9) AS {n}' for n in NAMES)} FROM wm",
    "window_panel": f"""WITH {ctes('box', 'pbp', 'stints')}, {_WP} SELECT mn.season, mn.team_id, {', '.join(f'round(mn.{n}, 6) AS {n}' for n in NAMES)}, round(nt.net, 6) AS target
        FROM mn JOIN nt ON nt.season = mn.season + 1 AND nt.team_id = mn.team_id WHERE nt.net IS NOT NULL AND coalesce({', '.join(f'mn.{n}' for n in NAMES)}) IS NOT NULL""",
}
