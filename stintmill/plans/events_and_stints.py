"""Queries over event logs and stints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.staging import parts_for
from ..operators import events, shots, stints, tables
from ..sources.views import ctes, table, view


def _classified(spark, sf):
    return events.classify_free_throws(view(spark, sf, "pbp"))


def _coefficients(spark, sf):
    return events.coefficients(_classified(spark, sf))


def _possessions(spark, sf):
    return stints.possessions(view(spark, sf, "possession_stats"))


def _reconcile(spark, sf):
    """Points by team of the stints against those of the possessions: each side lacks teams of the other."""
    derived = stints.points_by_team(view(spark, sf, "stints"))
    return stints.reconcile_points(derived, stints.points_by_team(stints.stints(_possessions(spark, sf))))


def _tenure_mismatch(spark, sf):
    """Tenure's possessions against shipped ones that one player in eleven has wrong."""
    derived = stints.tenure(view(spark, sf, "stints"))
    shipped = derived.withColumn("possessions", F.when(F.col("player_id") % 11 == 0, F.col("possessions") + 1).otherwise(F.col("possessions")))
    return stints.tenure_mismatches(shipped, derived)


# How some games' payloads are broken here, by what game_id % n is.
BROKEN = {"missing": (13, 6), "cut": (7, 3), "typed": (17, 8), "empty": (11, 5), "renamed": (19, 4)}


# Possessions that a task puts into payloads. A task that only writes their rows out takes four times as many.
POSSESSIONS = 50_000


def _payloads(spark, sf):
    """Each game's possessions as one JSON text; some are broken.

    Orders are dealt before each becomes six rows, and these by game, in parts whose number grows with the orders.
    """
    n = table(spark, sf, "orders").count()
    wide, narrow = (parts_for(spark, n, size) for size in (POSSESSIONS, 4 * POSSESSIONS))
    rows = view(spark, sf, "possession_stats", lambda orders: orders.repartition(narrow, "o_orderkey")).repartition(wide, "game_id")
    one = rows.groupBy("game_id", "possession_no").agg(F.collect_list(F.struct(*stints.STAT)).alias("stats"))
    json = one.groupBy("game_id").agg(F.to_json(F.struct(F.collect_list(F.struct("possession_no", "stats")).alias("possessions"))).alias("json"))
    broken = {
        "missing": F.lit(None).cast("string"),
        "cut": F.expr("left(json, length(json) - 7)"),
        "typed": F.regexp_replace("json", '"stat_value":[0-9]+', '"stat_value":"many"'),
        "empty": F.lit('{"possessions":[]}'),
        "renamed": F.replace("json", F.lit("OffPoss"), F.lit("Held")),
    }
    text = F.col("json")
    for how in reversed(BROKEN):
        n, k = BROKEN[how]
        text = F.when(F.col("game_id").cast("long") % n == k, broken[how]).otherwise(text)
    return json.select("game_id", text.alias("json"))


QUERIES = {
    "location_values": lambda s, d: tables.rounded(shots.location_values(view(s, d, "shots")), 9, "plain", "value"),
    "shot_values": lambda s, d: tables.rounded(shots.shot_values(view(s, d, "shots")), 9, "expected", "above"),
    "shot_values_plain": lambda s, d: tables.rounded(shots.shot_values(view(s, d, "shots"), prior=0.0), 9, "expected", "above"),
    "season_stints": lambda s, d: stints.season_stints(_payloads(s, d))[0],
    "season_failures": lambda s, d: stints.season_stints(_payloads(s, d))[1].select("game_id", "reason"),
    "season_summary": lambda s, d: stints.season_summary(*stints.season_stints(_payloads(s, d))),
    "classify_free_throws": lambda s, d: _classified(s, d).where("is_free_throw").select("event_id", "is_last_of_trip", "ends_possession"),
    "possession_coefficients": lambda s, d: _coefficients(s, d).withColumns({"coefficient": F.round("coefficient", 9), "difference": F.round("difference", 9)}),
    "coefficient_summary": lambda s, d: events.coefficient_summary(_coefficients(s, d)).select(
        *[F.round(c, 9).alias(c) for c in ("least", "greatest", "spread", "mean")], "seasons"
    ),
    "number_events": lambda s, d: events.number_events(view(s, d, "pbp").withColumnRenamed("event_id", "event_num")).select("game_id", "event_num", "event_order"),
    "possession_rows": lambda s, d: _possessions(s, d),
    "game_stints": lambda s, d: stints.stints(_possessions(s, d)),
    "failed_games": lambda s, d: stints.failed_games(view(s, d, "possession_stats")),
    "points_by_team": lambda s, d: stints.points_by_team(view(s, d, "stints")),
    "reconcile_points": _reconcile,
    "possessions_by_player": lambda s, d: stints.possessions_by_player(view(s, d, "stints")),
    "dropped_stints": lambda s, d: stints.dropped_stints(view(s, d, "stints")),
    "external_stints": lambda s, d: stints.external_stints(view(s, d, "external_stints")),
    "tenure": lambda s, d: stints.tenure(view(s, d, "stints")),
    "tenure_mismatches": _tenure_mismatch,
    "team_ratings": lambda s, d: stints.team_ratings(view(s, d, "stints")).select(
        "season", "team_id", *[F.round(c, 6).alias(c) for c in ("offense", "defense", "net")], "possessions"
    ),
    "league_spread": lambda s, d: stints.league_spread(stints.team_ratings(view(s, d, "stints"))).select(
        "season", *[F.round(c, 6).alias(c) for c in ("least", "greatest", "sd")], "teams"
    ),
}

TOLD = """
t AS (SELECT *, coalesce(type_text, '') LIKE 'Free Throw%' AS is_free_throw,
  type_text LIKE 'Free Throw%Technical%' AS tech, type_text LIKE 'Free Throw%Flagrant%' OR type_text LIKE 'Free Throw%Clear Path%' AS keeps,
  TRY_CAST(regexp_extract(type_text, '(\\d+) of (\\d+)$', 1) AS INT) AS k, TRY_CAST(regexp_extract(type_text, '(\\d+) of (\\d+)$', 2) AS INT) AS n,
  lead(type_text, 1) OVER w AS l1, lead(type_text, 2) OVER w AS l2, lead(type_text, 3) OVER w AS l3, lead(type_text, 4) OVER w AS l4,
  coalesce(lead(shooting_play, 1) OVER w, false) AS s1, coalesce(lead(shooting_play, 2) OVER w, false) AS s2, coalesce(lead(shooting_play, 3) OVER w, false) AS s3
  FROM pbp WINDOW w AS (PARTITION BY game_id ORDER BY game_play_number)),
u AS (SELECT *, is_free_throw AND (tech OR coalesce(k = n, false)) AS is_last_of_trip,
  CASE WHEN l1 LIKE '%Rebound' THEN l1 LIKE 'Def%' WHEN s1 THEN NULL WHEN l2 LIKE '%Rebound' THEN l2 LIKE 'Def%' WHEN s2 THEN NULL
       WHEN l3 LIKE '%Rebound' THEN l3 LIKE 'Def%' WHEN s3 THEN NULL WHEN l4 LIKE '%Rebound' THEN l4 LIKE 'Def%' END AS told FROM t),
c AS (SELECT *, CASE WHEN NOT is_last_of_trip THEN NULL WHEN tech OR keeps OR coalesce(n = 1, false) THEN false WHEN scoring_play THEN true ELSE told END AS ends_possession FROM u),
co AS (SELECT season, count(*) FILTER (is_free_throw) AS total_attempts, count(*) FILTER (is_last_of_trip AND ends_possession IS NULL) AS unresolved,
  count(*) FILTER (is_last_of_trip AND coalesce(ends_possession, false)) AS ending_trips FROM c GROUP BY season),
cf AS (SELECT *, total_attempts - unresolved AS attempts, ending_trips / nullif(total_attempts - unresolved, 0) AS coefficient FROM co)"""
_POSS = """
f AS (SELECT game_id, possession_no, arg_min(team_id, stat_no) AS offense_team_id, arg_min(opponent_team_id, stat_no) AS defense_team_id,
  arg_min(lineup_id, stat_no) AS offense_lineup, arg_min(opponent_lineup_id, stat_no) AS defense_lineup
  FROM possession_stats WHERE stat_key = 'OffPoss' GROUP BY ALL),
p AS (SELECT game_id, possession_no, opponent_team_id AS scorer, lineup_id, opponent_lineup_id, arg_max(stat_value, stat_no) AS v
  FROM possession_stats WHERE stat_key = 'OpponentPoints' GROUP BY ALL),
po AS (SELECT f.*, CAST(coalesce(sum(v) FILTER (scorer = offense_team_id), 0) AS BIGINT) AS points, CAST(coalesce(sum(v) FILTER (scorer <> offense_team_id), 0) AS BIGINT) AS opponent_points
  FROM f LEFT JOIN p USING (game_id, possession_no) GROUP BY ALL)"""
_PLAYERS = """
v AS (SELECT * FROM stints WHERE len(string_split(offense_lineup, '-')) = 5 AND len(string_split(defense_lineup, '-')) = 5),
pl AS (SELECT season, possessions, CAST(unnest(string_split(offense_lineup || '-' || defense_lineup, '-')) AS BIGINT) AS player_id FROM v)"""
_TENURE = f"""{_PLAYERS},
ps AS (SELECT season, player_id, sum(possessions) AS possessions FROM pl GROUP BY ALL HAVING sum(possessions) > 0),
sp AS (SELECT *, unnest([season, season + 1, season + 2]) AS window_end FROM ps),
te AS (SELECT window_end, player_id, min(season) AS first_season, max(season) AS last_season, count(DISTINCT season) AS seasons_played, sum(possessions) AS possessions
  FROM sp WHERE window_end <= (SELECT max(season) FROM ps) AND window_end - 2 >= (SELECT min(season) FROM ps) GROUP BY ALL)"""
_TEAM = """
fo AS (SELECT season, offense_team_id AS team_id, sum(points) AS p, sum(possessions) AS n FROM stints GROUP BY ALL),
ag AS (SELECT season, defense_team_id AS team_id, sum(points) AS q, sum(possessions) AS m FROM stints GROUP BY ALL),
tr AS (SELECT season, team_id, 100 * p / nullif(n, 0) AS offense, 100 * q / nullif(m, 0) AS defense, 100 * p / nullif(n, 0) - 100 * q / nullif(m, 0) AS net, n + m AS possessions
  FROM fo JOIN ag USING (season, team_id))"""
_POINTS = """
pt AS (SELECT game_id, team_id, sum(points) AS points FROM (SELECT game_id, offense_team_id AS team_id, points FROM stints
  UNION ALL SELECT game_id, defense_team_id, opponent_points FROM stints) GROUP BY ALL)"""

_WHY = f"""CASE {' '.join(f"WHEN CAST(game_id AS BIGINT) % {n} = {k} THEN '{'empty' if how == 'empty' else 'uncounted' if how == 'renamed' else 'corrupt'}'" for how, (n, k) in BROKEN.items())}
  WHEN count(*) FILTER (stat_key = 'OffPoss') = 0 THEN 'uncounted' END"""
_READ = f"""{_POSS}, wy AS (SELECT game_id, {_WHY} AS reason FROM possession_stats GROUP BY game_id),
ss AS (SELECT game_id, offense_team_id, defense_team_id, offense_lineup, defense_lineup, CAST(count(*) AS DOUBLE) AS possessions, CAST(sum(points) AS DOUBLE) AS points,
  CAST(sum(opponent_points) AS DOUBLE) AS opponent_points FROM po SEMI JOIN (SELECT game_id FROM wy WHERE reason IS NULL) USING (game_id) GROUP BY ALL)"""

_BINS = """sb AS (SELECT player_id, CAST(floor(x / 2) AS BIGINT) AS bin_x, CAST(floor(y / 2) AS BIGINT) AS bin_y, count(*) AS n, CAST(sum(points) AS DOUBLE) AS s FROM shots WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
bn AS (SELECT bin_x, bin_y, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s FROM sb GROUP BY ALL),
ar AS (SELECT a.bin_x, a.bin_y, sum(b.s) / sum(b.n) AS mean FROM bn a JOIN bn b ON abs(a.bin_x - b.bin_x) <= 1 AND abs(a.bin_y - b.bin_y) <= 1 AND (a.bin_x, a.bin_y) <> (b.bin_x, b.bin_y) GROUP BY ALL),
lv AS (SELECT bn.bin_x, bn.bin_y, n AS attempts, s / n AS plain, (s + 20 * coalesce(ar.mean, (SELECT sum(s) / sum(n) FROM bn))) / (n + 20) AS value FROM bn LEFT JOIN ar USING (bin_x, bin_y))"""
_SHOT = lambda value: f"""WITH {ctes('shots')}, {_BINS}, pv AS (SELECT player_id, CAST(sum(n) AS BIGINT) AS attempts, sum(s) AS points, sum(n * {value}) / sum(n) AS expected FROM sb JOIN lv USING (bin_x, bin_y) GROUP BY ALL)
        SELECT player_id, attempts, points, round(expected, 9) AS expected, round(points / attempts - expected, 9) AS above FROM pv"""  # noqa: E731

SQL = {
    "location_values": f"WITH {ctes('shots')}, {_BINS} SELECT bin_x, bin_y, attempts, round(plain, 9) AS plain, round(value, 9) AS value FROM lv",
    "shot_values": _SHOT("value"),
    "shot_values_plain": _SHOT("plain"),
    "season_stints": f"WITH {ctes('possession_stats')}, {_READ} SELECT * FROM ss",
    "season_failures": f"WITH {ctes('possession_stats')}, {_READ} SELECT * FROM wy WHERE reason IS NOT NULL",
    "season_summary": f"WITH {ctes('possession_stats')}, {_READ} SELECT count(DISTINCT game_id) AS games, count(*) AS stints, sum(possessions) AS possessions, (SELECT count(*) FROM wy WHERE reason IS NOT NULL) AS failed FROM ss",
    "classify_free_throws": f"WITH {ctes('pbp')}, {TOLD} SELECT event_id, is_last_of_trip, ends_possession FROM c WHERE is_free_throw",
    "possession_coefficients": f"""WITH {ctes('pbp')}, {TOLD} SELECT season, total_attempts, unresolved, ending_trips, attempts,
        round(coefficient, 9) AS coefficient, round(coefficient - 0.44, 9) AS difference FROM cf""",
    "coefficient_summary": f"""WITH {ctes('pbp')}, {TOLD} SELECT round(min(coefficient), 9) AS least, round(max(coefficient), 9) AS greatest,
        round(max(coefficient) - min(coefficient), 9) AS spread, round(avg(coefficient), 9) AS mean, count(coefficient) AS seasons FROM cf""",
    "number_events": f"WITH {ctes('pbp')} SELECT game_id, event_id AS event_num, row_number() OVER (PARTITION BY game_id ORDER BY period, event_id) - 1 AS event_order FROM pbp",
    "possession_rows": f"WITH {ctes('possession_stats')}, {_POSS} SELECT * FROM po",
    "game_stints": f"""WITH {ctes('possession_stats')}, {_POSS} SELECT game_id, offense_team_id, defense_team_id, offense_lineup, defense_lineup,
        CAST(count(*) AS DOUBLE) AS possessions, CAST(sum(points) AS DOUBLE) AS points, CAST(sum(opponent_points) AS DOUBLE) AS opponent_points FROM po GROUP BY ALL""",
    "failed_games": f"""WITH {ctes('possession_stats')} SELECT game_id, count(*) AS rows FROM possession_stats GROUP BY game_id HAVING count(*) FILTER (stat_key = 'OffPoss') = 0""",
    "points_by_team": f"WITH {ctes('stints')}, {_POINTS} SELECT * FROM pt",
    "reconcile_points": f"""WITH {ctes('stints', 'possession_stats')}, {_POINTS}, {_POSS}, rf AS (SELECT game_id, team_id, CAST(sum(points) AS DOUBLE) AS reference FROM (SELECT game_id, offense_team_id AS team_id, points FROM po
        UNION ALL SELECT game_id, defense_team_id, opponent_points FROM po) GROUP BY ALL)
        SELECT game_id, team_id, pt.points AS derived, reference, pt.points IS NOT DISTINCT FROM reference AS agrees FROM pt FULL JOIN rf USING (game_id, team_id)""",
    "possessions_by_player": f"WITH {ctes('stints')}, {_PLAYERS} SELECT player_id, sum(possessions) AS possessions FROM pl GROUP BY ALL",
    "dropped_stints": f"""WITH {ctes('stints')}, g AS (SELECT possessions >= 1 AS kept, len(string_split(offense_lineup, '-')) = 5 AND len(string_split(defense_lineup, '-')) = 5 AS ok FROM stints)
        SELECT count(*) AS stints, count(*) FILTER (NOT kept) AS below_floor, count(*) FILTER (kept AND NOT ok) AS bad_lineup, count(*) FILTER (kept AND ok) AS usable FROM g""",
    "external_stints": f"""WITH {ctes('external_stints')}, e AS (SELECT game_id, replace(home_lineup, '_', '-') AS h, replace(away_lineup, '_', '-') AS a, n_pos / 2 AS possessions, home_points, away_points FROM external_stints)
        SELECT game_id, CAST(1 AS BIGINT) AS offense_team_id, CAST(2 AS BIGINT) AS defense_team_id, h AS offense_lineup, a AS defense_lineup, possessions, CAST(home_points AS DOUBLE) AS points, CAST(0 AS DOUBLE) AS opponent_points FROM e
        UNION ALL SELECT game_id, 2, 1, a, h, possessions, away_points, 0 FROM e""",
    "tenure": f"WITH {ctes('stints')}, {_TENURE} SELECT * FROM te",
    "tenure_mismatches": f"WITH {ctes('stints')}, {_TENURE} SELECT window_end, player_id, possessions + 1 AS shipped, possessions AS derived FROM te WHERE player_id % 11 = 0",
    "team_ratings": f"WITH {ctes('stints')}, {_TEAM} SELECT season, team_id, round(offense, 6) AS offense, round(defense, 6) AS defense, round(net, 6) AS net, possessions FROM tr",
    "league_spread": f"WITH {ctes('stints')}, {_TEAM} SELECT season, round(min(net), 6) AS least, round(max(net), 6) AS greatest, round(stddev(net), 6) AS sd, count(*) AS teams FROM tr GROUP BY season",
}
