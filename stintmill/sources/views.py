"""Event, box-score, schedule and line-up views over the driver's star schema.

The SQL is plain enough for Spark and DuckDB to read alike, so an oracle starts from the same rows.
``{name}`` stands for a table. Counting columns are whole numbers, so sums are exact in any order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "box": """
        SELECT l_orderkey AS game_id, CAST(year(l_shipdate) AS BIGINT) AS season, l_shipdate AS game_date,
               l_suppkey AS athlete_id, CAST(s_nationkey AS BIGINT) AS team_id,
               'Player ' || CAST(CASE WHEN l_suppkey % 10 = 7 THEN l_suppkey - 1 ELSE l_suppkey END AS STRING) AS athlete_display_name,
               CASE WHEN l_linestatus = 'O' THEN 2 ELSE 3 END AS season_type,
               l_returnflag = 'R' AND l_quantity < 5 AS did_not_play,
               l_linenumber AS line, l_partkey AS part,
               CAST(l_quantity AS DOUBLE) AS minutes,
               CAST(l_partkey % 7 AS DOUBLE) AS field_goals_made,
               CAST(l_partkey % 17 + 3 AS DOUBLE) AS field_goals_attempted,
               CAST(l_orderkey % 4 AS DOUBLE) AS three_point_field_goals_made,
               CAST(l_orderkey % 4 + l_partkey % 5 AS DOUBLE) AS three_point_field_goals_attempted,
               CAST(CASE WHEN l_linenumber > l_partkey % 3 THEN l_linenumber - l_partkey % 3 ELSE 0 END AS DOUBLE) AS free_throws_made,
               CAST(l_linenumber AS DOUBLE) AS free_throws_attempted,
               CAST(l_orderkey % 3 AS DOUBLE) AS offensive_rebounds,
               CAST(l_partkey % 6 AS DOUBLE) AS defensive_rebounds,
               CAST(l_orderkey % 3 + l_partkey % 6 AS DOUBLE) AS rebounds,
               CAST(l_partkey % 8 AS DOUBLE) AS assists,
               CAST(l_orderkey % 5 AS DOUBLE) AS steals,
               CAST(l_partkey % 4 AS DOUBLE) AS blocks,
               CAST(l_orderkey % 6 AS DOUBLE) AS turnovers,
               CAST(l_linenumber % 6 AS DOUBLE) AS fouls,
               CAST(floor(l_extendedprice / 1000) AS DOUBLE) AS points
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "pbp": """
        SELECT user_id AS game_id, CAST(2000 + user_id % 5 AS BIGINT) AS season,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS game_play_number,
               event_id, CAST(1 + event_id % 4 AS BIGINT) AS period, CAST(event_id % 14 AS BIGINT) AS clock_minutes, CAST(value AS DOUBLE) AS clock_seconds,
               CAST(user_id % 25 AS BIGINT) AS home_team_id, CAST((user_id + 1 + event_id % 24) % 25 AS BIGINT) AS away_team_id,
               CASE event_type
                 WHEN 'error' THEN 'Free Throw - ' ||
                   CASE WHEN event_id % 11 = 0 THEN 'Technical'
                        ELSE CASE WHEN event_id % 13 = 0 THEN 'Flagrant ' WHEN event_id % 17 = 0 THEN 'Clear Path ' ELSE '' END
                             || CAST(1 + (event_id % 7) % (1 + event_id % 3) AS STRING) || ' of ' || CAST(1 + event_id % 3 AS STRING) END
                 WHEN 'purchase' THEN 'Defensive Rebound' WHEN 'signup' THEN 'Offensive Rebound'
                 WHEN 'click' THEN 'Jump Shot' ELSE 'Substitution' END AS type_text,
               value > 20 AS scoring_play, event_type IN ('error', 'click') AS shooting_play
        FROM {events}""",
    "event_feed": """
        SELECT user_id AS game_id, CASE WHEN event_id % 71 = 0 THEN 0 ELSE CAST(1 + event_id % 4 AS BIGINT) END AS period,
               CAST(CASE WHEN event_id % 83 = 0 THEN 'overtime' WHEN event_id % 79 = 0 THEN '0' ELSE CAST(1 + event_id % 4 AS STRING) END AS STRING) AS period_number,
               'Q' || CAST(1 + event_id % 4 AS STRING) AS period_display_value, CAST(event_id % 14 AS STRING) || ':00' AS clock_display_value,
               CAST(event_id % 14 AS BIGINT) AS clock_minutes, CAST(value AS DOUBLE) AS clock_seconds, CAST(ts AS STRING) AS wallclock,
               CASE WHEN event_id % 61 = 0 THEN NULL ELSE CAST(event_id % 40 AS BIGINT) END AS type_id, CAST(user_id % 25 AS BIGINT) AS team_id,
               event_id % 500 AS athlete_id_1, event_id % 501 AS athlete_id_2, CASE WHEN event_id % 59 = 0 THEN 'nobody' ELSE CAST(event_id % 502 AS STRING) END AS athlete_id_3,
               'P' || CAST(event_id % 500 AS STRING) AS athlete_name_1, CAST(NULL AS STRING) AS athlete_name_2, CAST(NULL AS STRING) AS athlete_name_3,
               CAST(event_id % 50 AS DOUBLE) AS coordinate_x, CAST(event_id % 94 AS DOUBLE) AS coordinate_y, CAST(event_id % 50 AS DOUBLE) AS coordinate_x_raw,
               CASE WHEN event_id % 67 = 0 THEN '?' ELSE CAST(event_id % 94 AS STRING) END AS coordinate_y_raw,
               CAST(user_id % 25 AS BIGINT) AS home_team_id, 'H' || CAST(user_id % 25 AS STRING) AS home_team_name, CAST(NULL AS STRING) AS home_team_mascot,
               CASE WHEN event_id % 53 = 0 THEN NULL ELSE 'H' END AS home_team_abbrev, CAST(NULL AS STRING) AS home_team_name_alt,
               CASE WHEN event_id % 47 = 0 THEN NULL ELSE CAST((user_id + 1) % 25 AS BIGINT) END AS away_team_id, CASE WHEN event_id % 43 = 0 THEN NULL ELSE 'A' END AS away_team_name,
               CAST(NULL AS STRING) AS away_team_mascot, 'A' AS away_team_abbrev, CAST(NULL AS STRING) AS away_team_name_alt, CAST(event_id % 9 AS DOUBLE) AS home_team_spread
        FROM {events}""",
    "shots": """
        SELECT user_id AS player_id, CASE WHEN event_id % 37 = 0 THEN NULL ELSE CAST(user_id % 20 + event_id % 30 AS DOUBLE) END AS x, CAST(event_id % 47 AS DOUBLE) * 2 AS y,
               CASE WHEN value > 20 THEN CAST(2 + event_id % 2 AS BIGINT) ELSE 0 END AS points
        FROM {events} WHERE event_type IN ('click', 'error')""",
    "sched": """
        SELECT o_orderkey AS game_id, CAST(year(o_orderdate) AS BIGINT) AS season,
               CASE WHEN o_orderkey % 97 = 0 THEN 'unknown' WHEN o_orderkey % 89 = 0 THEN '1900-01-01'
                    ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS game_date,
               CAST(o_custkey % 25 AS BIGINT) AS home_id, CAST((o_custkey + o_orderkey % 25) % 25 AS BIGINT) AS away_id,
               CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderstatus <> 'P' END AS status_type_completed
        FROM {orders}""",
    "stints": """
        SELECT CAST(o_custkey AS STRING) AS game_id, CAST(year(o_orderdate) AS BIGINT) AS season,
               CAST(o_custkey % 25 AS BIGINT) AS offense_team_id, CAST((o_custkey + 1 + o_orderkey % 24) % 25 AS BIGINT) AS defense_team_id,
               CAST((o_orderkey + 0 * s) % 40 AS STRING) || '-' || CAST((o_orderkey + 1 * s) % 40 AS STRING) || '-' || CAST((o_orderkey + 2 * s) % 40 AS STRING)
                 || '-' || CAST((o_orderkey + 3 * s) % 40 AS STRING) || CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE '-' || CAST((o_orderkey + 4 * s) % 40 AS STRING) END AS offense_lineup,
               CAST((o_orderkey + 5 * s) % 40 AS STRING) || '-' || CAST((o_orderkey + 6 * s) % 40 AS STRING) || '-' || CAST((o_orderkey + 7 * s) % 40 AS STRING)
                 || '-' || CAST((o_orderkey + 8 * s) % 40 AS STRING) || '-' || CAST((o_orderkey + 9 * s) % 40 AS STRING) AS defense_lineup,
               CAST(o_orderkey % 16 AS DOUBLE) AS possessions, CAST(floor(o_totalprice / 20000) AS DOUBLE) AS points, CAST(o_orderkey % 3 AS DOUBLE) AS opponent_points
        FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 9 END AS s FROM {orders}) o""",
    "possession_stats": """
        SELECT CAST(o_custkey AS STRING) AS game_id, o_orderkey AS possession_no, k AS stat_no,
               CASE WHEN k = 0 AND o_orderkey % 9 <> 0 THEN 'OffPoss' WHEN k = 3 THEN 'Other' ELSE 'OpponentPoints' END AS stat_key,
               CAST((o_orderkey + k) % 4 AS BIGINT) AS stat_value,
               CAST(o_custkey % 25 AS BIGINT) AS team_id,
               CAST(CASE WHEN k = 4 THEN (o_custkey + 1) % 25 ELSE o_custkey % 25 END AS BIGINT) AS opponent_team_id,
               CAST(o_orderkey % 2 AS STRING) || '-2-3-4-5' AS lineup_id, CAST(10 + k % 2 AS STRING) || '-12-13-14-15' AS opponent_lineup_id
        FROM {orders} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) ks""",
    "external_stints": """
        SELECT CAST(o_custkey AS STRING) AS game_id, CAST(o_orderkey % 40 AS STRING) || '_1_2_3_4' AS home_lineup, CAST(o_orderkey % 7 AS STRING) || '_6_7_8_9' AS away_lineup,
               CAST(1 + o_orderkey % 9 AS BIGINT) AS n_pos, CAST(o_orderkey % 11 AS BIGINT) AS home_points, CAST(o_orderkey % 13 AS BIGINT) AS away_points
        FROM {orders}""",
    "people_a": """
        SELECT c_custkey AS athlete_id, CAST(2000 + c_custkey % 3 AS BIGINT) AS season,
               CASE c_custkey % 6 WHEN 0 THEN 'José' WHEN 1 THEN 'Nikola' WHEN 2 THEN 'D.J.' WHEN 3 THEN 'Marcelinho' WHEN 4 THEN 'De''Aaron' ELSE 'Luka' END || ' ' ||
               CASE c_custkey % 5 WHEN 0 THEN 'Núñez' WHEN 1 THEN 'Jokić' WHEN 2 THEN 'Smith-Jones' WHEN 3 THEN 'Huertas' ELSE 'Payton' END || CAST(c_custkey % 40 AS STRING) ||
               CASE c_custkey % 4 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' II' ELSE '' END AS athlete_display_name
        FROM {customer}""",
    "people_seasons": """
        SELECT c_custkey AS athlete_id, CAST(2000 + k AS BIGINT) AS season,
               CASE c_custkey % 6 WHEN 0 THEN 'José' WHEN 1 THEN 'Nikola' WHEN 2 THEN 'D.J.' WHEN 3 THEN 'Marcelinho' WHEN 4 THEN 'De''Aaron' ELSE 'Luka' END || ' ' ||
               CASE c_custkey % 5 WHEN 0 THEN 'Núñez' WHEN 1 THEN 'Jokić' WHEN 2 THEN 'Smith-Jones' WHEN 3 THEN 'Huertas' ELSE 'Payton' END || CAST((c_custkey + 6 * (k % 2)) % 40 AS STRING) ||
               CASE (c_custkey + k) % 4 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' II' ELSE '' END AS athlete_display_name
        FROM {customer} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks""",
    "people_b": """
        SELECT s_suppkey AS nba_id, s_suppkey % 3 <> 0 AS played,
               CASE s_suppkey % 6 WHEN 0 THEN 'Jose' WHEN 1 THEN 'Nikola' WHEN 2 THEN 'DJ' WHEN 3 THEN 'Marcelo' WHEN 4 THEN 'DeAaron' ELSE 'Luka' END || ' ' ||
               CASE s_suppkey % 5 WHEN 0 THEN 'Nunez' WHEN 1 THEN 'Jokic' WHEN 2 THEN 'Smith Jones' WHEN 3 THEN 'Huertas' ELSE 'Payton' END || CAST(s_suppkey % 40 AS STRING) ||
               CASE WHEN s_suppkey % 8 = 0 THEN ' Jr' ELSE '' END AS name
        FROM {supplier}""",
    "ratings": """
        SELECT o_custkey % 500 AS player_id, 'Player ' || CAST(o_custkey % 300 AS STRING) AS player, CAST(year(o_orderdate) AS BIGINT) AS window_end,
               CAST(1 + o_custkey % 3 AS BIGINT) AS seasons_played, CAST(sum(o_orderkey % 100) AS DOUBLE) AS possessions,
               CAST(sum(o_orderkey % 21) - 10 * count(*) AS DOUBLE) AS offensive, CAST(sum(o_orderkey % 11) - 5 * count(*) AS DOUBLE) AS defensive,
               CAST(sum(o_orderkey % 21 + o_orderkey % 11) - 15 * count(*) AS DOUBLE) AS total
        FROM {orders} GROUP BY o_custkey % 500, 'Player ' || CAST(o_custkey % 300 AS STRING), year(o_orderdate), 1 + o_custkey % 3""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, dealt: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """One of the views as a DataFrame; dealt is put between each of its tables and the view."""
    return spark.sql(SQL[name], **{t: dealt(table(spark, sf_dir, t)) for t in set(re.findall(r"\{(\w+)\}", SQL[name]))})


def ctes(*names: str) -> str:
    """The views as common table expressions for an oracle."""
    return ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', SQL[n])})" for n in names)
