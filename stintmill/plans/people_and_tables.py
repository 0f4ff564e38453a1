"""Queries over identity, reliability, drift and the published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import box, drift, events, identity, reliability, ridge, tables
from ..sources.views import ctes, table, view
from .boxes_and_checks import ELIGIBLE, NAMES, metric_sql
from .events_and_stints import TOLD

DRAWS, FLOOR = 100, 500.0
PROFILED = NAMES


def _eligible(s, d):
    return box.eligible_rows(view(s, d, "box"))


def _halves(s, d, rule="random"):
    rows = reliability.measured(_eligible(s, d), FLOOR).select("season", "athlete_id", *reliability.ROW_KEY, *(["game_date"] if rule != "random" else []))
    return reliability.assign_halves(rows, rule, DRAWS)


def _correlations(s, d):
    return reliability.drawn_correlations(reliability.measured(_eligible(s, d), FLOOR), "random", DRAWS, PROFILED)


def _season_table(s, d, rule="random"):
    out = reliability.measure(_eligible(s, d), rule, DRAWS, FLOOR, PROFILED)
    return tables.rounded(out, 6, "rho_half", "rho_half_sd", "rho_half_spearman", "games_per_half", "reliability_at_observed_length", "reliability_at_82_games", "traded_share")


def _both_rules(s, d):
    rows = _eligible(s, d)
    return reliability.measure(rows, "random", DRAWS, FLOOR, PROFILED).unionByName(reliability.measure(rows, "odd_even", DRAWS, FLOOR, PROFILED))


def _crosswalk(s, d):
    return identity.crosswalk(view(s, d, "people_a"), view(s, d, "people_b"))


def _teams(s, d):
    ours = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") % 5 == 0, "GSW").when(F.col("n_nationkey") % 7 == 1, "UTA").otherwise(F.col("n_name")).alias("code"))
    theirs = table(s, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("other_id")).select("other_id", F.when(F.col("s_nationkey") == 5, "GS").when(F.col("s_nationkey") == 8, "UTAH").otherwise(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))).alias("code"))
    return identity.team_crosswalk(ours, theirs)


def _profile(s, d):
    wide = box.with_metrics(box.totals(_eligible(s, d), ("season", "athlete_id")), only=PROFILED).withColumn("rating", F.col("games") * 1.0 + F.col("assists") / 100)
    rel = reliability.measure(_eligible(s, d), "random", DRAWS, FLOOR, PROFILED).groupBy("metric").agg(F.avg("reliability_at_82_games").alias("reliability"))
    return tables.rounded(reliability.validity_profile(wide, "rating", PROFILED, rel), 5, "validity", "reliability", "profile")


def _rated_profile(s, d):
    """The same against each season's ridge rating."""
    wide = box.with_metrics(box.totals(_eligible(s, d), ("season", "athlete_id")), only=PROFILED)
    rated = ridge.solve_groups(ridge.gram(ridge.design(view(s, d, "stints"), 1.0, "season"), "season"), 3000.0, "season")
    both = wide.join(rated.select("season", F.col("player_id").alias("athlete_id"), F.col("total").alias("rating")), ["season", "athlete_id"])
    rel = reliability.measure(_eligible(s, d), "random", DRAWS, FLOOR, PROFILED).groupBy("metric").agg(F.avg("reliability_at_82_games").alias("reliability"))
    return reliability.validity_profile(both, "rating", PROFILED, rel)


def _psi(s, d):
    return tables.rounded(drift.drift_report(view(s, d, "ratings")), 7, "psi", "ks")


def _schedule_payloads(s, d):
    row = F.to_json(F.struct(F.array(F.struct(F.struct(F.collect_list(F.struct(F.concat(F.when(F.col("o_orderkey") % 10 == 0, "001").otherwise("002"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("gid"))).alias("g")).alias("mscd"))).alias("lscd")))
    return table(s, d, "orders").groupBy("o_custkey").agg(row.alias("json"))


def _payloads(s, d):
    body = F.when(F.col("event_id") % 4 == 0, '{"g": {"gid": "1", "pd": []}}').when(F.col("event_id") % 4 == 1, '{"g": {"gid": "1", "pd": [{"p": 1}]}}').when(F.col("event_id") % 4 == 2, "{broken").otherwise('{"lscd": [{"mscd": {"g": []}}]}')
    return table(s, d, "events").select(F.col("event_id").alias("name"), body.alias("json"))


def _with_coefficient(s, d):
    # the logs' seasons 2000 to 2004 stand for 1995 to 1999: those before and after have no measured coefficient
    measured = events.coefficients(events.classify_free_throws(view(s, d, "pbp"))).withColumn("season", F.col("season") - 5)
    rows = tables.with_coefficient(view(s, d, "box").select("season").distinct(), measured)
    return tables.rounded(rows, 9, "coefficient")


QUERIES = {
    "normalise_names": lambda s, d: view(s, d, "people_a").select(
        "athlete_id",
        identity.normalise(F.col("athlete_display_name")).alias("plain"),
        identity.normalise(F.col("athlete_display_name"), True).alias("bare"),
        identity.initial_key(identity.normalise(F.col("athlete_display_name"), True)).alias("initial"),
    ),
    "crosswalk": _crosswalk,
    "crosswalk_rates": lambda s, d: tables.rounded(identity.match_rates(_crosswalk(s, d)), 9, "match_rate"),
    "window_crosswalk": lambda s, d: identity.window_crosswalk(identity.crosswalk(view(s, d, "people_seasons"), view(s, d, "people_b"), ("season",))),
    "team_crosswalk": _teams,
    "season_labels": lambda s, d: view(s, d, "box").select("season").distinct().select("season", identity.season_label(F.col("season") - 1).alias("label")),
    "assign_halves": lambda s, d: _halves(s, d).groupBy("season", "draw", "athlete_id").agg(F.count(F.when(F.col("half") == 0, 1)).alias("h0"), F.count(F.when(F.col("half") == 1, 1)).alias("h1"), F.sum(F.when(F.col("half") == 0, F.col("minutes"))).alias("m0")),
    "draw_correlations": lambda s, d: tables.rounded(_correlations(s, d), 6, "rho", "spearman", "games_per_half"),
    "reliability_season": _season_table,
    "reliability_query": lambda s, d: tables.reliability_query(_season_table(s, d, "odd_even"), 1998, "odd_even"),
    "reliability_odd_even": lambda s, d: _season_table(s, d, "odd_even"),
    "reliability_curve": lambda s, d: tables.rounded(reliability.curve(_eligible(s, d), "points_per_36", (200.0, 800.0, 1100.0), DRAWS), 6, "rho_half", "games_per_half"),
    "reliability_pooled": lambda s, d: tables.rounded(reliability.pooled_reliability(_both_rules(s, d)), 6, "reliability"),
    "rule_differences": lambda s, d: tables.rounded(reliability.rule_differences(_both_rules(s, d)), 6, "mean_difference", "greatest_difference"),
    "validity_profile": _profile,
    "validity_profile_rated": _rated_profile,
    "drift_report": _psi,
    "top_rated": lambda s, d: tables.top_rated(view(s, d, "ratings"), 25),
    "rating_query": lambda s, d: tables.rating_query(view(s, d, "ratings"), 1998, 100.0),
    "player_history": lambda s, d: tables.history(view(s, d, "ratings"), 7),
    "serving_health": lambda s, d: tables.serving_health(view(s, d, "ratings")),
    "compare_players": lambda s, d: tables.compare_players(view(s, d, "ratings"), ["Player 1", "Player 2", "Player 3"]),
    "axis_labels": lambda s, d: tables.axis_labels(view(s, d, "ratings")).select("player_id", "window_end", "label"),
    "signed_split": lambda s, d: tables.signed_split(view(s, d, "ratings"), "total").select("player_id", "window_end", "total", "total_up", "total_down"),
    "latest_rows": lambda s, d: tables.latest_rows(view(s, d, "ratings")),
    "partial_windows": lambda s, d: tables.partial_windows(view(s, d, "ratings")),
    "season_ranges": lambda s, d: tables.season_ranges(view(s, d, "stints"), ("game_id",)),
    "precision_view": lambda s, d: tables.precision_view(view(s, d, "ratings")),
    "schedule_games": lambda s, d: tables.schedule_games(_schedule_payloads(s, d)),
    "payload_validity": lambda s, d: tables.payload_validity(_payloads(s, d)),
    "coefficient_lookup": _with_coefficient,
    "fingerprint": lambda s, d: drift.fingerprint(view(s, d, "ratings")),
    "long_to_wide": lambda s, d: tables.long_to_wide(
        view(s, d, "ratings").unpivot(["player_id", "window_end"], ["offensive", "defensive"], "side", "value"), ("player_id", "window_end"), "side", "value", ["offensive", "defensive"]
    ),
}

_N = lambda c: f"trim(regexp_replace(replace(replace(replace(lower(strip_accents({c})), '.', ''), '''', ''), '-', ' '), '\\s+', ' ', 'g'))"
_B = lambda c: f"trim(regexp_replace(regexp_replace({_N(c)}, '\\b(jr|sr|ii|iii|iv|v)\\b', '', 'g'), '\\s+', ' ', 'g'))"
_I = lambda c: f"CASE WHEN len(string_split({_B(c)}, ' ')) < 2 THEN {_B(c)} ELSE string_split({_B(c)}, ' ')[-1] || ' ' || left({_B(c)}, 1) END"


def _cross(people, within=""):
    w = f"{within}, " if within else ""
    on = f"USING ({w}athlete_id)"
    return f"""pk AS (SELECT {w}athlete_id, unnest([0, 1, 2]) AS p, unnest([{_N('athlete_display_name')}, {_B('athlete_display_name')}, {_I('athlete_display_name')}]) AS key FROM {people}),
bk AS (SELECT nba_id, played, unnest([0, 1, 2]) AS p, unnest([{_N('name')}, {_B('name')}, {_I('name')}]) AS key FROM people_b),
fd AS (SELECT {w}athlete_id, p, count(*) FILTER (played) AS here, min(nba_id) FILTER (played) AS nba_id FROM pk JOIN bk USING (p, key) GROUP BY ALL),
bs AS (SELECT {w}athlete_id, min(p) FILTER (here = 1) AS p, arg_min(nba_id, p) FILTER (here = 1) AS nba_id FROM fd GROUP BY ALL),
cw AS (SELECT {w}athlete_id, athlete_display_name AS name, nba_id, ['exact', 'suffix', 'initial'][p + 1] AS pass,
  CASE WHEN p IS NOT NULL THEN 'matched' WHEN bs.athlete_id IS NOT NULL THEN 'ambiguous' ELSE 'unmatched' END AS status FROM {people} pa LEFT JOIN bs {on})"""


def _halved(rule, draws=DRAWS, floor=FLOOR):
    each = f"unnest(range(1, {draws + 1}))" if rule == "random" else "unnest([1])"
    key = "md5('20260910|' || draw || '|' || athlete_id || '|' || game_id || '|' || line || '|' || part || '|' || minutes || '|' || points)" if rule == "random" else "game_date"
    names = ", ".join(f"sum({c}) AS {c}" for c in box.COUNTS)
    return f"""{ELIGIBLE},
en AS (SELECT season, athlete_id, sum(minutes) AS whole FROM el GROUP BY ALL HAVING sum(minutes) >= {floor}),
us AS (SELECT el.*, whole FROM el JOIN en USING (season, athlete_id)),
dr AS (SELECT *, {each} AS draw FROM us),
hv AS (SELECT *, row_number() OVER (PARTITION BY season, draw, athlete_id ORDER BY {key}, game_id, line, part, minutes, points) % 2 AS half FROM dr),
ht AS (SELECT season, draw, athlete_id, half, whole, {names}, count(DISTINCT game_id) AS games FROM hv GROUP BY ALL)"""


def _pairs_sql(rule, names=PROFILED, **kw):
    lm = " UNION ALL ".join(f"SELECT season, draw, athlete_id, half, whole, games, '{n}' AS metric, {metric_sql(n)} AS value FROM ht" for n in names)
    return f"""{_halved(rule, **kw)}, lm AS ({lm}),
pa AS (SELECT season, draw, metric, athlete_id, whole, max(value) FILTER (half = 0) AS a, max(value) FILTER (half = 1) AS b, avg(games) AS games FROM lm GROUP BY ALL
  HAVING max(value) FILTER (half = 0) IS NOT NULL AND max(value) FILTER (half = 1) IS NOT NULL)"""


def _drawn(rule):
    return f"""{_pairs_sql(rule)},
rk AS (SELECT *, rank() OVER (PARTITION BY season, draw, metric ORDER BY a) + (count(*) OVER (PARTITION BY season, draw, metric, a) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY season, draw, metric ORDER BY b) + (count(*) OVER (PARTITION BY season, draw, metric, b) - 1) / 2 AS rb FROM pa),
dc AS (SELECT season, draw, metric, corr(a, b) AS rho, avg(games) AS games_per_half, count(*) AS players, corr(ra, rb) AS spearman FROM rk GROUP BY ALL HAVING count(*) >= 3),
sm AS (SELECT season, metric, avg(rho) AS rho_half, coalesce(stddev_samp(rho), 0) AS rho_half_sd, avg(spearman) AS rho_half_spearman, avg(games_per_half) AS games_per_half,
  CAST(floor(avg(players)) AS BIGINT) AS players, count(rho) AS draws_used FROM dc GROUP BY ALL),
tr AS (SELECT season, avg(CASE WHEN t > 1 THEN 1.0::DOUBLE ELSE 0 END) AS traded_share FROM (SELECT season, athlete_id, count(DISTINCT team_id) AS t FROM us GROUP BY ALL) GROUP BY ALL),
st AS (SELECT sm.*, least(0.9999::DOUBLE, 2 * rho_half / (1 + rho_half)) AS reliability_at_observed_length,
  least(0.9999::DOUBLE, (82 / games_per_half) * rho_half / (1 + (82 / games_per_half - 1) * rho_half)) AS reliability_at_82_games, traded_share, '{rule}' AS rule FROM sm JOIN tr USING (season))"""


_ST = "season, metric, players, draws_used, rule, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("rho_half", "rho_half_sd", "rho_half_spearman", "games_per_half", "reliability_at_observed_length", "reliability_at_82_games", "traded_share")
)


def _drift(c):
    return f"""SELECT '{c}' AS "column", 1995 AS reference_window, 2001 AS comparison_window, round(psi, 7) AS psi, round(ks, 7) AS ks, rn AS reference_n, cn AS comparison_n,
      CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'watch' ELSE 'shifted' END AS verdict FROM (
      WITH x AS (SELECT window_end = (SELECT max(window_end) FROM ratings) AS side, {c} AS x FROM ratings WHERE window_end IN ((SELECT min(window_end) FROM ratings), (SELECT max(window_end) FROM ratings))),
      e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM x WHERE NOT side),
      b AS (SELECT side, x, len(list_filter(e[2:len(e) - 1], lambda v: v <= x)) AS bin FROM x, e),
      g AS (SELECT bin, count(*) FILTER (NOT side) AS a, count(*) FILTER (side) AS b FROM b GROUP BY bin),
      s AS (SELECT a / sum(a) OVER () + 1e-6 AS p, b / sum(b) OVER () + 1e-6 AS q FROM g),
      v AS (SELECT x, count(*) FILTER (NOT side) AS a, count(*) FILTER (side) AS b FROM x GROUP BY x),
      k AS (SELECT abs(sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER ()) AS d FROM v)
      SELECT (SELECT sum((q - p) * ln(q / p)) FROM s) AS psi, (SELECT max(d) FROM k) AS ks, (SELECT CAST(sum(a) AS BIGINT) FROM v) AS rn, (SELECT CAST(sum(b) AS BIGINT) FROM v) AS cn)"""


_DRIFT = " UNION ALL ".join(f"({_drift(c)})" for c in ("offensive", "defensive", "total")).replace("1995 AS reference", "(SELECT min(window_end) FROM ratings) AS reference").replace("2001 AS comparison", "(SELECT max(window_end) FROM ratings) AS comparison")
_R = f"WITH {ctes('ratings')}"

SQL = {
    "normalise_names": f"WITH {ctes('people_a')} SELECT athlete_id, {_N('athlete_display_name')} AS plain, {_B('athlete_display_name')} AS bare, {_I('athlete_display_name')} AS initial FROM people_a",
    "crosswalk": f"WITH {ctes('people_a', 'people_b')}, {_cross('people_a')} SELECT * FROM cw",
    "crosswalk_rates": f"""WITH {ctes('people_a', 'people_b')}, {_cross('people_a')} SELECT count(*) AS people, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (pass = 'exact') AS exact,
        count(*) FILTER (pass = 'suffix') AS suffix, count(*) FILTER (pass = 'initial') AS initial, count(*) FILTER (status = 'ambiguous') AS ambiguous,
        count(*) FILTER (status = 'unmatched') AS unmatched, round(count(*) FILTER (status = 'matched') / count(*), 9) AS match_rate FROM cw""",
    "window_crosswalk": f"WITH {ctes('people_seasons', 'people_b')}, {_cross('people_seasons', 'season')} SELECT athlete_id, arg_max(nba_id, season) AS nba_id FROM cw WHERE status = 'matched' GROUP BY athlete_id",
    "season_labels": f"WITH {ctes('box')} SELECT DISTINCT season, CAST(season - 1 AS VARCHAR) || '-' || lpad(CAST(season % 100 AS VARCHAR), 2, '0') AS label FROM box",
    "team_crosswalk": """WITH a AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'GS' WHEN n_nationkey % 7 = 1 THEN 'UTAH' ELSE n_name END AS code FROM nation),
        b AS (SELECT min(s_suppkey) AS other_id, CASE WHEN s_nationkey = 5 THEN 'GS' WHEN s_nationkey = 8 THEN 'UTAH' ELSE 'NATION_' || s_nationkey END AS code FROM supplier GROUP BY s_nationkey)
        SELECT id, other_id FROM a JOIN b USING (code)""",
    "assign_halves": f"WITH {ctes('box')}, {_halved('random')} SELECT season, draw, athlete_id, count(*) FILTER (half = 0) AS h0, count(*) FILTER (half = 1) AS h1, sum(minutes) FILTER (half = 0) AS m0 FROM hv GROUP BY ALL",
    "draw_correlations": f"WITH {ctes('box')}, {_drawn('random')} SELECT season, draw, metric, round(rho, 6) AS rho, round(games_per_half, 6) AS games_per_half, players, round(spearman, 6) AS spearman FROM dc",
    "reliability_season": f"WITH {ctes('box')}, {_drawn('random')} SELECT {_ST} FROM st",
    "reliability_query": f"WITH {ctes('box')}, {_drawn('odd_even')} SELECT {_ST} FROM st WHERE season = 1998",
    "reliability_odd_even": f"WITH {ctes('box')}, {_drawn('odd_even')} SELECT {_ST} FROM st",
    "reliability_curve": f"""WITH {ctes('box')}, {_pairs_sql('random', ('points_per_36',), floor=200.0)}, fl AS (SELECT *, unnest([200.0::DOUBLE, 800, 1100]) AS floor FROM pa),
        dc AS (SELECT season, draw, floor, corr(a, b) AS rho, avg(games) AS g, count(*) AS n FROM fl WHERE whole >= floor GROUP BY ALL HAVING count(*) >= 3)
        SELECT season, floor, round(avg(rho), 6) AS rho_half, round(avg(g), 6) AS games_per_half, CAST(floor(avg(n)) AS BIGINT) AS players FROM dc GROUP BY ALL""",
    "reliability_pooled": f"""WITH {ctes('box')}, {_drawn('random')} SELECT metric, round(avg(reliability_at_82_games), 6) AS reliability FROM st GROUP BY ALL UNION ALL SELECT 'rating', 0.796""",
    "rule_differences": f"""WITH a AS (WITH {ctes('box')}, {_drawn('random')} SELECT season, metric, rho_half FROM st), b AS (WITH {ctes('box')}, {_drawn('odd_even')} SELECT season, metric, rho_half FROM st)
        SELECT round(avg(abs(a.rho_half - b.rho_half)), 6) AS mean_difference, round(max(abs(a.rho_half - b.rho_half)), 6) AS greatest_difference, count(*) AS compared FROM a JOIN b USING (season, metric)""",
    "validity_profile": f"""WITH {ctes('box')}, {_drawn('random')}, re AS (SELECT metric, avg(reliability_at_82_games) AS reliability FROM st GROUP BY ALL),
        tt AS (SELECT season, athlete_id, {', '.join(f'sum({c}) AS {c}' for c in box.COUNTS)}, count(DISTINCT game_id) AS games FROM el GROUP BY ALL),
        lv AS ({' UNION ALL '.join(f"SELECT '{n}' AS metric, {metric_sql(n)} AS v, games * 1.0::DOUBLE + assists / 100 AS r FROM tt" for n in PROFILED)}),
        va AS (SELECT metric, corr(v, r) AS validity FROM lv GROUP BY ALL), bo AS (SELECT * FROM va JOIN re USING (metric))
        SELECT metric, round(validity, 5) AS validity, round(reliability, 5) AS reliability, round((SELECT corr(reliability, abs(validity)) FROM bo), 5) AS profile FROM bo""",
    "drift_report": f"{_R} {_DRIFT}",
    "top_rated": f"{_R} SELECT * FROM ratings ORDER BY total DESC, player_id, window_end, player, seasons_played LIMIT 25",
    "rating_query": f"{_R} SELECT * FROM ratings WHERE window_end = 1998 AND possessions >= 100",
    "player_history": f"{_R} SELECT * FROM ratings WHERE player_id = 7",
    "serving_health": f"{_R} SELECT count(*) AS rows, min(window_end) AS first_window, max(window_end) AS last_window FROM ratings",
    "compare_players": f"""{_R} SELECT window_end, avg(total) FILTER (player = 'Player 1') AS "Player 1", avg(total) FILTER (player = 'Player 2') AS "Player 2", avg(total) FILTER (player = 'Player 3') AS "Player 3"
        FROM ratings WHERE player IN ('Player 1', 'Player 2', 'Player 3') GROUP BY window_end""",
    "axis_labels": f"""{_R}, l AS (SELECT *, player || ' (' || seasons_played || ')' AS p FROM ratings WHERE player IS NOT NULL)
        SELECT player_id, window_end, CASE WHEN count(*) OVER (PARTITION BY p) > 1 THEN p || ' to ' || window_end ELSE p END AS label FROM l""",
    "signed_split": f"{_R} SELECT player_id, window_end, total, greatest(total, 0) AS total_up, least(total, 0) AS total_down FROM ratings",
    "latest_rows": f"{_R} SELECT player_id, window_end, total, seasons_played FROM ratings QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY window_end DESC, player DESC, total DESC, seasons_played DESC) = 1",
    "partial_windows": f"{_R} SELECT count(*) FILTER (seasons_played < 3) AS partial, count(*) AS rows FROM ratings",
    "season_ranges": f"""WITH {ctes('stints')}, d AS (SELECT DISTINCT game_id, season AS s FROM stints), g AS (SELECT *, s - row_number() OVER (PARTITION BY game_id ORDER BY s) AS k FROM d)
        SELECT game_id, min(s) AS first, max(s) AS last, CASE WHEN min(s) = max(s) THEN CAST(min(s) AS VARCHAR) ELSE min(s) || '-' || max(s) END AS label FROM g GROUP BY game_id, k""",
    "precision_view": f"{_R} SELECT player, window_end, possessions, total FROM ratings WHERE player IS NOT NULL",
    "schedule_games": "SELECT DISTINCT '002' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS game_id FROM orders WHERE o_orderkey % 10 <> 0",
    "payload_validity": "SELECT event_id AS name, event_id % 4 = 1 AS valid_game, event_id % 4 = 3 AS valid_schedule FROM events",
    "long_to_wide": f"{_R} SELECT player_id, window_end, avg(offensive) AS offensive, avg(defensive) AS defensive FROM ratings GROUP BY ALL",
    "coefficient_lookup": f"""WITH {ctes('pbp', 'box')}, {TOLD}, s AS (SELECT DISTINCT season FROM box)
        SELECT s.season, round(coalesce(cf.coefficient, 0.4178::DOUBLE), 9) AS coefficient FROM s LEFT JOIN (SELECT season - 5 AS season, coefficient FROM cf) cf USING (season)""",
}
