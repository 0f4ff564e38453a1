"""Queries over ridge ratings, factor fusion and team panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import box, fusion, panel, ridge, stints, trees
from ..operators.tables import rounded
from ..sources.views import ctes, view
from .boxes_and_checks import ELIGIBLE, metric_sql

FUSED = ("points_per_36", "assists_per_36", "rebounds_per_36", "true_shooting", "free_throw_pct", "usage_proxy", "rating")
RELIABILITY = {"points_per_36": 0.9, "assists_per_36": 0.9, "rebounds_per_36": 0.95, "true_shooting": 0.7, "free_throw_pct": 0.75, "usage_proxy": 0.9, "rating": 0.796}
CANDIDATES = ("points_per_36", "assists_per_36", "true_shooting", "usage_proxy")
ALPHA = 3000.0


def _design(s, d, *carry):
    return ridge.design(view(s, d, "stints"), 1.0, *carry)


def _people(s, d):
    """(athlete_id, metrics) of everyone with enough minutes over all seasons."""
    wide = box.with_metrics(box.totals(box.eligible_rows(view(s, d, "box")), ("athlete_id",)), only=FUSED[:-1])
    return wide.where("minutes >= 1000").select("athlete_id", *FUSED[:-1])


def _matrix(s, d):
    """One row a person over all seasons: metrics and the ridge rating of who has one, standardised; staged in memory for the EM steps."""
    enough = stints.possessions_by_player(view(s, d, "stints")).where("possessions >= 100").select("player_id")
    rated = ridge.fit(_design(s, d), ALPHA)[1].join(enough, "player_id", "left_semi").select(F.col("player_id").alias("athlete_id"), F.col("total").alias("rating"))
    return fusion.standardise(_people(s, d).join(rated, "athlete_id", "left").select("athlete_id", *FUSED), FUSED)


def _fitted(s, d):
    wide = _matrix(s, d).cache()
    return wide, fusion.refitted(wide, "athlete_id", FUSED, RELIABILITY, "rating")


def _panel(s, d):
    rows = box.added_up(box.eligible_rows(view(s, d, "box"), merge=False), CANDIDATES)
    counts = [c for c in rows.columns if c in box.COUNTS]
    team = F.max_by("team_id", F.struct("minutes", -F.col("team_id"))).alias("team_id")
    people = rows.groupBy("season", "athlete_id").agg(team, *[F.sum(c).alias(c) for c in counts])
    out = box.weighted_means(box.with_metrics(people, only=CANDIDATES), CANDIDATES, ("season", "team_id"))
    # seasons x teams, a few hundred rows: the target and the folds read it from memory
    out = out.repartition(1).cache()
    return panel.next_season_target(out, out, "points_per_36").repartition(1).cache()


def _builds(s, d):
    """The stints beside a second build, from the stints of another source."""
    return ridge.compare_builds(view(s, d, "stints"), stints.external_stints(view(s, d, "external_stints")), ALPHA, 200.0)


QUERIES = {
    "design_triples": lambda s, d: ridge.design_triples(_design(s, d)),
    "design_summary": lambda s, d: rounded(ridge.describe(_design(s, d)), 9, "density"),
    "gram_sums": lambda s, d: rounded(ridge.gram(_design(s, d)), 2, "s"),
    "fold_sums": lambda s, d: rounded(ridge.gram(_design(s, d).join(ridge.game_folds(_design(s, d)), "game_id"), "fold"), 2, "s"),
    "game_folds": lambda s, d: ridge.game_folds(_design(s, d)),
    "ridge_ratings": lambda s, d: ridge.fit(_design(s, d), ALPHA)[1],
    "ridge_solve": lambda s, d: ridge.solve(view(s, d, "stints"))[1],
    "ridge_penalties": lambda s, d: ridge.select_alpha(_design(s, d))[1],
    "ridge_bootstrap": lambda s, d: ridge.bootstrap_se(_design(s, d), ALPHA),
    "ridge_stability": lambda s, d: ridge.stability(view(s, d, "stints"), ALPHA, possession_floor=100.0),
    "ridge_builds": _builds,
    "ridge_error_profile": lambda s, d: ridge.error_profile(ridge.bootstrap_se(_design(s, d), ALPHA), stints.possessions_by_player(view(s, d, "stints"))),
    "fusion_matrix": lambda s, d: rounded(fusion.standardise(_people(s, d), FUSED[:-1]), 5, *FUSED[:-1]),
    "fusion_completeness": lambda s, d: rounded(fusion.completeness(_people(s, d), FUSED[:-1]), 9, "observed"),
    "fusion_loadings": lambda s, d: fusion.loading_table(s, FUSED, _fitted(s, d)[1]),
    "fusion_convergence": lambda s, d: fusion.convergence(_matrix(s, d).cache(), "athlete_id", FUSED, RELIABILITY, "rating"),
    "fused_ratings": lambda s, d: (lambda w: fusion.scores(w, "athlete_id", FUSED, fusion.fit(w, FUSED, RELIABILITY, "rating")))(_matrix(s, d).cache()),
    "fusion_calibration": lambda s, d: fusion.calibration(_matrix(s, d).cache(), "athlete_id", FUSED, RELIABILITY, "rating"),
    "team_panel": lambda s, d: rounded(_panel(s, d), 6, *CANDIDATES, "target"),
    "box_candidates": lambda s, d: rounded(panel.without(_panel(s, d), "usage_proxy", "absent"), 6, *CANDIDATES[:3], "target"),
    "one_candidate": lambda s, d: rounded(panel.only(_panel(s, d), "true_shooting", "absent"), 6, "true_shooting", "target"),
    "panel_folds": lambda s, d: panel.folds(_panel(s, d)),
    "compare_candidates": lambda s, d: rounded(panel.compare_candidates(panel.long_panel(_panel(s, d), CANDIDATES)), 5, "rmse"),
    "paired_comparison": lambda s, d: rounded(panel.paired(panel.candidate_errors(panel.long_panel(_panel(s, d), CANDIDATES)), "points_per_36", "assists_per_36"), 5, "mean_difference", "sd", "rmse_gap", "t"),
    "paired_p_value": lambda s, d: panel.paired(panel.candidate_errors(panel.long_panel(_panel(s, d), CANDIDATES)), "points_per_36", "assists_per_36", with_p=True),
    "ridge_baseline": lambda s, d: panel.baseline_table(ridge=panel.ridge_baseline(_panel(s, d), CANDIDATES)),
    "tree_baseline": lambda s, d: panel.baseline_table(trees=trees.nested_search(_panel(s, d), CANDIDATES)[0]),
    "tree_choices": lambda s, d: trees.nested_search(_panel(s, d), CANDIDATES)[1],
    "tree_attribution": lambda s, d: (lambda p: trees.tree_attribution(p, CANDIDATES, trees.nested_search(p, CANDIDATES)[2]))(_panel(s, d)),
    "ridge_attribution": lambda s, d: panel.ridge_attribution(_panel(s, d), CANDIDATES),
    "attribution_agreement": lambda s, d: panel.attribution_agreement(panel.ridge_attribution(_panel(s, d), CANDIDATES), fusion.loading_table(s, FUSED, _fitted(s, d)[1])),
}

_X = f"""
us AS (SELECT *, row_number() OVER () AS rn FROM stints WHERE possessions >= 1 AND len(string_split(offense_lineup, '-')) = 5 AND len(string_split(defense_lineup, '-')) = 5),
dx AS (SELECT rn, game_id, possessions AS w, points, unnest(list_concat(list_transform(string_split(offense_lineup, '-'), lambda p: 2 * CAST(p AS BIGINT)),
  list_transform(string_split(defense_lineup, '-'), lambda p: 2 * CAST(p AS BIGINT) + 1))) AS c FROM us),
xv AS (SELECT rn, game_id, w, points, c, CASE WHEN c % 2 = 0 THEN 1.0::DOUBLE ELSE -1 END AS v FROM dx)"""
_FOLD = "gf AS (SELECT game_id, ntile(5) OVER (ORDER BY md5('20260910|' || game_id), game_id) - 1 AS fold FROM (SELECT DISTINCT game_id FROM us))"
_MX = f"""{ELIGIBLE}, tt AS (SELECT athlete_id, {', '.join(f'sum({c}) AS {c}' for c in box.COUNTS)}, count(DISTINCT game_id) AS games FROM el GROUP BY ALL HAVING sum(minutes) >= 1000),
mx AS (SELECT athlete_id, {', '.join(f'{metric_sql(n)} AS {n}' for n in FUSED[:-1])} FROM tt),
sx AS (SELECT athlete_id, {', '.join(f'({n} - avg({n}) OVER ()) / nullif(stddev_pop({n}) OVER (), 0) AS {n}' for n in FUSED[:-1])} FROM mx)"""
_WM = lambda c: f"(SELECT season, team_id, sum({c} * minutes) / sum(minutes) AS {c} FROM pm WHERE {c} IS NOT NULL AND minutes >= 200 GROUP BY ALL)"
_PN = f"""{ELIGIBLE}, tt AS (SELECT season, athlete_id, {', '.join(f'sum({c}) AS {c}' for c in box.COUNTS)} FROM el GROUP BY ALL),
mt AS (SELECT season, athlete_id, team_id, sum(minutes) AS m FROM el GROUP BY ALL),
pt AS (SELECT season, athlete_id, team_id FROM mt QUALIFY row_number() OVER (PARTITION BY season, athlete_id ORDER BY m DESC, team_id) = 1),
pm AS (SELECT season, team_id, minutes, {', '.join(f'{metric_sql(c)} AS {c}' for c in CANDIDATES)} FROM tt JOIN pt USING (season, athlete_id)),
cp AS (SELECT * FROM {_WM(CANDIDATES[0])} {' '.join(f'FULL JOIN {_WM(c)} USING (season, team_id)' for c in CANDIDATES[1:])}),
pn AS (SELECT cp.*, nx.points_per_36 AS target FROM cp JOIN cp nx ON nx.season = cp.season + 1 AND nx.team_id = cp.team_id WHERE nx.points_per_36 IS NOT NULL)"""
_ER = f"""{_PN}, lg AS ({' UNION ALL '.join(f"SELECT season, team_id, target, '{c}' AS candidate, {c} AS value FROM pn WHERE {c} IS NOT NULL" for c in CANDIDATES)}),
ln AS (SELECT candidate, h.season AS held, regr_slope(target, value) AS k, regr_intercept(target, value) AS b FROM lg JOIN (SELECT DISTINCT season FROM pn) h ON lg.season <> h.season GROUP BY ALL HAVING regr_count(target, value) >= 3),
er AS (SELECT candidate, season, team_id, (k * value + b - target) ** 2 AS e FROM lg JOIN ln USING (candidate) WHERE ln.held = lg.season AND k IS NOT NULL)"""

SQL = {
    "design_triples": f"WITH {ctes('stints')}, {_X} SELECT game_id, c AS \"column\", sum(v) AS value, count(*) AS entries FROM xv GROUP BY ALL",
    "design_summary": f"""WITH {ctes('stints')}, {_X} SELECT count(DISTINCT rn) AS rows, (SELECT sum(possessions) FROM us) AS possessions, count(DISTINCT (rn, c)) AS nonzeros, 2 * count(DISTINCT c // 2) AS columns,
        round(count(DISTINCT (rn, c)) / (count(DISTINCT rn) * 2 * count(DISTINCT c // 2)), 9) AS density FROM xv""",
    "gram_sums": f"""WITH {ctes('stints')}, {_X}, g AS (SELECT a.c AS i, b.c AS j, sum(a.w * a.v * b.v) AS s FROM xv a JOIN xv b ON a.rn = b.rn AND b.c >= a.c GROUP BY ALL
        UNION ALL SELECT c, -1, sum(v * 100 * points) FROM xv GROUP BY ALL UNION ALL SELECT c, -2, sum(v * w) FROM xv GROUP BY ALL
        UNION ALL SELECT -1, -1, sum(100 * points) FROM us UNION ALL SELECT -1, -2, sum(possessions) FROM us UNION ALL SELECT -1, -3, sum(10000 * points * points / possessions) FROM us) SELECT i, j, round(s, 2) AS s FROM g""",
    "fold_sums": f"""WITH {ctes('stints')}, {_X}, {_FOLD}, f AS (SELECT fold, possessions, points FROM us JOIN gf USING (game_id)), xf AS (SELECT xv.*, fold FROM xv JOIN gf USING (game_id)),
        g AS (SELECT a.fold, a.c AS i, b.c AS j, sum(a.w * a.v * b.v) AS s FROM xf a JOIN xf b ON a.rn = b.rn AND b.c >= a.c GROUP BY ALL
        UNION ALL SELECT fold, c, -1, sum(v * 100 * points) FROM xf GROUP BY ALL UNION ALL SELECT fold, c, -2, sum(v * w) FROM xf GROUP BY ALL
        UNION ALL SELECT fold, -1, -1, sum(100 * points) FROM f GROUP BY fold UNION ALL SELECT fold, -1, -2, sum(possessions) FROM f GROUP BY fold
        UNION ALL SELECT fold, -1, -3, sum(10000 * points * points / possessions) FROM f GROUP BY fold) SELECT fold, i, j, round(s, 2) AS s FROM g""",
    "game_folds": f"WITH {ctes('stints')}, {_X}, {_FOLD} SELECT * FROM gf",
    "fusion_matrix": f"WITH {ctes('box')}, {_MX} SELECT athlete_id, {', '.join(f'round({n}, 5) AS {n}' for n in FUSED[:-1])} FROM sx",
    "fusion_completeness": f"WITH {ctes('box')}, {_MX} SELECT count(*) AS people, round(({' + '.join(f'count({n})' for n in FUSED[:-1])}) / (count(*) * {len(FUSED) - 1}), 9) AS observed FROM sx",
    "team_panel": f"WITH {ctes('box')}, {_PN} SELECT season, team_id, {', '.join(f'round({c}, 6) AS {c}' for c in (*CANDIDATES, 'target'))} FROM pn",
    "box_candidates": f"WITH {ctes('box')}, {_PN} SELECT season, team_id, {', '.join(f'round({c}, 6) AS {c}' for c in (*CANDIDATES[:3], 'target'))} FROM pn",
    "one_candidate": f"WITH {ctes('box')}, {_PN} SELECT season, team_id, round(true_shooting, 6) AS true_shooting, round(target, 6) AS target FROM pn",
    "panel_folds": f"""WITH {ctes('box')}, {_PN}, n AS (SELECT season AS held_out, count(*) AS test FROM pn GROUP BY ALL)
        SELECT held_out, (SELECT count(*) FROM pn) - test AS train, test, (SELECT count(*) FROM pn) - test >= 5 AS usable FROM n""",
    "compare_candidates": f"WITH {ctes('box')}, {_ER} SELECT candidate, round(sqrt(avg(e)), 5) AS rmse, count(*) AS observations, round(sqrt(avg(e)) - min(sqrt(avg(e))) OVER (), 4) AS vs_best FROM er GROUP BY candidate",
    "paired_comparison": f"""WITH {ctes('box')}, {_ER}, d AS (SELECT a.e AS a, b.e AS b FROM er a JOIN er b USING (season, team_id) WHERE a.candidate = 'points_per_36' AND b.candidate = 'assists_per_36')
        SELECT count(*) AS n, round(avg(a - b), 5) AS mean_difference, round(stddev_samp(a - b), 5) AS sd, round(sqrt(avg(a)) - sqrt(avg(b)), 5) AS rmse_gap, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 5) AS t FROM d""",
}
