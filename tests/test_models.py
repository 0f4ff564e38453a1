import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stintmill.functions import hashing, stats
from stintmill.operators import box, stints, fusion, identity, panel, reliability, ridge, windows

STINTS = "game_id string, offense_team_id long, defense_team_id long, offense_lineup string, defense_lineup string, possessions double, points double, opponent_points double"


@pytest.fixture(scope="module")
def season():
    """Forty games of twenty-five stints; player 7 is worth ten points per hundred more."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        for _ in range(25):
            ids = rng.choice(30, 10, replace=False)
            n = float(rng.integers(4, 16))
            rate = 110 + 10 * (7 in ids[:5]) - 10 * (7 in ids[5:])
            rows.append((f"g{g}", 1, 2, "-".join(map(str, ids[:5])), "-".join(map(str, ids[5:])), n, float(round(n * rate / 100)), 0.0))
    return rows


def closed_form(rows, alpha):
    ids = sorted({int(p) for r in rows for line in r[3:5] for p in line.split("-")})
    at = {p: k for k, p in enumerate(ids)}
    x = np.zeros((len(rows), 2 * len(ids)))
    for k, r in enumerate(rows):
        for p in r[3].split("-"):
            x[k, at[int(p)]] += 1
        for p in r[4].split("-"):
            x[k, len(ids) + at[int(p)]] -= 1
    w = np.array([r[5] for r in rows])
    y = 100 * np.array([r[6] for r in rows]) / w
    xc, yc = x - np.average(x, axis=0, weights=w), y - np.average(y, weights=w)
    b = np.linalg.solve(xc.T @ (xc * w[:, None]) + alpha * np.eye(x.shape[1]), xc.T @ (yc * w))
    return {p: (b[at[p]], b[len(ids) + at[p]]) for p in ids}


def test_ridge_equals_closed_form_and_finds_the_planted_player(spark, season):
    rows = ridge.design(spark.createDataFrame(season, STINTS))
    _, rated = ridge.fit(rows, 500.0)
    got = {r.player_id: (r.offensive, r.defensive) for r in rated.collect()}
    want = closed_form(season, 500.0)
    assert got.keys() == want.keys()
    assert max(abs(np.subtract(got[p], want[p])).max() for p in want) < 1e-8
    assert max(got, key=lambda p: sum(got[p])) == 7
    sparse = {r.player_id: (r.offensive, r.defensive) for r in ridge.fit_iterative(rows, [(500.0, None)]).ratings().collect()}
    assert max(abs(np.subtract(sparse[p], want[p])).max() for p in want) < 1e-8
    with pytest.raises(ValueError):
        ridge.fit(rows, 0.0)


def test_held_out_error_from_sums_equals_rows(spark, season):
    rows = ridge.design(spark.createDataFrame(season, STINTS))
    s = ridge.sums_of(ridge.gram(rows).toPandas())
    c, b = s.solve(300.0)
    place = {v: k for k, v in enumerate(s.columns)}
    err = [(r.w, (r.y - c - sum(e.v * b[place[e.c]] for e in r.x)) ** 2) for r in rows.collect()]
    assert s.mse(c, b) == pytest.approx(sum(w * e for w, e in err) / sum(w for w, _ in err))


def test_stability_is_reproducible(spark, season):
    df = spark.createDataFrame(season, STINTS)
    one, two = (ridge.stability(d, 500.0, 3, 10.0).first() for d in (df, df.repartition(7)))
    assert one.rho_half == pytest.approx(two.rho_half, abs=1e-9)
    assert one.draws == 3


@pytest.mark.parametrize(("name", "plain"), [("Nikola Jokić", "nikola jokic"), ("D.J. O'Neal-Smith", "dj oneal smith"), ("  José  Núñez ", "jose nunez"), (None, None)])
def test_normalise(spark, name, plain):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(identity.normalise(F.col("n"))).first()[0] == plain


def test_crosswalk_takes_only_who_played(spark):
    people = spark.createDataFrame([(1, "Gary Payton II"), (2, "Gary Payton"), (3, "Nobody Here"), (4, "Luka Doncic")], "athlete_id long, athlete_display_name string")
    known = spark.createDataFrame([(10, "Gary Payton", False), (11, "Gary Payton II", True), (12, "Luka Dončić", True), (13, "Nobody Heres", True)], "nba_id long, name string, played boolean")
    got = {r.athlete_id: (r.nba_id, r["pass"], r.status) for r in identity.crosswalk(people, known).collect()}
    assert got[1] == (11, "exact", "matched")
    assert got[2] == (11, "suffix", "matched")  # only the one who played that season can be meant
    assert got[3] == (None, None, "unmatched")
    assert got[4] == (12, "exact", "matched")


def test_halves_are_balanced(spark):
    df = spark.range(31).selectExpr("id as game_id", "1L as season", "id % 3 as athlete_id", "id as line", "id as part", "1D as minutes", "0D as points")
    got = reliability.assign_halves(df, draws=4).groupBy("draw", "athlete_id").agg(F.sum("half").alias("h"), F.count("*").alias("n")).collect()
    assert all(abs(2 * r.h - r.n) <= 1 for r in got)


def test_tails():
    assert stats.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.kolmogorov_p(1.3580986 * (2 / 1000) ** 0.5, 1000, 1000) == pytest.approx(0.05, abs=1e-5)


def test_fusion_recovers_planted_loadings(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=1500)
    true = {"a": 0.8, "b": 0.6, "c": 0.3, "rating": 0.9}
    data = {n: v * f + np.sqrt(1 - v * v) * rng.normal(size=1500) for n, v in true.items()}
    rows = [(i, *[float(data[n][i]) if rng.random() > 0.1 else None for n in true]) for i in range(1500)]
    wide = spark.createDataFrame(rows, "id long, a double, b double, c double, rating double").cache()
    model = fusion.fit(wide, tuple(true), {"rating": 0.81}, "rating", factors=1, steps=40)
    assert np.abs(model["loadings"][:, 0] - list(true.values())).max() < 0.08
    assert (np.linalg.norm(model["loadings"], axis=1) <= model["bounds"] + 1e-9).all()
    rated = {r.id: r.rating for r in fusion.scores(wide, "id", tuple(true), model).collect()}
    assert np.corrcoef([rated[i] for i in range(1500)], f)[0, 1] > 0.9


def test_held_out_season_is_never_trained_on(spark):
    rows = [(s, t, float(t), float(2 * t + (100 if s == 3 else 0))) for s in (1, 2, 3) for t in range(6)]
    df = spark.createDataFrame(rows, "season long, team_id long, good double, target double")
    errors = panel.candidate_errors(panel.long_panel(df, ("good",)))
    got = {r.season: r.e for r in errors.groupBy("season").agg(F.avg("squared_error").alias("e")).collect()}
    assert got[3] == pytest.approx(10000.0)  # the jump of season 3 cannot be known from the others
    assert got[1] == got[2] == pytest.approx(2500.0)


def test_penalties_bootstrap_and_empty_designs(spark, season):
    rows = ridge.design(spark.createDataFrame(season, STINTS))
    best, table = ridge.select_alpha(rows, (50.0, 500.0, 5000.0), folds=4)
    folds = {r.game_id: r.fold for r in ridge.game_folds(rows, 4).collect()}
    got = {r.alpha: r.weighted_mse for r in table.collect()}
    for alpha, mse in got.items():
        errors = []
        for k in range(4):
            train = [r for r in season if r[0] in folds and folds[r[0]] != k]
            b = closed_form(train, alpha)
            s = ridge.sums_of(ridge.gram(rows).toPandas())
            own = [r for r in season if folds.get(r[0]) == k]
            hat = lambda r: sum(b[int(p)][0] if int(p) in b else 0 for p in r[3].split("-")) - sum(b[int(p)][1] if int(p) in b else 0 for p in r[4].split("-"))  # noqa: E731, B023
            w = np.array([r[5] for r in train])
            c = np.average(np.array([100 * r[6] / r[5] - hat(r) for r in train]), weights=w)
            e = np.array([(100 * r[6] / r[5] - hat(r) - c) ** 2 for r in own])
            errors.append(np.average(e, weights=[r[5] for r in own]))
        assert mse == pytest.approx(np.mean(errors), rel=1e-8)
    assert got[best] == min(got.values()) and s.w == sum(r[5] for r in season)
    errors = ridge.bootstrap_se(rows, 500.0, 12).collect()
    assert all(0 < r.total_se < 50 and r.draws <= 12 for r in errors) and {r.player_id for r in errors} == set(closed_form(season, 500.0))
    for call in (lambda d: ridge.fit(d, 500.0), lambda d: ridge.select_alpha(d)):
        with pytest.raises(ValueError):
            call(rows.limit(0))
    with pytest.raises(ValueError):
        stints.required_stints(spark.createDataFrame(season, STINTS), 1e9)


def test_attribution_uses_every_row(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), t, float(a), float(b), float(3 * a + 0 * b + s)) for s in range(30) for t in range(25) for a, b in [rng.normal(size=2)]]
    df = spark.createDataFrame(rows, "season long, team_id long, a double, b double, target double")
    got = {r.feature: (r.mean_abs, r.mean_signed) for r in panel.ridge_attribution(df, ("a", "b")).collect()}
    a = np.array([r[2] for r in rows])
    assert got["a"][0] == pytest.approx(3 * np.abs(a - a.mean()).mean(), rel=0.15) and got["b"][0] < 0.5
    assert abs(got["a"][1]) < 1e-9 and abs(got["b"][1]) < 1e-9


def test_positive_anchor_and_loading_deviations(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=800)
    rows = [(i, float(0.7 * f[i] + 0.7 * rng.normal()), float(0.5 * f[i] + 0.86 * rng.normal()), float(0.6 * f[i] + 0.8 * rng.normal())) for i in range(800)]
    wide = spark.createDataFrame(rows, "id long, a double, b double, rating double").cache()
    model = fusion.fit(wide, ("a", "b", "rating"), {"rating": 0.9}, "rating", factors=1, steps=25, anchor_mode="positive")
    assert 0 <= model["loadings"][2, 0] <= np.sqrt(0.9) and (model["loading_sd"][:, 0] > 0).all()
    with pytest.raises(ValueError):
        fusion.fit(wide, ("a", "b", "rating"), {}, "rating", anchor_mode="other")


def test_solve_takes_the_best_penalty(spark, season):
    df = spark.createDataFrame(season, STINTS)
    alpha, rated = ridge.solve(df, (300.0, 30000.0), folds=4)
    assert alpha == ridge.select_alpha(ridge.design(df), (300.0, 30000.0), 4)[0]
    want = closed_form(season, alpha)
    assert max(abs(r.offensive - want[r.player_id][0]) for r in rated.collect()) < 1e-8


def test_split_half_of_one_metric(spark):
    rng = np.random.default_rng(5)
    rows = [(1, a, g, g, 1, 30.0, float(rng.poisson(5 + a)), 1) for a in range(12) for g in range(20)]
    df = spark.createDataFrame(rows, "season long, athlete_id long, game_id long, line long, part long, minutes double, points double, team_id long")
    one = reliability.split_half(df, "points_per_36", draws=5, floor=100.0).first()
    assert one.draws_used == 5 and one.players == 12 and one.rho_half > 0.5
    assert one.rho_half == reliability.measure(df, "random", 5, 100.0, ("points_per_36",)).first().rho_half
    with pytest.raises(ValueError):
        reliability.split_half(spark.createDataFrame([], "season long, athlete_id long, minutes double"), "no such metric")


def test_draws_at_once_equal_rows_by_draw(spark):
    rng = np.random.default_rng(7)
    rows = [(1 + i % 2, int(rng.integers(0, 5)), int(rng.integers(0, 40)), i, 1, float(rng.integers(1, 40)), None if i % 9 == 0 else float(rng.integers(0, 30))) for i in range(300)]
    df = spark.createDataFrame(rows, "season long, athlete_id long, game_id long, line long, part long, minutes double, points double")
    plain = {(r.season, r.athlete_id, r.draw, r.half): (r.minutes, r.points, r.games) for r in reliability.half_totals(reliability.assign_halves(df, draws=6)).collect()}
    got = {}
    for r in reliability.drawn_totals(df, 6).collect():
        got |= {(r.season, r.athlete_id, r.draw, h): (x.minutes, x.points, x.games) for h, x in ((0, r.a), (1, r.b)) if x is not None}
    assert got == plain


def _halving_rows(spark):
    rng = np.random.default_rng(11)
    rows = [(1 + i % 2, int(rng.integers(0, 4)), None if i % 13 == 0 else int(rng.integers(0, 30)), i, 1, float(rng.integers(1, 40)), float(rng.integers(0, 30)), f"2001-01-{1 + i % 28:02d}") for i in range(200)]
    return spark.createDataFrame(rows, "season long, athlete_id long, game_id long, line long, part long, minutes double, points double, game_date string")


def test_digests_order_as_hex_text():
    tails = [b"", b"7|1|2|3", "é|x".encode(), b"y" * 53, b"y" * 54, b"z" * 300]
    for prefix in (b"20260910|1|", b"1|", b"20260910|12|"):
        high, low = hashing.Md5(tails).of(prefix)
        assert [f"{int(h):016x}{int(w):016x}" for h, w in zip(high, low, strict=True)] == [hashlib.md5(prefix + t).hexdigest() for t in tails]


def test_rows_get_all_halves_from_one_reading(spark):
    df = _halving_rows(spark)
    halved = reliability.assign_halves(df, draws=12)
    plan = halved._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # a window would sort and shuffle every row once a draw
    order = Window.partitionBy("season", "draw", "athlete_id").orderBy(stats.seeded("draw", "athlete_id", *reliability.ROW_KEY, seed=reliability.SEED), *reliability.ROW_KEY)
    want = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("half", (F.row_number().over(order) % 2).cast("int"))
    assert sorted((r.draw, r.line, r.half) for r in halved.collect()) == sorted((r.draw, r.line, r.half) for r in want.collect())


def test_totals_by_date_equal_rows_by_date(spark):
    df = _halving_rows(spark)
    plain = {(r.season, r.athlete_id, r.draw, r.half): (r.minutes, r.points, r.games) for r in reliability.half_totals(reliability.assign_halves(df, "odd_even")).collect()}
    got = {}
    for r in reliability.drawn_totals(df, 1, rule="odd_even").collect():
        got |= {(r.season, r.athlete_id, r.draw, h): (x.minutes, x.points, x.games) for h, x in ((0, r.a), (1, r.b)) if x is not None}
    assert got == plain


def test_draw_correlations_rank_without_a_row_a_metric(spark):
    rng = np.random.default_rng(4)
    rows = [(1, d, p, 10.0, [float(a), 1.0, None if p % 2 else float(b)], [float(a + c), 1.0, float(c)]) for d in (1, 2) for p in range(30) for a, b, c in [rng.integers(0, 6, 3)]]
    pairs = spark.createDataFrame(rows, "season long, draw int, athlete_id long, games double, first array<double>, second array<double>")
    got = {(r.draw, r.metric): r for r in reliability.draw_correlations(pairs, ("a", "flat", "some")).collect()}
    for d in (1, 2):
        x, y = (pd.Series([r[k][0] for r in rows if r[1] == d]) for k in (4, 5))
        assert got[d, "a"].rho == pytest.approx(x.corr(y)) and got[d, "a"].spearman == pytest.approx(x.rank().corr(y.rank()))
        assert np.isnan(got[d, "flat"].rho) and got[d, "some"].players == 15


def test_metrics_of_draws_are_taken_by_column(spark):
    rng = np.random.default_rng(6)
    rows = [(1 + p % 2, p, g, g, 1, *[float(v) for v in rng.integers(1, 30, len(box.COUNTS))]) for p in range(14) for g in range(p % 3 * 10 + 1)]
    df = spark.createDataFrame(rows, "season long, athlete_id long, game_id long, line long, part long, " + ", ".join(f"{c} double" for c in box.COUNTS))
    names = tuple(m.name for m in box.metrics())
    plan = reliability.measure(df.withColumn("team_id", F.lit(1)), "random", 3, 0.0, names)._jdf.queryExecution().optimizedPlan().toString()
    assert "points#" in plan and "try_divide" not in plan and " >= 100.0" not in plan  # no row's shares and floors in the JVM
    halves = reliability.drawn_totals(df, 3).where("a is not null and b is not null")
    a, b = ({(r.season, r.draw, r.athlete_id): [r[n] for n in names] for r in box.with_metrics(halves.select("season", "draw", "athlete_id", f"{s}.*")).collect()} for s in "ab")
    pairs = reliability.pairs_of(df, "random", 3, names)
    got = {(r.season, r.draw, r.athlete_id): r for r in pairs.collect()}
    assert got.keys() == a.keys() and all(r.first == a[k] and r.second == b[k] for k, r in got.items())
    assert any(None in v for v in a.values())
    key = lambda r: (r.season, r.draw, r.metric, round(r.rho, 9), r.players, round(r.spearman, 9), r.games_per_half)
    assert sorted(map(key, reliability.drawn_correlations(df, "random", 3, names).collect())) == sorted(map(key, reliability.draw_correlations(pairs, names).collect()))


def test_sums_of_models_equal_repeated_stints(spark, season):
    rows = ridge.design(spark.createDataFrame(season, STINTS))
    dealt = rows.withColumn("models", F.expr("filter(array(0, 1, 1, 3), m -> pmod(xxhash64(game_id), 3) <> m)"))
    got = {(r.model, r.i, r.j): r.s for r in ridge.gram_of_models(dealt, "models", 4).collect()}
    want = {(r.model, r.i, r.j): r.s for r in ridge.gram(dealt.withColumn("model", F.explode("models")), "model").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-6) for k in want)


def test_people_are_added_up_before_ids_are_merged(spark):
    rng = np.random.default_rng(9)
    rows = [(1 + i % 2, p, int(rng.integers(0, 3)), None if p == 9 else f"P{p // 2}", i, 2, False, *[float(v) for v in rng.integers(1, 30, len(box.COUNTS))]) for i in range(400) for p in [int(rng.integers(0, 10))]]
    df = spark.createDataFrame(rows, "season long, athlete_id long, team_id long, athlete_display_name string, game_id long, season_type int, did_not_play boolean, " + ", ".join(f"{c} double" for c in box.COUNTS))
    names = tuple(m.name for m in box.metrics())
    got = box.added_up(box.eligible_rows(df, 1, merge=False), names)
    want = box.totals(box.eligible_rows(df, 1), ("season", "athlete_id", "team_id")).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in "".join(plan[plan.index("Join LeftOuter") :].split("\n")[1:3])  # no row of a game meets the mapping


def test_line_ups_are_added_up_by_their_texts(spark, season):
    rows = spark.createDataFrame(season, STINTS).withColumn("season", F.expr("pmod(xxhash64(game_id), 2)"))
    sums = ridge.line_up_sums(rows, 1.0, "season")
    got = {(r.season, r.i, r.j): r.s for r in ridge.gram_of_line_ups(sums, "season").collect()}
    want = {(r.season, r.i, r.j): r.s for r in ridge.gram(ridge.design(rows, 1.0, "season"), "season").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-6) for k in want)
    played = {(r.window_end, r.player_id) for r in windows.window_players(rows, 1, 50.0).collect()}
    plain = stints.possessions_by_player(stints.usable_stints(rows), ("season",)).where("possessions >= 50")
    assert played == {(r.season, r.player_id) for r in plain.collect()}


def test_products_are_taken_once_a_line_up(spark, season):
    rows = ridge.design(spark.createDataFrame(season, STINTS))
    plan = ridge.gram(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")  # stints are added up below the products


def test_steps_from_sums_by_pattern_equal_steps_over_people(spark, monkeypatch):
    rng = np.random.default_rng(8)
    f = rng.normal(size=300)
    cell = lambda v, hole: None if rng.random() < hole else float(v)
    rows = [(i, i % 2, [float(t) for t in rng.integers(0, 3, 2)], cell(0.7 * f[i] + 0.7 * rng.normal(), 0.2), cell(0.5 * f[i] + 0.9 * rng.normal(), 0.3), float(0.6 * f[i] + 0.8 * rng.normal())) for i in range(300)]
    wide = spark.createDataFrame(rows, "id long, w long, t array<double>, a double, b double, rating double").cache()
    models = [(g, d, 1) for g in (0, 1) for d in (0, 1)]
    call = lambda: fusion.fit_many(wide, ("a", "b", "rating"), {"rating": 0.8}, "rating", models, group="w", times="t", steps=4)
    by_pattern = call()
    monkeypatch.setattr(fusion, "MOST_SUMS", 0)
    by_people = call()
    for key in models:
        for part in ("loadings", "intercepts", "loading_sd"):
            assert np.allclose(by_pattern[key][part], by_people[key][part], rtol=1e-8, atol=1e-10)


def test_games_draws_are_not_broadcast_to_an_error_profile(spark):
    from stintmill.sources.views import view

    rows = ridge.design(view(spark, "/root/testdata/sf0.001", "stints"))
    plan = ridge.bootstrap_se(rows, 3000.0, draws=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2  # of games with their draws, and of stints with these
