"""Nested search, Shapley values, models in the same passes, and fits beyond a dense system."""

import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stintmill.operators import fusion, panel, ridge, trees, windows

RNG = np.random.default_rng(11)
PANEL = [(int(s), t, *[float(v) if RNG.random() > 0.1 else None for v in x], float(3 * x[0] + (x[1] > 0) * 4 + 0.1 * RNG.normal())) for s in range(1, 6) for t in range(30) for x in [RNG.normal(size=3)]]
SMALL = {"n_estimators": (20, 20, "int"), "learning_rate": (0.02, 0.3, "log"), "num_leaves": (3, 8, "int"), "min_child_samples": (3, 10, "int"), "subsample": (0.8, 1.0, "plain"), "colsample_bytree": (0.7, 1.0, "plain"), "reg_lambda": (1e-3, 1.0, "log")}
NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(PANEL, "season long, team_id long, a double, b double, c double, target double").cache()


@pytest.fixture(scope="module")
def found(df):
    return [x.toPandas() for x in trees.nested_search(df, NAMES, 6, ranges=SMALL)]


def plain_errors(rows, train, test, params):
    pdf = pd.DataFrame(rows, columns=["season", "team_id", *NAMES, "target"])
    fit = lambda p: (p[list(NAMES)].to_numpy(dtype=float), p["target"].to_numpy())
    x, y = fit(pdf[pdf["season"].isin(test)])
    return (trees.Trees(trees.grow(*fit(pdf[pdf["season"].isin(train)]), params)).predict(x) - y) ** 2


def test_nested_search_equals_plain_loops(found):
    errors, choices, _ = found
    sets, seasons = trees.drawn(6, ranges=SMALL), [1, 2, 3, 4, 5]
    for held in [None, *seasons]:
        inner = [s for s in seasons if s != held]
        score = [np.sqrt(np.mean(np.concatenate([plain_errors(PANEL, [s for s in inner if s != k], [k], p) for k in inner]))) for p in sets]
        row = choices[choices["held_out"].isna() if held is None else choices["held_out"] == held].iloc[0]
        assert row["trial"] == int(np.argmin(score)) and row["inner_rmse"] == pytest.approx(min(score))
        assert json.loads(row["params"]) == sets[row["trial"]]
        if held is not None:
            got = np.sort(errors[errors["held_out"] == held]["squared_error"])
            assert got == pytest.approx(np.sort(plain_errors(PANEL, inner, [held], sets[row["trial"]])))


def test_held_out_season_neither_trains_nor_chooses(spark, df, found):
    moved = df.withColumn("target", F.when(F.col("season") == 3, F.col("target") + 1e6).otherwise(F.col("target")))
    _, choices, _ = trees.nested_search(moved, NAMES, 6, ranges=SMALL)
    pick = lambda c: c[c["held_out"] == 3][["trial", "inner_rmse"]].values.tolist()
    assert pick(choices.toPandas()) == pick(found[1])


def test_planted_best_set_is_found(df):
    sets = {"n_estimators": (1, 150, "int"), "learning_rate": (0.1, 0.1000001, "log"), "num_leaves": (6, 6, "int"), "min_child_samples": (5, 5, "int"), "subsample": (1.0, 1.0, "plain"), "colsample_bytree": (1.0, 1.0, "plain"), "reg_lambda": (0.1, 0.1000001, "log")}
    trials = trees.drawn(5, ranges=sets)
    _, choices, _ = trees.nested_search(df, NAMES, 5, ranges=sets)
    got = {trials[r.trial]["n_estimators"] for r in choices.collect()}
    assert min(got) > sorted(t["n_estimators"] for t in trials)[1]  # too few trees are worse on every fold


def test_trees_take_missing_values_and_constants():
    x = np.array([[np.nan, 1.0], [np.nan, 1.0], [1.0, 1.0], [1.0, 1.0]] * 5)
    y = np.where(np.isnan(x[:, 0]), 5.0, -5.0)
    params = {"n_estimators": 60, "learning_rate": 0.3, "num_leaves": 3, "min_child_samples": 1, "subsample": 1.0, "colsample_bytree": 1.0, "reg_lambda": 1e-3}
    x[0, 0], y[0] = 2.0, -5.0
    assert np.abs(trees.Trees(trees.grow(x, y, params)).predict(x) - y).max() < 0.1
    flat = trees.Trees(trees.grow(np.ones((6, 1)), np.arange(6.0), params))
    assert flat.predict(np.array([[np.nan], [1.0]])).tolist() == [2.5, 2.5]


def test_shapley_values_are_exact_and_add_up(spark, df, found):
    model = spark.createDataFrame(found[2], trees.NODE)
    told = trees.Trees(found[2])
    few = df.where("season <= 2")
    x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in PANEL if r[0] <= 2])
    keys = [r[:2] for r in PANEL if r[0] <= 2]
    got = {(r.season, r.team_id, r.feature): r for r in trees.shapley(few, NAMES, model, background=len(x)).collect()}
    worth = {}
    for size in range(4):
        for s in itertools.combinations(range(3), size):
            mixed = np.repeat(x[None], len(x), axis=0)  # background z, row x
            mixed[:, :, list(s)] = np.repeat(x[:, None], len(x), axis=1).transpose(1, 0, 2)[:, :, list(s)] if s else mixed[:, :, []]
            full = np.repeat(x[:, None], len(x), axis=1)
            full[:, :, list(s)] = x[None][:, :, list(s)] if s else full[:, :, []]
            worth[s] = told.predict(full.reshape(-1, 3)).reshape(len(x), len(x)).mean(axis=0)
    for n, key in enumerate(keys):
        total = 0.0
        for j, name in enumerate(NAMES):
            want = sum(
                (1 / 3 if len(s) != 1 else 1 / 6) * (worth[tuple(sorted((*s, j)))][n] - worth[s][n]) for s in worth if j not in s
            )
            r = got[(*key, name)]
            assert r.value == pytest.approx(want, abs=1e-9)
            total += r.value
        assert total == pytest.approx(r.prediction - r.base, abs=1e-9) and r.prediction == pytest.approx(told.predict(x[n : n + 1])[0])


def test_sampled_orders_add_up(spark, found, df):
    model = spark.createDataFrame(found[2], trees.NODE)
    each = trees.shapley(df, NAMES, model, orders=4, background=7).toPandas()
    total = each.groupby(["season", "team_id"]).agg(v=("value", "sum"), p=("prediction", "first"), b=("base", "first"))
    assert np.abs(total["v"] - total["p"] + total["b"]).max() < 1e-9
    table = trees.tree_attribution(df, NAMES, model, orders=4, background=7).toPandas().set_index("feature")
    assert table.loc["a", "mean_abs"] > table.loc["c", "mean_abs"]


def test_claim_report_names_true_box_models(df):
    got = panel.claim_report(df, NAMES, ("a",), ("b", "missing"), trials=2).toPandas()
    assert set(got[got["part"] == "rmse"]["model"]) == {*NAMES, "ridge_all", "trees_all", "ridge_box", "trees_box"}
    box = got[got["part"] == "box_only"].iloc[0]
    assert box["model"].split(" - ")[0].endswith("_box") and box["model"].split(" - ")[1] in ("b", "c")
    assert set(got[got["part"] == "attribution"]["model"]) == set(NAMES) and got[got["part"] == "paired"]["p"].notna().all()


def test_run_log_keeps_a_retry_once(spark, df, tmp_path):
    table = panel.baseline_table(ridge=panel.ridge_baseline(df, NAMES))
    for run in ("one", "two", "two"):
        trees.log_runs(table, str(tmp_path), "claim", run)
    got = trees.read_runs(spark, str(tmp_path)).groupBy("experiment", "run").count().collect()
    assert sorted((r.experiment, r.run, r["count"]) for r in got) == [("claim", "one", 1), ("claim", "two", 1)]


# --- models in the same passes

def people(n=700, seed=4, window=0):
    rng = np.random.default_rng(seed)
    f = rng.normal(size=n)
    true = {"a": 0.8, "b": 0.5, "rating": 0.85}
    return [(window, i, *[float(v * f[i] + np.sqrt(1 - v * v) * rng.normal()) if rng.random() > 0.1 else None for v in true.values()]) for i in range(n)]


FUSED = ("a", "b", "rating")
SCHEMA = "window_end long, player_id long, a double, b double, rating double"


def test_windows_fit_together_equal_windows_fit_alone(spark):
    both = spark.createDataFrame(people(seed=1, window=1) + people(seed=2, window=2), SCHEMA).cache()
    together = windows.fused(both, FUSED, {"rating": 0.8}, steps=12)
    got = {(r.window_end, r.player_id): r.fused for r in together.collect()}
    for w in (1, 2):
        own = both.where(F.col("window_end") == w)
        model = fusion.fit(own, FUSED, {"rating": 0.8}, "rating", steps=12)
        alone = {r.player_id: r.rating for r in fusion.scores(own, "player_id", FUSED, model).collect()}
        assert max(abs(got[w, p] - v) for p, v in alone.items()) < 1e-9


def test_loading_deviations_equal_a_plain_bootstrap(spark):
    rows = people(500)
    wide = spark.createDataFrame(rows, SCHEMA).cache()
    got = fusion.refitted(wide, "player_id", FUSED, {"rating": 0.8}, "rating", draws=150, factors=1, steps=40)
    y = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows])
    rng, drawn, bound = np.random.default_rng(8), [], got["bounds"]
    for _ in range(150):
        z = y[rng.integers(0, len(y), len(y))]
        a, b = got["intercepts"], got["loadings"]
        for _ in range(40):
            mean, cov = fusion._posterior(z, a, b, fusion._residual(b))
            c = []
            for m in range(3):
                ok = ~np.isnan(z[:, m])
                one = np.column_stack([np.ones(ok.sum()), mean[ok]])
                gram = one.T @ one
                gram[1:, 1:] += cov[ok].sum(axis=0)
                c.append(np.linalg.solve(gram, one.T @ z[ok, m]))
            c = np.array(c)
            new = fusion._projected(c[:, 1:], bound, 2, "fixed")
            done, a, b = np.abs(new - b).max() < 1e-4, c[:, 0], new
            if done:
                break
        drawn.append(b[:, 0])
    want = np.std(drawn, axis=0, ddof=1)
    assert got["loading_sd"][:2, 0] == pytest.approx(want[:2], rel=0.2) and got["loading_sd"][2, 0] < 1e-9


def test_resampling_counts_are_poisson(spark):
    times = np.array([r.t for r in spark.range(20000).select(fusion.poisson_times(3, "id").alias("t")).collect()])
    assert times.mean(axis=0) == pytest.approx([1, 1, 1], abs=0.03) and times.var(axis=0) == pytest.approx([1, 1, 1], abs=0.05)
    assert abs(np.corrcoef(times.T)[0, 1]) < 0.03


def test_convergence_tells_scores_too(spark):
    wide = spark.createDataFrame(people(300), SCHEMA).cache()
    got = {(r.part, r.metric): r.spread for r in fusion.convergence(wide, "player_id", FUSED, {"rating": 0.8}, "rating", starts=3, factors=1, steps=60, tol=1e-7).collect()}
    assert set(got) == {*[("loading", n) for n in FUSED], *[("nuisance", n) for n in FUSED], ("score", "mean"), ("score", "most")}
    assert got["score", "mean"] <= got["score", "most"] < 0.05


def test_calibration_has_an_overall_row_and_needs_cells(spark):
    wide = spark.createDataFrame(people(600), SCHEMA).cache()
    got = {r.metric: r for r in fusion.calibration(wide, "player_id", FUSED, {"rating": 0.8}, "rating").collect()}
    assert set(got) == {None, *FUSED} and got[None].hidden == sum(got[n].hidden for n in FUSED)
    with pytest.raises(ValueError):
        fusion.calibration(wide.limit(8), "player_id", FUSED, {"rating": 0.8}, "rating")


# --- beyond a dense system

STINTS = "game_id string, offense_lineup string, defense_lineup string, possessions double, points double"


def many_stints(players, games, each, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(games):
        for _ in range(each):
            ids = rng.choice(players, 10, replace=False)
            n = float(rng.integers(4, 16))
            rows.append((f"g{g}", "-".join(map(str, ids[:5])), "-".join(map(str, ids[5:])), n, float(rng.integers(0, 3) * n / 2)))
    return rows


def test_conjugate_gradients_equal_the_closed_form(spark):
    rows = ridge.design(spark.createDataFrame(many_stints(3100, 40, 80), STINTS))
    assert ridge.column_count(rows) > 6000
    intercept, rated = ridge.fit(rows, 800.0)
    s = ridge.gram(rows).toPandas()
    most, ridge.MOST_COLUMNS = ridge.MOST_COLUMNS, 10_000
    try:
        c, b = (sums := ridge.sums_of(s)).solve(800.0)
    finally:
        ridge.MOST_COLUMNS = most
    want = ridge._ratings(sums.columns, b).set_index("player_id")
    got = rated.toPandas().set_index("player_id")
    assert intercept == pytest.approx(c, abs=1e-8) and set(got.index) == set(want.index)
    assert np.abs(got[["offensive", "defensive", "total"]] - want.loc[got.index][["offensive", "defensive", "total"]]).to_numpy().max() < 1e-8


def test_penalties_bootstrap_and_stability_beyond_a_dense_system(spark, monkeypatch):
    data = spark.createDataFrame(many_stints(12, 12, 10), STINTS)
    rows = ridge.design(data)
    dense = ridge.select_alpha(rows, (50.0, 5000.0), 3), ridge.bootstrap_se(rows, 500.0, 3).toPandas(), ridge.stability(data, 500.0, 2, 10.0).first()
    monkeypatch.setattr(ridge, "MOST_COLUMNS", 10)
    sparse = ridge.select_alpha(rows, (50.0, 5000.0), 3), ridge.bootstrap_se(rows, 500.0, 3).toPandas(), ridge.stability(data, 500.0, 2, 10.0).first()
    assert dense[0][0] == sparse[0][0]
    mse = [{r.alpha: r.weighted_mse for r in x[0][1].collect()} for x in (dense, sparse)]
    assert mse[0] == pytest.approx(mse[1], rel=1e-8)
    a, b = (x[1].sort_values("player_id").to_numpy(dtype=float) for x in (dense, sparse))
    assert np.abs(a - b).max() < 1e-7
    assert dense[2].rho_half == pytest.approx(sparse[2].rho_half, abs=1e-8)
