"""Team panels and out-of-sample comparison of candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import spearman, t_two_sided
from . import trees

KEYS = ("season", "team_id")


def next_season_target(panel: DataFrame, ratings: DataFrame, target: str) -> DataFrame:
    """panel plus the team's value of the following season as ``target``; rows without one go."""
    ahead = ratings.select((F.col("season") - 1).alias("season"), "team_id", F.col(target).alias("target"))
    return panel.join(ahead, list(KEYS)).dropna(subset=["target"])


def long_panel(panel: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    return panel.unpivot([*KEYS, "target"], list(candidates), "candidate", "value")


def without(panel: DataFrame, *names: str) -> DataFrame:
    return panel.drop(*names)


def only(panel: DataFrame, *names: str) -> DataFrame:
    return panel.select(*KEYS, "target", *[n for n in names if n in panel.columns])


def folds(panel: DataFrame) -> DataFrame:
    """(held_out, train, test) rows of each season held out; at least five to train on and one to test."""
    seasons = panel.select(F.col("season").alias("held_out")).distinct()
    sized = panel.join(F.broadcast(seasons)).groupBy("held_out").agg(
        F.count(F.when(F.col("season") != F.col("held_out"), 1)).alias("train"), F.count(F.when(F.col("season") == F.col("held_out"), 1)).alias("test")
    )
    return sized.withColumn("usable", (F.col("train") >= 5) & (F.col("test") > 0))


def candidate_errors(long: DataFrame) -> DataFrame:
    """Squared error of every row by a line fitted on the other seasons, for each candidate."""
    seasons = long.select(F.col("season").alias("held_out")).distinct()
    have = long.where("value is not null")
    lines = have.join(F.broadcast(seasons), F.col("season") != F.col("held_out")).groupBy("candidate", "held_out").agg(
        F.regr_slope("target", "value").alias("slope"), F.regr_intercept("target", "value").alias("intercept"), F.regr_count("target", "value").alias("n")
    )
    scored = have.withColumnRenamed("season", "held_out").join(lines.where("n >= 3 and slope is not null"), ["candidate", "held_out"])
    error = F.col("slope") * F.col("value") + F.col("intercept") - F.col("target")
    return scored.select("candidate", F.col("held_out").alias("season"), "team_id", (error * error).alias("squared_error"))


def compare_candidates(long: DataFrame) -> DataFrame:
    """RMSE of every candidate and its distance to the best."""
    table = candidate_errors(long).groupBy("candidate").agg(F.sqrt(F.avg("squared_error")).alias("rmse"), F.count("*").alias("observations"))
    return table.join(table.agg(F.min("rmse").alias("_b"))).withColumn("vs_best", F.round(F.col("rmse") - F.col("_b"), 4)).drop("_b")


def paired(errors: DataFrame, first: str, second: str, with_p: bool = False) -> DataFrame:
    """One row: the paired t statistic of two candidates' squared errors on the rows that both scored."""
    a, b = (errors.where(F.col("candidate") == c).select(*KEYS, F.col("squared_error").alias(n)) for c, n in ((first, "a"), (second, "b")))
    d = F.col("a") - F.col("b")
    out = a.join(b, list(KEYS)).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"), (F.sqrt(F.avg("a")) - F.sqrt(F.avg("b"))).alias("rmse_gap")
    )
    out = out.withColumn("t", F.when(F.col("n") >= 3, F.try_divide(F.col("mean_difference"), F.col("sd") / F.sqrt("n"))))
    if with_p:
        out = out.withColumn("p", F.udf(lambda t, n: None if t is None else t_two_sided(t, n - 1), "double")("t", "n"))  # one row
    return out


RIDGE_ALPHAS = tuple(10.0**k for k in range(-3, 5))


def _prepared(train: pd.DataFrame, test: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean-imputed and scaled features, by the training rows alone."""
    mean = train[names].mean().fillna(0.0)
    x, z = train[names].fillna(mean).to_numpy(), test[names].fillna(mean).to_numpy()
    sd = x.std(axis=0)
    sd[sd == 0] = 1.0
    return (x - mean.to_numpy()) / sd, (z - mean.to_numpy()) / sd


def _ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    b = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - y.mean()))
    return float(y.mean()), b


def _tuned(train: pd.DataFrame, columns: list[str], alphas: tuple[float, ...]) -> tuple[float, float]:
    """(error, penalty) that does best over the seasons of train, each held out in turn."""
    score = {}
    for alpha in alphas:
        errors = []
        for inner in sorted(train["season"].unique()):
            a, b = train[train["season"] != inner], train[train["season"] == inner]
            if len(a) < 5 or b.empty:
                continue
            x, z = _prepared(a, b, columns)
            c, w = _ridge(x, a["target"].to_numpy(), alpha)
            errors.extend((c + z @ w - b["target"].to_numpy()) ** 2)
        score[alpha] = float(np.mean(errors)) if errors else np.inf
    best = min(alphas, key=lambda v: score[v])
    return score[best], best


def ridge_baseline(panel: DataFrame, names: tuple[str, ...], alphas: tuple[float, ...] = RIDGE_ALPHAS) -> DataFrame:
    """(held_out, team_id, alpha, squared_error): nested selection, the held-out season never seen.

    A task takes one held-out season; its rows are a panel of seasons x teams, small by nature.
    """
    columns = list(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf["held_out"].iloc[0]
        train, test = pdf[pdf["season"] != held], pdf[pdf["season"] == held]
        _, best = _tuned(train, columns, alphas)
        x, z = _prepared(train, test, columns)
        c, w = _ridge(x, train["target"].to_numpy(), best)
        return pd.DataFrame({"held_out": held, "team_id": test["team_id"], "alpha": best, "squared_error": (c + z @ w - test["target"].to_numpy()) ** 2})

    seasons = panel.select(F.col("season").alias("held_out")).distinct()
    return panel.join(F.broadcast(seasons)).groupBy("held_out").applyInPandas(run, "held_out long, team_id long, alpha double, squared_error double")


def baseline_table(**errors: DataFrame) -> DataFrame:
    """(model, rmse) of several baselines."""
    out = None
    for name, e in errors.items():
        row = e.agg(F.lit(name).alias("model"), F.sqrt(F.avg("squared_error")).alias("rmse"), F.count("*").alias("observations"))
        out = row if out is None else out.unionByName(row)
    return out


def ridge_attribution(panel: DataFrame, names: tuple[str, ...], alphas: tuple[float, ...] = RIDGE_ALPHAS) -> DataFrame:
    """(feature, mean_abs, mean_signed): exact Shapley values b_j (x_j - mean_j) of every row, by a ridge
    fitted on all rows at the penalty that does best over held-out seasons.

    The fit is one task over a panel of seasons x teams; the values are taken from all rows by Spark.
    """
    columns = list(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, best = _tuned(pdf, columns, alphas)
        x, _ = _prepared(pdf, pdf, columns)
        _, w = _ridge(x, pdf["target"].to_numpy(), best)
        sd = pdf[columns].fillna(pdf[columns].mean().fillna(0.0)).to_numpy().std(axis=0)
        return pd.DataFrame({"feature": columns, "weight": w / np.where(sd == 0, 1.0, sd), "mean": pdf[columns].mean().fillna(0.0).to_numpy()})

    used = panel.select("season", "team_id", *columns, "target")
    weights = used.groupBy().applyInPandas(run, "feature string, weight double, mean double")
    each = used.unpivot(["season", "team_id"], columns, "feature", "value").join(F.broadcast(weights), "feature")  # a row a feature
    value = F.coalesce(F.col("weight") * (F.col("value") - F.col("mean")), F.lit(0.0))
    return each.groupBy("feature").agg(F.avg(F.abs(value)).alias("mean_abs"), F.avg(value).alias("mean_signed"))


def attribution_agreement(attribution: DataFrame, loadings: DataFrame) -> DataFrame:
    """Rank correlation of mean absolute attribution and absolute loading; null below three shared."""
    both = attribution.join(loadings.select(F.col("metric").alias("feature"), F.abs("loading").alias("size")), "feature").withColumn("all", F.lit(1))
    return spearman(both, "mean_abs", "size", ("all",)).select(F.when(F.col("n") >= 3, F.col("spearman")).alias("agreement"), "n")


def claim_report(panel: DataFrame, names: tuple[str, ...], beyond_box: tuple[str, ...], against: tuple[str, ...] = (), trials: int = 40) -> DataFrame:
    """(part, model, value, observations, p): all that a comparison of candidates says. Stage the panel.

    rmse: every candidate alone, and ridge and trees over all inputs (``_all``) and over those without ``beyond_box``
    (``_box``). paired: the best candidate less each of ``against``; box_only: the better box-score model less the
    best candidate of the box score, both with the p value of a paired t test. attribution: the tree model's mean
    absolute Shapley values. Ties go to the name that sorts first.
    """
    box = tuple(n for n in names if n not in beyond_box)
    single = candidate_errors(long_panel(panel, names))
    as_candidate = lambda e, name: e.select(F.lit(name).alias("candidate"), F.col("held_out").alias("season"), "team_id", "squared_error")
    errors_all, _, model = trees.nested_search(panel, names, trials)
    errors_box, _, _ = trees.nested_search(panel, box, trials)
    found = {"ridge_all": ridge_baseline(panel, names), "trees_all": errors_all, "ridge_box": ridge_baseline(panel, box), "trees_box": errors_box}
    errors = single
    for name, e in found.items():
        errors = errors.unionByName(as_candidate(e, name))
    errors = errors.cache()  # models x seasons x teams
    table = errors.groupBy("candidate").agg(F.sqrt(F.avg("squared_error")).alias("rmse"), F.count("*").alias("observations")).orderBy("rmse", "candidate").collect()  # a row a model
    order = [r.candidate for r in table]
    best = next((c for c in order if c in names), None)
    spark = panel.sparkSession
    out = spark.createDataFrame([("rmse", r.candidate, r.rmse, r.observations, None) for r in table], "part string, model string, value double, observations long, p double")
    tests = [("paired", best, other) for other in against if other != best and other in order]
    one, two = next((c for c in order if c.endswith("_box") and c in found), None), next((c for c in order if c in box), None)
    tests += [("box_only", one, two)] if one and two else []
    for part, a, b in tests:
        row = paired(errors, a, b, with_p=True)
        out = out.unionByName(row.select(F.lit(part).alias("part"), F.lit(f"{a} - {b}").alias("model"), F.col("rmse_gap").alias("value"), F.col("n").alias("observations"), "p"))
    said = trees.tree_attribution(panel, names, model)
    nothing = F.lit(None)
    return out.unionByName(said.select(F.lit("attribution").alias("part"), F.col("feature").alias("model"), F.col("mean_abs").alias("value"), nothing.cast("long").alias("observations"), nothing.cast("double").alias("p")))
