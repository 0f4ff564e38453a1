"""Boosted regression trees on a small table, searched and explained by Spark.

A panel of seasons x teams has some hundred rows, so one fit is a short task; what is large is their number:
every pair of seasons left out times every set of parameters. Spark deals these fits, each a task over the
broadcast panel, and Shapley values are one exploded table of row x order x background row.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20260910
MOST_PANEL_ROWS = 50_000  # a panel that is broadcast
BINS = 64
NODE = "tree int, node int, feature int, threshold double, missing_left boolean, left int, right int, value double"
# The ranges that parameters are drawn from; (least, greatest, kind).
RANGES = {
    "n_estimators": (50, 400, "int"),
    "learning_rate": (0.01, 0.3, "log"),
    "num_leaves": (3, 31, "int"),
    "min_child_samples": (5, 40, "int"),
    "subsample": (0.6, 1.0, "plain"),
    "colsample_bytree": (0.5, 1.0, "plain"),
    "reg_lambda": (1e-3, 10.0, "log"),
}


def drawn(trials: int, seed: int = SEED, ranges: dict = RANGES) -> list[dict[str, float]]:
    """Seeded sets of parameters; the first ``n`` of more trials are those of ``n`` trials."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trials):
        one = {}
        for name, (low, high, kind) in ranges.items():
            u = rng.random()
            one[name] = int(low + u * (high + 1 - low)) if kind == "int" else float(np.exp(np.log(low) + u * np.log(high / low))) if kind == "log" else float(low + u * (high - low))
        out.append(one)
    return out


class Trees:
    """An ensemble as a table of nodes (see NODE; feature -1 at a leaf) and the value that it starts from (tree -1)."""

    def __init__(self, nodes: pd.DataFrame):
        start = nodes[nodes["tree"] < 0]
        self.start = float(start["value"].iloc[0]) if len(start) else 0.0
        rows = nodes[nodes["tree"] >= 0].sort_values(["tree", "node"])
        self.first = np.flatnonzero(rows["node"].to_numpy() == 0)
        base = np.repeat(self.first, np.diff(np.append(self.first, len(rows))))
        self.feature, self.threshold, self.value = rows["feature"].to_numpy(), rows["threshold"].to_numpy(), rows["value"].to_numpy()
        self.missing_left = rows["missing_left"].to_numpy(dtype=bool)
        self.left, self.right = rows["left"].to_numpy() + base, rows["right"].to_numpy() + base

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        every = np.arange(len(x))
        for root in self.first:
            at, open_ = np.full(len(x), root), every
            while len(open_ := open_[self.feature[at[open_]] >= 0]):
                here = at[open_]
                v = x[open_, self.feature[here]]
                left = np.where(np.isnan(v), self.missing_left[here], v <= self.threshold[here])
                at[open_] = np.where(left, self.left[here], self.right[here])
            out += self.value[at]
        return out


def _best_split(count: np.ndarray, total: np.ndarray, least: int, ridge: float) -> tuple[float, int, int, bool] | None:
    """(gain, feature, bin, missing goes left) of a node from its sums by feature and bin; the last bin is the missing ones."""
    n, s = count[0].sum(), total[0].sum()
    best = None
    for missing_left in (False, True):
        nl, sl = np.cumsum(count[:, :-1], axis=1), np.cumsum(total[:, :-1], axis=1)
        if missing_left:
            nl, sl = nl + count[:, -1:], sl + total[:, -1:]
        nr, sr = n - nl, s - sl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((nl >= least) & (nr >= least), sl**2 / (nl + ridge) + sr**2 / (nr + ridge) - s**2 / (n + ridge), -np.inf)
        k = int(np.argmax(gain))
        if gain.flat[k] > 1e-12 and (best is None or gain.flat[k] > best[0] + 1e-12):
            best = (float(gain.flat[k]), k // gain.shape[1], k % gain.shape[1], missing_left)
    return best


def grow(x: np.ndarray, y: np.ndarray, params: dict[str, float], seed: int = SEED) -> pd.DataFrame:
    """Nodes of an ensemble for squared error; nulls (NaN) go to the side that gains more."""
    n, p = x.shape
    rng = np.random.default_rng(seed)
    edges = []
    for j in range(p):
        seen = np.unique(x[~np.isnan(x[:, j]), j])
        middle = (seen[1:] + seen[:-1]) / 2
        edges.append(middle if len(middle) < BINS else np.unique(np.quantile(middle, np.linspace(0, 1, BINS - 1))))
    bins = max(map(len, edges), default=0) + 2
    codes = np.stack([np.where(np.isnan(x[:, j]), bins - 1, np.searchsorted(edges[j], x[:, j], "left")) for j in range(p)], axis=1)
    least, ridge, rate = int(params["min_child_samples"]), params["reg_lambda"], params["learning_rate"]
    taken, width = max(1, round(n * params["subsample"])), max(1, math.ceil(p * params["colsample_bytree"]))
    start = float(y.mean())
    guess, nodes = np.full(n, start), [(-1, 0, -1, 0.0, False, 0, 0, start)]

    for tree in range(int(params["n_estimators"])):
        bag = np.zeros(n)
        bag[rng.permutation(n)[:taken]] = 1.0
        own = np.sort(rng.permutation(p)[:width])
        flat, left_over = codes[:, own] + np.arange(width) * bins, (y - guess) * bag

        def split(rows: np.ndarray):
            at, w = flat[rows].ravel(), bag[rows]
            count = np.bincount(at, np.repeat(w, width), width * bins).reshape(width, bins)
            total = np.bincount(at, np.repeat(left_over[rows], width), width * bins).reshape(width, bins)
            return _best_split(count, total, least, ridge)

        grown = [[-1, 0.0, False, 0, 0, np.arange(n)]]
        queue = []
        if found := split(grown[0][5]):
            heapq.heappush(queue, (-found[0], 0, found))
        leaves = 1
        while queue and leaves < params["num_leaves"]:
            _, at, (_, j, cut, missing_left) = heapq.heappop(queue)
            rows, feature = grown[at][5], int(own[j])
            code = codes[rows, feature]
            left = np.where(code == bins - 1, missing_left, code <= cut)
            grown[at][:5] = [feature, float(edges[feature][cut]) if cut < len(edges[feature]) else np.inf, missing_left, len(grown), len(grown) + 1]
            for part in (rows[left], rows[~left]):
                grown.append([-1, 0.0, False, 0, 0, part])
                if found := split(part):
                    heapq.heappush(queue, (-found[0], len(grown) - 1, found))
            leaves += 1
        for at, (feature, threshold, missing_left, a, b, rows) in enumerate(grown):
            value = 0.0
            if feature < 0:
                value = rate * float(left_over[rows].sum() / (bag[rows].sum() + ridge)) if len(rows) else 0.0
                guess[rows] += value
            nodes.append((tree, at, feature, threshold, missing_left, a, b, value))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "missing_left", "left", "right", "value"])


def _arrays(pdf: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return pdf[names].to_numpy(dtype=float), pdf["target"].to_numpy(dtype=float)


def _broadcast(panel: DataFrame, names: list[str]):
    small = panel.select("season", "team_id", *names, "target").where("target is not null").limit(MOST_PANEL_ROWS + 1).toPandas()
    if len(small) > MOST_PANEL_ROWS:
        raise ValueError(f"a panel of more than {MOST_PANEL_ROWS} rows is not one to search by whole fits")
    return panel.sparkSession.sparkContext.broadcast(small.sort_values(["season", "team_id"], ignore_index=True))


def nested_search(panel: DataFrame, names: tuple[str, ...], trials: int = 40, seed: int = SEED, ranges: dict = RANGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(errors, choices, model) of boosted trees by nested leave-one-season-out selection.

    errors: held_out, team_id, trial, squared_error; the season held out neither trains nor chooses.
    choices: held_out, trial, inner_rmse, params (JSON); a null held_out is the search over all seasons, whose
    parameters give the model (its nodes), fitted on all rows and kept for attribution, never for an error.

    A fit without seasons a and b serves a as the outer season and b as the inner one, and the reverse; a fit
    without a alone serves the last search and, if its parameters win, a's error. So trials x S (S + 1) / 2
    fits answer every search, each dealt to a task of its own. Seasons with fewer than five rows left to
    train on are not scored.
    """
    spark, columns = panel.sparkSession, list(names)
    shared, sets = _broadcast(panel, columns), drawn(trials, seed, ranges)
    seasons = sorted(shared.value["season"].unique().tolist())
    jobs = [(a, b, t) for a, b in itertools.combinations_with_replacement(seasons, 2) for t in range(trials)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = shared.value
        for pdf in batches:
            for a, b, t in pdf.itertuples(index=False):
                train = whole[(whole["season"] != a) & (whole["season"] != b)]
                if len(train) < 5:
                    continue
                trees = Trees(grow(*_arrays(train, columns), sets[t], seed))
                for outer, inner in {(a, b), (b, a)}:
                    test = whole[whole["season"] == inner]
                    x, y = _arrays(test, columns)
                    yield pd.DataFrame({"outer": outer, "inner": inner, "trial": t, "team_id": test["team_id"], "squared_error": (trees.predict(x) - y) ** 2})

    dealt = spark.createDataFrame(jobs, "a long, b long, trial int").repartition(max(1, len(jobs) // 4), "a", "b", "trial")
    scored = dealt.mapInPandas(run, "outer long, inner long, trial int, team_id long, squared_error double").cache()  # panel rows x trials x seasons
    of = F.when(F.col("outer") != F.col("inner"), F.col("outer"))
    tried = scored.groupBy(of.alias("held_out"), "trial").agg(F.sqrt(F.avg("squared_error")).alias("rmse"))
    best = tried.groupBy("held_out").agg(F.min(F.struct("rmse", "trial")).alias("best")).select("held_out", "best.trial", F.col("best.rmse").alias("inner_rmse"))
    texts = spark.createDataFrame([(t, json.dumps(s, sort_keys=True)) for t, s in enumerate(sets)], "trial int, params string")
    choices = best.join(F.broadcast(texts), "trial").select("held_out", "trial", "inner_rmse", "params")
    own = scored.where("outer = inner").select(F.col("outer").alias("held_out"), "team_id", "trial", "squared_error")
    errors = own.join(F.broadcast(best.where("held_out is not null").select("held_out", "trial")), ["held_out", "trial"])

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf["trial"]:
                yield grow(*_arrays(shared.value, columns), sets[t], seed)

    model = best.where("held_out is null").select("trial").mapInPandas(keep, NODE)
    return errors.select("held_out", "team_id", "trial", "squared_error"), choices, model


def shapley(panel: DataFrame, names: tuple[str, ...], model: DataFrame, orders: int = 24, background: int = 32, seed: int = SEED) -> DataFrame:
    """(season, team_id, feature, value, prediction, base): what each feature adds to each row's prediction.

    A feature's value is what it changes when it takes the row's value after those before it in an order,
    from a background row's values; averaged over orders and background rows. With at most ``orders``
    orders of the features all are taken, and the values are exact; else as many seeded ones. The
    background is the panel, or a seeded part of it of about ``background`` rows. A row's values add up to its
    prediction less the base, the background's mean prediction.
    """
    spark, columns = panel.sparkSession, list(names)
    p = len(columns)
    trees = spark.sparkContext.broadcast(Trees(model.toPandas()))  # at most some ten thousand nodes
    rng = np.random.default_rng(seed)
    ways = list(itertools.permutations(range(p))) if math.factorial(p) <= orders else [tuple(rng.permutation(p).tolist()) for _ in range(orders)]
    rows = panel.select("season", "team_id", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    behind = rows.select(F.col("x").alias("z")).orderBy(F.xxhash64("season", "team_id", F.lit(seed)), "season", "team_id").limit(background)
    orders_df = spark.createDataFrame([(list(w),) for w in ways], "way array<int>")
    asked = rows.join(F.broadcast(behind)).join(F.broadcast(orders_df))  # at most background x orders a row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, z = (np.array(pdf[c].tolist(), dtype=float) for c in ("x", "z"))
            way = np.array(pdf["way"].tolist())
            steps = np.repeat(z[:, None, :], p + 1, axis=1)
            for k in range(p):
                at = way[:, k]
                steps[np.arange(len(x))[:, None], np.arange(k + 1, p + 1)[None, :], at[:, None]] = x[np.arange(len(x)), at][:, None]
            said = trees.value.predict(steps.reshape(-1, p)).reshape(len(x), p + 1)
            gained = np.empty((len(x), p))
            np.put_along_axis(gained, way, np.diff(said, axis=1), axis=1)
            yield pd.DataFrame({"season": pdf["season"], "team_id": pdf["team_id"], "gained": list(gained), "prediction": said[:, -1], "base": said[:, 0]})

    each = asked.repartition("season", "team_id").mapInPandas(run, "season long, team_id long, gained array<double>, prediction double, base double")
    summed = each.groupBy("season", "team_id").agg(*[F.avg(F.get("gained", F.lit(k))).alias(c) for k, c in enumerate(columns)], F.avg("prediction").alias("prediction"), F.avg("base").alias("base"))
    return summed.unpivot(["season", "team_id", "prediction", "base"], columns, "feature", "value")


def tree_attribution(panel: DataFrame, names: tuple[str, ...], model: DataFrame, **options) -> DataFrame:
    """(feature, mean_abs, mean_signed, base) of ``shapley`` over every row."""
    each = shapley(panel, names, model, **options)
    return each.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean_signed"), F.avg("base").alias("base"))


def log_runs(results: DataFrame, path: str, experiment: str, run: str) -> None:
    """Append one run to a log: its own folder, written whole, so that a retry leaves it once."""
    results.write.mode("overwrite").parquet(f"{path}/experiment={experiment}/run={run}")


def read_runs(spark, path: str) -> DataFrame:
    """Every run of a log with its experiment and run."""
    return spark.read.option("mergeSchema", "true").parquet(path)
