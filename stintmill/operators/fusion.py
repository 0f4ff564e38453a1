"""Fusing metrics: factors whose loadings reliability bounds, by generalised EM.

y = a + B f + e with f ~ N(0, I). A metric's loading vector is no longer than the root of its
reliability, and its residual deviation is the root of 1 - |loading|^2. The rating is the anchor: it
loads on the first factor alone. Missing cells are left out. People stay in Spark: each step sends
them the loadings and takes back one small sum a metric.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import seeded

LEAST_RESIDUAL = 0.05


def standardise(wide: DataFrame, names: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Columns less their mean over their population deviation, within each group of ``by``; without spread null."""
    stats = wide.groupBy(*by).agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    out = wide.join(F.broadcast(stats), list(by)) if by else wide.join(F.broadcast(stats))
    return out.withColumns({n: F.try_divide(F.col(n) - F.col(f"m_{n}"), F.nullif(F.col(f"s_{n}"), F.lit(0.0))) for n in names}).select(*wide.columns)


def completeness(wide: DataFrame, names: tuple[str, ...]) -> DataFrame:
    cells = sum((F.count(n) for n in names[1:]), F.count(names[0]))
    return wide.agg(F.count("*").alias("people"), (cells / (F.count("*") * len(names))).alias("observed"))


def _posterior(y: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of the factors of each row from its observed cells."""
    seen = ~np.isnan(y)
    weight = seen / s**2
    precision = np.eye(b.shape[1]) + np.einsum("nm,mk,ml->nkl", weight, b, b)
    cov = np.linalg.inv(precision)
    mean = np.einsum("nkl,nl->nk", cov, (np.where(seen, y - a, 0.0) * weight) @ b)
    return mean, cov


def _residual(b: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_RESIDUAL, np.sqrt(np.maximum(0.0, 1 - (b**2).sum(axis=1))))


def _started(names: tuple[str, ...], factors: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(len(names), factors)) * 0.1 + 0.3 * np.eye(1, factors)


def _projected(rows: np.ndarray, bound: np.ndarray, at: int, anchor_mode: str) -> np.ndarray:
    """Loadings inside their bounds, the anchor's on the first factor alone."""
    rows = rows * np.minimum(1.0, bound / np.maximum(1e-12, np.linalg.norm(rows, axis=1)))[:, None]
    own = bound[at] if anchor_mode == "fixed" else np.clip(rows[at, 0], 0.0, bound[at])
    rows[at] = own * np.eye(1, rows.shape[1])[0]
    return rows


def poisson_times(draws: int, *key: str, seed: int = 20260910):
    """An array of how often a row is drawn in each of ``draws`` resamples: Poisson(1) by a seeded hash of its key.

    Counts do not depend on partitioning, and no table of picks is joined.
    """
    chance, upto = np.exp(-1.0), [float(np.exp(-1.0))]
    for k in range(1, 12):
        chance /= k
        upto.append(upto[-1] + float(chance))
    u = lambda d: F.pmod(F.xxhash64(*key, d, F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: sum(((u(d) >= c).cast("double") for c in upto[1:]), (u(d) >= upto[0]).cast("double")))


MOST_SUMS = 4_000_000  # numbers that may reach the driver


def _pattern_sums(used: DataFrame, names: tuple[str, ...], models: list[tuple], grouped: bool, timed: bool) -> dict[tuple, list[tuple[np.ndarray, np.ndarray]]]:
    """For each model (observed, sums) of every pattern of observed cells: sums of (1, y)(1, y)', unknown cells as 0, as often as people are drawn."""
    m = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = pdf[list(names)].to_numpy(dtype=float)
            seen = ~np.isnan(y)
            one = np.concatenate([np.ones((len(y), 1)), np.where(seen, y, 0.0)], axis=1)
            times = np.stack(pdf["_times"].to_numpy()) if timed and len(pdf) else np.ones((len(y), 1))
            patterns = pd.Series(["".join("01"[c] for c in r) for r in seen.astype(int)], dtype=object)
            group = pdf["_group"].reset_index(drop=True) if grouped else pd.Series(0, index=range(len(y)))
            for (value, pattern), rows in patterns.groupby([group, patterns]).indices.items():
                own = one[rows]
                for draw, t in enumerate(times[rows].T):
                    yield pd.DataFrame({"group": [int(value)], "pattern": [pattern], "draw": [draw], "v": [((own * t[:, None]).T @ own).reshape(-1)]})

    each = used.mapInPandas(run, "group long, pattern string, draw int, v array<double>").select("group", "pattern", "draw", F.posexplode("v").alias("k", "v"))
    found = each.groupBy("group", "pattern", "draw", "k").agg(F.sum("v").alias("v")).toPandas().sort_values(["group", "pattern", "draw", "k"])
    out: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
    for (group, pattern, draw), v in found.groupby(["group", "pattern", "draw"])["v"]:
        part = (np.array([c == "1" for c in pattern]), v.to_numpy().reshape(m + 1, m + 1))
        for key in models:
            if (key[0] is None or key[0] == group) and draw == (key[1] or 0):
                out.setdefault(key, []).append(part)
    return out


def _pattern_moments(parts: list[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(metrics, moments) of a step: a metric's sums of (1, f)(1, f)' and of y (1, f), by the posterior of each pattern."""
    m, k = b.shape
    s = _residual(b)
    left, right = np.zeros((m, k + 1, k + 1)), np.zeros((m, k + 1))
    for seen, sums in parts:
        n, first, second = sums[0, 0], sums[0, 1:], sums[1:, 1:]
        loads = b.T * (seen / s**2)
        cov = np.linalg.inv(np.eye(k) + loads @ b)
        of = cov @ loads  # the posterior mean is of @ (y - a)
        mean = of @ (first - n * a)
        centred = second - np.outer(first, a) - np.outer(a, first) + n * np.outer(a, a)
        whole = np.block([[np.array([[n]]), mean[None, :]], [mean[:, None], of @ centred @ of.T + n * cov]])
        left[seen] += whole
        right[seen] += np.concatenate([first[:, None], (second - np.outer(first, a)) @ of.T], axis=1)[seen]
    return np.concatenate([left.reshape(m, -1), right], axis=1)


def fit_many(
    wide: DataFrame,
    names: tuple[str, ...],
    reliability: dict[str, float],
    anchor: str,
    models: list[tuple],
    group: str | None = None,
    times: str | None = None,
    factors: int = 2,
    steps: int = 30,
    tol: float = 1e-4,
    anchor_mode: str = "fixed",
    begin: dict[str, np.ndarray] | None = None,
) -> dict[tuple, dict[str, np.ndarray]]:
    """Many models at once. People are read once: the moments of a step follow from the sums of cells and their products
    by the pattern of observed cells, so steps need no job. Beyond MOST_SUMS such sums a step reads the people once instead,
    for every model that still moves.

    models: (value of ``group``, draw, seed) each. A model takes the people of its group (all where it is None),
    as often as the array ``times`` says at its draw (once where it is None), and starts from its seed, or
    from ``begin``. What goes to the tasks and comes back grows with models x metrics only. Stage wide.
    """
    if anchor_mode not in ("fixed", "positive"):
        raise ValueError(f"no anchor mode {anchor_mode!r}")
    m, k = len(names), factors
    bound = np.array([np.sqrt(reliability.get(n, 1.0)) for n in names])
    at = names.index(anchor)
    first = lambda seed: _started(names, k, seed) if begin is None else begin["loadings"]
    now = {key: (np.zeros(m) if begin is None else begin["intercepts"], _projected(first(key[2]).copy(), bound, at, anchor_mode)) for key in models}
    spread = {key: np.zeros((m, k)) for key in models}
    moving, size = list(models), (k + 1) ** 2 + k + 1
    used = wide.select(*([F.col(group).alias("_group")] if group else []), *([F.col(times).alias("_times")] if times else []), *names)
    patterns = used.select(*(["_group"] if group else []), *[F.col(n).isNull().alias(n) for n in names]).distinct().count()
    few = patterns * len(models) * (m + 1) ** 2 <= MOST_SUMS
    known = _pattern_sums(used, names, models, bool(group), bool(times)) if few else {}
    for _ in range(steps):

        def moments(batches: Iterator[pd.DataFrame], now=dict(now), moving=tuple(moving)) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                y = pdf[list(names)].to_numpy(dtype=float)
                drawn = np.array(pdf["_times"].tolist()) if times else None
                where = pdf["_group"].to_numpy() if group else None
                for number, key in enumerate(moving):
                    own = slice(None) if key[0] is None else where == key[0]
                    rows = y[own]
                    if not len(rows):
                        continue
                    a, b = now[key]
                    mean, cov = _posterior(rows, a, b, _residual(b))
                    one = np.concatenate([np.ones((len(rows), 1)), mean], axis=1)
                    second = np.einsum("ni,nj->nij", one, one)
                    second[:, 1:, 1:] += cov
                    seen = ~np.isnan(rows)
                    weight = seen * (1.0 if key[1] is None else drawn[own, key[1]][:, None])
                    left = np.einsum("nm,nij->mij", weight, second).reshape(m, -1)
                    right = (np.where(seen, rows, 0.0) * weight).T @ one
                    yield pd.DataFrame({"model": number, "metric": range(m), "v": list(np.concatenate([left, right], axis=1))})

        if few:
            found = {n: _pattern_moments(known[key], *now[key]) for n, key in enumerate(moving) if key in known}
        else:
            sums = used.mapInPandas(moments, "model int, metric int, v array<double>")
            summed = sums.groupBy("model", "metric").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(size)]).orderBy("model", "metric").toPandas()
            found = {n: pdf[[f"v{i}" for i in range(size)]].to_numpy() for n, pdf in summed.groupby("model")}
        after = []
        for number, v in found.items():
            key = moving[number]
            grams = v[:, : (k + 1) ** 2].reshape(m, k + 1, k + 1) + 1e-9 * np.eye(k + 1)
            c = np.linalg.solve(grams, v[:, (k + 1) ** 2 :, None])[:, :, 0]
            b = _projected(c[:, 1:], bound, at, anchor_mode)
            spread[key] = np.sqrt(np.maximum(0.0, np.einsum("mii->mi", np.linalg.inv(grams))[:, 1:])) * _residual(b)[:, None]
            if np.abs(b - now[key][1]).max() >= tol:
                after.append(key)
            now[key] = (c[:, 0], b)
        if not after:
            break
        moving = after
    return {key: {"loadings": b, "loading_sd": spread[key], "intercepts": a, "bounds": bound} for key, (a, b) in now.items()}


def fit(wide: DataFrame, names: tuple[str, ...], reliability: dict[str, float], anchor: str, factors: int = 2, steps: int = 30, tol: float = 1e-4, seed: int = 20260910, anchor_mode: str = "fixed") -> dict[str, np.ndarray]:
    """Loadings (metric x factor), their deviations, intercepts and bounds. wide must not be recomputed at each step: stage it.

    The anchor's loading is its bound ("fixed"), or free between 0 and that ("positive"). Deviations are those of the
    information of the last step; ``refitted`` has those of a bootstrap.
    """
    key = (None, None, seed)
    return fit_many(wide, names, reliability, anchor, [key], factors=factors, steps=steps, tol=tol, anchor_mode=anchor_mode)[key]


def aligned(loadings: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Loadings turned to agree with others: each factor's sign, the first alone and the rest after the rotation that fits best."""
    out = loadings.copy()
    if out[:, 0] @ to[:, 0] < 0:
        out[:, 0] = -out[:, 0]
    if out.shape[1] > 1:
        u, _, v = np.linalg.svd(out[:, 1:].T @ to[:, 1:])
        out[:, 1:] = out[:, 1:] @ (u @ v)
    return out


def refitted(wide: DataFrame, key: str, names: tuple[str, ...], reliability: dict[str, float], anchor: str, draws: int = 50, seed: int = 20260910, **options) -> dict[str, np.ndarray]:
    """``fit`` with ``loading_sd`` from refits on resampled people, all draws in the same passes.

    Refits start from the fit, and are aligned to it before their deviation is taken.
    """
    whole = fit(wide, names, reliability, anchor, seed=seed, **options)
    drawn = wide.withColumn("_drawn", poisson_times(draws, key, seed=seed))
    each = fit_many(drawn, names, reliability, anchor, [(None, d, seed) for d in range(draws)], times="_drawn", begin=whole, **options)
    turned = np.array([aligned(f["loadings"], whole["loadings"]) for f in each.values()])
    return whole | {"loading_sd": turned.std(axis=0, ddof=1), "draws": turned}


def convergence(wide: DataFrame, key: str, names: tuple[str, ...], reliability: dict[str, float], anchor: str, starts: int = 4, **options) -> DataFrame:
    """(part, metric, spread): how far random starts lie apart; small when fits agree.

    part loading: the first factor's loading of a metric, and nuisance: the length of the other factors', over starts.
    part score: the mean (metric ``mean``) and the largest (``most``) spread of a person's rating.
    """
    models = [(None, None, s) for s in range(starts)]
    each = list(fit_many(wide, names, reliability, anchor, models, **options).values())
    first = np.array([f["loadings"][:, 0] for f in each])
    rest = np.array([np.linalg.norm(f["loadings"][:, 1:], axis=1) for f in each])
    rows = [("loading", n, float(d)) for n, d in zip(names, np.ptp(first, axis=0), strict=True)]
    rows += [("nuisance", n, float(d)) for n, d in zip(names, np.ptp(rest, axis=0), strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = pdf[list(names)].to_numpy(dtype=float)
            rated = np.array([_posterior(y, f["intercepts"], f["loadings"], _residual(f["loadings"]))[0][:, 0] for f in each])
            yield pd.DataFrame({"d": np.ptp(rated, axis=0)})

    lies = wide.select(*names).mapInPandas(run, "d double").agg(F.avg("d").alias("mean"), F.max("d").alias("most")).select(F.lit("score").alias("part"), F.expr("stack(2, 'mean', mean, 'most', most) as (metric, spread)"))
    return wide.sparkSession.createDataFrame(rows, "part string, metric string, spread double").unionByName(lies)


def loading_table(spark, names: tuple[str, ...], model: dict) -> DataFrame:
    """(metric, loading, loading_sd, bound, share_of_bound, nuisance): the first factor's loading beside its bound."""
    b, bound, sd = model["loadings"], model["bounds"], model["loading_sd"]
    rows = [(n, float(b[i, 0]), float(sd[i, 0]), float(bound[i]), float(abs(b[i, 0]) / bound[i]), float(np.linalg.norm(b[i, 1:]))) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "metric string, loading double, loading_sd double, bound double, share_of_bound double, nuisance double")


def scores(wide: DataFrame, key: str, names: tuple[str, ...], model: dict, z: float = 1.6448536269514722) -> DataFrame:
    """(key, rating, sd, low, high): the first factor's posterior of each person."""
    return group_scores(wide.withColumn("_all", F.lit(0)), "_all", key, names, {0: model}, z).drop("_all")


def group_scores(wide: DataFrame, group: str, key: str, names: tuple[str, ...], models: dict, z: float = 1.6448536269514722) -> DataFrame:
    """(group, key, rating, sd, low, high): ``scores`` by the model of each person's group; people of a group without one are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for value, own in pdf.groupby(group):
                if value in models:
                    b = models[value]["loadings"]
                    mean, cov = _posterior(own[list(names)].to_numpy(dtype=float), models[value]["intercepts"], b, _residual(b))
                    sd = np.sqrt(cov[:, 0, 0])
                    yield pd.DataFrame({group: value, key: own[key], "rating": mean[:, 0], "sd": sd, "low": mean[:, 0] - z * sd, "high": mean[:, 0] + z * sd})

    return wide.select(F.col(group).cast("long").alias(group), key, *names).mapInPandas(run, f"{group} long, {key} long, rating double, sd double, low double, high double")


def hidden_cells(wide: DataFrame, key: str, names: tuple[str, ...], share: float = 0.15, seed: int = 20260910) -> DataFrame:
    """wide with a seeded share of its observed cells set to null."""
    hide = lambda n: F.conv(F.substring(seeded(key, F.lit(n), seed=seed), 1, 8), 16, 10).cast("long") < int(share * 2**32)
    return wide.withColumns({n: F.when(~hide(n), F.col(n)) for n in names})


def calibration(wide: DataFrame, key: str, names: tuple[str, ...], reliability: dict[str, float], anchor: str, share: float = 0.15, z: float = 1.6448536269514722, nominal: float = 0.90, steps: int = 15, least: int = 10) -> DataFrame:
    """(metric, hidden, covered, median_width, verdict): hidden values inside their predictive interval.

    A null metric is the row over all. Fewer than ``least`` hidden cells raise: they would say nothing.
    """
    masked = hidden_cells(wide, key, names, share)
    both = wide.select(key, *[F.col(n).alias(f"true_{n}") for n in names]).join(masked.select(key, *names), key)
    hidden = both.agg(sum((F.count(F.when(F.col(n).isNull(), F.col(f"true_{n}"))) for n in names[1:]), F.count(F.when(F.col(names[0]).isNull(), F.col(f"true_{names[0]}"))))).first()[0]
    if hidden < least:
        raise ValueError(f"only {hidden} cells to hide; at least {least} are needed")
    model = fit(masked, names, reliability, anchor, steps=steps)
    a, b = model["intercepts"], model["loadings"]
    s = _residual(b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y, true = pdf[list(names)].to_numpy(dtype=float), pdf[[f"true_{n}" for n in names]].to_numpy(dtype=float)
            mean, cov = _posterior(y, a, b, s)
            centre = a + mean @ b.T
            half = z * np.sqrt(np.einsum("mk,nkl,ml->nm", b, cov, b) + s**2)
            row, col = np.nonzero(np.isnan(y) & ~np.isnan(true))
            yield pd.DataFrame({"metric": [names[c] for c in col], "inside": np.abs(true - centre)[row, col] <= half[row, col], "width": 2 * half[row, col]})

    cells = both.mapInPandas(run, "metric string, inside boolean, width double")
    # widths differ by the pattern of observed cells alone, so a median within 1 % of rank is taken from a sketch
    out = cells.rollup("metric").agg(F.count("*").alias("hidden"), F.avg(F.col("inside").cast("double")).alias("covered"), F.percentile_approx("width", 0.5, 10_000).alias("median_width"))
    gap = F.col("covered") - nominal
    return out.withColumn("verdict", F.when(F.abs(gap) <= 0.05, "calibrated").when(gap < 0, "over-confident").otherwise("under-confident"))
