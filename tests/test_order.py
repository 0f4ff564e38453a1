"""Order over whole tables against plain sorting."""

import numpy as np
import pytest

from stintmill.functions import order, stats
from stintmill.operators import drift


@pytest.mark.parametrize("kind", ["plain", "ties", "one", "skewed"])
def test_order_statistics_equal_a_sort(spark, kind):
    rng = np.random.default_rng(3)
    x = {"plain": rng.normal(size=5000), "ties": rng.integers(0, 4, 5000).astype(float), "one": np.full(500, 2.5), "skewed": np.concatenate([np.zeros(3000), 10.0 ** rng.uniform(-300, 300, 2000)])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    ranks = [0, 1, 250, 333, len(x) // 2, len(x) - 2, len(x) - 1]
    got = order.order_statistics(df, "x", ranks, cuts=10, few=30)
    assert got == {r: np.sort(x)[r] for r in ranks}
    shares = [k / 10 for k in range(11)]
    assert order.quantiles(df, "x", shares) == pytest.approx(np.quantile(x, shares))


def test_places_tiles_and_running_sums(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(v)) for i, v in enumerate(rng.integers(0, 50, 1003))]
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [r.id for r in sorted(order.numbered(df, "v", "id").collect(), key=lambda r: r.place)] == [i for i, _ in want]
    got = {r.id: r.tile for r in order.tiles(df, 7, "v", "id").collect()}
    assert [got[i] for i, _ in want] == [k for k, part in enumerate(np.array_split(np.arange(1003), 7)) for _ in part]
    sums = {r.id: r.before for r in order.running(df, "v", "v", "id").collect()}
    assert [sums[i] for i, _ in want] == [0, *np.cumsum([v for _, v in want])[:-1].tolist()]
    ranks = {r.id: r.r for r in stats.with_average_rank(df, "v", (), "r").collect()}
    plain = {v: np.mean([k + 1 for k, (_, x) in enumerate(want) if x == v]) for v in range(50)}
    assert all(ranks[i] == plain[v] for i, v in rows)
    few = {r.id: r.tile for r in order.tiles(df.where("id < 3"), 5, "id").collect()}
    assert few == {0: 0, 1: 1, 2: 2}


def test_ranks_leave_nulls_out(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 2.0), (4, 5.0)], "id long, v double")
    assert {r.id: r.r for r in stats.with_average_rank(df, "v", (), "r").collect()} == {1: 1.5, 2: None, 3: 1.5, 4: 3.0}


def test_stability_index_of_empty_sides_raises(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    with pytest.raises(ValueError):
        drift.stability_index(df.where("x > 9"), df, "x")
    with pytest.raises(ValueError):
        drift.stability_index(df, df.where("x > 9"), "x")
    assert drift.stability_index(df, df, "x").first().psi == 0
