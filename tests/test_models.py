"""Fitted models and quantiles against plain numpy."""

import numpy as np
import pytest

from tillage.operators import models, profile


def cart(x, y, depth, leaf, test, total=None):
    """Least-squares tree with midpoint thresholds; of equal gains the lowest feature, then the least threshold."""
    total = len(y) * y.var() if total is None else total
    best = None
    for j in range(x.shape[1]) if depth and np.ptp(y) > 0 and len(y) >= 2 * leaf else ():
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= leaf:
                gain = round((left.sum() * (y[left].mean() - y.mean()) ** 2 + (~left).sum() * (y[~left].mean() - y.mean()) ** 2) / total, 12)
                if best is None or gain > best[0]:
                    best = (gain, j, cut)
    if best is None:
        return np.full(len(test), y.mean())
    _, j, cut = best
    out, left, t = np.zeros(len(test)), x[:, j] <= cut, test[:, j] <= cut
    out[t], out[~t] = cart(x[left], y[left], depth - 1, leaf, test[t], total), cart(x[~left], y[~left], depth - 1, leaf, test[~t], total)
    return out


def test_tree_and_ridge(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 9, 600), rng.integers(0, 5, 600), np.full(600, 2000.0)]).astype(float)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 2, 20, 0) * (x[:, 0] > 4) + rng.normal(0, 1, 600)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    prep = models.Preprocessor(["a", "b", "c"], []).fit(df)
    ready = prep.transform(df)
    got = np.array([r.prediction for r in models.fit_tree(ready, "y", depth=3, leaf=20).transform(ready).select("prediction").collect()])
    assert got == pytest.approx(cart(x, y, 3, 20, x), abs=1e-9)
    z = x / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    centred = z - z.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + np.eye(3), centred.T @ (y - y.mean()))
    got = np.array([r.prediction for r in models.fit_ridge(ready, "y").transform(ready).select("prediction").collect()])
    assert got == pytest.approx(centred @ w + y.mean(), abs=1e-7)


def entries_of(x):
    return [[(int(k), float(v)) for k, v in enumerate(r) if v != 0] for r in x]


@pytest.mark.parametrize("local_rows", [0, 300, 10**6])
def test_tree_on_many_values(spark, local_rows):
    rng = np.random.default_rng(7)
    n = 900
    x = np.column_stack([rng.normal(0, 1, n), np.round(rng.normal(0, 3, n)), (rng.random(n) < 0.2) * 1.0, np.zeros(n), rng.choice([-1.0, 0.0, 2.5], n)])
    y = np.sin(3 * x[:, 0]) * 5 + x[:, 1] * x[:, 2] + np.where(x[:, 4] > 0, 3, 0) + rng.normal(0, 0.1, n)
    df = spark.createDataFrame([(e, float(v)) for e, v in zip(entries_of(x), y)] + [([], None)], f"entries {models.ENTRIES}, y double").repartition(3)
    tree = models.fit_tree(df, "y", depth=6, leaf=7, local_rows=local_rows)
    test = np.vstack([x, x + rng.normal(0, 0.3, x.shape)])
    held = spark.createDataFrame([(i, e) for i, e in enumerate(entries_of(test))], f"k long, entries {models.ENTRIES}")
    got = {r.k: r.prediction for r in tree.transform(held).collect()}
    assert np.array([got[i] for i in range(len(test))]) == pytest.approx(cart(x, y, 6, 7, test), abs=1e-9)


def test_tree_of_nothing(spark):
    df = spark.createDataFrame([([(0, 1.0)], 5.0)] * 50, f"entries {models.ENTRIES}, y double")
    assert {r.prediction for r in models.fit_tree(df, "y", leaf=1).transform(df).collect()} == {5.0}
    assert models.fit_tree(df.limit(0), "y").value[1] == 0.0
    with pytest.raises(ValueError, match="depth"):
        models.fit_tree(df, "y", depth=40)


def test_dictionary_and_sparse_ridge(spark):
    """20,000 one-hot columns: the codes are sorted ranks, the model the closed form by blocks of levels."""
    rng = np.random.default_rng(8)
    levels = np.array([f"l{k:05d}" for k in rng.permutation(20_000)])
    pick, z = np.concatenate([np.arange(20_000), rng.integers(0, 20_000, 20_000)]), rng.normal(2, 3, 40_000)
    y = rng.normal(0, 2, 20_000)[pick] + 0.7 * z + rng.normal(0, 0.1, 40_000)
    df = spark.createDataFrame([(str(levels[p]), float(a), float(b)) for p, a, b in zip(pick, z, y)], "c string, z double, y double")
    prep = models.Preprocessor(["z"], ["c"]).fit(df)
    assert prep.width == 20_001
    codes = {r.level: r.code for r in prep.levels_["c"].collect()}
    assert codes == {v: k for k, v in enumerate(sorted(levels))}
    ready = prep.transform(df)
    assert "features" not in ready.columns
    model = models.fit_ridge(ready, "y", width=prep.width)
    # stationary point of the penalised sum of squares, checked in each coordinate
    w = np.array(model.coefficients)
    code = np.array([codes[levels[p]] for p in pick])
    x0 = z / z.std()
    left = y - (model.intercept + w[0] * x0 + w[1 + code])
    assert abs(left.sum()) < 1e-5 and abs((left * x0).sum() - w[0]) < 1e-5
    assert np.abs(np.bincount(code, left, 20_000) - w[1:]).max() < 1e-5
    got = {(r.c, r.z): r.prediction for r in model.transform(ready.limit(50)).collect()}
    want = {(str(levels[p]), float(a)): model.intercept + w[0] * s + w[1 + k] for p, a, s, k in zip(pick, z, x0, code)}
    assert all(v == pytest.approx(want[k], abs=1e-9) for k, v in got.items())
    unseen = prep.transform(spark.createDataFrame([("new", None), (None, 1.0)], "c string, z double")).select("entries").collect()
    assert sorted(len(r.entries) for r in unseen) == [1, 2]


def test_quantiles(spark):
    rng = np.random.default_rng(6)
    values = [*rng.lognormal(0, 3, 500), *[7.0] * 300, *(-rng.random(50)), 1e300, -1e300, -0.0, 0.0]
    df = spark.createDataFrame([(float(v), float(v) if v > 5 else None) for v in values] + [(None, float("nan"))], "x double, y double")
    ps = [0.0, 0.1, 0.5, 0.77, 1.0]
    for accuracy, few in ((10_000, 10**6), (20, 10**6), (20, 0), (3, 0)):
        got = profile.quantiles(df, ["x", "y"], ps, accuracy, few)
        assert got["x"] == pytest.approx(list(np.quantile(values, ps)), rel=1e-12)
        assert got["y"] == pytest.approx(list(np.quantile([v for v in values if v > 5], ps)), rel=1e-12)
    assert profile.quantiles(df.limit(0), ["x"], [0.5])["x"] == [None]
    assert profile.quantiles(df.where("x = 7"), ["x", "y"], [0.0, 0.5]) == {"x": [7.0, 7.0], "y": [7.0, 7.0]}
    rows = {r.column_name: r for r in profile.describe_columns(df, ["x", "y"]).collect()}
    assert rows["y"].n == sum(v > 5 for v in values) and rows["x"].std == pytest.approx(np.std(values, ddof=1)) and rows["x"].q50 == pytest.approx(np.median(values))
