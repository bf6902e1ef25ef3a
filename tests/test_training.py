"""Distributed gradients against the same steps on whole arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import models as L
from tidegrid.operators import training as R


def data(n=90, width=6, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    return rng.normal(size=(n, width)) + y[:, None], y


def frame(spark, x, y):
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*rows, (-1, None, 1), (-2, [0.0] * x.shape[1], None)], "k int, x array<double>, y int").repartition(5)


@pytest.mark.parametrize("weights", [None, np.array([0.5, 2.0, 1.0])])
@pytest.mark.parametrize(("make", "shape"), [(lambda: L.Mlp([6, 5, 3], 4), (6,)), (lambda: L.Cnn(2, (3, 4), 3, ((2,), (2,)), 1), (2, 3))])
def test_sums_equal_the_whole_batch(spark, make, shape, weights):
    x, y = data()
    model = make()
    found = R.sums(frame(spark, x, y), model, "x", "y", shape, weights, batch=7, salts=2)
    logits, kept = model.forward(x.reshape(len(x), *shape))
    loss, grad = L.cross_entropy(logits, y, weights)
    mass = len(y) if weights is None else weights[y].sum()
    assert found["loss"] / found["weight"] == pytest.approx(loss) and found["weight"] == pytest.approx(mass)
    assert found["n"] == len(y) and found["hits"] == (logits.argmax(1) == y).sum()
    for k, g in model.backward(grad, kept).items():
        assert found[f"g.{k}"] / found["weight"] == pytest.approx(g, abs=1e-12)
    assert R.sums(frame(spark, x, y).limit(0), model, "x", "y", shape) is None


@pytest.mark.parametrize(("optimiser", "rho", "adaptive"), [(lambda: L.Adam(0.05), None, False), (lambda: L.Sgd(0.1), 0.05, False), (lambda: L.Sgd(0.1, decay=0.01), 0.5, True)])
def test_fit_equals_full_batches(spark, optimiser, rho, adaptive):
    x, y = data()
    ours, theirs = L.Mlp([6, 4, 3], 2), L.Mlp([6, 4, 3], 2)
    table = frame(spark, x, y)
    history = R.fit(table.filter("k >= 20"), table.filter("k < 20"), ours, "x", "y", (6,), optimiser(), epochs=4, rho=rho, adaptive=adaptive)
    want = L.train(theirs, x[20:], y[20:], (x[:20], y[:20]), optimiser(), epochs=4, batch=len(x), rho=rho, adaptive=adaptive)
    for got, other in zip(history, want, strict=True):
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in other.items()}
    for k, v in theirs.params.items():
        assert ours.params[k] == pytest.approx(v, abs=1e-9)


def test_parts_of_an_epoch_are_steps(spark):
    x, y = data(120)
    model = L.Mlp([6, 8, 3], 3)
    table = frame(spark, x, y)
    history = R.fit(table, table, model, "x", "y", (6,), L.Adam(0.05), epochs=6, parts=4, key=F.col("k"))
    assert len(history) == 6 and history[-1]["train_loss"] < history[0]["train_loss"] and history[-1]["validation_accuracy"] > 0.6
    none = R.fit(table.limit(0), table.limit(0), model, "x", "y", (6,), L.Adam(0.05), epochs=1)
    assert math.isnan(none[0]["train_loss"]) and math.isnan(none[0]["validation_accuracy"])


def test_grid_runs_each_configuration_and_seed(spark):
    x, y = data(200)
    configs = [{"hidden": [5], "optimiser": "adam", "rate": 0.05, "epochs": 3}, {"hidden": [], "optimiser": "sgd", "rate": 0.1, "epochs": 2, "rho": 0.05, "batch": 16}]
    run = lambda: sorted(tuple(r) for r in R.fit_grid(frame(spark, x, y), configs, [1, 2], "x", "y", "k", max_rows=100).collect())
    first = run()
    assert len(first) == 2 * 3 + 2 * 2 and first == run() and len({(r[0], r[1]) for r in first}) == 4
    assert R.fit_grid(frame(spark, x, y).limit(0), configs, [1], "x", "y", "k").count() == 0
