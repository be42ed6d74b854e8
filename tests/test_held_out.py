"""Leave one group out in shared Newton passes, against a plain refit per group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.operators import held_out, models
from inkprint.operators.held_out import leave_one_group_out

FEATURES = ["a", "b", "c", "flat"]
SCHEMA = "sample_id long, problem string, label int, a double, b double, c double, flat double, prediction_of string"


def refit(x, y, strength=1.0):
    """The penalised fit of some rows: standardised weights by Newton steps, and the scaler."""
    mean, std = x.mean(0), x.std(0)
    std = np.where(std == 0, 1.0, std)
    z = np.c_[(x - mean) / std, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], strength), 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge) + 1e-14 * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-12:
            break
    return lambda rows: (np.c_[(rows - mean) / std, np.ones(len(rows))] @ w > 0).astype(int)


def brute(rows):
    out = {}
    for group in {r[1] for r in rows}:
        rest = [r for r in rows if r[1] != group and r[2] in (0, 1)]
        if not rest:
            continue
        x, y = np.array([[v or 0.0 for v in r[3:7]] for r in rest]), np.array([r[2] for r in rest])
        model = refit(x, y) if 0 < y.sum() < len(y) else (lambda z, only=int(y[0]): np.full(len(z), only))
        own = [r for r in rows if r[1] == group]
        for r, p in zip(own, model(np.array([[v or 0.0 for v in r[3:7]] for r in own]))):
            out[r[0]] = int(p)
    return out


def sample(n=400, seed=4):
    """A third of the rows is one problem; others have a few rows or one; some rows have no problem."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 4)) * [1.0, 3.0, 0.2, 0.0] + y[:, None] * np.array([0.8, -1.5, 0.05, 0.0]) + [0, 5, 0, 2]
    problem = ["hot" if i % 3 == 0 else None if i % 41 == 0 else f"p{i % 57}" if i % 7 else f"one{i}" for i in range(n)]
    return [(i, problem[i], int(y[i]), *map(float, x[i]), "x") for i in range(n)]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = leave_one_group_out(df, FEATURES, "problem", **kw)
    assert got.columns == [*df.columns, "prediction"]
    return {r["sample_id"]: r["prediction"] for r in got.collect()}


def test_equals_a_refit_per_group(spark):
    rows = sample()
    assert run(spark, rows) == brute(rows)


def test_small_blocks_and_held_sums_change_nothing(spark, monkeypatch):
    rows = sample(150, 8)
    monkeypatch.setattr(held_out, "BLOCK", 5)
    monkeypatch.setattr(held_out, "HELD", 3)
    assert run(spark, rows) == brute(rows)


def test_passes_do_not_grow_with_the_groups(spark, monkeypatch):
    """Many small groups end with the one step; no model of theirs takes part in a further pass."""
    asked = []
    plain = held_out._model_sums
    monkeypatch.setattr(held_out, "_model_sums", lambda rows, several, *a: asked.append(len(several)) or plain(rows, several, *a))
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 6000)
    x = rng.normal(size=(6000, 4)) + 0.5 * y[:, None]
    rows = [(i, f"p{i // 2}", int(y[i]), *map(float, x[i]), "x") for i in range(6000)]
    got = run(spark, rows, tolerance=1e-3)
    assert len(got) == 6000 and max(asked) == 1 and len(asked) < 12
    some = {r[1] for r in rows[::600]}
    for group in some:  # and they are right
        rest = [r for r in rows if r[1] != group]
        model = refit(np.array([r[3:7] for r in rest]), np.array([r[2] for r in rest]))
        own = [r for r in rows if r[1] == group]
        assert [got[r[0]] for r in own] == model(np.array([r[3:7] for r in own])).tolist()


def test_edges(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, "p", 0, 1.0, 1.0, 1.0, 1.0, "x")]) == {}  # a single group has no other rows
    assert run(spark, [(1, "p", None, 1.0, 1.0, 1.0, 1.0, "x"), (2, "q", 7, 1.0, 1.0, 1.0, 1.0, "x")]) == {}
    one = [(i, f"p{i}", 1, float(i), 0.0, None, 2.0, "x") for i in range(4)]
    assert run(spark, one) == {i: 1 for i in range(4)}
    mixed = sample(80, 3) + [(900, "new", None, 0.5, 2.0, 0.1, 2.0, "x"), (901, "p1", None, float("nan"), None, 0.0, 2.0, "x")]
    want = brute([r for r in mixed if r[0] != 901] + [(901, "p1", None, 0.0, 0.0, 0.0, 2.0, "x")])
    assert run(spark, mixed) == want
    # outside its own group a class may not occur at all
    rows = [(i, "a" if i < 5 else "b", int(i < 5), float(i), 1.0, 0.0, 0.0, "x") for i in range(10)]
    assert run(spark, rows) == {i: int(i >= 5) * 1 for i in range(10)}


def test_agrees_with_a_fit_per_fold(spark):
    rows = [(i, f"g{i % 5}", *r[2:]) for i, r in enumerate(sample(300, 5))]
    df = spark.createDataFrame(rows, SCHEMA)
    folds = df.withColumn("fold", F.substring("problem", 2, 1).cast("int"))
    fitted = {r["sample_id"]: int(r["prediction"]) for r in models.cv_predictions(folds, FEATURES, models.logreg()).collect()}
    got = run(spark, rows)
    assert np.mean([fitted[i] == p for i, p in got.items()]) > 0.99


def test_groups_whose_rows_are_certain_do_not_go_on(spark, monkeypatch):
    """Many small groups beyond the weights' tolerance, but nearly all rows far from the border: few models go on, and all
    predictions are those of a refit."""
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 600)
    x = rng.normal(size=(600, 3)) + y[:, None] * np.array([1.5, -1.0, 0.3])
    rows = [(i, f"p{i // 3}", int(y[i]), *map(float, x[i]), 1.0, None) for i in range(600)]
    went_on, descend = [], held_out._descend
    monkeypatch.setattr(held_out, "_descend", lambda rows, models, *rest: went_on.append(len(models)) or descend(rows, models, *rest))
    got = leave_one_group_out(spark.createDataFrame(rows, SCHEMA), FEATURES, "problem", tolerance=1e-9)
    assert {r.sample_id: r.prediction for r in got.collect()} == brute(rows)
    assert sum(went_on) < 50  # the fit of all rows is one of them
