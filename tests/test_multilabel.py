"""Fourier features against the kernel, the model against plain Newton steps, measures above those of a constant."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatrace.operators import multilabel


def table(spark, n=1500, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2))
    y = np.stack([np.hypot(*x.T) < 0.5, np.abs(x[:, 0]) < 0.3, x[:, 0] * x[:, 1] > 0, rng.random(n) < 0.02], 1)
    rows = [(i, v.tolist(), *map(int, t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return x, y.astype(float), spark.createDataFrame(rows, "id long, x array<double>, disc int, strip int, corner int, rare int")


NAMES = ["disc", "strip", "corner", "rare"]


def test_features_are_near_the_kernel(spark):
    x, _, df = table(spark, 60)
    made = multilabel.Fourier(2, 4000, 0.7)
    z = np.array([r["z"] for r in df.orderBy("id").select(made.column(F.col("x")).alias("z")).collect()])
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 0.7**2))
    assert np.abs(z @ z.T - kernel).max() < 0.1
    assert np.allclose(z, multilabel.Fourier(2, 4000, 0.7).of(x)) and not np.allclose(z, multilabel.Fourier(2, 4000, 0.7, seed=3).of(x))


def test_inverse():
    a = np.random.default_rng(0).standard_normal((400, 257))
    a = a.T @ a / 400 + 1e-4 * np.eye(257)
    assert np.allclose(multilabel._inverse(a) @ a, np.eye(257), atol=1e-8)


def test_model_is_that_of_newton_steps(spark):
    x, y, df = table(spark)
    fourier = multilabel.Fourier(2, 30, 0.6)
    model = multilabel.train_labels(df.repartition(5), "x", NAMES, fourier=fourier, ridge=1e-3, rounds=150)
    z = np.hstack([fourier.of(x), np.ones((len(x), 1))])
    for k in range(len(NAMES)):
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve((z.T * (p * (1 - p))) @ z / len(z) + 1e-3 * np.eye(len(w)), z.T @ (p - y[:, k]) / len(z) + 1e-3 * w)
        assert np.allclose(model.weights[k], w, atol=0.02, rtol=0.01)
    got = {r["id"]: r["probabilities"] for r in model.predict(df, "x").collect()}
    assert np.allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-z @ model.weights.T)))


def test_measures_on_rows_not_learnt_from(spark):
    _, _, df = table(spark)
    x, y, other = table(spark, seed=2)
    model = multilabel.train_labels(df, "x", NAMES, fourier=multilabel.Fourier(2, 100, 0.5))
    told = model.predict(other, "x")
    p = np.array([r["probabilities"] for r in told.orderBy("id").collect()]) >= 0.5
    got = {r["label"]: r for r in multilabel.label_measures(told, NAMES).collect()}
    for k, name in enumerate(NAMES):
        tp, fp, fn = (p[:, k] & (y[:, k] == 1)).sum(), (p[:, k] & (y[:, k] == 0)).sum(), (~p[:, k] & (y[:, k] == 1)).sum()
        assert (got[name]["tp"], got[name]["fp"], got[name]["fn"], got[name]["tn"]) == (tp, fp, fn, len(y) - tp - fp - fn)
        share = y[:, k].mean()
        if name != "rare":
            assert got[name]["f1"] > max(0.9, 2 * share / (1 + share))


def test_missing_inputs_and_empty_tables(spark):
    rows = [(0, [0.1, 0.2], 1, None), (1, [0.1, None], 1, 0), (2, None, 0, 1), (3, [float("nan"), 0.0], 0, 0), (4, [0.5], 0, 0), (5, [-0.5, 0.3], 0, 1)]
    df = spark.createDataFrame(rows, "id long, x array<double>, a int, b int")
    fourier = multilabel.Fourier(2, 8)
    model = multilabel.train_labels(df, "x", ["a", "b"], fourier=fourier, rounds=5)
    assert model.weights.shape == (2, 9) and np.isfinite(model.weights).all()
    told = {r["id"]: r["probabilities"] for r in model.predict(df, "x").collect()}
    assert [i for i in told if told[i] is not None] == pytest.approx([0, 5])
    assert multilabel.label_measures(model.predict(df, "x"), ["a", "b"]).agg(F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).first()[0] == 4
    none = multilabel.train_labels(df.where("id < 0"), "x", ["a", "b"], fourier=fourier, rounds=2)
    assert not none.weights.any()
