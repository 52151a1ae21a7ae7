"""The matrix-free Gaussian process against the dense one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.operators import exact_gp
from kindred.operators.selection import Gaussian


def test_mean_and_logdet_equal_dense_form(spark, monkeypatch):
    monkeypatch.setattr(exact_gp, "BLOCK", 80)
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 2))
    y = np.sin(x[:, 0]) + 0.1 * r.normal(size=200)
    rows = [(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    rows[7] = (7, rows[7][1], None)
    rows[8] = (8, rows[8][1], float("nan"))
    df = spark.createDataFrame(rows, "gid long, v array<double>, y double").repartition(3).cache()
    k = Gaussian(0.7)
    model = exact_gp.ExactGaussianProcess(k, 0.3, rank=40, probes=20).fit(df.select("gid", "v"), df.select("gid", "y"))
    at = [i for i in range(200) if i not in (7, 8)]
    m = k(pd.DataFrame({"v": list(x[at])}), pd.DataFrame({"v": list(x[at])})) + 0.3 * np.eye(198)
    w = np.linalg.solve(m, y[at])
    got = {g.gid: g.w for g in model.weights.collect()}
    assert set(got) == set(at) and np.allclose([got[i] for i in at], w, atol=1e-5)
    assert np.isclose(model.quadratic, y[at] @ w, rtol=1e-6)
    want = np.linalg.slogdet(m)[1]
    assert abs(model.logdet - want) < 0.02 * abs(want)
    z = r.normal(size=(20, 2))
    mean = {g.gid: g.y for g in model.predict(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "gid long, v array<double>")).collect()}
    assert np.allclose([mean[i] for i in range(20)], k(pd.DataFrame({"v": list(z)}), pd.DataFrame({"v": list(x[at])})) @ w, atol=1e-5)
    assert model.steps < 15  # the factor of few columns saves most of them


def test_edges(spark):
    df = spark.createDataFrame([(1, [0.0], 2.0)], "gid long, v array<double>, y double")
    model = exact_gp.ExactGaussianProcess(Gaussian(1.0), 0.5, probes=2).fit(df.select("gid", "v"), df.select("gid", "y"))
    assert np.isclose(model.weights.first().w, 2 / 1.5) and np.isclose(model.logdet, np.log(1.5), atol=0.05)
    with pytest.raises(ValueError):
        exact_gp.ExactGaussianProcess(Gaussian(1.0)).fit(df.select("gid", "v"), df.select("gid", F.lit(None).cast("double").alias("y")))
    with pytest.raises(ArithmeticError):
        x = np.random.default_rng(0).normal(size=(50, 1))
        many = spark.createDataFrame([(i, v.tolist(), float(i)) for i, v in enumerate(x)], "gid long, v array<double>, y double")
        exact_gp.ExactGaussianProcess(Gaussian(1.0), 1e-6, rank=1, probes=0, max_steps=2).fit(many.select("gid", "v"), many.select("gid", "y"))
