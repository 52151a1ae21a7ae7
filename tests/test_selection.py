"""Greedy selection over rows against the dense forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.operators import selection
from kindred.operators.fitting import PointSimilarity
from kindred.operators.models import variance_minimizer


def points(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "gid long, v array<double>").repartition(3)


SIM = PointSimilarity(s=(0.8, "fixed"))
WITH = dict(similarity=lambda a, b: SIM(np.stack(a["v"]), np.stack(b["v"])), variance=lambda a: np.ones(len(a)))


def plain_determinant(k, n):
    d, f, out = np.diag(k).copy(), np.zeros((len(k), 0)), []
    for _ in range(n):
        i = int(np.argmax(np.where(np.isin(np.arange(len(k)), out), -1, d)))
        c = (k[:, i] - f @ f[i]) / np.sqrt(d[i])
        f, d = np.column_stack([f, c]), d - c**2
        out.append(i)
    return out, d


@pytest.mark.parametrize("save", [3, 100])
def test_determinant_equals_dense_form(spark, monkeypatch, save):
    monkeypatch.setattr(selection, "SAVE", save)
    x = np.random.default_rng(1).normal(size=(300, 3))
    k = SIM(x, x)
    want, left = plain_determinant(k, 10)
    got = selection.select_by_determinant(points(spark, x), n=10, **WITH)
    assert got.ids == want
    assert np.isclose(got.logdet, np.linalg.slogdet(k[np.ix_(want, want)])[1], rtol=1e-8)
    rows = {r.gid: r for r in got.points.collect()}
    assert np.allclose([rows[i].residual for i in range(300)], left, atol=1e-9)
    assert [rows[i].step for i in want] == list(range(1, 11)) and sum(r.step is not None for r in rows.values()) == 10


def test_variance_equals_dense_form(spark, monkeypatch):
    monkeypatch.setattr(selection, "BLOCK", 70)
    monkeypatch.setattr(selection, "SAVE", 4)
    x = np.random.default_rng(2).normal(size=(200, 2))
    got = selection.select_by_variance(points(spark, x), n=9, alpha=1e-3, **WITH)
    assert got.ids == variance_minimizer(SIM(x, x), 9, 1e-3)


def test_gaussian_equals_the_formula():
    x = np.random.default_rng(3).normal(size=(40, 5))
    t = pd.DataFrame({"v": list(x)})
    assert np.allclose(selection.Gaussian(0.8)(t, t[:7]), SIM(x, x[:7]), atol=1e-14)


def test_copies_and_few_rows(spark):
    x = np.array([[0.0], [0.0], [1.0], [1.0], [5.0]])
    got = selection.select_by_determinant(points(spark, x), n=5, **WITH)
    assert sorted(got.ids) == [0, 2, 4] and got.ids[0] == 0  # copies have no variance left
    empty = selection.select_by_determinant(points(spark, x).where("gid < 0"), n=2, **WITH)
    assert empty.ids == [] and empty.points.count() == 0
    graphs = pd.DataFrame({"gid": [3, 4], "name": ["a", "b"]})
    named = selection.select_by_determinant(spark.createDataFrame(graphs), lambda a, b: (a["name"].to_numpy()[:, None] == b["name"].to_numpy()[None]).astype(float), lambda a: np.ones(len(a)), 2)
    assert named.ids == [3, 4] and named.points.where(F.col("step").isNotNull()).count() == 2
