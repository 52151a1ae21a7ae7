"""Tall factors against their dense matrices."""

import numpy as np
import pytest

from kindred.operators import tall


def test_tall_factor_equals_dense_form(spark):
    r = np.random.default_rng(6)
    f = r.normal(size=(400, 6)) * 10.0 ** -np.arange(6)
    f[:, 5] = f[:, 0] - f[:, 1]  # of rank 5
    y = r.normal(size=400)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(f)], "gid long, f array<double>").repartition(7)
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "gid long, y double")
    a, got = f @ f.T, tall.TallFactor(rows, 6)
    s = np.linalg.svd(f, compute_uv=False)[:5]
    assert np.allclose(got.singular, s, rtol=1e-9) and np.isclose(got.logdet, 2 * np.log(s).sum()) and np.isclose(got.cond, (s[0] / s[4]) ** 2) and np.isclose(got.trace, np.trace(a))
    z = lambda df: np.array([x.z for x in sorted(df.collect())])
    assert np.allclose(z(got.times(values)), a @ y)
    assert np.allclose(z(got.pinv_times(values)), np.linalg.pinv(a, rcond=1e-12) @ y, rtol=1e-5, atol=1e-5)
    solved, logdet = got.shifted_solve(values, 0.3)
    assert np.allclose(z(solved), np.linalg.solve(a + 0.3 * np.eye(400), y)) and np.isclose(logdet, np.linalg.slogdet(a + 0.3 * np.eye(400))[1])
    few = tall.TallFactor(rows.where("gid < 2"), 6)
    assert len(few.singular) == 2
    with pytest.raises(ValueError):
        got.shifted_solve(values, 0.0)
