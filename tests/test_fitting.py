"""Fitting against finite differences, refits and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import microkernel as mk
from kindred.operators import fitting as fit
from kindred.operators import linalg, metrics, models
from kindred.plans.kernel import GraphKernel, minimax_kernel, pack

RBF = fit.PointSimilarity("a * exp(-x**2 / (2 * s**2))", a=(1.5, (1e-2, 1e2)), s=(0.7, (1e-2, 1e2)))


def differences(fun, t, h=1e-5):
    return np.array([(fun(t + h * e)[0] - fun(t - h * e)[0]) / (2 * h) for e in np.eye(len(t))])


def test_search_meets_bounds():
    rosen = lambda x: ((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    got = fit.minimize(rosen, np.array([-1.2, 1.0]), np.array([[-5, 5], [-5, 5]]), tol=1e-8)
    assert got.converged and np.allclose(got.x, [1, 1], atol=1e-3)
    held = fit.minimize(rosen, np.array([-1.2, 1.0]), np.array([[-5, 0.5], [-5, 5]]), tol=1e-8)
    assert held.converged and np.allclose(held.x, [0.5, 0.25], atol=1e-3)
    with pytest.raises(RuntimeError):
        fit.search(lambda x: (np.inf, np.ones(1)), np.zeros(1), np.array([[-1.0, 1.0]]))


@pytest.mark.parametrize("loss", [fit.likelihood, fit.loo_loss])
@pytest.mark.parametrize("how", ["+", "*"])
def test_objectives_equal_differences(loss, how):
    r = np.random.default_rng(1)
    x, y = r.standard_normal((12, 2)), r.standard_normal(12)

    def fun(t):
        k, dk = RBF.with_theta(t)(x, gradient=True)
        f, g = loss(fit.regularized(k, 1e-2, how), fit._regularized_gradient(dk, 1e-2, how), y)
        return f, g * np.exp(t)

    assert np.allclose(fun(RBF.theta)[1], differences(fun, RBF.theta), rtol=1e-4, atol=1e-6)


def test_fit_points_lowers_the_loss_and_recovers_a_scale():
    x = np.linspace(0, 6, 25)[:, None]
    y = [None if i % 6 == 5 else float(np.sin(v)) for i, v in enumerate(x[:, 0])]
    start = fit.PointSimilarity(s=(0.05, (1e-2, 1e2)))
    for loss in ("likelihood", "loocv"):
        sim, gp = fit.fit_points(start, x, y, alpha=1e-6, loss=loss, repeat=3, seed=2)
        hidden = [i for i, v in enumerate(y) if v is None]
        assert np.allclose(sim(x[hidden], x[gp.ids]) @ gp.weights, np.sin(x[hidden, 0]), atol=2e-2)
    with pytest.raises(ValueError):
        fit.fit_points(start, x, y, loss="other")


def test_outliers_are_found():
    x = np.linspace(0, 1, 12)[:, None] * 2 * np.pi
    y = np.sin(x[:, 0])
    y[3] += 0.5
    y[7] -= 0.4
    found = fit.OutlierDetector(fit.PointSimilarity(s=(1.0, (0.5, 10.0)))).fit(x, y, w=3.0, repeat=7, seed=3)
    assert (found.y_uncertainty[[3, 7]] > 0.2).all() and np.delete(found.y_uncertainty, [3, 7]).max() < 0.01
    mean, std = found.predict(x)
    assert np.abs(mean - np.sin(x[:, 0])).max() < 0.1 and (std < 0.3).all()
    t = np.r_[found.similarity.theta, np.log(np.full(12, 0.3))]
    fun = lambda z: found.objective(z, found.x, found.y)
    assert np.allclose(fun(t)[1], differences(fun, t), rtol=1e-4, atol=1e-5)


@pytest.mark.parametrize("p", [1.0, 2.0])
def test_field_losses(p):
    r = np.random.default_rng(4)
    x = r.standard_normal((14, 2))
    d = fit.distances(x, x)
    y = [None if i % 3 == 0 else float(x[i, 0] > 0) for i in range(14)]
    field = fit.GaussianField(fit.PointSimilarity(s=(0.8, (1e-3, 1e3))))
    for fun in (lambda t: field.entropy_loss(d, y, t), lambda t: field.loo_loss(d, y, p, t)):
        assert np.allclose(fun(field.weight.theta)[1], differences(fun, field.weight.theta), rtol=1e-4, atol=1e-6)
    before = field.loo_loss(d, y, p)[0]
    assert field.fit(d, y, f"loocv{int(p)}").loo_loss(d, y, p)[0] <= before
    filled, reach = field.predict(d, y, influence=True)
    assert np.allclose(reach.sum(1), 1) and np.isfinite(filled).all()
    path = np.array([[0, 1, 50.0], [1, 0, 1], [50, 1, 0]])
    assert np.isclose(fit.GaussianField(fit.PointSimilarity(s=(1.0, "fixed")), 0.0).predict(path, [0.0, None, 1.0])[1], 0.5)
    with pytest.raises(ValueError):
        field.predict(d, np.zeros(14))


def test_low_rank_fit_deviation_and_leave_one_out(spark):
    r = np.random.default_rng(5)
    x = np.linspace(-2, 2, 40)
    y = np.cos(2 * x) + 0.01 * r.standard_normal(40)
    core = x[::8]
    points = spark.createDataFrame([(i, [float(v)], float(w)) for i, (v, w) in enumerate(zip(x, y, strict=True))], "gid int, v array<double>, y double")
    sim, low = fit.fit_low_rank(fit.PointSimilarity(s=(0.3, (0.1, 3.0))), core, points, alpha=1e-8, beta=1e-14)
    kxc = sim(x[:, None], core[:, None])
    u = np.linalg.lstsq(kxc, y)[0]
    cross = spark.createDataFrame([(i, j, float(kxc[i, j])) for i in range(40) for j in range(len(core))], "g1 int, g2 int, k double")
    targets = points.select("gid", "y")
    assert np.allclose([z.y for z in low.predict(cross).orderBy("g1").collect()], kxc @ u, atol=1e-4)
    own = points.select("gid", F.lit(1.0).alias("k"))
    std = low.predict_std(cross, own).orderBy("g1").collect()
    want = 1 + low.alpha - np.einsum("ij,jk,ik->i", kxc, np.linalg.inv(sim(core[:, None]) + low.alpha * np.eye(len(core))), kxc)
    assert np.allclose([z.std for z in std], np.sqrt(np.maximum(want, 0)), atol=1e-3) and np.allclose([z.y for z in std], kxc @ u, atol=1e-4)
    refit = [kxc[i] @ np.linalg.lstsq(np.delete(kxc, i, 0), np.delete(y, i))[0] for i in range(40)]
    left = low.leave_one_out(cross, targets, "ridge-like").orderBy("g1").collect()
    assert np.allclose([z.y for z in left], refit, atol=1e-3) and left[0].std is None
    assert low.leave_one_out(cross, targets, "gpr-like").where("std > 0").count() == 40

    def fun(t):
        s = sim.with_theta(t)
        (k, dk), (kc, dkc) = s(x[:, None], core[:, None], True), s(core[:, None], gradient=True)
        f, g = fit.low_rank_likelihood(kc, dkc, k.T @ k, np.array([k.T @ m for m in dk]), k.T @ y, np.array([m.T @ y for m in dk]))
        return f, g * np.exp(t)

    assert np.allclose(fun(sim.theta + 0.2)[1], differences(fun, sim.theta + 0.2), rtol=1e-3, atol=1e-4)
    assert np.isclose(fun(sim.theta)[0], low.objective(), rtol=1e-3)


def test_models_are_kept(spark, tmp_path):
    x = np.linspace(0, 3, 6)[:, None]
    sim, gp = fit.fit_points(RBF, x, np.sin(x[:, 0]), alpha=1e-6, loss=None)
    fit.save(gp, spark, f"{tmp_path}/gp", theta=sim.theta)
    back, theta = fit.load(spark, f"{tmp_path}/gp")
    assert np.allclose(back.inverse, gp.inverse) and back.ids == gp.ids and np.allclose(theta, sim.theta) and np.isclose(back.objective(), gp.objective())
    with pytest.raises(Exception, match="already exists"):
        fit.save(gp, spark, f"{tmp_path}/gp")
    k = RBF(x)
    low = models.LowRankGaussianProcess().fit_sums(["a", "b", "c", "d", "e", "f"], k, k @ k, k @ np.sin(x[:, 0]))
    fit.save(low, spark, f"{tmp_path}/gp", overwrite=True)
    assert np.allclose(fit.load(spark, f"{tmp_path}/gp")[0].weights, low.weights)


def test_graph_fit_and_distance_gradients(spark):
    nodes = spark.createDataFrame([(g, i, "ab"[(i + g) % 2], float(i * g % 5)) for g in range(6) for i in range(3 + g % 3)], "gid long, nid int, lab string, val double")
    edges = spark.createDataFrame([(g, i, i + 1, 1.0 + i, 0.5 * i) for g in range(6) for i in range(2 + g % 3)], "gid long, src int, dst int, w double, len double")
    packed = pack(nodes, edges).cache()
    k = GraphKernel(mk.TensorProduct(lab=mk.KroneckerDelta(0.4), val=mk.SquareExponential(2.0)), mk.TensorProduct(len=mk.SquareExponential(1.0)), q=0.1)
    y = spark.createDataFrame([(g, None if g == 4 else float(g % 3)) for g in range(6)], "gid long, y double")
    source = fit.GraphSimilarity(k, packed)
    ids, gram, dk = source.gramian()
    assert ids == list(range(6)) and len(dk) == len(source.theta) == len(source.bounds)
    up = source.with_theta(source.theta + 1e-5 * np.eye(len(dk))[1]).gramian()[1]
    assert np.allclose((up - gram) / (1e-5 * np.exp(source.theta[1])), dk[1], rtol=1e-3, atol=1e-4)
    fixed = fit.GraphSimilarity(GraphKernel(mk.KroneckerDelta(0.4, (0.05, 0.95)), mk.Constant(1.0), q=0.1), pack(nodes.select("gid", "nid", "lab"), edges.select("gid", "src", "dst", "w")), "fixed")
    assert len(fixed.theta) == 1

    pairs, diag = k.pairs(packed, gradient=True).cache(), k.diag(packed, gradient=True).cache()
    moved = GraphKernel(k.node, k.edge, q=0.1 + 1e-6)
    got = {(r.g1, r.g2): r for r in metrics.kernel_distance_gradient(pairs, diag).collect()}
    other = {(r.g1, r.g2): r.d for r in metrics.kernel_distance(moved.pairs(packed), moved.diag(packed)).collect()}
    assert all(np.isclose((other[p] - r.d) / 1e-6, r.dd[0], rtol=1e-2, atol=1e-4) for p, r in got.items() if r.d > 1e-3)
    assert all(not any(r.dd) for (a, b), r in got.items() if a == b and r.d == 0)
    far = {(r.g1, r.g2): r for r in k.maximin_gradient(packed).collect()}
    shifted = {(r.g1, r.g2): r.d for r in moved.maximin_gradient(packed).collect()}
    assert all(np.isclose((shifted[p] - r.d) / 1e-6, r.dd[0], rtol=1e-2, atol=1e-4) for p, r in far.items() if r.d > 1e-3)
    plain = metrics.maximin(metrics.nodal_distances(k.nodal(packed), k.diag_nodal(packed)))
    assert all(np.isclose(far[r.g1, r.g2].d, r.d, atol=1e-6) for r in plain.collect())

    start = fit.GraphSimilarity(GraphKernel(k.node, k.edge, q=0.3), packed)
    fitted, gp = fit.fit_graphs(start, y, alpha=1e-2, tol=1e-2)
    assert gp.ids == [0, 1, 2, 3, 5] and np.isfinite(gp.objective())
    keep = np.ix_(gp.ids, gp.ids)
    before = models.GaussianProcess(1e-2).fit_matrix(gp.ids, start.gramian()[1][keep] + 1e-2 * np.eye(5), gp.y)
    assert gp.objective() <= before.objective()
    assert minimax_kernel(charge_eps=0.2).q == 0.01


def test_low_rank_algebra():
    u = np.random.default_rng(6).standard_normal((9, 3))
    low, a = linalg.LowRank(u), u @ u.T
    e = np.linalg.eigvalsh(a)[-3:]
    assert np.isclose(low.logdet(), np.log(e).sum()) and np.isclose(low.cond(), e[-1] / e[0])
    assert np.allclose((low**2).todense(), a @ a) and np.allclose((low**-1).todense(), np.linalg.pinv(a))
    d = np.linspace(0.5, 2, 9)
    assert np.allclose(linalg.shifted_pinvh(low, d), np.linalg.inv(a + np.diag(d)))
    assert np.allclose(linalg.shifted_pinvh(low, np.zeros(9)), np.linalg.pinv(a), atol=1e-8)


def test_reorder_and_rewrites_of_derived_tables(spark):
    from kindred.operators import graph_ops, sequences

    base = spark.createDataFrame([(1, 0, 3), (1, 3, 1), (1, 1, 2), (2, 0, 1)], "gid long, src int, dst int")
    nodes = base.select("gid", F.explode(F.array("src", "dst")).alias("nid")).distinct()
    for how in ("rcm", "pbr"):
        got = graph_ops.reorder(nodes, base, how).collect()
        assert sorted((r.gid, r.pos) for r in got) == sorted((r.gid, r.nid) for r in got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    seqs = spark.createDataFrame([(1, "ABAB"), (2, ""), (3, None)], "id int, s string")
    make = lambda: sorted(map(tuple, sequences.rewrites(sequences.SequenceRewriter(sequences.ngrams(seqs, 1)), seqs).collect()))
    got = make()
    assert got == make() and {i for i, _ in got} >= {1} and all(s and s != "ABAB" and set(s) <= set("AB") for _, s in got)
