"""The graph engine against dense algebra, finite differences and closed forms."""

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.functions import microkernel as mk
from kindred.functions.adjacency import shape
from kindred.operators import graph_ops as G
from kindred.operators import linalg, metrics, models, sequences
from kindred.plans.kernel import GraphKernel, Packed, pack, walk_similarity
from kindred.sources import graphs as S


def graph(n, edges, nodes=None, feats=None, gid=0):
    src, dst, w = (list(x) for x in zip(*[(a, b, c) for a, b, c in edges], strict=True))
    return Packed.of(pd.Series({"gid": gid, "n": n, "p": [1.0] * n, "src": src, "dst": dst, "w": w, **{f"n_{k}": v for k, v in (nodes or {}).items()}, **{f"e_{k}": v for k, v in (feats or {}).items()}}))


def dense_oracle(k, a, b):
    v = k.node.values(a.nodes or np.zeros(a.n), b.nodes or np.zeros(b.n))
    w = np.zeros((a.n * b.n,) * 2)
    one = lambda e, i: {f: [c[i]] for f, c in e.items()} if e else [0]
    for i, j in itertools.product(range(len(a.src)), range(len(b.src))):
        w[a.src[i] * b.n + b.src[j], a.dst[i] * b.n + b.dst[j]] += a.w[i] * b.w[j] * k.edge.values(one(a.edges, i), one(b.edges, j))[0, 0]
    d = np.outer(a.d, b.d).ravel() / (1 - k.q) ** 2
    return np.linalg.solve(np.diag(d / v.ravel()) - w, d).reshape(a.n, b.n)


LABELED = (
    graph(3, [(0, 1, 1.0), (0, 2, 2.0)], {"h": [2, 3, 1], "c": [1.0, -1.0, 2.0]}, {"o": [1, 2], "l": [0.5, 1.0]}),
    graph(2, [(0, 1, 3.0), (1, 1, 0.5)], {"h": [1, 1], "c": [1.0, -1.0]}, {"o": [2, 1], "l": [1.0, 0.2]}),
)
KERNEL = GraphKernel(mk.TensorProduct(h=mk.KroneckerDelta(0.3), c=mk.SquareExponential(1.0) * 0.9 + 0.1), mk.Additive(o=0.5 * mk.KroneckerDelta(0.3), l=0.5 * mk.SquareExponential(0.4)))


@pytest.mark.parametrize("q", [0.01, 0.05, 0.1, 0.5])
@pytest.mark.parametrize("solver", ["dense", "pcg", "walk"])
def test_kernel_equals_dense_oracle(q, solver):
    for a, b in itertools.product(LABELED, repeat=2):
        k = GraphKernel(KERNEL.node, KERNEL.edge, q=q, solver=solver)
        want = dense_oracle(k, a, b)
        assert np.allclose(k.solve(a, b), want, rtol=1e-6)
        v = k.node.values(a.nodes, b.nodes)
        assert np.allclose(GraphKernel(k.node, k.edge, q=q, solver=solver, lmin=1).solve(a, b), want - v, atol=1e-6)
        assert np.isclose(k.similarity(a, b), k.similarity(b, a))


@pytest.mark.parametrize("lmin", [0, 1])
def test_gradients_equal_differences(lmin):
    a, b = LABELED
    k = GraphKernel(KERNEL.node, KERNEL.edge, q=0.1, lmin=lmin, solver="dense")
    value, g = k.gradient(a, b)
    nodal, ng = k.nodal_gradient(a, b)
    assert np.isclose(value, k.similarity(a, b)) and np.isclose(nodal.sum(), value)
    for i in range(len(k.theta)):
        h = np.zeros(len(k.theta))
        h[i] = 1e-5
        up, down = k.with_theta(k.theta + h), k.with_theta(k.theta - h)
        diff = (up.similarity(a, b) - down.similarity(a, b)) / (2e-5 * np.exp(k.theta[i]))
        assert np.isclose(g[i], diff, rtol=1e-5, atol=1e-7) and np.isclose(ng[i].sum(), g[i], rtol=1e-6, atol=1e-9)


def test_permutation_and_normalization(spark):
    nodes = spark.createDataFrame([(g, i, "ab"[i % 2], float(i * g)) for g in range(5) for i in range(3 + g)], "gid long, nid int, lab string, val double")
    edges = spark.createDataFrame([(g, i, i + 1, 1.0 + i, 0.5 * i) for g in range(5) for i in range(2 + g)] + [(0, 1, 1, 2.0, 0.1)], "gid long, src int, dst int, w double, len double")
    k = GraphKernel(mk.TensorProduct(lab=mk.KroneckerDelta(0.3), val=mk.SquareExponential(2.0)), mk.TensorProduct(len=mk.SquareExponential(1.0)), q=0.1)
    p = pack(nodes, edges).cache()
    pairs = {(r.g1, r.g2): r.k for r in k.pairs(p, block=2).collect()}
    assert set(pairs) == {(i, j) for i in range(5) for j in range(i, 5)}
    order = G.reorder(nodes, edges, "rcm")
    n2, e2 = G.permute(nodes, edges, order)
    other = {(r.g1, r.g2): r.k for r in k.pairs(pack(n2, e2)).collect()}
    assert all(np.isclose(pairs[x], other[x]) for x in pairs)
    walk = {(r.g1, r.g2): r.k for r in walk_similarity(nodes, edges, k.node.column, k.edge.column, q=0.1).collect()}
    assert all(np.isclose(pairs[x], walk[x], atol=1e-6) for x in pairs)
    diag = k.diag(p)
    unit = metrics.normalize(k.pairs(p), diag).collect()
    assert all(np.isclose(r.k, 1) for r in unit if r.g1 == r.g2) and all(r.k <= 1 + 1e-9 for r in unit)
    listed = k.listed(p, spark.createDataFrame([(3, 1), (2, 2)], "g1 long, g2 long")).collect()
    assert {(r.g1, r.g2): round(r.k, 8) for r in listed} == {(3, 1): round(pairs[1, 3], 8), (2, 2): round(pairs[2, 2], 8)}
    cross = k.pairs(p.where("gid < 2"), p.where("gid > 1")).collect()
    assert {(r.g1, r.g2) for r in cross} == {(i, j) for i in (0, 1) for j in (2, 3, 4)}
    dist = metrics.nodal_distances(k.nodal(p), k.diag_nodal(p))
    far = metrics.maximin(dist)
    assert all(0 <= r.d <= 1 and (r.d < 1e-5 or r.g1 != r.g2) for r in far.collect())
    assert metrics.hotspot(dist, far).count() == 15
    block = k.diag_block(p).collect()
    assert all(np.isclose(np.sum(r.r), pairs[r.gid, r.gid]) for r in block)
    dk = metrics.normalize_gradient(k.pairs(p, gradient=True), p.sparkSession.createDataFrame([(r.g1, r.k, r.dk) for r in k.pairs(p, gradient=True).collect() if r.g1 == r.g2], "gid long, k double, dk array<double>")).collect()
    assert all(np.allclose(r.dk, 0, atol=1e-9) for r in dk if r.g1 == r.g2), dk


def test_microkernels(spark):
    ks = [mk.Constant(0.5), mk.SquareExponential(1.3), mk.RationalQuadratic(1.0, 1.5), (mk.SquareExponential(1.0) + 0.2) * 0.8, mk.RationalQuadratic(2.0, 1.0) ** 2, (mk.SquareExponential(0.7) + mk.RationalQuadratic(1.0, 1.0)).normalized, mk.MicroKernel.from_formula("exp(-abs(x - y) / s)", {"s": (2.0, (0.1, 9))})]
    r = np.random.default_rng(0)
    x, y = r.standard_t(2, 40), r.standard_t(2, 40)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    for k in ks:
        got = np.array([v[0] for v in df.select(k.column(F.col("x"), F.col("y"))).collect()])
        assert np.allclose(got, np.diag(k.values(x, y))) and np.allclose(k.values(x, y), k.values(y, x).T)
        v, g = k.values_and_partials(x, y)
        for i, z in enumerate(g):
            h = np.zeros(len(g))
            h[i] = 1e-6
            t = np.array(k.theta)
            assert np.allclose(z, (k.with_theta(t + h).values(x, y) - k.with_theta(t - h).values(x, y)) / 2e-6, atol=1e-5)
    d = mk.KroneckerDelta(0.2)
    assert d(float("nan"), float("nan")) == 0.2 and d("a", "a") == 1 and d("a", "b") == 0.2
    c = mk.Convolution(mk.KroneckerDelta(0.5))
    assert c([1, 2], [2]) == 0.75 and mk.Convolution(mk.KroneckerDelta(0.5), mean=False)([], [1]) == 0 and mk.DotProduct()([3.0] * 4, [2.0] * 4) == 24
    for bad in ("x + z", "open('f')", "x.y"):
        with pytest.raises((ValueError, SyntaxError)):
            mk.MicroKernel.from_formula(bad, {})
    with pytest.raises(ValueError, match="bounds"):
        mk.KroneckerDelta(0.5, (1, 0))
    with pytest.raises(ValueError, match="constant"):
        mk.SquareExponential(1.0) ** mk.SquareExponential(1.0)


def test_graph_tables(spark):
    edges = spark.createDataFrame([(0, i, j, 1.0) for i in range(5) for j in range(i + 1, 5)] + [(1, 0, 0, 2.0)], "gid int, src int, dst int, w double")
    nodes = spark.createDataFrame([(0, i) for i in range(5)] + [(1, 0), (1, 1)], "gid int, nid int")
    assert {r.a for r in G.adjacency_matrix(edges.where("gid = 0")).collect()} == {1.0}
    assert G.adjacency_matrix(edges.where("gid = 1")).first().a == 4.0
    assert {(r.nid, r.d) for r in G.degree(nodes, edges).where("gid = 1").collect()} == {(0, 2.0), (1, 1.0)}
    rows = G.laplacian(edges).groupBy("gid", "i").agg(F.sum("l").alias("s")).collect()
    assert all(abs(r.s) < 1e-12 for r in rows)
    r = np.random.default_rng(1)
    for n in (5, 17, 40):
        src, dst = r.integers(0, n, 3 * n), r.integers(0, n, 3 * n)
        for f in (G.reverse_cuthill_mckee, G.partition_reorder):
            assert sorted(f(n, src, dst)) == list(range(n))
        assert G.tiles(G.partition_reorder(n, src, dst), src, dst) <= G.tiles(list(range(n)), src, dst)
    assert G.tile_count(edges).where("gid = 0").first().tiles == 1
    keyed = spark.createDataFrame([(0, "b", 1), (0, "a", 2)], "gid int, key string, f int")
    n, e = S.from_keyed(keyed, spark.createDataFrame([(0, "b", "a")], "gid int, src string, dst string"))
    assert [(x.nid, x.key) for x in n.orderBy("nid").collect()] == [(0, "a"), (1, "b")] and (e.first().src, e.first().dst, e.first().w) == (0, 1, 1.0)
    assert S.check_complete(nodes, edges).count() == 0
    a, b = S.unify(spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1.0,)], "x double"))
    assert a.dtypes == b.dtypes == [("x", "double")]
    with pytest.raises(TypeError):
        S.unify(spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("a",)], "x string"))


@pytest.mark.parametrize("n", [2, 3, 7])
def test_radius_edges_and_periodic_images(spark, n):
    pts = spark.createDataFrame([(0, i, 2.0 * i, 0.0, 0.0) for i in range(n)], "gid int, nid int, x double, y double, z double")
    cells = spark.createDataFrame([(0, [2.0 * n, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 9.0], [True, False, False])], "gid int, a array<double>, b array<double>, c array<double>, pbc array<boolean>")
    w = shape("tent1").column(F.col("length"), F.lit(1.0))
    free, ring = S.radius_edges(pts, 3.0, w).count(), S.radius_edges(pts, 3.0, w, cells=cells).count()
    assert free == n - 1 and ring == (n if n > 2 else 1)


def test_radius_edges_are_not_grouped(spark):
    """Skew lattice, against brute force: the nearest image once, and no sums over edges in the plan."""
    r = np.random.default_rng(5)
    xyz, cell = r.uniform(0, 4, (40, 3)), np.array([[4.0, 0.5, 0.0], [0.0, 4.0, 0.3], [0.2, 0.0, 4.0]])
    pts = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(xyz)], "gid int, nid int, x double, y double, z double")
    for pbc in ([True, True, False], [False] * 3):
        moves = [m @ cell for m in np.array(np.meshgrid(*[[-1, 0, 1] if p else [0] for p in pbc])).T.reshape(-1, 3)]
        far = {(i, j): min(np.linalg.norm(xyz[i] - xyz[j] - m) for m in moves) for i in range(40) for j in range(i + 1, 40)}
        want = {k: v for k, v in far.items() if v < 1.9}
        cells = spark.createDataFrame([(0, *cell.tolist(), pbc)], "gid int, a array<double>, b array<double>, c array<double>, pbc array<boolean>")
        for got in [S.radius_edges(pts, 1.9, cells=cells), *([] if any(pbc) else [S.radius_edges(pts, 1.9)])]:
            assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
            rows = got.collect()
            assert len(rows) == len(want) and all(abs(want[e.src, e.dst] - e.length) < 1e-12 for e in rows)


def test_gaussian_process(spark):
    x = np.linspace(0, 2, 6)
    rbf = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2))
    y = np.sin(x)
    k = rbf(x, x)
    pairs = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(6) for j in range(i, 6)], "g1 int, g2 int, k double")
    gp = models.GaussianProcess(alpha=1e-6).fit(pairs, spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "gid int, y double"))
    cross = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(6) for j in range(6)], "g1 int, g2 int, k double")
    got = {r.g1: (r.y, r.std) for r in gp.predict_std(cross, spark.createDataFrame([(i, 1.0) for i in range(6)], "gid int, k double")).collect()}
    assert np.allclose([got[i][0] for i in range(6)], y, atol=1e-3) and max(s for _, s in got.values()) < 0.01
    loo, _ = gp.leave_one_out()
    for i in range(6):
        keep = [j for j in range(6) if j != i]
        assert np.isclose(loo[i], k[i, keep] @ np.linalg.solve(k[np.ix_(keep, keep)] + 1e-6 * np.eye(5), y[keep]), atol=1e-7)
    masked = models.masked_targets(spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, float("inf")), (5, 3.0)], "gid int, y double"), normalize=True)
    assert {r.gid: r.y for r in masked.collect()} == {1: -1.0, 5: 1.0}
    xs, core = np.linspace(0, 2, 200), np.linspace(0, 2, 5)
    kc, kx = rbf(core, core), rbf(xs, core)
    spark_core = spark.createDataFrame([(i, j, float(kc[i, j])) for i in range(5) for j in range(i, 5)], "g1 int, g2 int, k double")
    spark_cross = spark.createDataFrame([(i, j, float(kx[i, j])) for i in range(200) for j in range(5)], "g1 int, g2 int, k double")
    low = models.LowRankGaussianProcess(alpha=1e-9, beta=1e-12).fit(spark_core, spark_cross, spark.createDataFrame([(i, float(np.cos(v))) for i, v in enumerate(xs)], "gid int, y double"))
    best = kx @ np.linalg.lstsq(kx, np.cos(xs))[0]  # the low-rank form is least squares over the core's functions
    assert np.allclose([r.y for r in low.predict(spark_cross).orderBy("g1").collect()], best, atol=5e-3)


def test_label_propagation(spark):
    both = lambda e: spark.createDataFrame([(a, b, w) for a, b, w in e] + [(b, a, w) for a, b, w in e], "i int, j int, w double")
    ys = lambda v: spark.createDataFrame(list(enumerate(v)), "gid int, y double")
    run = lambda e, v: {r.gid: round(r.y, 6) for r in models.propagate_labels(both(e), ys(v), smoothing=0.0).collect()}
    assert run([(0, 1, 3.0), (1, 2, 1.0)], [1.0, None, 0.0]) == {1: 0.75}
    assert run([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], [1.0, None, None, 0.0]) == {1: round(2 / 3, 6), 2: round(1 / 3, 6)}
    z = models.propagate_labels(both([(0, 1, 1.0), (1, 2, 1.0)]), ys([0.0, None, 1.0]), smoothing=0.0)
    assert np.isclose(models.label_entropy(z).first()[0], -np.log(0.5))
    tri = both([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0)])
    assert np.isclose(models.label_loo_error(tri, ys([-1.0, 0.0, 1.0]), 1).first()[0], 1.0)
    assert np.isclose(models.label_loo_error(tri, ys([-1.0, 0.0, 1.0]), 2).first()[0], np.sqrt(1.5))
    with pytest.raises(ValueError, match="unlabelled"):
        models.propagate_labels(tri, ys([1.0, 0.0, 1.0]))


def test_selection(spark):
    for n in (3, 9, 31):
        x = np.linspace(-2, 2, n)
        k = np.exp(-((x[:, None] - x[None]) ** 2) / 8)
        assert models.variance_minimizer(k, 1) == [n // 2]
    assert len(set(models.determinant_maximizer(np.ones((5, 5)), 3))) == 3
    pts = spark.createDataFrame([(i, [float(i % 40), float(i // 40)]) for i in range(800)], "gid int, v array<double>")
    got = models.hierarchical_selection(pts, lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / 50), 6, leaf=100).collect()
    assert len({r.gid for r in got}) == 6


def test_sequences(spark):
    grams = {(r.context, r.symbol): (r.cnt, r.freq) for r in sequences.frequencies(sequences.ngrams(spark.createDataFrame([(1, "AABBB")], "id int, s string"), 0)).collect()}
    assert grams == {("", "A"): (2, 0.4), ("", "B"): (3, 0.6)}
    t = sequences.ngrams(spark.createDataFrame([(1, "ABCDEF")], "id int, s string"), 3)
    q = spark.createDataFrame([(1, "XBC"), (2, "ZZ"), (3, "ABC")], "id int, s string")
    assert {r.id: r.context for r in sequences.match_context(t, q, 3).collect()} == {1: "BC", 2: "", 3: "ABC"}
    rw = sequences.SequenceRewriter(t, n=2, seed=1)
    assert 0 < len(rw("ABC")) <= 3 and "ABC" not in rw("ABC")
    found = sequences.TreeSearch(rw, lambda s: (np.array([len(x) for x in s], float), np.full(len(s), 0.5))).seek("ABC", 6.0, 60)
    assert abs(found[0][1] - 6) < 2
    kids = {"a": ["b", "c", "b"], "b": ["d"]}
    value = {"a": (9.0, 1.0), "b": (1.0, 0.5), "c": (4.0, 1.0), "d": (2.0, 2.0)}
    found = sequences.TreeSearch(lambda x: kids.get(x, []), lambda xs: np.array([value[x] for x in xs]).T).seek("a", 1.6, 1)
    density = lambda m, sd: np.exp(-0.5 * ((1.6 - m) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))
    mean = (4 * 1 + 1 * 4) / 5  # of the children alone, by precision
    assert [x[0] for x in found] == ["b", "a", "c"] and np.isclose(found[1][3], density(mean, np.sqrt((4 * (1 - mean) ** 2 + (4 - mean) ** 2) / 5)))
    assert {x[0] for x in sequences.TreeSearch(lambda x: kids.get(x, []), lambda xs: np.array([value[x] for x in xs]).T).seek("a", 1.6, 9)} == set("abcd")
    tree = sequences.flatten_tree(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "id int, parent int")).collect()
    assert {r.id: r.level for r in tree} == {1: 0, 2: 1, 3: 2, 4: 1}


def test_linear_algebra():
    r = np.random.default_rng(3)
    a = r.normal(size=(12, 12))
    a = a @ a.T + 0.1 * np.eye(12)
    b = r.normal(size=12)
    assert np.allclose(a @ linalg.chol_solve(a, b), b) and np.allclose(a @ linalg.cg_solve(a, b), b, atol=1e-6)
    assert np.allclose(linalg.powerh(a, 0.5) @ linalg.powerh(a, 0.5), a) and np.allclose(linalg.pinvh(a)[0], np.linalg.inv(a))
    inv = linalg.bordered_inverse(np.linalg.inv(a[:11, :11]), a[:11, 11], a[11, 11])
    assert np.allclose(inv, np.linalg.inv(a))
    u, v = r.normal(size=(50, 4)), r.normal(size=(50, 4))
    x, y = linalg.LowRank(u, v), linalg.LowRank(v, u)
    assert np.allclose((x @ y + x - y.T).todense(), u @ v.T @ v @ u.T + u @ v.T - (v @ u.T).T)
    assert np.allclose(x.todense() @ x.pinv().todense() @ x.todense(), x.todense()) and np.isclose(x.trace(), np.trace(x.todense()))


def test_reorder_deals_with_many_graphs_in_a_call(spark):
    """A graph each would cost a call of Python each: graphs come as rows of a batch, also those without an edge."""
    rng = np.random.default_rng(3)
    graphs = {f"g{k}": (int(rng.integers(1, 9)), rng.integers(0, 9, (int(rng.integers(0, 12)), 2))) for k in range(60)}
    graphs = {g: (n, [tuple(sorted((int(a) % n, int(b) % n))) for a, b in e]) for g, (n, e) in graphs.items()}
    nodes = spark.createDataFrame([(g, i) for g, (n, _) in graphs.items() for i in range(n)], "gid string, nid int")
    edges = spark.createDataFrame([(g, a, b, 1.0) for g, (_, e) in graphs.items() for a, b in e], "gid string, src int, dst int, w double")
    got = G.reorder(nodes, edges, "rcm")
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    want = set()
    for g, (n, e) in graphs.items():
        src, dst = np.array([a for a, _ in e], int), np.array([b for _, b in e], int)
        want |= {(g, i, at) for at, i in enumerate(G.reverse_cuthill_mckee(n, src, dst))}
    assert {tuple(r) for r in got.collect()} == want


def test_steps_of_the_walk_shuffle_no_pairs(spark):
    """More steps do not shuffle more, and settings are as before; one large pair is still dealt over all tasks."""

    def sent():
        time.sleep(1)
        of = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(of.apply(i).totalShuffleWrite() for i in range(of.size()))

    nodes = spark.createDataFrame([(g, i, "ab"[i % 2], float(i + g)) for g in range(20) for i in range(5)], "gid long, nid int, lab string, val double")
    edges = spark.createDataFrame([(g, i, j, 1.0 + i, 0.5 * j) for g in range(20) for i in range(5) for j in range(i, 5)], "gid long, src int, dst int, w double, len double")
    k = GraphKernel(mk.TensorProduct(lab=mk.KroneckerDelta(0.3), val=mk.SquareExponential(2.0)), mk.TensorProduct(len=mk.SquareExponential(1.0)), q=0.1)
    pairs = spark.createDataFrame([(g, g + 1) for g in range(19)], "g1 long, g2 long")
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "-1")
    try:
        used, got = [sent()], []
        for tol, which in ((1e-1, pairs), (1e-9, pairs), (1e-9, pairs.limit(1))):
            got.append({(r.g1, r.g2): r.k for r in walk_similarity(nodes, edges, k.node.column, k.edge.column, q=0.1, pairs=which, tol=tol).collect()})
            used.append(sent())
    finally:
        spark.conf.set(names[0], before[0])
    assert [spark.conf.get(n) for n in names] == before
    want = {(r.g1, r.g2): r.k for r in k.listed(pack(nodes, edges), pairs).collect()}
    assert set(got[1]) == set(want) and all(np.isclose(got[1][x], want[x], atol=1e-6) for x in want)
    assert len(got[2]) == 1 and all(np.isclose(got[2][x], want[x], atol=1e-6) for x in got[2])
    assert used[2] - used[1] < 1.5 * (used[1] - used[0])
