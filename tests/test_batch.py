"""Stacked solves against single ones, and searches by pivots against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.functions import microkernel as mk
from kindred.operators import metrics
from kindred.plans import batch, kernel, search
from kindred.plans.kernel import GraphKernel, Packed, pack


def random_graph(r, gid, n, hub=False, edges=True):
    ends = {(min(i, j), max(i, j)) for i, j in r.integers(n, size=(2 * n, 2)).tolist()} if edges else set()
    ends |= {(0, j) for j in range(1, n)} if hub and edges else set()
    ends = sorted(ends)
    return Packed.of(pd.Series({"gid": gid, "n": n, "p": r.random(n) + 0.5, "n_c": list(r.choice(list("abc"), n)), "n_v": r.random(n), "src": [e[0] for e in ends], "dst": [e[1] for e in ends], "w": r.random(len(ends)) + 0.1, "e_l": r.random(len(ends))}))


NODE, EDGE = mk.TensorProduct(c=mk.KroneckerDelta(0.4), v=mk.SquareExponential(0.7)), mk.TensorProduct(l=mk.RationalQuadratic(0.5, 1.5))


@pytest.mark.parametrize("direct", [0, 100])
@pytest.mark.parametrize("lmin", [0, 1])
def test_stacked_solves_equal_single_ones(monkeypatch, direct, lmin):
    monkeypatch.setattr(batch, "DIRECT", direct)
    r = np.random.default_rng(1)
    graphs = [random_graph(r, i, n, hub=i % 4 == 3) for i, n in enumerate([1, 2, 3, 5, 9, 9, 10, 17, 30, 40])] + [random_graph(r, 99, 4, edges=False)]
    k = GraphKernel(NODE, EDGE, q=0.05, lmin=lmin)
    one = GraphKernel(NODE, EDGE, q=0.05, lmin=lmin, solver="dense")
    for entries in (1, 1 << 18):
        monkeypatch.setattr(batch, "ENTRIES", entries)
        for a in (graphs[3], graphs[8], graphs[-1]):
            for b, (x, _, _), (k1, dk) in zip(graphs, batch.solved(k, a, graphs), k.many(a, graphs, gradient=True), strict=True):
                assert np.allclose(x, one.solve(a, b), atol=1e-8)
                value, g = one.gradient(a, b)
                assert np.isclose(k1, value, atol=1e-7) and np.allclose(dk, g, rtol=1e-6, atol=1e-6), (a.n, b.n)


def test_graphs_of_48_nodes(spark):
    """Value and gradient in one run at the size of the bench, against the dense solve."""
    r = np.random.default_rng(2)
    a, *bs = [random_graph(r, i, 48) for i in range(4)]
    k, one = GraphKernel(NODE, EDGE, q=0.05), GraphKernel(NODE, EDGE, q=0.05, solver="dense")
    for b, (v, g) in zip(bs, k.many(a, bs, gradient=True), strict=True):
        value, grad = one.gradient(a, b)
        assert np.isclose(v, value, rtol=1e-9) and np.allclose(g, grad, rtol=1e-7)


def test_small_products_laid_out_by_tables_equal_dense_ones():
    """Mixed sizes in one class, self-loops, parallel edges (which take the list), weights for the adjoint's right side."""
    r = np.random.default_rng(5)
    graphs = [random_graph(r, i, n) for i, n in enumerate([3, 5, 5, 18, 19])]
    twice = Packed.of(pd.Series({"gid": 9, "n": 2, "p": np.ones(2), "n_c": ["a", "b"], "n_v": [0.1, 0.2], "src": [0, 0], "dst": [1, 1], "w": [1.0, 2.0], "e_l": [0.3, 0.6]}))
    k, one = GraphKernel(NODE, EDGE, q=0.05), GraphKernel(NODE, EDGE, q=0.05, solver="dense")
    for a in (graphs[0], graphs[1], twice):
        for b, (x, _, g) in zip([*graphs, twice], batch.solved(k, a, [*graphs, twice], adjoint=lambda b, x: np.eye(*x.shape)), strict=True):
            assert np.allclose(x, one.solve(a, b))
            _, dr = one.nodal_gradient(a, b)
            assert np.allclose(g, (dr / np.outer(a.p, b.p)).trace(axis1=1, axis2=2), rtol=1e-6, atol=1e-8)


def test_metrics_within_blocks_equal_those_of_tables(spark):
    packed = tables(spark, 25).cache()
    k = GraphKernel(mk.TensorProduct(lab=mk.KroneckerDelta(0.3), val=mk.SquareExponential(2.0)), mk.TensorProduct(len=mk.SquareExponential(1.0)), q=0.1)
    pairs, diag = k.pairs(packed), k.diag(packed)
    rows = lambda df: {(r[0], r[1]): r[2] for r in df.collect()}
    far = metrics.nodal_distances(k.nodal(packed), k.diag_nodal(packed)).cache()
    for got, want in ((k.normalized(packed, 2.0), metrics.exponentiate(metrics.normalize(pairs, diag), 2.0)), (k.distances(packed), metrics.kernel_distance(pairs, diag)), (k.maximin(packed), metrics.maximin(far))):
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        got, want = rows(got), rows(want)
        assert len(want) == 26 * 27 // 2 and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want)
    asked = spark.createDataFrame([(i, i + 1) for i in range(25)], "g1 long, g2 long")
    tied = far.withColumn("d", F.round("d", 7))
    want = {(r.g1, r.g2): (r.n1, r.n2) for r in metrics.hotspot(tied, metrics.maximin(tied)).collect()}
    assert {(r.g1, r.g2): (r.n1, r.n2) for r in k.hotspots(packed, asked).collect()} == {(i, i + 1): want[i, i + 1] for i in range(25)}


@pytest.mark.parametrize("listed", [64, 600, 4000])
def test_edges_too_many_to_list_pairs(monkeypatch, listed):
    """Below the number of distinct pairs of features edges meet in stretches, above it by singular terms."""
    r = np.random.default_rng(7)
    a, b, c = random_graph(r, 0, 30, hub=True), random_graph(r, 1, 25), random_graph(r, 2, 40)
    c.edges["l"] = c.edges["l"].round(1)
    k = GraphKernel(NODE, EDGE, q=0.05)
    one = GraphKernel(NODE, EDGE, q=0.05, solver="dense")
    monkeypatch.setattr(kernel, "EDGE_PAIRS", listed)
    for x, y in ((a, b), (c, c)):
        assert len(x.src) * len(y.src) > listed
        assert np.allclose(k.solve(x, y), one.solve(x, y), rtol=1e-8)
        assert np.allclose(GraphKernel(NODE, EDGE, q=0.05, lmin=1).solve(x, y), GraphKernel(NODE, EDGE, q=0.05, lmin=1, solver="dense").solve(x, y), rtol=1e-8)


def test_listed_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(kernel, "LOT", 10)
    monkeypatch.setattr(kernel, "TOGETHER", 8)
    packed = tables(spark, 40).cache()
    k = GraphKernel(mk.TensorProduct(lab=mk.KroneckerDelta(0.3), val=mk.SquareExponential(2.0)), mk.TensorProduct(len=mk.SquareExponential(1.0)), q=0.1)
    asked = [(i, i + 1) for i in range(40)] + [(7, i) for i in range(20, 40)] + [(3, 99), (99, 3)]
    got = k.listed(packed, spark.createDataFrame(asked, "g1 long, g2 long")).cache()
    assert got.rdd.getNumPartitions() == 7
    want = {(r.g1, r.g2): r.k for r in k.pairs(packed).collect()}
    assert {(r.g1, r.g2): round(r.k, 9) for r in got.collect()} == {p: round(want[p], 9) for p in asked[:-2]}


def tables(spark, count, seed=0):
    r = np.random.default_rng(seed)
    nodes, edges = [], []
    for g in range(count):
        n = int(r.integers(2, 7))
        kind = g % 5
        nodes += [(g, i, "abcde"[(kind + i) % 5], float(kind + r.random() * 0.3)) for i in range(n)]
        edges += [(g, i, i + 1, 1.0, float(r.random())) for i in range(n - 1)]
    copies = [(count, *x[1:]) for x in nodes if x[0] == 0], [(count, *x[1:]) for x in edges if x[0] == 0]
    nodes, edges = nodes + copies[0], edges + copies[1]
    return pack(spark.createDataFrame(nodes, "gid long, nid int, lab string, val double"), spark.createDataFrame(edges, "gid long, src int, dst int, w double, len double")).repartition(4)


@pytest.mark.parametrize("kind", [search.KernelMetric, search.MaximinMetric])
def test_pivot_search_equals_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(search, "GRAPHS", 50)
    monkeypatch.setattr(search, "QUERIES", 3)
    packed = tables(spark, 120).cache()
    metric = kind(GraphKernel(mk.TensorProduct(lab=mk.KroneckerDelta(0.3), val=mk.SquareExponential(2.0)), mk.TensorProduct(len=mk.SquareExponential(1.0)), q=0.1))
    graphs = search._graphs(packed.toPandas())
    for g in graphs:
        g.own = np.asarray(metric.own(g))
    index = search.GraphIndex(packed, metric, pivots=6, candidates=20)
    want, near = {}, []
    for a in graphs:
        if a.gid % 20 == 0:
            d = sorted((round(d, 4) + 0.0, b.gid) for b, d in zip(graphs, metric.distances(a, graphs), strict=True) if b.gid != a.gid)
            want[a.gid] = d[:7]
            near += [(a.gid, g, d) for d, g in d if d <= 0.3]
    got = index.nearest(F.col("gid") % 20 == 0, 7).collect()
    assert {q: [(r.d, r.g2) for r in sorted(got, key=lambda r: r["rank"]) if r.g1 == q] for q in want} == want
    assert 0 < sum({r.g1: r.solved for r in got}.values()) < len(want) * 120
    assert sorted((r.g1, r.g2, r.d) for r in index.within(F.col("gid") % 20 == 0, 0.3).collect()) == sorted(near)
    assert index.nearest(F.lit(False), 3).count() == 0
    alone = search.GraphIndex(packed.where("gid < 2"), metric)
    assert sorted((r.g1, r["rank"], r.g2) for r in alone.nearest(F.lit(True), 5).collect()) == [(0, 1, 1), (1, 1, 0)]
