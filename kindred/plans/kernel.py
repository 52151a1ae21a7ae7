"""The marginalized (random-walk) graph kernel as a Spark plan.

Graphs are packed to one row of parallel arrays. All-pairs results deal graphs into blocks, so each pair of blocks is
one group of bounded size and a graph is copied once per block it meets rather than once per graph; explicit pair lists
are joined and dealt by their first graph. A group's pairs are solved in numpy, stacked into arrays (``batch``): directly
for small products of graphs, by preconditioned conjugate gradients without forming the matrix for large ones. One pair
alone is solved densely, by conjugate gradients or by the walk iteration. The walk iteration also exists
as joins and sums over tables (:func:`walk_similarity`), which is how a pair too large for a task is solved.

With D(i) = d(i1) d(i2) / (1 - q)^2, node similarity v and edge similarity e, the solution x of
(diag(D / v) - W) x = D, W = w1 w2 e, gives the nodal similarity p(i1) p(i2) x(i), and its sum the graph similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.microkernel import Constant, MicroKernel, check_range
from ..operators.graph_ops import degree, symmetrized
from .batch import DIRECT, _conjugate, solved
from .checkpoint import checkpointed

#: Products of more node pairs than this are solved without forming the matrix.
DENSE = 1500
#: Pairs of edges up to which they are listed.
EDGE_PAIRS = 1 << 23


def pack(nodes: DataFrame, edges: DataFrame, start: Column | None = None) -> DataFrame:
    """One row per graph: gid, n, p (starting probabilities), n_<feature> arrays, src, dst, w, e_<feature> arrays."""
    feats = [c for c in nodes.columns if c not in ("gid", "nid")]
    efeats = [c for c in edges.columns if c not in ("gid", "src", "dst", "w")]
    p = (start if start is not None else F.lit(1.0)).cast("double").alias("_p")
    n = nodes.select("gid", F.struct("nid", p, *feats).alias("s")).groupBy("gid").agg(F.sort_array(F.collect_list("s")).alias("s"))
    n = n.select("gid", F.size("s").alias("n"), F.col("s._p").alias("p"), *[F.col(f"s.{c}").alias(f"n_{c}") for c in feats])
    weight = F.col("w").cast("double").alias("w") if "w" in edges.columns else F.lit(1.0).alias("w")
    e = edges.select("gid", F.struct("src", "dst", weight, *efeats).alias("s")).groupBy("gid").agg(F.sort_array(F.collect_list("s")).alias("s"))
    e = e.select("gid", *[F.col(f"s.{c}").alias(c) for c in ("src", "dst", "w")], *[F.col(f"s.{c}").alias(f"e_{c}") for c in efeats])
    return n.join(e, "gid", "left")


@dataclass
class Packed:
    """One graph in numpy: directed edges (self-loops once), degrees, features."""

    gid: object
    n: int
    p: np.ndarray
    nodes: dict
    src: np.ndarray
    dst: np.ndarray
    w: np.ndarray
    edges: dict
    d: np.ndarray
    once: int | None = None  # undirected edges, which stand first; the others repeat them in the other direction

    @classmethod
    def of(cls, r) -> Packed:
        get = lambda c, t: np.asarray(r[c] if r[c] is not None else [], t)
        s, t, w = get("src", int), get("dst", int), get("w", float)
        both = np.r_[np.arange(len(s)), np.flatnonzero(s != t)]
        src, dst, w = np.r_[s, t[s != t]], np.r_[t, s[s != t]], w[both]
        d = np.bincount(src, w, int(r["n"]))
        feature = lambda v: np.asarray(v) if v is not None else np.zeros(0)
        out = cls(r["gid"], int(r["n"]), get("p", float), {c[2:]: feature(r[c]) for c in r.index if c.startswith("n_")}, src, dst, w, {c[2:]: feature(r[c])[both] if r[c] is not None else np.zeros(0) for c in r.index if c.startswith("e_")}, np.where(d == 0, 1.0, d), len(s))
        if "own" in r.index:  # what a metric needs of the graph alone
            out.own = np.asarray(r["own"], float)
        return out


def _distinct(g: Packed) -> tuple[np.ndarray, object]:
    """For each directed edge the number of its features among the distinct ones, and those."""
    if not g.edges:
        return np.zeros(len(g.src), int), np.zeros(1)
    t = pd.DataFrame(g.edges)
    codes = t.groupby(list(t.columns), sort=False, dropna=False).ngroup().to_numpy()
    first = np.unique(codes, return_index=True)[1]
    return codes, _rows(g.edges, first)


def _rows(features, at: np.ndarray):
    return {c: v[at] for c, v in features.items()} if isinstance(features, dict) else features[at]


def _length(features) -> int:
    return len(next(iter(features.values())) if isinstance(features, dict) else features)


@dataclass(frozen=True)
class GraphKernel:
    """Node and edge microkernels over named features (or one Constant), stopping probability q, walk length lmin."""

    node: MicroKernel
    edge: MicroKernel
    q: float = 0.01
    lmin: int = 0
    solver: str = "auto"
    tol: float = 1e-10

    def __post_init__(self):
        if not 0 < self.q < 1 or self.lmin not in (0, 1) or self.solver not in ("auto", "dense", "pcg", "walk"):
            raise ValueError("q must lie in (0, 1), lmin be 0 or 1, solver auto, dense, pcg or walk")
        check_range(self.node, "node", open_below=True)
        check_range(self.edge, "edge", open_below=False)

    # ------------------------------------------------------------------ hyperparameters, log scale
    @property
    def theta(self) -> np.ndarray:
        return np.log([self.q, *self.node.theta, *self.edge.theta])

    @property
    def active(self) -> np.ndarray:
        free = lambda b: b != "fixed" and b[0] < b[1]
        return np.array([True, *map(free, [*self.node.bounds, *self.edge.bounds])])

    def with_theta(self, theta) -> GraphKernel:
        t = np.exp(theta)
        n = len(self.node.theta)
        return replace(self, q=float(t[0]), node=self.node.with_theta(t[1 : 1 + n]), edge=self.edge.with_theta(t[1 + n :]))

    # ------------------------------------------------------------------ one pair
    def _parts(self, a: Packed, b: Packed, grad: bool = False):
        of = lambda k, x, y: k.values_and_partials(x, y) if grad else (k.values(x, y), [])
        v, gv = of(self.node, a.nodes or np.zeros(a.n), b.nodes or np.zeros(b.n))
        if len(a.src) and len(b.src):
            e, ge = of(self.edge, a.edges or np.zeros(len(a.src)), b.edges or np.zeros(len(b.src)))
        else:
            e, ge = np.zeros((len(a.src), len(b.src))), [np.zeros((len(a.src), len(b.src)))] * len(self.edge.theta)
        ww = np.outer(a.w, b.w)
        rows = (a.src[:, None] * b.n + b.src[None]).ravel()
        cols = (a.dst[:, None] * b.n + b.dst[None]).ravel()
        d = np.outer(a.d, b.d).ravel() / (1 - self.q) ** 2
        return v.ravel(), [z.ravel() for z in gv], (ww * e).ravel(), [(ww * z).ravel() for z in ge], rows, cols, d

    def solve(self, a: Packed, b: Packed) -> np.ndarray:
        """x, as (a.n, b.n)."""
        if self.solver in ("auto", "pcg") and len(a.src) * len(b.src) > EDGE_PAIRS:
            return self._solve_large(a, b)
        v, _, w, _, rows, cols, d = self._parts(a, b)
        x = self._solve(v, w, rows, cols, d, d)
        return (x - v if self.lmin else x).reshape(a.n, b.n)

    def _solve_large(self, a: Packed, b: Packed) -> np.ndarray:
        """As :meth:`solve` where pairs of edges are too many to list: conjugate gradients whose memory is a few arrays of (a.n, b.n).

        The edge similarity of distinct features is split into its singular terms, all but those at rounding: W x is then
        a sum of A x B' over them, with a matrix of weights of either graph. Where distinct features are too many for
        that, stretches of a's edges meet all of b's, one after the other.
        """
        v = self.node.values(a.nodes or np.zeros(a.n), b.nodes or np.zeros(b.n))
        rhs = np.outer(a.d, b.d) / (1 - self.q) ** 2
        (ia, fa), (ib, fb) = _distinct(a), _distinct(b)
        if _length(fa) * _length(fb) <= EDGE_PAIRS:
            u, s, vt = np.linalg.svd(self.edge.values(fa, fb), full_matrices=False)
            terms = range(int((s > s[0] * np.finfo(float).eps).sum()))
            matrix = lambda g, w: np.bincount(g.src * g.n + g.dst, w, g.n * g.n).reshape(g.n, g.n)

            def times(x: np.ndarray) -> np.ndarray:
                return sum(matrix(a, a.w * (s[k] * u[ia, k])) @ x @ matrix(b, b.w * vt[k, ib]).T for k in terms)
        else:

            def times(x: np.ndarray) -> np.ndarray:
                out, step = np.zeros(a.n * b.n), max(1, EDGE_PAIRS // 8 // len(b.src))
                for k in range(0, len(a.src), step):
                    at = slice(k, k + step)
                    e = self.edge.values(_rows(fa, ia[at]), _rows(fb, ib)) * np.outer(a.w[at], b.w) * x[a.dst[at]][:, b.dst]
                    out += np.bincount((a.src[at, None] * b.n + b.src).ravel(), e.ravel(), len(out))
                return out.reshape(a.n, b.n)

        x = _conjugate(lambda x: times(x[0, 0])[None, None], (rhs / v)[None], rhs[None, None], self.tol)[0, 0]
        return x - v if self.lmin else x

    def _solve(self, v, w, rows, cols, d, rhs) -> np.ndarray:
        n = len(v)
        how = self.solver if self.solver != "auto" else ("dense" if n <= DENSE else "pcg")
        if how == "dense":
            m = np.bincount(rows * n + cols, -w, n * n).reshape(n, n).astype(float)  # without edges the sums are whole numbers
            m[np.arange(n), np.arange(n)] += d / v
            return np.linalg.solve(m, rhs)
        times = lambda x: np.bincount(rows, w * x[cols], n)
        if how == "walk":
            x = v / d * rhs
            for _ in range(100_000):
                new = v / d * (rhs + times(x))
                if np.abs(new - x).max() < self.tol:
                    return new
                x = new
            raise ArithmeticError("the walk iteration did not converge")
        x = np.zeros(n)
        r = rhs.copy()
        z = v / d * r
        s, rz = z.copy(), r @ z
        for _ in range(10 * n):
            t = d / v * s - times(s)
            step = rz / (s @ t)
            x += step * s
            r -= step * t
            if np.sqrt(r @ r) < self.tol * np.sqrt(rhs @ rhs):
                return x
            z = v / d * r
            new = r @ z
            s, rz = z + new / rz * s, new
        raise ArithmeticError("conjugate gradients did not converge")

    def similarity(self, a: Packed, b: Packed) -> float:
        return float(a.p @ self.solve(a, b) @ b.p)

    def gradient(self, a: Packed, b: Packed) -> tuple[float, np.ndarray]:
        """Value and derivatives with respect to (q, node parameters, edge parameters), not their logarithms."""
        v, gv, w, ge, rows, cols, d = self._parts(a, b, True)
        pp = np.outer(a.p, b.p).ravel()
        y, z = self._solve(v, w, rows, cols, d, d), self._solve(v, w, rows, cols, d, pp)
        dd = 2 / (1 - self.q) * d
        out = [pp @ (0 * y) + z @ (dd - dd / v * y)]
        out += [(z * d / v**2 * y) @ g - (pp @ g if self.lmin else 0.0) for g in gv]
        out += [(z[rows] * y[cols]) @ g for g in ge]
        return float(pp @ (y - v if self.lmin else y)), np.array(out, float)

    def nodal_gradient(self, a: Packed, b: Packed) -> tuple[np.ndarray, np.ndarray]:
        """Nodal similarities and their exact derivatives (parameters first)."""
        v, gv, w, ge, rows, cols, d = self._parts(a, b, True)
        pp = np.outer(a.p, b.p).ravel()
        y = self._solve(v, w, rows, cols, d, d)
        dd = 2 / (1 - self.q) * d
        solve = lambda rhs: self._solve(v, w, rows, cols, d, rhs)
        out = [solve(dd - dd / v * y)]
        out += [solve(d / v**2 * y * g) - (g if self.lmin else 0) for g in gv]
        out += [solve(np.bincount(rows, g * y[cols], len(v))) for g in ge]
        shape = (a.n, b.n)
        return (pp * (y - v if self.lmin else y)).reshape(shape), np.array([(pp * o).reshape(shape) for o in out])

    # ------------------------------------------------------------------ Spark plans
    def pairs(self, x: DataFrame, y: DataFrame | None = None, *, gradient: bool = False, block: int | None = None) -> DataFrame:
        """(g1, g2, k[, dk]) for packed graphs: g1 <= g2 within one table, or every pair across two."""
        fields = "k double" + ", dk array<double>" * gradient
        return block_pairs(x, y, lambda a, bs: [[t] for t in self.many(a, bs, gradient)], fields, block)

    def normalized(self, x: DataFrame, power: float = 1.0) -> DataFrame:
        """(g1, g2, k / sqrt(k1 k2)) of all pairs g1 <= g2, to a power: self similarities go with the graphs, pairs are not moved."""
        return self._related(x, lambda k, a, b: (k / np.sqrt(a * b)) ** power, "k double")

    def distances(self, x: DataFrame) -> DataFrame:
        """(g1, g2, d) of all pairs g1 <= g2: sqrt((k1 + k2) / 2 - k), at least 0, without moving pairs."""
        return self._related(x, lambda k, a, b: np.sqrt(np.maximum(0.0, 0.5 * (a + b) - k)), "d double")

    def _related(self, x: DataFrame, relate: Callable, fields: str) -> DataFrame:
        def result(a: Packed, bs: list[Packed]) -> list[list[tuple]]:
            k = np.array([v for (v,) in self.many(a, bs)])
            return [[(v,)] for v in relate(k, a.own[0], np.array([b.own[0] for b in bs])).tolist()]

        return block_pairs(with_own(x, lambda g: [self.many(g, [g])[0][0]]), None, result, fields, None)

    def maximin(self, x: DataFrame, *, scale: float = 1.0) -> DataFrame:
        """(g1, g2, d) of all pairs g1 <= g2: the Hausdorff distance over nodes, times ``scale``; no nodal row leaves a task."""

        def result(a: Packed, bs: list[Packed]) -> list[list[tuple]]:
            return [[(float(_farthest(d) * scale),)] for d in self.nodal_distances(a, bs)]

        return block_pairs(with_own(x, self.own_nodes), None, result, "d double", None)

    def hotspots(self, x: DataFrame, pairs: DataFrame, *, digits: int = 7) -> DataFrame:
        """(g1, g2, n1, n2) for the given pairs of ids: the node pair at the Hausdorff distance, of several the last in row order.
        Nodal distances count as tied when they are equal to ``digits``."""

        def result(a: Packed, bs: list[Packed]) -> list[tuple]:
            far = [d.round(digits) for d in self.nodal_distances(a, bs)]
            return [tuple(int(z[-1]) for z in np.nonzero(d == _farthest(d))) for d in far]

        return listed_pairs(with_own(x, self.own_nodes), pairs, result, "n1 int, n2 int")

    def own_nodes(self, g: Packed) -> list[float]:
        """Each node's similarity with itself."""
        return np.diag(self.solutions(g, [g])[0]).tolist()

    def nodal_distances(self, a: Packed, bs: list[Packed]) -> list[np.ndarray]:
        """sqrt(1 - r) for all nodes of ``a`` and each of ``bs``, r being the similarity normalised by ``own_nodes``."""
        return [np.sqrt(np.maximum(0.0, 1.0 - r / np.sqrt(np.outer(a.own, b.own)))) for b, r in zip(bs, self.solutions(a, bs), strict=True)]

    def many(self, a: Packed, bs: list[Packed], gradient: bool = False) -> list[tuple]:
        """(k[, dk]) of one graph with each of ``bs``, solved together unless a solver is asked for."""
        if self.solver != "auto":
            return [(lambda k, g: (k, g.tolist()))(*self.gradient(a, b)) if gradient else (self.similarity(a, b),) for b in bs]
        got = solved(self, a, bs, gradient)
        right = np.concatenate([b.p for b in bs]) if bs else np.zeros(0)
        parts = a.p @ np.concatenate([x for x, _, _ in got], axis=1) * right if bs else right
        k = np.add.reduceat(parts, np.cumsum([0, *[b.n for b in bs[:-1]]])).tolist() if bs else []
        return [(v, *([g.tolist()] if gradient else [])) for v, (_, _, g) in zip(k, got, strict=True)]

    def solutions(self, a: Packed, bs: list[Packed]) -> list[np.ndarray]:
        """Nodal similarities of one graph with each of ``bs``."""
        x = [x for x, _, _ in solved(self, a, bs)] if self.solver == "auto" else [self.solve(a, b) for b in bs]
        return [s * np.outer(a.p, b.p) for s, b in zip(x, bs, strict=True)]

    def nodal(self, x: DataFrame, y: DataFrame | None = None, *, block: int = 32) -> DataFrame:
        """(g1, g2, n1, n2, r) node by node."""

        def result(a: Packed, bs: list[Packed]) -> list[list[tuple]]:
            return [[(i, j, float(r[i, j])) for i in range(a.n) for j in range(b.n)] for b, r in zip(bs, self.solutions(a, bs), strict=True)]

        return block_pairs(x, y, result, "n1 int, n2 int, r double", block)

    def diag(self, x: DataFrame, *, gradient: bool = False) -> DataFrame:
        """(gid, k[, dk]) self similarity; no join."""
        if gradient:
            return self._each(x, lambda g: [(k, d.tolist()) for k, d in [self.gradient(g, g)]], "k double, dk array<double>")
        return self._each(x, lambda g: [(self.similarity(g, g),)], "k double")

    def diag_nodal(self, x: DataFrame) -> DataFrame:
        """(gid, nid, r): each node with itself."""
        return self._each(x, lambda g: [(i, float(z)) for i, z in enumerate(np.diag(self.solve(g, g)) * g.p**2)], "nid int, r double")

    def diag_block(self, x: DataFrame) -> DataFrame:
        """(gid, r): each graph's nodal self similarity as nested arrays."""
        return self._each(x, lambda g: [((self.solve(g, g) * np.outer(g.p, g.p)).tolist(),)], "r array<array<double>>")

    def maximin_gradient(self, x: DataFrame, y: DataFrame | None = None, *, scale: float = 1.0, block: int | None = None) -> DataFrame:
        """(g1, g2, d, n1, n2, dd): Hausdorff distance over nodes, the node pair it is attained at, and the distance's
        derivatives (order of :meth:`gradient`) there; zeros where the distance is 0. Of tied node pairs the last counts."""

        def own(g: Packed) -> list[float]:
            """Each node with itself: similarities, then derivatives by parameter."""
            r, dr = self.nodal_gradient(g, g)
            return np.concatenate([np.diag(r), np.diagonal(dr, axis1=1, axis2=2).ravel()]).tolist()

        def row(a: Packed, b: Packed, r: np.ndarray, at: Callable) -> tuple:
            """``at`` gives the derivatives of r at a node pair."""
            da, ga, db, gb = a.own[: a.n], a.own[a.n :].reshape(-1, a.n), b.own[: b.n], b.own[b.n :].reshape(-1, b.n)
            norm = r / np.sqrt(np.outer(da, db))
            i, j, far = _hottest(norm)
            dn = at(i, j) / np.sqrt(da[i] * db[j]) - 0.5 * norm[i, j] * (ga[:, i] / da[i] + gb[:, j] / db[j])
            slope = -0.5 / far * dn * scale if far > 0 else np.zeros(len(dn))
            return float(far * scale), i, j, slope.tolist()

        def result(a: Packed, bs: list[Packed]) -> list[list[tuple]]:
            out: list = [None] * len(bs)
            small = [k for k, b in enumerate(bs) if self.solver == "auto" and a.n * b.n <= DIRECT]
            for k in sorted(set(range(len(bs))) - set(small)):
                r, g = self.nodal_gradient(a, bs[k])
                out[k] = [row(a, bs[k], r, lambda i, j, g=g: g[:, i, j])]

            def at_hot(b: Packed, x: np.ndarray) -> np.ndarray:
                """The right side whose adjoint solution has the derivatives of the hottest pair's similarity."""
                i, j, _ = _hottest(x * np.outer(a.p, b.p) / np.sqrt(np.outer(a.own[: a.n], b.own[: b.n])))
                one = np.zeros((a.n, b.n))
                one[i, j] = a.p[i] * b.p[j]
                return one

            for k, (x, _, g) in zip(small, solved(self, a, [bs[k] for k in small], adjoint=at_hot), strict=True):
                out[k] = [row(a, bs[k], x * np.outer(a.p, bs[k].p), lambda i, j, g=g: g)]
            return out

        return block_pairs(with_own(x, own), None if y is None else with_own(y, own), result, "d double, n1 int, n2 int, dd array<double>", block)

    def listed(self, x: DataFrame, pairs: DataFrame) -> DataFrame:
        """(g1, g2, k) for the given pairs of ids."""
        return listed_pairs(x, pairs, lambda a, bs: self.many(a, bs), "k double")

    def _each(self, x: DataFrame, result: Callable, fields: str) -> DataFrame:
        names = [f.split()[0] for f in fields.split(", ")]
        kind = dict(x.dtypes)["gid"]

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(g.gid, *t) for g in map(Packed.of, (r for _, r in b.iterrows())) for t in result(g)]
                yield pd.DataFrame(out, columns=["gid", *names])

        return x.mapInPandas(rows, f"gid {kind}, {fields}")


def _farthest(d: np.ndarray) -> float:
    """The largest distance to a nearest node, either way."""
    return max(d.min(axis=1).max(), d.min(axis=0).max())


def _hottest(norm: np.ndarray) -> tuple[int, int, float]:
    """The last node pair at the Hausdorff distance, and that distance, from normalised similarities."""
    d = np.sqrt(np.maximum(0.0, 1.0 - norm))
    far = _farthest(d)
    i, j = (int(z[-1]) for z in np.nonzero(d == far))
    return i, j, far


#: Graphs of a task that makes what is needed of each graph alone.
OWN = 256


def with_own(x: DataFrame, own: Callable[[Packed], list[float]]) -> DataFrame:
    """Packed graphs with an array ``own`` of what ``own`` gives of each alone; written, since blocks read it more than once."""
    x = checkpointed(x)
    x = x.repartition(max(1, min(TASKS, -(-x.count() // OWN))), "gid")  # small rows, dear solves

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(own=[own(Packed.of(r)) for _, r in b.iterrows()])

    return checkpointed(x.mapInPandas(rows, x.withColumn("own", F.lit(None).cast("array<double>")).schema))


#: Most graphs of a block.
BLOCK = 256
#: Most tasks that blocks of pairs are dealt to.
TASKS = 20_000
#: Pairs of one graph that are solved together, on average.
TOGETHER = 128
#: Listed pairs that a task takes up at a time, on average.
LOT = 256


def listed_pairs(x: DataFrame, pairs: DataFrame, result: Callable, fields: str) -> DataFrame:
    """(g1, g2, fields) with ``result(a, bs)``, a row for each of bs, for the given pairs of ids.

    A graph's pairs are dealt into groups of about TOGETHER; it is sent once to each of them. Groups are dealt to tasks
    by the number of pairs: they are small in bytes and dear in time, so that sizes say nothing.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    kind = dict(x.dtypes)["gid"]
    pairs = checkpointed(pairs.select("g1", "g2"))
    lots = max(1, -(-pairs.count() // LOT))
    size = pairs.groupBy("g1").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_n"))
    dealt = pairs.join(size, "g1").withColumn("_c", F.pmod(F.xxhash64("g2"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_lot", F.pmod(F.xxhash64("g1", "_c"), F.lit(lots)).cast("int"))
    left = dealt.select("g1", "_c", "_lot").distinct().join(x.withColumn("g1", F.col("gid")), "g1")
    right = dealt.select("g1", "_c", "_lot", "g2").join(x.withColumn("g2", F.col("gid")), "g2")

    def solve(ones: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        out = []
        lone = {(r["g1"], r["_c"]): r for _, r in ones.iterrows()}
        for key, t in many.groupby(["g1", "_c"], sort=False):
            if key in lone:  # a graph that is not there has no pairs
                a, bs = Packed.of(lone[key]), [Packed.of(r) for _, r in t.iterrows()]
                out += [(a.gid, b.gid, *v) for b, v in zip(bs, result(a, bs), strict=True)]
        return pd.DataFrame(out, columns=["g1", "g2", *names])

    tasks = min(lots, TASKS)
    right = right.select([F.col(c).alias(c) for c in right.columns])  # columns of its own, apart from those of the left
    sides = [df.repartition(tasks, "_lot").groupBy("_lot") for df in (left, right)]
    return sides[0].cogroup(sides[1]).applyInPandas(solve, f"g1 {kind}, g2 {kind}, {fields}")


def block_pairs(x: DataFrame, y: DataFrame | None, result: Callable, fields: str, block: int | None) -> DataFrame:
    """Apply ``result(graph, graphs)``, a list of rows for each pair, to packed graphs, ``block`` of each side to a group.

    The number of blocks follows from a count of the graphs; a graph is sent to as many groups as there are blocks, so
    unless given a block is BLOCK graphs, or less where that makes fewer than some 100 groups. Groups are dealt to tasks by their number: they are small in bytes and dear in time, so that sizes say nothing.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    kind = dict(x.dtypes)["gid"]
    own = lambda df, n: F.pmod(F.xxhash64("gid"), F.lit(n)).cast("int")
    blocks = lambda n: max(1, -(-n // (block or max(16, min(BLOCK, -(-n // 16))))))
    x = checkpointed(x)
    nx = blocks(x.count())
    if y is None:
        dealt = x.withColumn("_b", own(x, nx)).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
        dealt = dealt.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o"), "_side": F.lit(0)})
    else:
        y = checkpointed(y)
        ny = blocks(y.count())
        dealt = x.withColumn("_i", own(x, nx)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).withColumn("_side", F.lit(0))
        other = y.withColumn("_j", own(y, ny)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("_side", F.lit(1))
        dealt = dealt.unionByName(other.select(dealt.columns))
    same = y is None

    def solve(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        graphs = [Packed.of(r) for _, r in t.iterrows()]
        out = []
        if same:
            side = t["_b"].to_numpy()
            order = sorted(range(len(graphs)), key=lambda k: graphs[k].gid)
            for s, k in enumerate(order):
                with_ = [graphs[m] for m in order[s:] if key[0] == key[1] or side[k] != side[m]]
                out += [(graphs[k].gid, b.gid, *r) for b, rows in zip(with_, result(graphs[k], with_) if with_ else [], strict=True) for r in rows]
        else:
            side = t["_side"].to_numpy()
            with_ = [graphs[m] for m in np.flatnonzero(side == 1)]
            for k in np.flatnonzero(side == 0) if with_ else []:
                out += [(graphs[k].gid, b.gid, *r) for b, rows in zip(with_, result(graphs[k], with_), strict=True) for r in rows]
        return pd.DataFrame(out, columns=["g1", "g2", *names])

    groups = nx * (nx + 1) // 2 if same else nx * ny
    return dealt.repartition(min(groups, TASKS), "_i", "_j").groupBy("_i", "_j").applyInPandas(solve, f"g1 {kind}, g2 {kind}, {fields}")


def upper_pairs(ids: DataFrame, block: int = 64) -> DataFrame:
    """(g1, g2) with g1 <= g2 of all ids, by equi-joins of blocks: an id is copied once per block it meets."""
    n = max(1, -(-ids.count() // block))
    own = F.pmod(F.xxhash64("gid"), F.lit(n)).cast("int")
    met = ids.select("gid", own.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_o"))
    met = met.select("gid", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))
    side = lambda k: met.select(F.col("gid").alias(f"g{k}"), F.col("_b").alias(f"_b{k}"), "_i", "_j")
    both = side(1).join(side(2), ["_i", "_j"]).where("g1 <= g2 AND (_i = _j OR _b1 <> _b2)")
    return both.select("g1", "g2")


#: Pairs of graphs that a task of the walk plan holds, on average.
PAIRS = 2_000
#: Steps of the walk plan that are one stage where pairs are dealt once: each sorts and sums in the same task's memory.
CHAIN = 2
#: For the steps of the walk plan: rows dealt by one of a join's keys need not be dealt anew, and a checkpoint tells how its
#: rows are dealt, which that of an adaptive plan does not.
AS_DEALT = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.enabled": "false"}


def walk_similarity(nodes: DataFrame, edges: DataFrame, node: Callable[[Column, Column], Column], edge: Callable[[Column, Column], Column], *, q: float, pairs: DataFrame | None = None, tol: float = 1e-8, max_steps: int = 1000, check: int = 8) -> DataFrame:
    """(g1, g2, k) by joins and sums alone: walk steps x <- (v / D) (D + W x), from x = v, until none moves by ``tol``.

    ``pairs`` (g1, g2) are all with g1 <= g2 unless given. Movement is looked at every ``check`` steps, where the lineage
    is cut; raises if ``max_steps`` do not suffice. Pairs are dealt by their second graph once, before they are made, and
    steps keep to that: what is shuffled is graphs and sides of pairs, neither node pairs nor edge pairs. Where few
    graphs have most of the edge pairs, these are dealt anew in each step instead, over all tasks.
    """
    pairs = checkpointed(upper_pairs(nodes.select("gid").distinct()) if pairs is None else pairs.select("g1", "g2"))
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS))
    even = _even(pairs, edges, parts)
    deal = lambda df: df.repartition(parts, "g2") if even else df
    full = degree(nodes, edges).join(nodes, ["gid", "nid"])
    side = lambda k: full.select(F.col("gid").alias(f"g{k}"), F.col("nid").alias(f"i{k}"), F.col("d").alias(f"d{k}"), F.struct(*nodes.columns).alias(f"s{k}"))
    v = node(F.col("s1"), F.col("s2"))
    pn = deal(pairs.join(side(1), "g1")).join(side(2), "g2").select("g1", "g2", "i1", "i2", v.alias("v"), (F.col("d1") * F.col("d2") / (1 - q) ** 2).alias("d"))
    both = symmetrized(edges)
    eside = lambda k: both.select(F.col("gid").alias(f"g{k}"), F.col("src").alias(f"i{k}"), F.col("dst").alias(f"j{k}"), F.col("w").alias(f"w{k}"), F.struct(*edges.columns).alias(f"s{k}"))
    pe = deal(pairs.join(eside(1), "g1")).join(eside(2), "g2").select("g1", "g2", "i1", "i2", "j1", "j2", (F.col("w1") * F.col("w2") * edge(F.col("s1"), F.col("s2"))).alias("w"))
    ours = AS_DEALT if even else {}
    before = {k: spark.conf.get(k) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        if even:  # and sorted as the steps join them
            pn, pe = pn.sortWithinPartitions("g1", "g2", "i1", "i2"), pe.sortWithinPartitions("g1", "g2", "j1", "j2")
        x = _walk(checkpointed(pn), checkpointed(pe), tol, max_steps, check, CHAIN if even else check)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return x.groupBy("g1", "g2").agg(F.sum("x").alias("k"))


def _even(pairs: DataFrame, edges: DataFrame, parts: int) -> bool:
    """Whether no second graph has more than some tasks' share of the edge pairs."""
    size = lambda k: edges.groupBy(F.col("gid").alias(f"g{k}")).agg(F.count("*").cast("double").alias(f"n{k}"))
    own = pairs.join(size(1), "g1").join(size(2), "g2").groupBy("g2").agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))
    most, total = own.agg(F.max("n"), F.sum("n")).first()
    return total is not None and most * parts <= 4 * total


def _walk(pn: DataFrame, pe: DataFrame, tol: float, max_steps: int, check: int, chain: int) -> DataFrame:
    """(g1, g2, i1, i2, x) where the steps of :func:`walk_similarity` end, checkpointed; ``chain`` steps are run at once."""
    keys = ["g1", "g2", "i1", "i2"]
    x = pn.select(*keys, F.col("v").alias("x"))
    for step in range(1, max_steps + 1):
        near = x.select("g1", "g2", F.col("i1").alias("j1"), F.col("i2").alias("j2"), "x")
        got = pe.join(near, ["g1", "g2", "j1", "j2"]).groupBy(keys).agg(F.sum(F.col("w") * F.col("x")).alias("s"))
        last = step % check == 0
        new = pn.join(got, keys, "left")
        if last:  # the step's movement comes along, so that no step runs twice
            new = new.join(x.withColumnRenamed("x", "_x"), keys)
        value = F.col("v") / F.col("d") * (F.col("d") + F.coalesce("s", F.lit(0.0)))
        new = new.select(*keys, value.alias("x"), *([F.abs(value - F.col("_x")).alias("moved")] if last else []))
        if last:
            new = checkpointed(new)
            moved = new.agg(F.max("moved")).first()[0]
            new = new.drop("moved")
            if moved is None or moved < tol:
                return new
        elif step % chain == 0:
            new = checkpointed(new)
        x = new
    raise ArithmeticError("the walk iteration did not converge")


def molecular_kernel(stopping: float = 0.01, element_prior: float = 0.2, edge_length_scale: float = 0.05) -> GraphKernel:
    """The preset for atoms (``element``) joined by edges with a ``length``."""
    from ..functions.microkernel import KroneckerDelta, SquareExponential, TensorProduct

    return GraphKernel(TensorProduct(element=KroneckerDelta(element_prior)), TensorProduct(length=SquareExponential(edge_length_scale)), q=stopping)


def minimax_kernel(q: float = 0.01, element_delta: float = 0.2, bond_eps: float = 0.02, charge_eps: float | None = None) -> GraphKernel:
    """The preset of the molecular minimax metric; with ``charge_eps`` atoms also have a ``charge``. Its distance is
    ``maximin(nodal_distances(..., scale=sqrt(2)))`` over graphs with edges weighted by ``tent2`` at zoom 0.75."""
    from ..functions.microkernel import KroneckerDelta, SquareExponential, TensorProduct

    charge = {} if charge_eps is None else {"charge": SquareExponential(charge_eps)}
    return GraphKernel(TensorProduct(element=KroneckerDelta(element_delta), **charge), TensorProduct(length=SquareExponential(bond_eps)), q=q)


def unlabeled(q: float = 0.01, **options) -> GraphKernel:
    return GraphKernel(Constant(1.0), Constant(1.0), q=q, **options)
