"""Fitting of hyperparameters: objectives with gradients, a bounded quasi-Newton search, and the models that use them.

Similarities reach an objective as a dense matrix of a bounded training set (``models.LIMIT``, less for the derivatives:
``FIT_LIMIT``) or, for the low-rank model, as core-by-core sums that Spark adds up over any number of rows. Parameters
are searched by their logarithms; derivatives of a similarity are with respect to the parameters themselves.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expression import parse
from ..plans.kernel import GraphKernel
from .linalg import inverse, pinvh
from .models import LIMIT, GaussianProcess, LowRankGaussianProcess, masked_targets

#: Training points whose Gramian derivatives a driver holds.
FIT_LIMIT = 3_000

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


# --------------------------------------------------------------------------- search
@dataclass
class Optimum:
    x: np.ndarray
    value: float
    converged: bool


def minimize(fun: Objective, x0: np.ndarray, bounds: np.ndarray, *, tol: float = 1e-5, steps: int = 500, memory: int = 10) -> Optimum:
    """Limited-memory quasi-Newton search along the projection to the bounds, with backtracking.

    Converged when the projected gradient's largest entry or the relative gain of a step is below ``tol``.
    """
    lo, hi = np.asarray(bounds, float).reshape(-1, 2).T
    x = np.clip(np.asarray(x0, float), lo, hi)
    f, g = fun(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if not len(x) or np.abs(np.clip(x - g, lo, hi) - x).max() < tol:
            return Optimum(x, f, True)
        free = ~(((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0)))
        way = -_two_loops(g * free, past) * free
        if way @ g >= 0:
            past, way = [], -g * free
        step = 1.0 if past else min(1.0, 1.0 / np.abs(way).max())
        while True:
            new = np.clip(x + step * way, lo, hi)
            fn, gn = fun(new)
            if np.isfinite(fn) and fn <= f + 1e-4 * (g @ (new - x)):
                break
            step /= 2
            if step < 1e-12:
                if not past:
                    return Optimum(x, f, False)
                past, new, fn, gn = [], x, f, g
                break
        s, y = new - x, gn - g
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y)][-memory:]
        gain, moved = f - fn, bool(np.any(s))
        x, f, g = new, fn, gn
        if moved and gain <= tol * 1e-3 * max(abs(f), 1.0):
            return Optimum(x, f, True)
    return Optimum(x, f, False)


def _two_loops(g: np.ndarray, past: list) -> np.ndarray:
    q, used = g.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        q -= a * y
        used.append(a)
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(used), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return q


def search(fun: Objective, x0: np.ndarray, bounds: np.ndarray, *, tol: float = 1e-5, repeat: int = 1, jitter: float = 1.0, seed: int = 0, starts: Callable | None = None) -> Optimum:
    """The best of ``repeat`` searches, the first from x0 and the others from jittered starts (``starts(rng, k)`` if given)."""
    rng = np.random.default_rng(seed)
    best = None
    for k in range(repeat):
        start = starts(rng, k) if starts else x0 + jitter * rng.standard_normal(len(x0)) * (k > 0)
        got = minimize(fun, start, bounds, tol=tol)
        if got.converged and (best is None or got.value < best.value):
            best = got
    if best is None:
        raise RuntimeError("the search for hyperparameters did not converge")
    return best


# --------------------------------------------------------------------------- similarities with parameters
class PointSimilarity:
    """A formula in ``x``, the Euclidean distance of two vectors, and named parameters: value and bounds or 'fixed'."""

    def __init__(self, formula: str = "exp(-x**2 / (2 * s**2))", **hyper: tuple[float, tuple[float, float] | str]):
        self.formula, self.hyper, self.expr = formula, hyper, parse(formula)
        if missing := self.expr.free() - {"x", *hyper}:
            raise ValueError(f"parameters without a value: {sorted(missing)}")
        for name, (_, b) in hyper.items():
            if b != "fixed" and not 0 < b[0] <= b[1]:
                raise ValueError(f"bounds of {name}: {b}")
        self.free = [n for n, (_, b) in hyper.items() if b != "fixed" and b[0] < b[1]]

    @property
    def theta(self) -> np.ndarray:
        return np.log([self.hyper[n][0] for n in self.free])

    @property
    def bounds(self) -> np.ndarray:
        return np.log([self.hyper[n][1] for n in self.free]).reshape(-1, 2)

    def with_theta(self, theta) -> PointSimilarity:
        new = dict(zip(self.free, np.exp(theta), strict=True))
        return PointSimilarity(self.formula, **{n: (float(new.get(n, v)), b) for n, (v, b) in self.hyper.items()})

    def over(self, d: np.ndarray, gradient: bool = False):
        """Values at distances, and with ``gradient`` their derivatives, parameters first."""
        env = {"x": d, **{n: v for n, (v, _) in self.hyper.items()}}
        k = np.broadcast_to(self.expr.numpy(env), d.shape).astype(float)
        if not gradient:
            return k
        return k, np.array([np.broadcast_to(self.expr.diff(n).numpy(env), d.shape) for n in self.free]).reshape(-1, *d.shape)

    def __call__(self, x: np.ndarray, y: np.ndarray | None = None, gradient: bool = False):
        return self.over(distances(x, x if y is None else y), gradient)

    def diag(self, x: np.ndarray) -> np.ndarray:
        return self.over(np.zeros(len(x)))

    def pairs(self, distance: DataFrame) -> DataFrame:
        """(g1, g2, k) over a table (g1, g2, d)."""
        return distance.select("g1", "g2", self.expr.column({"x": F.col("d"), **{n: v for n, (v, _) in self.hyper.items()}}).alias("k"))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = (np.asarray(z, float).reshape(len(z), -1) for z in (x, y))
    step = max(1, (1 << 20) // max(1, y.size))  # rows whose differences fit a core's cache
    parts = [np.sqrt(((x[i : i + step, None] - y[None]) ** 2).sum(-1)) for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros((0, len(y)))


class GraphSimilarity:
    """A graph kernel over a table of packed graphs: the same protocol, solved by Spark."""

    def __init__(self, kernel: GraphKernel, graphs: DataFrame, q_bounds: tuple[float, float] | str = (1e-4, 1 - 1e-4), block: int = 64):
        self.kernel, self.graphs, self.q_bounds, self.block = kernel, graphs, q_bounds, block

    @property
    def active(self) -> np.ndarray:
        return np.r_[self.q_bounds != "fixed", self.kernel.active[1:]].astype(bool)

    @property
    def theta(self) -> np.ndarray:
        return self.kernel.theta[self.active]

    @property
    def bounds(self) -> np.ndarray:
        every = [self.q_bounds, *self.kernel.node.bounds, *self.kernel.edge.bounds]
        return np.log([b for b, on in zip(every, self.active, strict=True) if on]).reshape(-1, 2)

    def with_theta(self, theta) -> GraphSimilarity:
        full = self.kernel.theta
        full[self.active] = theta
        return GraphSimilarity(self.kernel.with_theta(full), self.graphs, self.q_bounds, self.block)

    def gramian(self) -> tuple[list, np.ndarray, np.ndarray]:
        """Ids in order, the matrix and its derivatives."""
        n = self.graphs.count()
        if n > FIT_LIMIT:
            raise ValueError(f"{n} training graphs; derivatives are held for {FIT_LIMIT}, use the low-rank model")
        t = self.kernel.pairs(self.graphs, gradient=True, block=self.block).toPandas()
        ids = sorted(set(t["g1"]))
        at = {g: i for i, g in enumerate(ids)}
        i, j = t["g1"].map(at).to_numpy(), t["g2"].map(at).to_numpy()
        k, dk = np.zeros((len(ids), len(ids))), np.zeros((int(self.active.sum()), len(ids), len(ids)))
        d = np.stack(t["dk"].to_numpy())[:, self.active]
        for a, b in ((i, j), (j, i)):
            k[a, b], dk[:, a, b] = t["k"], d.T
        return ids, k, dk


# --------------------------------------------------------------------------- objectives
def likelihood(k: np.ndarray, dk: np.ndarray, y: np.ndarray, beta: float = 1e-8) -> tuple[float, np.ndarray]:
    """y' K^-1 y + log det K and its derivatives."""
    inv, logdet = inverse(k, beta)
    w = inv @ y
    return float(y @ w + logdet), np.einsum("ij,pij->p", inv, dk) - np.einsum("i,pij,j->p", w, dk, w)


def loo_loss(k: np.ndarray, dk: np.ndarray, y: np.ndarray, beta: float = 1e-8) -> tuple[float, np.ndarray]:
    """Half the sum of squared leave-one-out errors and its derivatives."""
    inv, _ = inverse(k, beta)
    w, d = inv @ y, np.diag(inv)
    e = w / d
    moved = [inv @ g @ inv for g in dk]
    return float(0.5 * e @ e), np.array([e @ (-(m @ y) / d + w * np.diag(m) / d**2) for m in moved])


def low_rank_likelihood(kcc, dkcc, a, da, b, db) -> tuple[float, np.ndarray]:
    """The low-rank model's objective from core-by-core sums: a = Kxc' Kxc, b = Kxc' y, da = Kxc' dKxc, db = dKxc' y.

    With u = a^-1 b it is u' Kcc u + log det a - log det Kcc.
    """
    ai, la = inverse(a, 1e-14)
    ci, lc = inverse(kcc, 1e-14)
    u = ai @ b
    grad = []
    for dc, s, t in zip(dkcc, da, db, strict=True):
        both = s + s.T
        du = ai @ (t - both @ u)
        grad.append(2 * u @ kcc @ du + u @ dc @ u + np.sum(ai * both) - np.sum(ci * dc))
    return float(u @ kcc @ u + la - lc), np.array(grad)


def regularized(k: np.ndarray, alpha, how: str = "+") -> np.ndarray:
    return k + np.diag(np.broadcast_to(alpha, len(k))) if how == "+" else k + np.diag(np.diag(k) * alpha)


def _regularized_gradient(dk: np.ndarray, alpha, how: str) -> np.ndarray:
    return dk if how == "+" else dk + np.einsum("pii,ij->pij", dk, np.eye(dk.shape[1])) * alpha


# --------------------------------------------------------------------------- models
def _known(y) -> np.ndarray:
    return np.isfinite(np.asarray([np.nan if v is None else v for v in y], float))


def fit_points(similarity: PointSimilarity, x: np.ndarray, y, *, alpha: float = 1e-8, beta: float = 1e-8, regularization: str = "+", loss: str | None = "likelihood", **options) -> tuple[PointSimilarity, GaussianProcess]:
    """The similarity with fitted parameters (``loss`` None: as they are) and the Gaussian process over the known points."""
    at = np.flatnonzero(_known(y))
    xs, ys = np.asarray(x, float)[at], np.array([float(y[i]) for i in at])
    score = _loss(loss)
    if score:

        def fun(theta):
            k, dk = similarity.with_theta(theta)(xs, gradient=True)
            f, g = score(regularized(k, alpha, regularization), _regularized_gradient(dk, alpha, regularization), ys, beta)
            return f, g * np.exp(theta)

        similarity = similarity.with_theta(search(fun, similarity.theta, similarity.bounds, **options).x)
    model = GaussianProcess(alpha, beta, regularization)
    return similarity, model.fit_matrix(list(at), regularized(similarity(xs), alpha, regularization), ys)


def fit_graphs(similarity: GraphSimilarity, y: DataFrame, *, alpha: float = 1e-8, beta: float = 1e-8, regularization: str = "+", loss: str = "likelihood", **options) -> tuple[GraphSimilarity, GaussianProcess]:
    """As :func:`fit_points` for graphs; y(gid, y) may lack graphs or be null, which leaves them out."""
    known = masked_targets(y).join(similarity.graphs.select("gid"), "gid", "left_semi")
    similarity = GraphSimilarity(similarity.kernel, similarity.graphs.join(known.select("gid"), "gid", "left_semi").cache(), similarity.q_bounds, similarity.block)
    ids, k, dk = similarity.gramian()
    target = {r.gid: r.y for r in known.collect()}
    ys = np.array([target[g] for g in ids])
    score, first = _loss(loss), [similarity.theta, k, dk]

    def fun(theta):
        km, dm = first[1:] if np.array_equal(theta, first[0]) else similarity.with_theta(theta).gramian()[1:]
        f, g = score(regularized(km, alpha, regularization), _regularized_gradient(dm, alpha, regularization), ys, beta)
        return f, g * np.exp(theta)

    similarity = similarity.with_theta(search(fun, similarity.theta, similarity.bounds, **options).x)
    model = GaussianProcess(alpha, beta, regularization)
    return similarity, model.fit_matrix(ids, regularized(similarity.gramian()[1], alpha, regularization), ys)


def _loss(name: str | None):
    if name not in (None, "likelihood", "loocv"):
        raise ValueError(f"not a loss: {name}")
    return {None: None, "likelihood": likelihood, "loocv": loo_loss}[name]


def fit_low_rank(similarity: PointSimilarity, core: np.ndarray, points: DataFrame, *, alpha: float = 1e-7, beta: float = 1e-7, **options) -> tuple[PointSimilarity, LowRankGaussianProcess]:
    """Fits on points(gid, v, y) held by Spark: each evaluation of the objective is one pass that adds up small matrices."""
    core = np.asarray(core, float).reshape(len(core), -1)
    rows = points.where("y IS NOT NULL AND NOT isnan(y)").select("v", "y").cache()
    rows.count()

    def sums(s: PointSimilarity, gradient: bool):
        c, p = len(core), len(s.free) if gradient else 0

        def part(batches):
            out = np.zeros((1 + p, c + 1, c))
            for t in batches:
                if len(t):
                    v, y = np.stack(t["v"].to_numpy()), t["y"].to_numpy(float)
                    k, dk = s(v, core, True)
                    for i, m in enumerate([k, *dk][: 1 + p]):
                        out[i, :c] += k.T @ m
                        out[i, c] += m.T @ y
            yield pd.DataFrame({"i": np.arange(out.size), "v": out.ravel()})

        t = rows.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros((1 + p) * (c + 1) * c)
        out[t["i"]] = t["v"]
        out = out.reshape(1 + p, c + 1, c)
        return out[:, :c], out[:, c]

    def fun(theta):
        s = similarity.with_theta(theta)
        a, b = sums(s, True)
        kcc, dkcc = s(core, gradient=True)
        f, g = low_rank_likelihood(regularized(kcc, alpha), dkcc, a[0], a[1:], b[0], b[1:])
        return f, g * np.exp(theta)

    similarity = similarity.with_theta(search(fun, similarity.theta, similarity.bounds, **options).x)
    a, b = sums(similarity, False)
    return similarity, LowRankGaussianProcess(alpha, beta).fit_sums(list(range(len(core))), similarity(core), a[0], b[0])


class OutlierDetector:
    """A Gaussian process with a noise deviation per sample, found under an L1 penalty ``w`` on the deviations."""

    def __init__(self, similarity: PointSimilarity, sigma_bounds: tuple[float, float] = (1e-4, np.inf), beta: float = 1e-8):
        self.similarity, self.sigma_bounds, self.beta = similarity, sigma_bounds, beta

    def objective(self, theta_sigma: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """y' K^-1 y + log det K over (theta, log sigma), K having sigma^2 on its diagonal, and its derivatives."""
        p = len(self.similarity.theta)
        theta, sigma = theta_sigma[:p], np.exp(theta_sigma[p:])
        k, dk = self.similarity.with_theta(theta)(x, gradient=True)
        inv, logdet = pinvh(k + np.diag(sigma**2), self.beta, "clamp")
        w = inv @ y
        by_theta = np.einsum("ij,pij->p", inv, dk) - np.einsum("i,pij,j->p", w, dk, w)
        return float(y @ w + logdet), np.r_[by_theta, (np.diag(inv) - w**2) * 2 * sigma] * np.exp(theta_sigma)

    def fit(self, x: np.ndarray, y, w: float, *, udist: Callable[[int], np.ndarray] | None = None, tol: float = 1e-4, repeat: int = 1, jitter: float = 1.0, seed: int = 0) -> OutlierDetector:
        at = np.flatnonzero(_known(y))
        if len(at) > FIT_LIMIT:
            raise ValueError(f"{len(at)} samples; the dense form holds {FIT_LIMIT}")
        self.x, self.y = np.asarray(x, float)[at], np.array([float(y[i]) for i in at])
        n, p = len(at), len(self.similarity.theta)
        penalty = np.r_[np.zeros(p), np.full(n, float(w))]

        def fun(t):
            f, g = self.objective(t, self.x, self.y)
            return f + penalty @ np.exp(t), g + penalty * np.exp(t)

        def starts(rng, k):
            sigma = udist(n) if udist else self.y.std() * rng.lognormal(-1.0, 1.0, n)
            return np.r_[self.similarity.theta + jitter * rng.standard_normal(p) * (k > 0), np.log(sigma)]

        bounds = np.r_[self.similarity.bounds, np.tile(np.log(self.sigma_bounds), (n, 1))]
        got = search(fun, None, bounds, tol=tol, repeat=repeat, seed=seed, starts=starts)
        self.similarity, self.sigma = self.similarity.with_theta(got.x[:p]), np.exp(got.x[p:])
        self.inverse, self.logdet = pinvh(self.similarity(self.x) + np.diag(self.sigma**2), self.beta, "clamp")
        self.weights = self.inverse @ self.y
        return self

    @property
    def y_uncertainty(self) -> np.ndarray:
        """The noise deviation of each known sample: large for an outlier."""
        return self.sigma

    def predict(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation; the predicted points have no noise of their own."""
        k = self.similarity(z, self.x)
        return k @ self.weights, np.sqrt(np.maximum(0, self.similarity.diag(z) - np.einsum("ij,jk,ik->i", k, self.inverse, k)))


class GaussianField:
    """Label propagation over a bounded set of points whose weights have parameters; large weight tables: models.propagate_labels."""

    def __init__(self, weight: PointSimilarity, smoothing: float = 1e-3):
        self.weight, self.smoothing = weight, smoothing

    def _weights(self, d: np.ndarray, weight: PointSimilarity, gradient: bool):
        off = 1 - np.eye(len(d))
        if not gradient:
            return weight.over(d) * off
        w, dw = weight.over(d, True)
        return w * off, dw * off

    def predict(self, d: np.ndarray, y, influence: bool = False):
        """Labels with the unknown ones filled in, from the points' distances; and the influence matrix of the known."""
        ok = _known(y)
        if ok.all():
            raise ValueError("nothing is unlabelled")
        out = np.array([v if k else np.nan for v, k in zip(y, ok, strict=True)], float)
        inner, outer, _ = self._system(d, ok, self.weight, False)
        reach = np.linalg.solve(inner, outer)
        out[~ok] = reach @ out[ok]
        return (out, reach) if influence else out

    def _system(self, d, ok, weight, gradient):
        got = self._weights(d, weight, gradient)
        w, dw = got if gradient else (got, np.zeros((0, *d.shape)))
        w = w + self.smoothing * (1 - np.eye(len(d)))
        block = lambda m: (np.diag(m[~ok].sum(1)) - m[np.ix_(~ok, ~ok)], m[np.ix_(~ok, ok)])
        return *block(w), [block(m) for m in dw]

    def entropy_loss(self, d, y, theta=None) -> tuple[float, np.ndarray]:
        """Average entropy of the filled-in labels and its derivatives by the logarithms of the parameters."""
        weight = self.weight if theta is None else self.weight.with_theta(theta)
        ok = _known(y)
        known = np.array([float(v) for v, k in zip(y, ok, strict=True) if k])
        inner, outer, parts = self._system(d, ok, weight, True)
        z = np.linalg.solve(inner, outer @ known)
        dz = np.array([np.linalg.solve(inner, do @ known - di @ z) for di, do in parts]).reshape(-1, len(z))
        c = np.clip(z, 1e-7, 1 - 1e-7)
        slope = np.where(c == z, np.log(1 - c) - np.log(c), 0.0)
        return float(-np.mean(c * np.log(c) + (1 - c) * np.log(1 - c))), (dz * slope).mean(1) * np.exp(weight.theta)

    def loo_loss(self, d, y, p: float = 2.0, theta=None) -> tuple[float, np.ndarray]:
        """p-norm mean of the labelled points' errors when predicted from each other, and its derivatives."""
        weight = self.weight if theta is None else self.weight.with_theta(theta)
        ok = _known(y)
        known = np.array([float(v) for v, k in zip(y, ok, strict=True) if k])
        w, dw = self._weights(d[np.ix_(ok, ok)], weight, True)
        w = w + self.smoothing * (1 - np.eye(len(w)))
        total = w.sum(1)
        mean = w @ known / total
        e = known - mean
        err = np.mean(np.abs(e) ** p) ** (1 / p)
        dmean = np.array([(m @ known - mean * m.sum(1)) / total for m in dw]).reshape(-1, len(known))
        outer = err ** (1 - p) / len(e) if err > 0 else 0.0
        return float(err), outer * (np.abs(e) ** (p - 1) * np.sign(e) * -dmean).sum(1) * np.exp(weight.theta)

    def fit(self, d: np.ndarray, y, loss: str = "loocv2", **options) -> GaussianField:
        """``loss``: 'ale' (average label entropy), 'loocv1' or 'loocv2'."""
        if loss not in ("ale", "loocv1", "loocv2"):
            raise ValueError(f"not a loss: {loss}")
        if len(d) > LIMIT:
            raise ValueError(f"{len(d)} points; the dense form holds {LIMIT}")
        fun = (lambda t: self.entropy_loss(d, y, t)) if loss == "ale" else (lambda t: self.loo_loss(d, y, float(loss[-1]), t))
        self.weight = self.weight.with_theta(search(fun, self.weight.theta, self.weight.bounds, **options).x)
        return self

    def fit_predict(self, d: np.ndarray, y, loss: str = "ale", **options) -> np.ndarray:
        return self.fit(d, y, loss, **options).predict(d, y)


# --------------------------------------------------------------------------- keeping models
_PARTS = {GaussianProcess: ("y", "weights", "inverse"), LowRankGaussianProcess: ("kcc", "r", "z")}


def save(model: GaussianProcess | LowRankGaussianProcess, spark: SparkSession, path: str, *, theta=(), overwrite: bool = False) -> None:
    """Writes a fitted model as Parquet to any store Spark reaches: a row per training or core point. An existing path is an error."""
    parts = {c: getattr(model, c) for c in _PARTS[type(model)]}
    head = {"kind": type(model).__name__, "alpha": model.alpha, "beta": model.beta, "theta": [float(t) for t in theta]}
    head |= {"regularization": model.regularization, "logdet": model.logdet} if isinstance(model, GaussianProcess) else {}
    rows = [(i, json.dumps(g.item() if hasattr(g, "item") else g), json.dumps(head) if i == 0 else None, *[np.atleast_1d(v[i]).tolist() for v in parts.values()]) for i, g in enumerate(model.ids)]
    fields = ", ".join(f"{c} array<double>" for c in parts)
    spark.createDataFrame(rows, f"at int, id string, head string, {fields}").write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[GaussianProcess | LowRankGaussianProcess, np.ndarray]:
    """The model and the theta it was saved with."""
    rows = spark.read.parquet(path).orderBy("at").collect()
    head = json.loads(rows[0].head)
    kind = next(k for k in _PARTS if k.__name__ == head["kind"])
    get = {c: np.array([r[c] for r in rows]) for c in _PARTS[kind]}
    get = {c: v[:, 0] if c in ("y", "weights", "z") else v for c, v in get.items()}
    ids = [json.loads(r.id) for r in rows]
    if kind is LowRankGaussianProcess:
        return LowRankGaussianProcess(head["alpha"], head["beta"]).fit_factor(ids, **get), np.array(head["theta"])
    model = GaussianProcess(head["alpha"], head["beta"], head["regularization"])
    model.ids, model.logdet = ids, head["logdet"]
    for c, v in get.items():
        setattr(model, c, v)
    return model, np.array(head["theta"])
