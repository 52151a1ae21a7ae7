"""Composable similarity functions between two attribute values (or two records of them).

One object gives the value as a Spark column, as vectorised numpy (all of x against all of y) and as SQL text, and the
derivatives with respect to its hyperparameters. Scalar arguments are columns or arrays; records are mappings from
feature names to them.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .expression import Node, parse

Bounds = tuple[float, float] | str


def _checked(name: str, bounds) -> Bounds:
    if bounds == "fixed":
        return bounds
    try:
        lo, hi = map(float, bounds)
    except (TypeError, ValueError):
        raise ValueError(f"bounds of {name} must be 'fixed' or a pair: {bounds!r}") from None
    if not lo <= hi:
        raise ValueError(f"bounds of {name} are not in order: {bounds!r}")
    return lo, hi


class MicroKernel:
    """Base: ``parts`` are sub-kernels, ``own`` the hyperparameters {name: (value, bounds)} of this node."""

    def __init__(self, parts: tuple = (), own: Mapping | None = None):
        self.parts = tuple(parts)
        self.own = {k: (float(v), _checked(k, b)) for k, (v, b) in (own or {}).items()}

    def __getattr__(self, name: str):
        own = self.__dict__.get("own", {})
        if name in own:
            return own[name][0]
        raise AttributeError(name)

    # hyperparameters, depth first: own ones, then those of the parts
    @property
    def theta(self) -> list[float]:
        return [v for v, _ in self.own.values()] + [t for p in self.parts for t in p.theta]

    @property
    def bounds(self) -> list[Bounds]:
        return [b for _, b in self.own.values()] + [b for p in self.parts for b in p.bounds]

    def with_theta(self, theta) -> MicroKernel:
        theta = list(theta)
        if len(theta) != len(self.theta):
            raise ValueError("wrong number of hyperparameters")
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        n = len(self.own)
        out.own = {k: (float(t), b) for (k, (_, b)), t in zip(self.own.items(), theta[:n], strict=True)}
        at, parts = n, []
        for p in self.parts:
            parts.append(p.with_theta(theta[at : at + len(p.theta)]))
            at += len(p.theta)
        out.parts = tuple(parts)
        return out

    @property
    def minmax(self) -> tuple[float, float] | tuple[None, None]:
        return (0.0, 1.0)

    def column(self, x, y) -> Column:
        raise NotImplementedError

    def sql(self, x, y) -> str:
        raise NotImplementedError

    def values(self, x, y) -> np.ndarray:
        """(len(x), len(y)) values; arguments are arrays, lists of arrays, or mappings to them."""
        return self.values_and_partials(x, y)[0]

    def values_and_partials(self, x, y) -> tuple[np.ndarray, list[np.ndarray]]:
        raise NotImplementedError

    def __call__(self, x, y) -> float:
        one = lambda v: {k: one(w) for k, w in v.items()} if isinstance(v, Mapping) else [v]
        return float(self.values(one(x), one(y))[0, 0])

    def __add__(self, other):
        return Sum(self, _kernel(other))

    __radd__ = __add__

    def __mul__(self, other):
        return Times(self, _kernel(other))

    __rmul__ = __mul__

    def __pow__(self, c):
        if isinstance(c, MicroKernel) and not isinstance(c, Constant):
            raise ValueError("the exponent must be a constant")
        return Power(self, _kernel(c))

    @property
    def normalized(self):
        return self if isinstance(self, Normalize) else Normalize(self)

    def __repr__(self) -> str:
        own = [f"{k}={v!r}" for k, (v, _) in self.own.items()]
        return f"{type(self).__name__}({', '.join([*map(repr, self.parts), *own])})"

    @staticmethod
    def from_formula(formula: str, hyper: Mapping[str, tuple[float, Bounds]], *, names: tuple[str, str] = ("x", "y"), minmax=(0.0, 1.0)) -> Formula:
        """A kernel from an expression in exactly two variables and hyperparameters {name: (value, bounds)}."""
        return Formula(parse(formula), hyper, names, minmax)


def _kernel(k) -> MicroKernel:
    return k if isinstance(k, MicroKernel) else Constant(k)


def _size(x) -> int:
    return len(next(iter(x.values()))) if isinstance(x, Mapping) else len(x)


class Constant(MicroKernel):
    def __init__(self, c: float, bounds: Bounds = "fixed"):
        super().__init__(own={"c": (c, bounds)})

    @property
    def minmax(self):
        return (self.c, self.c)

    def column(self, x, y):
        return F.lit(self.c)

    def sql(self, x, y):
        return f"CAST({self.c!r} AS DOUBLE)"

    def values_and_partials(self, x, y):
        one = np.ones((_size(x), _size(y)))
        return self.c * one, [one]


class KroneckerDelta(MicroKernel):
    """1 where equal, else h. NaN equals nothing; null equals null."""

    def __init__(self, h: float, h_bounds: Bounds = (1e-3, 1)):
        super().__init__(own={"h": (h, h_bounds)})

    @property
    def minmax(self):
        return (min(self.h, 1.0), max(self.h, 1.0))

    def column(self, x, y):
        nan = F.typeof(x).isin("float", "double") & (x.cast("string") == "NaN")  # the text is a label like others
        return F.when(x.eqNullSafe(y) & ~F.coalesce(nan, F.lit(False)), 1.0).otherwise(self.h)

    def sql(self, x, y):
        return f"(CASE WHEN {x} IS NOT DISTINCT FROM {y} AND NOT (typeof({x}) IN ('FLOAT', 'DOUBLE') AND lower(coalesce(CAST({x} AS VARCHAR), '')) = 'nan') THEN 1.0 ELSE {self.h!r} END)"

    def values(self, x, y):
        return np.where(_equal(x, y), 1.0, self.h)

    def values_and_partials(self, x, y):
        same = _equal(x, y)
        return np.where(same, 1.0, self.h), [np.where(same, 0.0, 1.0)]


def _equal(x, y) -> np.ndarray:
    a, b = np.asarray(x), np.asarray(y)
    return np.asarray(a[:, None] == b[None], bool)


class Formula(MicroKernel):
    def __init__(self, expr: Node, hyper: Mapping, names=("x", "y"), minmax=(0.0, 1.0)):
        super().__init__(own=hyper)
        if len(names) != 2 or not set(names) <= expr.free() | set(names) or expr.free() - set(names) - set(hyper):
            raise ValueError("a formula has exactly two variables and its hyperparameters")
        self.expr, self.names, self._minmax = expr, names, minmax

    @property
    def minmax(self):
        return self._minmax

    def _env(self, x, y) -> dict:
        return {self.names[0]: x, self.names[1]: y, **{k: v for k, (v, _) in self.own.items()}}

    def column(self, x, y):
        return self.expr.column(self._env(x.cast("double"), y.cast("double")))

    def sql(self, x, y):
        return self.expr.sql(self._env(f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)"))

    def values(self, x, y):
        with np.errstate(all="ignore"):
            return np.broadcast_to(self.expr.numpy(self._env(np.asarray(x, float)[:, None], np.asarray(y, float)[None])), (_size(x), _size(y)))

    def values_and_partials(self, x, y):
        env = self._env(np.asarray(x, float)[:, None], np.asarray(y, float)[None])
        shape = (_size(x), _size(y))
        with np.errstate(all="ignore"):
            return np.broadcast_to(self.expr.numpy(env), shape), [np.broadcast_to(self.expr.diff(k).numpy(env), shape) for k in self.own]


class SquareExponential(Formula):
    def __init__(self, length_scale: float, length_scale_bounds: Bounds = (1e-6, np.inf)):
        super().__init__(parse("exp(-(x - y)**2 / (2 * length_scale**2))"), {"length_scale": (length_scale, length_scale_bounds)})


class RationalQuadratic(Formula):
    def __init__(self, length_scale: float, alpha: float, length_scale_bounds: Bounds = (1e-6, np.inf), alpha_bounds: Bounds = (1e-3, np.inf)):
        super().__init__(parse("(1 + (x - y)**2 / (2 * alpha * length_scale**2))**(0 - alpha)"), {"length_scale": (length_scale, length_scale_bounds), "alpha": (alpha, alpha_bounds)})


class Product(Formula):
    def __init__(self):
        super().__init__(parse("x * y"), {}, minmax=(None, None))


class DotProduct(MicroKernel):
    """Inner product of two arrays; 0 for empty ones. Components that only one of them has count as null, so the value is null (NaN)."""

    @property
    def minmax(self):
        return (None, None)

    def column(self, x, y):
        pairs = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)

    def sql(self, x, y):
        return f"coalesce(list_sum(list_transform(list_zip({x}, {y}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 0)"

    def values_and_partials(self, x, y):
        sx, sy = np.array([len(a) for a in x], int), np.array([len(b) for b in y], int)
        a, b = np.zeros((len(x), max(sx.max(initial=0), sy.max(initial=0)))), np.zeros((len(y), max(sx.max(initial=0), sy.max(initial=0))))
        for m, z in ((a, x), (b, y)):
            for i, row in enumerate(z):
                m[i, : len(row)] = row
        return np.where(sx[:, None] == sy[None], a @ b.T, np.nan), []


class Convolution(MicroKernel):
    """Mean (or sum) of a kernel over all pairs of two arrays' elements."""

    def __init__(self, kernel: MicroKernel, mean: bool = True):
        super().__init__((kernel,))
        self.mean = mean

    @property
    def minmax(self):
        return self.parts[0].minmax if self.mean else (None, None)

    def column(self, x, y):
        k = self.parts[0]
        total = F.aggregate(x, F.lit(0.0), lambda s, a: s + F.aggregate(y, F.lit(0.0), lambda t, b: t + k.column(a, b)))
        return total / (F.size(x) * F.size(y)) if self.mean else total

    def sql(self, x, y):
        k = self.parts[0].sql("a_", "b_")
        total = f"coalesce(list_sum(list_transform({x}, lambda a_: list_sum(list_transform({y}, lambda b_: {k})))), 0)"
        return f"({total} / (len({x}) * len({y})))" if self.mean else total

    def values_and_partials(self, x, y):
        n, m = len(x), len(y)
        sx, sy = np.array([len(a) for a in x], int), np.array([len(b) for b in y], int)
        fx, fy = (np.concatenate([np.asarray(a) for a in z]) if len(z) else np.zeros(0) for z in (x, y))
        v, g = self.parts[0].values_and_partials(fx, fy)
        row, col = np.repeat(np.arange(n), sx), np.repeat(np.arange(m), sy)

        def fold(z):
            out = np.zeros((n, m))
            np.add.at(out, (row[:, None], col[None]), z)
            with np.errstate(all="ignore"):
                return out / (sx[:, None] * sy[None]) if self.mean else out

        return fold(v), [fold(z) for z in g]


class Composite(MicroKernel):
    """Kernels of named features folded by + or *; derivatives of a product replace one factor (no division)."""

    def __init__(self, op: str, **features: MicroKernel):
        if op not in ("+", "*"):
            raise ValueError("op must be '+' or '*'")
        super().__init__(tuple(features.values()))
        self.op, self.names = op, tuple(features)

    @property
    def minmax(self):
        return _fold_range(self.op, [p.minmax for p in self.parts])

    def column(self, x, y):
        get = lambda r, n: r[n] if isinstance(r, Mapping) else r.getField(n)
        return reduce((lambda a, b: a + b) if self.op == "+" else (lambda a, b: a * b), [k.column(get(x, n), get(y, n)) for n, k in zip(self.names, self.parts, strict=True)])

    def sql(self, x, y):
        get = lambda r, n: r[n] if isinstance(r, Mapping) else f"{r}.{n}"
        return "(" + f" {self.op} ".join(k.sql(get(x, n), get(y, n)) for n, k in zip(self.names, self.parts, strict=True)) + ")"

    def values(self, x, y):
        return reduce(np.add if self.op == "+" else np.multiply, [k.values(x[n], y[n]) for n, k in zip(self.names, self.parts, strict=True)])

    def values_and_partials(self, x, y):
        return _folded(self.op, [k.values_and_partials(x[n], y[n]) for n, k in zip(self.names, self.parts, strict=True)])


def _folded(op, got):
    vals = [v for v, _ in got]
    total = reduce(np.add if op == "+" else np.multiply, vals)
    grads = []
    for i, (_, g) in enumerate(got):
        rest = reduce(np.multiply, [v for j, v in enumerate(vals) if j != i], 1.0) if op == "*" else 1.0
        grads += [z * rest for z in g]
    return total, grads


def _fold_range(op, ranges):
    if any(None in r for r in ranges):
        return (None, None)
    f = (lambda z: sum(z)) if op == "+" else (lambda z: float(np.prod(z)))
    return (f([r[0] for r in ranges]), f([r[1] for r in ranges]))


def TensorProduct(**features: MicroKernel) -> Composite:
    return Composite("*", **features)


def Additive(**features: MicroKernel) -> Composite:
    return Composite("+", **features)


class _Fold(MicroKernel):
    op = "+"

    def __init__(self, a: MicroKernel, b: MicroKernel):
        super().__init__((a, b))

    @property
    def minmax(self):
        return _fold_range(self.op, [p.minmax for p in self.parts])

    def column(self, x, y):
        a, b = (p.column(x, y) for p in self.parts)
        return a + b if self.op == "+" else a * b

    def sql(self, x, y):
        return f"({self.parts[0].sql(x, y)} {self.op} {self.parts[1].sql(x, y)})"

    def values(self, x, y):
        return (np.add if self.op == "+" else np.multiply)(*[p.values(x, y) for p in self.parts])

    def values_and_partials(self, x, y):
        return _folded(self.op, [p.values_and_partials(x, y) for p in self.parts])


class Sum(_Fold):
    op = "+"


class Times(_Fold):
    op = "*"


class Power(MicroKernel):
    def __init__(self, base: MicroKernel, exponent: Constant):
        super().__init__((base, exponent))

    @property
    def minmax(self):
        lo, hi = self.parts[0].minmax
        return (None, None) if lo is None else (lo**self.parts[1].c, hi**self.parts[1].c)

    def column(self, x, y):
        return F.pow(self.parts[0].column(x, y), F.lit(self.parts[1].c))

    def sql(self, x, y):
        return f"pow({self.parts[0].sql(x, y)}, {self.parts[1].c!r})"

    def values_and_partials(self, x, y):
        v, g = self.parts[0].values_and_partials(x, y)
        c = self.parts[1].c
        with np.errstate(all="ignore"):
            out = v**c
            return out, [c * v ** (c - 1) * z for z in g] + [out * np.log(v)]


class Normalize(MicroKernel):
    """k(x, y) / sqrt(k(x, x) k(y, y)); 0 where a diagonal value is not positive."""

    def __init__(self, kernel: MicroKernel):
        super().__init__((kernel.parts[0] if isinstance(kernel, Normalize) else kernel,))

    def column(self, x, y):
        k = self.parts[0]
        a, b = k.column(x, x), k.column(y, y)
        return F.when((a > 0) & (b > 0), k.column(x, y) / F.sqrt(a * b)).otherwise(0.0)

    def sql(self, x, y):
        k = self.parts[0]
        a, b = k.sql(x, x), k.sql(y, y)
        return f"(CASE WHEN {a} > 0 AND {b} > 0 THEN {k.sql(x, y)} / sqrt({a} * {b}) ELSE 0.0 END)"

    def values_and_partials(self, x, y):
        k = self.parts[0]
        v, g = k.values_and_partials(x, y)

        def diagonal(z):
            cut = lambda r, i: {n: c[i : i + 32] for n, c in r.items()} if isinstance(r, Mapping) else r[i : i + 32]
            got = [k.values_and_partials(cut(z, i), cut(z, i)) for i in range(0, _size(z), 32)]  # blocks along the diagonal
            pick = lambda ms: np.concatenate([np.diagonal(m) for m in ms]) if got else np.zeros(0)
            return pick([a for a, _ in got]), np.stack([pick([b[i] for _, b in got]) for i in range(len(g))], 1) if g else np.zeros((_size(z), 0))

        (a, ga), (b, gb) = diagonal(x), diagonal(y)
        ok = (a[:, None] > 0) & (b[None] > 0)
        with np.errstate(all="ignore"):
            root = np.sqrt(a[:, None] * b[None])
            out = np.where(ok, v / root, 0.0)
            grads = [np.where(ok, z / root - 0.5 * out * (ga[:, [i]] / a[:, None] + gb[:, i][None] / b[None]), 0.0) for i, z in enumerate(g)]
        return out, grads


def check_range(kernel: MicroKernel, what: str, *, open_below: bool) -> None:
    """Warn when values may leave (0, 1] (nodes) or [0, 1] (edges), outside of which the walk series may diverge."""
    lo, hi = kernel.minmax
    if lo is None or hi > 1 + 1e-9 or lo < 0 or (open_below and lo <= 0):
        warnings.warn(f"the {what} kernel may leave its range: {lo} to {hi}", stacklevel=3)


Feature = Callable[[Column, Column], Column]
